"""Line dedup with a log-template tree.

A line's tokens are parted by ASCII white space; those with a digit, an at sign, a quote or ``://`` are variable from the
start and read ``<*>``. The tree is of fixed depth: first the number of tokens, then the first `depth` tokens; the leaf
holds the line's templates. Within a leaf the other tokens fall into `blocks` even blocks, and besides the line as it is
every line that leaves out one or two of them is a template (their tokens read ``<*>``), as long as the share `alike` of
its tokens is constant. Lines of a leaf that differ in one or two blocks only so meet in the template that generalises
the differing fields, whatever order they come in, and no line is ever compared with another.

A template that occurs in `least` documents or more is recurring; a line of over `longer` tokens recurs, token for
token, from `repeats` documents on. Their lines go from every document but the one with the smallest doc_id, so
that no template goes altogether. Templates without a constant token, and blank lines, never recur. With `copies`, a document
that would lose more than that share of its words stays whole: it is a copy, and near-duplicate detection needs its text.

Counts come from all documents, one row for each document and template, summed in each part before the exchange. The
recurring templates are met with the documents' own under a salted key, as one may be in a third of all documents.

Cases: null texts stay null and have no lines, empty ones stay empty; rows that share a doc_id count as so many
documents and keep their lines alike; a null doc_id is never the first, so its recurring lines go if another
document has them; ties of doc_id and repeated rows are kept as they are; lines and texts of any length are read whole;
an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.llm.common import only, whole_number, written
from tabveil.llm.words import U, Words, mix, pieces, powers, runs

VARIABLE = "<*>"
#: Tree depth, blocks of a line behind the leading tokens, and constant tokens of ten that a generalised template keeps.
DEPTH, BLOCKS, ALIKE = 1, 4, 6
_BASE = 0xD1342543DE82EF95 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WILD = U(0x5BD1E995)
_LEFT_OUT = [s for k in (1, 2) for s in combinations(range(BLOCKS), k)]
NO_DOC = (1 << 63) - 1


def template(line: str) -> list[str]:
    """The line's tokens, the variable ones masked."""
    variable = lambda t: any(c.isdigit() and c.isascii() or c in '@"' for c in t) or "://" in t
    return [VARIABLE if variable(t) else t for t in (x.decode() for x in line.encode().split())]


def path(tokens: list[str], depth: int = DEPTH) -> tuple[int, tuple[str, ...]]:
    """(token count, leading tokens): the way to the template's leaf."""
    return len(tokens), tuple(tokens[:depth])


def generalised(tokens: list[str]) -> list[tuple[str, ...]]:
    """The masked line and all templates that leave out one or two of its blocks and stay constant enough."""
    n, m, out = len(tokens), len(tokens) - DEPTH, {tuple(tokens): None}
    for left in _LEFT_OUT if m > 0 else ():
        gone = {k for b in left for k in range(DEPTH + b * m // BLOCKS, DEPTH + (b + 1) * m // BLOCKS)}
        found = tuple(VARIABLE if k in gone else t for k, t in enumerate(tokens))
        if 10 * sum(t != VARIABLE for t in found) >= ALIKE * n:
            out[found] = None
    return [t for t in out if any(x != VARIABLE for x in t)]


class Lines:
    """Lines of some texts (doc, line of the doc, size in tokens) and the keys of their templates (of: place of the line; node; leaf).

    node is a hash of the path to the leaf, leaf one of a template in it; lines that are compared token for token have node 0.
    """

    def __init__(self, texts: list[bytes], longer: int = 10, templates: bool = True, repeats: bool = True):
        words = Words(texts)
        count = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        b = words.buf
        odd = ((b >= 0x30) & (b <= 0x39)) | (b == 0x40) | (b == 0x22)
        odd[: max(len(b) - 2, 0)] |= (b[:-2] == 0x3A) & (b[1:-1] == 0x2F) & (b[2:] == 0x2F) if len(b) > 2 else False
        flags, breaks = count(odd), count(b == 0x0A)
        variable = flags[words.end] > flags[words.start]
        number = breaks[words.start]
        at = runs(number)
        start, size = (at[:-1], np.diff(at)) if len(words) else (np.zeros(0, np.int64),) * 2
        self.words = words.n
        self.doc, self.size = words.doc[start], size
        self.line = number[start] - breaks[words.text_start[self.doc]]
        of, node, leaf = [], [], []
        plain, places, back = words.hashes(), powers(_BASE, max(len(words), 1)), powers(_INVERSE, max(len(words), 1))
        summed = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * places[: len(x)], dtype=np.uint64)])
        if repeats:
            sums, own = summed(plain), np.flatnonzero(size > longer)
            a, z = start[own], start[own] + size[own]
            of.append(own)
            node.append(np.zeros(len(own), np.uint64))
            leaf.append(mix((sums[z] - sums[a]) * back[a] ^ U(0x3C6EF372)))
        if templates:
            h = np.where(variable, _WILD, plain)
            sums, constant, ones = summed(h), count(~variable), summed(np.full(len(h), _WILD))
            whole = (sums[start + size] - sums[start]) * back[start]
            way = mix((sums[start + np.minimum(size, DEPTH)] - sums[start]) * back[start] + mix(size.astype(np.uint64)))
            fixed = constant[start + size] - constant[start]
            m = np.maximum(size - DEPTH, 0)
            edge = [DEPTH + k * m // BLOCKS for k in range(BLOCKS + 1)]
            edge = [start + np.minimum(e, size) for e in edge]
            loss = [constant[z] - constant[a] for a, z in zip(edge[:-1], edge[1:], strict=True)]
            # What a block's tokens give the sum, and what wild cards would.
            swap = [(ones[z - start] - ones[a - start]) - (sums[z] - sums[a]) * back[start] for a, z in zip(edge[:-1], edge[1:], strict=True)]
            for left in ((), *_LEFT_OUT):
                lost = sum((loss[k] for k in left), np.zeros(len(start), np.int64))
                if left:
                    keep = (lost > 0) & (10 * (fixed - lost) >= ALIKE * size)
                    if len(left) == 2:
                        keep &= (loss[left[0]] > 0) & (loss[left[1]] > 0)
                else:
                    keep = fixed > 0
                own = np.flatnonzero(keep)
                of.append(own)
                node.append(way[own])
                leaf.append(mix(sum((swap[k][own] for k in left), whole[own]) ^ U(0xA5A5A5A5)))
        self.of, self.node, self.leaf = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (of, node, leaf))
        self.of = self.of.astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, node, leaf), each once."""
        doc = self.doc[self.of]
        order = np.lexsort((self.leaf, self.node, doc))
        d, a, b = doc[order], self.node[order], self.leaf[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return d[new], a[new].view(np.int64), b[new].view(np.int64)


_KEYS = "a long, b long, n long, first long"


def recurring(docs: DataFrame, least: int | None = 10, longer: int = 10, repeats: int | None = 2) -> DataFrame:
    """(a, b, n, first): keys of recurring templates, in how many documents, and the smallest doc_id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", 3_000_000):
            ids = part.column(0).fill_null(NO_DOC).to_numpy()
            d, a, b = Lines(texts, longer, least is not None, repeats is not None).distinct()
            doc = ids[d]
            order = np.lexsort((doc, b, a))
            a, b, doc = a[order], b[order], doc[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], np.diff(np.append(at, len(a))), doc[at])], ["a", "b", "n", "first"])

    rows = whole_number(only(docs, doc_id="doc_id", text="text"), "doc_id").mapInArrow(count, _KEYS)
    enough = F.when(F.col("a") == 0, F.lit(repeats)).otherwise(F.lit(least))
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= enough)


def dropped(docs: DataFrame, least: int | None = 10, longer: int = 10, repeats: int | None = 2, copies: float = 1.0, salts: int = 16) -> DataFrame:
    """docs with text without its recurring lines, and n_lines, n_dropped; text is null where it was."""
    known = written(recurring(docs, least, longer, repeats), "templates").select("a", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", 3_000_000):
            d, a, b = Lines(texts, longer, least is not None, repeats is not None).distinct()
            ids, key = part.column(0).to_numpy(), part.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[d], key[d], (d % salts).astype(np.int32), a, b)], ["doc_id", "key", "salt", "a", "b"])

    plain = whole_number(only(docs, doc_id="doc_id", text="text"), "doc_id").select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    own = plain.mapInArrow(keys, "doc_id long, key long, salt int, a long, b long")
    hit = own.join(known, ["a", "b", "salt"]).where("doc_id <> first").select("doc_id", "key", "b").groupBy("doc_id", "key").agg(F.collect_set("b").alias("_gone"))
    names = docs.columns
    rows = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), "_key": F.xxhash64("text")})
    rows = rows.join(hit.withColumnsRenamed({"doc_id": "_doc", "key": "_key"}), ["_doc", "_key"], "left").select(*names, "_gone")
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                texts, gone = part.column(at).to_pylist(), [0] * part.num_rows
                n_lines = [t.count("\n") + 1 if t else 0 for t in texts]
                hits = part.column(len(names))
                rows_hit = [i for i in range(part.num_rows) if hits[i].is_valid]
                found = Lines([texts[i].encode() for i in rows_hit], longer, least is not None, repeats is not None)
                drop = lines_hit(found, [hits[i].values.to_numpy() for i in rows_hit], copies)
                for d, own in drop.items():
                    i = rows_hit[d]
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in own)
                    gone[i] = len(own)
                columns = [pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.mapInArrow(cut, schema)


def lines_hit(found: Lines, gone: list[np.ndarray], copies: float) -> dict[int, set[int]]:
    """Document -> its lines that have a key of its own in gone; none for those that would lose over the share `copies` of their words."""
    if not gone:
        return {}
    tag = lambda doc, leaf: mix(leaf ^ mix(doc.astype(np.uint64)))
    sought = tag(np.repeat(np.arange(len(gone)), [len(x) for x in gone]), np.concatenate(gone).view(np.uint64))
    lines = np.unique(found.of[np.isin(tag(found.doc[found.of], found.leaf), sought)])
    lost = np.bincount(found.doc[lines], found.size[lines], minlength=len(gone))
    lines = lines[lost[found.doc[lines]] <= copies * found.words[found.doc[lines]]]
    out: dict[int, set[int]] = {}
    for d, k in zip(found.doc[lines].tolist(), found.line[lines].tolist(), strict=True):
        out.setdefault(d, set()).add(k)
    return out


def report(docs: DataFrame, least: int = 10, longer: int = 10, repeats: int | None = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that stays; null: empty)."""
    rows = dropped(only(docs, doc_id="doc_id", text="text"), least, longer, repeats)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def plain_report(rows: list[tuple[int | None, str | None]], least: int = 10, longer: int = 10, repeats: int = 2) -> list[tuple]:
    """What report gives, by a plain loop; for tests."""

    def keys(line: str) -> list[tuple]:
        tokens = line.encode().split()
        return [(least, t) for t in generalised(template(line))] + [(repeats, tuple(tokens))] * (len(tokens) > longer)

    docs: dict[tuple, list[int]] = {}
    for doc, text in rows:
        for key in {k for x in (text or "").split("\n") for k in keys(x)}:
            docs.setdefault(key, []).append(NO_DOC if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = text.split("\n") if text else []
        own = NO_DOC if doc is None else doc
        kept = [x for x in lines if not any(len(d := docs[k]) >= k[0] and min(d) != own for k in keys(x))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
