"""Benchmark decontamination with an FM-index for each training shard.

Words are runs of digits, letters and non-ASCII characters, with A-Z in lower case. A window is `size`
consecutive words of a benchmark item, or all words of a shorter one. Each shard (a few MB of documents) becomes
a sequence of benchmark word numbers: a run of fewer words of the benchmark's vocabulary than the shortest
window cannot hold one, and is left out with everything else outside that vocabulary. The sequence's suffix
array gives its Burrows-Wheeler transform, held as a wavelet tree; all windows are searched backward through it
at once, and their places come from every 16th suffix position by walking back.

The documents pass through in one scan, without a shuffle. Windows are broadcast in blocks of some `block` bytes
of benchmark text, as measured, whatever the size of the benchmark; each block is a step of the same scan.

Cases: null texts and texts without words have no hits; null doc_ids, ties and repeated rows keep a row each; an
item without words is no window; item ids of any type are taken as text; an item with a null id hits but is not listed; an empty benchmark hits nothing;
empty documents give an empty result; texts of any length are indexed whole; columns of docs named hit_words, hit_spans or
hit_items keep their values in `removed`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.llm.common import aside, only
from tabveil.llm.words import ALNUM, Words, pieces, runs

SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; after each round only the suffixes that are still tied are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    at = runs(s[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at[:-1], np.diff(at))
    left, k = order[np.repeat(np.diff(at) > 1, np.diff(at))], 1
    while len(left):
        after = left + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        left, key = left[by], key[by]
        group, at = rank[left], runs(key)
        in_group = runs(group)
        base = np.repeat(in_group[:-1], np.diff(in_group))
        size = np.diff(at)
        rank[left] = group + np.repeat(at[:-1], size) - base
        left, k = left[np.repeat(size > 1, size)], 2 * k
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class WaveletTree:
    """Rank of a symbol in a prefix, for many symbols and prefixes at once; a level holds one bit of each symbol."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(upto), upto
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1) == 1
            ones, zeros = self.ones[level], self.zeros[level]
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """s: symbols from 1 on; a 0 is appended as the end."""

    def __init__(self, s: np.ndarray):
        s = np.append(s, 0).astype(np.int64)
        self.n = len(s)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        largest = int(s.max())
        self.less = np.zeros(largest + 2, np.int64)
        np.cumsum(np.bincount(s, minlength=largest + 1), out=self.less[1:])
        self.tree = WaveletTree(self.bwt, largest)
        self.largest = largest
        self.marked = sa % SAMPLE == 0
        self.mark_rank = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.marked, out=self.mark_rank[1:])
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase (a row of symbols)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            open_ = np.flatnonzero((low < high) & (phrases[:, j] <= self.largest))
            dead = np.ones(len(phrases), bool)
            dead[open_] = False
            c = phrases[open_, j]
            low[open_], high[open_] = self.less[c] + self.tree.rank(c, low[open_]), self.less[c] + self.tree.rank(c, high[open_])
            high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, out, at = np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(at):
            done = self.marked[rows]
            out[at[done]] = self.samples[self.mark_rank[rows[done]]] + steps[at[done]]
            at, rows = at[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.less[c] + self.tree.rank(c, rows)
            steps[at] += 1
        return out % self.n


@dataclass
class Phrases:
    """vocabulary: sorted word hashes; by_length: length -> (windows as rows of symbols, of which items)."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, list[list[str | None]]]]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], size: int) -> Phrases:
        words = Words([(t or "").encode() for _, t in items], ALNUM, lower=True)
        vocabulary, number = np.unique(words.hashes(), return_inverse=True)
        found: dict[int, dict[tuple, dict[str | None, None]]] = {}
        for i, (item, _) in enumerate(items):
            own = number[words.first[i] : words.first[i + 1]] + 2
            length = min(size, len(own))
            for k in range(len(own) - length + 1) if length else ():
                found.setdefault(length, {}).setdefault(tuple(own[k : k + length].tolist()), {})[item] = None
        return cls(vocabulary, {n: (np.array(list(w), np.int64), [list(x) for x in w.values()]) for n, w in found.items()})


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str | None]]]:
    """(first word, number of words, items) of each occurrence of a window in a shard's documents."""
    nothing = np.zeros(0, np.int64)
    if not len(words) or not phrases.by_length:
        return nothing, nothing, []
    h = words.hashes()
    number = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[number] == h
    # Runs of known words within a document; the short ones hold no window.
    edge = np.ones(len(words), bool)
    edge[1:] = (known[1:] != known[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.append(np.flatnonzero(edge), len(words))
    keep = known[at[:-1]] & (np.diff(at) >= min(phrases.by_length))
    starts, sizes = at[:-1][keep], np.diff(at)[keep]
    if not len(starts):
        return nothing, nothing, []
    # Each run with a 1 behind it, that no window holds.
    offset = np.concatenate([[0], np.cumsum(sizes + 1)])
    place = np.arange(offset[-1]) - np.repeat(offset[:-1], sizes + 1) + np.repeat(starts, sizes + 1)
    s = np.where(np.isin(np.arange(offset[-1]), offset[1:] - 1), 1, number[np.minimum(place, len(words) - 1)] + 2)
    index = FMIndex(s)
    first, length, of = [], [], []
    for n, (rows, items) in phrases.by_length.items():
        low, high = index.search(rows)
        hit = np.flatnonzero(low < high)
        count = (high - low)[hit]
        where = index.locate(np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()))
        first.append(place[where])
        length.append(np.full(len(where), n))
        of += [items[i] for i in np.repeat(hit, count)]
    return np.concatenate(first), np.concatenate(length), of


_HIT = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [T.StructField("hit_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(_HIT)), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def marked(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = 8_000_000, remove: bool = False) -> DataFrame:
    """docs with n_words as hit_words, hit_items, and hit_spans: merged spans of words [first, last) and UTF-8 bytes [start, end).

    block: bytes of benchmark text that are sent to the executors at once; remove: the last block takes the spans out of the texts too.
    """
    items = only(benchmark, item="item_id", body="text").withColumn("item", F.col("item").cast("string"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // block))
    if blocks > 1:
        items = items.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(blocks)))
    schema = T.StructType([f for f in docs.schema.fields if f.name not in {x.name for x in FOUND}] + FOUND)
    plain = [f.name for f in schema.fields[: -len(FOUND)]]
    docs = docs.select(*[F.col(f"`{c}`") for c in plain])
    for k in range(blocks):
        rows = items.where(F.col("part") == k) if blocks > 1 else items
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases.of([(r["item"], r["body"]) for r in rows.select("item", "body").collect()], size))
        docs = docs.mapInArrow(_marker(phrases, plain, remove and k == blocks - 1), schema)
    return docs


def _marker(phrases: Broadcast, plain: list[str], remove: bool = False):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", 1_500_000):
            words = Words(texts, ALNUM, lower=True)
            first, length, of = occurrences(words, phrases.value)
            spans: list[list[dict]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            before = len(part.schema.names) > len(plain)
            if before:
                for i, (s, x) in enumerate(zip(part.column(len(plain) + 1).to_pylist(), part.column(len(plain) + 2).to_pylist(), strict=True)):
                    items[i] = set(x)
                    if s:
                        first = np.concatenate([first, [y["first"] + words.first[i] for y in s]])
                        length = np.concatenate([length, [y["last"] - y["first"] for y in s]])
                        of += [[]] * len(s)
            if len(first):
                doc = words.doc[first]
                for d, x in zip(doc.tolist(), of, strict=True):
                    items[d].update(y for y in x if y is not None)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + length, -1)
                hit = np.cumsum(cover[:-1]) > 0
                cut = hit.copy()
                cut[1:] &= ~(hit[:-1] & (words.doc[1:] == words.doc[:-1]))
                for a in np.flatnonzero(cut):
                    d = words.doc[a]
                    stop = words.first[d + 1]
                    gap = np.flatnonzero(~hit[a:stop])
                    b = a + gap[0] if len(gap) else stop
                    t = words.text_start[d]
                    spans[d].append({"first": int(a - words.first[d]), "last": int(b - words.first[d]), "start": int(words.start[a] - t), "end": int(words.end[b - 1] - t)})
            columns = part.columns[: len(plain)]
            if remove:
                at = plain.index("text")
                columns[at] = pa.array([x.as_py() if not s else without_spans(t, s) for x, t, s in zip(columns[at], texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words.n, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*plain, *(f.name for f in FOUND)])

    return mark


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words)."""
    found = marked(only(docs, doc_id="doc_id", text="text"), benchmark, size)
    ids = F.array_join(F.array_sort("hit_items"), ",")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        "doc_id", F.col("hit_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"), F.transform("hit_spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))).alias("spans"),
    )


def removed(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs with the text of hit spans taken out (n_chars, if there, follows); all columns stay."""
    docs, back = aside(docs, [f.name for f in FOUND])
    names = docs.columns
    found = marked(docs, benchmark, size, remove=True).select(*names).withColumnsRenamed(back)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else found


def without_spans(raw: bytes, spans: list[dict]) -> str:
    left, at = [], 0
    for s in spans:
        left.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*left, raw[at:]]).decode()
