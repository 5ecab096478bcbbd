"""Substring dedup with fixed-block anchors.

A word goes if a run of `span` words around it also starts in a document with a smaller doc_id. Any such run
holds a whole block of `span // 2` words that begins at a multiple of that in the smaller document. So

1. the blocks at those places are the index and the runs of `span // 2` words at every place are the probes; all
   are dealt by a hash of their words. A probe that meets a block of a smaller doc_id is a hit, and so is the block;
2. around each hit, the runs of `span` words that hold it, which are the hit's extensions to either side, are dealt by
   their own hash; those which a run of a smaller doc_id with the same 96 bits of two independent hashes confirms are repeats. Neighbouring repeats join to the maximal exact repeat of that place;
3. the words of a document's repeats are taken out.

What is dealt is packed: one row for each part of a few MB of text and each bucket, with some five bytes a probe,
and not a row for each. A run that a third of all documents share is in one bucket once a document, beside some
hundreds of other runs of the same documents elsewhere; a bucket holds packed numbers only, never texts, and there are so
many buckets that one has some `bucket_bytes`, whatever the size of the corpus.

Cases: null and empty texts have no words; rows with a null doc_id are kept whole and remove nothing elsewhere;
rows that share a doc_id never remove from one another, and each is judged by its own text; repeated rows keep a row each; an
empty table gives an empty result; texts of any length are read whole; extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import even_keys, only, partitions, whole_number
from tabveil.llm.words import U, Words, mix, pieces, runs, windows

_RUN = np.dtype([("a", "<u8"), ("b", "<u4")])
_PACKED = ["bucket", "docs", "keys", "counts", "gaps", "hashes"]
_PACKED_TYPE = "bucket int, docs binary, keys binary, counts binary, gaps binary, hashes binary"


def _by_bytes(x: np.ndarray, kind: str) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: the upper ones are mostly alike and pack to little."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed_rows(bucket: np.ndarray, hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch | None:
    """Rows of a part, by bucket. doc: place of the document in ids and keys; at: word of the document. In order of (doc, at)."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    edge = runs(bucket[order])
    out: list[list] = [[] for _ in _PACKED]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = order[a:b]
        d = doc[own]
        first = runs(d)
        here, place = d[first[:-1]], at[own]
        gaps = np.diff(place, prepend=0)
        gaps[first[:-1]] = place[first[:-1]]
        out[0].append(int(bucket[own[0]]))
        out[1].append(_by_bytes(ids[here], "<i8"))
        out[2].append(keys[here].astype("<i4").tobytes())
        out[3].append(_by_bytes(np.diff(first), "<u4"))
        out[4].append(_by_bytes(gaps, "<u4"))
        out[5].append(hashes[own].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], _PACKED)


def _unpacked(table: pa.Table, kind: str | type | np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, doc ids, keys, word places) of each packed row."""
    for batch in table.to_batches():
        columns = [batch.column(k) for k in range(1, 6)]
        for i in range(batch.num_rows):
            docs, keys, counts, gaps, hashes = (c[i].as_py() for c in columns)
            n, gap = _numbers(counts, "<u4").astype(np.int64), _numbers(gaps, "<u4").astype(np.int64)
            total = np.cumsum(gap)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = total - np.repeat(total[first] - gap[first], n)
            yield np.frombuffer(hashes, kind), np.repeat(_numbers(docs, "<i8"), n), np.repeat(np.frombuffer(keys, "<i4"), n), place


def _places(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], groups: np.ndarray) -> pa.Table:
    """Packed rows again, one for each group of documents at most: groups has their keys."""
    if not found:
        return pa.table([pa.array([], pa.int32() if k == 0 else pa.binary()) for k in range(6)], names=_PACKED)
    docs, keys, places = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((places, keys, docs))
    docs, keys, places = docs[order], keys[order], places[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    number = np.cumsum(new) - 1
    of = groups[(mix(docs[new].view(np.uint64) ^ keys[new].astype(np.int64).view(np.uint64)) % U(len(groups))).astype(np.int64)]
    return pa.Table.from_batches([_packed_rows(of[number], np.zeros(len(docs), np.uint8), number, places, docs[new], keys[new])])


_PLACES_TYPE = "doc_id long, key int, places array<int>"


def _by_document(rows: DataFrame) -> DataFrame:
    """(doc_id, key, places) of what _places has packed."""

    def unpack(key: tuple, table: pa.Table) -> pa.Table:
        docs, keys, places = (np.concatenate(x) for x in zip(*(x[1:] for x in _unpacked(table, np.uint8)), strict=True))
        order = np.lexsort((keys, docs))
        docs, keys, places = docs[order], keys[order], places[order].astype(np.int32)
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
        at = np.append(np.flatnonzero(new), len(docs)).astype(np.int32)
        return pa.table([pa.array(docs[new]), pa.array(keys[new]), pa.ListArray.from_arrays(pa.array(at), pa.array(places))], names=["doc_id", "key", "places"])

    return rows.groupBy("bucket").applyInArrow(unpack, _PLACES_TYPE)


def _runs_in_documents(words: Words, size: int) -> np.ndarray:
    """Places from which `size` words lie in one document."""
    n = len(words) - size + 1
    return np.flatnonzero(words.doc[:n] == words.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def repeats(docs: DataFrame, span: int = 50, part_bytes: int = 1_500_000, bucket_bytes: int = 64_000_000) -> DataFrame:
    """(doc_id, key, text, places): each row of docs with the first words of its repeats (null: none). key: hash of the text."""
    block, per = span // 2, partitions(docs.sparkSession)
    # A probe has some 5 bytes, a word at least 2; the buckets of a partition are handled one by one.
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = per * max(1, -(-length * 5 // 6 // (bucket_bytes * per)))
    keys = np.array(even_keys(docs.sparkSession, buckets), np.int32)
    plain = whole_number(only(docs, doc_id="doc_id", text="text"), "doc_id").select("doc_id", F.hash("text").alias("key"), "text")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", part_bytes):
            words = Words(texts)
            starts = _runs_in_documents(words, block)
            h = windows(words.hashes(), block)[starts]
            doc = words.doc[starts]
            rows = _packed_rows(keys[((h >> U(32)) % U(buckets)).astype(np.int64)], h.astype("<u4"), doc, starts - words.first[doc], part.column(0).to_numpy(), part.column(1).to_numpy())
            if rows:
                yield rows

    def hits(key: tuple, table: pa.Table) -> pa.Table:
        index: list[tuple] = []
        for h, doc, own, place in _unpacked(table, "<u4"):
            at = place % block == 0
            index.append((h[at], doc[at], own[at], place[at]))
        h, doc, own, place = (np.concatenate(x) for x in zip(*index, strict=True))
        order = np.lexsort((doc, h))
        h, doc, own, place = h[order], doc[order], own[order], place[order]
        edge = runs(h)
        values, least = h[edge[:-1]], doc[edge[:-1]]
        most = np.full(len(values), np.iinfo(np.int64).min)
        found = []
        for ph, pdoc, pown, pplace in _unpacked(table, "<u4"):
            if not len(values):
                break
            at = np.minimum(np.searchsorted(values, ph), len(values) - 1)
            hit = (values[at] == ph) & (least[at] < pdoc)
            if hit.any():
                found.append((pdoc[hit], pown[hit], pplace[hit]))
                np.maximum.at(most, at[hit], pdoc[hit])
        met = doc < np.repeat(most, np.diff(edge))
        if met.any():
            found.append((doc[met], own[met], place[met]))
        return _places(found, keys)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", part_bytes):
            words = Words(texts)
            places = part.column(3)
            n = np.diff(places.offsets.to_numpy())
            at = places.flatten().to_numpy() + np.repeat(words.first[:-1], n)
            low = np.maximum(at - (span - block), np.repeat(words.first[:-1], n))
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, low, 1)
            np.add.at(near, at + 1, -1)
            starts = _runs_in_documents(words, span)
            starts = starts[np.cumsum(near)[starts] > 0]
            h = words.hashes()
            doc = words.doc[starts]
            other = windows(h, span, salt=0x5851F42D4C957F2D)[starts]
            run = np.empty(len(starts), _RUN)
            run["a"], run["b"] = windows(h, span)[starts], other.astype("<u4")
            rows = _packed_rows(keys[((other >> U(32)) % U(buckets)).astype(np.int64)], run, doc, starts - words.first[doc], part.column(0).to_numpy(), part.column(1).to_numpy())
            if rows:
                yield rows

    def confirmed(key: tuple, table: pa.Table) -> pa.Table:
        h, doc, own, place = (np.concatenate(x) for x in zip(*_unpacked(table, _RUN), strict=True))
        order = np.lexsort((h["b"], h["a"]))
        edge = runs(h[order])
        doc = doc[order]
        later = doc > np.repeat(np.minimum.reduceat(doc, edge[:-1]), np.diff(edge))
        return _places([(doc[later], own[order][later], place[order][later])], keys)

    known = plain.where("doc_id is not null")
    hit = _by_document(known.mapInArrow(probes, _PACKED_TYPE).groupBy("bucket").applyInArrow(hits, _PACKED_TYPE))
    # Both joins read the texts from one exchange, as its plan is the same.
    dealt = known.repartition("doc_id", "key")
    near = dealt.join(hit, ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    found = _by_document(near.mapInArrow(spans, _PACKED_TYPE).groupBy("bucket").applyInArrow(confirmed, _PACKED_TYPE))
    none = plain.where("doc_id is null").withColumn("places", F.lit(None).cast("array<int>"))
    return dealt.join(found, ["doc_id", "key"], "left").select("doc_id", "key", "text", "places").union(none)


def without_repeats(docs: DataFrame, span: int = 50, keep_text: bool = False, bucket_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text: the words that stay, joined by a space)."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    kinds = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            rows = []
            for doc, text, places in zip(part.column(0).to_pylist(), texts, part.column(3), strict=True):
                words = text.split()
                n = len(words)
                if places.is_valid and len(places.values):
                    cover = np.zeros(n + span + 1, np.int64)
                    at = places.values.to_numpy()
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + span, -1)
                    stay = np.cumsum(cover)[:n] == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                joined = b" ".join(words)
                rows.append((doc, n, n - len(words), hashlib.sha256(joined).hexdigest(), *([joined.decode()] if keep_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return repeats(docs, span, bucket_bytes=bucket_bytes).mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
