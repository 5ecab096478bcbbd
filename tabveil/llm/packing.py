"""Packing of documents into training sequences as a cutting-stock problem.

A document's ids (with a closing id 0) are cut every `size` ids. The lengths of the pieces, 1 to `size`, give a
histogram of at most `size` rows; on the driver, column generation solves a linear program over it: which
patterns of whole pieces, and how often, leave least room and least ids outside. A knapsack by dynamic
programming over the prices of the lengths finds the pattern that gains most, until none gains over `gap`.
Patterns are rounded down, the few pieces that remain are packed first-fit decreasing, and the patterns with
most room are dissolved until the pieces outside fill the room of the others: those pieces alone are cut, one
behind the other, into the room that is left, then into sequences of their own, the last by powers of two. So
nothing is padded, and all but a few hundredths of the documents are cut only where they exceed a sequence.

Each piece takes, by its rank among the pieces of its length, its place in the patterns. Ranks are counted
within a task as the pieces are made and shifted by the tasks' counts, so that a length which a third of all
pieces share is no single task's work.

Cases: null and empty texts are one id (the closing 0); repeated rows and null doc_ids keep their pieces; an
empty table gives an empty result; texts of any length are tokenised whole.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import only, written
from tabveil.llm.words import pieces as text_slices

SPECIAL = "<|endoftext|>"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def encoder(path: str):
    """text -> ids, as tokenizers gives them for the file at path.

    Where the same vocabulary lies beside it as byte-pair ranks, those serve for texts without the special
    token: the ids are the same and come several times faster.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda text: plain.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda text: plain.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


def tokenized(docs: DataFrame, size: int = 1024, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, part (the task), own (rank in it by length), ids.

    ids: little-endian, 2 bytes each (4, if an id needs it); kept for pieces shorter than `size`, as only these may be cut.
    """
    path = path or tokenizer_file()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "own", "ids"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for part, texts in text_slices(batches, "text", 1_000_000):
            rows: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = np.array([*encode(text.decode()), 0], "<u4")
                kept = ids.astype("<u2") if ids.max() < 65536 else ids
                for at in range(0, len(ids), size):
                    own = ids[at : at + size]
                    n = len(own)
                    rows.append((doc, at, n, zlib.crc32(own.tobytes()), len(ids), task, int(seen[n]), kept[at : at + size].tobytes() if keep_ids or n < size else None))
                    seen[n] += 1
                if len(rows) >= 2000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    docs = only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, own long, ids binary")


def _knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern (count of each length) with the highest price that fits; lengths ascending."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for w in range(int(lengths[0]), size + 1):
        value = best[w - lengths[: fits[w]]] + prices[: fits[w]]
        top = int(value.argmax())
        best[w], choice[w] = value[top], top
        if best[w - 1] > best[w]:
            best[w], choice[w] = best[w - 1], -1
    pattern, w = np.zeros(len(lengths), np.int64), size
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= int(lengths[choice[w]])
    return float(best[size]), pattern


def generated_columns(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 0.002, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation by the revised simplex method: (patterns as columns, how often each is used, fractional).

    A pattern costs the ids of room it leaves; a piece outside all patterns costs its ids. Left over: demand - patterns @ times.
    """
    m = len(lengths)
    columns, cost = np.eye(m), lengths.astype(float)
    outside, inverse, x = np.ones(m, bool), np.eye(m), demand.astype(float)
    for k in range(most):
        prices = cost @ inverse
        value, pattern = _knapsack(lengths, lengths + prices, size)
        if value <= size * (1 + gap):
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out], cost[out], outside[out] = pattern, size - lengths @ pattern, False
        row = inverse[out] / d[out]
        d[out] = 0
        touched = np.flatnonzero(d)
        inverse[touched] -= d[touched, None] * row
        inverse[out] = row
        x[touched] -= d[touched] * ratio[out]
        x[out] = ratio[out]
        if k % 400 == 399:
            inverse = np.linalg.inv(columns)
            x = inverse @ demand
        x = np.maximum(x, 0)
    return columns[:, ~outside].astype(np.int64), x[~outside]


Pattern = tuple[dict[int, int], int]


def plan(histogram: dict[int, int], size: int = 1024) -> list[Pattern]:
    """(pattern as length -> count, number of sequences); what they leave of the histogram is to be cut, and fills their room at least."""
    out: list[Pattern] = []
    if full := histogram.get(size, 0):
        out.append(({size: 1}, full))
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < size), np.int64)
    if not len(lengths):
        return out
    left = np.array([histogram[k] for k in lengths], np.int64)
    columns, x = generated_columns(lengths, left, size)
    for j in np.argsort(-x, kind="stable"):
        used = columns[:, j] > 0
        times = min(int(np.floor(x[j] + 1e-6)), int((left[used] // columns[used, j]).min()))
        if times > 0:
            left -= columns[:, j] * times
            out.append(({int(lengths[i]): int(columns[i, j]) for i in np.flatnonzero(used)}, times))
    while left.any():  # first-fit decreasing; equal bins are made at once
        room, pattern = size, {}
        for i in range(len(lengths) - 1, -1, -1):
            if n := min(int(left[i]), room // int(lengths[i])):
                pattern[int(lengths[i])] = n
                room -= n * int(lengths[i])
        times = min(int(left[np.searchsorted(lengths, k)]) // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[np.searchsorted(lengths, k)] -= n * times
        out.append((pattern, times))
    room = lambda p: size - sum(k * n for k, n in p.items())
    out.sort(key=lambda p: room(p[0]))
    need = sum(room(p) * n for p, n in out)
    while need > 0:  # what is dissolved goes into the room of the others
        pattern, n = out[-1]
        gain = size  # its room goes, and its ids fill as much of the others'
        times = min(n, -(-need // gain))
        need -= times * gain
        out[-1] = (pattern, n - times)
        if times == n:
            out.pop()
    return out


class Places:
    """For each length, which ranks go to which pattern, and where the ids of the others go; bounded by the plan."""

    def __init__(self, patterns: list[Pattern], histogram: dict[int, int], size: int):
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k, n in histogram.items() if n}
        rooms: list[tuple[int, int, int, int]] = []  # ids of room, times, first sequence, offset
        base = 0
        for pattern, times in patterns:
            at = 0
            for length, n in sorted(pattern.items(), reverse=True):
                rows[length].append((n * times, n, base, at))
                at += n * length
            if at < size:
                rooms.append((size - at, times, base, at))
            base += times
        loose, self.loose_from = 0, {}
        for length, own in sorted(rows.items()):
            a = np.array(own, np.int64).reshape(-1, 4)
            ends = np.concatenate([[0], np.cumsum(a[:, 0])])
            self.by_length[length] = (ends, a[:, 1], a[:, 2], a[:, 3])
            self.loose_from[length] = (int(ends[-1]), loose)
            loose += (histogram[length] - int(ends[-1])) * length
        left = loose - sum(r * t for r, t, _, _ in rooms)
        if left // size:
            rooms.append((size, left // size, base, 0))
            base += left // size
        for k in range(size.bit_length() - 1, -1, -1):
            if left % size >> k & 1:
                rooms.append((1 << k, 1, base, 0))
                base += 1
        self.rooms = np.array(rooms, np.int64).reshape(-1, 4)
        self.room_ends = np.concatenate([[0], np.cumsum(self.rooms[:, 0] * self.rooms[:, 1])])

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, -1) of a piece in a pattern; (-1, -1, its first id's place among loose ids) of one to be cut."""
        sequence, offset, loose = np.full(len(rank), -1), np.full(len(rank), -1), np.full(len(rank), -1)
        order = np.argsort(length, kind="stable")
        values, first = np.unique(length[order], return_index=True)
        for k, a, b in zip(values, first, [*first[1:], len(order)], strict=True):
            own = order[a:b]
            ends, n, base, at = self.by_length[int(k)]
            packed_n, start = self.loose_from[int(k)]
            out = own[rank[own] >= packed_n]
            loose[out] = start + (rank[out] - packed_n) * int(k)
            own = own[rank[own] < packed_n]
            p = np.searchsorted(ends, rank[own], "right") - 1
            within = rank[own] - ends[p]
            sequence[own] = base[p] + within // n[p]
            offset[own] = at[p] + within % n[p] * int(k)
        return sequence, offset, loose

    def cuts(self, loose: int, length: int) -> list[tuple[int, int, int, int]]:
        """(ids before, ids, sequence, offset) of the parts of a loose piece."""
        out, done = [], 0
        while done < length:
            at = loose + done
            p = int(np.searchsorted(self.room_ends, at, "right")) - 1
            room, _, base, offset = self.rooms[p].tolist()
            k, inside = divmod(at - int(self.room_ends[p]), room)
            n = min(room - inside, length - done)
            out.append((done, n, base + k, offset + inside))
            done += n
        return out


def packed(docs: DataFrame, size: int = 1024, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): a row for each piece."""
    cut = written(tokenized(docs, size, path, keep_ids), "packing-pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, size), histogram, size)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("own"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    types = [pa.int64()] * 7 + [pa.list_(pa.int64())] * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, length, crc, tokens, rank, raw = b.columns
            sequence, offset, loose = places.of(length.to_numpy(), rank.to_numpy())
            whole = np.flatnonzero(loose < 0)
            columns = [x.take(pa.array(whole)) for x in (doc, start, length, crc, tokens)] + [pa.array(sequence[whole]), pa.array(offset[whole])]
            unpack = lambda x, n: np.frombuffer(x, f"<u{len(x) // n}")
            if keep_ids:
                columns.append(pa.array([unpack(raw[i].as_py(), length[i].as_py()).tolist() for i in whole], types[7]))
            yield pa.RecordBatch.from_arrays(columns, names)
            rows = []
            for i in np.flatnonzero(loose >= 0).tolist():
                n = length[i].as_py()
                ids = unpack(raw[i].as_py(), n).astype("<u4")
                for done, k, seq, at in places.cuts(int(loose[i]), n):
                    own = ids[done : done + k]
                    rows.append((doc[i].as_py(), start[i].as_py() + done, k, zlib.crc32(own.tobytes()), tokens[i].as_py(), seq, at, *([own.tolist()] if keep_ids else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * keep_ids
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids").mapInArrow(place, kinds)
