"""Quality as an ordinal grade: cumulative-link (proportional odds) regression on hashed text.

Features are counts of byte triples, hashed to `size` places, as log(1 + n) and of unit length, and the text's form
(its length, how often a word repeats the one before, how few words are distinct); one weight for each
place is shared by all grades, and ordered thresholds part them: P(grade <= k) = logistic(threshold k - weight x).
The thresholds stay ordered as each is the one before plus an exponential. The fit is Adam on the full sample:
`per_grade` labelled rows of each grade at most, those with the smallest hash of doc_id, weighted back
to the grades' shares among all labelled rows.

Cases: null and empty texts have no features and get the grades' shares at weight 0; null doc_ids are scored and
teach nothing; with one grade, or without labels, every row has expected grade and tail of that grade (0 without);
repeated rows and ties of doc_id get a row each; an empty table gives an empty result; texts of any length are read whole;
extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import only, whole_number
from tabveil.llm.toxicity import train_rows
from tabveil.llm.words import pieces


#: Places at the end of the weights for the form of a text: its length, by powers of two, and how its words repeat.
FORM = 32


def features(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the hashed byte triples and of the text's form."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    n = np.bincount(((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(size - FORM), minlength=size)
    at = np.flatnonzero(n)
    value = np.log1p(n[at]).astype(np.float32)
    words = text.split()
    again = sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(len(words), 1)
    form = [size - FORM + min(len(b).bit_length(), FORM - 3), size - 2, size - 1]
    return np.concatenate([at, form]), np.concatenate([value / np.linalg.norm(value), np.array([0.5, again, 1 - len(set(words)) / max(len(words), 1)], np.float32)])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Grades:
    """grades ascending; thresholds between them; weights by place."""

    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, as columns."""
        return 1 - _logistic(self.thresholds[None, :] - latent[:, None])


def ordinal(indptr: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, share: np.ndarray, k: int, size: int, rounds: int = 300, rate: float = 0.3, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for grades 0 .. k - 1. share: weight of each row, 1 in sum."""
    row = np.repeat(np.arange(len(y)), np.diff(indptr))
    p = np.concatenate([np.zeros(size), [-(k - 2) / 2], np.zeros(k - 2)])  # the weights, the first threshold, log steps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        steps = np.exp(p[size + 1 :])
        theta = np.concatenate([[-np.inf], p[size] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        latent = np.bincount(row, value * p[at], minlength=len(y))
        up, low = _logistic(theta[y + 1] - latent), _logistic(theta[y] - latent)
        mass = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / mass * share, low * (1 - low) / mass * share  # of the log likelihood by the upper and the lower threshold
        g_theta = np.bincount(y, du, minlength=k)[: k - 1] - np.bincount(y, dl, minlength=k)[1:]
        g = np.concatenate([-np.bincount(at, value * (du - dl)[row], minlength=size) - ridge * p[:size], [g_theta.sum()], [g_theta[j + 1 :].sum() * steps[j] for j in range(k - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return p[:size].astype(np.float32), p[size] + np.concatenate([[0], np.cumsum(np.exp(p[size + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", per_grade: int = 3000, size: int = 1 << 15) -> Grades:
    """per_grade bounds the sample of labelled rows of each grade; size bounds the weights. A grade is one of a scale: its distinct values are few."""
    spark = docs.sparkSession
    known = only(labels, id="doc_id", y=grade).where(train_rows(F.col("id")) & F.col("y").isNotNull()).select("id", F.col("y").cast("double").alias("y")).distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    grades = sorted(counts)
    if len(grades) < 2:
        return Grades(grades or [0.0], np.zeros(0), np.zeros(size, np.float32))
    ids = [(r["id"], j) for j, g in enumerate(grades) for r in known.where(F.col("y") == g).orderBy(F.xxhash64("id"), "id").limit(per_grade).collect()]
    texts = only(docs, id="doc_id", text="text").where("text is not null").join(F.broadcast(spark.createDataFrame(ids, "id long, y int")), "id").select("y", "text").distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in pieces(batches, "text"):
            f = [features(t, size) for t in own]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a.astype("<u4").tobytes() for a, _ in f], pa.binary()), pa.array([v.tobytes() for _, v in f], pa.binary())], ["y", "at", "value"])

    rows = texts.mapInArrow(hashed, "y int, at binary, value binary").toArrow().sort_by([("y", "ascending"), ("at", "ascending")])
    y = rows.column("y").to_numpy().astype(np.int64)
    at = [np.frombuffer(x, "<u4") for x in rows.column("at").to_pylist()]
    value = np.concatenate([np.frombuffer(x, np.float32) for x in rows.column("value").to_pylist()])
    n = np.bincount(y, minlength=len(grades))
    share = (np.array([counts[g] for g in grades]) / np.maximum(n, 1))[y]
    share = share / share.sum()
    weights, thresholds = ordinal(np.concatenate([[0], np.cumsum([len(a) for a in at])]), np.concatenate(at).astype(np.int64), value, y, share, len(grades), size)
    return Grades(grades, thresholds, weights)


def score(docs: DataFrame, model: Grades, tail: int = -1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (P of the grades over threshold number `tail`), kept (tail >= threshold)."""
    size, grades = len(model.weights), np.array(model.grades)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            f = [features(t, size) for t in texts]
            tails = model.tails(np.array([float(v @ model.weights[a]) for a, v in f]))
            expected = grades[0] + tails @ np.diff(grades)
            top = tails[:, tail] if tails.shape[1] else np.ones(len(texts)) * (grades[0] > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(top, pa.float64())], ["doc_id", "expected_grade", "tail"])

    rows = whole_number(only(docs, doc_id="doc_id", text="text"), "doc_id").mapInArrow(scored, "doc_id long, expected_grade double, tail double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "expected_grade", "tail", (F.col("tail") >= threshold).alias("kept"))
