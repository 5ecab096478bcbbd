"""Replacements and span candidates from plug-ins: what is asked, what of the answers is accepted, and why not the rest."""

from __future__ import annotations

import re
from collections import Counter
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.functions import values as V

#: Limits of requests.
BATCH, VALUES_PER_COLUMN, CELLS, CELLS_PER_REQUEST, BYTES_PER_REQUEST, REQUESTS = 20, 200, 320, 32, 12 * 1024, 10
LEAST_SCORE, MOST_CANDIDATES = 8000, 10_000
#: Reasons of rejection, in the order in which they are reported.
REASONS = ("unexpectedOriginal", "duplicateOriginal", "emptyOutput", "sameAsOriginal", "controlCharacter", "containsOriginal", "matchesOtherOriginal", "duplicateOutput", "missingOutput")


class ReplacementProvider(Protocol):
    def replacements(self, column: str, values: list[str]) -> list[tuple[str, str]]: ...


class CandidateDetector(Protocol):
    detector_id: str

    def detect(self, cells: list[tuple[str, int, str]]) -> list[tuple[str, int, int, int, str, int]]:
        """(column, row, start, end, kind, score in 1/10000) for cells (column, row, text)."""
        ...


def key(value: str) -> str:
    return " ".join(value.split()).lower()


def carries(text: str, source: str) -> bool:
    """Whether a replacement's key holds a source's: equal, or of 3 characters or more and between borders of words."""
    if text == source:
        return True
    return len(source) >= 3 and re.search(rf"(?<![^\W_]){re.escape(source)}(?![^\W_])", text) is not None


def accepted(expected: list[str], sources: set[str], answers: list[tuple[str, str]], used: set[str]) -> tuple[dict[str, str], Counter]:
    """(original -> replacement, reasons of the rest). sources: keys of the whole column; used: keys of outputs, which grows."""
    known = {key(v): v for v in expected}
    out: dict[str, str] = {}
    seen, why = set(), Counter()
    for original, text in answers:
        k, t = key(original), text.strip()
        if k not in known:
            why["unexpectedOriginal"] += 1
            continue
        seen.add(k)
        n = key(t)
        reason = (
            "duplicateOriginal" if known[k] in out
            else "emptyOutput" if not t
            else "sameAsOriginal" if n == k
            else "controlCharacter" if any(ord(c) < 32 and c != "\t" or 127 <= ord(c) < 160 for c in t)
            else "containsOriginal" if carries(n, k)
            else "matchesOtherOriginal" if any(carries(n, s) for s in sources if s != k)
            else "duplicateOutput" if n in used
            else None
        )
        if reason:
            why[reason] += 1
        else:
            used.add(n)
            out[known[k]] = t
    why["missingOutput"] += sum(k not in seen for k in known)
    return out, +why


def wanted(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(col, value): distinct values that no known map (col, key) has, up to 200 of each column, in order."""
    rows = cells.where(~V.is_empty(V.trimmed(F.col("value")))).select("col", V.trimmed(F.col("value")).alias("value")).withColumn("key", V.identity_key(F.col("value"))).groupBy("col", "key").agg(F.min("value").alias("value"))
    if known is not None:
        rows = rows.join(known.select("col", "key"), ["col", "key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("col").orderBy("value"))
    return rows.withColumn("n", place).where(F.col("n") <= VALUES_PER_COLUMN).select("col", "value")


def generated(values: DataFrame, provider: ReplacementProvider) -> DataFrame:
    """(col, value, output, reason): the provider's answers for wanted values, batch by batch; reason is null where accepted.

    A column has 200 values at most, so that one task holds a column's.
    """

    def run(_: tuple, p: pd.DataFrame) -> pd.DataFrame:
        column, own, used, rows = p["col"].iloc[0], sorted(p["value"]), set(), []
        sources = {key(v) for v in own}
        for low in range(0, len(own), BATCH):
            batch = own[low : low + BATCH]
            try:
                answers = provider.replacements(column, batch)
            except Exception:  # noqa: BLE001  a provider's failure leaves the fallback
                answers = []
            out, why = accepted(batch, sources, answers, used)
            rows += [(column, v, t, None) for v, t in out.items()] + [(column, None, None, r) for r in REASONS for _ in range(why[r])]
        return pd.DataFrame(rows, columns=["col", "value", "output", "reason"])

    return values.groupBy("col").applyInPandas(run, "col string, value string, output string, reason string")


def balanced(cells: DataFrame, most: int = CELLS) -> DataFrame:
    """Cells (col, row, value) taken in turn from the columns, each column's by a hash, `most` in all."""
    h = lambda *c: F.sha2(F.concat_ws("|", *c).cast("binary"), 256)
    turn = F.row_number().over(Window.partitionBy("col").orderBy(h(F.col("col"), F.col("row").cast("string"))))
    return cells.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", h(F.col("col"))).limit(most)


def requests(cells: list[tuple[str, int, str]]) -> list[list[tuple[str, int, str]]]:
    """Greedy packs of 32 cells and 12 KiB at most; ten packs."""
    out: list[list[tuple[str, int, str]]] = []
    size = 0
    for c in cells:
        n = len(c[2].encode())
        if not out or len(out[-1]) >= CELLS_PER_REQUEST or size + n > BYTES_PER_REQUEST:
            if len(out) == REQUESTS:
                break
            out.append([])
            size = 0
        out[-1].append(c)
        size += n
    return out


def valid_candidates(candidates: DataFrame, cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates (col, row, start, end, kind, score) with a score, inside a known cell, that no span overlaps; the best 10,000."""
    from tabveil.operators.audit import without_overlap

    known = cells.select("col", "row", F.length("value").alias("_n"))
    inside = candidates.where(F.col("score").between(LEAST_SCORE, 10_000)).join(known, ["col", "row"]).where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_n"))).drop("_n")
    free = without_overlap(inside, spans).dropDuplicates(["col", "row", "start", "end", "kind"])
    return free.orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "col", "row", "start", "end", "kind").limit(MOST_CANDIDATES)


class EchoFree:
    """A provider for tests: numbered stand-ins."""

    def replacements(self, column: str, values: list[str]) -> list[tuple[str, str]]:
        import hashlib

        return [(v, "stand-in " + hashlib.sha256(f"{column}\x00{v}".encode()).hexdigest()[:12]) for v in values]


def applied(df: DataFrame, column: str, known: DataFrame, fallback: str) -> DataFrame:
    """df with `column` replaced by known (key, output), or by the column `fallback` where there is none."""
    k = V.identity_key(F.col(f"`{column}`"))
    rows = df.withColumn("_k", k).join(known.select(F.col("key").alias("_k"), F.col("output").alias("_o")), "_k", "left")
    return rows.withColumn(column, F.coalesce("_o", fallback)).drop("_k", "_o")

