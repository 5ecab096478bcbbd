"""Sensitive spans in free text: recognisers, a choice without overlaps, and their summary as evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import checks
from tabveil.functions import values as V

#: The inline patterns.
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
URL = r"\b(?:https?://|www\.)[^\s<>'\"]+"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b"
SECRET = r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|secret|password|passwd|pwd|private[_-]?key)\b\s*[:=]\s*[\"']?([A-Za-z0-9][A-Za-z0-9_\-./+=]{7,})"
BEARER = r"(?i)\bbearer\s+([A-Za-z0-9._~+/\-]{12,}=*)"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
CARD = r"\b\d(?:[ -]?\d){12,18}\b"
IBAN = r"(?i)\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){11,30}\b"
VAT = r"(?i)\b[A-Z]{2,3}[\s./-]?[A-Z0-9](?:[\s./-]?[A-Z0-9]){6,14}\b"

_digits = lambda s: re.sub(r"\D", "", s)
_formatted = lambda s: len(_digits(s)) >= 7 and bool(re.search(r"[+() .\-/]", s))
_inside = lambda body: rf"\b{body}\b".replace(r"\p{Nd}", r"\d")

#: (field, kind, type, confidence, score, detector, priority, pattern, group, test)
RECOGNISERS = [
    ("secret", "credentialOrSecret", "string", "high", 98, "pattern:secret-assignment", 0, SECRET, 1, None),
    ("secret", "credentialOrSecret", "string", "high", 96, "pattern:bearer-token", 1, BEARER, 1, None),
    ("secret", "credentialOrSecret", "string", "high", 99, "pattern:private-key", 2, PRIVATE_KEY, 0, None),
    ("accountNumber", "accountOrFinancialId", "numericId", "high", 94, "validator:card", 10, CARD, 0, checks.card),
    ("accountNumber", "accountOrFinancialId", "string", "high", 92, "validator:iban", 11, IBAN, 0, checks.iban),
    ("taxId", "governmentId", "taxId", "high", 92, "validator:vat", 12, VAT, 0, checks.vat),
    ("email", "contact", "email", "high", 96, "validator:email", 20, EMAIL, 0, checks.email),
    ("url", "url", "url", "medium", 78, "validator:url", 30, URL, 0, checks.url),
    ("uuid", "recordIdentifier", "uuid", "medium", 76, "pattern:uuid", 40, _inside(V.UUID), 0, None),
    ("date", "privateDate", "timestamp", "low", 54, "pattern:date", 50, _inside(V.TIMESTAMP), 0, None),
    ("ipAddress", "networkOrDeviceId", "ipAddress", "medium", 78, "pattern:ip", 60, _inside(V.IPV4), 0, None),
    ("macAddress", "networkOrDeviceId", "macAddress", "medium", 76, "pattern:mac", 70, _inside(V.MAC), 0, None),
    ("taxId", "governmentId", "taxId", "high", 94, "validator:tax-id:us", 80, _inside(V.US_TAX_ID), 0, lambda s: checks.us_ssn(s) or checks.us_ein(s)),
    ("phone", "contact", "phone", "high", 90, "pattern:phone", 90, PHONE, 0, _formatted),
    ("phone", "contact", "phone", "low", 55, "pattern:phone-digits", 95, PHONE, 0, None),
]
#: What a text must have for any recogniser to find something.
WORTH = r"[0-9@]|://|www\.|(?i:secret|passw|pwd|key|token|bearer)|-----BEGIN"
SPAN = "start int, end int, priority int, kind string, type string, confidence string, score int, detector string, value string"


def find(text: str) -> list[tuple]:
    """Spans without overlaps: by start, priority, length; each that begins after the last one's end. Offsets in code points."""
    found = []
    for _, kind, type_, level, score, detector, priority, pattern, group, test in RECOGNISERS:
        for m in re.finditer(pattern, text):
            if test is None or test(m[group]):
                found.append((m.start(group), m.end(group), priority, kind, type_, level, score, detector, m[group]))
    found.sort(key=lambda s: (s[0], s[2], s[0] - s[1]))
    out, end = [], 0
    for s in found:
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def utf16(text: str, at: int) -> int:
    """Offset in UTF-16 units of an offset in code points."""
    return at + sum(ord(c) > 0xFFFF for c in text[:at])


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, ...): a row for each span. Texts that can have none never reach Python."""
    names = [key, *(f.split(" ")[0] for f in SPAN.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(k, *s) for k, t in zip(p[key], p[text], strict=True) for s in find(t)], columns=names)

    kind = dict(df.dtypes)[key]
    return df.select(key, text).where(F.col(text).rlike(WORTH)).mapInPandas(run, f"{key} {kind}, {SPAN}")


def selected(candidates: Column) -> Column:
    """The choice without overlaps over an array of (start, end, priority), as a Column: sorted, then folded."""
    order = F.array_sort(F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), s["priority"].alias("priority"), (s["start"] - s["end"]).alias("short"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,priority:int,short:int,end:int>>")
    fold = F.aggregate(order, none, lambda a, s: F.when((F.size(a) == 0) | (s["start"] >= F.element_at(a, -1)["end"]), F.concat(a, F.array(s))).otherwise(a))
    return F.transform(fold, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["priority"].alias("priority")))


#: Order of kinds where all else ties, and the risk of each.
KINDS = "person contact privateAddress addressRegion privateDate recordIdentifier networkOrDeviceId accountOrFinancialId governmentId credentialOrSecret url mixedSensitiveText".split()
MEDIUM = {"privateDate", "addressRegion", "recordIdentifier", "networkOrDeviceId", "url"}
KIND_PRIORITY = {"credentialOrSecret": 100, "governmentId": 95, "contact": 90, "person": 85, "privateAddress": 80, "addressRegion": 78, "accountOrFinancialId": 75, "privateDate": 70, "networkOrDeviceId": 65, "url": 60, "recordIdentifier": 55, "mixedSensitiveText": 10}


def evidence(found: DataFrame, row: str) -> DataFrame:
    """kind, type -> match_count (rows), score and detector of the best, confidence, detectors, risk, actionable."""
    level = F.create_map(F.lit("high"), F.lit(2), F.lit("medium"), F.lit(1), F.lit("low"), F.lit(0))
    out = found.groupBy("kind", "type").agg(
        F.count_distinct(row).alias("match_count"), F.max("score").alias("score"), F.max_by("detector", F.struct(F.col("score"), (-F.col("priority")).alias("p"))).alias("detector"),
        F.max(level[F.col("confidence")]).alias("_level"), F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"),
    )
    name = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("_level") + 1)
    return out.select("kind", "type", "match_count", "score", "detector", name.alias("confidence"), "detectors", F.when(F.col("kind").isin(*MEDIUM), "medium").otherwise("high").alias("risk"), (F.col("_level") > 0).alias("actionable"))


def spliced(text: Column, pattern: str, replacement: str) -> Column:
    """A text with every match of one pattern replaced."""
    return F.regexp_replace(text, pattern, replacement)


def promoted(found: DataFrame, kind: str, confidence: str, score: int, detector: str | None = None, rows: Column | None = None) -> DataFrame:
    """Spans in which those of a kind (and of `rows`, a condition) have at least this confidence and score; where the score rises, `detector` is its reason."""
    rank = F.create_map(*[F.lit(x) for k, n in (("low", 0), ("medium", 1), ("high", 2)) for x in (k, n)])
    hit = (F.col("kind") == kind) & (F.lit(True) if rows is None else rows)
    better, higher = hit & (rank[F.col("confidence")] < rank[F.lit(confidence)]), hit & (F.col("score") < score)
    changes = {"confidence": F.when(better, confidence).otherwise(F.col("confidence")), "score": F.when(higher, score).otherwise(F.col("score"))}
    if detector:
        changes["detector"] = F.when(higher, detector).otherwise(F.col("detector"))
    return found.withColumns(changes)
