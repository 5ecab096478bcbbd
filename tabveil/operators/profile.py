"""Column profiles: one wide aggregate of votes over the sample, then rules over the counts on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import headers, phones
from tabveil.functions import values as V
from tabveil.functions.checks import checked
from tabveil.operators.distribution import long_form

#: Personal-data risk of each type; types not here are low.
RISK = {**dict.fromkeys(("email", "phone", "firstName", "lastName", "fullName", "address", "taxId"), "high"), **dict.fromkeys(("uuid", "numericId", "postalCode", "ipAddress", "macAddress", "url"), "medium")}
KIND_OF = {"email": "contact", "phone": "contact", "firstName": "person", "lastName": "person", "fullName": "person", "address": "privateAddress", "taxId": "governmentId", "uuid": "recordIdentifier", "numericId": "recordIdentifier", "postalCode": "addressRegion", "ipAddress": "networkOrDeviceId", "macAddress": "networkOrDeviceId", "url": "url"}
RANK = {"low": 0, "medium": 1, "high": 2}
ENUM_MOST, ENUM_OVER = 20, 10
#: Kinds of header signals that a value must bear out.
HEADER_FITS = ("credentialOrSecret", "accountOrFinancialId", "privateDate")
#: Values of a column that a plan shows.
SAMPLE = 5


def votes(cells: DataFrame) -> DataFrame:
    """cells (col, value) -> a row for each column: non_empty, distinct, a count for each predicate."""
    v = F.col("value")
    full = ~V.is_empty(v)
    t = V.trimmed(v)
    count = lambda c: F.count_if(full & F.coalesce(c, F.lit(False)))
    extra: dict[str, Column] = {
        "numericValue": V.is_numeric_value(t), "unsigned": V.whole(t, "[0-9]+"), "iban": V.is_iban(t), "card": V.is_card(t), "address": V.is_address(t), "street": V.is_address(t) & V.has_street_word(t),
        "namePart2": V.is_name_part(t, 2), "namePart4": V.is_name_part(t, 4), "fullName": V.is_full_name(t), "keyToken": V.is_key_token(t), "isoCountry": V.is_country(t),
        "phonePlan": phones.shaped(t, 7, slash=True) | phones.is_valid(t), "ssn9": V.is_bare_us_tax_id(t, "ssn"), "ein9": V.is_bare_us_tax_id(t, "ein"), "tax9": V.is_bare_us_tax_id(t), "btw": V.is_dutch_btw(t),
        **{f"fits_{k}": V.fits_header_signal(v, k) for k in HEADER_FITS},
    }
    return cells.groupBy("col").agg(
        count(F.lit(True)).alias("non_empty"), F.count_distinct(F.when(full, v)).alias("distinct"), F.bool_or(v == "").alias("has_empty"), F.bool_or(F.lower(v) == "null").alias("has_null"),
        *[count(p(t)).alias(f"is_{k}") for k, (p, _, _) in V.PRIORITY.items()], *[count(p).alias(f"is_{k}") for k, p in extra.items()],
    )


def checksum_votes(cells: DataFrame) -> DataFrame:
    """(col, counts of values that pass, country): the checks see each distinct value once. country: the commonest one of the national numbers, the first by name in a tie."""
    values = checked(cells)
    counts = cells.join(values, "value").groupBy("col", "country").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"ok_{c}") for c in ("vat", "iban", "nationalId")])
    first = F.min(F.when(F.col("country").isNotNull(), F.struct((-F.col("n")).alias("n"), "country")))["country"]
    return counts.groupBy("col").agg(*[F.sum(f"ok_{c}").alias(f"ok_{c}") for c in ("vat", "iban", "nationalId")], first.alias("country"))


def first_values(df: DataFrame, order: str, columns: list[str], n: int = SAMPLE) -> DataFrame:
    """(col, value, place): the first n values of each column that are not empty, in `order`; ties by value.

    Ranks up to n are cut before the exchange too, so that no column's cells meet in one task.
    """
    from pyspark.sql import Window

    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    cells = df.select(F.col(order).alias("_at"), F.explode(pairs).alias("p")).select("_at", "p.*").where(~V.is_empty(F.col("value")))
    place = F.row_number().over(Window.partitionBy("col").orderBy("_at", "value"))
    return cells.withColumn("place", place).where(F.col("place") <= n).select("col", "value", "place")


def postal_votes(cells: DataFrame, context: list[str] | None = None) -> DataFrame:
    """(col, country, n) of values in a postal format."""
    return cells.where(~V.is_empty(F.col("value"))).withColumn("country", V.postal_country(F.col("value"), context)).where("country is not null").groupBy("col", "country").agg(F.count("*").alias("n"))


def locale(cells: DataFrame) -> DataFrame:
    """(code, n): country codes of the columns of which 8 of 10 values are such codes, most first."""
    v = F.col("value")
    columns = cells.where(~V.is_empty(v)).groupBy("col").agg(F.count("*").alias("n"), F.count_if(V.is_country(v)).alias("iso")).where("10 * iso >= 8 * n").select("col")
    return cells.where(V.is_country(v)).join(columns, "col").groupBy(v.alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def key_likeness(cells: DataFrame) -> DataFrame:
    """(col, n, key_like): 8 keys or more, three quarters of one length and use of separators, three quarters distinct."""
    t = V.trimmed(F.col("value"))
    keys = cells.where(V.is_key_token(F.col("value"))).select("col", F.struct(F.length(t).alias("n"), t.rlike("[-_/]").alias("s")).alias("shape"), F.lower(t).alias("key"))
    shapes = keys.groupBy("col", "shape").agg(F.count("*").alias("n")).groupBy("col").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    distinct = keys.groupBy("col").agg(F.count_distinct("key").alias("distinct"))
    return shapes.join(distinct, "col").select("col", "n", ((F.col("n") >= 8) & (4 * F.col("top") >= 3 * F.col("n")) & (4 * F.col("distinct") >= 3 * F.col("n"))).alias("key_like"))


def empty_format(has_empty: bool, has_null: bool) -> str:
    return "mixed" if has_empty and has_null else "null" if has_null else "emptyString"


@dataclass
class Profile:
    header: str
    index: int
    kind: str = "unknown"
    confidence: str = "low"
    risk: str = "high"
    detector: str = ""
    non_empty: int = 0
    evidence: list[tuple[str, str, int]] = field(default_factory=list)  # kind, detector, matches
    empty_format: str = "emptyString"
    sample: list[str] = field(default_factory=list)

    @property
    def selected(self) -> bool:
        return self.non_empty > 0 and RANK[self.risk] > 0

    @property
    def strategy(self) -> str:
        return "redact" if RANK[self.risk] > 0 else "auto"


def _share(n: int, total: int) -> str:
    return "high" if total and 10 * n >= 8 * total else "medium" if total and 2 * n >= total else "low"


def decide(header: str, index: int, c: dict, postal: dict[str, int] | None = None, context: list[str] | None = None) -> Profile:
    """The type of a column from its counts: validators, headers that values bear out, postal codes, patterns, numbers, names, addresses, enums."""
    n = c["non_empty"]
    p = Profile(header, index, non_empty=n, empty_format=empty_format(bool(c.get("has_empty")), bool(c.get("has_null"))))
    if not n:
        return p
    names = headers.matched(header)
    postal = postal or {}
    found: tuple[str, str, str] | None = None

    def take(kind: str, count: int, detector: str) -> tuple[str, str, str] | None:
        level = _share(count, n)
        return (kind, level, detector) if level != "low" else None

    best = None
    for at, (kind, (_, evidence, specific)) in enumerate(V.PRIORITY.items()):
        level = _share(c[f"is_{kind}"], n)
        if level != "low":
            best = max(best or (), (RANK[level], evidence, specific, c[f"is_{kind}"], -at, kind, level))
    national = _share(c.get("ok_nationalId") or 0, n)
    if national != "low":
        best = max(best or (), (RANK[national], 3, 100, c["ok_nationalId"], -50, "taxId", national))
    country = f":{c['country']}" if best and best[4] == -50 and c.get("country") else ""
    top = (best[5], best[6], f"validator:national-id{country}" if best[4] == -50 else "validator" if best[1] == 3 else "pattern") if best else None
    bare = c[{"ssn": "is_ssn9", "ein": "is_ein9", None: "is_tax9"}[headers.tax_context(header)]] + (c["is_btw"] if headers.dutch_btw_context(header) else 0)
    early = next((x for h, kind, count in (("phone", "phone", c["is_phonePlan"]), ("postal_code", "postalCode", sum(postal.values())), ("address", "address", c["is_address"]), ("tax_id", "taxId", c["is_taxId"] + bare + (c.get("ok_vat") or 0))) if h in names and (x := take(kind, count, f"header:{h}"))), None)
    validated = take("taxId", c.get("ok_vat") or 0, "validator:vat") or take("string", c.get("ok_iban") or 0, "validator:iban") or (top if top and best[1] == 3 else None)
    if validated:
        found = validated
        if early and early[0] == validated[0]:
            found = (early[0], "high" if early[1] != "low" else "medium", early[2])
    found = found or early
    if not found and context:
        found = take("postalCode", sum(postal.values()), "postal")
    found = found or top
    if not found and names & {"numeric_id", "account_number"}:
        found = take("numericId", c["is_unsigned"], "header:numeric_id")
    if not found and "opaque_identifier" in names and c.get("key_like"):
        found = take("numericId", c["is_keyToken"], "header:opaque_identifier")
    found = found or take("numericValue", c["is_numericValue"], "pattern:numeric")
    for h, kind, count in (("full_name", "fullName", c["is_fullName"]), ("first_name", "firstName", c["is_namePart2"]), ("last_name", "lastName", c["is_namePart4"]), ("generic_name", "fullName", c["is_fullName"])):
        if not found and h in names:
            found = take(kind, count, f"header:{h}")
    if not found and not context:
        found = take("postalCode", sum(postal.values()), "postal")
    if not found and 10 * c["is_street"] >= 3 * max(c["is_address"], 1):
        found = take("address", c["is_address"], "pattern:address")
    if not found and n > ENUM_OVER and c["distinct"] <= ENUM_MOST:
        found = ("enum", "high", "cardinality")
    p.kind, p.confidence, p.detector = found or ("string", "low", "")
    p.risk = RISK.get(p.kind, "low")
    for signal, kind, level in (("secret", "credentialOrSecret", "high"), ("account_number", "accountOrFinancialId", "high"), ("device_identifier", "networkOrDeviceId", "medium"), ("private_date", "privateDate", "medium"), ("account_identifier", "recordIdentifier", "medium")):
        if signal in names:
            fits = c[f"is_fits_{kind}"] if kind in HEADER_FITS else n
            if not fits:
                continue
            p.evidence.append((kind, f"header:{signal}", fits))
            p.risk = max(p.risk, level, key=RANK.get)
            break
    if p.kind in KIND_OF:
        p.evidence.append((KIND_OF[p.kind], p.detector, n))
    return p


def profiled(df: DataFrame, names: list[str] | None = None) -> list[Profile]:
    """A profile of each column of df, from all its rows, under its header; only aggregates reach the driver."""
    columns, names = df.columns, names or df.columns
    cells = long_form(df, columns)
    counts = {r["col"]: r.asDict() for r in votes(cells).collect()}
    for extra in (checksum_votes(cells), key_likeness(cells).select("col", "key_like")):
        for r in extra.collect():
            counts[r["col"]].update(r.asDict())
    codes = [r["code"] for r in locale(cells).limit(10).collect()]
    postal: dict[str, dict[str, int]] = {}
    for r in postal_votes(cells, codes).collect():
        postal.setdefault(r["col"], {})[r["country"]] = r["n"]
    out = []
    for i, c in enumerate(columns):
        out.append(decide(names[i], i, counts.get(c, {"non_empty": 0}), postal.get(c), codes))
    return out
