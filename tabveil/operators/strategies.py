"""Protection of column values. Every draw is a keyed hash, so that a plan gives the same values however often Spark runs it.

Kept promises: a key has one output in a domain; two keys have two outputs while the space lasts; no output equals
its source. Domains of pseudonyms are shared by all columns, tokens and labels belong to a column. The seed is a
column expression, so that it can come from a one-row table and needs no place in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.functions import values as V
from tabveil.operators import ranking
from tabveil.operators.uniqueness import PASS_THROUGH

STRATEGIES = ("auto", "pseudonymize", "tokenize", "localAi", "mask", "label", "redact", "passThrough")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
FIRST = "Ada Ben Cleo Dan Elsa Finn Gia Hugo Ines Jack Kira Liam Mona Nils Olga Paul Quin Rosa Sven Tara Ugo Vera Wim Xena Yara Zoe Arlo Beth Cora Dirk Emil Faye Greg Hana Ivor Jana Karl Lena Milo Nora".split()
LAST = "Abbot Birch Crane Dale Elm Frost Grove Heath Iver Jewel Keen Lark Marsh North Oakes Pike Quill Reed Shaw Thorn Upton Vale Wren Yates Zeller Ash Brook Cliff Drake Eden Field Glen Hart Isle Jarvis Knoll Lodge Moor Nash Orchard".split()


def blank_kept(v: Column, out: Column) -> Column:
    """The rule of every strategy: values that are empty when trimmed stay as they are."""
    return F.when(V.is_empty(V.trimmed(v)), v).otherwise(out)


def _once(v: Column, out: Callable[[Column], Column]) -> Column:
    """blank_kept over the trimmed value, which is computed once a row."""
    return V.let(V.trimmed(v), lambda t: F.when(V.is_empty(t), v).otherwise(out(t)))


def column_label(header: str, index: int) -> str:
    """Runs of letters and digits in upper case, joined by _, cut where 40 characters are reached."""
    out, gap = "", False
    for c in header:
        if c.isalnum():
            out += ("_" if gap and out else "") + c.upper()
            gap = False
            if len(out) >= 40:
                break
        else:
            gap = True
    return out or f"COLUMN_{index}"


#: Markers of types and of kinds of evidence.
TYPE_MARKERS = {"email": "[EMAIL]", "phone": "[PHONE]", "firstName": "[PERSON]", "lastName": "[PERSON]", "fullName": "[PERSON]", "address": "[ADDRESS]", "taxId": "[GOVERNMENT_ID]", "ipAddress": "[NETWORK_ID]", "macAddress": "[NETWORK_ID]", "url": "[URL]"}
KIND_MARKERS = {"person": "[PERSON]", "contact": "[CONTACT]", "privateAddress": "[ADDRESS]", "addressRegion": "[ADDRESS]", "privateDate": "[DATE]", "accountOrFinancialId": "[ACCOUNT_ID]", "governmentId": "[GOVERNMENT_ID]", "credentialOrSecret": "[SECRET]", "networkOrDeviceId": "[NETWORK_ID]", "url": "[URL]"}


def placeholder(header: str, index: int, kind: str = "unknown", evidence: str | None = None, evidence_type: str | None = None, ambiguous: bool = False) -> str:
    """What redaction writes: by type, else by the strongest evidence, else by the header."""
    if kind in TYPE_MARKERS:
        return TYPE_MARKERS[kind]
    if evidence == "contact" and evidence_type in ("email", "phone"):
        return TYPE_MARKERS[evidence_type]
    if evidence in KIND_MARKERS:
        return KIND_MARKERS[evidence]
    label = column_label(header, index)
    return f"[{label}_{index}]" if ambiguous else f"[{label}]"


def token(v: Column, key: Column, header: str, index: int) -> Column:
    return F.concat(F.lit("tok_"), F.substring(V.keyed_hash(key, F.lit("token"), F.lit(str(index)), F.lit(header), V.identity_key(v)), 1, 24))


def uuid(v: Column, seed: Column) -> Column:
    def made(h: Column) -> Column:
        s = lambda a, n: F.substring(h, a, n)
        variant = F.substring(F.lit("89ab"), (F.conv(s(17, 1), 16, 10).cast("int") % 4 + 1).cast("int"), F.lit(1))
        return F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-4"), s(14, 3), F.lit("-"), variant, s(18, 3), F.lit("-"), s(21, 12))

    out = V.let(V.keyed_hash(seed, F.lit("uuid"), V.identity_key(v)), made)
    return F.when((v == F.upper(v)) & v.rlike("[A-Z]"), F.upper(out)).otherwise(out)


def timestamp(v: Column, seed: Column) -> Column:
    """The date moved by 1 to 365 days either way, the rest as it is; null: no date in front."""

    def shift(h: Column) -> Column:
        days = V.hash_number(h, 1, 8) % 365 + 1
        return F.when(V.hash_number(h, 9, 1) % 2 == 0, days).otherwise(-days).cast("int")

    day = F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    days = V.let(V.keyed_hash(seed, F.lit("timestamp"), V.identity_key(v)), shift)
    return F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & day.isNotNull(), F.concat(F.date_add(day, days).cast("string"), F.substr(v, F.lit(11))))


def _digits(seed: Column, domain: str, v: Column) -> Column:
    """128 decimal digits of two hashes."""
    h = lambda n: V.keyed_hash(seed, F.lit(domain), V.identity_key(v), F.lit(n))
    return F.translate(F.concat(h("0"), h("1")), "abcdef", "012345")


def _bumped(out: Column, v: Column) -> Column:
    """Another last digit if nothing changed."""

    def bump(o: Column) -> Column:
        last = F.regexp_extract(o, "([0-9])[^0-9]*$", 1)
        other = F.when(last == "9", "1").otherwise((last.cast("int") + 1).cast("string"))
        return F.when(o == v, F.concat(F.regexp_replace(o, "[0-9]([^0-9]*)$", ""), other, F.regexp_extract(o, "[0-9]([^0-9]*)$", 1))).otherwise(o)

    return V.let(out, bump)


def phone(v: Column, seed: Column) -> Column:
    out = lambda d: F.array_join(F.transform(F.split(v, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(d, i % 128 + 1, F.lit(1))).otherwise(c)), "")
    return F.when((F.length(V.digits(v)) >= 7) & v.rlike(r"^[0-9 ()+.\-xet#*,;/]+$"), _bumped(V.let(_digits(seed, "phone", v), out), v))


def _fresh(width: Column, d: Column, first_at: int) -> Column:
    """`width` digits, the first not 0."""
    first = (F.substring(d, first_at, 1).cast("int") % 9 + 1).cast("string")
    return F.when(width > 0, F.concat(first, F.substring(d, F.lit(first_at + 1), width - 1))).otherwise("")


def numeric_id(v: Column, seed: Column) -> Column:
    """As wide as it was, its leading zeros kept; null: not only digits."""
    zeros = F.regexp_extract(v, "^(0*)", 1)
    out = V.let(_digits(seed, "numericId", v), lambda d: F.concat(zeros, _fresh(F.length(v) - F.length(zeros), d, 1)))
    return F.when(v.rlike("^[0-9]{1,100}$") & v.rlike("[1-9]"), _bumped(out, v)).when(v.rlike("^0+$"), _bumped(v, v))


def numeric_value(v: Column, seed: Column) -> Column:
    """Sign, widths, decimals and leading zeros as they were; null: no number."""
    parts = r"^([+-]?)(0*)([0-9]*)(\.?)([0-9]*)$"
    x = lambda k: F.regexp_extract(v, parts, k)
    out = V.let(_digits(seed, "numericValue", v), lambda d: F.concat(x(1), x(2), _fresh(F.length(x(3)), d, 1), x(4), F.substring(d, F.lit(65), F.length(x(5)))))
    return F.when(V.whole(v, V.NUMERIC) & v.rlike(parts) & (F.length(v) <= 60), _bumped(out, v))


def generic(v: Column, seed: Column) -> Column:
    """Characters of an alphabet of 64, 80 to 120 % of the bytes; never the source in another case."""

    def made(h: Column) -> Column:
        width = F.greatest(F.lit(1), F.floor(F.octet_length(v) * (80 + V.hash_number(h, 1, 6) % 41) / 100)).cast("int")
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(width / 32)).cast("int"))
        # Each hash gives 32 characters, one for two of its digits.
        char = lambda x, i: F.substring(F.lit(ALPHABET), (F.conv(F.substring(x, 2 * i - 1, F.lit(2)), 16, 10).cast("int") % 64 + 1).cast("int"), F.lit(1))
        part = lambda k: V.let(F.sha2(F.concat(h, k.cast("string")).cast("binary"), 256), lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: char(x, i)), ""))
        return F.substring(F.array_join(F.transform(rounds, part), ""), F.lit(1), width)

    drawn = V.let(V.keyed_hash(seed, F.lit("generic"), V.identity_key(v)), made)
    return V.let(drawn, lambda o: F.when(F.lower(o) == F.lower(v), F.concat(o, F.lit("x"))).otherwise(o))


def labels(df: DataFrame, column: str, order: str, label: str, out: str) -> DataFrame:
    """df with [LABEL_n] in `out`: n is the place of a value's key by first appearance, as `order` (a whole number) has it."""
    key = V.identity_key(F.col(column))
    rows = df.withColumn("_k", F.when(~V.is_empty(V.trimmed(F.col(column))), key))
    first = ranking.by_number(rows.where("_k is not null").groupBy("_k").agg(F.min(order).alias("_first")), "_first", "_n")
    named = rows.join(first.select("_k", "_n"), "_k", "left")
    return named.withColumn(out, F.when(F.col("_n").isNull(), F.col(column)).otherwise(F.concat(F.lit(f"[{label}_"), F.col("_n").cast("string"), F.lit("]")))).drop("_k", "_n")


def email_mapping(values: DataFrame, seed: Column, known: DataFrame | None = None) -> DataFrame:
    """(key, output) of distinct e-mail keys: user{n}@ and the key's domain. n is the rank of a key's hash, after those in `known`."""
    keys = values.select(V.identity_key(F.col("value")).alias("key")).where(F.contains("key", F.lit("@"))).distinct()
    start = 0
    if known is not None:
        keys = keys.join(known.select("key"), "key", "left_anti")
        start = known.count()
    placed = ranking.by_hash(keys.withColumn("h", V.keyed_hash(seed, F.lit("email"), F.col("key"))), F.col("h"))
    return placed.select("key", F.concat(F.lit("user"), (F.col("rank") + start).cast("string"), F.lit("@"), F.substring_index("key", "@", -1)).alias("output"))


def name_mapping(values: DataFrame, seed: Column, domain: str = "firstName") -> DataFrame:
    """(key, output) of distinct name tokens: a name of the pool by the rank of the key's hash, then with a number of letters behind it.

    A name that is itself a token of the data is left out of the pool, so that no output is anybody's source.
    """
    pool = FIRST if domain == "firstName" else LAST
    keys = values.select(F.explode(F.split(V.identity_key(F.col("value")), " ")).alias("key")).where("key <> ''").distinct()
    taken = {r["key"] for r in keys.where(F.col("key").isin([p.lower() for p in pool])).collect()}  # at most the pool
    free = [p for p in pool if p.lower() not in taken] or [f"{p}a" for p in pool]
    placed = ranking.by_hash(keys.withColumn("h", V.keyed_hash(seed, F.lit(domain), F.col("key"))), F.col("h"))
    turn = F.floor((F.col("rank") - 1) / len(free))
    suffix = F.when(turn == 0, "").otherwise(F.translate(F.lpad(F.conv(turn.cast("string"), 10, 16), 4, "0"), "0123456789ABCDEF", "bcdfghjklmnpqrst"))
    return placed.select("key", F.concat(F.element_at(F.array(*[F.lit(p) for p in free]), ((F.col("rank") - 1) % len(free) + 1).cast("int")), suffix).alias("output"))


def expression(v: Column, kind: str, strategy: str, header: str, index: int, seed: Column, marker: str | None = None) -> Column | None:
    """The released value as an expression; None: it needs a mapping (labels, e-mails, names)."""
    if strategy == "passThrough" or (strategy in ("auto", "pseudonymize") and kind in PASS_THROUGH):
        return v
    t = V.trimmed(v)
    if strategy == "mask":
        return blank_kept(v, V.mask(t))
    if strategy == "redact":
        return blank_kept(v, F.lit(marker or placeholder(header, index, kind)))
    if strategy == "tokenize":
        return _once(v, lambda t: token(t, seed, header, index))
    if strategy == "label" or kind in ("email", "firstName", "lastName", "fullName"):
        return None
    shaped = {"uuid": uuid, "timestamp": timestamp, "phone": phone, "numericId": numeric_id, "numericValue": numeric_value}.get(kind)
    return _once(v, lambda t: F.coalesce(shaped(t, seed), generic(t, seed)) if shaped else generic(t, seed))
