"""Personal data by fixed patterns and by bootstrapped contexts; DataFrame functions only.

Base kinds (email, ip, card, phone) are leftmost matches that do not overlap within a kind; those that fail
their test go. Where a pattern repeats a group, single separators are first marked by a character of the
same length, so that the pattern needs no group and runs in linear time and constant stack on any text. Places come
from the lengths between and of the matches, in code points.

The method adds the kind ``id``. Candidates are values behind a label (``password=...``, ``token = "..."``, also
``--token=...``) and long tokens that mix letters and digits, also in quotes, behind = or before a full stop, all of
any length. Each has lexical patterns: its label, or the word left of it, and the capitals it begins with. Seeds are
labelled base entities and labelled values whose label is one of `seeds` (or ends with one); nothing is a seed for its looks, so that hashes
of commits or files are none. Pattern and candidate scores are computed in turn over the graph of patterns and values: a
pattern has the mean score of its candidates, drawn towards 0 when there are few, and a candidate that is no
seed has the best score of its patterns, so that a value met under a known label teaches the contexts where it stands
without one. Patterns of high confidence then take all their candidates, and seeds
with letters and digits stay at any rate; of nested spans the outer one counts.

Cases: null and empty texts have no spans; repeated rows, ties of doc_id and null doc_ids keep a row each, each with the
spans of its own text; an empty table gives an empty result; texts and values of any length are read whole, without
recursion in the patterns; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import only, whole_number, written

KINDS = ("email", "ip", "card", "phone")
# Characters of private use, which stand for single separators; in a text they become one that no pattern takes.
_GAP, _DOT, _OTHER = "\ue000", "\ue001", "\u0001"
EMAIL = f"(?:(?<![A-Za-z0-9._%+{_DOT}-])|\\G)[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{_GAP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LABEL = "[A-Za-z_-][A-Za-z0-9_-]{2,}+ ?[=:]"
LABELLED = f"(?<![A-Za-z0-9_-]){_LABEL} ?[\"']?[^\\s\"'=:,;<>]{{6,}}+"
TOKEN = r"(?<![A-Za-z0-9_])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+(?![A-Za-z0-9_@]|\.[A-Za-z0-9])"
_BLOCK = 256
#: How far before a token its left word may begin.
_LEFT = 48
#: Labels whose values are seeds.
SEEDS = tuple("password passwd pwd passphrase secret token api_key apikey access_key auth_key private_key client_key credential ssn iban passport".split())


def _prefix_sums(n: Column) -> Column:
    """Sums of all lengths before each; in blocks, so that many matches cost no square of their number."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda b: F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    starts = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + total(x))))
    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda s, at: F.transform(s, lambda _, i: at + total(F.slice(s, F.lit(1), i)))))


def matches(text: Column, pattern: str, worth: Column, left: bool = False) -> Column:
    """array of (start, end, value) of the pattern's matches; worth: a cheap test that a text may have any. left: with the word before, too."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.length(b) + F.length(m))
    ends = F.zip_with(_prefix_sums(lengths), lengths, lambda a, n: a + n)
    spans = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).cast("long").alias("start"), e.cast("long").alias("end"), m.alias("value")))
    kind = "start:bigint,end:bigint,value:string"
    if left:
        word = lambda b: F.lower(F.regexp_extract(F.substring(b, -_LEFT, _LEFT), r"([A-Za-z_]+)[^A-Za-z0-9_]{1,3}$", 1))
        spans = F.zip_with(spans, F.slice(between, F.lit(1), F.size(found)), lambda s, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), word(b).alias("left")))
        kind += ",left:string"
    none = F.array().cast(f"array<struct<{kind}>>")
    return F.when(worth, F.when(F.size(found) > 0, spans).otherwise(none)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of (start, end, value) that pass the kind's test; text is never null."""
    clean = F.translate(text, _GAP + _DOT, _OTHER * 2)
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", _GAP)
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    part = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"
    return {
        "email": matches(dotted, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(clean, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(part))),
        "card": F.filter(matches(joined, CARD, text.rlike("[0-9][ -]?[0-9]")), lambda s: F.length(digits(s["value"])).between(14, 19) & F.call_function("luhn_check", digits(s["value"]))),
        "phone": F.filter(matches(clean, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["value"])).between(10, 15)),
    }


def _joined(spans: Column) -> Column:
    """kind:start:end of an array of (start, order, end, kind), sorted, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(rows: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """rows (row, text): (row, start, end, value, label, left, head, seed) of what may be an identifier."""
    place = lambda s, label, left: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("all"), label.alias("label"), left.alias("left"))
    labelled = F.transform(matches(F.col("text"), LABELLED, F.col("text").rlike("[=:]")), lambda s: place(s, F.regexp_extract(s["value"], f"^({_LABEL})", 1), F.lit("")))
    tokens = F.transform(matches(F.col("text"), TOKEN, F.col("text").rlike("[0-9]"), left=True), lambda s: place(s, F.lit(""), s["left"]))
    out = rows.select("row", F.explode(F.concat(labelled, tokens)).alias("s")).select("row", "s.*")
    value = F.when(F.col("label") != "", F.regexp_replace("all", f"^{_LABEL} ?[\"']?", "")).otherwise(F.col("all"))
    label = F.regexp_replace(F.regexp_replace(F.lower("label"), "^-+| ", ""), ":$", "=")
    out = out.select("row", (F.col("end") - F.length(value)).alias("start"), "end", value.alias("value"), label.alias("label"), "left")
    head = F.when(F.length("value") >= 16, F.regexp_extract("value", "^[A-Z]{3,4}", 0)).otherwise("")
    base = F.col("value").rlike(r"^[^@]+@[^@]+\.[^@]+$|^\+?[0-9][0-9 -]{11,}$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    known = F.regexp_replace("label", "-", "_").rlike(f"(^|_)({'|'.join(seeds)})s?=$")
    return out.select("row", "start", "end", "value", "label", "left", head.alias("head"), ((F.col("label") != "") & (base | known)).alias("seed"))


def _of() -> Column:
    """The patterns of a candidate."""
    return F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in ("label", "left", "head")]))


def patterns(found: DataFrame, rounds: int = 3, prior: float = 2.0) -> DataFrame:
    """(pattern, score, n): the pattern-instance graph of candidates, scored in turn `rounds` times."""
    instances = written(found.groupBy("value", "label", "left", "head").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "instances")
    # A value that is a seed anywhere is one everywhere.
    sure = instances.groupBy("value").agg(F.max("seed").alias("seed"))
    edges = instances.select("value", F.explode(_of()).alias("pattern")).distinct().join(sure, "value")
    edges = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for k in range(rounds):
        scored = written(edges.groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("score"), F.count("*").alias("n")), "patterns")
        if k == rounds - 1:
            return scored
        best = edges.select("value", "seed", "pattern").join(scored, "pattern").groupBy("value").agg(F.max("score").alias("score"), F.max("seed").alias("seed")).select("value", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score"))
        edges = edges.drop("score").join(best, "value")
    return scored


def report(docs: DataFrame, confidence: float = 0.6, least: int = 3, salts: int = 16) -> DataFrame:
    """doc_id, n_email .. n_phone, n_id, n_found (all kinds), base_sha256, spans (all kinds, sorted): one row for each row of docs."""
    rows = whole_number(only(docs, doc_id="doc_id", text="text"), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    # Rows that share doc and key have the same text, and so the same spans.
    keyed = rows.withColumns({"doc": F.coalesce("doc_id", F.lit(-1)), "key": F.xxhash64("text")})
    struct = lambda kind, order: lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    # The graph is built from the candidates of all documents; those with a good pattern are met under a salted key, as one pattern may have most of them.
    maybe = written(candidates(keyed.select(F.struct("doc", "key").alias("row"), "text")), "candidates")
    good = patterns(maybe).where((F.col("score") >= confidence) & (F.col("n") >= least))
    good = good.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    taken = maybe.select("row.*", "start", "end", F.explode(_of()).alias("pattern"))
    taken = taken.withColumn("salt", F.pmod(F.xxhash64("doc", "key", "start"), F.lit(salts)).cast("int")).join(good, ["pattern", "salt"])
    # A seed with letters and digits needs no pattern of many others.
    sure = maybe.where(F.col("seed") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).select("row.*", "start", "end")
    taken = taken.select("doc", "key", "start", "end").union(sure).distinct()
    # A token inside a labelled value, and a candidate that several patterns took, are one span.
    before = Window.partitionBy("doc", "key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("reach", F.max("end").over(before)).where("reach is null or end > reach")
    added = taken.groupBy("doc", "key").agg(F.collect_set(struct("id", len(KINDS))({"start": F.col("start"), "end": F.col("end")})).alias("added"))
    kinds = base_spans(F.col("text"))
    keyed = keyed.select("doc_id", "doc", "key", *[spans.alias(kind) for kind, spans in kinds.items()])
    base = F.concat(*[F.transform(kind, struct(kind, k)) for k, kind in enumerate(KINDS)])
    keyed = keyed.select("doc_id", "doc", "key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), base.alias("base"))
    out = keyed.join(added, ["doc", "key"], "left").withColumn("added", F.coalesce("added", F.array().cast(added.schema["added"].dataType)))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.size("added").cast("long").alias("n_id"), "base_sha256", _joined(F.concat("base", "added")).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_found"))
