import re

from pyspark.sql import functions as F

from tabveil.functions import values as V
from tabveil.operators import audit, distribution, profile, ranking, sampling, smart, spans, strategies, uniqueness

SEED = F.lit


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_classes(spark):
    rows = table(spark, [(v,) for v in "aaaabbbccd"], "x string")
    s = uniqueness.summary(rows).first()
    assert (s.distinct_classes, s.unique_rows, s.smallest_class, s.fifth_percentile_class_size, s.rows_measured) == (4, 1, 1, 1, 10)


def test_percentile_is_by_rows(spark):
    rows = table(spark, [("one",)] + [("many",)] * 39, "x string")
    s = uniqueness.summary(rows).first()
    assert (s.smallest_class, s.fifth_percentile_class_size) == (1, 39)


def test_leave_one_out(spark):
    rows = table(spark, [("a", "x", "1"), ("a", "x", "2"), ("a", "y", "3"), ("a", "y", "4"), ("b", "z", "5")], "p string, q string, r string")
    assert {r["col"]: r.unique_rows_without for r in uniqueness.leave_one_out(rows).collect()} == {"p": 5, "q": 5, "r": 1}
    assert uniqueness.summary(rows).first().unique_rows == 5


def test_projections(spark):
    df = table(spark, [("user1@x.org", "2021-03-04T05:06", "+1 (555) 1234567", "00420", "-001.50", "Ann Lee")], "e string, t string, p string, i string, n string, f string")
    kinds = {"e": "email", "t": "timestamp", "p": "phone", "i": "numericId", "n": "numericValue", "f": "fullName"}
    r = df.select([uniqueness.projection(F.col(c), k, "pseudonymize")[1].alias(c) for c, k in kinds.items()]).first()
    assert (r.e, r.t, r.i, r.n, r.f) == ("@x.org", "202|T05:06", "5:2", "-3:2.2", "2")
    assert r.p == "+\0 (\0\0\0) " + "\0" * 7


def test_matched(spark):
    rows = table(spark, [("a", None, "k"), ("b", None, "k")], "x string, y string, z string")
    got = {r["col"]: (r.matched, r.matched_every_row) for r in uniqueness.matched_columns(rows).collect()}
    assert got == {"x": (True, True), "y": (False, False), "z": (False, True)}


def test_distribution_and_risk(spark):
    df = table(spark, [("q%d" % (i // 2 if i < 100 else 0),) for i in range(200)] + [(" NULL ",), (None,)], "v string")
    s = distribution.with_risk(distribution.distribution(df, ["v"])).first()
    assert (s.distinct_values, s.total_values, s.max_value_occurrences, s.risk) == (50, 200, 102, "dominantValue")
    few = distribution.with_risk(distribution.distribution(table(spark, [(str(i % 3),) for i in range(60)], "v string"), ["v"])).first()
    assert few.risk == "fewDistinctValues"


def test_chao1(spark):
    f = lambda d, a, b: spark.range(1).select(distribution.chao1(F.lit(d), F.lit(a), F.lit(b))).first()[0]
    assert f(10, 4, 2) == 14 and f(10, 4, 0) == 16 and f(10, 0, 0) == 10


def test_samples(spark):
    df = spark.range(5000).withColumnRenamed("id", "i")
    got = [r.i for r in sampling.spread(df, "i", 100).collect()]
    assert len(set(got)) == 100 and sorted(got) == sorted(r.i for r in sampling.spread(df.repartition(7), "i", 100).collect())
    assert sorted(r.i for r in sampling.even(df, "i", 200).collect()) == [k * 25 for k in range(200)]


def test_ranks_are_global(spark):
    df = spark.range(3000).select((F.col("id") * 17 % 3001).alias("k"))
    got = {r.k: r["rank"] for r in ranking.by_number(df, "k").collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 3001))


def test_shapes(spark):
    seed = F.lit("s")
    df = table(spark, [("00420", "-012.50", "+1 (555) 123-4567", "2021-03-04T05:06:07Z", "6F9619FF-8B86-D011-B42D-00C04FC964FF", "hello world")], "i string, n string, p string, t string, u string, g string")
    r = df.select(strategies.numeric_id(F.col("i"), seed).alias("i"), strategies.numeric_value(F.col("n"), seed).alias("n"), strategies.phone(F.col("p"), seed).alias("p"), strategies.timestamp(F.col("t"), seed).alias("t"), strategies.uuid(F.col("u"), seed).alias("u"), strategies.generic(F.col("g"), seed).alias("g")).first()
    s = df.first()
    assert re.fullmatch("00[1-9][0-9]{2}", r.i) and r.i != s.i
    assert re.fullmatch(r"-0[1-9][0-9]\.[0-9]{2}", r.n) and r.n != s.n
    assert re.sub("[0-9]", "0", r.p) == re.sub("[0-9]", "0", s.p) and r.p != s.p
    assert r.t.endswith("T05:06:07Z") and r.t[:10] != s.t[:10]
    assert re.fullmatch(r"[0-9A-F]{8}-[0-9A-F]{4}-4[0-9A-F]{3}-[89AB][0-9A-F]{3}-[0-9A-F]{12}", r.u)
    assert 8 <= len(r.g) <= 14 and r.g.lower() != s.g


def test_mappings_are_injective(spark):
    mails = table(spark, [(f"u{i}@d{i % 3}.org",) for i in range(500)] + [("U1@D1.ORG",)], "value string")
    got = strategies.email_mapping(mails, F.lit("s")).collect()
    assert len(got) == 500 == len({r.output for r in got}) and all(r.output.split("@")[1] == r.key.split("@")[1] for r in got)
    names = table(spark, [(f"Name{i} Ada",) for i in range(200)], "value string")
    got = strategies.name_mapping(names, F.lit("s")).collect()
    assert len({r.output for r in got}) == 201 and not {r.output.lower() for r in got} & {r.key for r in got}


def test_labels(spark):
    df = table(spark, [(3, "b"), (1, "a"), (2, " B "), (4, ""), (5, "c")], "i long, v string")
    got = [r.o for r in strategies.labels(df, "v", "i", "V", "o").orderBy("i").collect()]
    assert got == ["[V_1]", "[V_2]", "[V_2]", "", "[V_3]"]


def test_placeholders():
    assert strategies.placeholder("E-mail addr.", 0, "email") == "[EMAIL]"
    assert strategies.placeholder("order id", 2, "numericId") == "[ORDER_ID]"
    assert strategies.placeholder("order id", 2, "numericId", ambiguous=True) == "[ORDER_ID_2]"
    assert strategies.placeholder("x", 1, "string", "contact", "phone") == "[PHONE]"
    assert strategies.placeholder("???", 4) == "[COLUMN_4]"


def test_spans():
    found = spans.find("mail a.b@example.com ip 10.0.0.1 card 4111 1111 1111 1111 token password=hunter22x +1 (555) 123-4567 5551234567")
    assert [s[7] for s in found] == ["validator:email", "pattern:ip", "validator:card", "pattern:secret-assignment", "pattern:phone", "pattern:phone-digits"]
    assert spans.utf16("\U0001f600a", 1) == 2


def test_fold_agrees_with_find(spark):
    c = [(0, 10, 5), (0, 4, 1), (4, 9, 2), (8, 12, 0), (12, 13, 9)]
    df = table(spark, [([{"start": a, "end": b, "priority": p} for a, b, p in c],)], "s array<struct<start:int,end:int,priority:int>>")
    assert [(r.start, r.end) for r in df.select(spans.selected(F.col("s")).alias("x")).first().x] == [(0, 4), (4, 9), (12, 13)]


def test_evidence(spark):
    docs = table(spark, [(1, "a@b.co c@d.co"), (2, "a@b.co 10.0.0.1"), (3, "nothing")], "id long, t string")
    got = {(r.kind, r.type): (r.match_count, r.risk, r.actionable) for r in spans.evidence(spans.spans(docs, "id", "t"), "id").collect()}
    assert got == {("contact", "email"): (2, "high", True), ("networkOrDeviceId", "ipAddress"): (1, "medium", True)}


def test_audits(spark):
    df = table(spark, [("ann", "x1", "x1"), ("bob", "bob", "q"), ("", "", "ann")], "s string, r string, o string")
    assert audit.unchanged(df, {"c": ("s", "r")}).first().unchanged == 1
    r = audit.residual(df, ["s"], ["r", "o"]).first()
    assert (r.protected_values, r.released_values, r.overlap) == (2, 4, 2)


def test_overlap(spark):
    c = table(spark, [(0, 1, 5, 9), (0, 1, 9, 12)], "col int, row int, start int, end int")
    s = table(spark, [(0, 1, 8, 9)], "col int, row int, start int, end int")
    assert [r.start for r in audit.without_overlap(c, s).collect()] == [9]


def test_replacements():
    given = ["Jan Smit", "Ann Lee", "Bo", "Cy Young", "Di", "Ed"]
    answers = [("Zed", "x"), ("Jan Smit", " Janneke Visser "), ("jan  smit", "Other"), ("Ann Lee", "ann lee"), ("Bo", "Mr. Cy Young"), ("Cy Young", "Janneke visser"), ("Di", "")]
    out, why = smart.accepted(given, {smart.key(v) for v in given}, answers, set())
    assert out == {"Jan Smit": "Janneke Visser"}
    assert why == {"unexpectedOriginal": 1, "duplicateOriginal": 1, "sameAsOriginal": 1, "matchesOtherOriginal": 1, "duplicateOutput": 1, "emptyOutput": 1, "missingOutput": 1}


def test_requests():
    packs = smart.requests([("c", i, "x" * 1000) for i in range(40)])
    assert [len(p) for p in packs] == [12, 12, 12, 4]
    assert len(smart.requests([("c", i, "x") for i in range(1000)])) == 10


def test_candidates(spark):
    cells = table(spark, [("a", 1, "hello world")], "col string, row int, value string")
    c = table(spark, [("a", 1, 0, 5, "person", 9000), ("a", 1, 6, 11, "person", 9500), ("a", 1, 6, 99, "person", 9900), ("a", 2, 0, 1, "person", 9900), ("a", 1, 0, 5, "person", 100)], "col string, row int, start int, end int, kind string, score int")
    s = table(spark, [("a", 1, 4, 6)], "col string, row int, start int, end int")
    assert [(r.start, r.score) for r in smart.valid_candidates(c, cells, s).collect()] == [(6, 9500)]


def test_profiles(spark):
    rows = [(f"u{i}@x.org", f"{100000 + i}", ["open", "done"][i % 2], f"Ann{'abcdefghij'[i % 10]} Lee", f"{10 + i}.5", f"2021-01-{i % 28 + 1:02d}", f"CUST-{i:04d}", "", ["NL", "DE"][i % 2]) for i in range(40)]
    df = table(spark, rows, "mail string, order_id string, status string, full_name string, amount string, day string, reference string, none string, country string")
    got = {p.header: (p.kind, p.risk) for p in profile.profiled(df)}
    assert got == {"mail": ("email", "high"), "order_id": ("numericId", "medium"), "status": ("enum", "low"), "full_name": ("fullName", "high"), "amount": ("numericValue", "low"), "day": ("timestamp", "low"), "reference": ("numericId", "medium"), "none": ("unknown", "high"), "country": ("countryCode", "low")}


def test_confidence(spark):
    f = lambda m, n: spark.range(1).select(V.confidence(F.lit(m), F.lit(n))).first()[0]
    assert [f(8, 10), f(5, 10), f(4, 10), f(0, 0)] == ["high", "medium", "low", "low"]
