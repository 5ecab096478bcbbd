import hashlib
import re

from tabveil.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "a@b.c@d.e x_a@b.c_d@e.f aa@@b.c a..b@c.d.e..f", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 +1 (555) 123-4567) +49.30.1234567 +1",
    "é\U0001F600 a@b.co \U0001F600 " + "1 " * 3000 + "x " + "a.b" * 2000, " 41111111 ab@c.d", "", None, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "1-2-3-" * 5000, "a@" + "b." * 5000 + "c", "x@y.z " * 3000,
]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def test_base_kinds(spark, odd, none):
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for i, text in enumerate(TEXTS):
        found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m.group())]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)).encode()).hexdigest(), text and text[:50]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(f[3] == k for f in found) for k in PATTERNS]
    assert pii.report(odd).count() == 8 and pii.report(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    rows = [(i, f'the token = "{h}" of a b') for i, h in enumerate(hexes)] + [(100 + i, f"and password={h[:18]} too") for i, h in enumerate(hexes)] + [(200, "and password=letters-only too"), (201, "plain words, nothing = here")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "id:13:53" and got[100] == "id:13:31" and got[200] == "id:13:25" and got[201] == ""


def test_any_number_of_patterns(spark):
    from pyspark.sql import functions as F

    # 11,000 labels in letters only, each with three seeds.
    name = lambda c: F.translate(F.lpad(c.cast("string"), 5, "0"), "0123456789", "abcdefghij")
    rows = spark.range(33_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the "), name(F.floor(F.col("id") / 3)), F.lit("="), F.format_string("u%d@mail.org", "id")).alias("text"))
    assert pii.report(rows).where("n_id = 0").count() == 0


def test_heads_take_labelled_values(spark):
    keys = ["AKIA" + hashlib.sha1(str(i).encode()).hexdigest().upper()[:16] for i in range(14)]
    long = "".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(125))
    texts = [f"a secret={k} here" for k in keys[:10]] + [f"rare={keys[10]} x", f'a "{keys[11]}" x', f"the key is {keys[12]}.", f"x={keys[13]} y", f"a --{'very-' * 20}api-key: {long} b", f"token={long} b", f"see file{keys[0]}.txt and {keys[0]}@x"]
    texts += [f"a {'_'.join(['deep'] * 12)}_token={k} b" for k in keys[:3]]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = lambda i, value: f"id:{texts[i].index(value)}:{texts[i].index(value) + len(value)}"
    assert len(long) == 5000
    assert [got[i] for i in range(14)] == [*[at(i, keys[i]) for i in range(10)], *[at(k, keys[k]) for k in range(10, 14)]]
    assert [got[i] for i in range(15, 20)] == [at(15, long), "", *[at(17 + i, keys[i]) for i in range(3)]]


def test_hashes_of_commits_stay(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    rows = [(i, f"fixed in commit {h} of main") for i, h in enumerate(hexes[:20])] + [(100 + i, f"commit: {h}") for i, h in enumerate(hexes[:20])] + [(200 + i, f'token = "{h}"') for i, h in enumerate(hexes[20:30])]
    # A value known by its label teaches the word left of it.
    rows += [(300 + i, f"unlock with {h} then") for i, h in enumerate(hexes[20:28])] + [(400, f"unlock with {hexes[39]} then")]
    got = {r.doc_id: (r.spans, r.n_found) for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ("", 0) for i in (*range(20), *range(100, 120)))
    assert all(got[200 + i] == ("id:9:49", 1) for i in range(10)) and all(got[300 + i] == ("id:12:52", 1) for i in range(8)) and got[400] == ("id:12:52", 1)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdef123", "x", 1), (1, "token=abcdef124", "y", 2), (2, "password=abcdef123", None, 3)] * 2, "doc_id long, text string, good string, base int")
    got = sorted((r.doc_id, r.spans) for r in pii.report(df).collect())
    assert len(got) == 6 and pii.report(df).columns[0] == "doc_id"
