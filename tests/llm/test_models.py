import random

import numpy as np

from tabveil.llm import quality, toxicity

WORDS = "river stone cloud paper window garden silver morning".split()


def corpus(spark, spoil, n=400, seed=5):
    r = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        w = [r.choice(WORDS) + r.choice(["", "s", "ing"]) for _ in range(r.randint(5, 60))]
        bad = d % 4 == 0
        labels.append((d, int(bad)))
        rows.append((d, " ".join(spoil(r, w) if bad else w)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity(spark, odd, none):
    docs, labels, y = corpus(spark, lambda r, w: w[:3] + [r.choice(["nastyword", "vileterm"])] * 2 + w[3:])
    lexicon = toxicity.fit(docs, labels)
    learned = {t.strip() for t in lexicon.terms} - {toxicity.fold(w).strip() for w in toxicity.SEEDS}
    assert learned == {toxicity.fold("nastyword").strip(), toxicity.fold("vileterm").strip()}
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    assert all(r.predicted == y[d] and 0 <= r.score <= 1 for d, r in got.items())
    assert {r.held_out for r in got.values()} == {True, False}
    hidden = spark.createDataFrame([(1, "river n4styw0rd stone nаstywоrd"), (2, "river stone")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(hidden, lexicon).orderBy("doc_id").collect()] == [1, 0]
    assert {r.doc_id for r in toxicity.rejected(docs, lexicon).collect()} == {d for d, v in y.items() if not v}
    assert toxicity.score(odd, lexicon).count() == 8 and toxicity.score(none, lexicon).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).where("predicted = 1").count() == 0


def test_exceptions_and_fold():
    lexicon = toxicity.Lexicon({" scrap ": 3.0}, [toxicity.fold("scrap metal")])
    a = lexicon.automaton()
    assert len(toxicity.matches(toxicity.fold("SCRAP!"), a)) == 1 and not toxicity.matches(toxicity.fold("scrap metal"), a)
    assert toxicity.fold("Ｉd1öt") == toxicity.fold("idiot") and toxicity.fold("a$$") != toxicity.fold("a")


def test_exceptions_of_the_query(spark):
    docs, labels, y = corpus(spark, lambda r, w: w[:3] + [r.choice(["nastyword", "vileterm", "xq"])] * 2 + w[3:])
    lexicon = toxicity.fit(docs, labels)
    assert toxicity.fold("xq") in lexicon.terms  # short words are learned too
    rows = spark.createDataFrame([(1, "river stone put it in the trash can by the window"), (2, "river stone you are trash"), (3, "garbage collector and garbage"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.n_matches for r in toxicity.score(rows, lexicon).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_scores_by_hand(spark):
    import math

    lexicon = toxicity.Lexicon({" bad ": 2.0, " aw": 1.5, " awfui ": 3.0}, [" not bad "], (-4.0, 1.2, 0.8))
    texts = ["bad day", "an awful, awful 8ad day", "not bad at all", "awkward " * 40, "", None]
    total, words = [2.0, 8.0, 0.0, 60.0, 0.0, 0.0], [2, 5, 4, 40, 0, 0]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()}
    for i in range(6):
        z = -4 + 1.2 * math.log1p(100 * total[i] / max(words[i], 1)) + 0.8 * math.log1p(total[i])
        assert got[i].total == total[i] and got[i].n_words == words[i] and abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9


def test_many_grades(spark):
    docs = spark.createDataFrame([(i, f"grade {'x' * (i % 30)} " * (1 + i % 30)) for i in range(600)], "doc_id long, text string")
    model = quality.fit(docs, docs.selectExpr("doc_id", "doc_id % 30 AS quality"))
    assert model.grades == [float(g) for g in range(30)] and (np.diff(model.thresholds) > 0).all()


def test_quality_by_hand(spark):
    model = quality.Grades([1.0, 2.0, 5.0], np.array([-0.5, 1.0]), np.random.default_rng(2).normal(size=1 << 12).astype(np.float32))
    texts = ["some words of a text, some words", "ab", "", "x y " * 500]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        at, value = quality.features(t.encode(), 1 << 12)
        x = float(value @ model.weights[at])
        low, mid = (1 / (1 + np.exp(-(k - x))) for k in model.thresholds)
        assert abs(got[i].expected_grade - (low * 1 + (mid - low) * 2 + (1 - mid) * 5)) < 1e-6 and abs(got[i].tail - (1 - mid)) < 1e-6


def test_quality(spark, odd, none):
    docs, labels, y = corpus(spark, lambda r, w: [x.upper() + "!!" for x in w])
    model = quality.fit(docs, labels.withColumnRenamed("toxic", "quality"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(r.kept == bool(y[d]) for d, r in got.items()) >= 395
    assert quality.score(odd, model).count() == 8 and quality.score(none, model).count() == 0
    assert quality.score(odd, quality.fit(odd, labels.limit(0).withColumnRenamed("toxic", "quality"))).count() == 8


def test_ordinal_recovers_ordered_thresholds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=3000)
    latent = 2 * x + rng.logistic(size=3000)
    y = np.searchsorted([-2.0, 0.0, 1.5], latent)
    w, theta = quality.ordinal(np.arange(3001), np.zeros(3000, np.int64), x, y, np.full(3000, 1 / 3000), 4, 1, rounds=600, rate=0.1)
    assert abs(w[0] - 2) < 0.25 and np.allclose(theta, [-2, 0, 1.5], atol=0.25) and (np.diff(theta) > 0).all()
