import numpy as np
from pyspark.sql import functions as F

from tabveil.llm import ann


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)).round(3)
    x[200:700] = 5 * x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [1.0, None] + [0.0] * 10), (None, x[0].tolist()), (5004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, leaf=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        true = np.lexsort((np.arange(1500), -s))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s[v] - y) < 1e-12 for _, v, y in found)
        assert [(-y, v) for _, v, y in found] == sorted((-y, v) for _, v, y in found)
        hits += len({v for _, v, _ in found} & set(true.tolist()))
    assert hits / (20 * len(got)) > 0.9
    assert [v for _, v, _ in got[240]] == [v for v in range(200, 221) if v != 240][:20]


def test_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 1, 1.5), (20, 2, 0, 1.0)]
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_are_exact(spark):
    rng = np.random.default_rng(11)
    x = rng.choice([-1.0, 1.0], size=(400, 12))
    rows = [(int(i), v.tolist(), int(i)) for i, v in zip(rng.permutation(400), x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id long")
    by = {i: np.array(v) for i, v, _ in rows}
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, visits=10_000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 20
    for q, found in got.items():
        want = sorted((-float(by[i] @ by[q]), i) for i in by if i != q)[:20]
        assert [(-s, v) for _, v, s in sorted(found)] == want


def test_trees_deepen_with_the_table(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0, leaf=64, sample=600, block=50).collect():
        s = x @ x[r.query_id]
        s[r.query_id] = -np.inf
        hits += s[r.vec_id] >= np.sort(s)[-20] - 1e-12
    assert hits / (20 * 30) > 0.9
