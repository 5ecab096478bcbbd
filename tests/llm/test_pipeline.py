import corpus_pipeline
from tabveil.llm import decontaminate, neardup

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() <= before.count()
        before = after
    assert neardup.clusters(before).where("not kept").count() <= 1
    assert decontaminate.report(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of some words", i, "k", 1) for i in range(5)], "doc_id long, text string, n_lines long, hit_words string, _key int")
    for k in (1, 3):
        out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_long_lines_of_two_documents(spark):
    shared = " ".join(f"common{'abcdefghijklmnop'[i % 16] * (1 + i // 16)}" for i in range(60))
    own = lambda d: "\n".join(" ".join(f"{d}{'abcdefghijklmnop'[i % 16] * (1 + i // 16)}" for i in range(k, k + 40)) for k in (0, 40, 80))
    rows = [(1, own("x") + "\n" + shared + "\nThe end"), (2, shared + "\n" + own("y") + "\nThe end"), (3, own("z") + "\nprices " + "1 " * 20), (4, own("w") + "\nprices " + "2 " * 20), (5, own("z") + "\nprices " + "1 " * 19 + "3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (1, 2):
        docs = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {1: rows[0][1], 2: own("y") + "\nThe end", 3: rows[2][1], 4: rows[3][1]}
