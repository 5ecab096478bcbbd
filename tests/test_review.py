import pytest

from tabveil.operators import spans
from tabveil.plans import review, service
from tabveil.sources import documents


def plan(i=0, name="a", kind="email", how="pseudonymize", selected=True, risk="high", **more):
    return service.ColumnPlan(name, i, kind, risk, how, selected, **more)


def test_unique_share():
    assert [review.unique_share(*x) for x in ((0, 10), (1, 10_000), (1, 8), (0, 0), (5, 10_000))] == ["0.0%", "under 0.1%", "12.5%", "0.0%", "0.1%"]


def test_warnings():
    plans = [plan(), plan(1, "n", "numericValue", "redact"), plan(2, "m", "string", "mask"), plan(3, "r", "string", "redact"), plan(4, "p", "enum"), plan(5, "who", "string", "auto", False, evidence=[("person", review.POSSIBLE_NAMES, 3)])]
    got = review.warnings(plans, {"a": "fewDistinctValues"}, {"n": "json/k:n", "r": "json/k:r"})
    assert [i for i, _, _ in got] == [0, 0, 1, 2, 4, 5]
    assert not review.changes_scalar_type(plans[1], "xml/e:n") and review.changes_scalar_type(plans[1], "yaml")


def test_plugin_evidence():
    r = review.Replacements(10, 8, 2, {"emptyOutput": 2})
    rows = review.plugin_evidence(r, {"id": 7, "x": 0})
    assert [(x["id"], x["status"]) for x in rows] == [("local-ai-validation", "review"), ("keyed-tokenization", "info")]
    assert "2 emptyOutput" in rows[0]["detail"] and "7 distinct values of id " in rows[1]["detail"]
    assert review.plugin_evidence(review.Replacements(1, 1))[0]["status"] == "verified" and not review.plugin_evidence()


def test_detection_summary():
    assert review.detection_summary("disabled")["eligible"] == 0
    done = review.detection_summary("completed", "m", "1", 5, accepted=2, rejections={"overlap": 3})
    assert (done["eligible"], done["rejected"], done["reasons"]) == (5, 3, ["candidateRejected"])
    part = review.detection_summary("incomplete", "m", examined=5, total=9, oversized=4)
    assert part["eligible"] == 9 and "5 of 9" in part["message"]
    assert review.detection_summary("failed", "m", message="no")["reasons"] == ["detectorFailed"]


def test_structure():
    c = review.Confirmed("1", 0, 3, 0, 3, "person", "Ann x", "Ann", "local:m")
    ran = review.detection_summary("completed", "m")
    found = {(0, 3, 0, 3, "person", "Ann", "local:m")}
    review.checked_structure([plan()], [c], found, ran)
    for columns, spans_, findings, summary in (
        ([plan(1)], [], set(), ran),
        ([plan()], [c], set(), ran),
        ([plan()], [c, c], found, ran),
        ([plan()], [c], found, review.detection_summary("disabled")),
        ([plan()], [review.Confirmed("1", 0, 3, 0, 9, "person", "Ann x", "Ann", "local:m")], found, ran),
        ([plan()], [c, review.Confirmed("2", 0, 3, 2, 5, "person", "Ann x", "n x", "local:m")], found | {(0, 3, 2, 5, "person", "n x", "local:m")}, ran),
    ):
        with pytest.raises(ValueError):
            review.checked_structure(columns, spans_, findings, summary)


def test_type_override_looks_at_samples():
    p = plan(kind="string", risk="low", sample=["mail bob@example.org now", "x"])
    q = service.controlled([p], [0], {0: {"type": "enum"}})[0]
    assert q.risk == "high" and ("contact", "validator:email", 1) in q.evidence
    assert service.controlled([p], [0], {0: {"strategy": "mask"}})[0].risk == "low"


def test_defaults_after_spans():
    p = plan(kind="string", how="auto", selected=False, risk="low")
    q = service.defaults_after_spans([p], {"a": [("contact", "validator:email", 1)]})[0]
    assert (q.strategy, q.selected, q.risk) == ("redact", True, "high")
    assert service.defaults_after_spans([p], {})[0] == p


def test_promotion(spark):
    df = spark.createDataFrame([("contact", "low", 55, "a", 1), ("contact", "high", 90, "b", 2), ("url", "medium", 78, "c", 1)], "kind string, confidence string, score int, detector string, r int")
    got = {r.detector: (r.confidence, r.score) for r in spans.promoted(df, "contact", "medium", 60).collect()}
    assert got == {"a": ("medium", 60), "b": ("high", 90), "c": ("medium", 78)}
    assert {r.detector for r in spans.promoted(df, "contact", "high", 95, "h", df.r == 1).collect()} == {"h", "b", "c"}


def test_row_counts(spark):
    assert [documents.row_count(v) for v in ([1, 2], {}, None, "x", 0)] == [2, 1, 0, 1, 1]
    df = spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (2, "p")], "k int, path string")
    assert {r.k: r.rows for r in documents.row_counts(df, "k").collect()} == {1: 2, 2: 1}


def test_snapshot_round_trip():
    plans = [plan(evidence=[("contact", "validator:email", 3)], sample=["a@b.co"])]
    assert service.restored(service.snapshot(plans, "f"), "f") == plans
    with pytest.raises(ValueError):
        service.restored(service.snapshot([plan(1)], "f"), "f")


def test_samples_in_plans(spark):
    df = spark.createDataFrame([(i, f"u{i}@x.org") for i in range(9)], "row_idx long, mail string")
    p = service.planned(df, order="row_idx")[0]
    assert p.sample == [f"u{i}@x.org" for i in range(5)] and p.kind == "email"
