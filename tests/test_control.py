import pytest

from tabveil.plans import control


def test_budget(spark):
    df = spark.createDataFrame([(f"a{i}", f"b{i % 3}", "x") for i in range(30)], "a string, b string, c string")
    how = {"a": "pseudonymize", "b": "label", "c": "mask"}
    assert control.entries(df, how) == 93 and control.budget(df, how) == 93
    assert control.entries(df.limit(0), how) == 0 and control.entries(df, {"c": "redact"}) == 0
    with pytest.raises(control.MapBudgetError):
        control.budget(df, how, 92)
    assert control.ceiling() == 32_000_000 and control.ceiling(16_000) == 20


def test_jobs_states_and_one_writer(spark):
    jobs = control.Jobs(spark)
    with jobs.run("csv") as c:
        c.progress("scan", 0.5)
        assert jobs.get(c.job.id).state == "running" and jobs.get(c.job.id).share == 0.5
        with pytest.raises(RuntimeError), jobs.run("csv"):
            pass
        with jobs.run("preview", writes=False):
            pass
    assert jobs.get(c.job.id).state == "completed" and not jobs.cancel(c.job.id)
    with pytest.raises(ZeroDivisionError), jobs.run("csv") as c:
        1 / 0
    assert (jobs.get(c.job.id).state, jobs.get(c.job.id).message) == ("failed", "ZeroDivisionError")


def test_cancel(spark):
    jobs = control.Jobs(spark)
    with pytest.raises(control.Canceled), jobs.run("csv") as c:
        assert jobs.cancel(c.job.id) and c.canceled()
        c.progress("write", 0.9)
    assert jobs.get(c.job.id).state == "canceled"
    assert spark.range(3).count() == 3


def test_jobs_are_forgotten():
    now = [0.0]
    jobs = control.Jobs(clock=lambda: now[0])
    for _ in range(25):
        with jobs.run("x"):
            pass
    assert len(jobs.all()) == 20
    now[0] = 30 * 60 + 1
    assert not jobs.all()


def test_reports_are_throttled():
    now, told = [0.0], []
    jobs = control.Jobs(publish=lambda j: told.append((j.state, j.share)), clock=lambda: now[0])
    with jobs.run("x") as c:
        for k in range(10):
            now[0] += 0.03
            c.progress("scan", k / 10)
    assert 3 <= len(told) <= 5 and told[-1][0] == "completed"


def test_counted(spark):
    df, seen = control.counted(spark.range(7))
    df.collect()
    assert seen.get["rows"] == 7


def test_issued():
    issued = control.Issued(2)
    for s in ("a", "b", "c"):
        issued.register(s)
    issued.verify("c")
    with pytest.raises(ValueError):
        issued.verify("a")
