import pytest
from pyspark.sql import functions as F

from tabveil.functions import phones


def run(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.o for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_valid_by_plan(spark):
    good = ["+31 20 123 4567", "(212) 234-5678", "020 123 4567", "+44 20 7946 0958", "+1800FLOWERS", "030 1234567", "06 12345678", "020 1234567 ext 45", "(415) 234-0100 x89", "+49 (0)30 1234567"]
    assert run(spark, good, phones.is_valid) == [True] * len(good)
    bad = [None, "", "hello", "1800FLOWERS", "+999 123 4567 890", "(111) 111-1111", "12", "a b c 212 234 5678", "+1 111 111 1111"]
    assert run(spark, bad, phones.is_valid) == [False] * len(bad)


def test_by_value_alone(spark):
    cases = {"+31 20 123 4567": True, "212-234-5678": True, "2122345678": False, "2024-01-02 10 20": False, "1234 567 890": False, "(0201) 234567": True, "212-234-5678-9012-34": False, "++31 20 123 4567": False, None: False, "null": False}
    assert run(spark, list(cases), phones.is_phone) == list(cases.values())


def test_code_like_lead(spark):
    assert run(spark, ["2024-01-02", "(2024) 01", "+2024 01", "20240 1"], phones.has_code_like_lead) == [True, False, False, False]


def test_extension(spark):
    assert run(spark, ["020 1234567 ext 45", "020 1234567, extension. 9", "x89", "020 12"], phones.without_extension) == ["020 1234567", "020 1234567", "", "020 12"]


def test_locale_adds_regions(spark):
    got = run(spark, ["01 2345 678", "+385 1 2345 678"], lambda v: phones.regions(v, ["HR"]))
    assert got[0][0] == "HR" and "HR" in got[1]


@pytest.mark.parametrize("region", phones.WORLD)
def test_each_plan_has_a_code(region):
    code, trunk, pattern = phones.PLANS[region]
    assert code.isdigit() and (not trunk or trunk.isdigit()) and pattern
