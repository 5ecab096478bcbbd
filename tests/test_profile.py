from tabveil.functions import headers
from tabveil.operators import profile


def profiled(spark, header, values):
    return profile.profiled(spark.createDataFrame([(v,) for v in values], "c string"), [header])[0]


def test_bare_tax_numbers_need_their_header(spark):
    bsn_like = [f"{123456780 + i}" for i in range(20)]
    assert profiled(spark, "ssn", bsn_like).kind == "taxId"
    assert profiled(spark, "amount", bsn_like).kind != "taxId"
    assert (headers.tax_context("Social Security Number"), headers.tax_context("EIN"), headers.tax_context("tax id")) == ("ssn", "ein", None)


def test_dutch_btw_header(spark):
    values = [f"{100000000 + i}B01" for i in range(12)]
    assert headers.dutch_btw_context("btw-nummer") and not headers.dutch_btw_context("vat")


def test_header_signal_counts_only_fitting_values(spark):
    p = profiled(spark, "password", ["correcthorse1", "x", "1234567890", "", "s3cretvalue"])
    assert ("credentialOrSecret", "header:secret", 2) in p.evidence and p.risk == "high"
    assert not profiled(spark, "password", ["1", "2", "3"]).evidence


def test_phone_header_takes_plain_digits_of_a_plan(spark):
    digits = [f"06{10000000 + i * 37}" for i in range(12)]
    assert profiled(spark, "phone number", digits).kind == "phone"
    assert profiled(spark, "phone number", ["not a phone at all"] * 12).kind != "phone"


def test_country_of_national_numbers(spark):
    bsn = [f"{n:09d}" for n in range(111222300, 111222900) if sum(int(d) * w for d, w in zip(f"{n:09d}", (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0]
    assert profiled(spark, "nummer", bsn).detector.endswith(":NL")


def test_first_values(spark):
    rows = [(i, None if i < 3 else f"v{i}", "" if i % 2 else "null") for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = sorted((r.col, r.place, r.value) for r in profile.first_values(df, "i", ["a", "b"]).collect())
    assert got == [("a", k + 1, f"v{k + 3}") for k in range(5)]
