import pytest
from pyspark.sql import functions as F

from tabveil.functions import checks, headers
from tabveil.functions import values as V


def applied(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("f", "yes", "no"),
    [
        (V.is_email, ["a@b.co", " x.y+z@mail.example.com "], ["a@b", "a b@c.de", "@c.de", "a@-b.de"]),
        (V.is_url, ["http://a.b/c?d", "www.example.com"], ["ftp://a.b", "http:// a", "a.b"]),
        (V.has_separator_phone, ["+31 20 123 4567", "(555) 555-2485"], ["5555552485", "1234-555-0000", "12 34"]),
        (V.is_us_tax_id, ["123-45-6789", "12-3456789"], ["000-45-6789", "123456789", "07-1234567"]),
        (V.is_iban, ["NL91 ABNA 0417 1643 00", "GB82WEST12345698765432"], ["NL92ABNA0417164300", "NL91"]),
        (V.is_card, ["4111 1111 1111 1111", "378282246310005"], ["4111 1111 1111 1112", "1234567890123456"]),
        (V.is_full_name, ["Grace Hopper", "Anne-Marie O'Brien"], ["Acme Corporation", "Grace", "a1 b2"]),
        (V.is_address, ["12 Main Street", "Kerkstraat 5"], ["Main Street", "12345"]),
        (V.is_key_token, ["CUST-0042", "a1b"], ["ACTIVE", "1234", "a1"]),
    ],
)
def test_recognisers(spark, f, yes, no):
    assert applied(spark, f, yes) == [True] * len(yes)
    assert applied(spark, f, no) == [False] * len(no)


def test_formulas(spark):
    given = ["=cmd", "  +SUM(1 1)", "\tTabbed", "＝cmd", "-42.50", "+31", " -7 ", "-2+3", "-1.2.3", "plain", ""]
    want = ["'=cmd", "'  +SUM(1 1)", "'\tTabbed", "'＝cmd", "-42.50", "+31", " -7 ", "'-2+3", "'-1.2.3", "plain", ""]
    assert applied(spark, V.neutralized, given) == want


def test_identity_and_mask(spark):
    assert applied(spark, V.identity_key, ["  A\t B　C "]) == ["a b c"]
    assert applied(spark, V.mask, ["a b　ç"]) == ["* *　*"]


def test_postal(spark):
    assert applied(spark, lambda v: V.postal_country(v, ["DE"]), ["1234 AB", "12-345", "12345", "SW1A 1AA"]) == ["NL", "PL", "DE", "GB"]
    assert applied(spark, V.postal_country, ["12345"]) == [None]


VALID = {"NL": "111222333", "BE": "85073003328", "PL": "44051401359", "IT": "RSSMRA85T10A562S", "ES": "12345678Z", "FR": "255081416802538", "FI": "131052-308T", "SE": "811218-9876", "BR": "11144477735", "DE": "86095742719"}
NEAR = {"NL": "111222334", "BE": "85073003329", "PL": "44051401358", "IT": "RSSMRA85T10A562T", "ES": "12345678A", "FR": "255081416802539", "FI": "131052-308U", "SE": "811218-9875", "BR": "11144477736", "DE": "86095742718"}


@pytest.mark.parametrize("country", VALID)
def test_national_ids(country):
    assert country in checks.national_id_countries(VALID[country])
    assert country not in checks.national_id_countries(NEAR[country])


def test_numbers():
    assert checks.national_id_countries("111.444.777-35") == ["BR"]
    assert checks.vat("DE136695976") and not checks.vat("DE136695978")
    assert checks.vat("NL 0045.47.298.B01".replace("NL 0", "NL0")) or checks.vat("NL004495445B01")
    assert checks.dutch_btw("123456789B01") and not checks.dutch_btw("123456789B00")
    assert checks.iban("DE89370400440532013000") and not checks.iban("DE8937040044053201300")


@pytest.mark.parametrize(
    ("header", "kind"),
    [("telefoonnummer", "phone"), ("phoneNumber", "phone"), ("homephone", "phone"), ("telefoonnumer", "phone"), ("street_adress", "address"), ("btw_nummer", "tax_id"), ("dateOfBirth", "private_date"), ("geburtsdatum", "private_date"), ("voornaam", "first_name"), ("customer name", "full_name"), ("order_id", "numeric_id"), ("device_access_token", "secret"), ("apikey", "secret"), ("username", "account_identifier"), ("zip_code", "postal_code")],
)
def test_headers(header, kind):
    assert kind in headers.matched(header)


@pytest.mark.parametrize(("header", "kind"), [("headphone", "phone"), ("candidateOfBirth", "private_date"), ("code", "postal_code"), ("nr", "numeric_id"), ("id", "numeric_id")])
def test_headers_that_only_look_alike(header, kind):
    assert kind not in headers.matched(header)


def test_jaro_winkler():
    assert headers.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert headers.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-4)


def test_blake3():
    from tabveil.functions import blake3

    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    data = bytes(i % 251 for i in range(5121))
    assert blake3.digest(data[:1]).hex().startswith("2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213")
    assert blake3.digest(data[:1024]).hex().startswith("42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7")
    assert blake3.digest(data[:1025]).hex().startswith("d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444")
    assert blake3.digest(b"x", b"k" * 32) != blake3.digest(b"x")


def test_keyed_tokens(spark):
    from tabveil.functions import blake3

    f = blake3.token_udf("ab" * 32, "name", 1)
    a, b, c = applied(spark, f, [" Ann  Lee", "ann lee", "Bo"])
    assert a == b != c and len(a) == 28 and a.startswith("tok_")
    assert applied(spark, blake3.token_udf("ab" * 32, "name", 2), ["Bo"]) != [c]


def test_fingerprint(spark, tmp_path):
    from tabveil.sources import fingerprint

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.csv").write_text("1")
    one = fingerprint.files(spark, str(tmp_path / "a"))
    (tmp_path / "a/x.csv").write_text("2")
    assert one != fingerprint.files(spark, str(tmp_path / "a")) and fingerprint.fnv1a(b"a") == 0xAF63DC4C8601EC8C
