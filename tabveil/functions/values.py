"""Whole-value recognisers and transforms as Column expressions; all run inside Spark's generated code.

Text rules: a value is empty if it is "" or "null" in any case; white space is Unicode white space; the identity
key of a value is trimmed, with inner white space collapsed to single spaces, in lower case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bodies of the value patterns.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TIMESTAMP = r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}(?:[T ]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?)?"
MAC = r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
US_TAX_ID = r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{2}-[0-9]{7})"
NUMERIC = r"[+-]?(?:\p{Nd}+|\p{Nd}+\.\p{Nd}+|\.\p{Nd}+)"
CURRENCY = r"\$\s?(?:\p{Nd}+|\p{Nd}{1,3}(?:,\p{Nd}{3})+)(?:\.\p{Nd}{2})?"
PERCENTAGE = r"[+-]?\p{Nd}+(?:\.\p{Nd}+)?%"

#: Postal formats in the order in which they are tried; the last element tells whether the country must be known.
POSTAL = (
    ("NL", r"[0-9]{4}\s?[A-Z]{2}", False), ("GB", r"[A-Z]{1,2}[0-9][A-Z0-9]?\s?[0-9][A-Z]{2}", False), ("CA", r"[A-Z][0-9][A-Z]\s?[0-9][A-Z][0-9]", False), ("PL", r"[0-9]{2}-[0-9]{3}", False),
    ("PT", r"[0-9]{4}-[0-9]{3}", False), ("BR", r"[0-9]{5}-[0-9]{3}", False), ("JP", r"[0-9]{3}-[0-9]{4}", True), ("US", r"[0-9]{5}(?:-[0-9]{4})?", True), ("DE", r"[0-9]{5}", True), ("FR", r"[0-9]{5}", True),
    ("IT", r"[0-9]{5}", True), ("ES", r"[0-9]{5}", True), ("SE", r"[0-9]{3}\s?[0-9]{2}", True), ("DK", r"[0-9]{4}", True), ("AT", r"[0-9]{4}", True), ("BE", r"[0-9]{4}", True),
)

#: The country codes that count as such.
COUNTRIES = (
    "AD AE AR AT AU BE BG BR CA CH CL CN CO CZ DE DK EE EG ES FI FR GB GR HK HR HU ID IE IL IN IT JP KE KR LT LU LV MX MY NG NL NO NZ PE PH PL PT RO RS RU SA SE SG SI SK TH TR UA US VN ZA"
).split()

#: Words of streets (whole tokens), and those that end a compound.
STREET_WORDS = (
    "st street ave avenue rd road blvd boulevard dr drive ln lane way court ct straat weg laan plein strasse straße platz allee rue calle avenida carrera rua travessa via viale piazza"
).split()
STREET_ENDS = ["straat", "weg", "laan", "plein", "strasse", "straße", "platz", "allee"]

#: Legal forms, then words for bodies and trades, none of which belongs to a person's name.
ORGANISATION_WORDS = (
    "aktiengesellschaft bvba company cooperative coop corp corporation gmbh inc kft limited llc llp ltd nonprofit oyj plc pty sarl spa sro "
    "academy agency airport authority bakery bank brewery charity church cinema city college commission court dental embassy factory farm foundation gallery garage government guild "
    "hospital hotel institute labs library ministry municipality museum orchestra parish pharmacy police province publisher restaurant school shop studio theatre trust union university warehouse workshop "
    "accounting banking catering cleaning consulting insurance landscaping logistics marketing plumbing recruiting roofing software"
).split()


def trimmed(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def identity_key(v: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(v), r"(?U)\s+", " "))


def is_empty(v: Column) -> Column:
    """Null counts as "", as a file has no nulls."""
    return F.coalesce((v == "") | (F.lower(v) == "null"), F.lit(True))


def mask(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\S", "*")


def whole(v: Column, body: str) -> Column:
    return v.rlike(f"^(?:{body})$") & ~v.endswith("\n")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def is_email(v: Column) -> Column:
    t = trimmed(v)
    local, domain = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
    return t.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])$") & (F.length(local) <= 64) & (F.length(domain) <= 254)


def is_url(v: Column) -> Column:
    return trimmed(v).rlike(r"^(?i:https?://|www\.)[^\s/?#<>\"^`{|}\\]+(?:[/?#][^\s]*)?$")


def has_separator_phone(v: Column) -> Column:
    """10 to 15 digits of the phone alphabet, with a plus or a separator, not a code of four digits in front."""
    t = trimmed(v)
    n = F.length(digits(t))
    return n.between(10, 15) & t.rlike(r"^\+?[0-9 ().\-]+$") & t.rlike(r"[+ ().\-]") & ~t.rlike(r"^[0-9]{4}[ .\-]")


def is_us_tax_id(v: Column) -> Column:
    ssn = v.rlike(r"^(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return ssn | v.rlike(r"^(?!0[07-9]|1[789]|2[89]|49|[67]9|[78]0|8[9]|9[67])[0-9]{2}-[0-9]{7}$")


def is_bare_us_tax_id(v: Column, kind: str | None = None) -> Column:
    """Nine digits that a header makes a US number: kind ssn, ein, or null for either."""
    ssn = r"(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}"
    ein = r"(?!0[07-9]|1[789]|2[89]|49|[67]9|[78]0|8[9]|9[67])[0-9]{9}"
    return whole(trimmed(v), {"ssn": ssn, "ein": ein}.get(kind or "", f"{ssn}|{ein}"))


def is_dutch_btw(v: Column) -> Column:
    """The Dutch turnover tax number without its country: nine digits, B, two digits that are not 00."""
    return F.upper(F.regexp_replace(v, "[^A-Za-z0-9]", "")).rlike("^[0-9]{9}B(?!00)[0-9]{2}$")


def fits_header_signal(v: Column, kind: str) -> Column:
    """Whether a value bears out what its header says: secrets have 8 bytes and a letter, accounts 4 digits or the form of an identifier, dates 4 bytes."""
    if kind == "credentialOrSecret":
        return (F.octet_length(v) >= 8) & v.rlike("[A-Za-z]")
    if kind == "accountOrFinancialId":
        return (F.length(digits(v)) >= 4) | is_account_identifier(v)
    if kind == "privateDate":
        return whole(v, TIMESTAMP) | (F.octet_length(v) >= 4)
    return F.lit(True)


def is_iban(v: Column) -> Column:
    """Two letters, two check digits, 11 to 30 more; the number that the rearranged letters make is 1 mod 97."""
    t = F.upper(F.regexp_replace(v, r"(?U)\s", ""))
    turned = F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))
    return F.when(t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(F.lit(False))


def is_card(v: Column) -> Column:
    """13 to 19 digits of a known brand, with their length, that pass Luhn."""
    d = digits(v)
    brand = d.rlike(r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12}|(?:5018|5020|5038|6304|6759|676[1-3])[0-9]{8,15})$")
    return trimmed(v).rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & brand & F.call_function("luhn_check", d)


def postal_country(v: Column, context: list[str] | None = None) -> Column:
    """The first country whose format the value has; formats that need context only if the country is in it."""
    known = context or []
    t = F.upper(trimmed(v))
    return F.coalesce(*[F.when(whole(t, body), F.lit(c)) for c, body, needs in POSTAL if not needs or c in known])


def is_country(v: Column) -> Column:
    return v.isin(COUNTRIES)


def is_address(v: Column) -> Column:
    t = F.lower(trimmed(v))
    tokens = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    shape = F.octet_length(trimmed(v)).between(5, 200) & v.rlike("[0-9]") & v.rlike(r"\p{L}")
    return shape & (has_street_word(v) | (v.rlike(r"[\p{L}&&[^\x00-\x7F]]") & F.contains(v, F.lit("-"))) | F.contains(v, F.lit(",")) | (F.length(F.regexp_replace(trimmed(v), r"(?U)\S", "")) >= 2)) & (F.size(tokens) > 0)


def has_street_word(v: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(v), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    ends = F.exists(tokens, lambda t: t.rlike(f"^.+(?:{'|'.join(STREET_ENDS)})$"))
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in STREET_WORDS])) | ends


def _name_tokens(v: Column) -> tuple[Column, Column]:
    tokens = F.split(trimmed(v), r"(?U)\s+")
    plain = F.forall(tokens, lambda t: t.rlike(r"^\p{L}[\p{L}'.\-]*$") & ~t.rlike(r"^\p{L}[\p{L}'-]*\.\p{L}{2,4}$"))
    words = F.regexp_extract_all(F.lower(v), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return tokens, plain & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in ORGANISATION_WORDS]))


def is_name_part(v: Column, most: int) -> Column:
    tokens, plain = _name_tokens(v)
    return F.octet_length(trimmed(v)).between(2, 80) & (F.size(tokens) <= most) & plain


def is_full_name(v: Column) -> Column:
    tokens, plain = _name_tokens(v)
    return F.octet_length(trimmed(v)).between(5, 120) & F.size(tokens).between(2, 6) & plain


def is_key_token(v: Column) -> Column:
    return trimmed(v).rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_/\-]{3,64}$")


def is_account_identifier(v: Column) -> Column:
    return trimmed(v).rlike(r"^(?=.*[A-Za-z])[A-Za-z0-9_.\-]{3,64}$")


def _phone(v: Column) -> Column:
    from tabveil.functions import phones

    return phones.is_phone(v)


#: type -> (predicate, evidence rank, specificity), in the order in which they are tried.
PRIORITY = {
    "email": (is_email, 3, 80),
    "uuid": (lambda v: whole(v, UUID), 2, 90),
    "timestamp": (lambda v: whole(v, TIMESTAMP), 1, 50),
    "phone": (_phone, 3, 70),
    "ipAddress": (lambda v: whole(v, IPV4), 2, 80),
    "macAddress": (lambda v: whole(v, MAC), 2, 90),
    "url": (is_url, 3, 80),
    "taxId": (is_us_tax_id, 3, 100),
    "boolean": (lambda v: F.lower(v).isin("true", "false", "yes", "no"), 1, 40),
    "currency": (lambda v: whole(v, CURRENCY), 1, 40),
    "percentage": (lambda v: whole(v, PERCENTAGE), 1, 40),
    "numericId": (lambda v: whole(v, r"\p{Nd}{4,}"), 1, 60),
    "countryCode": (lambda v: whole(v, "[A-Z]{2}"), 1, 40),
}


def is_numeric_value(v: Column) -> Column:
    return whole(v, NUMERIC)


def confidence(matched: Column, total: Column) -> Column:
    """8 of 10 High, 5 of 10 Medium, else Low; integers only, so that it agrees everywhere."""
    return F.when((total > 0) & (10 * matched >= 8 * total), "high").when((total > 0) & (2 * matched >= total), "medium").otherwise("low")


def could_be_formula(v: Column) -> Column:
    sign = trimmed(v).rlike(r"^[+-][0-9]*\.?[0-9]*$") & (F.length(trimmed(v)) > 1)
    return ~sign & v.rlike(r"(?U)^(?:[\t\r\n]|\s*[=+\-@＝＋－＠])")


def neutralized(v: Column) -> Column:
    return F.when(could_be_formula(v), F.concat(F.lit("'"), v)).otherwise(v)


def keyed_hash(seed: Column, *parts: Column) -> Column:
    """64 hex digits of SHA-256 over the seed and the parts."""
    return F.sha2(F.concat_ws("\u0001", seed, *parts).cast("binary"), 256)


def hash_number(h: Column, first: int = 1, n: int = 15) -> Column:
    """The number that n hex digits of a hash from place `first` make (n at most 15)."""
    return F.conv(F.substring(h, first, n), 16, 10).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
