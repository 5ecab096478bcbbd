"""Phone numbers by the number plans of regions, as Column expressions.

The plans are our own short form of the public numbering plans: calling code, trunk prefix, and what national numbers
look like. A number with + is held against the plans of its calling code, one without against those of the regions
that a column's locale names and of `WORLD`. Null, empty values and values with letters (but for an extension, and for
vanity numbers behind a +) are no phone numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabveil.functions import values as V

_NANP = "(?![2-9]11)[2-9][0-9]{2}(?![2-9]11)[2-9][0-9]{6}"
#: region -> calling code, trunk prefix (pattern, may be left out), national numbers.
PLANS: dict[str, tuple[str, str, str]] = {
    "US": ("1", "1", _NANP),
    "CA": ("1", "1", _NANP),
    "GB": ("44", "0", "(?:1[0-9]{8,9}|2[0-9]{9}|3[0-9]{9}|7[0-9]{9}|8(?:0[08]|4[2-5]|7[0-3])[0-9]{7}|9[0-9]{9})"),
    "NL": ("31", "0", "(?:[1-5][0-9]{8}|6[1-5][0-9]{7}|7[0-9]{8}|8[4578][0-9]{7}|800[0-9]{4,7}|900[0-9]{4,7})"),
    "DE": ("49", "0", "(?:1(?:5[0-9]{9}|[67][0-9]{8,9})|[2-9][0-9]{6,10})"),
    "FR": ("33", "0", "[1-9][0-9]{8}"),
    "ES": ("34", "", "[5-9][0-9]{8}"),
    "PT": ("351", "", "(?:2[0-9]{8}|3[0-9]{8}|[6-9][0-9]{8})"),
    "IT": ("39", "", "(?:0[0-9]{5,10}|3[0-9]{8,9}|8[0-9]{5,9})"),
    "JP": ("81", "0", "(?:[1-9][0-9]{8}|[5789]0[0-9]{8})"),
    "BE": ("32", "0", "(?:4[5-9][0-9]{7}|[1-9][0-9]{7})"),
    "LU": ("352", "", "(?:6[2-9]1?[0-9]{6,7}|2[0-9]{5,9}|[3-9][0-9]{4,9})"),
    "IE": ("353", "0", "(?:8[356-9][0-9]{7}|1[0-9]{7}|[2-9][0-9]{6,8})"),
    "AT": ("43", "0", "(?:1[0-9]{3,11}|6[5-9][0-9]{6,11}|[2-7][0-9]{5,11})"),
    "CH": ("41", "0", "[2-9][0-9]{8}"),
    "DK": ("45", "", "[2-9][0-9]{7}"),
    "SE": ("46", "0", "(?:7[02369][0-9]{7}|[1-9][0-9]{6,8})"),
    "NO": ("47", "", "[2-9][0-9]{7}"),
    "FI": ("358", "0", "(?:4[0-9]{6,9}|50[0-9]{5,8}|[1-9][0-9]{5,10})"),
    "PL": ("48", "", "[1-9][0-9]{8}"),
    "CZ": ("420", "", "[2-9][0-9]{8}"),
    "SK": ("421", "0", "[2-9][0-9]{8}"),
    "HU": ("36", "06", "(?:[237]0[0-9]{7}|[1-9][0-9]{7})"),
    "RO": ("40", "0", "[237-9][0-9]{8}"),
    "BG": ("359", "0", "(?:[89][0-9]{7,8}|[2-7][0-9]{6,7})"),
    "GR": ("30", "", "(?:2[0-9]{9}|69[0-9]{8}|[589][0-9]{9})"),
    "TR": ("90", "0", "(?:[2-4][0-9]{9}|5[0-9]{9}|8[0-9]{9})"),
    "UA": ("380", "0", "[3-9][0-9]{8}"),
    "IN": ("91", "0", "(?:[6-9][0-9]{9}|[1-5][0-9]{9})"),
    "CN": ("86", "0", "(?:1[3-9][0-9]{9}|[2-9][0-9]{8,10}|10[0-9]{8})"),
    "KR": ("82", "0", "(?:2[0-9]{7,8}|1[0-9]{8,9}|[3-6][0-9]{7,9}|70[0-9]{8})"),
    "AU": ("61", "0", "(?:[2378][0-9]{8}|4[0-9]{8}|1[38]00[0-9]{6})"),
    "NZ": ("64", "0", "(?:[3-79][0-9]{7}|2[0-9]{7,9}|800[0-9]{6,7})"),
    "SG": ("65", "", "[3689][0-9]{7}"),
    "HK": ("852", "", "[2-9][0-9]{7}"),
    "ID": ("62", "0", "(?:8[1-9][0-9]{7,10}|[2-79][0-9]{6,10})"),
    "TH": ("66", "0", "(?:[689][0-9]{8}|[2-7][0-9]{7})"),
    "VN": ("84", "0", "(?:[35789][0-9]{8}|2[0-9]{9})"),
    "PH": ("63", "0", "(?:9[0-9]{9}|2[0-9]{7,8}|[3-8][0-9]{7,8})"),
    "MY": ("60", "0", "(?:1[0-9]{8,9}|3[0-9]{8}|[4-9][0-9]{7,8})"),
    "BR": ("55", "0", "(?:[1-9]{2}9[0-9]{8}|[1-9]{2}[2-5][0-9]{7}|800[0-9]{6,7})"),
    "AR": ("54", "0", "(?:9?(?:11|[23][0-9]{2,3})[0-9]{6,8})"),
    "CL": ("56", "", "[2-9][0-9]{8}"),
    "CO": ("57", "", "(?:3[0-9]{9}|60[0-9]{8})"),
    "MX": ("52", "01", "[2-9][0-9]{9}"),
    "PE": ("51", "0", "(?:9[0-9]{8}|1[0-9]{7}|[4-8][0-9]{7})"),
    "ZA": ("27", "0", "[1-8][0-9]{8}"),
    "NG": ("234", "0", "(?:[789][01][0-9]{8}|[1-9][0-9]{6,7})"),
    "EG": ("20", "0", "(?:1[0125][0-9]{8}|[2-9][0-9]{7,8})"),
    "KE": ("254", "0", "(?:[17][0-9]{8}|[2-6][0-9]{6,8})"),
    "IL": ("972", "0", "(?:5[0-9]{8}|7[0-9]{8}|[23489][0-9]{7})"),
    "SA": ("966", "0", "(?:5[0-9]{8}|1[1-7][0-9]{7})"),
    "AE": ("971", "0", "(?:5[024-8][0-9]{7}|[2-79][0-9]{7})"),
    "RU": ("7", "8", "[3489][0-9]{9}"),
}
WORLD = list(PLANS)
#: Regions that are tried only where a column's locale names them.
LOCAL: dict[str, tuple[str, str, str]] = {
    "EE": ("372", "", "[3-9][0-9]{6,7}"),
    "HR": ("385", "0", "[1-9][0-9]{7,8}"),
    "LT": ("370", "8", "[3-9][0-9]{7}"),
    "LV": ("371", "", "[2689][0-9]{7}"),
    "RS": ("381", "0", "[1-9][0-9]{7,8}"),
    "SI": ("386", "0", "[1-9][0-9]{7}"),
}
_EXTENSION = r"(?i)[\s,;.\-]*(?:extension|ext|x)\.?\s*[0-9]{1,6}\s*$"
_LETTERS, _KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999"


def without_extension(v: Column) -> Column:
    """The value without "ext. 45" or "x89" at its end."""
    return F.regexp_replace(v, _EXTENSION, "")


def can_be_swept(v: Column) -> Column:
    """Whether a value without + is worth holding against all regions: no letters but an extension's."""
    return ~without_extension(v).rlike("[A-Za-z]")


def has_code_like_lead(v: Column) -> Column:
    """Exactly four digits before the first separator, and neither + in front nor a parenthesis: a code, not a number."""
    t = V.trimmed(v)
    return t.rlike(r"^[0-9]{4}[ .\-]") & ~F.contains(t, F.lit("("))


def _any(patterns: list[str]) -> str:
    return "^(?:" + "|".join(dict.fromkeys(patterns)) + ")$"


def is_valid(v: Column, context: list[str] | None = None) -> Column:
    """Whether the value is a number of some plan. context: country codes of the column's locale."""
    plans = PLANS | {c: LOCAL[c] for c in context or [] if c in LOCAL}
    everywhere = _any([f"{code}(?:{trunk})?{n}" if trunk == "0" else f"{code}{n}" for code, trunk, n in (PLANS | LOCAL).values()])
    national = _any([f"(?:{trunk})?{n}" if trunk == "1" else f"{trunk}{n}" for _, trunk, n in plans.values()])
    t = without_extension(V.trimmed(v))
    typed = F.regexp_replace(F.translate(F.upper(t), _LETTERS, _KEYS), "[^0-9]", "")
    plain = t.rlike(r"^\+?[0-9A-Za-z ().\-/]+$")
    return F.coalesce(plain & F.when(t.startswith("+"), typed.rlike(everywhere)).otherwise(can_be_swept(v) & V.digits(t).rlike(national)), F.lit(False))


def shaped(v: Column, least: int = 10, slash: bool = False) -> Column:
    """Digits, one + in front at most and separators; `least` to 15 digits; a + or a separator at all."""
    t, extra = V.trimmed(v), "/" if slash else ""
    return t.rlike(rf"^\+?[0-9 ().\-{extra}]+$") & F.length(V.digits(t)).between(least, 15) & t.rlike(rf"^\+|[ ().\-{extra}]")


def is_phone(v: Column, context: list[str] | None = None) -> Column:
    """A phone number by its value alone: its shape, no code in front, and a plan that has it."""
    return F.coalesce(shaped(v) & ~has_code_like_lead(v) & is_valid(v, context), F.lit(False))


def regions(v: Column, context: list[str] | None = None) -> Column:
    """Codes of the regions whose plan has the value, the context's first, as an array."""
    t = without_extension(V.trimmed(v))
    d, plus = V.digits(t), t.startswith("+")
    order = dict.fromkeys([*[c for c in context or [] if c in PLANS or c in LOCAL], *WORLD])
    found = []
    for region in order:
        code, trunk, n = PLANS.get(region) or LOCAL[region]
        fits = F.when(plus, d.rlike(f"^{code}{n}$")).otherwise(can_be_swept(v) & d.rlike(f"^(?:{trunk})?{n}$" if trunk == "1" else f"^{trunk}{n}$"))
        found.append(F.when(shaped(v, 7, slash=True) & fits, F.lit(region)))
    return F.array_compact(F.array(*found))

