"""What a column's header says: terms by kind, matched whole, by tokens, at the end, or nearly."""

from __future__ import annotations

import functools
import re
import unicodedata

#: Our own dictionary: kind -> (weight, terms).
TERMS: dict[str, tuple[int, list[str]]] = {
    "phone": (95, "phone|phone number|telephone|mobile|mobile number|cell|fax|telefoon|telefoonnummer|teléfono|telefonnummer|telefone|telemóvel|電話番号|home phone|work phone|téléphone|telefono".split("|")),
    "postal_code": (94, "zip|zip code|postal code|postcode|codigo postal|codice postale|code postal|plz|postleitzahl|cep|郵便番号".split("|")),
    "address": (92, "address|street|street address|home address|adresse|dirección|adres|endereço|indirizzo|住所|straat|strasse".split("|")),
    "tax_id": (96, "tax id|tax number|vat|vat number|vat id|btw nummer|ssn|social security number|ein|tin|nif|steuernummer|partita iva|codice fiscale".split("|")),
    "first_name": (93, "first name|given name|forename|voornaam|vorname|prénom|nombre|nome próprio".split("|")),
    "last_name": (93, "last name|surname|family name|achternaam|nachname|nom de famille|apellido|apellidos|sobrenome|cognome".split("|")),
    "full_name": (92, "full name|contact name|customer name|client name|legal name|nom complet|nome completo|nome e cognome|nombre completo|volledige naam".split("|")),
    "generic_name": (75, "name|naam|nom|nome".split("|")),
    "numeric_id": (90, "person id|record id|order id|customer id|user id|account id|invoice id|ticket id|employee id".split("|")),
    "opaque_identifier": (85, "entity id|location id|reference|ref|external id|customer code|key|identifier".split("|")),
    "account_number": (96, "account number|rekeningnummer|kontonummer|iban|bank account|card number".split("|")),
    "secret": (98, "secret|password|passwd|api key|apikey|access token|auth token|private key|secret key|client secret".split("|")),
    "device_identifier": (90, "device id|hardware id|serial number|imei|mac address|device identifier".split("|")),
    "private_date": (92, "date of birth|dob|birth date|birthday|geboortedatum|geburtsdatum|fecha nacimiento|fecha de nacimiento|data nascimento|data de nascimento|data di nascita|date de naissance|生年月日".split("|")),
    "user_event_date": (80, "last login at|last login|signup date|registered at|last seen".split("|")),
    "account_identifier": (82, "username|user name|login|handle|screen name".split("|")),
}
#: Kinds whose terms count only as the whole header.
WHOLE = {"generic_name", "opaque_identifier"}
DATES = {"private_date", "user_event_date"}


def fold(text: str) -> str:
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def tokens(header: str) -> list[str]:
    """Words of a header: at signs and spaces, and where camel case turns."""
    apart = re.sub(r"(?<=[^\W\d_a-z])(?=[^\W\d_][a-z])|(?<=[a-z])(?=[A-Z])|(?<=\d)(?=[A-Z])", " ", header)
    return [t for t in re.split(r"[\W_]+", fold(apart)) if t]


def compact(header: str) -> str:
    return "".join(c for c in fold(header) if c.isalnum())


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, from_a = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                from_a.append(c)
                break
    if not from_a:
        return 0.0
    m, from_b = len(from_a), [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(from_a, from_b, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def _matches(header: str, kind: str, weight: int, term: str) -> int:
    """The score of a match, 0 for none."""
    own, whole, t, c = tokens(header), compact(header), tokens(term), compact(term)
    if whole == c:
        return weight
    if kind in WHOLE:
        return 0
    if t and all(x in own for x in t):
        return weight
    if len(c) >= 5 and any("".join(own[k:]) == c for k in range(len(own))):
        return weight
    if weight < 88 or kind in DATES or not c.isascii() or len(c) < 5:
        return 0
    near = all(any(len(x) >= 5 and len(y) >= 5 and x[0] == y[0] and x[-1] == y[-1] and jaro_winkler(x, y) >= 0.92 for y in own) or x in own for x in t)
    close = len(c) >= 8 and abs(len(whole) - len(c)) <= 3 and whole[:1] == c[0] and whole[-1:] == c[-1] and jaro_winkler(whole, c) >= 0.93
    return max(70, weight - 12) if near or close else 0


@functools.lru_cache(4096)
def scores(header: str) -> dict[str, int]:
    """kind -> best score."""
    found = {kind: max(_matches(header, kind, w, t) for t in terms) for kind, (w, terms) in TERMS.items()}
    return {k: s for k, s in found.items() if s}


def matched(header: str) -> set[str]:
    return set(scores(header))


def best(header: str, kinds: list[str]) -> str | None:
    found = {k: s for k, s in scores(header).items() if k in kinds}
    return max(found, key=lambda k: (found[k], -kinds.index(k))) if found else None


def tax_context(header: str) -> str | None:
    """ssn, ein, or null: which US number nine bare digits under this header are."""
    return {"ssn": "ssn", "socialsecuritynumber": "ssn", "ein": "ein", "employeridentificationnumber": "ein"}.get(compact(header))


def dutch_btw_context(header: str) -> bool:
    c = compact(header)
    return c in {"btw", "btwnr", "btwid", "btwidentificatienummer"} or c.endswith(("btwnummer", "omzetbelastingnummer"))
