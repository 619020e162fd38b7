"""Components of a postal address written on one line."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Words of addresses and what they stand for.
STREET_TYPES = {
    "ave": "ave av avenue aven", "blvd": "blvd boul boulevard bd", "st": "st str street", "dr": "dr drv drive", "ln": "ln lane", "rd": "rd road",
    "pl": "pl place", "ct": "ct court crt", "sq": "sq square", "ter": "ter terr terrace", "hwy": "hwy highway", "pkwy": "pkwy pky parkway", "way": "way",
    "cir": "cir circle", "trl": "trl trail", "aly": "aly alley", "cres": "cres crescent", "expy": "expy expressway",
}
DIRECTIONS = {"n": "n no north", "s": "s so south", "e": "e east", "w": "w west", "ne": "ne northeast", "nw": "nw northwest", "se": "se southeast", "sw": "sw southwest"}
TOWN_WORDS = {"hts": "heights", "jct": "junction", "spgs": "springs", "ft": "fort", "mt": "mount", "st": "saint", "ste": "sainte", "n": "north", "s": "south", "e": "east", "w": "west", "pt": "port"}
UNITS = "suite ste unit apt apartment room rm fl floor"
BUILDINGS = "mall center centre plaza arcade tower building bldg"
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
TENTHS = {"thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70, "eightieth": 80, "ninetieth": 90}

_TYPE = {w: k for k, ws in STREET_TYPES.items() for w in ws.split()}
_DIRECTION = {w: k for k, ws in DIRECTIONS.items() for w in ws.split()}
_UNIT = re.compile(rf"\b(?:{'|'.join(UNITS.split())})\b\.?\s*#?\s*\d[\w-]*|#\s*\d+\w*(?!\w*-\d)")
_UNIT_NUMBER = re.compile(r"#\s*\w+\s*-\s*(\d+[a-z]?)\b")
_NUMBER_MARK = re.compile(r"\bno\.?\s*(\d+[a-z]?)\b")
_BUILDING = re.compile(rf"\b(?:{'|'.join(BUILDINGS.split())})$")
_ORDINAL = re.compile(r"(\d+)(?:st|nd|rd|th)$")
_LEADING = re.compile(r"(\d+[a-z]?)(?:\s+(.*))?$")
_TRAILING = re.compile(r"(.*[^\d\s].*?)\s+(\d+[a-z]?)$")
_POSTCODE = re.compile(r"(?:^|\s)(\d{5}(?:-?\d{4})?|\d{3} \d{2}|[a-z]\d[a-z][ -]?\d[a-z]\d)$")


@dataclass
class Address:
    number: str | None = None
    street: str | None = None
    kind: str | None = None
    direction: str | None = None
    town: str | None = None
    postcode: str | None = None


def plain(text: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _ordinal(word: str) -> str:
    if m := _ORDINAL.match(word):
        return f"{int(m[1])}th"
    if word in ORDINALS:
        return f"{ORDINALS.index(word) + 1}th"
    if word in TENTHS:
        return f"{TENTHS[word]}th"
    ten, _, one = word.partition("-")
    if ten in TENS and one in ORDINALS[:9]:
        return f"{TENS[ten] + ORDINALS.index(one) + 1}th"
    return word


def postcode_of(text: str | None) -> str | None:
    """Five digits, or six signs of letters and digits; else None."""
    if not text:
        return None
    sign = re.sub(r"[^a-z0-9]", "", plain(text))
    if re.fullmatch(r"\d{5}(\d{4})?", sign):
        return sign[:5]
    return sign if re.fullmatch(r"[a-z]\d[a-z]\d[a-z]\d", sign) else None


def town_of(text: str | None) -> str | None:
    """Letters of a town's name in full words, without a state code after a comma; None if nothing is left."""
    if not text:
        return None
    name = re.sub(r",\s*[a-z]{2}\s*$", "", plain(text).strip())
    words = [TOWN_WORDS.get(w, w) for w in re.sub(r"[^a-z0-9-]+", " ", name).split()]
    return re.sub(r"[^a-z0-9]", "", "".join(words)) or None


def _tail(parts: list[str]) -> tuple[str | None, str | None]:
    """(town, postcode) of what stands behind the street."""
    text, code = " ".join(parts).strip(), None
    if m := _POSTCODE.search(text):
        code, text = postcode_of(m[1]), text[: m.start()].strip()
    text = re.sub(r"\s+[a-z]{2}$", "", text) if not re.fullmatch(r"[a-z]{2}", text) else ""
    return town_of(text), code


def _street(text: str) -> tuple[str | None, str | None, str | None]:
    """(name, type, direction)."""
    words = [w for w in (re.sub(r"[^a-z0-9'-]", "", w) for w in text.split()) if w]
    kind = direction = None
    if len(words) > 1 and words[-1] in _DIRECTION:
        direction = _DIRECTION[words.pop()]
    if len(words) > 1 and words[-1] in _TYPE:
        kind = _TYPE[words.pop()]
    if len(words) > 1 and direction is None and words[0] in _DIRECTION:
        direction = _DIRECTION[words.pop(0)]
    if len(words) > 1:
        words[0] = {"st": "saint", "mt": "mount", "ft": "fort"}.get(words[0], words[0])
    return " ".join(map(_ordinal, words)) or None, kind, direction


def parse_address(address: str | None, city: str | None, postcode: str | None) -> Address:
    """Components; number and street are None where the address has none. Never raises."""
    out = Address(town=town_of(city), postcode=postcode_of(postcode))
    if not address or not address.strip(" ,.\t\n"):
        return out
    text = re.sub(r"\s+-\s+|[\t\n;]", ",", plain(address))
    if m := _UNIT_NUMBER.search(text):
        text = text[: m.start()] + " " + m[1] + " " + text[m.end() :]
    text = re.sub(r",(?=\s*,)", " ", _UNIT.sub(" , ", text))
    if m := _NUMBER_MARK.search(text):
        out.number = m[1]
        text = text[: m.start()] + " , " + text[m.end() :]
    parts = [p for p in (" ".join(p.split()).strip(" .") for p in text.split(",")) if p]
    parts = [p for i, p in enumerate(parts) if i == len(parts) - 1 or not _BUILDING.search(p)]
    at = None
    for i, p in enumerate(parts):
        words = p.split()
        if out.number is None and (m := _LEADING.match(p)) and not _ORDINAL.match(words[0]):
            out.number = m[1]
            if m[2]:
                at, parts[i] = i, m[2]
            elif i + 1 < len(parts):
                at = i + 1
            break
        trailing = out.number is None and _TRAILING.match(p) and not any(re.match(r"\d+[a-z]?\s+\S*[a-z]", q) for q in parts[i + 1 :])
        if trailing or any(w.strip(".") in _TYPE for w in words[1:]) or _ORDINAL.match(words[0]):
            at = i
            if out.number is None and (m := _TRAILING.match(p)):
                parts[i], out.number = m[1], m[2]
            break
    if at is None and out.number is not None and parts:
        at = 0
    if at is None:
        return out
    if out.number is None and (m := _TRAILING.match(parts[at])):
        parts[at], out.number = m[1], m[2]
    out.street, out.kind, out.direction = _street(parts[at])
    out.number = out.number and (out.number.lstrip("0") or "0")
    town, code = _tail(parts[at + 1 :])
    out.town, out.postcode = out.town or town, out.postcode or code
    return out
