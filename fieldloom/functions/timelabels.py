"""All valid readings of one time label, as instants in UTC."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone
from fractions import Fraction
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

NS = 1_000_000_000
EPOCH_DAY = date(1970, 1, 1).toordinal()

# Nanoseconds of the units in "<unit> since <reference>".
UNIT_NS = {
    "ns": 1, "nanosecond": 1, "nanoseconds": 1, "us": 1_000, "microsecond": 1_000, "microseconds": 1_000,
    "ms": 1_000_000, "msec": 1_000_000, "msecs": 1_000_000, "millisecond": 1_000_000, "milliseconds": 1_000_000,
    "s": NS, "sec": NS, "secs": NS, "second": NS, "seconds": NS, "min": 60 * NS, "mins": 60 * NS, "minute": 60 * NS, "minutes": 60 * NS,
    "h": 3600 * NS, "hr": 3600 * NS, "hrs": 3600 * NS, "hour": 3600 * NS, "hours": 3600 * NS,
    "d": 86400 * NS, "day": 86400 * NS, "days": 86400 * NS, "week": 604800 * NS, "weeks": 604800 * NS,
}
GREGORIAN = {"", "standard", "gregorian", "proleptic_gregorian"}
UTC_NAMES = {"z", "utc", "gmt", "ut"}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DAYS = "mon tue wed thu fri sat sun".split()

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_SINCE = re.compile(r"^\s*([A-Za-z]+)\s+since\s+(.+?)\s*$")
_REFERENCE = re.compile(r"^(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?)?\s*(Z|z|[A-Za-z]{2,5}|[+-]\d{1,2}(?::?\d{2})?)?$")
_ZONE = r"\s*(?P<zone>Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?"
_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
_CLOCK12 = r"(?P<h>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<a>[AaPp]\.?[Mm]\.?)"
_NAME = r"(?P<b>[A-Za-z]{3})[a-z]*\.?"
#: The written forms, tried when the encoding names none; a label may have several.
FORMS = [(name, re.compile(f"^{pattern}$")) for name, pattern in (
    ("iso", rf"(?P<Y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})[T ]{_CLOCK}{_ZONE}"),
    ("date", rf"(?P<Y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}}){_ZONE}"),
    ("basic", rf"(?P<Y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:T(?P<H>\d{{2}})(?P<M>\d{{2}})(?:(?P<S>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE})?"),
    ("ordinal", rf"(?P<Y>\d{{4}})-?(?P<j>\d{{3}})(?:T{_CLOCK}{_ZONE})?"),
    ("rfc", rf"(?:(?P<w>[A-Za-z]{{3}}),\s*)?(?P<d>\d{{1,2}})\s+{_NAME}\s+(?P<Y>\d{{4}})\s+{_CLOCK}{_ZONE}"),
    ("d-b-y", rf"(?P<d>\d{{1,2}})-{_NAME}-(?P<Y>\d{{4}})(?:\s+{_CLOCK}{_ZONE})?"),
    ("b-d-y", rf"{_NAME}\s+(?P<d>\d{{1,2}}),?\s+(?P<Y>\d{{4}})(?:,?\s+{_CLOCK12}{_ZONE})?"),
    ("b-d-y-24", rf"{_NAME}\s+(?P<d>\d{{1,2}}),?\s+(?P<Y>\d{{4}}),?\s+{_CLOCK}{_ZONE}"),
    ("d/m/y", rf"(?P<d>\d{{1,2}})[/.](?P<m>\d{{1,2}})[/.](?P<Y>\d{{4}})(?:\s+(?:{_CLOCK}){_ZONE})?"),
    ("m/d/y", rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<Y>\d{{4}})(?:\s+(?:{_CLOCK}){_ZONE})?"),
    ("d/m/y-12", rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<Y>\d{{4}})\s+{_CLOCK12}{_ZONE}"),
    ("m/d/y-12", rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<Y>\d{{4}})\s+{_CLOCK12}{_ZONE}"),
)]
_DIGITS = str.maketrans("123456789", "0" * 9)
_TOKENS = {"yyyy": r"(?P<Y>\d{4})", "MMM": r"(?P<b>[A-Za-z]{3})", "MM": r"(?P<m>\d{2})", "M": r"(?P<m>\d{1,2})", "dd": r"(?P<d>\d{2})", "d": r"(?P<d>\d{1,2})", "DDD": r"(?P<j>\d{3})",
           "HH": r"(?P<H>\d{2})", "H": r"(?P<H>\d{1,2})", "hh": r"(?P<h>\d{2})", "h": r"(?P<h>\d{1,2})", "mm": r"(?P<M>\d{2})", "ss": r"(?P<S>\d{2})", "SSS": r"(?P<f>\d{3})", "a": r"(?P<a>[AaPp][Mm])"}


@lru_cache(maxsize=4096)
def pattern_of(form: str) -> re.Pattern | None:
    """A regular expression for a letter pattern such as ``dd/MM/yyyy HH:mm``; None if it can't be read."""
    out = []
    for token in re.findall(r"([A-Za-z])(\1*)|('[^']*')|(.)", form):
        letters = token[0] + token[1]
        if letters:
            if letters not in _TOKENS:
                return None
            out.append(_TOKENS[letters])
        elif token[2]:
            out.append(re.escape(token[2][1:-1]))
        else:
            out.append(r"\s+" if token[3] == " " else re.escape(token[3]))
    try:
        return re.compile("^" + "".join(out) + _ZONE + "$")
    except re.error:
        return None


@lru_cache(maxsize=1024)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def abbreviations(zones: Iterable[str], first: int = 1970, last: int = 2037) -> dict[str, dict[str, list[int]]]:
    """abbreviation -> zone -> offsets in seconds, of the named zones between two years."""
    out: dict[str, dict[str, list[int]]] = {}
    for name in sorted(set(zones)):
        zone = zone_of(name)
        if zone is None or name not in available_timezones():
            continue
        at, end = datetime(first, 1, 1, tzinfo=timezone.utc), datetime(last, 12, 31, tzinfo=timezone.utc)
        while at < end:
            local = at.astimezone(zone)
            short, offset = local.tzname(), int(local.utcoffset().total_seconds())
            if short and short.isalpha() and short.lower() not in UTC_NAMES:
                offsets = out.setdefault(short.upper(), {}).setdefault(name, [])
                if offset not in offsets:
                    offsets.append(offset)
            at += timedelta(days=10)
    return out


def _times(number: str, unit: int) -> int:
    """A written number times a unit, exact and then rounded, halves to even."""
    whole, _, part = number.partition(".")
    if not (whole + part).lstrip("+-").isdigit():
        return round(Fraction(number) * unit)
    size = 10 ** len(part)
    n, rest = divmod(int(whole + part) * unit, size)
    return n + (2 * rest > size or (2 * rest == size and n % 2 == 1))


class Reader:
    """Reads labels; ``known`` is the result of :func:`abbreviations`."""

    def __init__(self, known: dict[str, dict[str, list[int]]]) -> None:
        self.known = known
        self.encodings: dict[str, dict | None] = {}
        self.counts: dict[tuple[str, str | None], tuple[list[int], int] | None] = {}
        self.shapes: dict[str, list[tuple[str, re.Pattern]]] = {}

    def forms(self, text: str) -> list[tuple[str, re.Pattern]]:
        """The written forms that a text may have: no form tells one digit from another, so texts are told apart without them."""
        shape = text.translate(_DIGITS)
        if shape not in self.shapes:
            if len(self.shapes) > 20_000:
                self.shapes.clear()
            self.shapes[shape] = [(name, pattern) for name, pattern in FORMS if pattern.match(shape)]
        return self.shapes[shape]

    def encoding(self, text: str | None) -> dict | None:
        """The encoding as a dict, empty for null; None if it isn't a JSON object."""
        if text is None or not text.strip():
            return {}
        if text not in self.encodings:
            if len(self.encodings) > 20_000:
                self.encodings.clear()
            try:
                read = json.loads(text)
            except ValueError:
                read = None
            self.encodings[text] = read if isinstance(read, dict) else None
        return self.encodings[text]

    def offsets(self, zone: str | None, named: str | None) -> list[int] | None:
        """Offsets that a zone in a label may mean; None where the label has no zone, [] for an unknown one."""
        if not zone:
            return None
        if zone.lower() in UTC_NAMES:
            return [0]
        if zone[0] in "+-":
            digits = zone[1:].replace(":", "")
            digits = digits if len(digits) > 2 else digits + "00"
            hours, minutes = int(digits[:-2]), int(digits[-2:])
            return [(-1 if zone[0] == "-" else 1) * (hours * 3600 + minutes * 60)] if hours <= 18 and minutes < 60 else []
        by_zone = self.known.get(zone.upper(), {})
        if named in by_zone:
            return by_zone[named]
        return sorted({o for offsets in by_zone.values() for o in offsets})

    def instants(self, day: int, ns: int, zone: str | None, named: str | None) -> list[int]:
        """Nanoseconds since the epoch in UTC that a wall clock may show: none, one or two."""
        wall = (day - EPOCH_DAY) * 86400 * NS + ns
        offsets = self.offsets(zone, named)
        if offsets is None:
            if not named:
                return [wall]
            tz = zone_of(named)
            if tz is None:
                return []
            clock = datetime.fromordinal(day) + timedelta(seconds=ns // NS)
            offsets = []
            for fold in (0, 1):
                offset = clock.replace(tzinfo=tz, fold=fold).utcoffset()
                back = (clock - offset).replace(tzinfo=timezone.utc).astimezone(tz).replace(tzinfo=None)
                seconds = int(offset.total_seconds())
                if back == clock and seconds not in offsets:
                    offsets.append(seconds)
        return [wall - o * NS for o in offsets]

    def clock(self, g: dict[str, str | None]) -> tuple[int, int] | None:
        """(ordinal day, nanoseconds of it) of matched parts; None for what no calendar or clock has."""
        try:
            if g.get("j"):
                first = date(int(g["Y"]), 1, 1)
                on = first + timedelta(days=int(g["j"]) - 1)
                if int(g["j"]) < 1 or on.year != first.year:
                    return None
            else:
                month = MONTHS.get(g["b"].lower(), 0) if g.get("b") else int(g["m"])
                on = date(int(g["Y"]), month, int(g["d"]))
        except (ValueError, OverflowError):
            return None
        if g.get("w") and DAYS[on.weekday()] != g["w"].lower():
            return None
        if g.get("h"):
            hour = int(g["h"])
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if g["a"][0] in "Pp" else 0)
        else:
            hour = int(g.get("H") or 0)
        minute, second = int(g.get("M") or 0), int(g.get("S") or 0)
        if hour > 23 or minute > 59 or second > 59:
            return None
        part = ((g.get("f") or "") + "0" * 9)[:9]
        return on.toordinal(), (hour * 3600 + minute * 60 + second) * NS + int(part)

    def written(self, text: str, forms: Iterable[tuple[str, re.Pattern]], named: str | None) -> list[tuple[str, int]]:
        out = []
        for name, pattern in forms:
            m = pattern.match(text)
            if m:
                g = m.groupdict()
                at = self.clock(g)
                if at is not None:
                    out += [(name, ns) for ns in self.instants(*at, g.get("zone"), named)]
        return out

    def counted(self, text: str, units: str, named: str | None) -> list[tuple[str, int]]:
        if not _NUMBER.fullmatch(text):
            return []
        if units.strip().lower().replace(" ", "") in ("dayas%y%m%d.%f", "daysas%y%m%d.%f"):
            whole, _, part = text.partition(".")
            m = re.fullmatch(r"(\d{4})(\d{2})(\d{2})", whole)
            if not m or (part and not part.isdigit()):
                return []
            at = self.clock({"Y": m[1], "m": m[2], "d": m[3]})
            if at is None:
                return []
            ns = round(Fraction(f"0.{part or 0}") * 86400 * NS)
            return [("day-as", i) for i in self.instants(at[0] + ns // (86400 * NS), ns % (86400 * NS), None, named)]
        if (units, named) not in self.counts:
            if len(self.counts) > 20_000:
                self.counts.clear()
            self.counts[units, named] = self.since(units, named)
        held = self.counts[units, named]
        if held is None:
            return []
        elapsed = _times(text, held[1])
        return [("since", start + elapsed) for start in held[0]]

    def since(self, units: str, named: str | None) -> tuple[list[int], int] | None:
        """(starts, nanoseconds of the unit) of ``<unit> since <reference>``; None where it can't be read."""
        m = _SINCE.match(units)
        unit = UNIT_NS.get(m[1].lower()) if m else None
        r = _REFERENCE.match(m[2]) if unit else None
        if r is None:
            return None
        second, _, part = (r[6] or "0").partition(".")
        at = self.clock({"Y": r[1].zfill(4), "m": r[2], "d": r[3], "H": r[4], "M": r[5], "S": second, "f": part})
        if at is None:
            return None
        zone = r[7]
        if zone and re.match(r"[+-]\d(?::|$)", zone):
            zone = zone[0] + "0" + zone[1:]
        return self.instants(*at, zone, named), unit

    def read(self, text: str | None, encoding: str | None) -> list[tuple[str, int]]:
        """All (form, nanoseconds since the epoch in UTC) that the label may stand for, without repeats of an instant."""
        enc = self.encoding(encoding)
        if enc is None or text is None or not text.strip():
            return []
        if str(enc.get("calendar") or "").strip().lower() not in GREGORIAN:
            return []
        text, named = text.strip(), enc.get("timezone") or None
        if enc.get("units"):
            found = self.counted(text, str(enc["units"]), named)
        elif enc.get("format"):
            pattern = pattern_of(str(enc["format"]))
            found = self.written(text, [(str(enc["format"]), pattern)], named) if pattern else []
        else:
            found = self.written(text, self.forms(text), named)
        seen: dict[int, str] = {}
        for form, ns in found:
            seen.setdefault(ns, form)
        return [(form, ns) for ns, form in seen.items()]


def nearest_ms(ns: int) -> int:
    return (ns + 500_000) // 1_000_000
