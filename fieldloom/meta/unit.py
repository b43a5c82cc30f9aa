"""Units: an expression of known names becomes a scale and an offset to base units.

``0.1 hPa``, ``m s**-1``, ``kg/m2``, ``deg F``: factors are numbers or names with an exponent, divided
by a slash, otherwise multiplied. What can't be read is kept as it is and counts as unknown.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Dimensions are exponents of (length, mass, time, temperature, amount, current, angle).
_L, _M, _T, _K, _N, _A, _R = (tuple(int(i == k) for i in range(7)) for k in range(7))
_ONE = (0,) * 7


def _dim(**powers: int) -> tuple[int, ...]:
    return tuple(powers.get(k, 0) for k in ("l", "m", "t", "k", "n", "a", "r"))


_PRESSURE, _SPEED, _FORCE, _ENERGY, _POWER = _dim(m=1, l=-1, t=-2), _dim(l=1, t=-1), _dim(m=1, l=1, t=-2), _dim(m=1, l=2, t=-2), _dim(m=1, l=2, t=-3)
# Spellings, scale and offset to base units, dimension.
_NAMED: list[tuple[str, float, float, tuple[int, ...]]] = [
    ("m metre metres meter meters", 1.0, 0.0, _L),
    ("inch inches in", 0.0254, 0.0, _L),
    ("ft foot feet", 0.3048, 0.0, _L),
    ("fathom fathoms", 1.8288, 0.0, _L),
    ("yard yards yd", 0.9144, 0.0, _L),
    ("mile miles mi", 1609.344, 0.0, _L),
    ("nautical_mile nautical_miles nmile nmi", 1852.0, 0.0, _L),
    ("g gram grams gramme grammes", 1e-3, 0.0, _M),
    ("tonne tonnes t", 1e3, 0.0, _M),
    ("s sec secs second seconds", 1.0, 0.0, _T),
    ("min mins minute minutes", 60.0, 0.0, _T),
    ("h hr hrs hour hours", 3600.0, 0.0, _T),
    ("d day days", 86400.0, 0.0, _T),
    ("K kelvin kelvins degK deg_K degree_K degrees_K degreeK degreesK °K", 1.0, 0.0, _K),
    ("degC deg_C degree_C degrees_C degreeC degreesC celsius degree_Celsius degrees_Celsius °C ℃ C", 1.0, 273.15, _K),
    ("degF deg_F degree_F degrees_F degreeF degreesF fahrenheit degree_Fahrenheit degrees_Fahrenheit °F ℉ F", 5.0 / 9.0, 459.67 * 5.0 / 9.0, _K),
    ("mol mole moles", 1.0, 0.0, _N),
    ("ampere amperes A", 1.0, 0.0, _A),
    ("radian radians rad", 1.0, 0.0, _R),
    ("degree degrees deg ° degree_north degrees_north degreeN degreesN degree_N degrees_N degree_east degrees_east degreeE degreesE degree_E degrees_E", 0.017453292519943295, 0.0, _R),
    ("1 fraction ratio dimensionless count", 1.0, 0.0, _ONE),
    ("% percent pct per_cent", 0.01, 0.0, _ONE),
    ("Pa pascal pascals", 1.0, 0.0, _PRESSURE),
    ("bar bars", 1e5, 0.0, _PRESSURE),
    ("mb millibars", 100.0, 0.0, _PRESSURE),
    ("atm atmosphere atmospheres", 101325.0, 0.0, _PRESSURE),
    ("N newton newtons", 1.0, 0.0, _FORCE),
    ("J joule joules", 1.0, 0.0, _ENERGY),
    ("W watt watts", 1.0, 0.0, _POWER),
    ("l L litre litres liter liters", 1e-3, 0.0, _dim(l=3)),
    ("knot knots kt kts kn", 1852.0 / 3600.0, 0.0, _SPEED),
    ("mph", 0.44704, 0.0, _SPEED),
    ("kmh kph", 1.0 / 3.6, 0.0, _SPEED),
    ("mps", 1.0, 0.0, _SPEED),
]
_PREFIX = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 10.0, "d": 0.1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "n": 1e-9, "p": 1e-12,
           "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deca": 10.0, "deci": 0.1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9}
_TAKES_PREFIX = set("m metre metres meter meters g gram grams s second seconds Pa pascal pascals bar bars N newton J joule W watt l L litre litres liter liters mol mole K kelvin".split())
_EXACT = {name: (scale, offset, dim) for names, scale, offset, dim in _NAMED for name in names.split()}
_BLIND: dict[str, tuple[float, float, tuple[int, ...]]] = {}
for _name in sorted(_EXACT, key=lambda n: (n != n.lower(), n)):
    _BLIND.setdefault(_name.lower(), _EXACT[_name])
_FACTOR = re.compile(r"\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![A-Za-z°%])|(?P<name>[A-Za-z°%µμ℃℉_]+)(?:\s*(?:\*\*|\^)\s*(?P<p1>[+-]?\d+)|(?P<p2>[+-]?\d+))?)")


def _lookup(name: str) -> tuple[float, float, tuple[int, ...]] | None:
    for known, at, prefixes in ((_EXACT, name, _PREFIX), (_BLIND, name.lower(), {p.lower(): f for p, f in _PREFIX.items() if p not in ("Y", "Z", "E", "P", "T", "G", "M")})):
        if at in known:
            return known[at]
        for prefix, factor in prefixes.items():
            rest = at[len(prefix):]
            if at.startswith(prefix) and rest and (rest in _TAKES_PREFIX or (known is _BLIND and rest in {t.lower() for t in _TAKES_PREFIX})):
                scale, offset, dim = known[rest]
                return scale * factor, offset, dim
    return None


@dataclass(frozen=True)
class Unit:
    """base = value * scale + offset; ``dim`` is None for an unknown unit."""

    text: str
    scale: float = 1.0
    offset: float = 0.0
    dim: tuple[int, ...] | None = None
    calendar: str | None = None

    @property
    def is_unknown(self) -> bool:
        return self.dim is None

    @property
    def is_time_reference(self) -> bool:
        return " since " in self.text

    def is_convertible(self, other: Unit) -> bool:
        return self.dim is not None and self.dim == other.dim

    def to(self, other: Unit) -> tuple[float, float]:
        """(a, b) of value_in_other = value * a + b; ValueError where they measure different things."""
        if not self.is_convertible(other):
            raise ValueError(f"can't convert {self.text!r} to {other.text!r}")
        return self.scale / other.scale, (self.offset - other.offset) / other.scale

    def __str__(self) -> str:
        return self.text


@lru_cache(maxsize=65536)
def parse_unit(text: str | None, calendar: str | None = None) -> Unit:
    """Read a unit expression. Null, blank and unreadable text give an unknown unit, which keeps the text."""
    raw = "" if text is None else str(text)
    s = " ".join(raw.replace("·", ".").split())
    if not s or " since " in s:
        return Unit(raw, calendar=calendar)
    s = re.sub(r"\b(deg|degree|degrees) ([CFKcfk]|[Cc]elsius|[Ff]ahrenheit|[Kk]elvin)\b", r"\1_\2", s)
    if s.lower() in ("deg_celsius", "deg_fahrenheit", "deg_kelvin"):
        s = s[4:]
    scale, dim, offset, at, names, divide, first = 1.0, list(_ONE), 0.0, 0, 0, False, True
    while at < len(s):
        m = _FACTOR.match(s, at)
        if not m:
            return Unit(raw, calendar=calendar)
        if m["number"] is not None:
            factor, powers, own = float(m["number"]), _ONE, 0.0
            if factor == 0 or (not first and not divide):
                return Unit(raw, calendar=calendar)
            exponent = 1
        else:
            found = _lookup(m["name"])
            if found is None:
                return Unit(raw, calendar=calendar)
            factor, own, powers = found
            exponent = int(m["p1"] or m["p2"] or 1)
            names += 1
        exponent = -exponent if divide else exponent
        if own:
            offset = own if exponent == 1 and names == 1 else 0.0
        elif m["number"] is None and offset:
            offset = 0.0  # a difference of temperatures, not a temperature
        scale *= factor**exponent
        dim = [a + b * exponent for a, b in zip(dim, powers)]
        at, divide, first = m.end(), False, False
        rest = re.compile(r"\s*([/.*]?)\s*").match(s, at)
        if at < len(s) and rest[1] == "/":
            divide = True
        at = rest.end()
    if divide:
        return Unit(raw, calendar=calendar)
    return Unit(raw, scale, offset, tuple(dim), calendar)
