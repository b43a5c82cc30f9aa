"""CF ``cell_methods``: a sequence of ``axes: method [where area [over area]] [(details)]``.

Inside the parentheses stand ``interval: value unit`` entries, one for all axes or one for each,
and ``comment: text``; parentheses without these keys are a plain comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

_TOKEN = re.compile(r"\([^()]*(?:\([^()]*\)[^()]*)*\)|[^\s()]+")
_DETAIL = re.compile(r"\b(interval|comment)\s*:\s*", re.I)
_AMOUNT = re.compile(r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(\S.*?)\s*$")

# Spellings of time units, in microseconds.
TIME_UNIT_US = {
    "us": 1, "microsecond": 1, "microseconds": 1,
    "ms": 1_000, "msec": 1_000, "millisecond": 1_000, "milliseconds": 1_000,
    "s": 1_000_000, "sec": 1_000_000, "secs": 1_000_000, "second": 1_000_000, "seconds": 1_000_000,
    "min": 60_000_000, "mins": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000,
    "h": 3_600_000_000, "hr": 3_600_000_000, "hrs": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000, "days": 86_400_000_000,
    "week": 604_800_000_000, "weeks": 604_800_000_000,
}


@dataclass(frozen=True)
class CellMethod:
    """One entry of a ``cell_methods`` string; the comment does not count for equality."""

    axes: tuple[str, ...]
    method: str | None
    where: str | None = None
    intervals: tuple[str, ...] = ()
    comment: str | None = field(default=None, compare=False)

    def interval_of(self, axis: str) -> str | None:
        """The interval that holds for one axis: its own, or the only one given."""
        if axis not in self.axes or not self.intervals:
            return None
        if len(self.intervals) == len(self.axes):
            return self.intervals[self.axes.index(axis)]
        return self.intervals[0] if len(self.intervals) == 1 else None

    def __str__(self) -> str:
        text = " ".join([*(f"{a}:" for a in self.axes), *([self.method] if self.method else [])])
        if self.where:
            text += f" where {self.where}"
        details = [f"interval: {i}" for i in self.intervals] + ([f"comment: {self.comment}"] if self.comment else [])
        return text + (f" ({' '.join(details)})" if details else "")


def _details(text: str) -> tuple[tuple[str, ...], str | None]:
    marks = list(_DETAIL.finditer(text))
    if not marks:
        return (), text.strip() or None
    intervals, comment = [], None
    for i, m in enumerate(marks):
        if m[1].lower() == "comment":
            comment = text[m.end():].strip()
            break
        end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        intervals.append(text[m.end():end].strip())
    return tuple(intervals), comment


def parse_cell_methods(text: str | None) -> list[CellMethod]:
    """All entries of a ``cell_methods`` string; an empty list for null, blank or unreadable text."""
    if not text or not text.strip():
        return []
    out: list[CellMethod] = []
    axes: list[str] = []
    words: list[str] = []
    intervals: tuple[str, ...] = ()
    comment: str | None = None

    def close() -> None:
        nonlocal axes, words, intervals, comment
        if axes:
            method = words[0] if words else None
            where = " ".join(words[2:]) if len(words) > 2 and words[1] == "where" else None
            out.append(CellMethod(tuple(axes), method, where, intervals, comment))
        axes, words, intervals, comment = [], [], (), None

    for token in _TOKEN.findall(text):
        if token.startswith("("):
            intervals, comment = _details(token[1:-1])
        elif token.endswith(":") and len(token) > 1:
            if words or intervals or comment:
                close()
            axes.append(token[:-1])
        else:
            words.append(token)
    close()
    return out


def parse_cell_method(text: str | None) -> CellMethod | None:
    """The first entry, for a field that has one."""
    entries = parse_cell_methods(text)
    return entries[0] if entries else None


def render_cell_methods(entries: list[CellMethod]) -> str:
    return " ".join(map(str, entries))


def duration_us(text: str | None) -> int | None:
    """Microseconds of ``value unit``; None if it isn't a positive whole number of them."""
    m = _AMOUNT.match(text or "")
    unit = TIME_UNIT_US.get(m[2].lower()) if m else None
    if unit is None:
        return None
    us = Fraction(m[1]) * unit
    return int(us) if us > 0 and us.denominator == 1 else None


def time_interval_us(text: str | None, axis: str = "time") -> int | None:
    """The interval that ``cell_methods`` states for the time axis, in microseconds."""
    for entry in parse_cell_methods(text):
        us = duration_us(entry.interval_of(axis))
        if us is not None:
            return us
    return None
