"""The grammar of typed queries: words of the form key:value are filters, all others are text."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names

DAY = 86400
# The words for each kind and the units, which decide results.
KIND_WORDS = {
    "Image": ("image", "img", "photo", "picture"),
    "Video": ("video", "movie"),
    "Audio": ("audio", "music", "sound"),
    "Archive": ("archive", "zip"),
    "Code": ("code", "source"),
    "Document": ("document", "doc", "docs"),
    "Directory": ("folder", "dir", "directory"),
    "Other": ("other", "file"),
}
SIZE_UNITS = {"": 0, "b": 0, "kb": 1, "k": 1, "kib": 1, "mb": 2, "m": 2, "mib": 2, "gb": 3, "g": 3, "gib": 3, "tb": 4, "t": 4, "tib": 4}
AGE_UNITS = {"h": 3600, "d": DAY, "w": 7 * DAY}
_COMPARED = re.compile(r"(>=|<=|>|<|)(.*)", re.DOTALL)
_SIZE = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*([A-Za-z]*)\s*", re.ASCII)
_AGE = re.compile(r"([<>])\s*(\+?\d+)\s*([a-z]+)\s*", re.ASCII)
_DATE = re.compile(r"\s*\+?(\d+)-\+?(\d+)-\+?(\d+)\s*", re.ASCII)


@dataclass(frozen=True)
class Filter:
    """``field`` compared by ``op`` (=, <, <=, >, >=, range) with ``low``, for a range also ``high``, both included."""

    field: str
    op: str
    low: object
    high: object = None

    def where(self) -> Column | None:
        """The records that pass; unknown sizes and times never do. None for tags, which are joined with their paths."""
        if self.field == "tag":
            return None
        if self.field == "kind":
            return names.kind(F.col("name"), F.col("is_dir")) == self.low
        if self.field == "ext":
            return F.coalesce(~F.col("is_dir") & (names.extension(F.col("name")) == self.low), F.lit(False))
        value = F.col({"size": "size", "modified": "mtime"}[self.field])
        passed = {"=": value == self.low, "<": value < self.low, "<=": value <= self.low, ">": value > self.low, ">=": value >= self.low}
        return F.coalesce(value.between(self.low, self.high) if self.op == "range" else passed[self.op], F.lit(False))


@dataclass(frozen=True)
class Query:
    text: str
    filters: tuple[Filter, ...]

    def where(self) -> Column:
        """All filters but those of tags."""
        out = F.lit(True)
        for f in self.filters:
            if (one := f.where()) is not None:
                out = out & one
        return out

    @property
    def tags(self) -> list[str]:
        return [f.low for f in self.filters if f.field == "tag"]


def size(text: str) -> int | None:
    """Bytes of a size such as 1.5mb, in steps of 1024."""
    found = _SIZE.fullmatch(text)
    if not found or (power := SIZE_UNITS.get(found[2].lower())) is None or (value := float(found[1])) < 0:
        return None
    return int(value * 1024**power) if value * 1024**power <= 2**64 else None


def date(text: str) -> int | None:
    """The first second of a day; days are at most 31 in any month and go on into the next one."""
    found = _DATE.fullmatch(text)
    if not found:
        return None
    year, month, day = map(int, found.groups())
    if not (1 <= month <= 12 and 1 <= day <= 31):
        return None
    cycles, year = divmod(year - 1, 400)  # the calendar repeats after 146,097 days
    first = datetime.date(year + 1, month, 1).toordinal() + cycles * 146_097
    return (first + day - 1 - datetime.date(1970, 1, 1).toordinal()) * DAY


def _sized(value: str) -> Filter | None:
    if ".." in value:
        low, high = map(size, value.split("..", 1))
        return None if low is None or high is None else Filter("size", "range", low, high)
    op, rest = _COMPARED.fullmatch(value).groups()
    n = size(rest)
    return None if n is None else Filter("size", op or "=", n)


def _modified(value: str, now: int) -> Filter | None:
    today = now // DAY * DAY
    fixed = {
        "today": Filter("modified", ">=", today),
        "yesterday": Filter("modified", "range", today - DAY, today - 1),
        "week": Filter("modified", ">=", now - 7 * DAY),
        "month": Filter("modified", ">=", now - 30 * DAY),
        "year": Filter("modified", ">=", now - 365 * DAY),
    }
    if out := fixed.get(value.lower()):
        return out
    if (age := _AGE.fullmatch(value.lower())) and age[3] in AGE_UNITS:  # younger than is later than
        return Filter("modified", {"<": ">", ">": "<"}[age[1]], now - int(age[2]) * AGE_UNITS[age[3]])
    if ".." in value:
        low, high = map(date, value.split("..", 1))
        return None if low is None or high is None else Filter("modified", "range", low, high + DAY - 1)
    op, rest = _COMPARED.fullmatch(value).groups()
    day = date(rest)
    if day is None:
        return None
    last = day + DAY - 1
    return Filter("modified", "range", day, last) if not op else Filter("modified", op, last if op in (">", "<=") else day)


def filter_of(word: str, now: int) -> Filter | None:
    """The filter that a word is, or None for text: unknown keys, no value, or one that the key can't read."""
    key, _, value = word.partition(":")
    if not value:
        return None
    match key.lower() if key.isascii() else key:
        case "tag":
            return Filter("tag", "=", value.lower())
        case "kind":
            kind = next((k for k, words in KIND_WORDS.items() if value.lower() in words), None)
            return Filter("kind", "=", kind) if kind else None
        case "ext":
            return Filter("ext", "=", value.lstrip(".").lower())
        case "size":
            return _sized(value)
        case "modified":
            return _modified(value, now)
    return None


def parsed(raw: str, now: int) -> Query:
    """Text and distinct filters of a typed query; ``now`` anchors ages. Never fails."""
    words = [(w, filter_of(w, now)) for w in raw.split()]
    return Query(" ".join(w for w, f in words if f is None), tuple(dict.fromkeys(f for _, f in words if f)))


def chips(raw: str, now: int) -> list[tuple[str, Filter]]:
    """The words that are filters, the first of each filter."""
    out: dict[Filter, str] = {}
    for word in raw.split():
        if f := filter_of(word, now):
            out.setdefault(f, word)
    return [(w, f) for f, w in out.items()]


def without(raw: str, word: str) -> str:
    return " ".join(w for w in raw.split() if w != word)
