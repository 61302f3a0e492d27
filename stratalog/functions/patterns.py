"""Patterns of new names: {n} is a number in the batch, {name} the stem, {ext} the extension."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\{([^}]*)\}|([^{}]+)", re.DOTALL)


@dataclass(frozen=True)
class NamePattern:
    """``parts`` are pairs: a place's name and "", or "" and a literal text."""

    parts: tuple[tuple[str, str], ...]

    @property
    def varies(self) -> bool:
        """Whether files of one batch get names of their own."""
        return any(place in ("n", "name") for place, _ in self.parts)

    def render(self, name: Column, n: Column, width: Column) -> Column:
        """The new name of one that is number ``n``, from 1, with zeros up to ``width`` digits."""
        has_stem = name.rlike(r"(?s)^.+\.[^.]*$") & (name != "..")
        number = n.cast("string")
        made = {
            "n": F.lpad(number, F.greatest(width, F.length(number)), F.lit("0")),
            "name": F.when(has_stem, F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name),
            "ext": F.when(has_stem, F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)).otherwise(""),
        }
        return F.concat(*[made[place] if place else F.lit(text) for place, text in self.parts])


def parsed(text: str) -> NamePattern | None:
    """None for no text, places of other names, and braces without a partner."""
    parts, at = [], 0
    while at < len(text):
        found = _PART.match(text, at)
        if not found:
            return None
        place = None if found[1] is None else found[1].strip().lower()
        if place is not None and place not in ("n", "name", "ext"):
            return None
        parts.append((place or "", found[2] or ""))
        at = found.end()
    return NamePattern(tuple(parts)) if parts else None
