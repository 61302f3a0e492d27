"""Commands and questions in words: what a sentence acts on, what it does, and where to."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from . import grammar, patterns, phrases
from .phrases import lower

# Vocabulary that decides results.
VERBS = {
    "delete": ("delete", "remove", "trash"), "move": ("move",), "copy": ("copy",), "rename": ("rename",), "compress": ("compress", "zip", "archive"), "tag": ("tag", "label"),
    "untag": ("untag",), "organize": ("organize", "organise", "tidy", "sort"),
}
SEPARATORS = {"move": ("to", "into"), "copy": ("to", "into"), "rename": ("to",), "tag": ("as", "with")}
QUANTIFIERS = ("all", "every", "any", "my", "the")
PICKED = (
    "selected", "selection", "these", "them", "it", "this", "those", "that", "this file", "these ones", "selected ones", "what i selected", "everything selected",
    "selected files", "selected items", "these files", "these items",
)
EVERYTHING = ("everything", "anything", "files", "items", "stuff", "*")
CONTENTS = ("everything", "all", "the", "my", "files", "items", "stuff", "in", "inside")
THIS_FOLDER = ("", "here", "this", "this folder", "this directory", "current folder")
HERE = ("here", "this", "current", "this folder", "current folder", "the current folder", "this directory")
ORGANIZED_BY = {"type": "kind", "kind": "kind", "file type": "kind", "extension": "extension", "ext": "extension", "month": "month", "date": "month", "year": "year"}
COLORS = {"grey": "grey", "gray": "grey", "green": "green", "purple": "purple", "blue": "blue", "yellow": "yellow", "red": "red", "orange": "orange"}
ASKED = {
    "count": ("how many", "count", "number of"),
    "size": ("how big is", "how large is", "size of", "total size of", "how big are", "how large are"),
}
ASKED_TAILS = ("are there", "do i have", "there are")
GO = ("go to", "goto", "cd", "open", "show", "take me to")
TEMPLATES = (
    ("move pdfs from Downloads to Documents", "Move files"), ("copy selected to Desktop", "Copy files"), ("delete screenshots older than 30 days", "Move files to Trash"),
    ("rename selected to photo-{n}.{ext}", "Rename in bulk"), ("zip selected", "Compress to ZIP"), ("tag invoices as Work", "Tag files"),
    ("organize Downloads by type", "Sort files into folders"), ("move selected to new folder Archive", "Move into a new folder"), ("go to Documents", "Open a folder"),
    ("new folder Projects", "Create a folder"), ("connect to smb://server/share", "Open a network share"), ("how big is Downloads", "Folder size"),
    ("how many pdfs", "Count files"), ("largest videos", "Find what takes the space"),
)

_VERB_OF = {word: verb for verb, words in VERBS.items() for word in words}


@dataclass(frozen=True)
class Destination:
    name: str
    create: bool = False


@dataclass(frozen=True)
class Selection:
    """Files by ``text`` of their names and ``filters``, within a folder; or those that are ``picked``."""

    source: str
    text: str = ""
    filters: tuple[grammar.Filter, ...] = ()
    within: Destination | None = None
    picked: bool = False

    @property
    def query(self) -> grammar.Query:
        return grammar.Query(self.text, self.filters)


@dataclass(frozen=True)
class Command:
    """``to`` is a Destination (move, copy), a NamePattern (rename), a Tag (tag), a tag's name or None for all tags (untag), or what decides a file's folder (organize)."""

    verb: str
    of: Selection
    to: object = None


@dataclass(frozen=True)
class Tag:
    name: str
    color: str | None = None


@dataclass(frozen=True)
class Question:
    """``asks`` is count, size or largest; ``folder``: the words may name a folder; ``top``: how many."""

    asks: str
    of: Selection
    folder: bool = False
    top: int | None = None


@dataclass(frozen=True)
class Go:
    name: str
    new_tab: bool = False


def _is(words: list[str], *options: str) -> bool:
    return lower(" ".join(words)) in options


def _after(words: list[str], lead: str) -> list[str] | None:
    """The words after a lead, if there are any."""
    n = len(lead.split())
    return words[n:] if len(words) > n and _is(words[:n], lead) else None


def _last(words: list[str], options: tuple[str, ...]) -> int | None:
    return max((i for i, w in enumerate(words) if lower(w) in options), default=None)


def _unquantified(words: list[str]) -> list[str]:
    return words[1:] if _is(words[:1], *QUANTIFIERS) else words


# --- what and where -------------------------------------------------------------------------------------------------------------------------


def destination(words: list[str]) -> Destination | None:
    """A folder's name without articles and a last "folder"; "new folder X" and "a folder called X" ask for one to be made."""
    words = _unquantified(words)
    if len(words) > 1 and _is(words[:1], "a"):
        words = words[1:]
    made = re.fullmatch(r"(?:new (?:folder|directory)(?: (?:called|named))?|(?:folder|directory) (?:called|named)) (.+)", " ".join(words), re.IGNORECASE | re.ASCII | re.DOTALL)
    if made and not _is([made[1]], "called", "named"):
        return Destination(made[1], True)
    while words and _is(words[-1:], "folder", "directory"):
        words = words[:-1]
    return Destination(" ".join(words)) if words else None


def _place(words: list[str], now: int) -> tuple[list[str], Destination | None]:
    """Words before the last "from", "in" or "inside", and the folder after it, unless a time is there."""
    at = _last(words, ("from", "in", "inside"))
    if at is None or any(":" in w for w in words[at + 1 :]):
        return words, None
    place = destination(words[at + 1 :])
    dated = any(f.field == "modified" for f in phrases.expand(" ".join(words[at + 1 :]), now, described=True).filters)
    return (words, None) if place is None or dated else (words[:at], replace(place, create=False))


def selection(words: list[str], now: int, explicit: bool = True, everything: bool = False) -> Selection | None:
    """What words describe, None for nothing. ``explicit`` allows picked files, ``everything`` all of them."""
    source = " ".join(words)
    if explicit and _is([source], *PICKED):
        return Selection(source, picked=True)
    words, within = _place(words, now)
    query = phrases.searched(" ".join(words), now, described=True)
    whole = _is([query.text], *EVERYTHING)
    text = "" if whole and (within or everything or query.filters) else query.text
    if not (text or query.filters or within or (everything and whole)):
        return None
    return Selection(source, text, query.filters, within)


def _organized(words: list[str]) -> Selection:
    """The picked files, a named folder, or the one that is shown."""
    source = " ".join(words)
    while words and _is(words[:1], *CONTENTS):
        words = words[1:]
    picked = _is(words, *PICKED)
    return Selection(source, within=None if picked or _is(words, *THIS_FOLDER) else destination(words), picked=picked)


def _tag(words: list[str]) -> Tag:
    """A color is a tag of its name, a color and words a colored tag."""
    color = COLORS.get(lower(words[0]))
    if color and len(words) == 1:
        return Tag(lower(words[0]).capitalize(), color)
    return Tag(" ".join(words[1:] if color else words), color)


# --- sentences ------------------------------------------------------------------------------------------------------------------------------


def command(raw: str, now: int, auto: bool = False) -> Command | None:
    """The command that a text is. ``auto`` is the strict reading for texts typed as searches: only deleting by a filter, moving, copying and renaming."""
    words = raw.split()
    verb = _VERB_OF.get(lower(words[0])) if words else None
    if not verb:
        return None
    rest, named = _unquantified(words[1:]), None
    if verb == "delete" and _is(rest[:1], "tag"):
        at = next((i for i, w in enumerate(rest) if _is([w], "from")), 0)
        if at > 1:
            verb, named, rest = "untag", " ".join(rest[1:at]), _unquantified(rest[at + 1 :])
    if (auto and verb not in ("delete", "move", "copy", "rename")) or not (rest or verb == "organize"):
        return None
    if verb == "organize":
        at = _last(rest, ("by",))
        by = "kind" if at is None else ORGANIZED_BY.get(lower(" ".join(rest[at + 1 :])))
        return by and Command(verb, _organized(rest[:at]), by)
    to = named
    if verb in SEPARATORS:
        at = _last(rest, SEPARATORS[verb])
        if not at or at + 1 == len(rest):
            return None
        rest, tail = rest[:at], rest[at + 1 :]
        to = {"rename": lambda: patterns.parsed(" ".join(tail)), "tag": lambda: _tag(tail)}.get(verb, lambda: destination(tail))()
        if to is None:
            return None
    of = selection(rest, now, explicit=not auto)
    if of is None or (auto and verb == "delete" and not of.filters):
        return None
    return Command(verb, of, to)


def _asked(words: list[str], lead: str, now: int) -> Selection | None:
    rest = _after(words, lead)
    if rest is None:
        return None
    tail = next((t.split() for t in ASKED_TAILS if len(rest) >= len(t.split()) and _is(rest[-len(t.split()) :], t)), [])
    rest = rest[: len(rest) - len(tail)]
    if len(rest) > 1 and _is(rest[:1], "my", "the", "all"):
        rest = rest[1:]
    return selection(rest, now, everything=True)


def question(words: list[str], now: int) -> Question | None:
    for asks, leads in ASKED.items():
        for lead in leads:
            if of := _asked(words, lead, now):
                return Question(asks, of, asks == "size" and not lead.endswith("are"))
    rest = _after(words, "largest") or _after(words, "biggest")
    if not rest:
        return None
    top = int(rest[0]) if re.fullmatch(r"\+?[0-9]+", rest[0]) and int(rest[0]) > 0 else None
    of = selection((rest[1:] if top else rest) or ["files"], now, everything=True)
    return of and Question("largest", of, top=top)


def go(words: list[str]) -> Go | None:
    rest = next((r for lead in GO if (r := _after(words, lead))), None)
    if not rest:
        return None
    tab = next((t for t in ("in a new tab", "in new tab") if _is(words[-len(t.split()) :], t)), None)
    if tab:
        rest = rest[: max(len(rest) - len(tab.split()), 0)]
    if len(rest) > 1 and _is(rest[:1], "the"):
        rest = rest[1:]
    if len(rest) > 1 and _is(rest[-1:], "folder"):
        rest = rest[:-1]
    return Go(" ".join(rest), tab is not None) if rest else None


def interpreted(raw: str, now: int) -> Question | Go | Command | None:
    """A question, a place to go to or a command, in this order; question and exclamation marks at ends of words don't count."""
    words = [w for w in (w.rstrip("?!") for w in raw.split()) if w]
    return question(words, now) or go(words) or command(" ".join(words), now)


def suggested(text: str) -> list[tuple[str, str]]:
    """Templates of which some word begins with each typed word; if there are none, those that fit the first one."""

    def fits(typed: list[str]) -> list[tuple[str, str]]:
        return [(t, hint) for t, hint in TEMPLATES if all(any(w.startswith(x) for w in lower(f"{t} {hint}").split()) for x in typed)]

    typed = lower(text).split()
    return fits(typed) or (fits(typed[:1]) if len(typed) > 1 else [])
