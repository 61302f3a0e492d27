"""Searches in plain words: runs of up to five words that describe files become filters, all others stay text."""

from __future__ import annotations

import datetime
import itertools
import re
from dataclasses import dataclass

from . import grammar, names
from .grammar import DAY, Filter

LONGEST = 5
MOST_SECONDS = 2**63 - 1
# Vocabulary that decides results.
KIND_WORDS = {
    "Image": ("photos", "pictures", "images", "photo", "picture", "image", "pics", "pic", "snaps", "screenshots", "screenshot", "wallpapers"),
    "Video": ("videos", "movies", "video", "movie", "clips", "films", "footage"),
    "Audio": ("music", "songs", "audio", "song", "tracks", "podcasts"),
    "Document": ("documents", "document", "docs", "spreadsheets", "spreadsheet", "sheets", "excel", "slides", "presentations"),
    "Directory": ("folders", "directories", "folder", "dirs"),
    "Code": ("code", "source code", "scripts", "source files"),
    "Archive": ("archives", "zips", "archive", "zip"),
}
LANGUAGES = {"rust": "rs", "python": "py", "javascript": "js", "typescript": "ts", "golang": "go", "ruby": "rb", "kotlin": "kt"}
EVERYDAY = ("opus", "swift")
FILLERS = (
    "from", "in", "my", "the", "of", "on", "at", "a", "an", "some", "any", "all", "that", "those", "these", "for", "i", "files", "file", "really", "very", "super",
    "modified", "created", "changed", "edited", "saved", "updated", "downloaded", "took", "taken", "made", "signed", "sent", "received", "shared",
)
NAMED_SIZES = {
    **dict.fromkeys(("big", "large", "huge"), (">", 100 * 1024**2)),
    **dict.fromkeys(("small", "tiny"), ("<", 1024**2)),
    **dict.fromkeys(("empty", "zero byte", "zero bytes", "zero-byte", "0 bytes"), ("=", 0)),
}
SIZE_LEADS = {
    "bigger than": ">", "larger than": ">", "more than": ">", "over": ">", "above": ">",
    "smaller than": "<", "less than": "<", "under": "<", "below": "<", "at least": ">=", "at most": "<=",
}
COMPARATIVES = ("older", "newer", "bigger", "larger", "smaller")
BYTE_UNITS = {"byte": "b", "b": "b", "kilobyte": "kb", "kb": "kb", "k": "kb", "megabyte": "mb", "meg": "mb", "mb": "mb", "gigabyte": "gb", "gig": "gb", "gb": "gb", "terabyte": "tb", "tb": "tb"}
COUNTS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "couple": 2, "three": 3, "few": 3, "several": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12,
}
SPANS = {
    "hour": 3600, "hr": 3600, "h": 3600, "day": DAY, "d": DAY, "week": 7 * DAY, "wk": 7 * DAY, "w": 7 * DAY, "month": 30 * DAY, "year": 365 * DAY, "yr": 365 * DAY,
}
TODAY = ("today", "this morning", "this afternoon", "earlier today", "tonight")
#: Phrases for the last days up to now, and for as many days before these.
RECENT = {
    **dict.fromkeys(("this week", "recently", "lately", "recent", "past week", "earlier this week"), 7),
    **dict.fromkeys(("this month", "past month", "earlier this month"), 30),
    **dict.fromkeys(("this year", "past year", "earlier this year"), 365),
}
BEFORE = {"last week": 7, "last month": 30, "last year": 365}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
KIND_LABELS = {
    "Directory": ("folder", "Folders"), "Image": ("image", "Images"), "Video": ("video", "Videos"), "Audio": ("audio", "Audio"), "Archive": ("archive", "Archives"),
    "Code": ("code", "Code"), "Document": ("document", "Documents"), "Other": ("other", "Other files"),
}

_KIND_OF = {word: kind for kind, words in KIND_WORDS.items() for word in words}
_KNOWN = {e for found in names.KINDS.values() for e in found}
_MONTH_OF = {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])} | {"sept": 9}
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_INTEGER = re.compile(r"[+-]?[0-9]+")
_LED = re.compile(r"(" + "|".join(SIZE_LEADS) + r") (.+)", re.DOTALL)
_DAY = re.compile(r"(\+?[0-9]+)(?:st|nd|rd|th)?")


@dataclass(frozen=True)
class Phrase:
    source: str
    filter: Filter

    @property
    def label(self) -> str:
        """As a filter: kind:image, ext:pdf; sizes and times in the words that were typed."""
        match self.filter.field:
            case "kind":
                return f"kind:{KIND_LABELS[self.filter.low][0]}"
            case "ext":
                return f"ext:{self.filter.low}"
        return self.source

    @property
    def plain_label(self) -> str:
        """In words: Images, PDF files; sizes and times as typed, with a capital."""
        match self.filter.field:
            case "kind":
                return KIND_LABELS[self.filter.low][1]
            case "ext":
                return f"{self.filter.low.upper()} files"
        return self.source[:1].translate(_UPPER) + self.source[1:]


_UPPER = {v: k for k, v in ((k, ord(v)) for k, v in _LOWER.items())}


@dataclass(frozen=True)
class Expansion:
    text: str
    phrases: tuple[Phrase, ...]

    @property
    def filters(self) -> tuple[Filter, ...]:
        return tuple(p.filter for p in self.phrases)


def lower(text: str) -> str:
    """A to Z in small letters, all else as it is."""
    return text.translate(_LOWER)


def _integer(text: str) -> int | None:
    return int(text) if _INTEGER.fullmatch(text) and abs(int(text)) <= MOST_SECONDS else None


def _singular(word: str) -> str:
    return word.removesuffix("s")


def _times(unit: int, n: int) -> int | None:
    return unit * n if unit * n <= MOST_SECONDS else None


# --- sizes and spans ------------------------------------------------------------------------------------------------------------------------


def extension_word(phrase: str) -> str | None:
    """The extension that a word names: a language, or a known extension of three characters or more, also as a plural."""
    candidates = (e for e in (phrase, _singular(phrase)) if len(e) > 2 and e in _KNOWN and e not in EVERYDAY)
    return LANGUAGES.get(phrase) or next(candidates, None)


def spoken_size(text: str) -> int | None:
    """Bytes of a size with its unit: 10mb, 20 megabytes, a gigabyte."""
    words = text.split()
    if len(words) == 1 and re.search("[A-Za-z]", text):
        return grammar.size(words[0])
    if len(words) == 2 and (unit := BYTE_UNITS.get(_singular(words[1]))):
        return grammar.size(f"{COUNTS.get(words[0], words[0])}{unit}")
    return None


def spoken_span(text: str) -> tuple[int, int] | None:
    """How many of how many seconds: 30 days, a couple of weeks, 30d."""
    words = [w for w in text.split() if w != "of"]
    if len(words) == 1:
        count, unit = re.fullmatch(r"([^A-Za-z]*)(.*)", words[0], re.DOTALL).groups()
    elif len(words) == 2 or (len(words) == 3 and words[0] in ("a", "an")):
        count, unit = words[-2:]
    else:
        return None
    n = COUNTS.get(count, _integer(count))
    seconds = SPANS.get(_singular(unit))
    return None if n is None or n < 0 or seconds is None else (n, seconds)


def _seconds(text: str) -> int | None:
    span = spoken_span(text)
    return span and _times(*span)


# --- times ----------------------------------------------------------------------------------------------------------------------------------


def _weekday(name: str, today: int) -> tuple[int, int] | None:
    """The last day of that name before today."""
    if name not in WEEKDAYS:
        return None
    number = today // DAY
    back = ((number + 4) - WEEKDAYS.index(name) - 1) % 7 + 1
    return today - back * DAY, today - (back - 1) * DAY - 1


def _weekend(today: int) -> tuple[int, int]:
    """The last Saturday and Sunday that are over."""
    saturday = today - 8 * DAY if (today // DAY + 4) % 7 == 0 else _weekday("saturday", today)[0]
    return saturday, saturday + 2 * DAY - 1


def _year(word: str) -> int | None:
    n = _integer(word)
    return n if n is not None and 1970 <= n <= 2200 else None


def _from_to(first: tuple[int, int], after: tuple[int, int]) -> tuple[int, int]:
    low, high = (grammar.date(f"{y}-{m}-1") for y, m in (first, after))
    return low, high - 1


def _month(year: int, month: int) -> tuple[int, int]:
    return _from_to((year, month), (year + month // 12, month % 12 + 1))


def calendar(text: str, today: int) -> tuple[int, int] | None:
    """First and last second of a month, year, month of a year or day of a month; without a year the last one that has begun."""
    now = datetime.date(1970, 1, 1) + datetime.timedelta(days=today // DAY)
    words = text.split()
    if len(words) == 1:
        if month := _MONTH_OF.get(words[0]):
            return _month(now.year - (month > now.month), month)
        year = _year(words[0])
        return None if year is None else _from_to((year, 1), (year + 1, 1))
    if len(words) != 2:
        return None
    at = next((i for i, w in enumerate(words) if w in _MONTH_OF), None)
    if at is None:
        return None
    month, other = _MONTH_OF[words[at]], words[1 - at]
    if at == 0 and (year := _year(other)):
        return _month(year, month)
    day = _DAY.fullmatch(other)
    if not day or not 1 <= int(day[1]) <= 31:
        return None
    starts = [grammar.date(f"{y}-{month}-{int(day[1])}") for y in (now.year, now.year - 1)]
    start = starts[0] if starts[0] <= today else starts[1]
    rolled = (datetime.date(1970, 1, 1) + datetime.timedelta(days=start // DAY)).month != month
    return None if rolled else (start, start + DAY - 1)


def _relative(phrase: str, now: int) -> tuple[int, int | None] | None:
    """Bounds of a fixed phrase; no upper one if it lasts until now."""
    today = now // DAY * DAY
    if phrase in TODAY:
        return today, None
    if days := RECENT.get(phrase):
        return now - days * DAY, None
    if days := BEFORE.get(phrase):
        return now - 2 * days * DAY, now - days * DAY
    return {"yesterday": (today - DAY, today - 1), "last weekend": _weekend(today)}.get(phrase)


def _dated(text: str, now: int) -> tuple[int, int] | None:
    """First and last second of what since, before and after can name."""
    today = now // DAY * DAY
    if span := _relative(text, now):
        return span[0], now if span[1] is None else span[1]
    return _weekday(text.removeprefix("last "), today) or calendar(text, today)


def _since(low: int) -> Filter:
    return Filter("modified", ">=", low)


def _within(span: tuple[int, int] | None) -> Filter | None:
    return span and Filter("modified", "range", *span)


def time_phrase(phrase: str, now: int) -> Filter | None:
    today = now // DAY * DAY
    if span := _relative(phrase, now):
        return _since(span[0]) if span[1] is None else _within(span)
    if phrase.endswith(" ago"):
        n, unit = spoken_span(phrase.removesuffix(" ago")) or (None, 0)
        if n is not None and (far := _times(unit, n + 1)) is not None:
            return _within((now - far, now - unit * max(n - 1, 0)))
    lead, _, rest = phrase.partition(" ")
    match lead:
        case "past" | "last" | "within" if (length := _seconds(rest)) is not None:
            return _since(now - length)
        case "last":
            return _within(_weekday(rest, today))
        case "since" | "before" | "after":
            span = _dated(rest, now)
            made = {"since": (">=", 0), "before": ("<", 0), "after": (">", 1)}[lead]
            return span and Filter("modified", made[0], span[made[1]])
        case "in" | "from" | "during" | "on":  # names of days, months and years alone are text
            return _within(_weekday(rest, today) or calendar(rest, today))
    return None


# --- expansion ------------------------------------------------------------------------------------------------------------------------------


def lookup(phrase: str, now: int) -> Filter | None:
    """What a phrase in small letters means as a whole: kinds, extensions, sizes, ages, times, in this order."""
    if kind := _KIND_OF.get(phrase):
        return Filter("kind", "=", kind)
    if extension := extension_word(phrase):
        return Filter("ext", "=", extension)
    if phrase in NAMED_SIZES:
        return Filter("size", *NAMED_SIZES[phrase])
    if (led := _LED.fullmatch(phrase)) and (n := spoken_size(led[2])) is not None:
        return Filter("size", SIZE_LEADS[led[1]], n)
    word, than, rest = phrase.partition(" than ")
    if than and word in ("older", "newer") and (age := _seconds(rest)) is not None:
        return Filter("modified", "<" if word == "older" else ">", now - age)
    return time_phrase(phrase, now)


def _longest(words: list[str], at: int, now: int) -> tuple[int, Filter] | None:
    ends = range(min(at + LONGEST, len(words)), at, -1)
    return next(((end, f) for end in ends if (f := lookup(lower(" ".join(words[at:end])), now))), None)


def _segments(words: list[str], now: int):
    """Words, and phrases where some begin, in order. Words with a colon are never parts of one found, and what follows a comparison that can't be read stays text."""
    at = 0
    while at < len(words):
        found = None if ":" in words[at] else _longest(words, at, now)
        if found:
            yield Phrase(" ".join(words[at : found[0]]), found[1])
            at = found[0]
            continue
        compared = lower(words[at]) in COMPARATIVES and at + 1 < len(words) and lower(words[at + 1]) == "than"
        step = 3 if compared else 1
        yield from words[at : at + step]
        at += step


def expand(raw: str, now: int, described: bool = False) -> Expansion:
    """The text that is left of ``raw`` and its phrases. One word alone is a name, unless the words describe what a verb acts on.
    Fillers go where their run touches a phrase, and at the end if there is any phrase."""
    words = raw.split()
    parts = list(_segments(words, now))
    if len(words) == 1 and not described:
        parts = words
    found = tuple(p for p in parts if isinstance(p, Phrase))
    runs = [list(run) for _, run in itertools.groupby(parts, lambda p: "phrase" if isinstance(p, Phrase) else "filler" if lower(p) in FILLERS else "text")]
    text = []
    for i, run in enumerate(runs):
        if isinstance(run[0], Phrase):
            text += ["screenshot" for p in run if lower(p.source) in ("screenshot", "screenshots")]  # images named like one
        elif lower(run[0]) not in FILLERS:
            text += run
        else:
            beside = [r[0] for r in (runs[i - 1 : i] + runs[i + 1 : i + 2])]
            if not (any(isinstance(p, Phrase) for p in beside) or (found and i + 1 == len(runs))):
                text += run
    return Expansion(" ".join(text), found)


def without_phrase(raw: str, source: str) -> str:
    """``raw`` without the first run of words that are ``source`` in any letter case of A to Z."""
    words, wanted = raw.split(), lower(source).split()
    if not wanted:
        return raw.strip()
    starts = (i for i in range(len(words) - len(wanted) + 1) if [lower(w) for w in words[i : i + len(wanted)]] == wanted)
    at = next(starts, len(words))
    return " ".join(words[:at] + words[at + len(wanted) :])


def searched(raw: str, now: int, described: bool = False) -> grammar.Query:
    """Filters typed as key:value and those of phrases, each once, and the text that is left."""
    typed = grammar.parsed(raw, now)
    spoken = expand(typed.text, now, described)
    return grammar.Query(spoken.text, tuple(dict.fromkeys(typed.filters + spoken.filters)))
