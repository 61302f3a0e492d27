"""Functions of file names: folding, word starts, tiers, kinds, edits."""

from __future__ import annotations

import datetime
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The extensions of each kind and of each family, which decide results.
KINDS = {
    "Image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif", "ico"),
    "Video": ("mp4", "mkv", "mov", "avi", "webm", "m4v"),
    "Audio": ("mp3", "wav", "flac", "ogg", "m4a", "aac", "opus"),
    "Archive": ("zip", "tar", "gz", "bz2", "xz", "zst", "7z", "rar", "dmg", "iso"),
    "Code": ("rs", "py", "js", "ts", "tsx", "jsx", "c", "h", "cpp", "hpp", "go", "java", "rb", "sh", "swift", "kt", "toml", "yaml", "yml", "json", "html", "css", "sql"),
    "Document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "rtf"),
}
FAMILIES = {
    "Text": ("txt", "md", "markdown", "rtf", "doc", "docx", "odt", "pages", "tex", "log", "epub"),
    "PDF": ("pdf",),
    "Spreadsheet": ("xls", "xlsx", "xlsm", "csv", "tsv", "ods", "numbers"),
    "Presentation": ("ppt", "pptx", "odp", "key"),
    "Image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif", "ico", "heic", "heif", "avif", "svg", "raw", "cr2", "nef", "dng", "psd"),
    "Video": ("mp4", "mkv", "mov", "avi", "webm", "m4v", "wmv", "flv", "mpg", "mpeg"),
    "Audio": ("mp3", "wav", "flac", "ogg", "m4a", "aac", "opus", "aiff", "wma", "mid", "midi"),
    "Archive": ("zip", "tar", "gz", "tgz", "bz2", "xz", "zst", "7z", "rar", "lz4"),
    "Code": ("rs", "py", "js", "mjs", "ts", "tsx", "jsx", "c", "h", "cc", "cpp", "hpp", "cs", "go", "java", "rb", "php", "sh", "bash", "zsh", "ps1", "swift", "kt", "lua", "toml", "yaml", "yml", "json", "xml", "html", "css", "scss", "sql", "ini", "cfg"),
    "Font": ("ttf", "otf", "woff", "woff2", "ttc"),
    "App": ("exe", "msi", "msix", "appx", "app", "dmg", "pkg", "deb", "rpm", "appimage", "apk", "iso", "bat", "cmd"),
}
TIERS = ("exact", "prefix", "boundary", "substring", "fuzzy")
#: Starts of words within a name: the first character, an alphanumeric one after another kind, a capital after a small letter, and a capital that ends an acronym.
_STARTS = r"(?s)(?:^.|(?<![\p{IsAlphabetic}\p{N}])[\p{IsAlphabetic}\p{N}]|(?<=\p{IsLowercase})\p{IsUppercase}|(?<=\p{IsUppercase})\p{IsUppercase}(?=\p{IsLowercase}))"


@pandas_udf(T.StringType())
def _full_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()))


@pandas_udf(T.StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()))


def fold_text(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def fold(name: Column, ascii_only: bool = False) -> Column:
    """Full case folding within NFC; names of ASCII alone are lower-cased, and go to Python as nulls. ``ascii_only`` promises that there are no others."""
    beyond = name.rlike(r"[^\x00-\x7F]")
    return F.lower(name) if ascii_only else F.when(beyond, _full_fold(F.when(beyond, name))).otherwise(F.lower(name))


def word_parts(name: Column) -> Column:
    """A name cut at the starts of its words."""
    return F.filter(F.split(F.regexp_replace(name, _STARTS, "\x00$0"), "\x00"), lambda p: p != "")


_STARTS_HERE = regex.compile(_STARTS.replace("{Is", "{"))


def _tier_beyond_ascii(needle: str):
    """Tiers of names with other letters, whose words are folded like the name."""

    def one(name: str | None) -> int | None:
        if name is None:
            return None
        folded = fold_text(name)
        if folded == needle:
            return 0
        if folded.startswith(needle):
            return 1
        if needle not in folded:
            return None
        return 2 if any(fold_text(name[m.start() :]).startswith(needle) for m in _STARTS_HERE.finditer(name)) else 3

    @pandas_udf(T.IntegerType())
    def tier(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore").astype("Int32")

    return tier


def tier(name: Column, needle: str, ascii_only: bool = False) -> Column:
    """0 exact, 1 prefix, 2 at the start of a word, 3 anywhere, null: not in it; an empty needle is anywhere in all names. Names of ASCII alone stay in the JVM."""
    needle = fold_text(needle)
    if not needle:
        return F.lit(3)
    folded = F.lower(name)
    parts = word_parts(name)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.lower(F.array_join(F.slice(parts, i, F.size(parts)), "")))
    at_word = F.when(F.size(parts) > 0, F.exists(starts, lambda x: F.startswith(x, F.lit(needle)))).otherwise(F.lit(False))
    plain = F.when(folded.contains(needle), F.when(folded == needle, 0).when(folded.startswith(needle), 1).otherwise(F.when(at_word, 2).otherwise(3)))
    if ascii_only:
        return plain
    beyond = name.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, _tier_beyond_ascii(needle)(F.when(beyond, name))).otherwise(plain)


def fuzzy_words(folded: Column) -> Column:
    """The words of a folded name: runs of letters and digits."""
    return F.filter(F.split(folded, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def fuzzy_keys(name: Column, ascii_only: bool = False) -> Column:
    """The keys by which names that resemble a needle are found: a: and the first characters of 2 to 12 words before the last dot; d: and each word of 3 to 24 characters, and
    that less any one character."""
    stem = F.regexp_replace(name, r"(?s)\.[^.]*$", "")
    firsts = F.filter(F.transform(word_parts(stem), lambda p: F.substring(p, 1, 1)), lambda c: c.rlike(r"[\p{IsAlphabetic}\p{N}]"))
    acronym = F.when(F.size(firsts) >= 2, F.concat(F.lit("a:"), fold(F.array_join(F.slice(firsts, 1, 12), ""), ascii_only)))
    words = F.filter(fuzzy_words(fold(name, ascii_only)), lambda w: F.length(w).between(3, 24))
    near = F.flatten(F.transform(words, lambda w: F.transform(F.array_union(F.array(w), deletions(w)), lambda x: F.concat(F.lit("d:"), x))))
    return F.array_distinct(F.concat(F.array_compact(F.array(acronym)), near))


def resembles(name: Column, needle: str, ascii_only: bool = False) -> Column:
    """Whether a name has the needle, of 2 to 24 characters, as its acronym, or shares a key with it and has a word at most one edit from it."""
    needle = fold_text(needle)
    if not 2 <= len(needle) <= 24:
        return F.lit(False)
    keys = fuzzy_keys(name, ascii_only)
    wanted = sorted({"d:" + needle, *("d:" + needle[:i] + needle[i + 1 :] for i in range(len(needle)))})
    near = F.arrays_overlap(keys, F.lit(wanted)) & F.exists(fuzzy_words(fold(name, ascii_only)), lambda w: one_edit(w, F.lit(needle)))
    return F.array_contains(keys, "a:" + needle) | near


def extension_after_dot(name: Column) -> Column:
    """What follows the last dot, also of a dot file, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(?s)\.([^.]*)$", 1))


def extension(name: Column) -> Column:
    """The extension proper, in lower case: null for names without a dot and for dot files."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)))


def kind(name: Column, is_dir: Column) -> Column:
    out = F.when(is_dir, "Directory")
    for k, extensions in KINDS.items():
        out = out.when(extension_after_dot(name).isin(*extensions), k)
    return out.otherwise("Other")


def family(name: Column) -> Column:
    """The family of a file name that has both a stem and an extension; File for all others."""
    ext = F.when(name.rlike(r"(?s)^.+\.[^.]+$"), extension_after_dot(name))
    out = F.when(ext.isNull(), "File")
    for k, extensions in FAMILIES.items():
        out = out.when(ext.isin(*extensions), k)
    return out.otherwise("File")


def deletions(word: Column) -> Column:
    """All words with one character less."""
    return F.when(F.length(word) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))).otherwise(F.array().cast("array<string>"))


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion or substitution apart; a swap is two."""
    return F.levenshtein(a, b, 1) >= 0


def swaps_distance(a: str, b: str, limit: int) -> int:
    """Edits with swaps of neighbours as one (optimal string alignment), ASCII case ignored, at most limit + 1."""
    a, b = a.lower(), b.lower()
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    last, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return min(row[-1], limit + 1)


def swaps_distance_to(word: str, limit: int):
    @pandas_udf(T.IntegerType())
    def distance(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else swaps_distance(x, word, limit)).astype("Int32")

    return distance


def path_under(path: Column, scope: str) -> Column:
    """Component-wise prefix; the scope itself is under it."""
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")


def glob(name: Column, pattern: str) -> Column:
    """Case-insensitive match of the whole name, with * and ?."""
    if pattern in ("*", "*.*"):
        return F.lit(True)
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return name.ilike(like)


def format_size(n: Column) -> Column:
    """Bytes as they are, then one decimal in steps of 1024. Halves of a tenth go to the even tenth; format_string alone takes them up."""

    def tenths(i: int, unit: str) -> Column:
        value = n / float(1024**i)
        return F.format_string("%.1f " + unit, F.floor(value) + F.rint(value % 1 * 10) / 10)

    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (i + 1), tenths(i, unit))
    return out.otherwise(tenths(4, "TB"))


def bits(n: Column) -> Column:
    """The bit length of a number, 0 for 0."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def day(seconds: Column) -> Column:
    return F.floor(seconds / 86400).cast("long")


def seconds(time: Column) -> Column:
    """Unix seconds, with fractions, of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz")) / 1e6


def scrubbed(text: Column, home: str) -> Column:
    """The home folder as ~, and words that are absolute paths as <path>, whole: words are what single spaces part in each line; quotes, parentheses and commas around
    one don't count. Paths have a drive letter, or two parts or more."""
    lines = F.split(F.replace(text, F.lit(home), F.lit("~")), "\r?\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    path = lambda w: F.btrim(w, F.lit("\"'`(),")).rlike(r"(?s)^(?:[A-Za-z]:[\\/]|/[^/]*/)")
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(F.split(line, " "), lambda w: F.when(path(w), "<path>").otherwise(w)), " ")), "\n")


def extension_label(name: Column) -> Column:
    """The first four characters of the extension as capitals."""
    return F.upper(F.substring(extension(name), 1, 4))


def format_modified(t: Column, now: int) -> Column:
    """How long ago a time in seconds was, in words, UTC; a dash where it is unknown."""
    then = F.timestamp_seconds(t)
    days = F.lit(now // 86400) - day(t)
    this_year = F.date_format(then, "yyyy") == F.lit(datetime.datetime.fromtimestamp(now, datetime.UTC).strftime("%Y"))
    out = F.when(t.isNull(), "\u2014").when(F.lit(now) - t < 60, "Just now").when(days == 0, F.concat(F.lit("Today at "), F.date_format(then, "h:mm a")))
    return out.when(days == 1, "Yesterday").when(days < 7, F.date_format(then, "EEEE")).when(this_year, F.date_format(then, "MMM d")).otherwise(F.date_format(then, "MMM d, yyyy"))


def format_timestamp(t: Column, day_first: bool = False) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(t), "d MMM yyyy 'at' h:mm a" if day_first else "MMM d, yyyy 'at' h:mm a"), F.lit("\u2014"))


def bucket(name: Column, mtime: Column, by: str) -> Column:
    """The folder that organizing by kind, extension, month or year puts a file in."""
    if by == "kind":
        plural = {"Image": "Images", "Video": "Videos", "Archive": "Archives", "Document": "Documents", "Directory": "Other"}
        out = kind(name, F.lit(False))
        return F.coalesce(F.create_map(*[F.lit(x) for kv in plural.items() for x in kv])[out], out)
    if by == "extension":
        return F.coalesce(F.upper(extension(name)), F.lit("No extension"))
    when = F.date_format(F.date_from_unix_date(day(mtime).cast("int")), {"month": "yyyy-MM", "year": "yyyy"}[by])
    return F.when(mtime >= 0, when).otherwise("Undated")


def valid_file_name(name: Column) -> Column:
    return (name != "") & ~name.rlike(r"[/\\]") & ~name.isin(".", "..")


def nearest(word: str, vocabulary: list[str]) -> str | None:
    """The one word of a vocabulary within one edit, two from eight characters on, that is closest. Of several only one that alone begins with the same letter; none where the
    word itself is there."""
    limit = 2 if len(word) >= 8 else 1
    far = {v: swaps_distance(word, v, limit) for v in dict.fromkeys(vocabulary) if abs(len(v) - len(word)) <= limit}
    least = min(far.values(), default=limit + 1)
    if not 0 < least <= limit:
        return None
    close = [v for v, d in far.items() if d == least]
    same = [v for v in close if v[:1].lower() == word[:1].lower()]
    return close[0] if len(close) == 1 else same[0] if len(same) == 1 else None


def nearest_of(vocabulary: list[str]):
    """``nearest`` on a column, for a vocabulary of a grammar's size; give it distinct words."""

    @pandas_udf(T.StringType())
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else nearest(x, vocabulary))

    return found


# Descriptions of extensions and the names of plain texts that have none, which decide results.
DESCRIPTIONS = {
    "md": "Markdown", "txt": "Plain Text", "rs": "Rust Source", "py": "Python Source", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "json": "JSON", "toml": "TOML", "yaml": "YAML", "yml": "YAML", "html": "HTML", "css": "CSS", "sh": "Shell Script", "lock": "Lock File", "pdf": "PDF Document",
}
PLAIN_TEXTS = ("LICENSE", "LICENCE", "README", "CHANGELOG", "AUTHORS", "NOTICE", "COPYING")


def described(name: Column, is_dir: Column) -> Column:
    """What a record is, in words."""
    has = name.rlike(r"(?s)^.+\.[^.]*$")
    ext = F.lower(F.regexp_extract(name, r"(?s)\.([^.]*)$", 1))
    plain = F.upper(F.regexp_extract(name, "(?s)^([^-_]*)", 1)).isin(*PLAIN_TEXTS)
    known = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])[ext]
    words = F.create_map(*[F.lit(x) for kv in {"Image": "Image", "Video": "Video", "Audio": "Audio", "Archive": "Archive", "Code": "Source", "Document": "Document"}.items() for x in kv])
    other = F.concat_ws(" ", F.upper(ext), F.coalesce(words[kind(F.concat(F.lit("x."), ext), F.lit(False))], F.lit("File")))
    return F.when(is_dir, "Folder").when(~has, F.when(plain, "Plain Text").otherwise("File")).otherwise(F.coalesce(known, other))


def weekday(day_number: Column) -> Column:
    """0 on Sundays, of days since 1970."""
    return F.pmod(day_number + 4, F.lit(7))


def previous_weekday(day_number: Column, wanted: int) -> Column:
    """The last day of that name before a day; a week before a day of the name itself."""
    return day_number - 1 - F.pmod(weekday(day_number) - wanted - 1, F.lit(7))


def last_weekend(day_number: Column) -> Column:
    """The Saturday of the last weekend that is over."""
    return F.when(weekday(day_number) == 0, day_number - 8).otherwise(previous_weekday(day_number, 6))


def used_fraction(total: Column, free: Column) -> Column:
    """The used part of a volume; 0 where its size is 0 or unknown."""
    return F.coalesce(F.when(total > 0, F.greatest(total - free, F.lit(0)) / total), F.lit(0.0)).cast("float")
