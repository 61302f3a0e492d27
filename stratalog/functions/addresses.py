"""Addresses of shares, lines of mount tables and percent codes, as columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of mounts that are on other machines, which decide results.
NETWORK_TYPES = (
    "cifs", "smb3", "smbfs", "nfs", "nfs4", "afpfs", "webdav", "davfs", "fuse.sshfs", "fuse.rclone", "fuse.s3fs", "ceph", "glusterfs", "fuse.glusterfs", "afs",
)


def _bytes(first: Column, rest: Column) -> Column:
    """Binary of a text and of further pieces given in hex."""
    return F.unhex(F.concat(F.hex(F.encode(first, "UTF-8")), F.array_join(rest, "")))


def _hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def percent_encode(text: Column) -> Column:
    """All bytes but letters and digits of ASCII and - . _ ~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(text: Column) -> Column:
    """Null where a % has no two hex digits behind it or the bytes are not UTF-8; + stays."""
    parts = F.split(text, "%")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.substring(p, 1, 2), _hex(F.substr(p, F.lit(3)))))
    return F.when(~text.rlike("%(?![0-9A-Fa-f]{2})"), F.try_validate_utf8(_bytes(parts[0], rest).cast("string")))


def unescaped(field: Column) -> Column:
    r"""A mount table's field with its \ooo bytes; other backslashes stay, bytes that are not UTF-8 become U+FFFD."""
    parts = F.split(field, r"\\")
    octal = lambda p: F.lpad(F.conv(F.substring(p, 1, 3), 8, 16), 2, "0")
    piece = lambda p: F.when(p.rlike("^[0-3][0-7]{2}"), F.concat(octal(p), _hex(F.substr(p, F.lit(4))))).otherwise(F.concat(F.lit("5C"), _hex(p)))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.make_valid_utf8(_bytes(parts[0], rest).cast("string"))


def mounts(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Source, mount and type from columns line (number) and text: devices and network types; of lines with one mount point the first, in each table that the keys name.
    Lines of fewer than three fields give none."""
    fields = F.split(F.regexp_replace("text", r"^\s+", ""), r"\s+")
    found = lines.select(*keys, "line", fields.alias("f")).where("size(f) >= 3 and f[2] <> ''")
    kept = found.where(F.startswith(F.col("f")[0], F.lit("/dev/")) | F.col("f")[2].isin(*NETWORK_TYPES))
    rows = kept.select(*keys, unescaped(F.col("f")[1]).alias("mount"), F.struct("line", unescaped(F.col("f")[0]).alias("source"), F.col("f")[2].alias("type")).alias("x"))
    first = rows.groupBy(*keys, "mount").agg(F.min("x").alias("x"))
    return first.select(*keys, "x.line", "x.source", "mount", "x.type")


def _address(protocol: Column, user: Column, parts: Column, coded: Column, user_is_sound: Column | None = None) -> Column:
    """An address of a host and the pieces below it; null without a host, for smb without a share, or where a code is not sound."""
    code = lambda p: F.when(coded, percent_decode(p)).otherwise(p)
    host = code(F.get(parts, 0))
    below = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != ""), code)
    sound = (F.get(parts, 0) != "") & host.isNotNull() & ~F.exists(below, lambda p: p.isNull()) & ((protocol == "nfs") | (F.size(below) > 0)) & (F.lit(True) if user_is_sound is None else user_is_sound)
    return F.when(sound, F.struct(protocol.alias("protocol"), host.alias("host"), user.alias("user"), below.alias("segments")))


def share(text: Column) -> Column:
    r"""protocol, host, user and segments of \\server\share, smb://, cifs:// or nfs://; null for all else."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    unc = F.startswith(t, F.lit("\\\\")) & ~t.rlike(r"^\\\\[?.]\\")
    scheme, rest = F.lower(F.regexp_extract(t, "(?s)^(.*?)://(.*)$", 1)), F.regexp_extract(t, "(?s)^(.*?)://(.*)$", 2)
    authority = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(authority) + 2)
    coded = F.when(F.contains(authority, F.lit("@")), percent_decode(F.regexp_extract(authority, "(?s)^(.*)@[^@]*$", 1))).otherwise("")
    parts = F.concat(F.array(F.substring_index(authority, "@", -1)), F.split(path, "/"))
    windows = _address(F.lit("smb"), F.lit(None).cast("string"), F.split(F.substr(t, F.lit(3)), r"[\\/]"), F.lit(False))
    url = _address(F.when(scheme == "nfs", "nfs").otherwise("smb"), F.nullif(coded, F.lit("")), parts, F.lit(True), coded.isNotNull())
    return F.when(unc, windows).when(~F.startswith(t, F.lit("\\\\")) & scheme.isin("smb", "cifs", "nfs"), url)


def mounted_share(source: Column, kind: Column) -> Column:
    """The address in a mount's source: //[user@]server/share for smb types, server:/export for nfs; null for other types."""
    rest = F.substr(source, F.lit(3))
    before = F.substring_index(rest, "@", 1)
    has_user = F.contains(rest, F.lit("@")) & ~F.contains(before, F.lit("/"))
    user = F.when(has_user, F.substring_index(before, ";", -1))
    parts = F.split(F.when(has_user, F.substr(rest, F.length(before) + 2)).otherwise(rest), "/")
    host = F.regexp_replace(F.regexp_extract(source, "(?s)^(.*):/.*$", 1), r"^\[+|\]+$", "")
    export = F.split(F.regexp_extract(source, "(?s)^.*:/(.*)$", 1), "/")
    smb = F.when(F.startswith(source, F.lit("//")), _address(F.lit("smb"), user, parts, kind == "smbfs"))
    nfs = F.when(F.contains(source, F.lit(":/")), _address(F.lit("nfs"), F.lit(None).cast("string"), F.concat(F.array(host), export), F.lit(False)))
    return F.when(kind.isin("cifs", "smb3", "smbfs"), smb).when(kind.isin("nfs", "nfs4"), nfs)


def bookmarks(lines: DataFrame) -> DataFrame:
    """Local paths of bookmark lines (columns line and text, a coded file:// address and perhaps a label), each with its first line; other addresses and unsound codes give none."""
    path = percent_decode(F.regexp_extract("text", "^file://([^ ]*)", 1))
    found = lines.where(F.startswith("text", F.lit("file://"))).select("line", path.alias("path")).where("path is not null")
    return found.groupBy("path").agg(F.min("line").alias("line"))
