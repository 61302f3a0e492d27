"""What an index leaves out below a root, and which new roots it takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of the system right under a root, which decide results.
SYSTEM_FOLDERS = ("proc", "sys", "dev", "run", "boot", "usr", "bin", "sbin", "lib", "lib64", "etc", "var", "opt", "srv")


def inside(path: str, root: str) -> bool:
    return (path.rstrip("/") + "/").startswith(root.rstrip("/") + "/")


def within(path: Column, root: str) -> Column:
    """Whether a path is a root or below it, by whole names."""
    return F.startswith(F.concat(F.rtrim(path, F.lit("/")), F.lit("/")), F.lit(root.rstrip("/") + "/"))


def excluded(path: Column, is_dir: Column, root: str, names=(), mounts=(), system=SYSTEM_FOLDERS) -> Column:
    """Whether a path below the root is left out: by its first name if that is a system folder's (ASCII case ignored), by a folder's name at any depth, or as a part of a network mount
    strictly below the root. A file may have a folder's name. Paths outside of the root and the root itself are never left out by name."""
    parts = F.filter(F.split(F.substr(path, F.lit(len(root.rstrip("/")) + 2)), "/"), lambda p: p != "")
    folders = F.when(is_dir, parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    first = F.translate(F.get(parts, 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.coalesce(first.isin(*[s.lower() for s in system]), F.lit(False)) | F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    out = within(path, root) & out
    for mount in mounts:
        if inside(mount, root) and not inside(root, mount):
            out = out | within(path, mount)
    return out


def overlaps(path: Column, roots: list[str]) -> Column:
    """Whether a new root holds one there is or lies in it."""
    mine = F.concat(F.rtrim(path, F.lit("/")), F.lit("/"))
    out = F.lit(False)
    for root in roots:
        out = out | within(path, root) | F.startswith(F.lit(root.rstrip("/") + "/"), mine)
    return out
