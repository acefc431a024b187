"""Relative-path safety rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that are reserved on Windows, in any letter case.
RESERVED_NAMES = (
    "con", "prn", "aux", "nul",
    "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
)


def posix_path(path: Column) -> Column:
    """Backslashes to slashes, empty and ``.`` parts dropped; a leading slash is kept."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda part: ~part.isin("", "."))
    return F.concat(F.when(slashed.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(posix_path(path), "/"), lambda part: part != "")


def is_traversal(path: Column) -> Column:
    """Empty, absolute, or with a ``..`` part."""
    return (
        path.isNull()
        | (path == "")
        | posix_path(path).startswith("/")
        | F.array_contains(path_parts(path), "..")
    )


def _has_reserved_stem(part: Column) -> Column:
    return F.lower(F.substring_index(part, ".", 1)).isin(*RESERVED_NAMES)


def is_portable(path: Column) -> Column:
    """No part that another operating system would refuse to store."""
    return ~F.exists(
        path_parts(path),
        lambda part: part.rlike("[ .]$") | part.contains(":") | _has_reserved_stem(part),
    )


def is_windows_invalid(path: Column) -> Column:
    """Stricter rule used by the hygiene scan: also refuses ``< > : " | ? *``."""
    return F.exists(
        path_parts(path),
        lambda part: part.rlike(r'[ .]$|[<>:"|?*]') | _has_reserved_stem(part),
    )
