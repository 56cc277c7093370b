"""Patches: the files they change, and the rule that keeps a row by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankeval.functions.text import is_source

#: The reasons to drop a row.
NO_SOURCE, TOO_MANY = "no_source_files", "too_many_source_files"
MAX_FILES = 3


def changed_files(patch: Column | str) -> Column:
    """New paths of all diff headers, in order, repeats kept."""
    return F.regexp_extract_all(F.col(patch) if isinstance(patch, str) else patch, F.lit(r"(?md)^diff --git a/(.+?) b/(.+)$"), F.lit(2))


def source_files(files: Column) -> Column:
    return F.array_distinct(F.filter(files, is_source))


def drop_reason(files: Column, max_files: int = MAX_FILES) -> Column:
    """Null for rows that stay. files: distinct source files."""
    return F.when(F.size(files) == 0, NO_SOURCE).when(F.size(files) > max_files, TOO_MANY)
