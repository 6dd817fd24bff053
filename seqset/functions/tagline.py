"""The text form of tags: `prefix DEL name SOH line,offset`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bytes that part a tag line and open a file section.
AFTER_PREFIX = "\u007f"
AFTER_NAME = "\u0001"
SECTION = "\u000c\n"


def format_tag(
    prefix: Column, name: Column, line: Column, offset: Column,
    scope: Column | None = None, separator: Column | None = None,
) -> Column:
    """One tag line; with `scope` the name is written with its scope in front."""
    full = name if scope is None else F.concat(scope, separator, name)
    return F.concat(
        F.coalesce(prefix, F.lit("")), F.lit(AFTER_PREFIX), full, F.lit(AFTER_NAME),
        line.cast("string"), F.lit(","), offset.cast("string"),
    )


def format_header(path: Column, chars: Column) -> Column:
    """The two lines that open the section of a file."""
    return F.concat(F.lit(SECTION), path, F.lit(","), chars.cast("string"))


def parse_tag(line: Column) -> dict[str, Column]:
    """Prefix and name (null if left out) and line number; null if it is no tag line."""
    pattern = "^([^\u007f]*)\u007f(?:([^\u0001]+)\u0001)?([0-9]+)"
    is_tag = F.rlike(line, F.lit(pattern))
    name = F.regexp_extract(line, pattern, 2)
    return {
        "prefix": F.when(is_tag, F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))),
        "name": F.when(is_tag & (name != ""), name),
        "line": F.when(is_tag, F.regexp_extract(line, pattern, 3)).cast("int"),
    }


def candidate_path(candidate: Column) -> Column:
    """The path of a `path:text` candidate."""
    return F.substring_index(candidate, ":", 1)


def candidate_text(candidate: Column) -> Column:
    """The text of a `path:text` candidate, null without one."""
    text = F.regexp_extract(candidate, "[^:]+:(.+)", 1)
    return F.when(text != "", text)
