"""Requests written back as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the order in which sections are written.
SECTIONS = ("select", "from", "where", "group_by", "having", "order_by")


def render_from(containers: Column) -> Column:
    """`FROM a , b` from an array of names."""
    return F.concat(F.lit("FROM "), F.array_join(containers.cast("array<string>"), " , "))


def render_from_aliased(entries: Column) -> Column:
    """`FROM a AS x , b` from an array of (name, alias), alias null for none."""
    written = F.transform(entries, lambda e: F.concat_ws(" AS ", e["name"], e["alias"]))
    return F.concat(F.lit("FROM "), F.array_join(written, " , "))


def render_request(sections: Mapping[str, Column]) -> Column:
    """The sections in their fixed order, joined by blanks and closed by `;`."""
    known = [sections[s] for s in SECTIONS if s in sections]
    return F.concat_ws(" ", *known, F.lit(";"))
