"""Hot keys: finding them and splitting the work they cause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqset.session import passing

ROWS_PER_TASK = 4_000_000
"""Rows of one key that one task may handle; a key with more rows is split."""


def names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def apart(df: DataFrame) -> DataFrame:
    """The rows, for a join whose sides both grow with the data: it shuffles them and broadcasts neither.

    Spark's own size check takes the bytes of files. Sorted ids take a byte or less in a file and fifty as rows of a
    broadcast, and rows that an explode makes are not counted: millions of rows would pass through the driver.
    """
    return df.hint("merge")


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> dict[tuple, int]:
    """Keys with more than `rows` rows, and into how many pieces to split each.

    The result has at most `count(df) / rows` entries, which bounds what the
    driver holds and what callers broadcast.
    """
    with passing(df.sparkSession):
        heavy = (
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > rows)
            .collect()
        )
    return {tuple(r[:-1]): -(-r["_n"] // rows) for r in heavy}


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    hot_left: dict[tuple, int] | None = None,
    hot_right: dict[tuple, int] | None = None,
    large: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Equi-join that splits given hot keys of either side over several tasks.

    The rows of a hot key are dealt out by a hash of the whole row, and the
    matching rows of the other side are repeated once per piece. Hot keys come from
    `hot_keys`, best of a table that is read anyway and has at least as many rows
    per key as the input. With `large` neither side is broadcast (see `apart`). `how` is inner, or left
    if no key of the right side is hot: rows of the left side are then never repeated.
    """
    if how != "inner" and hot_right:
        raise ValueError("a left join cannot split hot keys of its right side")
    on = names(on)
    hot_left, hot_right = hot_left or {}, hot_right or {}
    hot = {k for k in hot_left.keys() | hot_right.keys() if None not in k}
    if not hot:
        return (apart(left) if large else left).join(right, on, how)
    schema = left.select(*on).schema.add("_nl", "integer").add("_nr", "integer")
    pieces = F.broadcast(
        left.sparkSession.createDataFrame(
            [(*k, hot_left.get(k, 1), hot_right.get(k, 1)) for k in hot], schema
        )
    )

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        spread = [c for c in df.columns if "map" not in df.schema[c].dataType.simpleString()]
        return (
            df.join(pieces, on, "left")
            .withColumn(own, F.pmod(F.xxhash64(*spread), F.coalesce(n_own, F.lit(1))))
            .withColumn(
                other,
                F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1).cast("array<bigint>")),
            )
            .drop("_nl", "_nr")
        )

    dealt_left = dealt(left, "_l", "_nl", "_r", "_nr")
    joined = (apart(dealt_left) if large else dealt_left).join(
        dealt(right, "_r", "_nr", "_l", "_nl"), [*on, "_l", "_r"], how
    )
    return joined.drop("_l", "_r")


def null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null equals null; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])
