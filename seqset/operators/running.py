"""Running values along ordered sequences, split so that no sequence is one task.

A sequence is the set of rows that share the `seq` columns, read in the order of
the `order` columns. Sequences of ordinary length are one window partition. A
sequence with more than `rows` rows is cut into chunks of neighbouring rows:
windows run inside the chunks, and one small row per chunk carries the value that
the earlier chunks hand on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqset.operators.skew import ROWS_PER_TASK, names, null_safe_left
from seqset.session import passing, saved

CHUNK = "_chunk"
# bits for the ranges of a chunk that is cut again, so that a session that makes more of them than asked for keeps their order
_LEAST_BITS = 12


@dataclass(frozen=True)
class Ordered:
    """Rows with their sequence and order columns; `split` if any chunk was cut."""

    frame: DataFrame
    seq: list[str]
    order: list[str]
    split: bool

    @property
    def keys(self) -> list[str]:
        return [*self.seq, CHUNK] if self.split else self.seq

    def with_column(self, name: str, value: Column) -> Ordered:
        return replace(self, frame=self.frame.withColumn(name, value))

    def done(self) -> DataFrame:
        return self.frame.drop(CHUNK)


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is last, first, sum, min or max."""

    kind: str
    value: Column


def _same(left: DataFrame, renamed: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return condition


def _of(df: DataFrame, found: list[Row], keys: list[str], how: str) -> DataFrame:
    """The rows of the found keys (left_semi) or the others (left_anti); Spark sees the size of the list."""
    listed = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found], df.select(*keys).schema)
    renamed = listed.toDF(*[f"_r_{k}" for k in keys])
    return df.join(renamed, _same(df, renamed, keys), how)


def _ranges(df: DataFrame, parts: int, by: list[str], chunk: Column) -> DataFrame:
    """The rows range-partitioned by sampled splitters of all columns `by`, each with its range's number, written."""
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    numbered = df.repartitionByRange(parts, *by).withColumn(CHUNK, chunk + F.spark_partition_id() + 1)
    back = saved(numbered.drop(*void)).withColumns({c: F.lit(None) for c in void})
    return back.select(*numbered.columns)


def _longer(df: DataFrame, keys: list[str], rows: int) -> list[Row]:
    with passing(df.sparkSession):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).collect()


def ordered(
    df: DataFrame,
    seq: str | Sequence[str],
    order: str | Sequence[str],
    rows: int | None = ROWS_PER_TASK,
) -> Ordered:
    """Find sequences with more than `rows` rows and cut them into chunks.

    With `rows` None nothing is looked for: the caller knows the sequences to be
    short, because each was made from one text cell.

    Long sequences are range-partitioned by splitters that Spark samples from the
    sequence and all order columns together, so any type that can be sorted cuts,
    and a column cuts where those before it are equal. Their rows are written with
    the number of their range, as other samples would give other ranges. Ranges are
    then counted exactly; one of more than `2 * rows` rows is cut again, unless more
    than `rows` of its rows are equal in every order column and at most `2 * rows`
    are not. Equal rows have no order among themselves and stay together.
    Of the sequences only keys and counts of long groups reach the driver, at most
    `count(df) / rows`, and Spark's sample of the order columns.
    """
    seq, order = names(seq), names(order)
    whole = df.withColumn(CHUNK, F.lit(0).cast("bigint"))
    found = [] if rows is None else _longer(df, seq, rows)
    if not found:
        return Ordered(whole, seq, order, False)
    keys, by = [*seq, CHUNK], [*seq, *order]
    parts = -(-sum(r["_n"] for r in found) // rows)
    bits = parts.bit_length()
    pieces = [_of(whole, found, seq, "left_anti"), _ranges(_of(whole, found, seq, "left_semi"), parts, by, F.col(CHUNK))]
    while over := _longer(pieces[-1], keys, 2 * rows):
        ties = _of(pieces[-1], over, keys, "left_semi").groupBy(*keys, *[c for c in order if c not in keys]).agg(F.count(F.lit(1)).alias("_n"))
        mixed = ties.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.max("_n").alias("_equal"))
        over = mixed.filter((F.col("_equal") <= rows) | (F.col("_n") - F.col("_equal") > 2 * rows)).collect()
        parts = -(-sum(r["_n"] for r in over) // rows)
        width = max(_LEAST_BITS, (parts + 1).bit_length())
        bits += width
        if not over or bits > 62:  # number after number, coarse before fine, in one long
            break
        again = _of(pieces[-1], over, keys, "left_semi")
        pieces[-1] = _of(pieces[-1], over, keys, "left_anti")
        step = 1 << width
        pieces = [p.withColumn(CHUNK, F.col(CHUNK) * step) for p in pieces]
        pieces.append(_ranges(again, parts, by, F.col(CHUNK) * step))
    return Ordered(reduce(DataFrame.unionByName, pieces), seq, order, True)


def _sorted_by(columns: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in columns]


def _carried(o: Ordered, totals: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """One row per chunk of the cut sequences: totals, then values handed on.

    Written, so that Spark knows the size and broadcasts only what is small.
    """
    per_chunk = o.frame.filter(F.col(CHUNK) > 0).groupBy(*o.keys).agg(
        *[value.alias(name) for name, value in totals.items()]
    )
    handed = per_chunk.select(*o.keys, *[value.alias(name) for name, value in before.items()])
    return saved(handed)


def running(
    o: Ordered, reverse: bool = False, strict: bool = False, **columns: Running
) -> Ordered:
    """Add running values up to each row, or up to the row before if `strict`.

    `reverse` runs from the end of the sequence to its start.
    """
    last_row = -1 if strict else 0
    inside = (
        Window.partitionBy(*o.keys)
        .orderBy(*_sorted_by(o.order, reverse))
        .rowsBetween(Window.unboundedPreceding, last_row)
    )
    over = {
        "last": lambda v: F.last(v, ignorenulls=True),
        "first": lambda v: F.first(v, ignorenulls=True),
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
    }
    local = o.frame.withColumns(
        {
            name: F.coalesce(F.sum(c.value).over(inside), F.lit(0)) if c.kind == "sum"
            else over[c.kind](c.value).over(inside)
            for name, c in columns.items()
        }
    )
    if not o.split:
        return replace(o, frame=local)

    at = F.struct(*o.order)
    nearest, farthest = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    whole = {
        "last": lambda v: nearest(v, F.when(v.isNotNull(), at)),
        "first": lambda v: farthest(v, F.when(v.isNotNull(), at)),
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
    }
    earlier = (
        Window.partitionBy(*o.seq)
        .orderBy(*_sorted_by([CHUNK], reverse))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = _carried(
        o,
        {f"_t_{name}": whole[c.kind](c.value) for name, c in columns.items()},
        {f"_c_{name}": over[c.kind](F.col(f"_t_{name}")).over(earlier) for name, c in columns.items()},
    )
    joined = null_safe_left(local, carry, o.keys)
    combine = {
        "last": lambda here, before: F.coalesce(here, before),
        "first": lambda here, before: F.coalesce(before, here),
        "sum": lambda here, before: here + F.coalesce(before, F.lit(0)),
        "min": lambda here, before: F.least(here, before),
        "max": lambda here, before: F.greatest(here, before),
    }
    merged = joined.withColumns(
        {name: combine[c.kind](F.col(name), F.col(f"_c_{name}")) for name, c in columns.items()}
    ).drop(*[f"_c_{name}" for name in columns])
    return replace(o, frame=merged)


def following(o: Ordered, name: str, value: Column) -> Ordered:
    """Add the value of the next row of the sequence, null at its end."""
    held = F.struct(value.alias("v"))
    inside = Window.partitionBy(*o.keys).orderBy(*_sorted_by(o.order, False))
    local = o.frame.withColumn(name, F.lead(held).over(inside))
    if o.split:
        chunks = Window.partitionBy(*o.seq).orderBy(CHUNK)
        carry = _carried(
            o,
            {"_first": F.min_by(held, F.struct(*o.order))},
            {"_next": F.lead("_first").over(chunks)},
        )
        local = null_safe_left(local, carry, o.keys)
        local = local.withColumn(name, F.coalesce(name, "_next")).drop("_next")
    return replace(o, frame=local.withColumn(name, F.col(f"{name}.v")))


def latest(o: Ordered, name: str, value: Column, n: int) -> Ordered:
    """Add the values of the last `n` rows up to each row, nearest first."""
    held = F.struct(value.alias("v"))
    inside = (
        Window.partitionBy(*o.keys)
        .orderBy(*_sorted_by(o.order, False))
        .rowsBetween(-(n - 1), 0)
    )
    local = o.frame.withColumn(name, F.collect_list(held).over(inside))
    if o.split and n > 1:
        back = Window.partitionBy(*o.keys).orderBy(*_sorted_by(o.order, True))
        chunks = (
            Window.partitionBy(*o.seq).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        )
        tails = (
            o.frame.filter(F.col(CHUNK) > 0)
            .withColumn("_back", F.row_number().over(back))
            .filter(F.col("_back") < n)
            .groupBy(*o.keys)
            .agg(F.sort_array(F.collect_list(F.struct("_back", held.alias("h"))), asc=False).alias("_tail"))
            # a chunk has at least one row, so n - 1 chunks hold all that is needed
            .select(*o.keys, F.flatten(F.collect_list("_tail").over(chunks.rowsBetween(-(n - 1), -1))).alias("_tail"))
        )
        local = null_safe_left(local, saved(tails), o.keys)
        before = F.transform(F.coalesce("_tail", F.array().cast(tails.schema["_tail"].dataType)), lambda t: t["h"])
        both = F.concat(before, F.col(name))
        local = local.withColumn(name, both).drop("_tail")
    newest_first = F.transform(F.reverse(F.col(name)), lambda x: x["v"])
    return replace(o, frame=local.withColumn(name, F.slice(newest_first, 1, n)))


def attach(o: Ordered, per_sequence: DataFrame, how: str) -> Ordered:
    """Join one row per sequence to the rows of the sequence.

    The row of a cut sequence is repeated for each of its chunks, so the join
    key is as fine as the chunks.
    """
    right = per_sequence
    if o.split:
        chunks = o.frame.filter(F.col(CHUNK) > 0).groupBy(*o.seq).agg(F.collect_set(CHUNK).alias("_chunks"))
        one = F.array(F.lit(0).cast("bigint"))
        right = (
            null_safe_left(right, chunks, o.seq)
            .withColumn(CHUNK, F.explode(F.coalesce("_chunks", one)))
            .drop("_chunks")
        )
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in o.keys})
    joined = o.frame.join(renamed, _same(o.frame, renamed, o.keys), how)
    return replace(o, frame=joined.drop(*[f"_r_{k}" for k in o.keys]))
