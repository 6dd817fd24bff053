"""Sorted lists of values in rows, cut into numbered parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqset.operators.running import Running, ordered, running
from seqset.operators.skew import ROWS_PER_TASK, names

PART_SIZE = 100_000


def collect_parts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    distinct: bool = True,
    part_size: int = PART_SIZE,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sorted list of values per key, cut into parts of `part_size` values.

    Rows are (keys…, part, values). The values of a key are numbered in order; number n is in part
    (n - 1) div `part_size`, so parts are neighbouring ranges, and all but the last are full. Repeats,
    kept unless `distinct`, are counted before anything is shuffled. Keys with very many values are
    numbered like any long sequence.
    """
    keys = names(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if distinct:
        counted = counted.withColumn("_n", F.lit(1).cast("bigint"))
    numbered = running(ordered(counted, keys, [value], rows), _upto=Running("sum", F.col("_n"))).done()
    size = F.lit(part_size)
    first, last = F.floor((F.col("_upto") - F.col("_n")) / size), F.floor((F.col("_upto") - 1) / size)
    each = numbered.withColumn("part", F.explode(F.sequence(first, last).cast("array<bigint>")))
    # of a repeated value, what lies in the part
    inside = F.least("_upto", (F.col("part") + 1) * size) - F.greatest(F.col("_upto") - F.col("_n"), F.col("part") * size)
    listed = F.flatten(F.collect_list(F.array_repeat(value, inside.cast("int"))))
    return each.groupBy(*keys, "part").agg(F.sort_array(listed).alias(name))
