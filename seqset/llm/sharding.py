"""Range shards of nearly equal bytes from sampled splitters.

Records are ordered by a hash of their text, so that equal texts lie together. A size-weighted sample of these
keys gives splitters at its quantiles, many for each shard. The exact bytes of every range are then counted,
and ranges in which a shard ends, or that are overfull, are divided further by new samples, until no shard
can miss its share by more than a small part. Only a text whose copies alone are heavy may be divided between shards;
its copies are then ordered by a hash of their id, and copies with one id by a number of their own.
"""

from __future__ import annotations

import bisect
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqset.llm.frames import per_batch, table
from seqset.session import saved

SHARDS = 16
#: Sampled keys of a round, and ranges per shard.
SAMPLE, RANGES = 8192, 32
#: Bytes of a shard, in parts of its share, that it may be off; copies of one text heavier than this are divided.
TOLERANCE = 0.01
#: About the bytes of a range in which records are numbered.
RANGE_BYTES = 256 << 20
SEED = 42


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.col(id_column), F.lit(SEED)).alias("id_hash"),
        # written with the row, so that it stays the same
        F.monotonically_increasing_id().alias("row"),
    )


def _with_key(rows: DataFrame, heavy: list[int], equal: list[int]) -> DataFrame:
    """The key as 48 hex digits: hash of the text; for heavy texts also hash of the id; for heavy pairs of both also hash of the row's number."""
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    inside = lambda c, some: c.isin(some) if some else F.lit(False)
    by_id = F.when(inside(F.col("text_hash"), heavy), hexed(F.col("id_hash"))).otherwise("0" * 16)
    by_row = F.when(inside(F.xxhash64("text_hash", "id_hash"), equal), hexed(F.xxhash64("row"))).otherwise("0" * 16)
    return rows.withColumn("key", F.concat(hexed(F.col("text_hash")), by_id, by_row))


def _ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """Rows with the number of their range: how many splitters lie at or below their key."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    @F.pandas_udf("bigint")
    def number(keys):
        bounds = np.array(shared.value, dtype="S48")
        return pd.Series(np.searchsorted(bounds, keys.to_numpy().astype("S48"), side="right"))

    return rows.withColumn("range", number("key"))


def _sampled(rows: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[str, float]]:
    """About `wanted` keys with weights, drawn by size: a record of `size` bytes is in with a chance in proportion to it."""
    dealt = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(1, total)))
    drawn = rows.where(dealt < chance).select("key", (F.col("size") / chance).alias("weight"))
    return [(r["key"], r["weight"]) for r in drawn.groupBy("key").agg(F.sum("weight").alias("weight")).collect()]


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys that cut a weighted sample into so many parts of equal weight."""
    sample = sorted(sample)
    sums = np.cumsum([w for _, w in sample])
    if not len(sums):
        return []
    at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
    return sorted({sample[k][0] for k in at})


def _bytes(rows: DataFrame, splitters: list[str]) -> np.ndarray:
    out = np.zeros(len(splitters) + 1, np.int64)
    for r in _ranged(rows, splitters).groupBy("range").agg(F.sum("size").alias("size")).collect():
        out[r["range"]] = r["size"]
    return out


def splitters_of(rows: DataFrame, shards: int) -> tuple[list[str], np.ndarray]:
    """Splitters of many ranges and the exact bytes of each; every shard can end close to its share at one of them.

    Ranges are divided until that holds, or until samples of what is still too wide give no new splitter: then its rows share one key.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = shards * RANGES + -(-total // RANGE_BYTES)
    splitters = _quantiles(_sampled(rows, total, max(SAMPLE, 16 * parts), SEED), parts)
    sizes = _bytes(rows, splitters)
    for round in count(1):
        # a range is overfull where a shard ends in it far from both its ends, or where it is much above the mean
        sums = np.concatenate([[0], np.cumsum(sizes)])
        wide = set(np.flatnonzero(sizes > 4 * total / max(1, parts)).tolist())
        for shard in range(1, shards):
            end = total * shard / shards
            k = int(np.searchsorted(sums, end)) - 1
            if k >= 0 and min(end - sums[k], sums[k + 1] - end) > TOLERANCE / 2 * total / shards:
                wide.add(k)
        if not wide:
            break
        inside = _ranged(rows, splitters).where(F.col("range").isin(sorted(wide)))
        weight = int(sum(sizes[k] for k in wide))
        more = _sampled(inside.drop("range"), weight, SAMPLE, SEED + round)
        groups: dict[int, list[tuple[str, float]]] = {}
        for key, w in more:
            groups.setdefault(bisect.bisect_right(splitters, key), []).append((key, w))
        new = {s for g in groups.values() for s in _quantiles(g, RANGES)} - set(splitters)
        if not new:
            break
        splitters = sorted(set(splitters) | new)
        sizes = _bytes(rows, splitters)
    return splitters, sizes


def shard_of_ranges(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each range: neighbours together, each shard ending at the range end nearest to its share."""
    sums = np.cumsum(sizes)
    total = sums[-1] if len(sums) else 0
    starts = sums - sizes
    ends = total * np.arange(1, shards) / shards
    # a range belongs behind a shard's end if it begins nearer to that end than its own end lies
    return np.searchsorted(ends, (starts + sums) / 2, side="right")


def shard_by_splitters(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row: shards of nearly equal bytes, slots gapless from 0 in each.

    Size is the UTF-8 bytes of the text and one more; a null text has none and counts as empty. Copies of a text share a
    shard unless they weigh more than TOLERANCE of a shard's share. Rows repeated in id and text share one key: they are
    never divided. Null ids are kept. Only the two named columns are read. The driver sees samples, splitters and the bytes
    of each range, of which there is one per RANGE_BYTES and a fixed number per shard. No rows give no rows.
    """
    rows = saved(_keyed(docs, id_column, text_column))
    total = rows.agg(F.sum("size")).first()[0] or 0
    much = F.col("size") > TOLERANCE * total / shards
    of_text = rows.groupBy("text_hash").agg(F.sum("size").alias("size")).where(much).select("text_hash")
    heavy = [r[0] for r in of_text.collect()]  # at most shards / TOLERANCE, and so below
    of_pair = rows.where(F.col("text_hash").isin(heavy)).groupBy("text_hash", "id_hash").agg(F.sum("size").alias("size")) if heavy else None
    equal = [r[0] for r in of_pair.where(much).select(F.xxhash64("text_hash", "id_hash")).collect()] if heavy else []
    keyed = _with_key(rows, heavy, equal)
    splitters, sizes = splitters_of(keyed, shards)
    shard = shard_of_ranges(sizes, shards)

    ranged = saved(_ranged(keyed, splitters))
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    bases, filled = np.zeros(len(sizes), np.int64), np.zeros(shards, np.int64)
    for k, s in enumerate(shard):
        bases[k] = filled[s]
        filled[s] += counts.get(k, 0)
    shared = docs.sparkSession.sparkContext.broadcast((shard.astype(np.int64), bases))

    in_range = Window.partitionBy("range").orderBy("key", "id_hash", "id", "row")
    numbered = ranged.withColumn("place", F.row_number().over(in_range) - 1)
    kind = docs.schema[id_column].dataType.simpleString()

    def placed(batch: pa.RecordBatch):
        where, base = shared.value
        k = np.asarray(batch["range"])
        slot = base[k] + np.asarray(batch["place"]) if len(k) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["size"], batch["text_crc32"], pa.array(where[k].astype(np.int32)), pa.array(slot.astype(np.int64))],
            ["id", "size", "text_crc32", "shard", "slot"],
        )

    return numbered.select("id", "size", "text_crc32", "range", F.col("place").cast("bigint").alias("place")).mapInArrow(
        per_batch(placed), f"id {kind}, size bigint, text_crc32 bigint, shard int, slot bigint"
    )


def op7_shard_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, by the law of equal bytes."""
    return shard_by_splitters(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
