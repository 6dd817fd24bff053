"""Mixing sources to target weights with Sainte-Laguë quotas of equal-token blocks.

Each source is dealt by a seeded hash into shards of bounded size, and its documents lie in each shard in a seeded
order, end to end. The words of a shard are cut into equal blocks. Blocks go to sources by highest quotients, then
to the shards of each source by highest quotients. A shard with quota q and n blocks is taken whole q div n times, and
q mod n more blocks from a seeded block on, around the end. As the order is random and the blocks are neighbours, only
the documents at both ends of that stretch are taken in part.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqset.llm.frames import free_name, table
from seqset.session import saved

#: Words of a block, and about the words of a shard.
BLOCK_WORDS, SHARD_WORDS = 16, 4_000_000
WEIGHTS = (5, 2, 1)
#: What the mix holds of all words, in percent, and how often a source may be taken at most.
SHARE_PERCENT, MOST_TIMES = 150, 2
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], percent: int = SHARE_PERCENT, times: int = MOST_TIMES) -> list[Fraction]:
    """Words wanted of each source: shares by weight; what exceeds `times` a source's size goes to the others by weight."""
    out = [Fraction(0)] * len(sizes)
    left, rest = Fraction(percent * sum(sizes), 100), set(range(len(sizes)))
    while rest:
        each = left / sum(weights[k] for k in rest)
        full = {k for k in rest if each * weights[k] > times * sizes[k]}
        if not full:
            for k in rest:
                out[k] = each * weights[k]
            break
        for k in full:
            out[k] = Fraction(times * sizes[k])
        left -= sum(out[k] for k in full)
        rest -= full
    return out


def sainte_lague(votes: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); nobody gets more than `most`, and equal quotients go to the first.

    The quotient below which no seat is won is found by bisection, so the work does not grow with the seats.
    """
    most = [m if v > 0 else 0 for m, v in zip(most, votes)]
    seats = min(seats, sum(most))

    def won(price: Fraction) -> list[int]:  # seats with a quotient of at least the price
        return [min(m, max(0, (math.floor(v / price) + 1) // 2)) for v, m in zip(votes, most)]

    if not seats:
        return [0] * len(votes)
    low, high = min(v for v in votes if v > 0) / (2 * max(most) + 1), 2 * max(votes)
    while sum(won(low)) - sum(won(high)) > len(votes):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(won(middle)) > seats else (low, middle)
    found = won(high)
    # what is left goes one by one: at most one seat for each vote, and equal quotients
    next_best = [(-v / (2 * n + 1), k) for k, (v, n, m) in enumerate(zip(votes, found, most)) if n < m]
    heapq.heapify(next_best)
    for _ in range(seats - sum(found)):
        _, k = heapq.heappop(next_best)
        found[k] += 1
        if found[k] < most[k]:
            heapq.heappush(next_best, (-votes[k] / (2 * found[k] + 1), k))
    return found


@dataclass
class _Shard:
    source: str | None
    shard: int
    size: int
    quota: int = 0

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK_WORDS)


def _sizes(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(text_column).alias("text_hash"),
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id, text_hash, source, size, source_size, target, taken, whole, first, last) per row of `docs`.

    `taken` counts words, repeats included: the document `whole` times, and its words from `first` to before
    `last` once more; where `last` is below `first`, those before `last` and those from `first` on. Sources rank by code point,
    null last, and weigh 5, 2, 1, repeating. A null text has no words and gives none; a source without words has
    target 0. Repeated rows count each. The order inside a shard is by a hash of id and text, then id and size, so
    that reruns agree. Only the three named columns are read. The driver sees one row per source and one per
    SHARD_WORDS words and rows. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = saved(_sizes(docs, id_column, text_column, source_column))
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sums]
    wanted = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sums))])

    # rows count too: very many empty texts are no one task
    shards = [max(1, -(-(r["size"] + r["rows"]) // SHARD_WORDS)) for r in sums]
    of_source = spark.createDataFrame(
        [(r["source"], s, float(t), n) for r, s, t, n in zip(sums, sizes, wanted, shards)],
        "of string, source_size bigint, target double, shards bigint",
    )
    order = F.xxhash64("id", "text_hash", F.lit(SEED))
    dealt = rows.join(of_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = dealt.withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")))
    found = dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect()
    by_source: dict[str | None, list[_Shard]] = {r["source"]: [] for r in sums}
    for r in sorted(found, key=lambda r: r["shard"]):
        by_source[r["source"]].append(_Shard(r["source"], r["shard"], r["size"]))

    most = [MOST_TIMES * sum(s.blocks for s in by_source[r["source"]]) for r in sums]
    seats = round(sum(wanted, Fraction(0)) / BLOCK_WORDS)
    for r, quota in zip(sums, sainte_lague(wanted, seats, most)):
        own = by_source[r["source"]]
        parts = sainte_lague([Fraction(s.size) for s in own], quota, [MOST_TIMES * s.blocks for s in own])
        for shard, part in zip(own, parts):
            shard.quota = part
    plan = spark.createDataFrame(
        [(s.source, s.shard, s.size, s.blocks, s.quota) for own in by_source.values() for s in own],
        "of string, at bigint, words bigint, blocks bigint, quota bigint",
    )

    # the stretch that is taken once more: [begin, end) in words of the shard, and [0, over) where it runs around the end
    block = F.lit(BLOCK_WORDS)
    start = F.pmod(F.xxhash64("source", "shard", F.lit(SEED)), F.greatest("blocks", F.lit(1)))
    extra = F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0)
    in_shard = Window.partitionBy("source", "shard").orderBy("order", "id", "size")
    placed = (
        dealt.withColumn("stop", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))
        .withColumn("whole", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("bigint"))
        .withColumn("begin", start * block)
        .withColumn("end", F.least((start + extra) * block, F.col("words")))
        .withColumn("over", F.greatest(start + extra - F.col("blocks"), F.lit(0)) * block)
        .withColumn("from", F.col("stop") - F.col("size"))
    )
    inside = lambda edge: F.greatest(F.lit(0), F.least(F.col("size"), F.col(edge) - F.col("from")))
    tail_first, tail_last, head = inside("begin"), inside("end"), inside("over")
    # only the document in which the stretch begins and ends at once has words of both
    both = (head > 0) & (tail_last > tail_first)
    return (
        placed.withColumn("first", F.when(both, tail_first).when(head > 0, 0).otherwise(tail_first).cast("bigint"))
        .withColumn("last", F.when(head > 0, head).otherwise(tail_last).cast("bigint"))
        .withColumn("part", (tail_last - tail_first + head).cast("bigint"))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
        .select("id", "text_hash", "source", "size", "source_size", "target", "taken", "whole", "first", "last", "part")
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of the mix, with the columns of `docs`: each document as often as it is taken whole, and its part.

    A part is its words joined by single spaces. Documents of which nothing is taken are not there.
    """
    names = {c: free_name(docs, f"mix_{c}") for c in ("id", "text_hash", "whole", "first", "last", "part", "size")}
    plan = mix(docs, id_column, text_column, source_column)
    # rows equal in id and text are alike: what is taken of them is listed, and each row takes one entry
    number = Window.partitionBy("id", "text_hash").orderBy("whole", "first", "last")
    plan = plan.withColumn("number", F.row_number().over(number))
    plan = plan.where("taken > 0").select(*[F.col(c).alias(n) for c, n in names.items()], F.col("number").alias(free_name(docs, "mix_number")))
    again, mark, place = (free_name(docs, c) for c in ("mix_number", "mix_hash", "mix_place"))
    own = docs.withColumn(mark, F.xxhash64(text_column))
    repeated = plan.where(F.col(again) > 1).limit(1).count()
    if repeated:
        own = own.withColumn(place, F.row_number().over(Window.partitionBy(id_column, mark).orderBy(mark)))
    else:
        own = own.withColumn(place, F.lit(1))
    joined = own.join(
        plan,
        F.col(id_column).eqNullSafe(F.col(names["id"])) & (F.col(mark) == F.col(names["text_hash"])) & (F.col(place) == F.col(again)),
    )
    first, last, part, size = (F.col(names[c]) for c in ("first", "last", "part", "size"))
    found = F.regexp_extract_all(F.col(text_column), F.lit(f"({WORD})"), 1)
    cut = F.when(last >= first, F.slice(found, (first + 1).cast("int"), (last - first).cast("int"))).otherwise(
        F.concat(F.slice(found, F.lit(1), last.cast("int")), F.slice(found, (first + 1).cast("int"), (size - first).cast("int")))
    )
    copies = F.concat(
        F.array_repeat(F.col(text_column), F.col(names["whole"]).cast("int")),
        F.when(part == size, F.array(F.col(text_column))).when(part > 0, F.array(F.array_join(cut, " "))).otherwise(F.array().cast("array<string>")),
    )
    copy = free_name(docs, "mix_copy")
    listed = joined.withColumn(copy, F.explode(copies))
    return listed.select(*[F.col(copy).alias(c) if c == text_column else F.col(c) for c in docs.columns])


def op6_mix_sainte_lague(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "taken")
