"""Preference pairs: the common turns of a chosen and a rejected conversation as prompt, the rest as completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import table
from seqset.operators.running import Running, ordered, running
from seqset.session import saved

# the turn format: role and text between marks
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Conversations whose neighbours one task looks for.
NEIGHBOURS = 1_000_000


def _turns(side: DataFrame, id_column: str, name: str) -> DataFrame:
    """One row per conversation with its turns in order, null roles and texts as empty."""
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    own = side.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("pair_id"))
    said = own.agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return said.select("pair_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias(name))


def _written(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE))), ""
    )


def _spans(turns: Column) -> Column:
    """Where a completion is learnt: the text and closing mark of each assistant turn, as [start, end) in characters."""
    empty = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.lit(len(OPEN) + len(BETWEEN)) + F.length(turn["role"])
        end = start + F.length(turn["text"]) + F.lit(len(CLOSE))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        learnt = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), learnt.alias("spans"))

    return F.aggregate(turns, empty, add)["spans"]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) for each id on both sides.

    Both sides have the columns turn, role and text. Turns are equal if role and text are; the longest common run from the
    first turn on is written once, as prompt. What follows on each side is its completion, with the character spans
    that are learnt: assistant turns, closing mark included. The prompt is never learnt. Turns are ordered by number, null
    first, then role and text; rows repeated in all three are repeated turns. Null roles and texts count as empty. Ids that are
    null or on one side only give no row. Completions may be empty, if one conversation is the beginning of the
    other. Extra columns are not read. A conversation is one row of the result, so its length is bounded by what a row holds.
    """
    both = _turns(chosen, id_column, "c").join(_turns(rejected, id_column, "r"), "pair_id")
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), shorter), F.slice("r", F.lit(1), shorter), lambda a, b: a == b)
    first_other = F.array_position(same, False)
    common = F.when(first_other > 0, first_other - 1).otherwise(shorter).cast("int")
    cut = both.withColumn("n_common", common)
    rest = {side: F.slice(F.col(side), F.col("n_common") + 1, F.size(side)) for side in ("c", "r")}
    return cut.select(
        "pair_id",
        "n_common",
        _written(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        _written(rest["c"]).alias("chosen"),
        _written(rest["r"]).alias("rejected"),
        _spans(rest["c"]).alias("chosen_mask"),
        _spans(rest["r"]).alias("rejected_mask"),
    )


def with_foreign_answers(turns: DataFrame, rows: int | None = None) -> DataFrame:
    """Every conversation with the last answer of the next one, in the order of ids, that has any; behind the last comes the first.

    The text of its own last assistant turn becomes the foreign one; without such a turn the foreign answer is one more turn behind
    the last. If no conversation has an answer, all stay as they are. Assistant turns without a number are no answers; rows without an id are left
    out. Neighbours are found among ids alone, in runs of about `rows` of them: by default a run per shuffle partition, of at most NEIGHBOURS.
    """
    present = turns.where(F.col("conv_id").isNotNull())
    answer = (F.col("role") == "assistant") & F.col("turn").isNotNull()
    each = saved(
        present.groupBy("conv_id").agg(F.max("turn").alias("end"), F.max(F.when(answer, F.struct("turn", "text"))).alias("last"))
    )
    ids = each.select("conv_id", F.when(F.col("last").isNotNull(), F.col("conv_id")).alias("source"), F.lit(0).alias("all"))
    first, n = ids.agg(F.min("source"), F.count(F.lit(1))).first()
    runs = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows or min(NEIGHBOURS, max(1, -(-n // runs)))
    after = running(ordered(ids, "all", "conv_id", rows), reverse=True, strict=True, next=Running("last", F.col("source"))).done()
    neighbour = after.select("conv_id", F.coalesce("next", F.lit(first).cast(ids.schema["conv_id"].dataType)).alias("next"))
    foreign = each.where("last IS NOT NULL").select(F.col("conv_id").alias("next"), F.struct(F.col("last.text").alias("text")).alias("other"))
    told = each.select("conv_id", "end", F.col("last.turn").alias("own")).join(neighbour.join(foreign, "next").select("conv_id", "other"), "conv_id", "left")
    told = saved(told)
    mine = (F.col("turn") == F.col("own")) & (F.col("role") == "assistant") & F.col("other").isNotNull()
    text = F.when(mine, F.col("other.text")).otherwise(F.col("text"))
    swapped = present.join(told, "conv_id").select("conv_id", "turn", "role", text.alias("text"))
    more = told.where("own IS NULL AND other IS NOT NULL").select(
        "conv_id", (F.coalesce("end", F.lit(0)) + 1).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("assistant").alias("role"), F.col("other.text").alias("text")
    )
    return swapped.unionByName(more)


def _mask(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations as chosen, each against itself with the next conversation's last answer as rejected."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = preference_pairs(turns, with_foreign_answers(turns))
    return found.select(
        "pair_id",
        "n_common",
        "prompt",
        "chosen",
        "rejected",
        _mask("chosen_mask").alias("chosen_mask"),
        _mask("rejected_mask").alias("rejected_mask"),
    )


OP3_SQL = """
WITH present AS (
  SELECT * FROM conversations WHERE conv_id IS NOT NULL
), each AS (
  SELECT conv_id, max(turn) AS last_of_all, max({'turn': turn, 'text': text}) FILTER (WHERE role = 'assistant' AND turn IS NOT NULL) AS own
  FROM present GROUP BY conv_id
), next AS (
  SELECT conv_id, last_of_all, own.turn AS last_turn,
         coalesce(min(CASE WHEN own IS NOT NULL THEN conv_id END) OVER (ORDER BY conv_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
                  min(CASE WHEN own IS NOT NULL THEN conv_id END) OVER ()) AS next_id
  FROM each
), swap AS (
  SELECT n.*, e.own.text AS other FROM next n LEFT JOIN each e ON e.conv_id = n.next_id
), sides AS (
  SELECT 'c' AS side, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM present
  UNION ALL
  SELECT 'r', c.conv_id, turn, coalesce(role, ''),
         coalesce(CASE WHEN turn = last_turn AND role = 'assistant' THEN other ELSE text END, '')
  FROM present c JOIN swap USING (conv_id)
  UNION ALL
  SELECT 'r', conv_id, coalesce(last_of_all, 0) + 1, 'assistant', coalesce(other, '') FROM swap WHERE last_turn IS NULL AND next_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM sides
), differing AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
         min(coalesce(c.place, r.place)) FILTER (WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) AS other_at,
         max(coalesce(c.place, r.place)) AS n
  FROM (SELECT * FROM placed WHERE side = 'c') c
  FULL JOIN (SELECT * FROM placed WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.place = r.place
  GROUP BY 1
), common AS (
  SELECT conv_id, CAST(coalesce(other_at - 1, n) AS INTEGER) AS n_common FROM differing
), written AS (
  SELECT p.*, n_common, place > n_common AS rest,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said
  FROM placed p JOIN common USING (conv_id)
), offsets AS (
  SELECT *, coalesce(sum(length(said)) FILTER (WHERE rest)
              OVER (PARTITION BY side, conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM written
), spans AS (
  SELECT *, (begun + 13 + length(role))::BIGINT AS learnt_from, (begun + length(said))::BIGINT AS learnt_to FROM offsets
)
SELECT conv_id AS pair_id, any_value(n_common) AS n_common,
  coalesce(string_agg(said, '' ORDER BY place) FILTER (WHERE side = 'c' AND NOT rest), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY place) FILTER (WHERE side = 'c' AND rest), '') AS chosen,
  coalesce(string_agg(said, '' ORDER BY place) FILTER (WHERE side = 'r' AND rest), '') AS rejected,
  coalesce(string_agg(learnt_from || ':' || learnt_to, ',' ORDER BY place) FILTER (WHERE side = 'c' AND rest AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(learnt_from || ':' || learnt_to, ',' ORDER BY place) FILTER (WHERE side = 'r' AND rest AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id
"""
