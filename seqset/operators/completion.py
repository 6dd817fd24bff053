"""What fits at a cursor inside a request, from the request's words as rows.

tokens (seq, pos, kind, value, end_off): one row per word or sign of a request, with
the offset after its last character. A request is one text cell, which bounds its
words; so its rows are one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqset.operators.membership import scoped_candidates
from seqset.operators.running import Running, following, latest, ordered, running
from seqset.operators.skew import ROWS_PER_TASK, hot_keys, skew_join

# The words that set the context of what follows them, those before a
# container name, and those that end the list of containers.
CONTEXTS = {"SELECT": "SELECT", "FROM": "FROM", "JOIN": "FROM", "WHERE": "WHERE"}
BEFORE_CONTAINER = ("FROM", "JOIN", "COMMA")
AFTER_LIST = ("WHERE", "ORDER", "GROUP", "HAVING", "SEMICOLON")


def cursor_requests(tokens: DataFrame, cursors: DataFrame, seq: str) -> DataFrame:
    """Context, prefix and alias at cursors(request_id, seq, at).

    Only words that end at or before the cursor count. `a.b` gives prefix b and
    alias a, `a.` only the alias, `b` only the prefix.
    """
    word = F.struct("kind", "value")
    known = latest(ordered(tokens, seq, "pos", rows=None), "_last", word, 3).done()
    context = F.lit(None).cast("string")
    for kind, name in CONTEXTS.items():
        context = F.when(F.col("kind") == kind, name).otherwise(context)
    marks = known.select(
        seq, F.col("end_off").alias("_off"), F.lit(0).alias("_side"), "pos", "_last", context.alias("_context")
    )
    asks = cursors.select(
        "request_id", seq, F.col("at").alias("_off"), F.lit(1).alias("_side"), F.lit(0).alias("pos")
    )
    both = ordered(marks.unionByName(asks, allowMissingColumns=True), seq, ["_off", "_side", "pos"], rows=None)
    filled = running(
        both, context=Running("last", F.col("_context")), _before=Running("last", F.col("_last"))
    ).done().filter(F.col("_side") == 1)

    before = [F.get("_before", i) for i in range(3)]
    name = [w["kind"] == "IDENTIFIER" for w in before]
    dot = [w["kind"] == "DOT" for w in before]
    qualified = name[0] & dot[1] & name[2]
    prefix = F.when(name[0], before[0]["value"])
    alias = F.when(qualified, before[2]["value"]).when(dot[0] & name[1], before[1]["value"])
    return filled.select("request_id", seq, "context", prefix.alias("prefix"), alias.alias("alias"))


def scope_entries(tokens: DataFrame, seq: str) -> DataFrame:
    """Containers listed after the last FROM: rows (seq, container, alias, items).

    `items` holds the names in brackets right behind a container or its alias, null without such brackets;
    those of a join condition or a call are no items.
    """
    kind = F.col("kind")
    is_from = (kind == "FROM").cast("int")
    o = ordered(tokens, seq, "pos", rows=None)
    o = following(o, "_next", F.struct("kind", "value"))
    o = following(o, "_next2", F.col("_next"))
    o = latest(o, "_last", kind, 5)
    o = running(o, _opened=Running("max", is_from), _froms=Running("sum", is_from))
    # behind the last FROM as many are counted as the request has: all windows share one sort
    of_all = F.coalesce(F.sum(is_from).over(Window.partitionBy(*o.keys)), F.lit(0))
    o = o.with_column("_later", of_all - F.col("_froms") + F.coalesce(is_from, F.lit(0)))
    inside = (F.col("_opened") == 1) & (F.col("_later") == 0)
    ends = (inside & kind.isin(*AFTER_LIST)).cast("int")
    step = F.when(inside & (kind == "OPAREN"), 1).when(inside & (kind == "CPAREN"), -1).otherwise(0)
    o = running(o, _ended=Running("sum", ends), _depth=Running("sum", step))
    names = inside & (F.col("_ended") == 0) & (kind == "IDENTIFIER")
    container = names & (F.col("_depth") == 0) & F.get("_last", 1).isin(*BEFORE_CONTAINER)
    before = [F.get("_last", i) for i in range(1, 5)]
    behind = (before[0] == "IDENTIFIER") & (
        before[1].isin(*BEFORE_CONTAINER)
        | (before[1] == "IDENTIFIER") & before[2].isin(*BEFORE_CONTAINER)
        | (before[1] == "AS") & (before[2] == "IDENTIFIER") & before[3].isin(*BEFORE_CONTAINER)
    )
    opening = inside & (kind == "OPAREN") & (F.col("_depth") == 1)
    o = running(
        o, _owner=Running("last", F.when(container, F.col("pos"))),
        _own=Running("last", F.when(opening, F.coalesce(behind, F.lit(False)))),
    )

    alias = F.when(F.col("_next.kind") == "AS", F.col("_next2.value")).when(
        F.col("_next.kind") == "IDENTIFIER", F.col("_next.value")
    )
    listed = F.array_sort(F.collect_list(F.when((F.col("_depth") > 0) & F.col("_own"), F.struct("pos", "value"))))
    return (
        o.done()
        .filter(names & F.col("_owner").isNotNull())
        .groupBy(seq, "_owner")
        .agg(
            F.max(F.when(container, F.col("value"))).alias("container"),
            F.max(F.when(container, alias)).alias("alias"),
            listed.alias("_listed"),
        )
        .select(
            seq, "container", "alias",
            F.when(F.size("_listed") > 0, F.transform("_listed", lambda x: x["value"])).alias("items"),
        )
    )


def complete(
    requests: DataFrame, scope: DataFrame, membership: DataFrame, max_len: int = 8,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Candidates for requests(request_id, context, prefix, alias): (request_id, candidate).

    In a SELECT or WHERE context these are items of the containers in scope, in a
    FROM context container names with the prefix, elsewhere nothing.
    """
    items = scoped_candidates(
        requests.filter(F.col("context").isin("SELECT", "WHERE")), scope, membership, max_len, rows
    )
    named = requests.filter(F.col("context") == "FROM").select(
        "request_id", F.substring(F.coalesce("prefix", F.lit("")), 1, max_len).alias("_key"),
        F.coalesce("prefix", F.lit("")).alias("_prefix"),
    )
    containers = membership.select(F.col("container").alias("candidate")).distinct()
    keyed = containers.withColumn(
        "_key",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.least(F.length("candidate"), F.lit(max_len))),
                lambda n: F.substring(F.col("candidate"), F.lit(1), n),
            )
        ),
    )
    found = skew_join(
        keyed, named, "_key", hot_keys(keyed, ["_key"], rows), hot_keys(named, ["_key"], rows)
    ).filter(F.col("candidate").startswith(F.col("_prefix")))
    return items.select("request_id", "candidate").unionByName(found.select("request_id", "candidate"))
