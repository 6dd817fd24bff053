"""Operators on membership tables: rows (container, item, …)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqset.operators.lists import PART_SIZE, collect_parts
from seqset.operators.running import Running, ordered, running
from seqset.operators.skew import ROWS_PER_TASK, apart, hot_keys, names, skew_join
from seqset.session import passing, saved

# holders of an item that are held as one list, and items of a request whose lists meet in one row
LIST_HOLDERS, LIST_ITEMS = 200, 1_000


def prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with the prefix, letter case respected."""
    return df.filter(F.col(column).startswith(prefix))


def prefix_type_filter(
    membership: DataFrame, container: str, containers: Sequence[str], item: str, prefix: str,
    type_column: str | None = None, types: Sequence[str] | None = None,
) -> DataFrame:
    """Items of the named containers with the prefix and, if given, a listed type."""
    kept = membership.filter(F.col(container).isin(*containers) & F.col(item).startswith(prefix))
    return kept if types is None else kept.filter(F.col(type_column).isin(*types))


def restrict_items(item: Column, allowed: Column) -> Column:
    """True if the item is on the allowed list, or if there is no list."""
    return allowed.isNull() | F.array_contains(allowed, item)


def _prefix_keys(df: DataFrame, word: str, lengths: Sequence[int]) -> DataFrame:
    """One row per word and asked prefix length, with the prefix as `_key`.

    Words shorter than a length have no such prefix.
    """
    if len(lengths) == 1:
        (n,) = lengths
        return df.filter(F.length(word) >= n).withColumn("_key", F.substring(word, 1, n))
    fitting = F.filter(
        F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(word)
    )
    return df.withColumn(
        "_key", F.explode(F.transform(fitting, lambda n: F.substring(F.col(word), F.lit(1), n)))
    )


def _request_key(prefix: str, max_len: int) -> Column:
    return F.substring(F.coalesce(F.col(prefix), F.lit("")), 1, max_len)


def _asked_lengths(requests: DataFrame, prefix: str, max_len: int) -> list[int]:
    """Prefix lengths that occur, at most max_len + 1 numbers."""
    if requests.isStreaming:
        return list(range(max_len + 1))
    found = requests.select(F.length(_request_key(prefix, max_len)).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found) or [0]


def _join_prefixes(requests: DataFrame, words: DataFrame, on: list[str], rows: int) -> DataFrame:
    if requests.isStreaming:
        return requests.join(words, on)
    return skew_join(words, requests, on, hot_keys(words, on, rows), hot_keys(requests, on, rows))


def prefix_join(
    requests: DataFrame, vocabulary: DataFrame, prefix: str, word: str, max_len: int = 8,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """All words that begin with a request's prefix, for many requests at once.

    An equi-join on the prefix: words are repeated for each prefix length that
    requests ask for. Prefixes longer than `max_len` join on their first `max_len`
    characters and are compared in full afterwards.
    """
    lengths = _asked_lengths(requests, prefix, max_len)
    asked = requests.withColumn("_key", _request_key(prefix, max_len))
    words = _prefix_keys(saved(vocabulary.select(word).distinct()), word, lengths)
    joined = _join_prefixes(asked, words, ["_key"], rows)
    return joined.filter(F.col(word).startswith(F.coalesce(F.col(prefix), F.lit("")))).drop("_key")


def scoped_candidates(
    requests: DataFrame, scope: DataFrame, membership: DataFrame, max_len: int = 8,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Items that complete each request's prefix within the request's scope.

    requests (request_id, prefix, alias), scope (request_id, container, alias,
    items), membership (container, item). With an alias only the scope entries of
    that alias count; a request without scope reads all containers; a list `items`
    restricts what a scope entry shows. Result (request_id, container, item,
    candidate), with `candidate` = `alias.item` where an alias is given. An item of
    two containers, or of two scope entries, is listed twice.
    """
    asked = requests.select("request_id", F.coalesce("prefix", F.lit("")).alias("prefix"), "alias")
    entries = scope.select(
        "request_id", "container", F.col("alias").alias("_entry_alias"), F.col("items").alias("_items")
    )
    in_scope = asked.join(entries, "request_id")
    scopeless = asked.join(entries.select("request_id").distinct(), "request_id", "left_anti")
    return _complete(requests, in_scope, scopeless, membership, max_len, rows)


def nested_scope_candidates(
    requests: DataFrame, membership: DataFrame, max_len: int = 8, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """`scoped_candidates` for requests that carry their scope as an array column.

    `scope` is array<struct<container, alias, items>>; null or empty means all
    containers. Requests may be a stream.
    """
    asked = requests.select("request_id", F.coalesce("prefix", F.lit("")).alias("prefix"), "alias", "scope")
    in_scope = asked.select("request_id", "prefix", "alias", F.explode("scope").alias("_e")).select(
        "request_id", "prefix", "alias", F.col("_e.container").alias("container"),
        F.col("_e.alias").alias("_entry_alias"), F.col("_e.items").alias("_items"),
    )
    scopeless = asked.filter(F.coalesce(F.size("scope"), F.lit(0)) <= 0).drop("scope")
    return _complete(requests, in_scope, scopeless, membership, max_len, rows)


def _complete(
    requests: DataFrame, in_scope: DataFrame, scopeless: DataFrame, membership: DataFrame,
    max_len: int, rows: int,
) -> DataFrame:
    lengths = _asked_lengths(requests, "prefix", max_len)
    key = _request_key("prefix", max_len)
    # saved, so that the membership is made once and read per branch and per batch
    known = _prefix_keys(saved(membership.select("container", "item").distinct()), "item", lengths)
    in_scope = (
        in_scope.filter(F.col("alias").isNull() | (F.col("alias") == F.col("_entry_alias")))
        .drop("_entry_alias")
        .withColumn("_key", key)
    )
    found = _join_prefixes(in_scope, known, ["container", "_key"], rows)
    found = found.filter(restrict_items(F.col("item"), F.col("_items"))).drop("_items")
    # an alias names a scope entry, so without scope it matches nothing
    everywhere = scopeless.filter(F.col("alias").isNull()).withColumn("_key", key)
    found = found.unionByName(_join_prefixes(everywhere, known, ["_key"], rows))
    return found.filter(F.col("item").startswith(F.col("prefix"))).select(
        "request_id", "container", "item", F.concat_ws(".", "alias", "item").alias("candidate")
    )


def invert(
    membership: DataFrame, container: str, item: str, part_size: int = PART_SIZE
) -> DataFrame:
    """Item to sorted set of containers, in parts of bounded size."""
    return collect_parts(membership, [item], container, "containers", True, part_size)


def group_by_qualifier(
    df: DataFrame, request: str, qualifier: str, name: str, part_size: int = PART_SIZE
) -> DataFrame:
    """Names per qualifier of a request, repeats kept; `all` stands for none."""
    rows = df.select(request, F.col(qualifier).alias("qualifier"), name)
    listed = collect_parts(rows, [request, "qualifier"], name, "names", False, part_size)
    return listed.withColumn("qualifier", F.coalesce("qualifier", F.lit("all")))


def contains_all(
    membership: DataFrame, required: DataFrame, request: str | Sequence[str], container: str,
    item: str, rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Containers that hold every item a request requires (relational division).

    The holders of an item that has at most `LIST_HOLDERS` are one sorted-out list, made once for each item; the lists
    of a request meet in its own row. What is left there is looked up, as rows, with the request's more frequent items,
    so these are never expanded. Requests of frequent items only, or of more than `LIST_ITEMS` items, start from the
    holders of their rarest item.
    """
    held = saved(membership.select(container, item).distinct())
    return holders_of_all(held, required, request, container, item, rows)


def holders_of_all(
    held: DataFrame, required: DataFrame, request: str | Sequence[str], container: str, item: str, rows: int = ROWS_PER_TASK
) -> DataFrame:
    """`contains_all` from memberships (container, item) that are written and have no repeats."""
    request = names(request)
    # a join by request would lose null requests
    wanted = saved(required.select(*request, item).distinct().dropna(subset=request))
    most, many = min(LIST_HOLDERS, rows), min(LIST_ITEMS, rows)
    hot_wanted = hot_keys(wanted, [item], rows)
    frequent = held.groupBy(item).agg(F.count(F.lit(1)).alias("_holders")).filter(F.col("_holders") > most)
    with passing(held.sparkSession):
        some_frequent = bool(frequent.take(1))
    needs = wanted.groupBy(*request).agg(F.count(F.lit(1)).alias("_needed"))
    long = needs.filter(F.col("_needed") > many).select(*request)
    with passing(held.sparkSession):
        some_long = bool(long.take(1))

    listed, asked = held, wanted
    if some_frequent:
        frequent = saved(frequent)
        listed = apart(held).join(frequent, item, "left_anti")
    if some_long:
        long = saved(long)
        asked = apart(wanted).join(long, request, "left_anti")
    lists = listed.groupBy(item).agg(
        F.collect_list(container).alias("_list"), F.bool_or(F.col(container).isNull()).alias("_unnamed")
    )
    # an item without a list has a row too, and counts as needed
    of_items = skew_join(asked, lists, item, hot_wanted, large=True, how="left")
    met = of_items.groupBy(*request).agg(
        F.count(F.lit(1)).alias("_needed"), F.collect_list("_list").alias("_lists"), F.bool_or("_unnamed").alias("_unnamed")
    )
    if some_frequent:
        met = saved(met)
    n = F.size("_lists")
    common = F.aggregate(
        F.slice("_lists", 2, n), F.get("_lists", F.lit(0)),
        lambda left, other: F.when(F.size(left) == 0, left).otherwise(F.array_intersect(left, other)),
    )
    # a container without a name holds single items, but is not the same for two
    unnamed = F.array(F.lit(None).cast(held.schema[container].dataType))
    of_all = F.when(n > 1, common).when(F.col("_unnamed"), F.concat(F.get("_lists", F.lit(0)), unnamed)).otherwise(F.get("_lists", F.lit(0)))
    out = met.filter(n == F.col("_needed")).select(*request, F.explode(of_all).alias(container))
    if not (some_frequent or some_long):
        return out

    hard = long if some_long else None
    if some_frequent:
        to_check = skew_join(wanted, frequent, item, hot_wanted, large=True)
        left = met.filter((n > 0) & (n < F.col("_needed"))).select(
            *request, (F.col("_needed") - n).alias("_left"), F.explode(common).alias(container)
        )
        checked = (
            apart(apart(left).join(to_check.select(*request, item), request))
            .join(held, [item, container], "left_semi")
            .groupBy(*request, container, "_left")
            .agg(F.count(F.lit(1)).alias("_held"))
        )
        out = out.unionByName(checked.filter(F.col("_held") == F.col("_left")).select(*request, container))
        unlisted = met.filter(n == 0).select(*request)
        hard = unlisted if hard is None else hard.unionByName(unlisted)
    return out.unionByName(_divided(held, saved(apart(wanted).join(hard, request, "left_semi")), request, container, item, rows))


def _divided(held: DataFrame, wanted: DataFrame, request: list[str], container: str, item: str, rows: int) -> DataFrame:
    """`contains_all` by rows alone, from memberships and wanted items without repeats.

    The holders of the request's rarest item are the candidates. They are looked up
    with its second rarest item, and the few that are left with all the others.
    """
    hot_held, hot_wanted = hot_keys(held, [item], rows), hot_keys(wanted, [item], rows)
    hot_requests = hot_keys(wanted, request, rows)

    holders = held.groupBy(item).agg(F.count(F.lit(1)).alias("_holders"))
    needs = wanted.groupBy(*request).agg(F.count(F.lit(1)).alias("_needed"))
    # an item that nobody holds is lost here, and its request gets no answer
    priced = skew_join(wanted, holders, item, hot_wanted, large=True)
    ranked = running(
        ordered(priced, request, ["_holders", item], rows if hot_requests else None),
        _place=Running("sum", F.lit(1)),
    ).done().drop("_holders")

    first = apart(ranked.filter(F.col("_place") == 1).drop("_place")).join(needs, request)
    by_first = skew_join(held, first, item, hot_held, hot_wanted, large=True).drop(item)
    # (item, container) is a fine key; what skew is left there is split at run time
    second = ranked.filter(F.col("_place") == 2).drop("_place")
    by_second = (
        apart(apart(by_first.filter(F.col("_needed") > 1)).join(second, request))
        .join(held, [item, container], "left_semi")
        .drop(item)
    )
    others = ranked.filter(F.col("_place") > 2).drop("_place")
    by_all = (
        apart(skew_join(by_second.filter(F.col("_needed") > 2), others, request, hot_right=hot_requests, large=True))
        .join(held, [item, container], "left_semi")
        .groupBy(*request, container, "_needed")
        .agg(F.count(F.lit(1)).alias("_held"))
        .filter(F.col("_held") == F.col("_needed") - 2)
    )
    parts = (by_first.filter(F.col("_needed") == 1), by_second.filter(F.col("_needed") == 2), by_all)
    one, two, more = (part.select(*request, container) for part in parts)
    return one.unionByName(two).unionByName(more)


def last_wins(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    key = names(key)
    row = F.struct(*[c for c in df.columns if c not in key])
    kept = df.groupBy(*key).agg(F.max_by(row, F.struct(*names(order))).alias("_row"))
    return kept.select(*key, "_row.*").select(*df.columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows without repeats."""
    return df.distinct()


def as_set(column: Column) -> Column:
    """The array as a set: sorted, without repeats."""
    return F.sort_array(F.array_distinct(column))


def distinct_sets(df: DataFrame, column: str) -> DataFrame:
    """Rows without repeats, where arrays equal up to order and repeats are one."""
    return df.withColumn(column, as_set(F.col(column))).distinct()


def is_subset(sub: Column, sup: Column) -> Column:
    """True if every element of `sub` is in `sup`; repeats do not matter."""
    return F.size(F.array_except(sub, sup)) == 0


def intersect_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both inputs, once each."""
    return a.intersect(b)


def remove_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """All rows but those of one key."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(key)))
