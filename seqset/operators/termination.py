"""Requests completed by the containers that could supply their items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqset.functions.render import SECTIONS, render_from, render_request
from seqset.operators.covers import _listed, pinned_rows, rank_by_size
from seqset.operators.running import Running, following, latest, ordered, running
from seqset.operators.sequences import split_by_markers
from seqset.operators.skew import ROWS_PER_TASK, apart
from seqset.session import saved

# The words that open a section, and how signs are written.
MARKERS = {
    "select": ["SELECT"], "from": ["FROM"], "where": ["WHERE"], "group_by": ["GROUP", "BY"], "having": ["HAVING"],
    "order_by": ["ORDER", "BY"],
}
SIGNS = {"DOT": ".", "COMMA": ",", "OPAREN": "(", "CPAREN": ")", "EQUAL": "=", "ASTERISK": "*"}


def terminate_requests(
    sections: DataFrame, items: DataFrame, membership: DataFrame, request: str, qualifier: str,
    item: str, container: str, local_limit: int = 1_000, rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Requests written out with each possible `from` section, best first.

    sections (request, select, from, where, group_by, having, order_by) holds the
    text of each section or null. Only requests without from, group-by and having
    section are completed; the items they name are rows (request, qualifier, item).
    Result (request, rank, size, text).
    """
    open_ones = _open_ones(sections)
    named = saved(apart(items.select(request, qualifier, item)).join(open_ones.select(request), request, "left_semi"))
    return _completed(open_ones, named, membership, request, qualifier, item, container, local_limit, rows)


def _open_ones(sections: DataFrame) -> DataFrame:
    return sections.filter(F.col("from").isNull() & F.col("group_by").isNull() & F.col("having").isNull())


def _completed(
    open_ones: DataFrame, named: DataFrame, membership: DataFrame, request: str, qualifier: str, item: str, container: str,
    local_limit: int, rows: int,
) -> DataFrame:
    """`terminate_requests` of open requests only and what they name; their texts meet the requests' rows, not each cover."""
    in_rows, others = pinned_rows(named, membership, request, qualifier, item, container, local_limit, rows)
    found = _listed(apart(in_rows).join(open_ones, request), in_rows, request, SECTIONS)
    if others is not None:
        ranked = rank_by_size(others, request, "cover", rows=rows)
        found = found.unionByName(apart(ranked).join(open_ones, request))
    text = render_request({s: render_from(F.col("cover")) if s == "from" else F.col(s) for s in SECTIONS})
    return found.select(request, "rank", "size", text.alias("text"))


def request_parts(tokens: DataFrame, request: str) -> tuple[DataFrame, DataFrame]:
    """Sections and named items of requests given as words, for `terminate_requests`.

    tokens (request, pos, kind, value): one row per word or sign. A request is one text cell, which bounds its
    words; so its rows are one window partition. Sections are (request, select, from, where, group_by, having,
    order_by), each written out from its words or null; a final semicolon is left out. Items are
    (request, qualifier, item): `a` and `q.a` at the head of an entry of the select list, with an alias or without.
    Calls and what stands in brackets name no items. A request that asks for `*` or `q.*` has no parts at all.
    """
    whole = saved(_request_rows(tokens, request))
    return whole.select(request, *SECTIONS), _named_items(whole, request)


def _named_items(whole: DataFrame, request: str) -> DataFrame:
    return whole.filter(F.col(request).isNotNull()).select(request, F.explode("_items").alias("_i")).select(request, "_i.*")


def _request_rows(tokens: DataFrame, request: str) -> DataFrame:
    """A row for each request that has parts: its sections, and `_items` with what it names. Words are shuffled once and not written."""
    kind = F.col("kind")
    in_list = F.col("section").eqNullSafe(F.lit("select"))
    o = ordered(split_by_markers(tokens, request, "pos", "kind", MARKERS, rows=None), request, "pos", rows=None)
    o = following(o, "_next", F.struct("kind", "value"))
    o = following(o, "_next2", F.col("_next"))
    o = latest(o, "_last", kind, 2)
    step = F.when(in_list & (kind == "OPAREN"), 1).when(in_list & (kind == "CPAREN"), -1).otherwise(0)
    o = running(o, _depth=Running("sum", step))
    before, after = F.get("_last", 1), F.coalesce("_next.kind", F.lit(""))
    begins = in_list & (F.col("_depth") == 0) & before.isin("SELECT", "COMMA", "DISTINCT")
    named = begins & (kind == "IDENTIFIER")
    second = F.col("_next2.kind")
    words = o.done().select(
        request, "pos", "section",
        F.when((kind == "DOT") | before.eqNullSafe(F.lit("DOT")), "").otherwise(" ").alias("_gap"),
        F.coalesce("value", *[F.when(kind == k, sign) for k, sign in SIGNS.items()], kind).alias("_written"),
        (kind != "SEMICOLON").alias("_shown"),
        F.coalesce(begins & ((kind == "ASTERISK") | (named & (after == "DOT") & (second == "ASTERISK"))), F.lit(False)).alias("_all"),
        F.when(named & (after == "DOT"), F.col("value")).alias("qualifier"),
        F.when(named & (after == "DOT") & (second == "IDENTIFIER"), F.col("_next2.value"))
        .when(named & ~after.isin("DOT", "OPAREN"), F.col("value")).alias("item"),
    )
    piece = F.struct("pos", F.concat("_gap", "_written").alias("text"))
    texts = {
        s: F.array_sort(F.collect_list(F.when((F.col("section") == s) & F.col("_shown"), piece))) for s in SECTIONS
    }
    items = F.collect_list(F.when(F.col("item").isNotNull(), F.struct("qualifier", "item")))
    lists = words.groupBy(request).agg(F.bool_or("_all").alias("_all"), items.alias("_items"), *[v.alias(s) for s, v in texts.items()])
    whole = {s: F.ltrim(F.array_join(F.transform(s, lambda w: w["text"]), "")) for s in SECTIONS}
    return lists.filter(~F.col("_all")).select(request, *[F.when(F.size(s) > 0, v).alias(s) for s, v in whole.items()], "_items")


def terminate_words(
    tokens: DataFrame, membership: DataFrame, request: str, item: str, container: str,
    local_limit: int = 1_000, rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """`terminate_requests` from the requests' words: rows (request, rank, size, text).

    Section texts are written anew from the words, single blanks between them and none around a dot.
    """
    whole = saved(_open_ones(_request_rows(tokens, request)))
    named = _named_items(whole, request).withColumnRenamed("item", item)
    return _completed(whole.drop("_items"), named, membership, request, "qualifier", item, container, local_limit, rows)
