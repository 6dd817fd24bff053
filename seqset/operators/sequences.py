"""Operators on ordered sequences: context, spans, sections, records.

Every operator takes the rows `df`, the sequence columns `seq` and the order
columns `order` (unique inside a sequence), and never needs a whole sequence in
one task; see `running`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqset.operators.running import (
    CHUNK,
    Ordered,
    Running,
    attach,
    following,
    latest,
    ordered,
    running,
)
from seqset.operators.skew import ROWS_PER_TASK, hot_keys, names
from seqset.session import saved

Names = str | Sequence[str]


def forward_fill(
    df: DataFrame, seq: Names, order: Names, header: Column, value: Column, name: str,
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Give every row the value of the latest header row at or above it."""
    o = ordered(df, seq, order, rows)
    return running(o, **{name: Running("last", F.when(header, value))}).done()


def context_at(
    points: DataFrame, markers: DataFrame, seq: Names, order: Names, marker: str, name: str,
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Give every point the marker at or last before it, null if there is none."""
    seq, order = names(seq), names(order)
    marks = markers.select(*seq, *order, F.col(marker).alias(name), F.lit(0).alias("_side"))
    both = points.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    o = ordered(both, seq, [*order, "_side"], rows)
    filled = running(o, **{name: Running("last", F.when(F.col("_side") == 0, F.col(name)))})
    return filled.done().filter(F.col("_side") == 1).drop("_side")


def correlate(
    requests: DataFrame, responses: DataFrame, key: Names, time: str, within: Column,
    response: Sequence[str], rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Give every request the first response with its key within the time limit.

    Requests and responses are read once, backwards in time, so a key with many
    of both does not pair them all. Columns of `response` are null without answer.
    """
    key = names(key)
    answers = responses.groupBy(*key, time).agg(F.min(F.struct(*response)).alias("_best")).select(
        *key, time, F.struct(F.col(time).alias("_t"), *[F.col(f"_best.{c}") for c in response]).alias("_answer"),
        F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_row"),
    )
    # requests at one instant are ordered among themselves by any fixed number
    asked = requests.withColumn("_side", F.lit(0)).withColumn("_row", F.xxhash64(*requests.columns))
    both = asked.unionByName(answers, allowMissingColumns=True)
    o = ordered(both, key, [time, "_side", "_row"], rows)
    o = running(o, reverse=True, _next=Running("last", F.when(F.col("_side") == 1, F.col("_answer"))))
    found = F.when(F.col("_next._t") <= F.col(time) + within, F.col("_next"))
    return (
        o.done()
        .filter(F.col("_side") == 0)
        .select(*requests.columns, *[found[c].alias(c) for c in response])
    )


def keep_by_first(
    df: DataFrame, seq: Names, order: Names, kind: str, not_in: Sequence[str],
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Keep the sequences whose first element is not of the listed kinds."""
    o = running(ordered(df, seq, order, rows), _first=Running("first", F.struct(F.col(kind).alias("k"))))
    first = F.col("_first.k")
    return o.done().filter(first.isNull() | ~first.isin(*not_in)).drop("_first")


def keep_by_header(
    df: DataFrame, seq: Names, order: Names, kind: str, header: Sequence[str],
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Keep the sequences that begin with `header`; shorter ones do not match."""
    o = running(ordered(df, seq, order, rows), _rn=Running("sum", F.lit(1)))
    wanted = F.get(F.array(*[F.lit(h) for h in header]), (F.col("_rn") - 1).cast("int"))
    matching = (
        o.frame.filter(F.col("_rn") <= len(header))
        .groupBy(*o.seq)
        .agg(F.count_if(F.col(kind) == wanted).alias("_hits"))
        .filter(F.col("_hits") == len(header))
        .drop("_hits")
    )
    return attach(o, matching, "left_semi").done().drop("_rn")


def extract_from_to(
    df: DataFrame, seq: Names, order: Names, kind: str, start: Sequence[str], stop: Sequence[str],
    include_from: bool = True, include_to: bool = False, rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Keep the first span from a start element to a stop element.

    An open span runs to the end. Start elements inside the span stay only with
    `include_from`. An element in both lists is a start.
    """
    is_start = F.col(kind).isin(*start)
    o = running(ordered(df, seq, order, rows), _open=Running("max", is_start.cast("int")))
    is_stop = (F.col("_open") == 1) & ~is_start & F.col(kind).isin(*stop)
    o = running(o, _stops=Running("sum", is_stop.cast("int")))
    inside = F.col("_stops") == 0
    if include_to:
        inside = inside | ((F.col("_stops") == 1) & is_stop)
    kept = (F.col("_open") == 1) & inside
    if not include_from:
        kept = kept & ~is_start
    return o.done().filter(kept).drop("_open", "_stops")


def split_by_markers(
    df: DataFrame, seq: Names, order: Names, kind: str, markers: Mapping[str, Sequence[str]],
    head: tuple[str, str] | None = None, rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Name the section of every row: the marker that opened it last.

    `markers` maps section names to one or two element kinds. Only the first
    occurrence of a marker opens its section; later ones are content. Rows before
    the first marker belong to the section `head` = (name, kind) if the sequence
    begins with that kind, else to none. The second kind of a marker cannot begin
    another marker.
    """
    firsts = {kinds[0] for kinds in markers.values()}
    if any(len(kinds) > 2 or firsts & set(kinds[1:]) for kinds in markers.values()):
        raise ValueError("markers are one or two kinds, and a second kind begins no marker")
    o = following(ordered(df, seq, order, rows), "_after", F.col(kind))
    hits = {}
    for section, kinds in markers.items():
        hit = F.col(kind) == kinds[0]
        if len(kinds) > 1:
            hit = hit & F.coalesce(F.col("_after") == kinds[1], F.lit(False))
        hits[section] = hit
    counts = {f"_n{i}": Running("sum", hit.cast("int")) for i, hit in enumerate(hits.values())}
    if head:
        counts["_rn"] = Running("sum", F.lit(1))
    o = running(o, **counts)
    opened = F.lit(None).cast("string")
    for i, (section, hit) in enumerate(hits.items()):
        opened = F.when(hit & (F.col(f"_n{i}") == 1), F.lit(section)).otherwise(opened)
    if head:
        at_head = (F.col("_rn") == 1) & (F.col(kind) == head[1])
        opened = F.coalesce(opened, F.when(at_head, F.lit(head[0])))
    o = running(o, section=Running("last", opened))
    return o.done().drop("_after", *counts)


def _if_long(df: DataFrame, seq: list[str], rows: int | None) -> int | None:
    """`rows` if any sequence is longer; else None, as then no part of one is."""
    return rows if rows is not None and hot_keys(df, seq, rows) else None


def _depth(o: Ordered, step: Column) -> Ordered:
    """Add `_depth` after each row; a closer at depth 0 leaves it at 0."""
    o = running(o, _sum=Running("sum", step))
    o = running(o, _low=Running("min", F.col("_sum")))
    depth = F.col("_sum") - F.least(F.lit(0), F.col("_low"))
    return Ordered(o.frame.withColumn("_depth", depth).drop("_sum", "_low"), o.seq, o.order, o.split)


def balanced_spans(
    df: DataFrame, seq: Names, pos: str, kind: str, pairs: Mapping[str, str],
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Each opener with its matching closer: rows (seq…, start, end, kind).

    `end` is null where the opener is never closed. Stray and wrong closers are
    ignored. `pairs` maps openers to closers.
    """
    seq = names(seq)
    marks = df.filter(F.col(kind).isin(*pairs.keys(), *pairs.values()))
    rows = _if_long(marks, seq, rows)
    if len(pairs) > 1:
        return _spans_of_kinds(marks, seq, pos, kind, pairs, rows)
    is_open = F.col(kind).isin(*pairs.keys())
    o = ordered(marks.select(*seq, pos, kind), seq, pos, rows)
    o = _depth(o, F.when(is_open, 1).otherwise(-1))
    level = F.when(is_open, F.col("_depth")).otherwise(F.col("_depth") + 1)
    levels = o.done().withColumn("_level", level)
    # the next element of an opener's own level is its closer
    paired = following(ordered(levels, [*seq, "_level"], pos, rows), "end", F.col(pos)).done()
    return paired.filter(is_open).select(*seq, F.col(pos).alias("start"), "end", kind)


def _matcher(keys: list[str], pos: str, kind: str, pairs: dict[str, str], whole: bool):
    """Match openers and closers of sorted runs, one run per value of `keys`.

    Emits (start, end, kind, _open): matched spans, then what only the neighbouring
    runs can decide: closers met with nothing open, and openers still open.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, stack = None, []

        def table(found: list[tuple], like: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame(found, columns=[*keys, "start", "end", kind, "_open"])
            if like[pos].dtype.kind == "i":
                out["end"] = out["end"].astype("Int64")
            return out

        for batch in batches:
            found: list[tuple] = []
            for *key, at, what in batch[[*keys, pos, kind]].itertuples(index=False, name=None):
                if key != run:
                    found += [(*run, start, None, opener, True) for start, opener in stack]
                    run, stack = key, []
                if what in pairs:
                    stack.append((at, what))
                elif not stack:
                    if not whole:
                        found.append((*key, at, None, what, False))
                elif pairs[stack[-1][1]] == what:
                    start, opener = stack.pop()
                    found.append((*key, start, at, opener, False))
            yield table(found, batch)
        if stack:
            yield table([(*run, start, None, opener, True) for start, opener in stack], batch)

    return match


def _undecided(rest: DataFrame, pos: str) -> tuple[DataFrame, DataFrame]:
    """Openers that stay open, and what neighbouring runs still have to decide.

    A closer before its sequence's first opener is stray; an opener behind its last closer stays open.
    """
    opens = F.col("_open")
    ends = rest.groupBy("_seq").agg(F.min(F.when(opens, F.col(pos))).alias("_first"), F.max(F.when(~opens, F.col(pos))).alias("_last"))
    both = saved(rest.join(saved(ends), "_seq"))
    open_to_end = both.filter(opens & F.coalesce(F.col(pos) > F.col("_last"), F.lit(True))).drop("_first", "_last")
    inner = F.when(opens, F.col(pos) < F.col("_last")).otherwise(F.col(pos) > F.col("_first"))
    return open_to_end, both.filter(inner).drop("_first", "_last")


def _seams(rest: DataFrame, pos: str, kind: str, pairs: Mapping[str, str], rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs joined two by two: (matched spans, rows that need a stack, rows that the joined run passes on).

    At the seam the left run's last opener meets the right run's first closer, the last but one the second, and so
    on: a join on the place from the seam. It holds up to the first closer of a wrong kind; only rows from there on need a stack.
    """
    opens, left = F.col("_open"), F.col("_node") % 2 == 0
    of_seam = (opens & left) | (~opens & ~left)
    here = rest.withColumn("_group", F.shiftright("_node", 1)).withColumn("_meets", of_seam)
    meet = here.filter("_meets").groupBy("_seq", "_group").agg(F.count_if(opens).alias("_openers"), F.count_if(~opens).alias("_closers"))
    placed = running(ordered(here.filter("_meets"), ["_seq", "_group", "_open"], pos, rows), _place=Running("sum", F.lit(1))).done()
    placed = saved(
        placed.join(saved(meet), ["_seq", "_group"])
        .withColumn("_place", F.when(opens, F.col("_openers") - F.col("_place") + 1).otherwise(F.col("_place")))
    )
    closes = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    openers = placed.filter(opens).select("_seq", "_group", "_place", F.col(pos).alias("start"), kind)
    closers = placed.filter(~opens).select("_seq", "_group", "_place", F.col(pos).alias("end"), F.col(kind).alias("_closer"))
    met = saved(openers.join(closers, ["_seq", "_group", "_place"]).withColumn("_right", closes[F.col(kind)] == F.col("_closer")))
    wrong = saved(met.filter(~F.col("_right")).groupBy("_seq", "_group").agg(F.min("_place").alias("_wrong")))
    before = F.col("_wrong").isNull() | (F.col("_place") < F.col("_wrong"))
    settled = met.join(wrong, ["_seq", "_group"], "left").filter(before).select("_seq", "start", "end", kind)
    marked = placed.join(wrong, ["_seq", "_group"], "left")
    beyond = F.when(opens, F.col("_place") > F.col("_closers")).otherwise(F.col("_wrong").isNull() & (F.col("_place") > F.col("_openers")))
    kept = ["_seq", "_group", pos, kind, "_open"]
    passed = here.filter("not _meets").select(*kept).unionByName(marked.filter(beyond).select(*kept))
    return settled, marked.filter(~beyond & ~before).select(*kept), passed


def _spans_of_kinds(
    marks: DataFrame, seq: list[str], pos: str, kind: str, pairs: Mapping[str, str], rows: int | None
) -> DataFrame:
    """Several pair kinds need a stack: match inside chunks, then join neighbouring chunks in log rounds.

    A closer met while something is open in its own chunk is decided there: it closes the last opener or is wrong.
    So a run of chunks is summed up by the closers that met nothing open, then the openers still open. Two
    summaries make a third: the right one's closers are read against the left one's openers from its end, what is left
    of the closers follows the left one's, what is left of the openers comes before the right one's. As that is what a stack
    does with the two runs in turn, any bracketing of the runs gives the same. Each round joins runs two by two. Only
    as many openers as there are closers meet; the others pass by. A stack in one task is needed only behind a wrong closer
    at a seam, for the rows of that seam.
    """

    # one text for all key columns, as pandas knows no null in whole numbers; it is taken apart at the end
    packed = T.StructType([T.StructField(f"k{i}", marks.schema[c].dataType) for i, c in enumerate(seq)])
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(seq)]), exact)
    own, seq = seq, ["_seq"]
    marks = marks.select(key.alias("_seq"), pos, kind)

    def unpacked(df: DataFrame) -> DataFrame:
        parts = F.from_json("_seq", packed, exact)
        return df.withColumn("_seq", parts).select(*[F.col(f"_seq.k{i}").alias(c) for i, c in enumerate(own)], "start", "end", kind)

    def matched(df: DataFrame, keys: list[str], whole: bool) -> DataFrame:
        fields = df.select(*keys, F.col(pos).alias("start"), F.col(pos).alias("end"), kind).schema
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields]).add("_open", "boolean")
        return (
            df.repartition(*keys)
            .sortWithinPartitions(*keys, pos)
            .mapInPandas(_matcher(keys, pos, kind, dict(pairs), whole), schema)
        )

    o = ordered(marks.select(*seq, pos, kind), seq, pos, rows)
    if not o.split:
        return unpacked(matched(o.done(), seq, True))
    left = F.col("end").isNull()
    first = saved(matched(o.frame, o.keys, False))
    spans = [first.filter(~left).select("_seq", "start", "end", kind)]

    def still_open(df: DataFrame) -> DataFrame:
        return df.select("_seq", F.col(pos).alias("start"), F.lit(None).cast(first.schema["end"].dataType).alias("end"), kind)

    # whole sequences first, then runs of chunks numbered from 0
    spans.append(first.filter(left & (F.col(CHUNK) == 0) & F.col("_open")).select("_seq", "start", "end", kind))
    chunks = first.filter(left & (F.col(CHUNK) > 0)).select("_seq", CHUNK).distinct()
    nodes = saved(chunks.withColumn("_node", F.row_number().over(Window.partitionBy("_seq").orderBy(CHUNK)) - 1))
    rest = first.filter(left).join(nodes, ["_seq", CHUNK]).select("_seq", "_node", F.col("start").alias(pos), kind, "_open")
    while True:
        opened, rest = _undecided(rest, pos)
        spans.append(still_open(opened))
        if not rest.agg(F.max("_node")).first()[0]:
            break
        settled, stacked, passed = _seams(rest, pos, kind, pairs, rows)
        streamed = saved(matched(stacked, ["_seq", "_group"], False))
        spans += [settled, streamed.filter(~left).select("_seq", "start", "end", kind)]
        kept = streamed.filter(left).select("_seq", "_group", F.col("start").alias(pos), kind, "_open")
        rest = passed.unionByName(kept).withColumnRenamed("_group", "_node")
    spans.append(still_open(rest.filter("_open")))
    return unpacked(reduce(DataFrame.unionByName, spans))


def marked_spans(
    df: DataFrame, seq: Names, pos: str, kind: str, opener: str, closer: str, marker: str,
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Balanced spans whose first inner element is `marker`, with nesting.

    Rows (seq…, start, end, depth, parent): `depth` counts the enclosing marked
    spans and itself, `parent` is the start of the innermost enclosing one.
    """
    seq = names(seq)
    rows = _if_long(df, seq, rows)
    spans = balanced_spans(df, seq, pos, kind, {opener: closer}, rows).drop(kind)
    marked = (
        following(ordered(df.select(*seq, pos, kind), seq, pos, rows), "_inner", F.col(kind))
        .done()
        .filter((F.col(kind) == opener) & (F.col("_inner") == marker))
        .select(*seq, F.col(pos).alias("start"))
    )
    spans = spans.join(marked, [*seq, "start"], "left_semi")
    edges = spans.select(*seq, F.col("start").alias("at"), "end", F.lit(1).alias("_step")).unionByName(
        spans.filter(F.col("end").isNotNull()).select(
            *seq, F.col("end").alias("at"), F.lit(None).cast(spans.schema["end"].dataType).alias("end"),
            F.lit(-1).alias("_step"),
        )
    )
    nested = running(ordered(edges, seq, "at", rows), depth=Running("sum", F.col("_step")))
    starts = nested.done().filter(F.col("_step") == 1).drop("_step").withColumnRenamed("at", "start")
    # the enclosing span is the last one opened one level up
    by_level = starts.withColumn("_side", F.lit(1)).withColumn("_level", F.col("depth") - 1).unionByName(
        starts.withColumn("_side", F.lit(0)).withColumn("_level", F.col("depth"))
    )
    enclosing = ordered(by_level, [*seq, "_level"], ["start", "_side"], rows)
    enclosing = running(
        enclosing, parent=Running("last", F.when(F.col("_side") == 0, F.col("start")))
    )
    return enclosing.done().filter(F.col("_side") == 1).drop("_side", "_level")


def split_records(
    df: DataFrame, seq: Names, order: Names, kind: str, delimiters: Sequence[str],
    opener: str, closer: str, name: str = "record", rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Number the records of a sequence, cut after delimiters outside pairs.

    The delimiter belongs to its record; what follows the last one is a record.
    """
    step = F.when(F.col(kind) == opener, 1).when(F.col(kind) == closer, -1).otherwise(0)
    o = _depth(ordered(df, seq, order, rows), step)
    cut = F.col(kind).isin(*delimiters) & (F.col("_depth") == 0)
    o = running(o, strict=True, **{name: Running("sum", cut.cast("int"))})
    return o.done().withColumn(name, F.col(name) + 1).drop("_depth")


def drop_blocks(
    df: DataFrame, seq: Names, order: Names, kind: str, start: Sequence[str], end: Sequence[str],
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Drop every block from a start element to its end element, both included."""
    is_start, is_end = F.col(kind).isin(*start), F.col(kind).isin(*end)
    mark = F.when(is_start, 1).when(is_end, 0)
    o = running(ordered(df, seq, order, rows), strict=True, _mark=Running("last", mark))
    inside = is_start | (F.coalesce("_mark", F.lit(0)) == 1)
    return o.done().filter(~inside).drop("_mark")


def preceding(
    df: DataFrame, seq: Names, order: Names, kind: str, at: Column, n: int, name: str,
    rows: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """At each row that `at` selects, the last `n` elements, nearest first."""
    o = latest(ordered(df, seq, order, rows), name, F.col(kind), n)
    return o.done().filter(at)


def take_until(
    df: DataFrame, seq: Names, order: Names, stop: Column, rows: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Rows of each sequence before its first stop row."""
    flag = F.coalesce(stop, F.lit(False)).cast("int")
    o = running(ordered(df, seq, order, rows), _stop=Running("max", flag))
    return o.done().filter(F.col("_stop") == 0).drop("_stop")
