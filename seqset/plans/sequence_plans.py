"""Queries on ordered sequences: events of users, tags of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.operators import sequences as S
from seqset.plans.base import Query, spread, table

SEQ, ORDER = "user_id", ["ts", "event_id"]
TAG = "</?[a-z][a-z0-9]*"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")


def _short(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("event_id", "event_type", *extra)


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    filled = S.forward_fill(events, SEQ, ORDER, F.col("event_type") == "signup", F.col("value"), "signup_value")
    return _short(filled, "signup_value")


def context_at(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    errors = events.filter(F.col("event_type") == "error")
    marks = events.filter(F.col("event_type").isin("signup", "view", "purchase"))
    return _short(S.context_at(errors, marks, SEQ, ORDER, "event_type", "context"), "context")


def correlate(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    views = events.filter(F.col("event_type") == "view").select("user_id", "ts", "event_id")
    purchases = events.filter(F.col("event_type") == "purchase").select(
        "user_id", "ts", F.col("event_id").alias("purchase_id")
    )
    answered = S.correlate(views, purchases, "user_id", "ts", F.expr("INTERVAL 12 HOURS"), ["purchase_id"])
    return answered.select("event_id", "purchase_id")


def keep_by_first(spark: SparkSession, d: str) -> DataFrame:
    return _short(S.keep_by_first(_events(spark, d), SEQ, ORDER, "event_type", ["error", "click"]))


def extract_from_to(spark: SparkSession, d: str) -> DataFrame:
    return _short(
        S.extract_from_to(_events(spark, d), SEQ, ORDER, "event_type", ["signup"], ["purchase"], True, True)
    )


def extract_between(spark: SparkSession, d: str) -> DataFrame:
    return _short(
        S.extract_from_to(_events(spark, d), SEQ, ORDER, "event_type", ["signup", "view"], ["view", "error"], False, False)
    )


def split_by_markers(spark: SparkSession, d: str) -> DataFrame:
    markers = {"signup": ["signup"], "view click": ["view", "click"], "error": ["error"]}
    found = S.split_by_markers(_events(spark, d), SEQ, ORDER, "event_type", markers, head=("start", "purchase"))
    return _short(found, "section")


def split_records(spark: SparkSession, d: str) -> DataFrame:
    found = S.split_records(_events(spark, d), SEQ, ORDER, "event_type", ["purchase"], "signup", "error")
    return _short(found, "record")


def keep_by_header(spark: SparkSession, d: str) -> DataFrame:
    records = S.split_records(_events(spark, d), SEQ, ORDER, "event_type", ["purchase"], "signup", "error")
    return _short(S.keep_by_header(records, ["user_id", "record"], ORDER, "event_type", ["view", "click"]), "record")


def drop_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _short(S.drop_blocks(_events(spark, d), SEQ, ORDER, "event_type", ["error"], ["signup"]))


def preceding(spark: SparkSession, d: str) -> DataFrame:
    is_error = F.col("event_type") == "error"
    found = S.preceding(_events(spark, d), SEQ, ORDER, "event_type", is_error, 3, "last")
    return found.select("event_id", F.array_join("last", ",").alias("last"))


def take_until(spark: SparkSession, d: str) -> DataFrame:
    return _short(S.take_until(_events(spark, d), SEQ, ORDER, F.col("event_type") == "error"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(TAG), F.lit(0))
    pages = spread(table(spark, d, "pages").select("page_id", "html"))
    tags = pages.select("page_id", F.posexplode(found).alias("pos", "tag"))
    return tags.withColumn("pos", F.col("pos").cast("bigint"))


def balanced_spans(spark: SparkSession, d: str) -> DataFrame:
    found = S.balanced_spans(_tags(spark, d), "page_id", "pos", "tag", {"<p": "</p"})
    return found.select("page_id", F.col("start").alias("opened"), F.col("end").alias("closed"))


def balanced_spans_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = S.balanced_spans(_tags(spark, d), "page_id", "pos", "tag", {"<p": "</p", "<div": "</div", "<li": "</li"})
    return found.select("page_id", F.col("start").alias("opened"), F.col("end").alias("closed"), "tag")


def marked_spans(spark: SparkSession, d: str) -> DataFrame:
    found = S.marked_spans(_tags(spark, d), "page_id", "pos", "tag", "<ul", "</ul", "<li")
    return found.select("page_id", F.col("start").alias("opened"), F.col("end").alias("closed"), "depth", "parent")


def nested_event_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a signup that an error closes, whose next event is another signup."""
    found = S.marked_spans(_events(spark, d), "user_id", "event_id", "event_type", "signup", "error", "signup")
    return found.select("user_id", F.col("start").alias("opened"), F.col("end").alias("closed"), "depth", "parent")


W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
SO_FAR = W + " ROWS UNBOUNDED PRECEDING)"
BEFORE = W + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

RECORDS = f"""
s AS (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) {SO_FAR} AS cum FROM events),
l AS (SELECT *, cum - least(0, min(cum) {SO_FAR}) AS depth FROM s),
r AS (SELECT *, (1 + coalesce(sum(CASE WHEN event_type = 'purchase' AND depth = 0 THEN 1 ELSE 0 END) {BEFORE}, 0))::BIGINT AS record FROM l)
"""

TAGS = f"""
t AS (SELECT page_id, unnest(range(len(m))) AS pos, unnest(m) AS tag
      FROM (SELECT page_id, regexp_extract_all(html, '{TAG}') AS m FROM pages))
"""


def _paired(source: str, seq: str, pos: str, kind: str, opener: str, closer: str) -> str:
    """Spans of one pair kind: an opener's closer is the next element of its level."""
    return f"""
    e AS (SELECT {seq}, {pos} AS pos, {kind} AS kind, CASE {kind} WHEN '{opener}' THEN 1 ELSE -1 END AS step
          FROM {source} WHERE {kind} IN ('{opener}', '{closer}')),
    c AS (SELECT *, sum(step) OVER (PARTITION BY {seq} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM e),
    g AS (SELECT *, cum - least(0, min(cum) OVER (PARTITION BY {seq} ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS depth FROM c),
    n AS (SELECT *, lead(pos) OVER (PARTITION BY {seq}, depth + (step < 0)::INT ORDER BY pos) AS closed FROM g),
    spans AS (SELECT {seq}, pos AS opened, closed FROM n WHERE step = 1)
    """


def _marked(source: str, seq: str, pos: str, kind: str, marker: str) -> str:
    """Marked spans; a parent is the innermost marked span around the start."""
    return f"""
    inner_kind AS (SELECT {seq}, {pos} AS opened, lead({kind}) OVER (PARTITION BY {seq} ORDER BY {pos}) AS next_kind FROM {source}),
    marked AS (SELECT spans.* FROM spans JOIN inner_kind USING ({seq}, opened) WHERE next_kind = '{marker}')
    SELECT a.{seq}, a.opened, a.closed, 1 + count(b.opened) AS depth, max(b.opened) AS parent
    FROM marked a LEFT JOIN marked b
      ON a.{seq} = b.{seq} AND b.opened < a.opened AND (b.closed IS NULL OR b.closed > a.opened)
    GROUP BY 1, 2, 3
    """


KINDS_SQL = f"""
WITH RECURSIVE {TAGS},
marks AS (SELECT page_id, pos, tag, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM t
          WHERE tag IN ('<p', '</p', '<div', '</div', '<li', '</li')),
walk AS (
    SELECT DISTINCT page_id, 0::BIGINT AS k, []::STRUCT(pos BIGINT, tag VARCHAR)[] AS stack,
           NULL::BIGINT AS opened, NULL::BIGINT AS closed, NULL::VARCHAR AS tag FROM marks
    UNION ALL
    SELECT w.page_id, m.k,
           CASE WHEN m.tag NOT LIKE '</%' THEN list_append(w.stack, {{'pos': m.pos, 'tag': m.tag}})
                WHEN len(w.stack) > 0 AND replace(m.tag, '/', '') = w.stack[-1].tag THEN w.stack[:-2]
                ELSE w.stack END,
           CASE WHEN m.tag LIKE '</%' AND len(w.stack) > 0 AND replace(m.tag, '/', '') = w.stack[-1].tag THEN w.stack[-1].pos END,
           m.pos, CASE WHEN len(w.stack) > 0 THEN w.stack[-1].tag END
    FROM walk w JOIN marks m ON m.page_id = w.page_id AND m.k = w.k + 1
), matched AS (SELECT page_id, opened, closed, tag FROM walk WHERE opened IS NOT NULL)
SELECT m.page_id, m.pos AS opened, s.closed, m.tag
FROM marks m LEFT JOIN matched s ON s.page_id = m.page_id AND s.opened = m.pos
WHERE m.tag NOT LIKE '</%'
"""

QUERIES = {
    "forward_fill": Query(
        forward_fill,
        f"SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) {SO_FAR} "
        "AS signup_value FROM events",
    ),
    "context_at": Query(
        context_at,
        "SELECT event_id, event_type, context FROM (SELECT *, last_value(CASE WHEN event_type IN "
        f"('signup','view','purchase') THEN event_type END IGNORE NULLS) {SO_FAR} AS context FROM events) "
        "WHERE event_type = 'error'",
    ),
    "correlate": Query(
        correlate,
        "SELECT v.event_id, arg_min(p.event_id, (p.ts, p.event_id)) AS purchase_id FROM events v LEFT JOIN events p "
        "ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 12 HOUR "
        "WHERE v.event_type = 'view' GROUP BY v.event_id",
    ),
    "keep_by_first": Query(
        keep_by_first,
        f"SELECT event_id, event_type FROM (SELECT *, first_value(event_type) {W}) AS f FROM events) "
        "WHERE f NOT IN ('error', 'click')",
    ),
    "extract_from_to": Query(
        extract_from_to,
        f"""WITH a AS (SELECT *, max((event_type = 'signup')::INT) {SO_FAR} AS opened FROM events),
        b AS (SELECT *, coalesce(sum((opened = 1 AND event_type = 'purchase')::INT) {BEFORE}, 0) AS stopped FROM a)
        SELECT event_id, event_type FROM b WHERE opened = 1 AND stopped = 0""",
    ),
    "extract_between": Query(
        extract_between,
        f"""WITH a AS (SELECT *, max((event_type IN ('signup', 'view'))::INT) {SO_FAR} AS opened FROM events),
        b AS (SELECT *, sum((opened = 1 AND event_type = 'error')::INT) {SO_FAR} AS stopped FROM a)
        SELECT event_id, event_type FROM b WHERE opened = 1 AND stopped = 0 AND event_type NOT IN ('signup', 'view')""",
    ),
    "split_by_markers": Query(
        split_by_markers,
        f"""WITH a AS (SELECT *, lead(event_type) {W}) AS after, row_number() {W}) AS rn FROM events),
        b AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'signup' WHEN event_type = 'error' THEN 'error'
              WHEN event_type = 'view' AND after = 'click' THEN 'view click' END AS hit FROM a),
        c AS (SELECT *, row_number() OVER (PARTITION BY user_id, hit ORDER BY ts, event_id) AS nth FROM b),
        d AS (SELECT *, CASE WHEN hit IS NOT NULL AND nth = 1 THEN hit
              WHEN rn = 1 AND event_type = 'purchase' THEN 'start' END AS opens FROM c)
        SELECT event_id, event_type, last_value(opens IGNORE NULLS) {SO_FAR} AS section FROM d""",
    ),
    "split_records": Query(split_records, f"WITH {RECORDS} SELECT event_id, event_type, record FROM r"),
    "keep_by_header": Query(
        keep_by_header,
        f"""WITH {RECORDS}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id, record ORDER BY ts, event_id) AS rn FROM r),
        ok AS (SELECT user_id, record FROM h GROUP BY 1, 2 HAVING bool_or(rn = 1 AND event_type = 'view') AND bool_or(rn = 2 AND event_type = 'click'))
        SELECT event_id, event_type, record FROM r SEMI JOIN ok USING (user_id, record)""",
    ),
    "drop_blocks": Query(
        drop_blocks,
        f"""WITH a AS (SELECT *, last_value(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 0 END IGNORE NULLS) {BEFORE} AS mark FROM events)
        SELECT event_id, event_type FROM a WHERE event_type <> 'error' AND coalesce(mark, 0) = 0""",
    ),
    "preceding": Query(
        preceding,
        f"SELECT event_id, last FROM (SELECT *, concat_ws(',', event_type, lag(event_type) {W}), lag(event_type, 2) {W})) AS last "
        "FROM events) WHERE event_type = 'error'",
    ),
    "take_until": Query(
        take_until,
        f"SELECT event_id, event_type FROM (SELECT *, max((event_type = 'error')::INT) {SO_FAR} AS stopped FROM events) WHERE stopped = 0",
    ),
    "balanced_spans": Query(
        balanced_spans, f"WITH {TAGS}, {_paired('t', 'page_id', 'pos', 'tag', '<p', '</p')} SELECT * FROM spans"
    ),
    "balanced_spans_of_kinds": Query(balanced_spans_of_kinds, KINDS_SQL),
    "marked_spans": Query(
        marked_spans,
        f"WITH {TAGS}, {_paired('t', 'page_id', 'pos', 'tag', '<ul', '</ul')}, {_marked('t', 'page_id', 'pos', 'tag', '<li')}",
    ),
    "nested_event_spans": Query(
        nested_event_spans,
        f"WITH {_paired('events', 'user_id', 'event_id', 'event_type', 'signup', 'error')}, "
        f"{_marked('events', 'user_id', 'event_id', 'event_type', 'signup')}",
    ),
}
