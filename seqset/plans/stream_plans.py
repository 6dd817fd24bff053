"""Queries that run requests through Structured Streaming.

Each stages its requests as files in a new folder, runs a stream over them until
all are read, and returns what the stream wrote.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.operators.membership import nested_scope_candidates
from seqset.operators.sequences import take_until
from seqset.plans import membership_plans as MP
from seqset.plans.base import Query, table
from seqset.session import work_dir
from seqset.streaming import requests as R


def _staged(spark: SparkSession, df: DataFrame, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The rows written as files and read back as a stream."""
    df.write.parquet(folder)
    return R.request_source(spark, folder, df.schema, files_per_batch)


def stream_candidates(spark: SparkSession, d: str) -> DataFrame:
    folder = work_dir(spark)
    requests, scope = MP.suggestion_requests(spark, d)
    # a request names few scope entries: they travel inside its row
    nested = scope.groupBy("request_id").agg(
        F.collect_list(F.struct("container", "alias", "items")).alias("scope")
    )
    stream = _staged(spark, requests.join(nested, "request_id", "left"), f"{folder}/in")
    found = nested_scope_candidates(stream, MP.source_words(spark, d), max_len=2)
    R.response_sink(found, "candidate", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def stream_correlate(spark: SparkSession, d: str) -> DataFrame:
    folder = work_dir(spark)
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    views = events.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("view_id")
    )
    purchases = events.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id")
    )
    matched = R.stream_correlate(
        _staged(spark, views, f"{folder}/views"), _staged(spark, purchases, f"{folder}/purchases"),
        "user_id", "viewed", "bought", "12 hours",
    ).select("view_id", "purchase_id")
    R.response_sink(matched, "purchase_id", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(matched.schema).parquet(f"{folder}/out")


def first_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each view of a user with the user's first purchase within 12 hours, if any; the streams arrive in four slices of time.

    Behind the last slice a row without user moves the time on, so that the last views are settled too.
    """
    folder = work_dir(spark)
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    views = events.filter(F.col("event_type") == "view").select("user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("view_id"))
    purchases = events.filter(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"))
    times = [*events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75, 1.0])).first()[0]]
    later = [datetime.timedelta(days=days) for days in (7, 14)]
    for k, end in enumerate([*times, *(times[-1] + x for x in later)]):
        for name, side, at in (("views", views, "viewed"), ("purchases", purchases, "bought")):
            if k >= len(times):
                part = spark.createDataFrame([(None, end, None)], side.schema)
            else:
                part = side.filter((F.col(at) <= end) & (F.col(at) > times[k - 1] if k else F.lit(True)))
            part.write.mode("append").parquet(f"{folder}/{name}")
        found = R.first_answers(
            R.request_source(spark, f"{folder}/views", views.schema), R.request_source(spark, f"{folder}/purchases", purchases.schema),
            "user_id", "viewed", "bought", "12 hours", "purchase_id",
        ).select("view_id", "purchase_id")
        R.response_sink(found, "view_id", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Requests made of events: calls, calls with id, exits, unknown verbs, damaged ones."""
    kind = F.col("event_type")

    def call(verb: str, token: Column | None = None) -> Column:
        start = F.lit("{") if token is None else F.concat(F.lit('{"token": '), token, F.lit(", "))
        rest = [F.lit(f'"verb": "{verb}", "args": ["'), kind, F.lit('", "'), F.col("value").cast("string"), F.lit('"]}')]
        return F.concat(start, *rest)

    payload = (
        F.when(kind == "purchase", call("price", F.col("event_id").cast("string")))
        .when(kind == "view", call("kind"))
        .when(kind == "signup", F.lit('{"verb": "exit"}'))
        .when(kind == "click", call("nothing_known"))
        .otherwise(F.concat(F.lit('{"verb": "kind", "args": ['), F.col("props")))
    )
    return table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), "user_id", "ts", payload.alias("payload")
    )


def _price(calls: DataFrame) -> DataFrame:
    # prices below 20 have no answer, which is then left out; those from 80 on are refused
    price = F.get("args", 1).try_cast("double")
    answer = F.when((price >= 20) & (price < 80), F.concat(F.lit("price "), F.floor(price).cast("string")))
    return calls.select("request_id", answer.alias("answer"), F.when(price >= 80, "over limit").alias("error"))


def _kind(calls: DataFrame) -> DataFrame:
    return calls.select("request_id", F.get("args", 0).alias("answer"))


VERBS = {"price": _price, "kind": _kind}


def route_requests(spark: SparkSession, d: str) -> DataFrame:
    routed = R.route_requests(_payloads(spark, d), "payload", list(VERBS))
    return routed.select("request_id", "token", "verb", "route", F.array_join("args", "|").alias("args"))


def request_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each user up to the first exit or malformed request."""
    routed = R.route_requests(_payloads(spark, d), "payload", list(VERBS))
    stop = F.col("route").isin("exit", "malformed")
    kept = take_until(routed, "user_id", ["ts", "request_id"], stop)
    return kept.select("user_id", "request_id", "route")


def serve_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests served in three batches, by time; a user's exit ends that user's day."""
    folder = work_dir(spark)
    day = F.concat_ws("/", "user_id", F.to_date("ts"))
    payloads = _payloads(spark, d).withColumn("session", day).drop("user_id")
    early, late = payloads.agg(F.percentile_approx("ts", [0.3, 0.6])).first()[0]
    slices = [F.col("ts") <= early, (F.col("ts") > early) & (F.col("ts") <= late), F.col("ts") > late]
    for part in slices:
        payloads.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = R.request_source(spark, f"{folder}/in", payloads.schema)
        R.serve(stream, VERBS, f"{folder}/out", f"{folder}/state", "session", ["ts", "request_id"]).awaitTermination()
    fields = "request_id bigint, token bigint, answer string, error string"
    outputs = [spark.read.schema(fields).parquet(f"{folder}/out/{name}") for name in ("answers", "errors", "silent")]
    return outputs[0].unionByName(outputs[1]).unionByName(outputs[2]).select("request_id", "token", "answer", "error")


def refresh_static(spark: SparkSession, d: str) -> DataFrame:
    """Customers ask for their nation's name; between two batches the names change."""
    folder = work_dir(spark)
    nation = table(spark, d, "nation")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    early = F.col("c_mktsegment") < "HOUSEHOLD"
    names = nation.select("n_nationkey", F.col("n_name").alias("name"))
    new_names = nation.select("n_nationkey", F.concat("n_name", F.lit("/"), "n_regionkey").alias("name"))

    def publish(df: DataFrame, version: int) -> None:
        df.write.parquet(f"{folder}/names/version={version}")

    def lookup() -> DataFrame:
        return R.newest_version(spark.read.parquet(f"{folder}/names"), "version")

    def answer(batch: DataFrame, known: DataFrame) -> DataFrame:
        return batch.join(known, batch.c_nationkey == known.n_nationkey).select("c_custkey", "name")

    publish(names, 1)
    stream = _staged(spark, customers.filter(early), f"{folder}/in")
    query = R.refresh_static(stream, lookup, answer, f"{folder}/out", f"{folder}/state")
    try:
        query.processAllAvailable()
        publish(new_names, 2)
        customers.filter(~early).write.mode("append").parquet(f"{folder}/in")
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("c_custkey bigint, name string").parquet(f"{folder}/out").select("c_custkey", "name")


ROUTES = """
r AS (SELECT event_id AS request_id, user_id, ts,
      CASE event_type WHEN 'purchase' THEN event_id END AS token,
      CASE event_type WHEN 'purchase' THEN 'price' WHEN 'view' THEN 'kind' WHEN 'signup' THEN 'exit' WHEN 'click' THEN 'nothing_known' END AS verb,
      CASE event_type WHEN 'purchase' THEN 'token_call' WHEN 'view' THEN 'call' WHEN 'signup' THEN 'exit' WHEN 'click' THEN 'unknown' ELSE 'malformed' END AS route,
      CASE WHEN event_type IN ('purchase', 'view', 'click') THEN event_type || '|' || value END AS args, value, event_type
      FROM events)
"""

QUERIES = {
    "stream_candidates": Query(stream_candidates, MP.CANDIDATE_SQL),
    "stream_correlate": Query(
        stream_correlate,
        "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON p.user_id = v.user_id "
        "AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 12 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'",
    ),
    "first_answers": Query(
        first_answers,
        """SELECT v.event_id AS view_id, (SELECT arg_min(p.event_id, {'t': p.ts, 'id': p.event_id}) FROM events p
           WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 12 HOUR) AS purchase_id
           FROM events v WHERE v.event_type = 'view'""",
    ),
    "route_requests": Query(route_requests, f"WITH {ROUTES} SELECT request_id, token, verb, route, args FROM r"),
    "request_sessions": Query(
        request_sessions,
        f"""WITH {ROUTES}, s AS (SELECT *, max((route IN ('exit', 'malformed'))::INT)
        OVER (PARTITION BY user_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS stopped FROM r)
        SELECT user_id, request_id, route FROM s WHERE stopped = 0""",
    ),
    "serve_requests": Query(
        serve_requests,
        f"""WITH {ROUTES}, s AS (SELECT *, max((route = 'exit')::INT) OVER (PARTITION BY user_id, ts::DATE
        ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM r)
        SELECT request_id, token,
        CASE WHEN stopped = 1 THEN NULL WHEN verb = 'kind' THEN event_type
             WHEN verb = 'price' AND value >= 20 AND value < 80 THEN 'price ' || floor(value)::BIGINT END AS answer,
        CASE WHEN stopped = 1 THEN 'ended' WHEN route IN ('unknown', 'malformed') THEN route
             WHEN verb = 'price' AND value >= 80 THEN 'over limit' END AS error FROM s""",
    ),
    "refresh_static": Query(
        refresh_static,
        "SELECT c_custkey, CASE WHEN c_mktsegment < 'HOUSEHOLD' THEN n_name ELSE n_name || '/' || n_regionkey END AS name "
        "FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
}
