"""Request and response streams: reading, routing, answering, matching."""

from __future__ import annotations

import bisect
import pickle
import re
from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqset.session import saved

REQUEST = "token bigint, verb string, args array<string>, damaged string"

Answerer = Callable[[DataFrame], DataFrame]

# SQL's classes of data exceptions and of exceptions in a user's function
_DATA_ERRORS = ("22", "38", "39")
_DATA_ERROR = re.compile(rf"SQLSTATE: ({'|'.join(_DATA_ERRORS)})")

#: Jobs that a verb's failing calls may cost in one batch.
ATTEMPTS = 512
#: Buckets of keys that `first_answers` keeps its state in.
BUCKETS = 2048


def request_source(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Requests that arrive as Parquet files in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drop_empty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose answer is not missing."""
    return df.filter(F.col(column).isNotNull())


def response_sink(df: DataFrame, answer: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Write every answer that is not missing; runs until all input is read."""
    return (
        drop_empty(df, answer)
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def route_requests(df: DataFrame, payload: str, verbs: list[str]) -> DataFrame:
    """Read JSON payloads and classify them.

    Adds token, verb, args and `route`: exit, malformed, unknown (verb), call
    (without token) or token_call. Damaged payloads are rows, never failures.
    """
    parsed = F.from_json(
        payload, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"}
    )
    verb = F.col("_request.verb")
    route = (
        F.when(F.col("_request.damaged").isNotNull() | verb.isNull(), "malformed")
        .when(verb == "exit", "exit")
        .when(~verb.isin(*verbs), "unknown")
        .when(F.col("_request.token").isNull(), "call")
        .otherwise("token_call")
    )
    return (
        df.withColumn("_request", parsed)
        .withColumn("route", route)
        .select("*", "_request.token", "_request.verb", "_request.args")
        .drop("_request")
    )


def until_exit(routed: DataFrame, session: str, order: list[str], ended: DataFrame | None = None) -> DataFrame:
    """Routed requests with the route `ended` for all that come after their session's first exit.

    `ended` (column `session`) lists sessions that ended before, none of whose requests counts any more. A null session never
    ends. The first exits are a grouped minimum, so that a session of any length is no task of its own.
    """
    at = F.struct(*order)
    exits = routed.filter(F.col("route") == "exit").groupBy(F.col(session).alias("_session")).agg(F.min(at).alias("_exit"))
    late = F.col("_exit").isNotNull() & (at > F.col("_exit"))
    found = routed.join(exits, F.col(session) == F.col("_session"), "left")
    if ended is not None:
        before = ended.select(F.col(session).alias("_over")).distinct()
        found = found.join(before, F.col(session) == F.col("_over"), "left")
        late = late | F.col("_over").isNotNull()
    return found.withColumn("route", F.when(late, "ended").otherwise(F.col("route"))).select(*routed.columns)


def _is_data_error(failure: PySparkException) -> bool:
    """Whether a job failed on its data or in a user's function, by the SQLSTATE of the failure or of what caused it."""
    state, cause = failure.getSqlState(), getattr(failure, "_origin", None)
    while state is None and cause is not None:
        try:
            state = cause.getSqlState()
        except Py4JError:  # not one of Spark's own exceptions
            pass
        cause = cause.getCause()
    # the cause of a failed task may be known by its text only
    return state[:2] in _DATA_ERRORS if state else bool(_DATA_ERROR.search(str(failure)))


def _without_failing(calls: DataFrame, run: Callable[[DataFrame], DataFrame | None], attempts: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Answers of all calls but those that fail, and those calls, given that `run` fails (returns null) on all of them together.

    Calls are halved by a hash of their id until a failing one is alone. A half of a failing part need not be run if the other
    half passes. After `attempts` jobs the parts that still fail count as failing whole.
    """
    number = F.xxhash64("request_id")
    given, failing, todo = [], [], [(calls, 0)]
    while todo:
        part, depth = todo.pop()
        least, most = part.agg(F.min("request_id"), F.max("request_id")).first()
        attempts -= 1
        if least == most or depth == 63 or attempts <= 0:
            failing.append(part)
            continue
        bit = number.bitwiseAND(F.lit(1 << depth))
        one, other = part.filter(bit == 0), part.filter(bit != 0)
        answers, attempts = run(one), attempts - 1
        if answers is not None:
            given.append(answers)
            todo.append((other, depth + 1))
            continue
        todo.append((one, depth + 1))
        answers, attempts = run(other), attempts - 1
        if answers is not None:
            given.append(answers)
        else:
            todo.append((other, depth + 1))
    return given, failing


def answer_requests(
    routed: DataFrame, registry: Mapping[str, Answerer], evaluate: Answerer = lambda df: df, attempts: int = ATTEMPTS
) -> DataFrame:
    """What becomes of each request: rows (request_id, token, answer, error).

    A verb's function maps its requests to rows (request_id, answer) or (request_id, answer, error); a row with neither
    declares that there is nothing to say. Requests that get no row are errors `unanswered`; malformed, unknown and ended
    ones are errors of that name; an exit has neither answer nor error. Functions refuse a request by its error and use
    `try_` functions on what clients send. With an `evaluate` that runs a function's rows, a function that fails on
    the data all the same is run again on halves of its calls until the failing ones are alone: they become errors `failed`, and all
    others are answered as ever. A verb has `attempts` jobs for that in a batch; beyond, calls among which some fail become `failed`
    together. Other failures, such as lost executors, are raised.
    """
    calls = routed.filter(F.col("route").isin("call", "token_call"))
    refused = F.when(F.col("route") != "exit", F.col("route"))
    done = routed.filter(~F.col("route").isin("call", "token_call")).select(
        "request_id", "token", F.lit(None).cast("string").alias("answer"), refused.alias("error")
    )
    for verb, function in registry.items():
        own = calls.filter(F.col("verb") == verb)
        asked = own.select("request_id", "token")

        def run(part: DataFrame, function: Answerer = function) -> DataFrame | None:
            try:
                given = function(part)
                error = F.col("error") if "error" in given.columns else F.lit(None).cast("string")
                return evaluate(given.select(F.col("request_id").alias("_id"), "answer", error.alias("error")))
            except PySparkException as failure:
                if not _is_data_error(failure):
                    raise
                return None

        given = run(own)
        if given is None:
            answered, failing = _without_failing(own, run, attempts)
            failed = [
                part.select(F.col("request_id").alias("_id"), F.lit(None).cast("string").alias("answer"), F.lit("failed").alias("error"))
                for part in failing
            ]
            given = reduce(DataFrame.unionByName, answered + failed)
        joined = asked.join(given, F.col("request_id") == F.col("_id"), "left")
        error = F.when(F.col("_id").isNull(), "unanswered").otherwise(F.col("error"))
        answer = F.when(error.isNull(), F.col("answer"))
        done = done.unionByName(joined.select("request_id", "token", answer.alias("answer"), error.alias("error")))
    return done


def serve(
    stream: DataFrame, registry: Mapping[str, Answerer], folder: str, checkpoint: str,
    session: str | None = None, order: list[str] | None = None, time: str | None = None, forget: str | None = None,
) -> StreamingQuery:
    """Route and answer a stream of requests(request_id, payload) into three outputs.

    `answers` has (request_id, token, answer), `errors` (request_id, token, error), `silent` (request_id, token); each
    request is in exactly one of them. With `session` and `order` columns an exit ends its session, in later batches too. Ended sessions
    are a table that each batch reads from the one before and hands on. With a `time` column and an interval `forget`, a session is forgotten when its exit lies so
    far behind the newest request; its name may then be used anew, and the table holds no more than what ended in that time. Each
    batch writes folders of its own number, so a batch that is run again replaces its own output.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        routed = route_requests(df, "payload", list(registry))
        if session is not None:
            known = T.StructType([T.StructField(session, df.schema[session].dataType), T.StructField("ended_at", T.TimestampType())])
            # one folder, whatever the number of batches
            ended = spark.read.schema(known).parquet(f"{folder}/ended/batch={number - 1}") if number else None
            # read once for each verb
            routed = saved(until_exit(routed, session, order, ended))
            at = F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")
            over = routed.filter((F.col("route") == "exit") & F.col(session).isNotNull()).groupBy(session).agg(F.min(at).alias("ended_at"))
            if ended is not None:
                over = over.unionByName(ended).groupBy(session).agg(F.min("ended_at").alias("ended_at"))
            if time and forget:
                newest = routed.agg(F.max(at)).first()[0]
                if newest is not None:
                    over = over.filter(F.col("ended_at") + F.expr(f"INTERVAL {forget}") >= F.lit(newest))
            over.write.mode("overwrite").parquet(f"{folder}/ended/batch={number}")
        else:
            routed = saved(routed)
        done = saved(answer_requests(routed, registry, saved))
        out = {
            "answers": done.filter(F.col("answer").isNotNull()).drop("error"),
            "errors": done.filter(F.col("error").isNotNull()).drop("answer"),
            "silent": done.filter(F.col("answer").isNull() & F.col("error").isNull()).select("request_id", "token"),
        }
        for name, rows in out.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_correlate(
    requests: DataFrame, responses: DataFrame, key: str, asked: str, answered: str,
    within: str, late: str = "1 hour", how: str = "inner", salts: int = 4,
) -> DataFrame:
    """Match two streams: same key, answered within the time limit.

    Times must be timestamps. Watermarks on both sides bound the state that is
    kept. An inner match deals the responses of a key out over `salts` tasks, each
    of which sees all its requests. All answers in the limit are matched; the first
    is taken downstream.
    """
    salts = salts if how == "inner" else 1
    answers = (
        responses.withColumn("_salt", F.pmod(F.xxhash64(*responses.columns), F.lit(salts)))
        .withColumnRenamed(key, "_key")
        .withWatermark(answered, late)
    )
    every = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)]))
    asking = requests.withColumn("_place", every).withWatermark(asked, late)
    on = (
        (F.col(key) == F.col("_key"))
        & (F.col("_place") == F.col("_salt"))
        & (F.col(answered) >= F.col(asked))
        & (F.col(answered) <= F.col(asked) + F.expr(f"INTERVAL {within}"))
    )
    return asking.join(answers, on, how).drop("_key", "_salt", "_place")


class _Waiting:
    """The open requests and the answers of one key, as first_answers keeps them between batches."""

    def __init__(self, requests: list | None = None, answers: list | None = None):
        self.requests, self.answers = requests or [], answers or []

    def add(self, kind: int, at: int, limit: int, tie: int, body: str) -> None:
        if kind == 0:
            self.requests.append((limit, at, body))
        else:
            bisect.insort(self.answers, (at, tie, body))

    def settled(self, now: int) -> list[tuple[str, str | None]]:
        """Requests whose limit has passed, each with its first answer; answers that no request can want any more go."""
        due = [r for r in self.requests if r[0] <= now]
        self.requests = [r for r in self.requests if r[0] > now]
        out = []
        for limit, at, body in due:
            k = bisect.bisect_left(self.answers, (at,))
            found = k < len(self.answers) and self.answers[k][0] <= limit
            out.append((body, self.answers[k][2] if found else None))
        oldest = min([now + 1, *(at for _, at, _ in self.requests)])
        del self.answers[: bisect.bisect_left(self.answers, (oldest,))]
        return out

    def until(self) -> int | None:
        """When something is to be done here next, in microseconds."""
        if self.requests:
            return min(r[0] for r in self.requests)
        return self.answers[-1][0] if self.answers else None


def _wait(bucket, batches, state: GroupState):
    """One bucket's step: take in the new rows of its keys, give out what is settled, and set a timer for the next limit."""
    held = pickle.loads(bytes(state.get[0])) if state.exists else {}
    waiting = {key: _Waiting(*lists) for key, lists in held.items()}
    if not state.hasTimedOut:
        for rows in batches:
            for key, kind, *row in rows[["key", "kind", "at", "limit", "tie", "body"]].itertuples(index=False, name=None):
                if kind >= 0:
                    if key not in waiting:
                        waiting[key] = _Waiting()
                    waiting[key].add(kind, *row)
    mark = state.getCurrentWatermarkMs()
    settled = [row for one in waiting.values() for row in one.settled(mark * 1000)]
    open_keys = {key: until for key, one in waiting.items() if (until := one.until()) is not None}
    if not open_keys:
        state.remove()
    else:
        state.update((pickle.dumps({key: (waiting[key].requests, waiting[key].answers) for key in open_keys}),))
        state.setTimeoutTimestamp(max(-(-min(open_keys.values()) // 1000), mark + 1))
    yield pd.DataFrame(settled, columns=["request", "answer"], dtype=object)


def first_answers(
    requests: DataFrame, answers: DataFrame, key: str, asked: str, answered: str, within: str, answer_id: str,
    late: str = "1 hour", salts: int = 1,
) -> DataFrame:
    """One row per request of a stream: its columns and those of its first answer, or nulls if none came in time.

    An answer has the request's key and a time from `asked` to `within` after it; the first is the earliest, of several the one with the least
    `answer_id` (an integer), then the least row. A request's row comes when the watermark, `late` behind the slower stream, has passed its limit. Rows that
    come later than that are dropped, and so are answers that no request asked for. An answer may arrive before its request, and may answer
    several. Rows without a key or a time only move the watermark. Columns of both sides must have different names.

    State is kept per bucket of keys with an event-time timer: open requests, and answers until no request can want them. A call of Python
    and a timer cost far more than a row, so keys are dealt by a hash into BUCKETS. Where a key has
    very many requests, they are dealt over `salts` tasks, each of which sees the key's answers. Rows travel as JSON.
    """
    as_text = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "true"}

    def side(df: DataFrame, kind: int, time: str, limit: Column, tie: Column, salt: Column) -> DataFrame:
        at = F.col(time).cast("timestamp")
        body = F.to_json(F.struct(*df.columns), as_text)
        # not filtered out: a filter would be moved in front of the watermark, which these rows are to move
        of_kind = F.when(F.col(key).isNull() | at.isNull(), -1).otherwise(kind)
        return df.select(
            F.col(key).alias("key"), at.alias("time"), of_kind.alias("kind"), F.coalesce(F.unix_micros(at), none).alias("at"),
            F.coalesce(limit, none).alias("limit"), tie.alias("tie"), body.alias("body"), salt.alias("salt"),
        ).withWatermark("time", late)

    none = F.lit(0).cast("bigint")
    limit = F.unix_micros(F.col(asked).cast("timestamp") + F.expr(f"INTERVAL {within}"))
    tie = F.coalesce(F.col(answer_id).cast("bigint"), F.lit(2**63 - 1))
    asking = side(requests, 0, asked, limit, none, F.pmod(F.xxhash64(*requests.columns), F.lit(salts)))
    every = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)]))
    answering = side(answers, 1, answered, none, tie, every)
    both = asking.union(answering)
    # keys are compared as texts; -0.0 is 0.0
    same = F.col("key") + F.lit(0) if isinstance(both.schema["key"].dataType, (T.FloatType, T.DoubleType)) else F.col("key")
    both = both.withColumn("key", F.to_json(F.struct(same.alias("key")), as_text))
    found = both.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("bucket", "salt").applyInPandasWithState(
        _wait, "request string, answer string", "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    own, other = (F.from_json(c, df.schema, as_text).alias(c) for c, df in (("request", requests), ("answer", answers)))
    read = found.select(own, other)
    return read.select(*[F.col("request")[c].alias(c) for c in requests.columns], *[F.col("answer")[c].alias(c) for c in answers.columns if c != key])


def refresh_static(
    stream: DataFrame,
    lookup: Callable[[], DataFrame],
    answer: Callable[[DataFrame, DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
) -> StreamingQuery:
    """Answer a stream from a lookup table that is read anew for every batch."""

    def batch(df: DataFrame, number: int) -> None:
        answer(df, lookup()).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def newest_version(table: DataFrame, version: str) -> DataFrame:
    """Rows of the highest version of a table that grows by whole versions."""
    newest = table.agg(F.max(version)).first()[0]
    return table.filter(F.col(version) == F.lit(newest)).drop(version)


