"""Request streams: routing, answering, matching, refreshing."""

import datetime
import random
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from seqset.session import saved, work_dir
from seqset.streaming import requests as R

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def kinds(calls):
    return calls.select("request_id", F.get("args", 0).alias("answer"))


def sizes(calls):
    return calls.select("request_id", F.get("args", 0).try_cast("int").cast("string").alias("answer"))


REGISTRY = {"kind": kinds, "size": sizes}
PAYLOADS = [
    (1, '{"token": 7, "verb": "kind", "args": ["a"]}', "token_call"), (2, '{"verb": "size", "args": ["12"]}', "call"),
    (3, '{"verb": "exit"}', "exit"), (4, '{"verb": "kind", "args": [', "malformed"), (5, "", "malformed"),
    (6, '{"verb": "format_disk", "args": []}', "unknown"), (7, '{"verb": "size", "args": ["many"]}', "call"),
    (8, '{"verb": "kind"}', "call"), (9, None, "malformed"), (10, "[1, 2]", "malformed"),
]


def payloads(spark):
    return spark.createDataFrame([p[:2] for p in PAYLOADS], "request_id long, payload string")


def test_routes(spark):
    got = R.route_requests(payloads(spark), "payload", list(REGISTRY)).orderBy("request_id").collect()
    assert [r["route"] for r in got] == [p[2] for p in PAYLOADS]
    assert got[0]["token"] == 7 and got[0]["args"] == ["a"]


def refused(calls):
    number = F.get("args", 0).try_cast("int")
    return calls.select("request_id", (number + 1).cast("string").alias("answer"), F.when(number.isNull(), "no number").alias("error"))


def careless(calls):
    return calls.select("request_id", F.get("args", 0).cast("int").cast("string").alias("answer"))


def picky(calls):
    return calls.filter(F.size("args") > 0).select("request_id", F.lit(None).cast("string").alias("answer"))


def served(spark, rows, registry, schema="request_id long, payload string", **how):
    folder = work_dir(spark)
    for part in rows:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        stream = R.request_source(spark, f"{folder}/in", spark.createDataFrame(part, schema).schema)
        R.serve(stream, registry, f"{folder}/out", f"{folder}/state", **how).awaitTermination()
    fields = "request_id long, token long, answer string, error string"
    read = [spark.read.schema(fields).parquet(f"{folder}/out/{name}").collect() for name in ("answers", "errors", "silent")]
    got = [tuple(r)[:4] for part in read for r in part]
    assert len({g[0] for g in got}) == len(got)
    return sorted(got)


def test_a_failing_request_does_not_stop_the_others(spark):
    registry = {**REGISTRY, "add": refused, "careless": careless, "picky": picky}
    more = [
        (11, '{"verb": "add", "token": 3, "args": ["x"]}'), (12, '{"verb": "add", "args": ["4"]}'), (13, '{"verb": "careless", "args": ["x"]}'),
        (14, '{"verb": "careless", "args": ["5"]}'), (15, '{"verb": "picky", "args": []}'), (16, '{"verb": "picky", "args": ["a"]}'),
    ]
    assert served(spark, [[p[:2] for p in PAYLOADS], more], registry) == [
        (1, 7, "a", None), (2, None, "12", None), (3, None, None, None), (4, None, None, "malformed"), (5, None, None, "malformed"),
        (6, None, None, "unknown"), (7, None, None, None), (8, None, None, None), (9, None, None, "malformed"), (10, None, None, "malformed"),
        (11, 3, None, "no number"), (12, None, "5", None), (13, None, None, "failed"), (14, None, "5", None),
        (15, None, None, "unanswered"), (16, None, None, None),
    ]


def test_three_of_a_thousand_calls_fail_alone(spark):
    bad = {17, 500, 501}
    rows = [(k, f'{{"verb": "careless", "args": ["{"x" if k in bad else k}"]}}') for k in range(1000)]
    df = spark.createDataFrame(rows, "request_id long, payload string").repartition(4)
    routed = saved(R.route_requests(df, "payload", ["careless"]))
    jobs = []

    def counted(given):
        jobs.append(1)
        return saved(given)

    got = {r["request_id"]: (r["answer"], r["error"]) for r in R.answer_requests(routed, {"careless": careless}, counted).collect()}
    assert got == {k: (None, "failed") if k in bad else (str(k), None) for k in range(1000)}
    assert len(jobs) <= 2 * 3 * 12
    # without attempts left, what fails together stays together
    few = R.answer_requests(routed, {"careless": careless}, saved, attempts=4).collect()
    assert len(few) == 1000 and bad <= {r["request_id"] for r in few if r["error"] == "failed"}
    assert all(r["answer"] == str(r["request_id"]) for r in few if r["error"] is None)


def test_other_failures_are_raised(spark):
    def wrong(calls):
        return calls.select("request_id", F.col("no_such_column").alias("answer"))

    routed = R.route_requests(spark.createDataFrame([(1, '{"verb": "wrong"}')], "request_id long, payload string"), "payload", ["wrong"])
    with pytest.raises(AnalysisException):
        R.answer_requests(routed, {"wrong": wrong}, saved)


def test_ended_sessions_are_forgotten(spark):
    def ask(number, session, minute, verb="kind"):
        return (number, session, at(minute), f'{{"verb": "{verb}", "args": ["v"]}}')

    batches = [
        [ask(1, "a", 0, "exit"), ask(2, "b", 5, "exit"), ask(3, "a", 6)],
        [ask(4, "a", 50), ask(5, "c", 61)],
        [ask(6, "a", 70), ask(7, "b", 71), ask(8, "c", 72)],
    ]
    folder = work_dir(spark)
    schema = "request_id long, session string, ts timestamp, payload string"
    for part in batches:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        stream = R.request_source(spark, f"{folder}/in", spark.createDataFrame(part, schema).schema)
        R.serve(stream, REGISTRY, f"{folder}/out", f"{folder}/state", "session", ["ts", "request_id"], "ts", "1 hour").awaitTermination()
    errors = spark.read.schema("request_id long, error string").parquet(f"{folder}/out/errors").collect()
    # a's exit is an hour old after the second batch, b's after the third
    assert sorted(r["request_id"] for r in errors if r["error"] == "ended") == [3, 4, 7]
    sizes = [spark.read.parquet(f"{folder}/out/ended/batch={n}").count() for n in range(3)]
    assert sizes == [2, 1, 0]


def test_first_answers(spark):
    """One row per request over several batches: early, late, repeated, unknown and missing answers."""
    rng = random.Random(13)
    asked = [(k, rng.choice("abc"), at(rng.randrange(0, 600))) for k in range(60)] + [(60, "d", at(30)), (61, None, at(31))]
    answered = [(k, rng.choice("abcz"), at(rng.randrange(0, 700))) for k in range(50)] + [(50, "a", at(100)), (51, "a", at(100)), (52, None, at(9))]
    want = {}
    for k, key, t in asked:
        if key is not None:
            hits = [(u, a) for a, other, u in answered if other == key and t <= u <= t + datetime.timedelta(minutes=45)]
            want[k] = min(hits)[1] if hits else None
    assert None in want.values() and len({v for v in want.values() if v is not None}) > 10
    for salts in (1, 3):
        folder = work_dir(spark)
        for k, (low, high) in enumerate([(-1, 200), (200, 420), (420, 1000), (10_000, 10_000), (20_000, 20_000)]):
            for name, rows, fields in (("q", asked, "id long, key string, asked timestamp"), ("a", answered, "answer long, key string, answered timestamp")):
                part = [r for r in rows if at(low) < r[2] <= at(high)] if low < high else [(None, None, at(low))]
                # what comes within the lateness may come out of order
                spark.createDataFrame(sorted(part, key=lambda r: -1 if r[0] is None else r[0] * 7 % 11), fields).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
            sides = [R.request_source(spark, f"{folder}/{n}", spark.read.parquet(f"{folder}/{n}").schema) for n in ("q", "a")]
            found = R.first_answers(*sides, "key", "asked", "answered", "45 minutes", "answer", "1 hour", salts)
            assert found.columns == ["id", "key", "asked", "answer", "answered"]
            R.response_sink(found, "id", f"{folder}/out", f"{folder}/state").awaitTermination()
            if k == 1:
                early = spark.read.schema(found.schema).parquet(f"{folder}/out").count()
                assert 0 < early < len(want)
        got = spark.read.schema(found.schema).parquet(f"{folder}/out").collect()
        assert {r["id"]: r["answer"] for r in got} == want and len(got) == len(want)
        assert all(r["answered"] == dict((a, u) for a, _, u in answered).get(r["answer"]) for r in got)


def test_first_answers_keep_their_state_by_the_bucket(spark, monkeypatch):
    """Keys share calls and state rows, whatever their number and type, and stay apart all the same."""
    monkeypatch.setattr(R, "BUCKETS", 3)
    for kind, value in (("long", lambda k: 2**60 + k), ("double", lambda k: -0.0 if k == 0 else k / 8)):
        folder = work_dir(spark)
        asked = [(k, value(k), at(k)) for k in range(40)] + [(40, None, at(5))]
        answered = [(100 + k, abs(value(k)), at(k + 1)) for k in range(0, 40, 2)]
        spark.createDataFrame(asked, f"id long, key {kind}, asked timestamp").write.parquet(f"{folder}/q")
        spark.createDataFrame(answered, f"answer long, key {kind}, answered timestamp").write.parquet(f"{folder}/a")
        total = 0
        for minutes in (None, 10_000, 20_000):
            for name, fields in (("q", f"id long, key {kind}, asked timestamp"), ("a", f"answer long, key {kind}, answered timestamp")):
                if minutes:
                    spark.createDataFrame([(None, None, at(minutes))], fields).write.mode("append").parquet(f"{folder}/{name}")
            sides = [R.request_source(spark, f"{folder}/{n}", spark.read.parquet(f"{folder}/{n}").schema) for n in ("q", "a")]
            query = R.response_sink(R.first_answers(*sides, "key", "asked", "answered", "45 minutes", "answer"), "id", f"{folder}/out", f"{folder}/state")
            query.awaitTermination()
            total = max([total, *[p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]])
        got = {r["id"]: r["answer"] for r in spark.read.parquet(f"{folder}/out").collect()}
        assert got == {k: 100 + k if k % 2 == 0 else None for k in range(40)}
        assert 0 < total <= 3


def test_an_exit_ends_its_session(spark):
    def ask(number, session, verb="kind"):
        return (number, session, f'{{"verb": "{verb}", "args": ["v"]}}')

    first = [ask(1, "a"), ask(2, "a", "exit"), ask(3, "a"), ask(4, "b"), ask(5, None, "exit"), ask(6, None)]
    second = [ask(7, "a"), ask(8, "b"), ask(9, "b", "exit"), ask(10, None)]
    got = served(
        spark, [first, second], REGISTRY, "request_id long, session string, payload string", session="session", order=["request_id"]
    )
    assert [g[0] for g in got if g[3] == "ended"] == [3, 7]
    assert [g[0] for g in got if g[2] == "v"] == [1, 4, 6, 8, 10]


def test_correlated_streams(spark):
    folder = work_dir(spark)
    asked = [(1, "a", at(0)), (2, "a", at(30)), (3, "b", at(5)), (4, "late", at(0))]
    answered = [(11, "a", at(10)), (12, "a", at(40)), (13, "b", at(4)), (14, "late", at(61)), (15, "nobody", at(3))]
    spark.createDataFrame(asked, "id long, key string, asked timestamp").write.parquet(f"{folder}/q")
    spark.createDataFrame(answered, "answer long, key string, answered timestamp").write.parquet(f"{folder}/a")
    matched = R.stream_correlate(
        R.request_source(spark, f"{folder}/q", spark.read.parquet(f"{folder}/q").schema),
        R.request_source(spark, f"{folder}/a", spark.read.parquet(f"{folder}/a").schema),
        "key", "asked", "answered", "60 minutes",
    ).select("id", "answer")
    R.response_sink(matched, "answer", f"{folder}/out", f"{folder}/state").awaitTermination()
    got = spark.read.schema(matched.schema).parquet(f"{folder}/out").collect()
    assert sorted(map(tuple, got)) == [(1, 11), (1, 12), (2, 12)]


def test_newest_version(spark):
    table = spark.createDataFrame([(1, "old"), (2, "new"), (2, "newer")], "version int, v string")
    assert sorted(r["v"] for r in R.newest_version(table, "version").collect()) == ["new", "newer"]


def test_work_dir_follows_the_session_setting(spark):
    def session(setting, master):
        conf = SimpleNamespace(get=lambda name, default: setting if name == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert work_dir(session("hdfs://shared/", "yarn")).startswith("hdfs://shared/run-")
    with pytest.raises(ValueError):
        work_dir(session(None, "yarn"))
    assert work_dir(spark) != work_dir(spark)
