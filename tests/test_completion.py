"""Completion at a cursor, on requests given as words."""

import re

import pytest

from seqset.operators import completion as C
from seqset.operators import termination as T

SCHEMA = {
    "orbit": ["body", "period", "tilt"],
    "moon": ["body", "mass", "period", "radius", "seen"],
    "comet": ["period", "tail"],
    "probe": ["body", "launch", "mass"],
}
SIGNS = {".": "DOT", ",": "COMMA", "(": "OPAREN", ")": "CPAREN", "=": "EQUAL", ";": "SEMICOLON"}
WORDS = "SELECT FROM WHERE JOIN AS ON ORDER BY LEFT".split()


def words(text):
    for pos, m in enumerate(re.finditer(r"\w+|[^\s\w]", text)):
        w = m.group()
        kind = SIGNS.get(w) or (w if w in WORDS else "IDENTIFIER")
        yield pos, kind, w if kind == "IDENTIFIER" else None, m.end() + 1


def run(spark, cases):
    tokens = spark.createDataFrame(
        [(i, *w) for i, (text, _) in enumerate(cases) for w in words(text)], "s long, pos long, kind string, value string, end_off long"
    )
    cursors = spark.createDataFrame([(i, i, at) for i, (_, at) in enumerate(cases)], "request_id long, s long, at long")
    return tokens, C.cursor_requests(tokens, cursors, "s")


# the cursor is at the bar
CASES = [
    ("FROM orbit o WHERE o.t|", ("WHERE", "t", "o"), ["o.tilt"]),
    ("SELECT c.| FROM comet AS c", ("SELECT", None, "c"), ["c.period", "c.tail"]),
    ("SELECT m.ra| FROM comet AS c, moon AS m", ("SELECT", "ra", "m"), ["m.radius"]),
    ("SELECT ma| FROM moon, probe p WHERE x = 2", ("SELECT", "ma", None), ["mass", "mass"]),
    ("SELECT seen FROM mo|", ("FROM", "mo", None), ["moon"]),
    ("SELECT seen FROM |", ("FROM", None, None), ["comet", "moon", "orbit", "probe"]),
    ("SELECT body FROM orbit LEFT JOIN pr|", ("FROM", "pr", None), ["probe"]),
    ("SELECT body FROM moon m JOIN probe p ON m.body = p.body WHERE p.l|", ("WHERE", "l", "p"), ["p.launch"]),
    ("SELECT s| FROM moon m (mass, seen) ORDER BY mass", ("SELECT", "s", None), ["seen"]),
    ("SELECT ta|", ("SELECT", "ta", None), ["tail"]),
    ("nothing|", (None, "nothing", None), []),
    ("SE|LECT body", (None, None, None), []),
]


def test_cursor_requests_and_candidates(spark):
    tokens, requests = run(spark, [(c[0].replace("|", ""), c[0].index("|") + 1) for c in CASES])
    got = {r["request_id"]: (r["context"], r["prefix"], r["alias"]) for r in requests.collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]
    scope = C.scope_entries(tokens, "s").withColumnRenamed("s", "request_id")
    membership = spark.createDataFrame([(t, c) for t, cs in SCHEMA.items() for c in cs], "container string, item string")
    found = {}
    for r in C.complete(requests, scope, membership, max_len=2).collect():
        found.setdefault(r["request_id"], []).append(r["candidate"])
    assert [sorted(found.get(i, [])) for i in range(len(CASES))] == [c[2] for c in CASES]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("SELECT tilt FROM orbit, comet ORDER BY tilt", [("comet", None, None), ("orbit", None, None)]),
        ("SELECT a FROM old WHERE x FROM t AS x (p, q), u", [("t", "x", ["p", "q"]), ("u", None, None)]),
        ("FROM orbit JOIN moon ON ( orbit . body = moon . body ) WHERE x", [("moon", None, None), ("orbit", None, None)]),
        ("FROM orbit o ( tilt ) JOIN moon ON near ( o . tilt )", [("moon", None, None), ("orbit", "o", ["tilt"])]),
        ("SELECT a", []),
    ],
)
def test_scope_entries(spark, text, wanted):
    tokens, _ = run(spark, [(text, 1)])
    got = C.scope_entries(tokens, "s").orderBy("container").collect()
    assert [(r["container"], r["alias"], r["items"]) for r in got] == wanted


MORE_SIGNS = {"*": "ASTERISK"}
MORE_WORDS = ("GROUP", "HAVING", "DISTINCT")
REQUESTS = [
    ("SELECT tilt , o.period WHERE tilt = x ORDER BY tilt ;", ["SELECT tilt , o.period", None, "WHERE tilt = x", None, None, "ORDER BY tilt"],
     {(None, "tilt"), ("o", "period")}),
    ("SELECT DISTINCT body AS b , count ( mass , m.seen ) , m . radius r", ["SELECT DISTINCT body AS b , count ( mass , m.seen ) , m.radius r", *[None] * 5],
     {(None, "body"), ("m", "radius")}),
    ("SELECT seen FROM moon GROUP BY seen HAVING seen = b", ["SELECT seen", "FROM moon", None, "GROUP BY seen", "HAVING seen = b", None], {(None, "seen")}),
    ("SELECT ( SELECT tail ) , tail", ["SELECT ( SELECT tail ) , tail", *[None] * 5], {(None, "tail")}),
    ("SELECT body , *", None, set()), ("SELECT o.* , tilt", None, set()), ("SELECT", ["SELECT", *[None] * 5], set()),
    ("WHERE mass = x ;", [None, None, "WHERE mass = x", None, None, None], set()), (";", [None] * 6, set()),
]


def request_words(text):
    for pos, kind, value, _ in words(text):
        kind = MORE_SIGNS.get(value, value if value in MORE_WORDS else kind)
        yield pos, kind, value if kind == "IDENTIFIER" else None


def test_sections_and_items_of_requests_in_words(spark):
    tokens = spark.createDataFrame(
        [(i, *w) for i, (text, *_) in enumerate(REQUESTS) for w in request_words(text)], "r long, pos long, kind string, value string"
    )
    sections, items = T.request_parts(tokens, "r")
    found = {r["r"]: list(r)[1:] for r in sections.collect()}
    assert found == {i: wanted for i, (_, wanted, _) in enumerate(REQUESTS) if wanted}
    named = {}
    for r in items.collect():
        named.setdefault(r["r"], set()).add((r["qualifier"], r["item"]))
    assert named == {i: wanted for i, (*_, wanted) in enumerate(REQUESTS) if wanted}


def test_requests_in_words_are_terminated(spark):
    asked = ["SELECT o.tilt , o.body WHERE tilt = x ;", "SELECT body , launch", "SELECT tail FROM comet", "SELECT *", "SELECT p.mass , p.launch , tail", "SELECT nothing"]
    tokens = spark.createDataFrame([(i, *w) for i, text in enumerate(asked) for w in request_words(text)], "r long, pos long, kind string, value string")
    membership = spark.createDataFrame([(c, i) for c, items in SCHEMA.items() for i in items], "container string, item string")
    got = T.terminate_words(tokens, membership, "r", "item", "container").collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["r"], r["rank"])):
        found.setdefault(r["r"], []).append(r["text"])
    assert found[0] == ["SELECT o.tilt , o.body FROM orbit WHERE tilt = x ;"]
    assert found[1][-1] == "SELECT body , launch FROM probe ;" and "SELECT body , launch FROM moon , probe ;" in found[1]
    assert not {2, 3, 5} & set(found)
    # the unqualified item needs comet alone, which holds no choice for p: no cover is kept
    assert 4 not in found
    empty = T.terminate_words(tokens.limit(0), membership, "r", "item", "container")
    assert empty.columns == ["r", "rank", "size", "text"] and empty.count() == 0


def test_a_scope_is_read_in_one_sort(spark):
    tokens = spark.createDataFrame([(1, *w) for w in words("SELECT a FROM x, y")], "s long, pos long, kind string, value string, end_off long")
    plan = C.scope_entries(tokens, "s")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[.*pos", plan)) == 1


def test_words_are_shuffled_once_and_not_written(spark, monkeypatch):
    written = []
    keep = T.saved
    monkeypatch.setattr(T, "saved", lambda df: written.append(df) or keep(df))
    asked = ["SELECT tilt , o.body", "SELECT tail FROM comet", "SELECT mass", "SELECT * , mass"]
    tokens = spark.createDataFrame([(i, *w) for i, text in enumerate(asked) for w in request_words(text)], "r long, pos long, kind string, value string")
    membership = spark.createDataFrame([(c, i) for c, items in SCHEMA.items() for i in items], "container string, item string")
    found = T.terminate_words(tokens, membership, "r", "item", "container")
    # a row for each request that is completed
    assert [df.count() for df in written] == [2] and "_items" in written[0].columns
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hash", plan.split("== Initial Plan ==")[0])) == 1
    assert sorted((r["r"], r["text"]) for r in found.collect() if r["rank"] == 1) == [(0, "SELECT tilt , o.body FROM orbit ;"), (2, "SELECT mass FROM moon ;")]
