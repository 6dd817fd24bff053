"""Text, line, tag and catalog functions on small literals."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqset.functions import tagline as G
from seqset.functions import text as X
from seqset.functions.render import render_from, render_from_aliased, render_request
from seqset.session import work_dir
from seqset.sources import catalog, lines, paths, tags


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def one(df):
    return [r[-1] for r in df.orderBy("id").collect()]


def test_ordered_symbols(spark):
    df = texts(spark, "b a b A", "x-1/y*2 x-1", "", "été no", None)
    got = X.ordered_symbols(df, "id", "text").orderBy("id", "rank").collect()
    assert [(r["id"], r["symbol"]) for r in got] == [
        (0, "b"), (0, "a"), (0, "A"), (1, "x-1/y*2"), (1, "x-1"), (3, "t"), (3, "no"),
    ]


def test_ordered_symbols_lists_the_first_accepted_occurrence(spark):
    """The predicate sees occurrences: `a` is refused where it comes with a sign."""
    df = texts(spark, "a# b a c a#")
    pattern = "[a-z]#?"
    refused = X.ordered_symbols(df, "id", "text", pattern, lambda w: ~w.endswith("#"))
    assert [r["symbol"] for r in refused.orderBy("rank").collect()] == ["b", "a", "c"]
    region = X.ordered_symbols(df, "id", F.substring("text", 4, 5), pattern)
    assert [r["symbol"] for r in region.orderBy("rank").collect()] == ["b", "a", "c"]


def test_cutting_texts(spark):
    df = texts(spark, "one. two. three", "none", "", None)
    assert one(df.select("id", X.read_until(F.col("text"), ". "))) == ["one. ", "none", "", None]
    assert one(df.select("id", X.read_until(F.col("text"), ""))) == ["", "", "", None]
    assert one(df.select("id", X.take_chars(F.col("text"), 3))) == ["one", "non", "", None]
    assert one(df.select("id", X.take_chars(F.col("text"), -1))) == ["", "", "", None]


def test_comments_and_quotes(spark):
    df = texts(spark, "a -- b\n c", "a --b", ' "q" ', '"a b"', "plain")
    assert one(df.select("id", X.strip_comments(F.col("text"))))[:2] == ["a c", "a"]
    assert one(df.select("id", X.unquote(F.col("text"))))[2:] == [' "q" ', "a b", "plain"]


def test_word_classes(spark):
    words = texts(spark, *'FROM house , car As v'.split())
    classes = {w: w.upper() for w in X.SQL_WORDS} | {",": "COMMA"}
    want = ["FROM", "IDENTIFIER", "COMMA", "IDENTIFIER", "AS", "IDENTIFIER"]
    assert one(words.select("id", X.word_class(F.col("text"), classes))) == want
    table = spark.createDataFrame(list(classes.items()), "word string, class string")
    assert one(X.classify_words(words, "text", table)) == want


def test_types(spark):
    cases = {
        "TEXT": ("text", None, None), "integer": ("int", None, None), "Int": ("int", None, None), "serial": ("serial", None, None),
        "bigserial": ("bigserial", None, None), "boolean": ("bool", None, None), "bigint": ("bigint", None, None),
        "real": ("real", None, None), "timestamp": ("timezone", None, None), "timestamp(6) without time zone": ("timezone", 6, None),
        "timestamp with time zone": ("timezone", None, None), "varchar(32)": ("varchar", 32, None),
        "character varying(256)": ("varchar", 256, None), "character varying": ("varchar", None, None), "date": ("date", None, None),
        "numeric(15, 2)": ("numeric", 15, 2), "numeric": ("numeric", None, None), "character(5)": ("character", 5, None),
        "jsonb": (None, None, None), "inte": (None, None, None),
    }
    t = F.col("text")
    got = texts(spark, *cases).select("id", X.normalize_type(t), X.type_number(t, 1), X.type_number(t, 2)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == list(cases.values())


def test_read_lines(spark):
    df = texts(spark, "ab\n\ncé\n", "x\r\ny\rz", "", "last")
    got = lines.read_lines(df, "id", "text").orderBy("id", "line").collect()
    assert [tuple(r) for r in got] == [
        (0, 1, 1, "ab"), (0, 2, 4, ""), (0, 3, 5, "cé"), (1, 1, 1, "x"), (1, 2, 4, "y"), (1, 3, 6, "z"), (3, 1, 1, "last"),
    ]
    assert one(df.select("id", lines.section_size(F.col("text")))) == [4, 3, 0, 4]


def test_paths(spark, tmp_path):
    urls = spark.createDataFrame([("/a/x.php",), ("/a/y.txt",), ("/b/skip.php",)], "p string")
    extra = spark.createDataFrame([("/c/named.inc",), ("/c/skip.inc",)], "p string")
    got = paths.select_paths(urls, "p", r"\.php$", "skip", extra)
    assert sorted(r["p"] for r in got.collect()) == ["/a/x.php", "/c/named.inc"]
    (tmp_path / "in").mkdir()
    for name in ("a.php", "in/b.php", "in/c.txt"):
        (tmp_path / name).write_text("<?php")
    assert [r["length"] for r in paths.list_files(spark, str(tmp_path)).collect()] == [5, 5]
    assert paths.list_files(spark, str(tmp_path), exclude="/in/").count() == 1
    assert paths.read_files(spark, str(tmp_path)).count() == 2


SOURCE = """<?php
namespace Port;

abstract class Winch
{
    protected $load;
    private static $rope = 'steel';
    public function lift($kg) { return $kg; }
    public function lower() {}
    public $hook;
}
"""
MORE = """<?php
namespace One;
function plain($x) { if ($x) { $s = '}}'; } }
interface Seen
{
  public function look();
}
if (true) {
  final class Inner {
    private static $p, $q;
    function &ref() {}
  }
  function after() {}
}
namespace Two;
abstract class Last { protected $z; // }
  function end() {} }
"""


def declared(spark, *sources):
    df = spark.createDataFrame([(f"f{i}.php", s) for i, s in enumerate(sources)], "path string, text string")
    return tags.extract_declarations(df, "path", "text", tags.PHP, ("{", "}"))


def test_declarations(spark):
    got = declared(spark, SOURCE).orderBy("offset").collect()
    at = lambda piece: SOURCE.index(piece) + 1
    assert [(r["prefix"], r["full_name"], r["line"], r["offset"]) for r in got] == [
        ("abstract class Winch", "Port\\Winch", 4, at("abstract")),
        ("    protected $load", "Port\\Winch$load", 6, at("protected")),
        ("    private static $rope", "Port\\Winch$rope", 7, at("private")),
        ("    public function lift", "Port\\Winch:lift", 8, at("public function lift")),
        ("    public function lower", "Port\\Winch:lower", 9, at("public function lower")),
        ("    public $hook", "Port\\Winch$hook", 10, at("public $hook")),
    ]


def test_declarations_know_where_classes_end(spark):
    got = [r["full_name"] for r in declared(spark, MORE, "<?php echo 1;").orderBy("offset", "name").collect()]
    assert got == [
        "One\\plain", "One\\Seen", "One\\Seen:look", "One\\Inner", "One\\Inner$p", "One\\Inner$q", "One\\Inner:ref",
        "One\\after", "Two\\Last", "Two\\Last$z", "Two\\Last:end",
    ]


def test_tag_index_round_trip(spark):
    found = declared(spark, SOURCE, MORE, "<?php echo 1;")
    folder = work_dir(spark)
    tags.write_tag_index(found, folder, scoped=True)
    whole = "".join(p.read_text() for p in Path(folder).glob("part-*"))
    chars = len(SOURCE.replace("\n", ""))
    assert f"\x0c\nf0.php,{chars}\nabstract class Winch\x7fPort\\Winch\x014,24\n    protected $load\x7f" in whole
    assert "f2.php" not in whole
    back = tags.read_tag_index(spark, folder)
    want = sorted((r["path"], r["n_chars"], r["full_name"], r["line"]) for r in found.collect())
    assert sorted((r["path"], r["n_chars"], r["name"], r["line"]) for r in back.collect()) == want
    assert len(want) == 17


def test_declarations_are_sorted_in_shares(spark, monkeypatch):
    """Tasks follow the size of the texts, and are not merged by their bytes."""
    df = spark.createDataFrame([(f"f{k}", "<?php\nclass A {\n function f() {}\n}\n" * 20) for k in range(60)], "path string, text string")
    plain = sorted(map(tuple, tags.extract_declarations(df, "path", "text", tags.PHP, ("{", "}")).collect()))
    monkeypatch.setattr(tags, "CHARS_PER_TASK", 1000)
    found = tags.extract_declarations(df, "path", "text", tags.PHP, ("{", "}"))
    shuffles = re.findall(r"hashpartitioning\(path#\d+, (\d+)\), (\w+)", found._jdf.queryExecution().executedPlan().toString())
    assert set(shuffles) == {("42", "REPARTITION_BY_NUM")}  # 42,000 characters
    assert sorted(map(tuple, found.collect())) == plain and len(plain) == 60 * 40


def test_comments_and_quotes(spark):
    df = texts(spark, "SELECT 'a--b  c' , x -- y", 'a  "b  --c"\n\t--d\n e', "it's  --x", "  a   b ")
    assert one(df.select("id", X.strip_comments(F.col("text")))) == ["SELECT 'a--b  c' , x", 'a "b  --c" e', "it's", "a b"]


def test_tag_lines(spark):
    line = G.format_tag(F.lit("class A"), F.lit("A"), F.lit(4), F.lit(31), F.lit("N"), F.lit("\\"))
    df = texts(spark, "class B\x7f5,1", "class B\x7fB\x015,1", "a.php,15", "", "\x7fB\x015,1").withColumn("made", line)
    assert {r["made"] for r in df.collect()} == {"class A\x7fN\\A\x014,31"}
    tag = G.parse_tag(F.col("text"))
    got = df.select("id", tag["prefix"], tag["name"], tag["line"]).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("class B", None, 5), ("class B", "B", 5), (None, None, None), (None, None, None), (None, "B", 5),
    ]
    c = texts(spark, "a/b.php:A:b", "alone")
    assert one(c.select("id", G.candidate_path(F.col("text")))) == ["a/b.php", "alone"]
    assert one(c.select("id", G.candidate_text(F.col("text")))) == ["A:b", None]


def test_locate_from(spark):
    rows = [(0, "x foo\ny\nz foo bar\nfoo", "$foo", 6), (1, "foo\nbar", "foo", 2), (2, "aa\nbb", "b", 1)]
    df = spark.createDataFrame(rows, "id long, text string, name string, start int")
    assert one(tags.locate_from(df, "id", "text", "name", "start")) == ["z foo", None, "b"]


def test_rendering(spark):
    df = spark.createDataFrame([(["a", "b"], [("t", "x"), ("u", None)])], "c array<string>, e array<struct<name:string,alias:string>>")
    request = render_request({"order_by": F.lit("ORDER BY k"), "select": F.lit("SELECT k"), "where": F.lit(None).cast("string"), "from": render_from(F.col("c"))})
    row = df.select(request, render_from_aliased(F.col("e"))).first()
    assert tuple(row) == ("SELECT k FROM a , b ORDER BY k ;", "FROM t AS x , u")


DUMP = """-- dump, with a quote ' and CREATE TABLE no (id int);
SET search_path = public;
COMMENT ON EXTENSION x IS 'CREATE TABLE no2 (id int);';
CREATE TABLE fruit (id integer NOT NULL, old boolean);
CREATE TABLE "user" (
    id integer NOT NULL, -- the key, of course
    a character varying(32) DEFAULT 'x, (y' NOT NULL,
    n numeric(15,2) DEFAULT 12, r real DEFAULT NULL, c character(5) DEFAULT 'q'::text,
    t timestamp with time zone DEFAULT now() NOT NULL,
    b boolean DEFAULT TRUE, f boolean DEFAULT false,
    z text DEFAULT NULL::character varying,
    s serial, bs bigserial, bi bigint, d date, v varchar(9),
    CONSTRAINT pk PRIMARY KEY (id, a, n),
    UNIQUE (c), CONSTRAINT "two words" UNIQUE (d, v), PRIMARY KEY (id)
);
ALTER TABLE ONLY "user" ADD CONSTRAINT later UNIQUE (bi);
COPY "user" (id) FROM stdin;
CREATE TABLE payload (id int);
\\.
create table behind (id int, id bigint);
GRANT ALL ON TABLE fruit TO x;
CREATE TABLE fruit (id bigint, name text)"""


@pytest.fixture(scope="module")
def dump_catalog(spark):
    dumps = spark.createDataFrame([("one", DUMP), ("none", "SELECT 1;"), ("two", "CREATE TABLE fruit (k date);")], "source string, text string")
    return catalog.read_ddl_catalog(dumps)


def test_catalog_columns(dump_catalog):
    rows = dump_catalog[0].orderBy("source", "table_name", "ordinal").collect()
    got = [(r["table_name"], r["column_name"], r["type"], r["size"], r["scale"], r["nullable"], r["default_kind"], r["default_text"]) for r in rows if r["source"] == "one"]
    plain = (None, None, True, "nothing", None)
    assert got == [
        ("behind", "id", "bigint", *plain),
        ("fruit", "id", "bigint", *plain), ("fruit", "name", "text", *plain),
        ("user", "id", "int", None, None, False, "nothing", None),
        ("user", "a", "varchar", 32, None, False, "string", "'x, (y'"),
        ("user", "n", "numeric", 15, 2, True, "int", "12"),
        ("user", "r", "real", None, None, True, "null", "NULL"),
        ("user", "c", "character", 5, None, True, "typed_string", "'q'::text"),
        ("user", "t", "timezone", None, None, False, "now", "now()"),
        ("user", "b", "bool", None, None, True, "bool", "TRUE"),
        ("user", "f", "bool", None, None, True, "bool", "false"),
        ("user", "z", "text", None, None, True, "typed_null", "NULL::character varying"),
        ("user", "s", "serial", *plain), ("user", "bs", "bigserial", *plain), ("user", "bi", "bigint", *plain),
        ("user", "d", "date", *plain), ("user", "v", "varchar", 9, None, True, "nothing", None),
    ]
    assert [r["column_name"] for r in rows if r["source"] == "two"] == ["k"]


def test_catalog_constraints(dump_catalog):
    rows = dump_catalog[1].collect()
    assert sorted(((r["table_name"], r["name"], r["kind"], r["columns"]) for r in rows), key=str) == sorted(
        [
            ("user", "pk", "primary_key", ["id", "a", "n"]), ("user", None, "unique", ["c"]),
            ("user", "two words", "unique", ["d", "v"]), ("user", None, "primary_key", ["id"]),
        ],
        key=str,
    )


def test_catalog_round_trip(spark, dump_catalog):
    folder = work_dir(spark)
    catalog.save_catalog(*dump_catalog, folder)
    for saved, read in zip(dump_catalog, catalog.load_catalog(spark, folder)):
        assert sorted(map(str, saved.select(read.columns).collect())) == sorted(map(str, read.collect()))


def test_dump_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text(DUMP)
    dumps = catalog.read_dumps(spark, str(tmp_path))
    assert [r["text"] for r in dumps.collect()] == [DUMP]
    assert catalog.read_ddl_catalog(dumps)[0].select("table_name").distinct().count() == 3


ODD_DUMP = """/* CREATE TABLE hidden (a int); */
CREATE TABLE IF NOT EXISTS farm.barn (
    no integer PRIMARY KEY, goats int NOT NULL DEFAULT 5, hay numeric(3, 1) DEFAULT 0.5 NOT NULL CHECK (hay IS NOT NULL AND hay > 0),
    door text CONSTRAINT one_door UNIQUE, CONSTRAINT fed CHECK (goats > 0), FOREIGN KEY (no, hay) REFERENCES farm.field (x, y),
    LIKE shed, EXCLUDE USING gist (c WITH &&), "check" int
) WITH (fillfactor = 70, x = 1);
CREATE FUNCTION f() AS $body$ x; CREATE TABLE inner_one (z int); $body$;
create unlogged table "old farm"."cow shed" (x int REFERENCES barn (no) NOT NULL, d text DEFAULT (a IS NOT NULL), e text DEFAULT NULL NULL);
CREATE TABLE made AS SELECT f(a, b) FROM x;
CREATE TABLE bare ();
CREATE TABLE cut (a int DEFAULT"""


def test_catalog_of_odd_dumps(spark):
    dumps = spark.createDataFrame([("s", ODD_DUMP), ("n", None), ("t", "CREATE TABLE ;;CREATE TABLE x")], "source string, text string")
    columns, constraints = catalog.read_ddl_catalog(dumps)
    got = {(r["table_name"], r["column_name"]): (r["ordinal"], r["raw_type"], r["nullable"], r["default_text"]) for r in columns.collect()}
    assert got == {
        ("farm.barn", "no"): (1, "integer", False, None), ("farm.barn", "goats"): (2, "int", False, "5"),
        ("farm.barn", "hay"): (3, "numeric(3, 1)", False, "0.5"), ("farm.barn", "door"): (4, "text", True, None),
        ("farm.barn", "check"): (9, "int", True, None), ("old farm.cow shed", "x"): (1, "int", False, None),
        ("old farm.cow shed", "d"): (2, "text", True, "(a IS NOT NULL)"), ("old farm.cow shed", "e"): (3, "text", True, "NULL"),
        ("cut", "a"): (1, "int", True, None),
    }
    assert sorted(((r["name"], r["kind"], r["columns"]) for r in constraints.collect()), key=str) == sorted(
        [
            ("fed", "other", []), (None, "other", ["no", "hay"]), (None, "other", []), (None, "other", []),
            (None, "primary_key", ["no"]), ("one_door", "unique", ["door"]),
        ],
        key=str,
    )


def test_dumps_are_cut_outside_of_lambdas(spark):
    """Words are found and marked by the batch; the plan asks nothing for each word."""
    dumps = spark.createDataFrame([("a", DUMP)], "source string, text string")
    for part in catalog.read_ddl_catalog(dumps):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "array_position" not in plan and "regexp_extract_all" not in plan


def test_pieces_of_a_dump():
    cut = catalog._cut
    assert cut(b" a--b -- c\n /* d */ e::int /* open 'x;' ") == ["a--b", "e", "::", "int", "/", "*", "open", "'x;'"]
    assert cut(b"$a$ ; $b$ $a$ x $ From\n stdin ; y\\. z" + b" " * 100_000) == ["$a$ ; $b$ $a$", "x", "$", "From\n stdin ; y\\.", "z"]
    assert cut(b"'\xe9' \xc3\xa9t") == ["'�'", "é", "t"] and cut(b"") == cut(None) == []
