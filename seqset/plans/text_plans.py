"""Queries on texts, lines, tags and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.functions import tagline, text as X
from seqset.plans.base import Query, spread, table
from seqset.session import work_dir
from seqset.sources import catalog, grammar, lines, paths, tags

# Words that the sample predicate refuses, and a small dictionary of word classes.
REFUSED = ["the", "of", "and", "in", "that", "la", "le", "de", "der", "und"]
CLASSES = {"the": "ARTICLE", "la": "ARTICLE", "le": "ARTICLE", "der": "ARTICLE", "and": "JOIN", "und": "JOIN", "of": "LINK", "de": "LINK", "in": "LINK"}

# Bytes of a range of a long dump.
LONG_RANGE = 1 << 20


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def ordered_symbols(spark: SparkSession, d: str) -> DataFrame:
    return X.ordered_symbols(_documents(spark, d), "doc_id", "text")


def ordered_symbols_accepted(spark: SparkSession, d: str) -> DataFrame:
    return X.ordered_symbols(
        _documents(spark, d), "doc_id", "text", accept=lambda w: ~F.lower(w).isin(*REFUSED) & (F.length(w) > 2)
    )


def read_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.read_lines(_documents(spark, d), "doc_id", "text")


def section_size(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", lines.section_size(F.col("text")).alias("n_chars"))


def read_until(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", X.read_until(F.col("text"), ". ").alias("head"))


def take_chars(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    # as many characters as the text has beyond 500, none if it is shorter
    return labelled.select("doc_id", X.take_chars(F.col("text"), F.col("n_chars").cast("int") - 500).alias("taken"))


def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    commented = F.replace("text", F.lit(", "), F.lit(" -- "))
    return _documents(spark, d).select("doc_id", X.strip_comments(commented).alias("bare"))


def classify_words(spark: SparkSession, d: str) -> DataFrame:
    words = _documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("word"))
    # counting words first leaves one row per word for the dictionary
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    classed = counted.withColumn("class", X.word_class(F.col("word"), CLASSES))
    return classed.groupBy("class").agg(F.sum("n").alias("n"))


def classify_words_by_table(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents, classed by the brands of parts named like them."""
    word = F.explode(F.split("p_name", " ")).alias("word")
    dictionary = (
        table(spark, d, "part").select(word, "p_type").groupBy(F.lower("word").alias("word")).agg(F.min("p_type").alias("class"))
    )
    words = table(spark, d, "part").select("p_partkey", word)
    return X.classify_words(words.withColumn("word", F.upper("word")), "word", dictionary)




def _type_text() -> Column:
    """A type text made of an order's priority and day."""
    priority, day = F.substring("o_orderpriority", 1, 1), F.dayofmonth("o_orderdate").cast("string")
    return (
        F.when(priority == "1", F.concat(F.lit("Varchar("), day, F.lit(")")))
        .when(priority == "2", F.concat(F.lit("numeric("), day, F.lit(", 2)")))
        .when(priority == "3", F.lit("TIMESTAMP with time zone"))
        .when(priority == "4", F.concat(F.lit("character varying("), day, F.lit(")")))
        .otherwise(F.concat(F.lit("type"), day))
    )


def normalize_type(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", _type_text().alias("t"))
    t = F.col("t")
    return orders.select(
        "o_orderkey", X.normalize_type(t).alias("type"), X.type_number(t, 1).alias("size"), X.type_number(t, 2).alias("scale")
    )


TYPE_SQL = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Varchar(' || day(o_orderdate) || ')'
 WHEN '2' THEN 'numeric(' || day(o_orderdate) || ', 2)' WHEN '3' THEN 'TIMESTAMP with time zone'
 WHEN '4' THEN 'character varying(' || day(o_orderdate) || ')' ELSE 'type' || day(o_orderdate) END"""


def unquote(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.when(F.col("p_size") > 25, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.unquote(quoted).alias("name"))


def select_paths(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("url")
    extra = pages.filter(F.col("url").endswith("#top"))
    return paths.select_paths(pages, "url", r"\.example\.com", r"\?page=", extra)


PAGE_DECLARATIONS = (
    tags.Declaration("list", r"<(ul)\b", "owner"),
    tags.Declaration("article", r"<(article)\b", "owner"),
    tags.Declaration("item", r"<(li)\b", "member", inner=":"),
    tags.Declaration("paragraph", r"<(p)\b", "member", inner=":"),
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages broken into lines between neighbouring tags, named by number and address."""
    return spread(table(spark, d, "pages").select("page_id", "url", "html")).select(
        F.concat("page_id", F.lit(" "), "url").alias("path"),
        F.replace("html", F.lit("><"), F.lit(">\n<")).alias("text"),
    )


def _page_tags(spark: SparkSession, d: str) -> DataFrame:
    return tags.extract_declarations(_pages(spark, d), "path", "text", PAGE_DECLARATIONS)


def declarations(spark: SparkSession, d: str) -> DataFrame:
    return _page_tags(spark, d)


def source_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of a source text per part, spread over lines, with comments, attributes and nested functions."""
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    key, brand = F.col("p_partkey").cast("string"), F.replace("p_brand", F.lit("#"), F.lit(""))
    text = F.concat(
        F.lit("<?php\n// class Hidden: "), "p_name", F.lit("\n"), F.repeat(F.lit("\n"), F.col("p_size") % 3), F.lit("namespace Parts\\"), brand,
        F.lit(";\n\n#[Size("), F.col("p_size").cast("string"), F.lit(")]\nfinal\n  class Part"), key, F.lit("\n{\n  protected\n    $kind = '"),
        "p_type", F.lit(" }',\n    $price;\n  public function\n    of(int $n,\n      $m = []) { function hidden() {} }\n}\nfunction make"), key, F.lit("() {}\n"),
    )
    return grammar.source_declarations(parts.select("p_partkey", text.alias("text")), "p_partkey", "text")


def format_tag(spark: SparkSession, d: str) -> DataFrame:
    found = _page_tags(spark, d)
    line = tagline.format_tag(F.col("prefix"), F.col("full_name"), F.col("line"), F.col("offset"))
    return found.select("path", line.alias("tag"), tagline.format_header(F.col("path"), F.col("n_chars")).alias("header"))


def parse_tag(spark: SparkSession, d: str) -> DataFrame:
    tag = tagline.parse_tag(F.col("tag"))
    candidate = F.concat("path", F.lit(":"), tag["name"])
    bare = F.regexp_replace(F.col("path"), "https?:", "")
    found = format_tag(spark, d).withColumn("path", bare)
    return found.select(
        "path", tag["prefix"].alias("prefix"), tag["name"].alias("name"), tag["line"].alias("line"),
        tagline.candidate_path(candidate).alias("candidate_path"), tagline.candidate_text(candidate).alias("candidate_text"),
    )


def tag_index(spark: SparkSession, d: str) -> DataFrame:
    """Tags written as an index and read back."""
    folder = f"{work_dir(spark)}/tags"
    tags.write_tag_index(_page_tags(spark, d), folder, scoped=True)
    return tags.read_tag_index(spark, folder)


def locate_from(spark: SparkSession, d: str) -> DataFrame:
    """The first line from line 2 on that holds the first symbol of the document."""
    name = F.regexp_extract("text", "[a-zA-Z0-9_]+", 0)
    starts = _documents(spark, d).withColumns({"name": name, "start": F.locate("\n", F.col("text")) + 1})
    later = starts.filter((F.col("start") > 1) & (F.col("name") != ""))
    return tags.locate_from(later, "doc_id", "text", "name", "start")


ITEM_TABLE = """CREATE TABLE IF NOT EXISTS shop.item (code int PRIMARY KEY, qty int NOT NULL DEFAULT 5 CHECK (qty IS NOT NULL),
    CONSTRAINT ck CHECK (qty > 0), FOREIGN KEY (code) REFERENCES "order" (id)) WITH (fillfactor = 70);
"""


def _order_dumps(spark: SparkSession, d: str) -> DataFrame:
    """One dump file per order: comments, settings, two or three tables and a payload."""
    orders = spread(
        table(spark, d, "orders").select(
            "o_orderkey", "o_orderstatus", "o_orderpriority", F.dayofmonth("o_orderdate").cast("string").alias("day")
        )
    )
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("-- dump of order "), key, F.lit("; CREATE TABLE no (id int);\nSET search_path = public;\n"),
        F.lit('CREATE TABLE "order'), key, F.lit('" (\n    id integer NOT NULL,\n    s_'), F.col("o_orderstatus"),
        F.lit(" character("), F.col("day"), F.lit(") DEFAULT '"), F.col("o_orderpriority"),
        F.lit("'::text NOT NULL, price numeric("), F.col("day"),
        F.lit(", 2) DEFAULT 0,\n    at timestamp without time zone DEFAULT now(),\n    CONSTRAINT pk_"), key,
        F.lit(" PRIMARY KEY (id, s_"), F.col("o_orderstatus"),
        F.lit(")\n);\nCOPY x (id) FROM stdin;\nCREATE TABLE payload (id int);\n\\.\n"),
        F.when(F.col("o_orderstatus") == "F", ITEM_TABLE).otherwise(""),
        F.lit("Create Table lines (n bigint, ok boolean DEFAULT TRUE, UNIQUE (n), note varchar(9) DEFAULT 'a, (b')"),
    )
    return orders.select(F.concat(F.lit("order"), key, F.lit(".sql")).alias("source"), text.alias("text"))


def ddl_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.read_ddl_catalog(_order_dumps(spark, d))[0]


def ddl_constraints(spark: SparkSession, d: str) -> DataFrame:
    found = catalog.read_ddl_catalog(_order_dumps(spark, d))[1]
    return found.withColumn("columns", F.array_join("columns", ","))


def long_dump_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns from a few long dump files, each of many orders' statements, read in byte ranges."""
    # names of their own, as many orders share a file
    key = F.regexp_extract("source", "[0-9]+", 0)
    own = F.replace(F.replace("text", F.lit("Create Table lines"), F.concat(F.lit("Create Table lines"), key)), F.lit("shop.item"), F.concat(F.lit("shop.item"), key))
    folder = f"{work_dir(spark)}/dumps"
    _order_dumps(spark, d).select(F.concat(own, F.lit(");")).alias("value")).write.text(folder)
    return catalog.read_long_ddl_catalog(spark, folder, ".txt", range_bytes=LONG_RANGE)[0].drop("source")


def catalog_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{work_dir(spark)}/catalog"
    catalog.save_catalog(*catalog.read_ddl_catalog(_order_dumps(spark, d), keep=True), folder)
    return catalog.load_catalog(spark, folder)[0]


DDL_SQL = """
WITH o AS (SELECT 'order' || o_orderkey || '.sql' AS source, 'order' || o_orderkey AS t, o_orderstatus AS s,
                  o_orderpriority AS p, day(o_orderdate)::INT AS d FROM orders)
SELECT source, t AS table_name, 'id' AS column_name, 1 AS ordinal, 'int' AS type, 'integer' AS raw_type, NULL::INT AS size,
       NULL::INT AS scale, FALSE AS nullable, 'nothing' AS default_kind, NULL::VARCHAR AS default_text FROM o
UNION ALL SELECT source, t, 's_' || s, 2, 'character', 'character(' || d || ')', d, NULL, FALSE, 'typed_string', '''' || p || '''::text' FROM o
UNION ALL SELECT source, t, 'price', 3, 'numeric', 'numeric(' || d || ', 2)', d, 2, TRUE, 'int', '0' FROM o
UNION ALL SELECT source, t, 'at', 4, 'timezone', 'timestamp without time zone', NULL, NULL, TRUE, 'now', 'now()' FROM o
UNION ALL SELECT source, 'lines', 'n', 1, 'bigint', 'bigint', NULL, NULL, TRUE, 'nothing', NULL FROM o
UNION ALL SELECT source, 'lines', 'ok', 2, 'bool', 'boolean', NULL, NULL, TRUE, 'bool', 'TRUE' FROM o
UNION ALL SELECT source, 'lines', 'note', 4, 'varchar', 'varchar(9)', 9, NULL, TRUE, 'string', '''a, (b''' FROM o
UNION ALL SELECT source, 'shop.item', 'code', 1, 'int', 'int', NULL, NULL, FALSE, 'nothing', NULL FROM o WHERE s = 'F'
UNION ALL SELECT source, 'shop.item', 'qty', 2, 'int', 'int', NULL, NULL, FALSE, 'int', '5' FROM o WHERE s = 'F'
"""

LONG_DDL_SQL = f"""
SELECT CASE WHEN table_name IN ('lines', 'shop.item') THEN table_name || replace(replace(source, 'order', ''), '.sql', '') ELSE table_name END AS table_name,
       * EXCLUDE (source, table_name) FROM ({DDL_SQL}) c
"""

SYMBOLS = r"""
SELECT doc_id, symbol, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos))::INT AS rank
FROM (SELECT doc_id, unnest(m) AS symbol, unnest(range(len(m))) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z_0-9#%*+$^/-]+') AS m FROM documents))
{where} GROUP BY doc_id, symbol
"""

PAGE_LINES = r"""
l AS (SELECT *, 1 + sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line) - (length(text) + 1) AS start FROM (
      SELECT page_id || ' ' || url AS path, unnest(s) AS text, unnest(range(1, len(s) + 1))::INT AS line,
             length(replace(html, chr(10), ''))::INT AS n_chars
      FROM (SELECT *, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS s FROM pages))),
k AS (SELECT * FROM (VALUES (1, 'list', 'ul', TRUE), (2, 'article', 'article', TRUE), (3, 'item', 'li', FALSE), (4, 'paragraph', 'p', FALSE)) v(d, kind, name, owns)),
hits AS (SELECT DISTINCT l.path, l.n_chars, l.line, l.start, l.text, k.d, k.kind, k.name, k.owns,
                instr(l.text, '<' || k.name) AS place
         FROM l JOIN k ON regexp_matches(l.text, '<' || k.name || '\b')),
o AS (SELECT *, last_value(CASE WHEN owns THEN name END IGNORE NULLS)
             OVER (PARTITION BY path ORDER BY line, place, d ROWS UNBOUNDED PRECEDING) AS last_owner FROM hits),
tags AS (
    SELECT path, n_chars, kind, CASE WHEN owns THEN '' ELSE last_owner END AS scope, CASE WHEN NOT owns THEN last_owner END AS owner, name,
           CASE WHEN owns THEN '\' || name ELSE last_owner || ':' || name END AS full_name,
           substr(text, 1, instr(text, name) + length(name) - 1) AS prefix, line, (start + place - 1)::BIGINT AS "offset"
    FROM o WHERE owns OR last_owner IS NOT NULL)
"""

SOURCE_SQL = r"""
WITH s AS (SELECT p_partkey, p_partkey::VARCHAR AS k, 'Parts\' || replace(p_brand, '#', '') AS ns, chr(10) AS n, '<?php' || n || '// class Hidden: ' || p_name || n
           || repeat(n, (p_size % 3)::BIGINT) || 'namespace ' || ns || ';' || n || n || '#[Size(' || p_size || ')]' || n || 'final' || n || '  class Part' || k
           || n || '{' || n || '  protected' || n || '    $kind = ''' || p_type || ' }'',' || n || '    $price;' || n || '  public function' || n
           || '    of(int $n,' || n || '      $m = []) { function hidden() {} }' || n || '}' || n || 'function make' || k || '() {}' || n AS t FROM part),
d AS (SELECT *, 'class' AS kind, NULL AS owner, 'Part' || k AS name, '\' AS sep, 'final' AS first, '  class Part' || k AS prefix FROM s
      UNION ALL SELECT *, 'property', 'Part' || k, '$kind', '', 'protected', '    $kind' FROM s
      UNION ALL SELECT *, 'property', 'Part' || k, '$price', '', 'protected', '    $price' FROM s
      UNION ALL SELECT *, 'method', 'Part' || k, 'of', ':', 'public', '    of' FROM s
      UNION ALL SELECT *, 'function', NULL, 'make' || k, '\', 'function make', 'function make' || k FROM s),
p AS (SELECT *, ns || coalesce('\' || owner, '') AS scope, instr(t, first) AS place, substr(t, 1, instr(t, first)) AS head FROM d WHERE t IS NOT NULL)
SELECT p_partkey, length(replace(t, n, ''))::INT AS n_chars, kind, scope, owner, name, scope || sep || name AS full_name, prefix,
       (1 + length(head) - length(replace(head, n, '')))::INT AS line, place::BIGINT AS "offset" FROM p
"""

CLASS_SQL = " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in CLASSES.items())
REFUSED_SQL = ", ".join(f"'{w}'" for w in REFUSED)

QUERIES = {
    "ordered_symbols": Query(ordered_symbols, SYMBOLS.format(where="")),
    "ordered_symbols_accepted": Query(
        ordered_symbols_accepted,
        SYMBOLS.format(where=f"WHERE lower(symbol) NOT IN ({REFUSED_SQL}) AND length(symbol) > 2"),
    ),
    "read_lines": Query(
        read_lines,
        r"""SELECT doc_id, line::INT AS line, (1 + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY line) - length(piece))::BIGINT AS "offset",
        rtrim(piece, chr(13) || chr(10)) AS text
        FROM (SELECT doc_id, unnest(m) AS piece, unnest(range(1, len(m) + 1)) AS line
              FROM (SELECT doc_id, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+') AS m FROM documents))""",
    ),
    "section_size": Query(
        section_size, "SELECT doc_id, length(replace(replace(text, chr(13), ''), chr(10), ''))::INT AS n_chars FROM documents"
    ),
    "read_until": Query(
        read_until,
        "SELECT doc_id, CASE WHEN instr(text, '. ') > 0 THEN substr(text, 1, instr(text, '. ') + 1) ELSE text END AS head FROM documents",
    ),
    "take_chars": Query(
        take_chars, "SELECT doc_id, substr(text, 1, greatest(n_chars - 500, 0)) AS taken FROM documents"
    ),
    "strip_comments": Query(
        strip_comments,
        r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, ', ', ' -- '), '--[^\n]*', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS bare FROM documents",
    ),
    "classify_words": Query(
        classify_words,
        f"""SELECT class, count(*) AS n FROM (SELECT CASE lower(word) {CLASS_SQL} ELSE 'IDENTIFIER' END AS class
        FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM documents)) GROUP BY 1""",
    ),
    "classify_words_by_table": Query(
        classify_words_by_table,
        """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_type FROM part),
        dict AS (SELECT word, min(p_type) AS class FROM w GROUP BY 1)
        SELECT p_partkey, upper(word) AS word, coalesce(class, 'IDENTIFIER') AS class FROM w LEFT JOIN dict USING (word)""",
    ),
    "normalize_type": Query(
        normalize_type,
        rf"""SELECT o_orderkey, CASE WHEN regexp_matches(t, '(?i)^(varchar|character varying)\(\d+\)$') THEN 'varchar'
        WHEN regexp_matches(t, '(?i)^numeric\(\d+, \d+\)$') THEN 'numeric' WHEN lower(t) = 'timestamp with time zone' THEN 'timezone' END AS type,
        TRY_CAST(regexp_extract(t, '\((\d+)', 1) AS INT) AS size, TRY_CAST(regexp_extract(t, ', (\d+)\)', 1) AS INT) AS scale
        FROM (SELECT o_orderkey, {TYPE_SQL} AS t FROM orders)""",
    ),
    "unquote": Query(unquote, "SELECT p_partkey, p_name AS name FROM part"),
    "select_paths": Query(
        select_paths,
        r"""SELECT url FROM (SELECT url FROM pages WHERE regexp_matches(url, '\.example\.com')
        UNION ALL SELECT url FROM pages WHERE url LIKE '%#top') WHERE NOT regexp_matches(url, '\?page=')""",
    ),
    "declarations": Query(declarations, f"WITH {PAGE_LINES} SELECT * FROM tags"),
    "source_declarations": Query(source_declarations, SOURCE_SQL),
    "format_tag": Query(
        format_tag,
        f"""WITH {PAGE_LINES} SELECT path, prefix || chr(127) || full_name || chr(1) || line || ',' || "offset" AS tag,
        chr(12) || chr(10) || path || ',' || n_chars AS header FROM tags""",
    ),
    "parse_tag": Query(
        parse_tag,
        f"""WITH {PAGE_LINES}, b AS (SELECT *, regexp_replace(path, 'https?:', '') AS bare FROM tags)
        SELECT bare AS path, prefix, full_name AS name, line, string_split(bare, ':')[1] AS candidate_path,
        regexp_extract(bare || ':' || full_name, '[^:]+:(.+)', 1) AS candidate_text FROM b""",
    ),
    "tag_index": Query(
        tag_index, f"WITH {PAGE_LINES} SELECT path, n_chars::BIGINT AS n_chars, full_name AS name, prefix, line FROM tags"
    ),
    "locate_from": Query(
        locate_from,
        r"""WITH a AS (SELECT doc_id, regexp_extract(text, '[a-zA-Z0-9_]+') AS name, string_split(text, chr(10)) AS s FROM documents WHERE text LIKE '%' || chr(10) || '%'),
        b AS (SELECT doc_id, name, list_filter(s[2:], lambda l: contains(l, name))[1] AS line FROM a WHERE name <> '')
        SELECT doc_id, name, substr(line, 1, instr(line, name) + length(name) - 1) AS found FROM b""",
    ),
    "ddl_columns": Query(ddl_columns, DDL_SQL),
    "ddl_constraints": Query(
        ddl_constraints,
        """SELECT 'order' || o_orderkey || '.sql' AS source, 'order' || o_orderkey AS table_name, 'pk_' || o_orderkey AS name,
        'primary_key' AS kind, 'id,s_' || o_orderstatus AS columns FROM orders
        UNION ALL SELECT 'order' || o_orderkey || '.sql', 'lines', NULL, 'unique', 'n' FROM orders
        UNION ALL SELECT 'order' || o_orderkey || '.sql', 'shop.item', name, kind, columns FROM orders,
        (VALUES ('ck', 'other', ''), (NULL, 'other', 'code'), (NULL, 'primary_key', 'code')) k(name, kind, columns) WHERE o_orderstatus = 'F'""",
    ),
    "long_dump_columns": Query(long_dump_columns, LONG_DDL_SQL),
    "catalog_round_trip": Query(catalog_round_trip, DDL_SQL),
}
