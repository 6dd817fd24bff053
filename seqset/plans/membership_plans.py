"""Queries on membership tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.functions.render import render_from, render_request
from seqset.operators import covers as C
from seqset.operators import families as Z
from seqset.operators import membership as M
from seqset.operators import termination as T
from seqset.operators.skew import apart
from seqset.plans.base import Query, spread, table

WORD = r"[a-zA-Z]+"


def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return M.prefix_filter(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "red")


def prefix_type_filter(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return M.prefix_type_filter(
        part, "p_brand", ["Brand#1", "Brand#2", "Brand#3", "Brand#4"], "p_name", "b", "p_type", ["ECONOMY", "SMALL", "STANDARD"]
    )


def source_words(spark: SparkSession, d: str) -> DataFrame:
    """Membership of words in document sources."""
    documents = spread(table(spark, d, "documents").select("source", "text"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return documents.select(F.col("source").alias("container"), F.explode(words).alias("item"))


def suggestion_requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Requests for the first two letters of each benchmark item, with a scope.

    Items that begin with T name an alias. Items that begin with R have no scope;
    the others see two sources under aliases, an unknown one, and one limited to
    two items.
    """
    begins = F.substring("text", 1, 1)
    benchmark = table(spark, d, "benchmark").select("item_id", "text")
    requests = benchmark.select(
        F.col("item_id").alias("request_id"),
        F.substring("text", 1, 2).alias("prefix"),
        F.when(begins == "T", F.lit("a")).alias("alias"),
    )

    def entry(container: str, alias: str, items: list[str] | None = None) -> Column:
        limited = F.array(*[F.lit(i) for i in items]) if items else F.lit(None).cast("array<string>")
        return F.struct(F.lit(container).alias("container"), F.lit(alias).alias("alias"), limited.alias("items"))

    entries = F.array(
        entry("src7", "a"), entry("src1", "b"), entry("nowhere", "a"), entry("src14", "c", ["The", "Of"])
    )
    scope = benchmark.filter(begins != "R").select(
        F.col("item_id").alias("request_id"), F.explode(entries).alias("e")
    )
    return requests, scope.select("request_id", "e.*")


def scoped_candidates(spark: SparkSession, d: str) -> DataFrame:
    requests, scope = suggestion_requests(spark, d)
    return M.scoped_candidates(requests, scope, source_words(spark, d))


CANDIDATE_SQL = """
WITH words AS (
    SELECT DISTINCT source AS container, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS item FROM documents
), requests AS (
    SELECT item_id AS request_id, substr(text, 1, 2) AS prefix,
           CASE WHEN text LIKE 'T%' THEN 'a' END AS alias FROM benchmark
), entries(container, alias, items) AS (
    VALUES ('src7', 'a', NULL), ('src1', 'b', NULL), ('nowhere', 'a', NULL), ('src14', 'c', ['The', 'Of'])
), scope AS (
    SELECT item_id AS request_id, container, alias, items FROM benchmark, entries WHERE text NOT LIKE 'R%'
), found AS (
    SELECT r.request_id, r.alias, w.container, w.item
    FROM requests r JOIN scope s ON s.request_id = r.request_id AND (r.alias IS NULL OR r.alias = s.alias)
    JOIN words w ON w.container = s.container AND starts_with(w.item, r.prefix)
    WHERE s.items IS NULL OR list_contains(s.items, w.item)
    UNION ALL
    SELECT r.request_id, r.alias, w.container, w.item
    FROM requests r JOIN words w ON starts_with(w.item, r.prefix)
    WHERE r.alias IS NULL AND NOT EXISTS (SELECT 1 FROM scope s WHERE s.request_id = r.request_id)
)
SELECT request_id, container, item, CASE WHEN alias IS NULL THEN item ELSE alias || '.' || item END AS candidate FROM found
"""


def prefix_join(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")
    vocabulary = spread(table(spark, d, "documents").select("text")).select(words)
    prefixes = table(spark, d, "benchmark").select(words).select(F.substring("word", 1, 5).alias("prefix")).distinct()
    return M.prefix_join(prefixes, vocabulary, "prefix", "word", max_len=4)


PREFIX_JOIN_SQL = """
WITH vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM documents),
     prefixes AS (SELECT DISTINCT substr(word, 1, 5) AS prefix
                  FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM benchmark))
SELECT prefix, word FROM prefixes JOIN vocabulary
  ON substr(word, 1, length(prefix)) = prefix
"""


def invert(spark: SparkSession, d: str, **parts: int) -> DataFrame:
    shipped = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return M.invert(shipped, "l_suppkey", "l_partkey", **parts).select(
        "l_partkey", "part", F.array_join(F.col("containers").cast("array<string>"), ",").alias("containers")
    )


def invert_small_parts(spark: SparkSession, d: str) -> DataFrame:
    return invert(spark, d, part_size=5)


INVERT_SQL = """
WITH held AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS n
              FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
SELECT l_partkey, (n - 1) // {size} AS part, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS containers
FROM held GROUP BY 1, 2
"""
GROUP_SQL = """
WITH numbered AS (SELECT l_orderkey, l_returnflag, l_partkey,
                         row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS n FROM lineitem)
SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'all' ELSE l_returnflag END AS qualifier, (n - 1) // 100000 AS part,
       string_agg(l_partkey, ',' ORDER BY l_partkey) AS names
FROM numbered GROUP BY 1, 2, 3
"""


def contains_all(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return M.contains_all(
        lines.select("l_suppkey", "l_partkey"), lines.select("l_orderkey", "l_partkey"),
        "l_orderkey", "l_suppkey", "l_partkey",
    )


CONTAINS_ALL_SQL = """
WITH wanted AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
     held AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
     needed AS (SELECT l_orderkey, count(*) AS n FROM wanted GROUP BY 1)
SELECT l_orderkey, l_suppkey
FROM wanted JOIN held USING (l_partkey) JOIN needed USING (l_orderkey)
GROUP BY l_orderkey, l_suppkey, n HAVING count(*) = n
"""


def regional_stock(spark: SparkSession, d: str) -> DataFrame:
    """Membership of parts in the regions whose suppliers have shipped them."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    # one by one: Spark takes a join for as large as the product of its sides, and would broadcast the lines instead
    of_nation = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return of_nation.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "l_partkey")


def _joined(name: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


def _covers(spark: SparkSession, d: str, **limits: int) -> DataFrame:
    wanted = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return C.covers(wanted, regional_stock(spark, d), "l_orderkey", "l_partkey", "n_regionkey", **limits)


def covers(spark: SparkSession, d: str) -> DataFrame:
    return _covers(spark, d).select("l_orderkey", _joined("cover"), "size")


def covers_grown(spark: SparkSession, d: str) -> DataFrame:
    """The same covers, every request grown item by item as distributed rows."""
    return _covers(spark, d, local_limit=1).select("l_orderkey", _joined("cover"), "size")


def rank_by_size(spark: SparkSession, d: str) -> DataFrame:
    ranked = C.rank_by_size(_covers(spark, d), "l_orderkey", "cover", again=True)
    return ranked.select("l_orderkey", _joined("cover"), "rank")


COVERS_CTE = """
held AS (
    SELECT DISTINCT n_regionkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), wanted AS (
    SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k,
           count(*) OVER (PARTITION BY l_orderkey) AS n
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {items})
), grown AS (
    SELECT DISTINCT l_orderkey, n, 0::BIGINT AS k, []::INTEGER[] AS cover FROM wanted
    UNION
    SELECT g.l_orderkey, g.n, w.k, list_sort(list_distinct(list_append(g.cover, h.n_regionkey)))
    FROM grown g JOIN wanted w ON w.l_orderkey = g.l_orderkey AND w.k = g.k + 1 JOIN held h ON h.l_partkey = w.l_partkey
), covers AS (
    SELECT DISTINCT l_orderkey, cover, len(cover)::INT AS size FROM grown WHERE k = n
)"""

COVERS_SQL = (
    "WITH RECURSIVE " + COVERS_CTE.format(items="lineitem")
    + " SELECT l_orderkey, array_to_string(cover, ',') AS cover, size FROM covers"
)
RANK_SQL = (
    "WITH RECURSIVE " + COVERS_CTE.format(items="lineitem")
    + """ SELECT l_orderkey, array_to_string(cover, ',') AS cover,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY size DESC, cover) AS rank FROM covers"""
)


MANY, BEST = 12, 3


def covers_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Orders with at most MANY covers with all of them, the others with their number alone."""
    wanted = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    found, more = Z.counted_covers(wanted, regional_stock(spark, d), "l_orderkey", "l_partkey", "n_regionkey", max_covers=MANY)
    listed = found.select("l_orderkey", _joined("cover"), "rank", F.col("n_covers").cast("bigint").alias("n_covers"))
    none = [F.lit(None).cast("string").alias("cover"), F.lit(None).cast("bigint").alias("rank")]
    return listed.unionByName(more.select("l_orderkey", *none, F.col("n_covers").cast("bigint").alias("n_covers")))


def best_covers(spark: SparkSession, d: str) -> DataFrame:
    """The first covers of each order in the order of `rank_by_size`, and how many there are."""
    wanted = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    found = Z.best_covers(wanted, regional_stock(spark, d), "l_orderkey", "l_partkey", "n_regionkey", BEST)
    return found.select("l_orderkey", _joined("cover"), "rank", F.col("n_covers").cast("bigint").alias("n_covers"))


def best_pinned_covers(spark: SparkSession, d: str) -> DataFrame:
    """The first answers of each order whose returned parts must share a region."""
    lines = _qualified_lines(spark, d)
    found = Z.best_covers(lines, regional_stock(spark, d), "l_orderkey", "l_partkey", "n_regionkey", BEST, "qualifier")
    return found.select("l_orderkey", _joined("cover"), "rank", F.col("n_covers").cast("bigint").alias("n_covers"))


RANKED_CTE = COVERS_CTE.format(items="lineitem") + """, ranked AS (
    SELECT l_orderkey, array_to_string(cover, ',') AS cover, row_number() OVER (PARTITION BY l_orderkey ORDER BY size DESC, cover) AS rank,
           count(*) OVER (PARTITION BY l_orderkey) AS n_covers FROM covers
)"""
OVERFLOW_SQL = f"""WITH RECURSIVE {RANKED_CTE}
SELECT l_orderkey, cover, rank, n_covers FROM ranked WHERE n_covers <= {MANY}
UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, n_covers FROM ranked WHERE n_covers > {MANY}"""
BEST_SQL = f"WITH RECURSIVE {RANKED_CTE} SELECT l_orderkey, cover, rank, n_covers FROM ranked WHERE rank <= {BEST}"


def _qualified_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "returned").alias("qualifier")
    )


def pinned_covers(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "returned").alias("qualifier")
    )
    found = C.pinned_covers(lines, regional_stock(spark, d), "l_orderkey", "qualifier", "l_partkey", "n_regionkey")
    text = render_request({"select": F.lit("SELECT l_partkey"), "from": render_from(F.col("cover"))})
    return found.select("l_orderkey", "size", "rank", text.alias("request"))


PINNED_SQL = (
    "WITH RECURSIVE "
    + COVERS_CTE.format(items="(SELECT * FROM lineitem WHERE l_returnflag <> 'R')")
    + """, pinned AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
needed AS (SELECT l_orderkey, count(*) AS n FROM pinned GROUP BY 1),
pins AS (
    SELECT l_orderkey, n_regionkey FROM pinned JOIN held USING (l_partkey) JOIN needed USING (l_orderkey)
    GROUP BY l_orderkey, n_regionkey, n HAVING count(*) = n
), answers AS (
    SELECT l_orderkey, cover, size FROM covers WHERE l_orderkey NOT IN (SELECT l_orderkey FROM pinned)
    UNION ALL
    SELECT DISTINCT c.l_orderkey, c.cover, c.size FROM covers c JOIN pins p
      ON p.l_orderkey = c.l_orderkey AND list_contains(c.cover, p.n_regionkey)
    UNION ALL
    SELECT l_orderkey, [n_regionkey], 1::INT FROM pins WHERE l_orderkey NOT IN (SELECT l_orderkey FROM wanted)
)
SELECT l_orderkey, size, row_number() OVER (PARTITION BY l_orderkey ORDER BY size DESC, cover) AS rank,
       'SELECT l_partkey FROM ' || array_to_string(cover, ' , ') || ' ;' AS request
FROM answers"""
)


BEST_PINNED_SQL = PINNED_SQL[: PINNED_SQL.rindex("SELECT l_orderkey, size, row_number()")] + f"""
SELECT l_orderkey, array_to_string(cover, ',') AS cover, row_number() OVER w AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n_covers
FROM answers WINDOW w AS (PARTITION BY l_orderkey ORDER BY size DESC, cover) QUALIFY row_number() OVER w <= {BEST}"""


def terminate_requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests for their parts; finished ones already name a source."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    none = F.lit(None).cast("string")
    sections = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.concat(F.lit("SELECT order"), "o_orderkey").alias("select"),
        F.when(status == "F", "FROM stock").alias("from"),
        F.when(priority != "5-LOW", F.concat(F.lit("WHERE p = "), priority)).alias("where"),
        F.when(priority == "2-HIGH", "GROUP BY p").alias("group_by"),
        none.alias("having"),
        F.when(status == "O", "ORDER BY p").alias("order_by"),
    )
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "returned").alias("qualifier")
    )
    return T.terminate_requests(
        sections, lines, regional_stock(spark, d), "l_orderkey", "qualifier", "l_partkey", "n_regionkey"
    )


TERMINATE_TAIL = """
SELECT l_orderkey, size, row_number() OVER (PARTITION BY l_orderkey ORDER BY size DESC, cover) AS rank,
       concat_ws(' ', 'SELECT order' || l_orderkey, 'FROM ' || array_to_string(cover, ' , '),
                 CASE WHEN o_orderpriority <> '5-LOW' THEN 'WHERE p = ' || o_orderpriority END,
                 CASE WHEN o_orderstatus = 'O' THEN 'ORDER BY p' END, ';') AS text
FROM answers JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus <> 'F' AND o_orderpriority <> '2-HIGH'
"""


def order_words(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests in words: SELECT returned.<part> , <part> … and what their status and priority add."""
    def word(kind: str, value: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if value is None else value).cast("string").alias("value"))

    def name(value: Column | str) -> Column:
        return word("IDENTIFIER", F.lit(value))

    none = F.array().cast("array<struct<kind:string,value:string>>")
    part = F.struct("l_partkey", F.when(F.col("l_returnflag") == "R", "returned").alias("qualifier"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(part)).alias("parts"))

    def entry(p: Column, i: Column) -> Column:
        comma = F.when(i > 0, F.array(word("COMMA"))).otherwise(none)
        qualifier = F.when(p["qualifier"].isNotNull(), F.array(name(p["qualifier"]), word("DOT"))).otherwise(none)
        return F.concat(comma, qualifier, F.array(name(p["l_partkey"])))

    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    added = [
        F.when(status == "F", F.array(word("FROM"), name("stock"))),
        F.when(priority != "5-LOW", F.array(word("WHERE"), name("p"), word("EQUAL"), name(priority))),
        F.when(priority == "2-HIGH", F.array(word("GROUP"), word("BY"), name("p"))),
        F.when(status == "O", F.array(word("ORDER"), word("BY"), name("p"))),
    ]
    words = F.concat(
        F.array(word("SELECT")), F.flatten(F.transform("parts", entry)), *[F.coalesce(a, none) for a in added],
        F.array(word("SEMICOLON")),
    )
    return apart(lines).join(orders, "l_orderkey").select("l_orderkey", F.posexplode(words).alias("pos", "w")).select("l_orderkey", "pos", "w.*")


def terminate_words(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests in words, completed."""
    stock = regional_stock(spark, d).withColumn("l_partkey", F.col("l_partkey").cast("string"))
    return T.terminate_words(order_words(spark, d), stock, "l_orderkey", "l_partkey", "n_regionkey")


TERMINATE_WORDS_TAIL = """, entries AS (
    SELECT l_orderkey, string_agg(coalesce(q || '.', '') || l_partkey, ' , ' ORDER BY l_partkey, q NULLS FIRST) AS entries
    FROM (SELECT DISTINCT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS q FROM lineitem) GROUP BY 1
)
SELECT l_orderkey, size, row_number() OVER (PARTITION BY l_orderkey ORDER BY size DESC, cover) AS rank,
       concat_ws(' ', 'SELECT ' || entries, 'FROM ' || array_to_string(cover, ' , '),
                 CASE WHEN o_orderpriority <> '5-LOW' THEN 'WHERE p = ' || o_orderpriority END,
                 CASE WHEN o_orderstatus = 'O' THEN 'ORDER BY p' END, ';') AS text
FROM answers JOIN entries USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus <> 'F' AND o_orderpriority <> '2-HIGH'
"""


def group_by_qualifier(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(flag != "N", flag).alias("flag"))
    grouped = M.group_by_qualifier(lines, "l_orderkey", "flag", "l_partkey")
    return grouped.select("l_orderkey", "qualifier", "part", _joined("names"))


def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return M.distinct_rows(table(spark, d, "part").select("p_brand", "p_type"))


def _order_brands(spark: SparkSession, d: str) -> DataFrame:
    """Rows (order, flag, brand); an order has at most the 25 brands, which bounds its sets."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines.l_partkey == part.p_partkey).select("l_orderkey", "l_returnflag", "p_brand")


def distinct_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = _order_brands(spark, d).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("brands"))
    return M.distinct_sets(sets.select("brands"), "brands").select(_joined("brands"))


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "props")
    return M.last_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def is_subset(spark: SparkSession, d: str) -> DataFrame:
    def brands(flag: str) -> Column:
        return F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("p_brand")))

    sets = _order_brands(spark, d).groupBy("l_orderkey").agg(brands("R").alias("returned"), brands("A").alias("accepted"))
    return sets.select("l_orderkey", M.is_subset(F.col("returned"), F.col("accepted")).alias("within"))


def filter_containing_any(spark: SparkSession, d: str) -> DataFrame:
    sets = _order_brands(spark, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
    pins = F.array(F.array(F.lit("Brand#1"), F.lit("Brand#2")), F.array(F.lit("Brand#3")))
    return sets.filter(C.filter_containing_any(F.col("brands"), pins)).select("l_orderkey", _joined("brands"))


def intersect_items(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    returned, accepted = (
        lines.filter(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey") for flag in ("R", "A")
    )
    return M.intersect_items(returned, accepted)


def remove_key(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return M.remove_key(customers, "c_mktsegment", "MACHINERY")


def combine_one_each(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    # segments, priorities and statuses are small fixed domains, which bounds the lists
    seen = (
        customers.join(orders, customers.c_custkey == orders.o_custkey)
        .groupBy("c_nationkey")
        .agg(
            F.sort_array(F.collect_set("c_mktsegment")).alias("segment"),
            F.sort_array(F.collect_set("o_orderpriority")).alias("priority"),
            F.sort_array(F.collect_set("o_orderstatus")).alias("status"),
        )
    )
    return C.combine_one_each(seen, ["segment", "priority", "status"]).drop("position")


COMBINE_SQL = """
WITH seen AS (SELECT DISTINCT c_nationkey, c_mktsegment, o_orderpriority, o_orderstatus
              FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT c_nationkey, segment, priority, status
FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS segment FROM seen)
JOIN (SELECT DISTINCT c_nationkey, o_orderpriority AS priority FROM seen) USING (c_nationkey)
JOIN (SELECT DISTINCT c_nationkey, o_orderstatus AS status FROM seen) USING (c_nationkey)
"""

BRANDS = "SELECT l_orderkey, l_returnflag, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey"

QUERIES = {
    "prefix_filter": Query(
        prefix_filter, "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')"
    ),
    "prefix_type_filter": Query(
        prefix_type_filter,
        "SELECT p_partkey, p_brand, p_name, p_type FROM part WHERE p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4') "
        "AND p_name LIKE 'b%' AND p_type IN ('ECONOMY','SMALL','STANDARD')",
    ),
    "scoped_candidates": Query(scoped_candidates, CANDIDATE_SQL),
    "prefix_join": Query(prefix_join, PREFIX_JOIN_SQL),
    "invert": Query(invert, INVERT_SQL.format(size=100_000)),
    "invert_small_parts": Query(invert_small_parts, INVERT_SQL.format(size=5)),
    "contains_all": Query(contains_all, CONTAINS_ALL_SQL),
    "covers": Query(covers, COVERS_SQL),
    "covers_grown": Query(covers_grown, COVERS_SQL),
    "rank_by_size": Query(rank_by_size, RANK_SQL),
    "covers_overflow": Query(covers_overflow, OVERFLOW_SQL),
    "best_covers": Query(best_covers, BEST_SQL),
    "best_pinned_covers": Query(best_pinned_covers, BEST_PINNED_SQL),
    "pinned_covers": Query(pinned_covers, PINNED_SQL),
    "terminate_requests": Query(
        terminate_requests, PINNED_SQL[: PINNED_SQL.rindex("SELECT l_orderkey, size, row_number()")] + TERMINATE_TAIL
    ),
    "terminate_words": Query(
        terminate_words, PINNED_SQL[: PINNED_SQL.rindex("SELECT l_orderkey, size, row_number()")].rstrip() + TERMINATE_WORDS_TAIL
    ),
    "group_by_qualifier": Query(group_by_qualifier, GROUP_SQL),
    "distinct_rows": Query(distinct_rows, "SELECT DISTINCT p_brand, p_type FROM part"),
    "distinct_sets": Query(
        distinct_sets,
        f"SELECT DISTINCT array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM ({BRANDS}) GROUP BY l_orderkey",
    ),
    "last_wins": Query(
        last_wins,
        "SELECT user_id, event_type, event_id, props FROM events "
        "QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    ),
    "is_subset": Query(
        is_subset,
        f"""WITH b AS ({BRANDS})
        SELECT l_orderkey, NOT EXISTS (SELECT 1 FROM b r WHERE r.l_orderkey = o.l_orderkey AND r.l_returnflag = 'R'
          AND NOT EXISTS (SELECT 1 FROM b a WHERE a.l_orderkey = r.l_orderkey AND a.p_brand = r.p_brand AND a.l_returnflag = 'A')) AS within
        FROM (SELECT DISTINCT l_orderkey FROM b) o""",
    ),
    "filter_containing_any": Query(
        filter_containing_any,
        f"SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM ({BRANDS}) GROUP BY 1 "
        "HAVING bool_or(p_brand = 'Brand#3') OR (bool_or(p_brand = 'Brand#1') AND bool_or(p_brand = 'Brand#2'))",
    ),
    "intersect_items": Query(
        intersect_items,
        "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' "
        "INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'",
    ),
    "remove_key": Query(
        remove_key, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'"
    ),
    "combine_one_each": Query(combine_one_each, COMBINE_SQL),
}
