"""Queries in the relational forms that a request may be written in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.plans.base import Query, table


def select_list(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").alias("n")
    return n.select(F.col("n.n_name").alias("nation"), F.col("n.n_regionkey"))


def distinct_and_all(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderpriority")
    return orders.distinct().withColumn("form", F.lit("distinct")).unionByName(
        orders.withColumn("form", F.lit("all"))
    )


def comma_list(spark: SparkSession, d: str) -> DataFrame:
    """Tables listed with alias and column list; the condition makes it an equi-join."""
    regions = table(spark, d, "region").toDF("id", "label").alias("r")
    nations = table(spark, d, "nation").alias("n")
    return regions.join(nations, F.col("r.id") == F.col("n.n_regionkey")).select("r.label", "n.n_name")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name")


def inner_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = _orders(spark, d), _customers(spark, d)
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select("o_orderkey", "c_name")


def left_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = _orders(spark, d), _customers(spark, d)
    return c.join(o, o.o_custkey == c.c_custkey, "left").select("c_custkey", "o_orderkey")


def right_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = _orders(spark, d), _customers(spark, d)
    return o.join(c, o.o_custkey == c.c_custkey, "right").select("c_custkey", "o_orderkey")


def _documents_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, d, "documents").select("doc_id", "lang"),
        table(spark, d, "labels").select("doc_id", "quality"),
    )


def full_join(spark: SparkSession, d: str) -> DataFrame:
    documents, labels = _documents_labels(spark, d)
    joined = documents.join(labels.withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"), "full")
    return joined.select("doc_id", "lang", "label_id", "quality")


def natural_joins(spark: SparkSession, d: str) -> DataFrame:
    documents, labels = _documents_labels(spark, d)
    shared = [c for c in documents.columns if c in labels.columns]
    parts = [
        documents.join(labels, shared, how).select("doc_id", "lang", "quality", F.lit(how).alias("form"))
        for how in ("inner", "left", "right", "full")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def union_join(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return region.unionByName(supplier, allowMissingColumns=True)


def where_section(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    kept = (
        (F.col("p_brand") == "Brand#1")
        | (F.col("p_name").like("red%") & F.col("p_type").isin("ECONOMY", "SMALL"))
    ) & ~(F.col("p_name").isNull()) & (~F.col("p_size").eqNullSafe(F.lit(1)) | F.lit(False))
    return part.filter(kept)


def grouped_sections(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey")
    return (
        orders.groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_orders"))
        .filter(F.col("n_orders") > 5)
        .orderBy(F.col("n_orders").desc(), "o_custkey")
    )


NATURAL = " UNION ALL ".join(
    f"SELECT doc_id, lang, quality, '{how}' AS form FROM (SELECT doc_id, lang FROM documents) a "
    f"NATURAL {how.upper()} JOIN (SELECT doc_id, quality FROM labels) b"
    for how in ("inner", "left", "right", "full")
)

QUERIES = {
    "select_list": Query(select_list, "SELECT n.n_name AS nation, n.n_regionkey FROM nation AS n"),
    "distinct_and_all": Query(
        distinct_and_all,
        "SELECT DISTINCT o_orderpriority, 'distinct' AS form FROM orders "
        "UNION ALL SELECT ALL o_orderpriority, 'all' FROM orders",
    ),
    "comma_list": Query(
        comma_list, "SELECT r.label, n.n_name FROM region AS r (id, label), nation n WHERE r.id = n.n_regionkey"
    ),
    "inner_join": Query(
        inner_join, "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey"
    ),
    "left_join": Query(
        left_join, "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON o_custkey = c_custkey"
    ),
    "right_join": Query(
        right_join, "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON o_custkey = c_custkey"
    ),
    "full_join": Query(
        full_join,
        "SELECT d.doc_id, lang, l.doc_id AS label_id, quality FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "natural_joins": Query(natural_joins, NATURAL),
    "union_join": Query(
        union_join,
        "SELECT r_regionkey, r_name, NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name FROM region "
        "UNION ALL SELECT NULL, NULL, s_suppkey, s_name FROM supplier",
    ),
    "where_section": Query(
        where_section,
        "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE (p_brand = 'Brand#1' OR "
        "(p_name LIKE 'red%' AND p_type IN ('ECONOMY','SMALL'))) AND NOT p_name IS NULL "
        "AND (p_size IS DISTINCT FROM 1 OR FALSE)",
    ),
    "grouped_sections": Query(
        grouped_sections,
        "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 5 "
        "ORDER BY n_orders DESC, o_custkey",
    ),
}
