"""Queries that complete requests at a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.operators import completion as C
from seqset.plans.base import Query, table


def _statements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A request per customer, as words, and a cursor in it.

    SELECT x.<letter> FROM <brand> AS x , <brand> y (<name>) WHERE k. Customers in debt
    have their cursor behind the first brand, the others behind the letter.
    """
    name, sign = (lambda v: ("IDENTIFIER", v)), (lambda k: (k, F.lit(None).cast("string")))
    brand = F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string"))
    words = [
        sign("SELECT"), name(F.lit("x")), sign("DOT"), name(F.lower(F.substring("c_mktsegment", 1, 1))), sign("FROM"),
        name(brand), sign("AS"), name(F.lit("x")), sign("COMMA"), name(F.lit("Brand#1")), name(F.lit("y")),
        sign("OPAREN"), name(F.lit("blue bolt")), sign("CPAREN"), sign("WHERE"), name(F.lit("k")),
    ]
    row: list[Column] = [F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in words]
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    tokens = customers.select("c_custkey", F.posexplode(F.array(*row)).alias("pos", "w")).select(
        "c_custkey", "pos", "w.kind", "w.value", (F.col("pos") * 10 + 9).alias("end_off")
    )
    cursors = customers.select(
        F.col("c_custkey").alias("request_id"), "c_custkey", F.when(F.col("c_acctbal") < 0, 60).otherwise(40).alias("at")
    )
    return tokens, cursors


def cursor_requests(spark: SparkSession, d: str) -> DataFrame:
    return C.cursor_requests(*_statements(spark, d), "c_custkey").drop("request_id")


def scope_entries(spark: SparkSession, d: str) -> DataFrame:
    found = C.scope_entries(_statements(spark, d)[0], "c_custkey")
    return found.withColumn("items", F.array_join("items", ","))


def complete_at_cursor(spark: SparkSession, d: str) -> DataFrame:
    tokens, cursors = _statements(spark, d)
    requests = C.cursor_requests(tokens, cursors, "c_custkey")
    scope = C.scope_entries(tokens, "c_custkey").withColumnRenamed("c_custkey", "request_id")
    parts = table(spark, d, "part").select(F.col("p_brand").alias("container"), F.col("p_name").alias("item"))
    return C.complete(requests, scope, parts)


REQUESTS = """
r AS (SELECT c_custkey, 'Brand#' || c_nationkey AS brand, lower(substr(c_mktsegment, 1, 1)) AS letter, c_acctbal < 0 AS in_from
      FROM customer)
"""

QUERIES = {
    "cursor_requests": Query(
        cursor_requests,
        f"""WITH {REQUESTS} SELECT c_custkey, CASE WHEN in_from THEN 'FROM' ELSE 'SELECT' END AS context,
        CASE WHEN in_from THEN brand ELSE letter END AS prefix, CASE WHEN NOT in_from THEN 'x' END AS alias FROM r""",
    ),
    "scope_entries": Query(
        scope_entries,
        f"""WITH {REQUESTS} SELECT c_custkey, brand AS container, 'x' AS alias, NULL AS items FROM r
        UNION ALL SELECT c_custkey, 'Brand#1', 'y', 'blue bolt' FROM r""",
    ),
    "complete_at_cursor": Query(
        complete_at_cursor,
        f"""WITH {REQUESTS} SELECT c_custkey AS request_id, 'x.' || p_name AS candidate FROM r
        JOIN (SELECT DISTINCT p_brand, p_name FROM part) ON p_brand = brand AND starts_with(p_name, letter) WHERE NOT in_from
        UNION ALL SELECT c_custkey, p_brand FROM r JOIN (SELECT DISTINCT p_brand FROM part) ON starts_with(p_brand, brand) WHERE in_from""",
    ),
}
