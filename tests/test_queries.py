"""Every registered query beside its SQL twin, and the shape of the plans."""

import io
import re
from contextlib import redirect_stdout

import pytest
from compare import differences, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = {n: q.run for n, q in entry._ALL.items()}, entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    problem, rows = differences(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert not problem and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name",
    [n for n in QUERIES if not n.startswith("stream_") and n not in ("serve_requests", "refresh_static")],
)
def test_plans_hold_at_scale(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    # no window, join or sort gathers everything in one task
    assert "SinglePartition" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["prefix_filter"](spark, FOLDER))
    assert "StringStartsWith(p_name,red)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan(QUERIES["invert"](spark, FOLDER))


@pytest.mark.parametrize("name", ["ordered_symbols", "read_lines", "take_chars", "select_paths", "ddl_columns", "ddl_constraints"])
def test_texts_are_cut_without_a_shuffle_by_key(spark, name):
    assert "hashpartitioning" not in plan(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["forward_fill", "extract_from_to", "split_records", "drop_blocks", "split_by_markers"])
def test_sequences_shuffle_once(spark, name):
    assert len(re.findall(r"- Exchange \(\d+\)", plan(QUERIES[name](spark, FOLDER)))) == 1
