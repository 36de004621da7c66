"""A choice of queries gives their SQL's rows on the smallest tables, where these are there."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cladeflow.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["even_split_abundance", "clr_transform", "bray_curtis", "confusion_rates", "area_under_curve", "n50_by_source", "node_statistics", "network_components", "interval_overlaps", "benjamini_hochberg", "event_windows", "read_assignments", "macro_averages_strict", "network_edge_shares", "listed_degree", "exclusive_taxa", "contained_reads", "degree_statistics", "last_value_table", "length_summary", "suffix_order"]


def rows(frame):
    cell = lambda v: repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_registry_is_whole():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
