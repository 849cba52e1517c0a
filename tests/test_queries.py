"""Queries against their SQL at the smallest scale; the driver holds all of them at a larger one."""

import pytest

from conftest import SMALL, same_rows
from lineage_jobs.queries import ORACLES, QUERIES

SLOW = {
    "datax_query_columns", "datax_first_query", "insert_column_rename", "derived_passthrough", "merge_edges", "update_edges", "union_merge",
    "scalar_subquery_sources", "lineage_reach", "longest_path_rank_cyclic", "layer_geometry", "closure_flag", "edge_focus", "engine_stats",
    "datax_qualify", "datax_side_tables", "datax_column_align", "datax_columns", "sql_physical_sources", "sql_read_only_tables", "table_order",
    "resolve_star", "resolve_unqualified", "graph_stats", "table_column_edges", "closure_components",
}


def test_all_have_sql_but_one():
    assert set(QUERIES) - set(ORACLES) == {"layer_barycenter_order"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck.execute(ORACLES[name]).df())
