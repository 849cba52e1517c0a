"""Work that grew out of proportion: what plans repeat, and what ran in one task or through the driver."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, same_rows
from lineage_jobs import closure, datax, fixtures, queries, resolve, service
from lineage_jobs.fixtures import derived
from lineage_jobs.runtime import by_text, dealt_out


def json_reads(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_alignment_reads_a_job_once(spark, duck):
    """filters on resolved columns are not answered by reading the job's JSON again."""
    df = queries.QUERIES["datax_column_align"](spark, SMALL)
    assert json_reads(df) <= json_reads(datax.datax_sides(datax.datax_contents(datax.datax_parse(derived(spark, SMALL, fixtures.DATAX_JOBS))))) < 60
    same_rows(df, duck.execute(queries.ORACLES["datax_column_align"]).df())


def test_table_edges_deal_out_a_single_file(spark, duck):
    """jobs from a file of one row group are mined by all cores, and read once."""
    df = queries.QUERIES["datax_table_edges"](spark, SMALL)
    assert json_reads(df) < 60
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    same_rows(df, duck.execute(queries.ORACLES["datax_table_edges"]).df())


COPIES = [(k, text) for k, text in enumerate(["insert into a.b select c.d from e.f c", "select 1 from g.h", None, "insert into a.b select c.d from e.f c", "select 1 from g.h", None, "select 1 from g.h"])]


def test_equal_texts_are_mined_once(spark):
    """each distinct text is mined once, nulls and dialects told apart, and every script gets its rows; distinct texts are mined as they are."""
    seen = []

    def mine(texts):
        seen.append(texts.count())
        return {"rows": texts.select("script_id", F.upper("text").alias("big"))}

    df = spark.createDataFrame(COPIES, "script_id long, text string")
    assert sorted(map(tuple, by_text(df, mine)["rows"].collect())) == [(k, text and text.upper()) for k, text in COPIES]
    spoken = df.withColumn("dialect", F.when(F.col("script_id") < 3, "hive"))
    assert sorted(map(tuple, by_text(spoken, mine)["rows"].collect())) == [(k, text and text.upper()) for k, text in COPIES]
    assert seen == [3, 7]


def test_sources_of_copies(spark, duck):
    """statements are written once and mined by text, not once for each of the tables that need them."""
    query = queries.QUERIES["sql_physical_sources"]
    df = query(spark, SMALL)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_") == 0
    same_rows(df, duck.execute(queries.ORACLES["sql_physical_sources"]).df())


#: F6, F8, F9, F10, F12, F13, F20
MINED_BY_TEXT = ["derived_passthrough", "sql_read_only_tables", "sql_table_edges", "sql_table_edges_hard", "insert_column_rename", "merge_edges", "update_edges"]


@pytest.mark.parametrize("name", MINED_BY_TEXT)
def test_operator_mines_each_text_once(spark, duck, monkeypatch, name):
    """The statements that an operator mines are those of distinct texts, and every script has its rows."""
    mined = []
    monkeypatch.setattr(queries, "dealt_out", lambda texts: mined.append(texts) or dealt_out(texts))
    df = queries.QUERIES[name](spark, SMALL)
    texts, = mined
    assert texts.count() == texts.select("text").distinct().count() < 1000
    same_rows(df, duck.execute(queries.ORACLES[name]).df())


def test_query_jobs_are_mined_once(spark, duck, monkeypatch):
    """jobs whose readers have queries are parsed and mined by text; the sides are written, not parsed for each join."""
    seen = []
    monkeypatch.setattr(queries, "by_text", lambda scripts, mine: seen.append(scripts) or by_text(scripts, mine))
    df = queries.QUERIES["datax_query_columns"](spark, SMALL)
    assert len(seen) == 1 and json_reads(df) == 0
    same_rows(df, duck.execute(queries.ORACLES["datax_query_columns"]).df())


def test_corpora_are_mined_by_text(spark, monkeypatch):
    """statements and documents of equal texts are made once."""
    seen, mine, document = [], resolve._sql_lineage, service.corpus.graph_document
    monkeypatch.setattr(resolve, "_sql_lineage", lambda texts, strict: seen.append(texts.count()) or mine(texts, strict))
    df = spark.createDataFrame([(k, text or "update x.y set z = 1") for k, text in COPIES], "script_id long, text string")
    got = resolve.sql_lineage(df)
    assert seen == [3]
    assert sorted(r[0] for r in got["table_edges"].select("script_id").collect()) == [0, 3]
    monkeypatch.setattr(service.corpus, "graph_document", lambda tables, *rest: seen.append(tables.select("script_id").distinct().count()) or document(tables, *rest))
    answers = service.analyse_corpus(df.withColumns({"dialect": F.lit("hive"), "preference": F.lit("auto")}))
    assert answers["documents"].count() == len(COPIES) and max(seen) == 3


@pytest.mark.parametrize("most", [0, 3, 200])
def test_closures_by_row_and_by_steps(spark, monkeypatch, most):
    """small scripts are closed in one row each and large ones by steps, with the same nodes; seeds without edges stay."""
    monkeypatch.setattr(closure, "SMALL_SCRIPT", most)
    steps = []
    connected = closure.connected_components
    monkeypatch.setattr(closure, "connected_components", lambda *a: steps.append(1) or connected(*a))
    links = [(1, "a", "b"), (1, "c", "b"), (1, "d", "e"), (1, "c", "f"), (2, "a", "z"), (2, "y", "x"), (2, "x", "a"), (3, "m", "n")]
    edges = spark.createDataFrame(links, "script_id long, source string, target string")
    seeds = spark.createDataFrame([(1, "f"), (2, "z"), (4, "q"), (2, "z")], "script_id long, id string")
    nodes, kept = closure.table_closure(edges, seeds)
    assert sorted(map(tuple, nodes.collect())) == [(1, "a"), (1, "b"), (1, "c"), (1, "f"), (2, "a"), (2, "x"), (2, "y"), (2, "z"), (4, "q")]
    assert kept.count() == 6 and bool(steps) == (most < 200)


#: F11, F15, F17
CLOSED_BY_ROW = ["closure_flag", "column_closure", "edge_focus"]


@pytest.mark.parametrize("name", CLOSED_BY_ROW)
def test_small_scripts_take_no_steps(spark, duck, monkeypatch, name):
    """No script of the fixture is large, so that none is closed by steps over all edges."""
    monkeypatch.setattr(closure, "connected_components", lambda *a: pytest.fail("closed by steps"))
    same_rows(queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLES[name]).df())
