"""A whole corpus from scripts to answers: cleaning, engines, choice among them, documents and envelopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs import corpus, datax, graph, resolve
from lineage_jobs.runtime import by_text, materialize
from lineage_jobs.schemas import EDGE_PARTS, ENGINE_RANK

PARTS = {"tables": ["id", "role", "ord"], "table_columns": ["tbl", "col", "ord"], "table_edges": ["source", "target", "seq"], "column_edges": [*EDGE_PARTS, "seq"]}


def _coded(found: dict[str, DataFrame], place: str | None) -> DataFrame:
    """``(script_id, seq, warning)``: an engine's warnings, and one for each table that lost columns."""
    own = found["warnings"]
    told = own.select("script_id", F.col("seq").cast("long").alias("seq"), "warning") if place is None else own.select("script_id", F.col(place).cast("long").alias("seq"), F.col("code").alias("warning"))
    return told.unionByName(found["cut"].select("script_id", F.lit(1 << 40).alias("seq"), F.concat(F.lit("columns_cut: "), "tbl").alias("warning")))


def foreign_graph(found: dict[str, DataFrame], strict: bool = False) -> dict[str, DataFrame]:
    """The graph tables of another engine (see :func:`corpus.engine_graph_json`), normalised; graphs without tables
    are failed attempts."""
    n = found["tables"].where("trim(id) <> ''").groupBy("script_id").agg(F.count(F.lit(1)).alias("n_tables"))
    attempts = corpus.attempt_reject_empty(found["attempts"].join(n, "script_id", "left")).drop("n_tables")
    declared = found["tables"].withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
    return graph.normalize_graph(declared, found["table_edges"], found["column_edges"], strict) | {"warnings": found["warnings"], "attempts": attempts}


def _answers(found: dict[str, DataFrame], place: str | None) -> dict[str, DataFrame]:
    """``attempts`` of an engine and ``documents(script_id, graph)`` of its graphs."""
    parts = [found[p].select("script_id", *cols) for p, cols in PARTS.items()]
    return {"attempts": found["attempts"], "documents": corpus.graph_document(*parts, _coded(found, place))}


def analyse_corpus(scripts: DataFrame, others: dict[str, dict[str, DataFrame]] | None = None, own: str = "sqlglot", strict: bool = False, ranks: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """``responses(script_id, ok, response)``, ``picks``, ``attempts`` and ``documents(script_id, graph)`` of a corpus.

    ``scripts(script_id, text, dialect, preference)``. Texts are cleaned; jobs and SQL are mined; ``others`` holds the flat
    graph tables of further engines by name. Of the engines that a script's preference admits the first in rank with a
    table gives the graph. The SQL mining of this library stands under the name ``own``. Scripts without text are
    rejected before any engine; null preferences count as ``auto``. ``ranks`` gives the order of the engines where ``others`` has
    ones of its own (see :mod:`lineage_jobs.extension`).
    """
    cleaned = materialize(corpus.input_classify(corpus.input_clean(scripts)))
    usable = cleaned.where("reject_reason is null")
    # documents of equal texts are equal: they are made once a text, and given to the scripts that chose their engine
    found = {
        "datax": by_text(usable, lambda texts: _answers(datax.datax_lineage(texts, strict), "content_idx"), ["text"]),
        own: by_text(usable.where("kind = 'sql'"), lambda texts: _answers(resolve.sql_lineage(texts, strict), "stmt_idx"), ["text"]),
    }
    found |= {name: _answers(foreign_graph(tables, strict), None) for name, tables in (others or {}).items()}
    tried = []
    for name, answers in found.items():
        tried.append(answers["attempts"].select("script_id", F.lit(name).alias("engine"), F.lit((ranks or ENGINE_RANK)[name]).alias("engine_rank"), "ok", "message"))
    candidates = materialize(usable.select("script_id", "preference").join(reduce(DataFrame.unionByName, tried), "script_id"))
    picks = materialize(corpus.fallback_pick(candidates, ranks))
    attempts = corpus.attempt_log(candidates)
    chosen = picks.where("ok").select("script_id", "engine")
    made = [answers["documents"].withColumn("engine", F.lit(name)) for name, answers in found.items()]
    documents = materialize(reduce(DataFrame.unionByName, made).join(chosen, ["script_id", "engine"]).drop("engine"))
    return {"responses": corpus.response_envelope(cleaned, picks, attempts, documents), "picks": picks, "attempts": attempts, "documents": documents}
