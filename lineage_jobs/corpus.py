"""Sources and sinks of script corpora, engine replies, routing between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineage_jobs.runtime import strip
from lineage_jobs.schemas import (
    DEFAULT_DIALECT,
    DIALECT_COLUMNS,
    EDGE_PARTS,
    ENGINE_RANK,
    GRAPH_SCHEMA,
    MAX_PROMPT_CHARS,
    ROLES,
    dialect_table,
)

BOM = "﻿"


# -- sources ---------------------------------------------------------------------------------------------------


def corpus_read(spark: SparkSession, path: str, pattern: str = "*.{sql,txt,ddl,json}") -> DataFrame:
    """``(path, text)``: one row for each script file below ``path``, read as UTF-8."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def input_clean(scripts: DataFrame) -> DataFrame:
    """``scripts`` with stripped texts and ``reject_reason``: ``empty`` where nothing is left, else null."""
    text = strip(F.regexp_replace(strip(F.coalesce("text", F.lit(""))), f"^{BOM}+", ""))
    return scripts.withColumn("text", text).withColumn("reject_reason", F.when(F.col("text") == "", "empty"))


def input_classify(scripts: DataFrame) -> DataFrame:
    """``scripts`` with ``kind``: ``json`` if the text starts with a brace, white space aside, else ``sql``."""
    return scripts.withColumn("kind", F.when(F.col("text").rlike(r"^\s*+\{"), "json").otherwise("sql"))


def dialect_resolve(scripts: DataFrame) -> DataFrame:
    """``scripts`` with the columns of their dialect, prefixed ``dialect_``; unknown and null keys take the default's."""
    known = dialect_table(scripts.sparkSession)
    named = known.select(*[F.col(c).alias(f"dialect_{c}") for c in DIALECT_COLUMNS])
    keys = [r["key"] for r in known.select("key").collect()]  # 14 rows
    chosen = F.when(F.col("dialect").isin(keys), F.col("dialect")).otherwise(F.lit(DEFAULT_DIALECT))
    return scripts.join(F.broadcast(named), chosen == F.col("dialect_key"))  # 14 rows


# -- replies of engines ----------------------------------------------------------------------------------------


def parsed_graph(column):
    """A reply as a struct; broken text gives a struct of nulls."""
    return F.from_json(column, GRAPH_SCHEMA)


def _facts(parsed: DataFrame, table_name: str) -> dict[str, DataFrame]:
    """Flat tables from rows ``(script_id, g)`` of graph structs."""
    at = lambda name: F.posexplode(f"g.{name}").alias("seq", "x")
    tables = parsed.select("script_id", at("tables")).select(
        "script_id", "seq", F.col(f"x.{table_name}").alias("id"), F.col("x.role").alias("role"), F.col("x.columns").alias("columns")
    )
    table_edges = parsed.select("script_id", at("table_edges")).select("script_id", "seq", "x.source", "x.target")
    column_edges = parsed.select("script_id", at("column_edges")).select("script_id", "seq", *[f"x.{c}" for c in EDGE_PARTS])
    warnings = parsed.select("script_id", at("warnings")).select("script_id", "seq", F.col("x").alias("warning"))
    return {"tables": tables, "table_edges": table_edges, "column_edges": column_edges, "warnings": warnings}


def engine_graph_json(replies: DataFrame) -> dict[str, DataFrame]:
    """Flat graph tables and ``attempts`` from rows ``(script_id, json)`` of an engine.

    A reply with an ``error`` is a failed attempt with that message and adds nothing to the graph; so is text that
    isn't a graph.
    """
    parsed = replies.select("script_id", parsed_graph(F.col("json")).alias("g"))
    bad = F.coalesce(F.col("g.error"), F.when(F.col("g.tables").isNull(), F.lit("not a graph")))
    attempts = parsed.select("script_id", bad.isNull().alias("ok"), F.coalesce(bad, F.lit("")).alias("message"))
    return _facts(parsed.where(bad.isNull()), "id") | {"attempts": attempts}


def engine_stdout_json(outputs: DataFrame) -> DataFrame:
    """``(script_id, json, message)``: the last output line that starts with a brace, or the end of the output."""
    lines = F.transform(F.split("stdout", "\n"), lambda x: strip(x))
    json = F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit("{"))), F.lit(-1))
    return outputs.select(
        "script_id", json.alias("json"), F.when(json.isNull(), F.right(strip(F.col("stdout")), F.lit(300))).alias("message")
    )


def llm_reply_json(replies: DataFrame) -> DataFrame:
    """``(script_id, json)``: the JSON object of a model's reply, or null.

    Tried are the body of the first fence, or the whole reply without one; then what stands from the first opening
    to the last closing brace of it.
    """
    text = strip(F.col("text"))
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*+(.*?)```", 1)
    body = F.when(text.rlike(r"(?s)```(?:json)?.*?```"), strip(fence)).otherwise(text)
    inner = F.regexp_extract(F.col("body"), r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(strip(c), F.lit("{")), c)
    return replies.select("script_id", body.alias("body")).select(
        "script_id", F.coalesce(valid(F.col("body")), F.when(inner != "", valid(inner))).alias("json")
    )


def llm_graph_sanitize(graphs: DataFrame) -> dict[str, DataFrame]:
    """Flat graph tables and ``attempts`` from rows ``(script_id, json)`` of a model.

    Names are stripped and blank ones dropped, roles lower-cased and unknown ones made ``source``; each graph gets
    the warning ``inferred``. A reply without JSON or without any table is a failed attempt.
    """
    g = parsed_graph(F.col("json"))
    named = F.filter(
        F.transform(
            F.coalesce("g.tables", F.expr("array()").cast("array<struct<id:string,name:string,role:string,columns:array<string>>>")),
            lambda t: F.struct(
                strip(F.coalesce(t["name"], F.lit(""))).alias("id"),
                F.when(strip(F.lower(t["role"])).isin(ROLES), strip(F.lower(t["role"]))).otherwise("source").alias("role"),
                F.coalesce(t["columns"], F.array().cast("array<string>")).alias("columns"),
            ),
        ),
        lambda t: t["id"] != "",
    )
    parsed = graphs.select("script_id", "json", g.alias("g")).withColumn("t", named)
    message = F.when(F.col("json").isNull(), "no JSON").when(F.size("t") == 0, "no table").otherwise("")
    attempts = parsed.select("script_id", (message == "").alias("ok"), message.alias("message"))
    good = parsed.where(message == "").select(
        "script_id",
        F.struct(F.col("t").alias("tables"), "g.table_edges", "g.column_edges", F.array(F.lit("inferred")).alias("warnings")).alias("g"),
    )
    found = _facts(good, "id")
    for name, columns in (("table_edges", ["source", "target"]), ("column_edges", EDGE_PARTS)):
        found[name] = found[name].withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in columns})
    return found | {"attempts": attempts}


PROMPT = (
    "Find the data lineage of this %s script. Answer with one JSON object with the keys tables (name, role: source, "
    "target or intermediate, columns), table_edges (source, target) and column_edges (source_table, source_column, "
    "target_table, target_column). List physical tables only; write * for columns that a star hides.\n\n%s"
)
CUT_SUFFIX = "\n...(truncated)"


def llm_prompt_text(scripts: DataFrame) -> DataFrame:
    """``scripts`` with ``prompt``: the question to a model, with at most 8000 characters of the script."""
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > MAX_PROMPT_CHARS, F.concat(F.substring(text, 1, MAX_PROMPT_CHARS), F.lit(CUT_SUFFIX))).otherwise(text)
    return scripts.withColumn("prompt", F.format_string(PROMPT, F.coalesce("dialect", F.lit(DEFAULT_DIALECT)), cut))


# -- fallback between engines ----------------------------------------------------------------------------------


def attempt_reject_empty(attempts: DataFrame) -> DataFrame:
    """``attempts`` whose graphs without tables (``n_tables`` = 0) are failures with the message ``no table found``."""
    empty = F.col("ok") & (F.coalesce("n_tables", F.lit(0)) == 0)
    return attempts.withColumn("message", F.when(empty, "no table found").otherwise(F.col("message"))).withColumn(
        "ok", F.col("ok") & ~empty
    )


def _tried(candidates: DataFrame) -> DataFrame:
    """The candidates that their script's preference admits."""
    auto = F.coalesce("preference", F.lit("auto")).isin("auto", "")
    return candidates.where(auto | (F.col("preference") == F.col("engine")))


def fallback_pick(candidates: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """``(script_id, ok, engine, detail)``: the engine whose graph a script gets.

    With the preference ``auto`` it is the successful one of the least rank; otherwise only the named engine
    counts, and one that doesn't exist fails. ``detail`` tells a failure's reasons. ``ranks`` names the engines where
    there are further ones (see :func:`schemas.engine_ranks`).
    """
    tried = _tried(candidates)
    best = tried.groupBy("script_id").agg(
        F.min_by(F.when(F.col("ok"), F.col("engine")), F.when(F.col("ok"), F.col("engine_rank"))).alias("engine")
    )
    scripts = candidates.groupBy("script_id").agg(F.first("preference").alias("preference"))
    why = failure_summary(attempt_log(candidates))
    unknown = ~F.coalesce("preference", F.lit("auto")).isin("auto", "", *(ranks or ENGINE_RANK))
    return (
        scripts.join(best, "script_id", "left")
        .join(why, "script_id", "left")
        .select(
            "script_id",
            F.col("engine").isNotNull().alias("ok"),
            "engine",
            F.when(F.col("engine").isNotNull(), "")
            .when(unknown, F.concat("preference", F.lit(": no such parser")))
            .otherwise(F.coalesce("detail", F.lit("")))
            .alias("detail"),
        )
    )


def attempt_log(candidates: DataFrame) -> DataFrame:
    """``(script_id, engine, engine_rank, ok, message)``: the attempts up to and including the first success."""
    won = F.min(F.when(F.col("ok"), F.col("engine_rank"))).over(Window.partitionBy("script_id"))
    return (
        _tried(candidates)
        .withColumn("won", won)
        .where("won is null or engine_rank <= won")
        .select("script_id", "engine", "engine_rank", "ok", "message")
    )


def failure_summary(attempts: DataFrame) -> DataFrame:
    """``(script_id, detail)``: the messages that aren't blank, in the order of the attempts."""
    told = F.sort_array(F.collect_list(F.struct("engine_rank", F.concat_ws(": ", "engine", "message").alias("text"))))
    return (
        attempts.where("coalesce(message, '') <> ''")
        .groupBy("script_id")
        .agg(F.array_join(F.transform(told, lambda x: x["text"]), "; ").alias("detail"))
    )


# -- sinks -----------------------------------------------------------------------------------------------------


def graph_document(tables: DataFrame, table_columns: DataFrame, table_edges: DataFrame, column_edges: DataFrame, warnings: DataFrame) -> DataFrame:
    """``(script_id, graph)``: the normalised graph of each script as one nested document with ordered arrays.

    ``tables(script_id, id, role, ord)``, ``table_columns(script_id, tbl, col, ord)``, edges with ``seq``,
    ``warnings(script_id, seq, warning)``. Only a script's own rows are gathered.
    """
    ordered = lambda *cols: F.sort_array(F.collect_list(F.struct(*cols)))
    columns = table_columns.groupBy("script_id", F.col("tbl").alias("id")).agg(
        F.transform(ordered("ord", "col"), lambda x: x["col"]).alias("columns")
    )
    nodes = tables.join(columns, ["script_id", "id"], "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
    parts = [
        nodes.groupBy("script_id").agg(
            F.transform(ordered("ord", "id", "role", "columns"), lambda x: F.struct(x["id"].alias("id"), x["role"].alias("role"), x["columns"].alias("columns"))).alias("tables")
        ),
        table_edges.groupBy("script_id").agg(
            F.transform(ordered("seq", "source", "target"), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"))).alias("table_edges")
        ),
        column_edges.groupBy("script_id").agg(
            F.transform(ordered("seq", *EDGE_PARTS), lambda x: F.struct(*[x[c].alias(c) for c in EDGE_PARTS])).alias("column_edges")
        ),
        warnings.groupBy("script_id").agg(F.transform(ordered("seq", "warning"), lambda x: x["warning"]).alias("warnings")),
    ]
    doc = parts[0]
    for part in parts[1:]:
        doc = doc.join(part, "script_id", "left")
    empty = {
        "table_edges": "array<struct<source:string,target:string>>",
        "column_edges": f"array<struct<{','.join(f'{c}:string' for c in EDGE_PARTS)}>>",
        "warnings": "array<string>",
    }
    filled = [F.coalesce(c, F.expr("array()").cast(kind)).alias(c) for c, kind in empty.items()]
    return doc.select("script_id", F.struct("tables", *filled).alias("graph"))


def response_envelope(scripts: DataFrame, picks: DataFrame, attempts: DataFrame, documents: DataFrame) -> DataFrame:
    """``(script_id, ok, response)``: the answer for each script as JSON.

    A success has parser, dialect, graph and attempts; a failure error and attempts. A script without text fails.
    """
    log = attempts.groupBy("script_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("engine_rank", "engine", "ok", "message"))),
            lambda x: F.struct(x["engine"].alias("parser"), x["ok"].alias("ok"), x["message"].alias("message")),
        ).alias("attempts")
    )
    picked = picks.select("script_id", F.col("ok").alias("picked"), "engine", "detail")
    rows = (
        scripts.select("script_id", "text", "dialect")
        .join(picked, "script_id", "left")
        .join(log, "script_id", "left")
        .join(documents, "script_id", "left")
    )
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    ok = F.coalesce(F.col("picked"), F.lit(False)) & ~blank
    error = F.when(blank, "empty").otherwise(F.concat(F.lit("all parsers failed. "), F.coalesce("detail", F.lit(""))))
    good = F.to_json(F.struct(F.lit(True).alias("ok"), F.col("engine").alias("parser"), "dialect", "graph", "attempts"))
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error"), "attempts"))
    return rows.select("script_id", ok.alias("ok"), F.when(ok, good).otherwise(bad).alias("response"))
