"""The queries of the lineage modules by name, each with the DuckDB SQL that gives the same rows from the generating columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineage_jobs import closure, corpus, datax, extension, fixtures, graph, layers, resolve, runs, service, sketches, sqltext, stats, streaming
from lineage_jobs.fixtures import derived
from lineage_jobs.runtime import by_text, dealt_out, materialize, shared_dir
from lineage_jobs.schemas import DIALECTS, EDGE_PARTS, engine_ranks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def joined(c):
    return F.array_join(c, ",")


# -- corpus ----------------------------------------------------------------------------------------------------

_REQUESTS = f"WITH r AS ({fixtures.REQUESTS}) "


@query(_REQUESTS + """SELECT script_id, CASE script_id % 4 WHEN 0 THEN '{ "job": {} }' WHEN 1 THEN '' WHEN 2 THEN 'select 1' ELSE '-- {' END AS text,
CASE WHEN script_id % 4 = 1 THEN 'empty' END AS reject_reason FROM r""")
def input_clean(spark, sf_dir):
    return corpus.input_clean(derived(spark, sf_dir, fixtures.REQUESTS)).select("script_id", "text", "reject_reason")


@query(_REQUESTS + "SELECT script_id, CASE WHEN script_id % 4 = 0 THEN 'json' ELSE 'sql' END AS kind FROM r")
def input_classify(spark, sf_dir):
    return corpus.input_classify(derived(spark, sf_dir, fixtures.REQUESTS)).select("script_id", "kind")


_DIALECT_ROWS = ", ".join("('{}', {}, '{}')".format(d[0], f"'{d[3]}'" if d[3] else "NULL", d[5]) for d in DIALECTS)


@query(_REQUESTS + f"""SELECT script_id, d.k AS dialect_key, d.g AS dialect_sqlglot, d.u AS dialect_druid
FROM r JOIN (VALUES {_DIALECT_ROWS}) AS d(k, g, u) ON d.k = CASE WHEN r.dialect IN ('mysql', 'hive', 'spark', 'db2') THEN r.dialect ELSE 'mysql' END""")
def dialect_resolve(spark, sf_dir):
    return corpus.dialect_resolve(derived(spark, sf_dir, fixtures.REQUESTS)).select("script_id", "dialect_key", "dialect_sqlglot", "dialect_druid")


@query("""SELECT o_orderkey % 32 AS bucket, count(*) AS n_lines, sum(length(CAST(o_orderkey AS VARCHAR)) + 8) AS n_chars FROM orders GROUP BY 1""")
def corpus_read(spark, sf_dir):
    """Files of many statements each, written to the shared folder and read back a file a row."""
    import uuid

    path = f"{shared_dir(spark)}/corpus/{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = orders.select((F.col("o_orderkey") % 32).alias("bucket"), F.concat(F.lit("SELECT "), F.col("o_orderkey").cast("string")).alias("value"))
    lines.repartition("bucket").write.partitionBy("bucket").text(path)
    docs = corpus.corpus_read(spark, path)
    return (
        docs.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "text")
        .groupBy("bucket")
        .agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
    )


def flat_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """Graph tables as rows ``(script_id, part, a, b, c, d)``."""
    none = F.lit(None).cast("string")
    shapes = {
        "tables": ["id", "role"], "table_edges": ["source", "target"], "column_edges": EDGE_PARTS, "warnings": ["warning"], "attempts": ["ok", "message"],
    }
    rows = []
    for part, cols in shapes.items():
        if part in parts:
            values = [F.col(c).cast("string") for c in cols] + [none] * (4 - len(cols))
            rows.append(parts[part].select("script_id", F.lit(part).alias("part"), *[v.alias(n) for n, v in zip("abcd", values, strict=True)]))
    return reduce(DataFrame.unionByName, rows)


_X = "CAST(o_custkey % 50 AS VARCHAR)"


@query(f"""WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 3 AS v, 's' || {_X} AS s, 'w' || CAST(o_custkey % 7 AS VARCHAR) AS w, 'e' || CAST(o_custkey % 5 AS VARCHAR) AS e FROM orders)
SELECT script_id, 'tables' AS part, s AS a, 'source' AS b, NULL AS c, NULL AS d FROM o WHERE v = 0
UNION ALL SELECT script_id, 'tables', 't', 'target', NULL, NULL FROM o WHERE v = 0
UNION ALL SELECT script_id, 'table_edges', s, 't', NULL, NULL FROM o WHERE v = 0
UNION ALL SELECT script_id, 'column_edges', s, 'a', 't', 'b' FROM o WHERE v = 0
UNION ALL SELECT script_id, 'warnings', w, NULL, NULL, NULL FROM o WHERE v = 0
UNION ALL SELECT script_id, 'attempts', CASE WHEN v = 1 THEN 'false' ELSE 'true' END, CASE WHEN v = 1 THEN e ELSE '' END, NULL, NULL FROM o""")
def engine_graph_json(spark, sf_dir):
    return flat_rows(corpus.engine_graph_json(derived(spark, sf_dir, fixtures.ENGINE_REPLIES)))


@query(f"""SELECT o_orderkey AS script_id, CASE o_orderkey % 3 WHEN 0 THEN '{{"id":' || {_X} || '}}' WHEN 2 THEN '{{"a":1}}' END AS json,
CASE WHEN o_orderkey % 3 = 1 THEN 'Exception ' || {_X} || chr(10) || ' at line 1' END AS message FROM orders""")
def engine_stdout_json(spark, sf_dir):
    return corpus.engine_stdout_json(derived(spark, sf_dir, fixtures.ENGINE_STDOUT))


@query(f"""SELECT o_orderkey AS script_id, CASE o_orderkey % 3
WHEN 0 THEN '{{"tables":[{{"name":" s' || {_X} || ' ","role":"SOURCE","columns":["a"]}},{{"name":"t","role":"weird"}},{{"name":" "}}],"table_edges":[{{"source":"s","target":"t"}}],"column_edges":[]}}'
WHEN 1 THEN '{{"tables":[{{"name":"u' || {_X} || '","role":"target"}}]}}' END AS json FROM orders""")
def llm_reply_json(spark, sf_dir):
    return corpus.llm_reply_json(derived(spark, sf_dir, fixtures.LLM_REPLIES))


@query(f"""WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 3 AS v, {_X} AS x FROM orders)
SELECT script_id, 'tables' AS part, CASE v WHEN 0 THEN 's' || x ELSE 'u' || x END AS a, CASE v WHEN 0 THEN 'source' ELSE 'target' END AS b, NULL AS c, NULL AS d FROM o WHERE v < 2
UNION ALL SELECT script_id, 'tables', 't', 'source', NULL, NULL FROM o WHERE v = 0
UNION ALL SELECT script_id, 'table_edges', 's', 't', NULL, NULL FROM o WHERE v = 0
UNION ALL SELECT script_id, 'warnings', 'inferred', NULL, NULL, NULL FROM o WHERE v < 2
UNION ALL SELECT script_id, 'attempts', CASE WHEN v < 2 THEN 'true' ELSE 'false' END, CASE WHEN v < 2 THEN '' ELSE 'no JSON' END, NULL, NULL FROM o""")
def llm_graph_sanitize(spark, sf_dir):
    return flat_rows(corpus.llm_graph_sanitize(corpus.llm_reply_json(derived(spark, sf_dir, fixtures.LLM_REPLIES))))


_PROMPT = corpus.PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(f"""WITH s AS ({fixtures.LONG_SCRIPTS}), t AS (SELECT script_id, coalesce(dialect, 'mysql') AS dialect,
CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || '...(truncated)' ELSE text END AS text FROM s)
SELECT script_id, CAST(length(p) AS INTEGER) AS n_chars, md5(p) AS digest FROM (SELECT script_id, '{_PROMPT.replace("%s", "' || dialect || '", 1).replace("%s", "' || text || '", 1)}' AS p FROM t)""")
def llm_prompt_text(spark, sf_dir):
    return corpus.llm_prompt_text(derived(spark, sf_dir, fixtures.LONG_SCRIPTS)).select("script_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


_CANDIDATES = f"WITH c AS ({fixtures.CANDIDATES}), "
_TRIED = _CANDIDATES + """t AS (SELECT * FROM c WHERE preference = 'auto' OR preference = engine),
l AS (SELECT script_id, engine, engine_rank, ok, message FROM (SELECT *, min(CASE WHEN ok THEN engine_rank END) OVER (PARTITION BY script_id) AS won FROM t) AS w WHERE won IS NULL OR engine_rank <= won),
f AS (SELECT script_id, string_agg(engine || ': ' || message, '; ' ORDER BY engine_rank) AS detail FROM l WHERE message <> '' GROUP BY script_id),
p AS (SELECT s.script_id, b.engine IS NOT NULL AS ok, b.engine, CASE WHEN b.engine IS NOT NULL THEN '' WHEN s.preference = 'nosuch' THEN 'nosuch: no such parser' ELSE coalesce(f.detail, '') END AS detail
  FROM (SELECT DISTINCT script_id, preference FROM c) AS s LEFT JOIN (SELECT script_id, arg_min(engine, engine_rank) AS engine FROM t WHERE ok GROUP BY script_id) AS b ON b.script_id = s.script_id LEFT JOIN f ON f.script_id = s.script_id) """


@query(_CANDIDATES + """d AS (SELECT 1) SELECT script_id, engine, ok AND script_id % 3 > 0 AS ok, CASE WHEN ok AND script_id % 3 = 0 THEN 'no table found' ELSE message END AS message FROM c""")
def attempt_reject_empty(spark, sf_dir):
    candidates = derived(spark, sf_dir, fixtures.CANDIDATES).withColumn("n_tables", F.col("script_id") % 3)
    return corpus.attempt_reject_empty(candidates).select("script_id", "engine", "ok", "message")


@query(_TRIED + "SELECT * FROM p")
def fallback_pick(spark, sf_dir):
    return corpus.fallback_pick(derived(spark, sf_dir, fixtures.CANDIDATES))


@query(_TRIED + "SELECT * FROM l")
def attempt_log(spark, sf_dir):
    return corpus.attempt_log(derived(spark, sf_dir, fixtures.CANDIDATES))


@query(_TRIED + "SELECT * FROM f")
def failure_summary(spark, sf_dir):
    return corpus.failure_summary(corpus.attempt_log(derived(spark, sf_dir, fixtures.CANDIDATES)))


# -- normaliser ------------------------------------------------------------------------------------------------

_PARTS = ", ".join(f"trim({c}) AS {c}" for c in EDGE_PARTS)
_COLUMN_EDGES = f"""e AS ({fixtures.COLUMN_EDGES_RAW}), c1 AS (SELECT script_id, seq, {_PARTS} FROM e),
ce AS (SELECT script_id, {", ".join(f"arg_min({c}, seq) AS {c}" for c in EDGE_PARTS)}, min(seq) AS seq FROM c1
WHERE {" AND ".join(f"{c} <> ''" for c in EDGE_PARTS)} GROUP BY script_id, {", ".join(f"lower({c})" for c in EDGE_PARTS)})"""
_TABLE_EDGES = f"""te AS (SELECT script_id, trim(source) AS source, trim(target) AS target, min(seq) AS seq FROM ({fixtures.TABLE_EDGES_RAW}) AS r
WHERE trim(source) <> '' AND trim(target) <> '' AND trim(source) <> trim(target) GROUP BY 1, 2, 3)"""
_COLUMNS = """ends AS (SELECT script_id, source_table AS tbl, source_column AS col, seq * 2 AS pl FROM ce UNION ALL SELECT script_id, target_table, target_column, seq * 2 + 1 FROM ce),
tc AS (SELECT script_id, tbl, col, min(pl) AS pl FROM ends GROUP BY 1, 2, 3),
oc AS (SELECT script_id, tbl, col, CAST(row_number() OVER (PARTITION BY script_id, tbl ORDER BY col = '*', lower(col), pl, col) AS INTEGER) AS ord FROM tc)"""
_ROLES = """ev AS (SELECT script_id, source AS id, 'source' AS role FROM te UNION ALL SELECT script_id, target, 'target' FROM te
UNION ALL SELECT script_id, source_table, 'source' FROM ce UNION ALL SELECT script_id, target_table, 'target' FROM ce),
ro AS (SELECT script_id, id, CASE WHEN bool_or(role = 'source') AND bool_or(role = 'target') THEN 'intermediate' WHEN bool_or(role = 'target') THEN 'target' ELSE 'source' END AS role FROM ev GROUP BY 1, 2),
ot AS (SELECT *, CAST(row_number() OVER (PARTITION BY script_id ORDER BY CASE role WHEN 'target' THEN 0 WHEN 'intermediate' THEN 1 ELSE 2 END, lower(id), id) AS INTEGER) AS ord FROM ro)"""
_NORM = f"WITH {_COLUMN_EDGES}, {_TABLE_EDGES}, {_COLUMNS}, {_ROLES} "


def raw_edges(spark, sf_dir):
    return derived(spark, sf_dir, fixtures.TABLE_EDGES_RAW), derived(spark, sf_dir, fixtures.COLUMN_EDGES_RAW)


def normal(spark, sf_dir) -> dict[str, DataFrame]:
    """The normalised graph of the derived raw edges, nothing declared."""
    none = spark.createDataFrame([], "script_id long, id string, role string, columns array<string>, seq long")
    return graph.normalize_graph(none, *raw_edges(spark, sf_dir))


@query(f"""SELECT script_id, tbl AS id, CASE WHEN bool_or(role = 'intermediate') OR (bool_or(role = 'source') AND bool_or(role = 'target')) THEN 'intermediate'
WHEN bool_or(role = 'target') THEN 'target' ELSE 'source' END AS role FROM ({fixtures.ROLE_EVENTS}) AS r GROUP BY 1, 2""")
def role_merge(spark, sf_dir):
    return graph.role_merge(derived(spark, sf_dir, fixtures.ROLE_EVENTS))


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY script_id, tbl ORDER BY seq, role) AS n FROM ({fixtures.ROLE_EVENTS}) AS x),
f AS (SELECT script_id, tbl, n, role FROM r WHERE n = 1 UNION ALL
SELECT r.script_id, r.tbl, r.n, CASE WHEN f.role = r.role THEN f.role WHEN f.role IN ('source', 'target') AND r.role IN ('source', 'target') THEN 'intermediate' WHEN r.role = 'target' THEN 'target' ELSE f.role END
FROM f JOIN r ON r.script_id = f.script_id AND r.tbl = f.tbl AND r.n = f.n + 1)
SELECT script_id, tbl AS id, arg_max(role, n) AS role FROM f GROUP BY 1, 2""")
def role_merge_strict(spark, sf_dir):
    return graph.role_merge(derived(spark, sf_dir, fixtures.ROLE_EVENTS), strict=True)


@query(f"SELECT script_id, tbl AS id, arg_max(role, seq) AS role FROM ({fixtures.ROLE_EVENTS}) AS r GROUP BY 1, 2")
def role_last_write(spark, sf_dir):
    return graph.role_last_write(derived(spark, sf_dir, fixtures.ROLE_EVENTS))


@query(f"WITH {_TABLE_EDGES} SELECT * FROM te")
def table_edge_dedup(spark, sf_dir):
    return graph.table_edge_dedup(raw_edges(spark, sf_dir)[0])


@query(f"WITH {_COLUMN_EDGES} SELECT * FROM ce")
def column_edge_dedup(spark, sf_dir):
    return graph.column_edge_dedup(raw_edges(spark, sf_dir)[1])


def listed_columns(spark, sf_dir):
    none = spark.createDataFrame([], "script_id long, tbl string, col string, seq long")
    return graph.table_columns(none, graph.column_edge_dedup(raw_edges(spark, sf_dir)[1]))


@query(f"WITH {_COLUMN_EDGES}, {_COLUMNS} SELECT script_id, tbl, col FROM tc")
def table_columns(spark, sf_dir):
    return listed_columns(spark, sf_dir).select("script_id", "tbl", "col")


@query(f"WITH {_COLUMN_EDGES}, {_COLUMNS} SELECT * FROM oc")
def column_order(spark, sf_dir):
    return graph.column_order(listed_columns(spark, sf_dir)).select("script_id", "tbl", "col", "ord")


@query(f"""WITH w AS (SELECT DISTINCT * FROM ({fixtures.WIDE_TABLE_COLUMNS}) AS r), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY script_id, tbl ORDER BY col = '*', lower(col), col) AS INTEGER) AS ord,
count(*) OVER (PARTITION BY script_id, tbl) AS n FROM w) SELECT script_id, tbl, col, ord, n > 80 AS cut FROM o WHERE ord <= 80""")
def column_cap(spark, sf_dir):
    columns = derived(spark, sf_dir, fixtures.WIDE_TABLE_COLUMNS).distinct().withColumn("seq", F.lit(0))
    kept, cut = graph.column_cap(graph.column_order(columns))
    marked = kept.join(cut.withColumn("cut", F.lit(True)), ["script_id", "tbl"], "left")
    return marked.select("script_id", "tbl", "col", "ord", F.coalesce("cut", F.lit(False)).alias("cut"))


@query(_NORM + "SELECT script_id, id, role, ord FROM ot")
def table_order(spark, sf_dir):
    return normal(spark, sf_dir)["tables"].select("script_id", "id", "role", "ord")


@query(_NORM + """SELECT script_id, 'tables' AS part, id AS a, role AS b, CAST(NULL AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS d FROM ot UNION ALL SELECT script_id, 'table_edges', source, target, NULL, NULL FROM te
UNION ALL SELECT script_id, 'column_edges', source_table, source_column, target_table, target_column FROM ce""")
def normalize_graph(spark, sf_dir):
    return flat_rows(normal(spark, sf_dir))


@query(_NORM + """SELECT t.script_id, t.n_tables, t.first_table, coalesce(k.n, 0) AS n_columns, coalesce(e.n, 0) AS n_table_edges, coalesce(x.n, 0) AS n_column_edges
FROM (SELECT script_id, count(*) AS n_tables, min_by(id, ord) AS first_table FROM ot GROUP BY 1) AS t
LEFT JOIN (SELECT script_id, count(*) AS n FROM oc WHERE ord <= 80 GROUP BY 1) AS k ON k.script_id = t.script_id
LEFT JOIN (SELECT script_id, count(*) AS n FROM te GROUP BY 1) AS e ON e.script_id = t.script_id LEFT JOIN (SELECT script_id, count(*) AS n FROM ce GROUP BY 1) AS x ON x.script_id = t.script_id""")
def graph_document(spark, sf_dir):
    """The documents go through JSON and are counted again."""
    g = normal(spark, sf_dir)
    none = spark.createDataFrame([], "script_id long, seq int, warning string")
    docs = corpus.graph_document(g["tables"], g["table_columns"], g["table_edges"], g["column_edges"], none)
    back = docs.select("script_id", corpus.parsed_graph(F.to_json("graph")).alias("g"))
    n = lambda c: F.size(f"g.{c}").cast("long").alias(f"n_{c}")
    width = F.aggregate(F.transform("g.tables", lambda t: F.size(t["columns"])), F.lit(0), lambda a, x: a + x).cast("long").alias("n_columns")
    return back.select("script_id", n("tables"), F.col("g.tables")[0]["id"].alias("first_table"), width, n("table_edges"), n("column_edges"))


@query(_TRIED.rstrip() + f""", q AS ({fixtures.REQUESTS}) SELECT q.script_id, p.ok AND trim(q.text) <> '' AS ok, CASE WHEN p.ok AND trim(q.text) <> '' THEN p.engine END AS parser,
(SELECT count(*) FROM l WHERE l.script_id = q.script_id) AS n_attempts,
CASE WHEN trim(q.text) = '' THEN 'empty' WHEN NOT p.ok THEN 'all parsers failed. ' || p.detail END AS error FROM q JOIN p ON p.script_id = q.script_id""")
def response_envelope(spark, sf_dir):
    candidates = derived(spark, sf_dir, fixtures.CANDIDATES)
    scripts = derived(spark, sf_dir, fixtures.REQUESTS)
    docs = scripts.select("script_id", F.struct(F.lit("t").alias("id")).alias("graph"))
    out = corpus.response_envelope(scripts, corpus.fallback_pick(candidates), corpus.attempt_log(candidates), docs)
    r = F.from_json("response", "parser string, error string, attempts array<string>")
    return out.select("script_id", "ok", r.alias("r")).select(
        "script_id", "ok", "r.parser", F.coalesce(F.size("r.attempts"), F.lit(0)).cast("long").alias("n_attempts"), "r.error"
    ).withColumn("n_attempts", F.greatest("n_attempts", F.lit(0).cast("long")))


# -- job mining ------------------------------------------------------------------------------------------------

_V = f"WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 6 AS v, {_X} AS x, CAST(o_custkey % 9 AS VARCHAR) AS y FROM orders) "


def jobs(spark, sf_dir):
    return derived(spark, sf_dir, fixtures.DATAX_JOBS)


def sides(spark, sf_dir):
    return datax.datax_sides(datax.datax_contents(datax.datax_parse(jobs(spark, sf_dir))))


def query_sides(spark, sf_dir):
    return datax.datax_sides(datax.datax_contents(datax.datax_parse(derived(spark, sf_dir, fixtures.DATAX_QUERY_JOBS))))


def both_sides(df, field):
    return df.select("script_id", "content_idx", field(F.col("reader")).alias("reader"), field(F.col("writer")).alias("writer"))


_IDX = "CAST(CASE WHEN v = 5 THEN 2 ELSE 1 END AS INTEGER) AS content_idx"


@query(f"""WITH j AS ({fixtures.DATAX_JOBS}) SELECT script_id, CASE WHEN script_id % 6 = 1 THEN regexp_replace(regexp_replace(replace(text, '/* c */', ''), ',]', ']', 'g'), ',}}', '}}', 'g') ELSE text END AS text FROM j""")
def datax_clean(spark, sf_dir):
    return jobs(spark, sf_dir).select("script_id", datax.datax_clean(F.col("text")).alias("text"))


@query(_V + "SELECT script_id, CAST(CASE WHEN v = 5 THEN 2 ELSE 1 END AS INTEGER) AS n_contents, CAST(NULL AS VARCHAR) AS error FROM o")
def datax_parse(spark, sf_dir):
    return datax.datax_parse(jobs(spark, sf_dir)).select("script_id", F.size("contents").alias("n_contents"), "error")


@query(_V + "SELECT script_id, 1 AS content_idx, v = 5 AS bad FROM o UNION ALL SELECT script_id, 2, false FROM o WHERE v = 5")
def datax_contents(spark, sf_dir):
    return datax.datax_contents(datax.datax_parse(jobs(spark, sf_dir))).select("script_id", "content_idx", "bad")


@query(_V + f"SELECT script_id, {_IDX}, CASE WHEN v IN (0, 1) THEN 'dock' ELSE '' END AS reader, CASE v WHEN 0 THEN 'yard' WHEN 3 THEN 'hold' ELSE '' END AS writer FROM o")
def datax_jdbc_db(spark, sf_dir):
    return both_sides(sides(spark, sf_dir), lambda s: s["db"])


_SIDE_TABLES = """CASE v WHEN 0 THEN 'T' || x WHEN 1 THEN 'a' || x || ',b' WHEN 2 THEN 's.t' || x WHEN 3 THEN 'quay.o' || x WHEN 4 THEN 'm' || x ELSE 'only' || x END AS reader,
CASE v WHEN 0 THEN 'f' || y WHEN 1 THEN 'yard.f' WHEN 2 THEN 'd.u' WHEN 3 THEN 'o' WHEN 4 THEN 'es' ELSE '' END AS writer"""


@query(_V + f"SELECT script_id, {_IDX}, {_SIDE_TABLES} FROM o")
def datax_side_tables(spark, sf_dir):
    return both_sides(sides(spark, sf_dir), lambda s: joined(s["tables"]))


@query(_V + "SELECT script_id, 'quay.o' || x AS tbl, 'o' || x AS plain, 'part' AS cut FROM o WHERE v = 3")
def datax_hdfs_table(spark, sf_dir):
    paths = jobs(spark, sf_dir).select("script_id", F.regexp_extract("text", r'"path":"([^"]*)"', 1).alias("path")).where("path <> ''")
    at = lambda c: datax.datax_hdfs_table(c)
    return paths.select(
        "script_id", at(F.col("path")).alias("tbl"), at(F.regexp_replace("path", r"\.db", "")).alias("plain"), at(F.concat("path", F.lit("/part*"))).alias("deep"),
    ).select("script_id", "tbl", "plain", F.when(F.col("deep") == F.col("tbl"), "part").alias("cut"))


@query(_V + f"""SELECT script_id, {_IDX}, CASE v WHEN 0 THEN 'crew,hours' WHEN 1 THEN 'id,a//b' WHEN 2 THEN 'a,b,c' WHEN 3 THEN '*' WHEN 4 THEN 'p' ELSE 'a' END AS reader,
CASE v WHEN 0 THEN 'k,v' WHEN 1 THEN 'k,v' WHEN 2 THEN 'x' WHEN 3 THEN '*' WHEN 4 THEN 'q' ELSE '' END AS writer FROM o""")
def datax_columns(spark, sf_dir):
    return both_sides(sides(spark, sf_dir), lambda s: joined(s["cols"]))


_Q = f"WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 3 AS v, {_X} AS x FROM orders) "
_QUERY_TEXT = "CASE v WHEN 0 THEN 'select b.berth, c.tons * 2 as load from port.berth' || x || ' b, port.cargo c where c.pier = b.pier' WHEN 1 THEN 'select a, 1 as one from q' || x || ' where dt = ''{}''' ELSE 'call p()' END"


@query(_Q + f"SELECT script_id, 1 AS content_idx, {_QUERY_TEXT.format('${bizdate}')} AS sqls FROM o")
def datax_queries(spark, sf_dir):
    return query_sides(spark, sf_dir).select("script_id", "content_idx", F.array_join("reader.sqls", "|").alias("sqls"))


@query(_Q + f"SELECT script_id, 1 AS content_idx, 0 AS query_pos, {_QUERY_TEXT.format('1')} AS sql FROM o")
def datax_mask_vars(spark, sf_dir):
    return datax.datax_query_texts(query_sides(spark, sf_dir))


def by_query_job(spark, sf_dir, take):
    """``take`` of the sides and the queries' facts of jobs with queries, both written; jobs with the same text are read once."""

    def over(texts):
        s = materialize(datax.datax_sides(datax.datax_contents(datax.datax_parse(texts))))
        return {"rows": take(s, materialize(resolve.query_outputs(datax.datax_query_texts(s))))}

    return by_text(derived(spark, sf_dir, fixtures.DATAX_QUERY_JOBS), over)["rows"]


@query(_Q + "SELECT script_id, 1 AS content_idx, 0 AS query_pos FROM o WHERE v < 2")
def datax_first_query(spark, sf_dir):
    return by_query_job(spark, sf_dir, datax.datax_first_query)


_SRC = "CASE v WHEN 0 THEN 'dock.t' || x WHEN 1 THEN 'dock.a' || x || ',dock.b' WHEN 2 THEN 's.t' || x WHEN 3 THEN 'quay.o' || x WHEN 4 THEN 'm' || x ELSE 'only' || x END"
_TGT = "CASE v WHEN 0 THEN 'yard.f' || y WHEN 1 THEN 'yard.f' WHEN 2 THEN 'd.u' WHEN 3 THEN 'hold.o' WHEN 4 THEN 'es' ELSE '' END"


@query(_V + f"SELECT script_id, {_IDX}, {_SRC} AS src, {_TGT} AS tgt FROM o")
def datax_qualify(spark, sf_dir):
    return datax.datax_resolved(sides(spark, sf_dir)).select("script_id", "content_idx", joined("src_tables").alias("src"), joined("tgt_tables").alias("tgt"))


@query(_V + f"SELECT script_id, {_IDX}, unnest(string_split({_SRC}, ',')) AS source, {_TGT} AS target FROM o WHERE v < 5")
def datax_table_edges(spark, sf_dir):
    return datax.datax_table_edges(datax.datax_resolved(sides(spark, sf_dir)))[0]


_ALIGN = f"""a AS (SELECT script_id, v, unnest(string_split({_SRC}, ',')) AS source_table, {_TGT} AS target_table FROM o WHERE v < 5),
p AS (SELECT * FROM (VALUES (0, 0, 'crew', 'k'), (0, 1, 'hours', 'v'), (1, 0, 'id', 'k'), (1, 1, 'a//b', 'v'), (2, 0, 'a', 'x'), (3, 0, '*', '*'), (4, 0, 'p', 'q')) AS t(v, pos, source_column, target_column))"""


@query(_V.rstrip() + f", {_ALIGN} SELECT script_id, 1 AS content_idx, pos, source_table, source_column, target_table, target_column FROM a JOIN p ON p.v = a.v WHERE a.v <> 3")
def datax_column_align(spark, sf_dir):
    return datax.datax_column_align(datax.datax_resolved(sides(spark, sf_dir)))


@query(_V.rstrip() + f", {_ALIGN} SELECT script_id, 1 AS content_idx, pos, source_table, source_column, target_table, target_column FROM a JOIN p ON p.v = a.v WHERE a.v = 3")
def datax_star_edges(spark, sf_dir):
    return datax.datax_star_edges(datax.datax_resolved(sides(spark, sf_dir)))


@query(_Q + """SELECT script_id, 1 AS content_idx, 0 AS pos, 'port.berth' || x AS source_table, 'berth' AS source_column, 'quay.tally' AS target_table, 'k' AS target_column FROM o WHERE v = 0
UNION ALL SELECT script_id, 1, 1, 'port.cargo', 'tons', 'quay.tally', 'v' FROM o WHERE v = 0
UNION ALL SELECT script_id, 1, 0, 'q' || x, 'a', 'yard.t', 'x' FROM o WHERE v = 1
UNION ALL SELECT script_id, 1, 1, 'q' || x, 'one', 'yard.t', 'y' FROM o WHERE v = 1""")
def datax_query_columns(spark, sf_dir):
    return by_query_job(spark, sf_dir, lambda s, facts: datax.datax_query_columns(datax.datax_resolved(s, facts)))


@query(_V + """SELECT script_id, 1 AS content_idx, 'width' AS code, 3 AS n, 1 AS m FROM o WHERE v = 2 UNION ALL SELECT script_id, 2, 'no_target', NULL, NULL FROM o WHERE v = 5
UNION ALL SELECT script_id, 1, 'bad_content', NULL, NULL FROM o WHERE v = 5""")
def datax_warnings(spark, sf_dir):
    contents = datax.datax_contents(datax.datax_parse(jobs(spark, sf_dir)))
    return datax.datax_warnings(contents, datax.datax_resolved(datax.datax_sides(contents)))


@query(_V.rstrip() + f""", {_ALIGN} SELECT script_id, 'column_edges' AS part, source_table AS a, source_column AS b, target_table AS c, target_column AS d FROM a JOIN p ON p.v = a.v
UNION ALL SELECT script_id, 'table_edges', source_table, target_table, NULL, NULL FROM a
UNION ALL SELECT script_id, 'tables', source_table, 'source', NULL, NULL FROM a UNION ALL SELECT script_id, 'tables', 'only' || x, 'source', NULL, NULL FROM o WHERE v = 5
UNION ALL SELECT DISTINCT script_id, 'tables', target_table, 'target', NULL, NULL FROM a UNION ALL SELECT script_id, 'attempts', 'true', '', NULL, NULL FROM o""")
def datax_lineage(spark, sf_dir):
    g = datax.datax_lineage(jobs(spark, sf_dir))
    return flat_rows({k: v for k, v in g.items() if k != "warnings"})


# -- SQL mining ------------------------------------------------------------------------------------------------

_S = _V
_STATEMENTS = f"""SELECT script_id, 1 AS stmt_idx, CASE WHEN script_id % 6 = 1 THEN split_part(text, '; ', 1) ELSE text END AS sql FROM ({fixtures.SQL_SCRIPTS}) AS t
UNION ALL SELECT script_id, 2, split_part(text, '; ', 2) FROM ({fixtures.SQL_SCRIPTS}) AS u WHERE script_id % 6 = 1"""


def statements(spark, sf_dir, fixture=fixtures.SQL_SCRIPTS):
    return sqltext.sql_statement_kind(sqltext.sql_statements(derived(spark, sf_dir, fixture)))


def blocks(spark, sf_dir, fixture=fixtures.SQL_SCRIPTS):
    s = statements(spark, sf_dir, fixture)
    return sqltext.sql_blocks(s, sqltext.sql_ctes(s))


@query(_STATEMENTS)
def sql_statements(spark, sf_dir):
    return sqltext.sql_statements(derived(spark, sf_dir, fixtures.SQL_SCRIPTS))


@query(_S + """SELECT script_id, 1 AS stmt_idx, CASE v WHEN 1 THEN 'create' WHEN 3 THEN 'create' WHEN 4 THEN 'update' WHEN 5 THEN 'select' ELSE 'insert' END AS kind, false AS needs_parser FROM o
UNION ALL SELECT script_id, 2, 'insert', false FROM o WHERE v = 1""")
def sql_statement_kind(spark, sf_dir):
    return statements(spark, sf_dir).select("script_id", "stmt_idx", "kind", "needs_parser")


_TARGETS = "CASE v WHEN 0 THEN 'fin.book' WHEN 1 THEN 'web.top' WHEN 2 THEN 'geo.area' WHEN 3 THEN 'arc.copy' WHEN 4 THEN 'hr.staff' END"


@query(_S + f"""SELECT script_id, 1 AS stmt_idx, {_TARGETS} AS table_name FROM o WHERE v < 5 UNION ALL SELECT script_id, 2, 'web.seen' FROM o WHERE v = 1""")
def sql_targets(spark, sf_dir):
    return sqltext.sql_targets(statements(spark, sf_dir)).select("script_id", "stmt_idx", "table_name")


@query(_S + "SELECT script_id, 1 AS stmt_idx, 0 AS pos, 'hits' AS name, 'SELECT page, visitor FROM log.raw' || x || ' WHERE code = 200' AS body FROM o WHERE v = 1")
def sql_ctes(spark, sf_dir):
    return sqltext.sql_ctes(statements(spark, sf_dir))


@query(f"""WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 4 AS v FROM orders), b AS (SELECT * FROM (VALUES (0, 'm', NULL, 'main'), (0, 'm.f0', 'm', 'derived'), (0, 'm.f0.u0', 'm.f0', 'branch'), (0, 'm.f0.u1', 'm.f0', 'branch'),
(1, 'm', NULL, 'main'), (1, 'c0', NULL, 'cte'), (1, 'c1', NULL, 'cte'), (2, 'm', NULL, 'main'), (2, 'm.s0', 'm', 'scalar')) AS t(v, scope_id, parent_scope_id, kind))
SELECT script_id, 1 AS stmt_idx, scope_id, parent_scope_id, kind FROM o JOIN b ON b.v = o.v""")
def sql_blocks(spark, sf_dir):
    return blocks(spark, sf_dir, fixtures.NESTED_SCRIPTS).drop("body")


_SOURCES = """r AS (SELECT script_id, stmt_idx, scope_id, CASE WHEN numbered THEN t || x ELSE t END AS table_name, CASE WHEN a = '' THEN split_part(t, '.', 2) || x ELSE a END AS alias, pos
FROM o JOIN (VALUES (0, 1, 'm', 'core.trade', true, 'b', 0), (0, 1, 'm', 'core.cost', false, 'k', 1), (1, 1, 'c0', 'log.raw', true, '', 0), (1, 1, 'm', 'hits', false, 'h', 0), (1, 2, 'm', 'log.raw', true, '', 0),
(2, 1, 'm', NULL, false, 'z', 0), (2, 1, 'm.f0', 'geo.point', true, '', 0), (3, 1, 'm', 'arc.live', true, 'p', 0), (3, 1, 'm', 'arc.memo', false, 'q', 1), (5, 1, 'm', 'kv.store', true, 't', 0))
AS f(w, stmt_idx, scope_id, t, numbered, a, pos) ON f.w = o.v)"""


@query(_S.rstrip() + f", {_SOURCES} SELECT * FROM r")
def sql_relations(spark, sf_dir):
    return sqltext.sql_relations(blocks(spark, sf_dir)).select("script_id", "stmt_idx", "scope_id", "table_name", "alias", "pos")


def mined_by_text(spark, sf_dir, fixture, mine):
    """``mine`` over the statements of a fixture's scripts, written once; scripts with the same text are mined once."""

    def over(texts):
        return {"rows": mine(materialize(sqltext.sql_statement_kind(sqltext.sql_statements(dealt_out(texts)))))}

    return by_text(derived(spark, sf_dir, fixture), over)["rows"]


def physical(s, by_root=False):
    ctes = materialize(sqltext.sql_ctes(s))
    return sqltext.sql_physical_sources(sqltext.sql_relations(sqltext.sql_blocks(s, ctes)), ctes, by_root)


@query(_S.rstrip() + f", {_SOURCES} SELECT DISTINCT script_id, stmt_idx, table_name FROM r WHERE table_name <> 'hits'")
def sql_physical_sources(spark, sf_dir):
    return mined_by_text(spark, sf_dir, fixtures.SQL_SCRIPTS, physical)


@query(_S.rstrip() + f""", {_SOURCES} SELECT DISTINCT r.script_id, r.stmt_idx, table_name AS source, CASE WHEN stmt_idx = 2 THEN 'web.seen' ELSE {_TARGETS} END AS target
FROM r JOIN o ON o.script_id = r.script_id WHERE table_name <> 'hits' AND v <> 5""")
def sql_table_edges(spark, sf_dir):
    return mined_by_text(spark, sf_dir, fixtures.SQL_SCRIPTS, lambda s: sqltext.sql_table_edges(physical(s), sqltext.sql_targets(s)))


@query(_S + "SELECT script_id, 1 AS stmt_idx, 'kv.store' || x AS id, 'source' AS role FROM o WHERE v = 5")
def sql_read_only_tables(spark, sf_dir):
    return mined_by_text(spark, sf_dir, fixtures.SQL_SCRIPTS, lambda s: sqltext.sql_read_only_tables(s, physical(s)))


_PROJECTIONS = """pr AS (SELECT * FROM (VALUES (0, 1, 'm', 1, 'nr', 'b.nr'), (0, 1, 'm', 2, 'col_2', 'coalesce(k.rate, 0) * b.vol'), (1, 1, 'c0', 1, 'page', 'page'), (1, 1, 'c0', 2, 'visitor', 'visitor'),
(1, 1, 'm', 1, 'url', 'h.page'), (1, 1, 'm', 2, 'visitors', 'count(DISTINCT h.visitor)'), (1, 2, 'm', 1, 'visitor', 'visitor'), (2, 1, 'm', 1, 'land', 'z.land'), (2, 1, 'm', 2, 'peak', 'max(z.height)'),
(2, 1, 'm.f0', 1, 'land', 'land'), (2, 1, 'm.f0', 2, 'height', 'height'), (3, 1, 'm', 1, '*', 'p.*'), (3, 1, 'm', 2, 'note', 'q.note'), (5, 1, 'm', 1, 'k', 't.k'), (5, 1, 'm', 2, 'v', 't.v'))
AS t(v, stmt_idx, scope_id, pos, name, expr))"""


@query(_S.rstrip() + f", {_PROJECTIONS} SELECT script_id, stmt_idx, scope_id, pos, name, expr FROM o JOIN pr ON pr.v = o.v")
def sql_projections(spark, sf_dir):
    return sqltext.sql_projections(blocks(spark, sf_dir))


@query(_S.rstrip() + """, pr AS (SELECT * FROM (VALUES (0, 1, 'm', 1, 'b', 'nr'), (0, 1, 'm', 2, 'k', 'rate'), (0, 1, 'm', 2, 'b', 'vol'), (1, 1, 'c0', 1, NULL, 'page'), (1, 1, 'c0', 2, NULL, 'visitor'),
(1, 1, 'm', 1, 'h', 'page'), (1, 1, 'm', 2, 'h', 'visitor'), (1, 2, 'm', 1, NULL, 'visitor'), (2, 1, 'm', 1, 'z', 'land'), (2, 1, 'm', 2, 'z', 'height'), (2, 1, 'm.f0', 1, NULL, 'land'), (2, 1, 'm.f0', 2, NULL, 'height'),
(3, 1, 'm', 1, 'p', '*'), (3, 1, 'm', 2, 'q', 'note'), (5, 1, 'm', 1, 't', 'k'), (5, 1, 'm', 2, 't', 'v'))
AS t(v, stmt_idx, scope_id, pos, qualifier, col)) SELECT script_id, stmt_idx, scope_id, pos, qualifier, col FROM o JOIN pr ON pr.v = o.v""")
def sql_column_refs(spark, sf_dir):
    return sqltext.sql_column_refs(sqltext.sql_projections(blocks(spark, sf_dir)))


@query(_S + """SELECT script_id, 1 AS stmt_idx, 'update' AS arm, 1 AS pos, 'desk' AS "column", 'd.room' AS expr FROM o WHERE v = 4 UNION ALL SELECT script_id, 1, 'update', 2, 'boss', 'coalesce(d.head, '''')' FROM o WHERE v = 4""")
def sql_set_items(spark, sf_dir):
    return sqltext.sql_set_items(statements(spark, sf_dir))


_HARD = f"WITH h AS (SELECT o_orderkey AS script_id, o_orderkey % 8 AS v, CAST(o_custkey % 50 AS VARCHAR) AS c FROM orders) "
_HARD_TARGETS = "(VALUES (0, 'mill.flour'), (1, '码头.货物'), (2, 'tea house.day sum'), (3, 'disk.used'), (4, 'deep.sum'), (5, 'lake.caught'), (5, 'lake.freed'), (6, 'bank.debit'), (6, 'bank.credit'), (7, 'zoo.cage')) AS t(w, target)"
_HARD_SOURCES = "(VALUES (0, 'mill.grain', 1), (0, 'mill.batch', 0), (0, 'mill.day', 0), (1, '码头.到港', 1), (2, 'tea.cup', 2), (3, 'disk.file', 1), (4, 'deep.part', 1), (5, 'lake.fish', 1), (5, 'lake.net', 0), (6, 'bank.move', 1), (7, 'zoo.arrived', 1)) AS s(u, base, more)"
_HARD_SOURCE = "concat(base, CASE more WHEN 0 THEN '' WHEN 1 THEN c ELSE concat(c, ' new') END)"


@query(_HARD + f"SELECT script_id, target AS table_name, CASE target WHEN 'tea house.day sum' THEN 'order,kg' WHEN 'bank.debit' THEN 'acct' WHEN 'bank.credit' THEN 'acct,sum' ELSE '' END AS cols FROM h JOIN {_HARD_TARGETS} ON v = w")
def sql_targets_hard(spark, sf_dir):
    """Several targets of a statement, and quoted and Chinese names."""
    return sqltext.sql_targets(materialize(statements(spark, sf_dir, fixtures.HARD_SCRIPTS))).select("script_id", "table_name", joined("cols").alias("cols"))


@query(_HARD + f"SELECT script_id, {_HARD_SOURCE} AS source, target FROM h JOIN {_HARD_SOURCES} ON v = u JOIN {_HARD_TARGETS} ON v = w")
def sql_table_edges_hard(spark, sf_dir):
    """Joins in brackets, brackets twenty deep, several targets, names in quotes and in Chinese."""
    edges = lambda s: sqltext.sql_table_edges(physical(s, by_root=True), sqltext.sql_targets(s)).drop("stmt_idx")
    return mined_by_text(spark, sf_dir, fixtures.HARD_SCRIPTS, edges)


@query(_HARD + """SELECT script_id, concat(base, CASE more WHEN 0 THEN '' WHEN 1 THEN c ELSE concat(c, ' new') END) AS source_table, source_column, target_table, target_column FROM h JOIN (VALUES
(0, 'mill.grain', 1, 'kg', 'mill.flour', 'kg'), (0, 'mill.day', 0, 'day', 'mill.flour', 'day'), (1, '码头.到港', 1, '重量', '码头.货物', '重量'), (1, '码头.到港', 1, '船', '码头.货物', '船名'),
(2, 'tea.cup', 2, 'group', 'tea house.day sum', 'order'), (2, 'tea.cup', 2, 'kg', 'tea house.day sum', 'kg'), (3, 'disk.file', 1, 'size', 'disk.used', 'size'), (4, 'deep.part', 1, 'n', 'deep.sum', 'n'),
(5, 'lake.fish', 1, 'kind', 'lake.caught', 'kind'), (5, 'lake.net', 0, 'mesh', 'lake.caught', 'mesh'), (5, 'lake.fish', 1, 'kind', 'lake.freed', 'species'),
(6, 'bank.move', 1, 'a', 'bank.debit', 'acct'), (6, 'bank.move', 1, 'b', 'bank.credit', 'acct'), (6, 'bank.move', 1, 's', 'bank.credit', 'sum'), (7, 'zoo.arrived', 1, 'beast', 'zoo.cage', 'beast')
) AS e(u, base, more, source_column, target_table, target_column) ON v = u""")
def sql_lineage_hard(spark, sf_dir):
    """Column edges of the same statements."""
    return resolve.sql_lineage(derived(spark, sf_dir, fixtures.HARD_SCRIPTS))["column_edges"].select("script_id", *EDGE_PARTS)


# -- resolution ------------------------------------------------------------------------------------------------

_RF, _FF = f"rf AS ({fixtures.RELATIONS_FACTS})", f"ff AS ({fixtures.REFS_FACTS})"
_VISIBLE = f"WITH {_RF}, {_FF}, vi AS (SELECT script_id, lower(alias) AS alias, arg_max(table_name, pos) AS table_name FROM rf GROUP BY 1, 2) "


def visible(spark, sf_dir):
    facts = derived(spark, sf_dir, fixtures.RELATIONS_FACTS)
    scope = F.col("scope_id").cast("string").alias("scope_id")
    none = F.lit(None).cast("string")
    relations = facts.select("script_id", "stmt_idx", scope, "alias", F.lit("table").alias("kind"), "table_name", none.alias("derived_scope_id"), "pos")
    scopes = relations.select("script_id", "stmt_idx", "scope_id").distinct().withColumn("parent_scope_id", none)
    return resolve.scope_visible_aliases(scopes, relations)


def refs(spark, sf_dir):
    return derived(spark, sf_dir, fixtures.REFS_FACTS).withColumn("scope_id", F.col("scope_id").cast("string"))


@query(_VISIBLE + "SELECT script_id, alias, table_name, 0 AS distance FROM vi")
def scope_visible_aliases(spark, sf_dir):
    return visible(spark, sf_dir).select("script_id", "alias", "table_name", "distance")


@query(_VISIBLE + "SELECT ff.script_id, ff.pos, table_name, col FROM ff JOIN vi ON vi.script_id = ff.script_id AND vi.alias = lower(ff.qualifier) WHERE col <> '*'")
def resolve_qualified(spark, sf_dir):
    return resolve.resolve_qualified(refs(spark, sf_dir), visible(spark, sf_dir)).select("script_id", "pos", F.col("src_table").alias("table_name"), F.col("src_column").alias("col"))


@query(_VISIBLE + "SELECT ff.script_id, ff.pos, table_name, col FROM ff JOIN vi ON vi.script_id = ff.script_id WHERE qualifier IS NULL AND col <> '*'")
def resolve_unqualified(spark, sf_dir):
    none = spark.createDataFrame([], "script_id long, stmt_idx int, scope_id string, name string")
    return resolve.resolve_unqualified(refs(spark, sf_dir), visible(spark, sf_dir), none).select("script_id", "pos", F.col("src_table").alias("table_name"), F.col("src_column").alias("col"))


@query(_VISIBLE + "SELECT ff.script_id, ff.pos, table_name FROM ff JOIN vi ON vi.script_id = ff.script_id AND (ff.qualifier IS NULL OR vi.alias = lower(ff.qualifier)) WHERE col = '*'")
def resolve_star(spark, sf_dir):
    return resolve.resolve_star(refs(spark, sf_dir), visible(spark, sf_dir)).select("script_id", "pos", F.col("src_table").alias("table_name"))


@query(_VISIBLE + """SELECT DISTINCT ff.script_id, ff.pos, table_name, col FROM ff JOIN vi ON vi.script_id = ff.script_id AND (ff.qualifier IS NULL OR vi.alias = lower(ff.qualifier))""")
def expression_sources(spark, sf_dir):
    r, v = refs(spark, sf_dir), visible(spark, sf_dir)
    none = spark.createDataFrame([], "script_id long, stmt_idx int, scope_id string, name string")
    found = resolve.resolve_qualified(r, v).unionByName(resolve.resolve_unqualified(r, v, none)).unionByName(resolve.resolve_star(r, v))
    items = r.select(*resolve.REF).distinct().withColumn("name", F.lit("x"))
    return resolve.expression_sources(found, items).select("script_id", "pos", F.col("src_table").alias("table_name"), F.col("src_column").alias("col"))


@query(f"""WITH {_RF}, {_FF} SELECT DISTINCT ff.script_id, ff.pos, rf.table_name, ff.col FROM ff JOIN rf ON rf.script_id = ff.script_id WHERE ff.col NOT IN ('*', 'c1')""")
def resolve_derived_missing(spark, sf_dir):
    """Each reference is asked of a derived relation that only has ``c1``, below which the script's tables lie."""
    none = F.lit(None).cast("string")
    wanted = refs(spark, sf_dir).select(*resolve.REF, none.alias("src_table"), F.lit("d").alias("src_scope"), F.col("col").alias("src_column"))
    outputs = wanted.select("script_id", "stmt_idx", F.lit("d").alias("scope_id"), F.lit("c1").alias("name")).distinct()
    bases = derived(spark, sf_dir, fixtures.RELATIONS_FACTS).select("script_id", "stmt_idx", F.lit("d").alias("scope_id"), "table_name").distinct()
    return resolve.resolve_derived_missing(wanted, outputs, bases).select("script_id", "pos", F.col("src_table").alias("table_name"), F.col("src_column").alias("col")).distinct()


_N = f"WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 4 AS v, {_X} AS x FROM orders) "


def nested(spark, sf_dir, take):
    """``take`` of the facts of nested statements, mined once a text."""
    return mined_by_text(spark, sf_dir, fixtures.NESTED_SCRIPTS, lambda s: take(resolve.statement_facts(s)))


@query(_N + """SELECT script_id, scope_id, pos, name, src_scope FROM o, (VALUES ('m.f0', 1, 'k', 'm.f0.u0'), ('m.f0', 1, 'k', 'm.f0.u1'), ('m.f0', 2, 'w', 'm.f0.u0'), ('m.f0', 3, 'v', 'm.f0.u1')) AS t(scope_id, pos, name, src_scope) WHERE o.v = 0""")
def union_merge(spark, sf_dir):
    b = blocks(spark, sf_dir, fixtures.NESTED_SCRIPTS)
    own = sqltext.sql_projections(b).select(*resolve.REF, "name")
    return resolve.union_merge(own, b).select("script_id", "scope_id", "pos", "name", "src_scope")


@query(_N + "SELECT script_id, 'm' AS scope_id, 2 AS pos, 'm.s0' AS src_scope FROM o WHERE v = 2")
def scalar_subquery_sources(spark, sf_dir):
    b = blocks(spark, sf_dir, fixtures.NESTED_SCRIPTS)
    return resolve.scalar_subquery_sources(sqltext.sql_projections(b), b).select("script_id", "scope_id", "pos", "src_scope")


_DERIVED = """d AS (SELECT script_id, 1 AS pos, 'k' AS name, 'b.c' || x AS src_table, 'k' AS src_column FROM o WHERE v = 0 UNION ALL SELECT script_id, 1, 'k', 'b.d', 'k' FROM o WHERE v = 0
UNION ALL SELECT script_id, 1, 'pp', 'r.s' || x, 'p' FROM o WHERE v = 1 UNION ALL SELECT script_id, 1, 'a', 's.m', 'a' FROM o WHERE v = 2 UNION ALL SELECT script_id, 2, 'mz', 's.q' || x, 'z' FROM o WHERE v = 2)"""


@query(_N.rstrip() + f", {_DERIVED} SELECT * FROM d")
def derived_passthrough(spark, sf_dir):
    return nested(spark, sf_dir, lambda f: f["derived"].where("scope_id = 'm'").select("script_id", "pos", "name", "src_table", "src_column"))


@query(_N.rstrip() + f""", {_DERIVED} SELECT d.script_id, d.pos, src_table AS source_table, src_column AS source_column, CASE v WHEN 0 THEN 't.u' WHEN 1 THEN 'o.o' ELSE 't.v' END AS target_table,
CASE v WHEN 0 THEN 'x' ELSE name END AS target_column FROM d JOIN o ON o.script_id = d.script_id""")
def insert_column_rename(spark, sf_dir):
    return nested(spark, sf_dir, lambda f: resolve.insert_column_rename(f["derived"], f["targets"]).drop("stmt_idx"))


@query(_S + """SELECT script_id, 'hr.desk' || x AS source_table, 'room' AS source_column, 'hr.staff' AS target_table, 'desk' AS target_column FROM o WHERE v = 4 UNION ALL SELECT script_id, 'hr.desk' || x, 'head', 'hr.staff', 'boss' FROM o WHERE v = 4""")
def update_edges(spark, sf_dir):
    def edges(s):
        f = resolve.statement_facts(s)
        return resolve.update_edges(f["set_items"], f["sources"], f["targets"]).select("script_id", *EDGE_PARTS)

    return mined_by_text(spark, sf_dir, fixtures.SQL_SCRIPTS, edges)


@query(_N + """SELECT script_id, 's.u' || x AS source_table, c AS source_column, 'm.t' AS target_table, t AS target_column FROM o, (VALUES ('b', 'a'), ('id', 'id'), ('c', 'a')) AS m(c, t) WHERE v = 3""")
def merge_edges(spark, sf_dir):
    return nested(spark, sf_dir, lambda f: resolve.merge_edges(f["set_items"], f["sources"], f["targets"])[0].select("script_id", *EDGE_PARTS))


@query(f"""WITH p AS (SELECT * FROM ({fixtures.PATH_FACTS}) AS r WHERE tbl NOT IN ('cte1', 'cte3')), n AS (SELECT script_id, path_id, tbl AS source_table, col AS source_column,
lead(tbl) OVER w AS target_table, lead(col) OVER w AS target_column FROM p WINDOW w AS (PARTITION BY script_id, path_id ORDER BY pos)) SELECT * FROM n WHERE target_table IS NOT NULL""")
def cte_path_fold(spark, sf_dir):
    paths = derived(spark, sf_dir, fixtures.PATH_FACTS)
    ctes = paths.select("script_id", F.explode(F.array(F.lit("cte1"), F.lit("cte3"))).alias("name")).distinct()
    return resolve.cte_path_fold(paths, ctes)


@query(f"WITH {_COLUMN_EDGES}, {_TABLE_EDGES} SELECT DISTINCT script_id, 'no_column_lineage' AS code FROM te WHERE script_id NOT IN (SELECT script_id FROM ce WHERE source_column <> '*')")
def no_column_lineage_warning(spark, sf_dir):
    g = normal(spark, sf_dir)
    return resolve.no_column_lineage_warning(g["table_edges"], g["column_edges"].where("source_column <> '*'"))


_LINEAGE = f"""{_SOURCES}, s AS (SELECT DISTINCT r.script_id, v, r.stmt_idx, table_name FROM r JOIN o ON o.script_id = r.script_id WHERE table_name <> 'hits'
UNION SELECT script_id, v, 1, 'hr.desk' || x FROM o WHERE v = 4),
w AS (SELECT script_id, v, 1 AS stmt_idx, {_TARGETS} AS target FROM o WHERE v < 5 UNION SELECT script_id, v, 2, 'web.seen' FROM o WHERE v = 1),
ce AS (SELECT script_id, CASE WHEN numbered THEN t || x ELSE t END AS a, c, t2, c2 FROM o JOIN (VALUES (0, 'core.trade', true, 'nr', 'fin.book', 'acct'), (0, 'core.cost', false, 'rate', 'fin.book', 'fee'), (0, 'core.trade', true, 'vol', 'fin.book', 'fee'),
(1, 'log.raw', true, 'page', 'web.top', 'url'), (1, 'log.raw', true, 'visitor', 'web.top', 'visitors'), (1, 'log.raw', true, 'visitor', 'web.seen', 'who'), (2, 'geo.point', true, 'land', 'geo.area', 'land'),
(2, 'geo.point', true, 'height', 'geo.area', 'peak'), (3, 'arc.live', true, '*', 'arc.copy', '*'), (3, 'arc.memo', false, 'note', 'arc.copy', 'note'), (4, 'hr.desk', true, 'room', 'hr.staff', 'desk'), (4, 'hr.desk', true, 'head', 'hr.staff', 'boss'))
AS f(w, t, numbered, c, t2, c2) ON f.w = o.v),
rows_ AS (SELECT DISTINCT script_id, 'tables' AS part, table_name AS a, 'source' AS b, CAST(NULL AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS d FROM s
UNION ALL SELECT script_id, 'tables', target, 'target', NULL, NULL FROM w
UNION ALL SELECT w.script_id, 'table_edges', table_name, target, NULL, NULL FROM s JOIN w ON w.script_id = s.script_id AND w.stmt_idx = s.stmt_idx
UNION ALL SELECT script_id, 'column_edges', a, c, t2, c2 FROM ce)"""


@query(_S.rstrip() + f""", {_LINEAGE} SELECT * FROM rows_ UNION ALL SELECT script_id, 'attempts', 'true', '', NULL, NULL FROM o""")
def sql_lineage(spark, sf_dir):
    g = resolve.sql_lineage(derived(spark, sf_dir, fixtures.SQL_SCRIPTS))
    return flat_rows({k: v for k, v in g.items() if k != "warnings"})


@query("""WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 4 AS v, CAST(o_custkey % 50 AS VARCHAR) AS x FROM orders)
SELECT script_id, v < 3 AS ok, CASE v WHEN 0 THEN 'datax' WHEN 1 THEN 'sqlglot' WHEN 2 THEN 'druid' END AS parser, CAST(CASE WHEN v < 3 THEN v + 1 ELSE 0 END AS BIGINT) AS n_attempts, CASE WHEN v = 3 THEN 'empty' END AS error,
CASE v WHEN 0 THEN 'in.t' || x WHEN 1 THEN 'in.s' || x WHEN 2 THEN 'ext.s' || x END AS source, CASE v WHEN 0 THEN 'out.w' WHEN 1 THEN 'out.r' WHEN 2 THEN 'ext.t' END AS target,
CAST(CASE v WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS BIGINT) AS n_column_edges, CASE v WHEN 2 THEN 'w' END AS warning FROM o""")
def analyse_corpus(spark, sf_dir):
    """Answers for a mixed corpus of jobs, SQL and another engine's replies, read back from their JSON."""
    others = {"druid": corpus.engine_graph_json(derived(spark, sf_dir, fixtures.MIXED_REPLIES))}
    out = service.analyse_corpus(derived(spark, sf_dir, fixtures.MIXED_CORPUS), others)["responses"]
    shape = "parser string, error string, attempts array<string>, graph struct<table_edges:array<struct<source:string,target:string>>,column_edges:array<string>,warnings:array<string>>"
    r = out.select("script_id", "ok", F.from_json("response", shape).alias("r"))
    return r.select(
        "script_id", "ok", "r.parser", F.coalesce(F.greatest(F.size("r.attempts"), F.lit(0)), F.lit(0)).cast("long").alias("n_attempts"), "r.error",
        F.get("r.graph.table_edges", F.lit(0))["source"].alias("source"), F.get("r.graph.table_edges", F.lit(0))["target"].alias("target"),
        F.when(F.col("r.graph").isNotNull(), F.size("r.graph.column_edges")).cast("long").alias("n_column_edges"), F.get("r.graph.warnings", F.lit(0)).alias("warning"),
    )


# -- graph analytics -------------------------------------------------------------------------------------------

_CYCLIC = f"ed AS ({fixtures.CYCLIC_EDGES})"
_SYM = "sy AS (SELECT script_id, source AS a, target AS b FROM ed UNION SELECT script_id, target, source FROM ed)"
_SEED = "se AS (SELECT script_id, min(a) AS id FROM sy GROUP BY 1)"
_CLOSURE = f"""WITH RECURSIVE {_CYCLIC}, {_SYM}, {_SEED}, cl AS (SELECT script_id, id FROM se UNION SELECT sy.script_id, sy.b FROM cl JOIN sy ON sy.script_id = cl.script_id AND sy.a = cl.id) """


def cyclic(spark, sf_dir):
    edges = derived(spark, sf_dir, fixtures.CYCLIC_EDGES)
    nodes = edges.select("script_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    return edges, nodes, nodes.groupBy("script_id").agg(F.min("id").alias("id"))


@query(_CLOSURE + "SELECT script_id, 'node' AS part, id AS a, CAST(NULL AS VARCHAR) AS b FROM cl UNION ALL SELECT DISTINCT ed.script_id, 'edge', source, target FROM ed JOIN cl ON cl.script_id = ed.script_id AND cl.id = ed.source")
def table_closure(spark, sf_dir):
    edges, _, seeds = cyclic(spark, sf_dir)
    nodes, kept = closure.table_closure(edges, seeds)
    return nodes.select("script_id", F.lit("node").alias("part"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(
        kept.select("script_id", F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"))
    )


_COLUMN_CLOSURE = f"""WITH RECURSIVE {_COLUMN_EDGES}, cs AS (SELECT script_id, source_table || chr(1) || lower(source_column) AS a, target_table || chr(1) || lower(target_column) AS b FROM ce),
sy AS (SELECT * FROM cs UNION SELECT script_id, b, a FROM cs), se AS (SELECT script_id, min(a) AS id FROM cs GROUP BY 1),
cl AS (SELECT script_id, id FROM se UNION SELECT sy.script_id, sy.b FROM cl JOIN sy ON sy.script_id = cl.script_id AND sy.a = cl.id) """


def column_seeds(edges):
    key = F.struct(F.col("source_table").alias("tbl"), F.lower("source_column").alias("col"))
    return edges.groupBy("script_id").agg(F.min(key).alias("k")).select("script_id", "k.tbl", "k.col")


@query(_COLUMN_CLOSURE + "SELECT script_id, split_part(id, chr(1), 1) AS tbl, split_part(id, chr(1), 2) AS col FROM cl")
def column_closure(spark, sf_dir):
    edges = materialize(graph.column_edge_dedup(raw_edges(spark, sf_dir)[1]))
    return closure.column_closure(edges, column_seeds(edges))[0]


@query(_COLUMN_CLOSURE + "SELECT ce.script_id, source_table, source_column, target_table, target_column FROM ce JOIN cl ON cl.script_id = ce.script_id AND cl.id = source_table || chr(1) || lower(source_column)")
def edge_focus(spark, sf_dir):
    """The column edges to show for the edge of each script with the least source column."""
    edges = materialize(graph.column_edge_dedup(raw_edges(spark, sf_dir)[1]))
    chosen = column_seeds(edges).select("script_id", F.col("tbl").alias("source_table"), F.col("col").alias("source_column"))
    return closure.edge_focus(edges, chosen, "column")[0].select("script_id", *EDGE_PARTS)


@query(f"""WITH RECURSIVE {_CYCLIC}, {_SYM}, {_SEED}, e1 AS (SELECT DISTINCT * FROM ed), rc AS (SELECT script_id, id, 0 AS depth FROM se UNION SELECT e1.script_id, e1.target, rc.depth + 1 FROM rc JOIN e1 ON e1.script_id = rc.script_id AND e1.source = rc.id WHERE rc.depth < 20)
SELECT script_id, id, min(depth) AS depth FROM rc GROUP BY 1, 2""")
def lineage_reach(spark, sf_dir):
    edges, _, seeds = cyclic(spark, sf_dir)
    return closure.lineage_reach(edges, seeds)


@query("""WITH n AS (SELECT c_nationkey AS k, 'cust' || c_custkey AS id FROM customer UNION ALL SELECT c_nationkey, 'ord' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT DISTINCT c_nationkey, 'nation' || c_nationkey FROM customer)
SELECT id, (min(id) OVER (PARTITION BY k)) AS component FROM n""")
def closure_components(spark, sf_dir):
    return closure.closure_components(derived(spark, sf_dir, fixtures.CORPUS_EDGES))


@query(f"WITH {_COLUMN_EDGES} SELECT script_id, source_table, source_column, target_table, target_column FROM ce WHERE source_table = 'ods.t1' OR target_table = 'ods.t1'")
def table_column_edges(spark, sf_dir):
    edges = materialize(graph.column_edge_dedup(raw_edges(spark, sf_dir)[1]))
    seeds = edges.select("script_id", F.lit("ods.t1").alias("id")).distinct()
    return closure.table_column_edges(edges, seeds)[0]


@query(_CLOSURE + "SELECT ed.script_id, source, target, cl.id IS NOT NULL AS selected FROM (SELECT DISTINCT * FROM ed) AS ed LEFT JOIN cl ON cl.script_id = ed.script_id AND cl.id = ed.source")
def closure_flag(spark, sf_dir):
    edges, _, seeds = cyclic(spark, sf_dir)
    return closure.closure_flag(edges.distinct(), closure.table_closure(edges, seeds)[1], ["script_id", "source", "target"])


@query(f"WITH {_COLUMN_EDGES} SELECT script_id, source_table AS source, target_table AS target, source_column, target_column FROM ce")
def graph_at_grain(spark, sf_dir):
    tables, columns = raw_edges(spark, sf_dir)
    return closure.graph_at_grain(graph.table_edge_dedup(tables), graph.column_edge_dedup(columns), "column")


@query(f"""WITH {_COLUMN_EDGES}, {_COLUMNS}, f AS (SELECT script_id, tbl, lower(col) AS k, min(ord) AS ord FROM oc WHERE ord <= 3 GROUP BY 1, 2, 3)
SELECT ce.script_id, source_table, source_column, target_table, target_column, a.ord AS src_ord, b.ord AS tgt_ord FROM ce LEFT JOIN f AS a ON a.script_id = ce.script_id AND a.tbl = source_table AND a.k = lower(source_column)
LEFT JOIN f AS b ON b.script_id = ce.script_id AND b.tbl = target_table AND b.k = lower(target_column)""")
def edge_column_ordinals(spark, sf_dir):
    """Positions in lists cut to three columns, so that some are missing."""
    edges = graph.column_edge_dedup(raw_edges(spark, sf_dir)[1])
    kept, _ = graph.column_cap(graph.column_order(listed_columns(spark, sf_dir)), 3)
    return closure.edge_column_ordinals(edges, kept).select("script_id", *EDGE_PARTS, "src_ord", "tgt_ord")


_DAG = f"ed AS ({fixtures.DAG_EDGES})"
_DEPTHS = """no AS (SELECT script_id, source AS id FROM ed UNION SELECT script_id, target FROM ed), e1 AS (SELECT DISTINCT * FROM ed),
dp AS (SELECT script_id, id, 0 AS d FROM no UNION SELECT e1.script_id, e1.target, dp.d + 1 FROM dp JOIN e1 ON e1.script_id = dp.script_id AND e1.source = dp.id), rk AS (SELECT script_id, id, max(d) AS rank FROM dp GROUP BY 1, 2)"""


def dag(spark, sf_dir):
    edges = derived(spark, sf_dir, fixtures.DAG_EDGES)
    return edges, edges.select("script_id", F.explode(F.array("source", "target")).alias("id")).distinct()


@query(f"WITH RECURSIVE {_DAG}, {_DEPTHS} SELECT * FROM rk")
def longest_path_rank(spark, sf_dir):
    edges, nodes = dag(spark, sf_dir)
    return layers.longest_path_rank(nodes, edges)


@query(f"""WITH RECURSIVE {_CYCLIC}, no AS (SELECT script_id, source AS id FROM ed UNION SELECT script_id, target FROM ed), e0 AS (SELECT DISTINCT * FROM ed WHERE source <> target),
tc AS (SELECT script_id, source AS a, target AS b FROM e0 WHERE script_id % 17 = 0 UNION SELECT tc.script_id, tc.a, e0.target FROM tc JOIN e0 ON e0.script_id = tc.script_id AND e0.source = tc.b),
un AS (SELECT DISTINCT script_id, b AS id FROM tc WHERE (script_id, a) IN (SELECT (script_id, a) FROM tc WHERE a = b)),
e1 AS (SELECT * FROM e0 WHERE (script_id, target) NOT IN (SELECT (script_id, id) FROM un)),
dp AS (SELECT script_id, id, 0 AS d FROM no WHERE (script_id, id) NOT IN (SELECT (script_id, id) FROM un) UNION SELECT e1.script_id, e1.target, dp.d + 1 FROM dp JOIN e1 ON e1.script_id = dp.script_id AND e1.source = dp.id),
rk AS (SELECT script_id, id, max(d) AS rank FROM dp GROUP BY 1, 2)
SELECT * FROM rk UNION ALL SELECT un.script_id, un.id, coalesce((SELECT max(rk.rank) + 1 FROM e0 JOIN rk ON rk.script_id = e0.script_id AND rk.id = e0.source WHERE e0.script_id = un.script_id AND e0.target = un.id), 0) FROM un""")
def longest_path_rank_cyclic(spark, sf_dir):
    edges, nodes, _ = cyclic(spark, sf_dir)
    return layers.longest_path_rank(nodes, edges)


@query()
def layer_barycenter_order(spark, sf_dir):
    """No SQL: each layer's order depends on the one before; tests hold it against a sequential version."""
    edges, nodes = dag(spark, sf_dir)
    ranked = layers.longest_path_rank(nodes, edges).withColumn("seq", F.substring("id", 2, 9).cast("int"))
    return layers.layer_barycenter_order(ranked, edges)


@query(f"""WITH RECURSIVE {_DAG}, {_DEPTHS}, o AS (SELECT *, row_number() OVER (PARTITION BY script_id, rank ORDER BY id) - 1 AS ord FROM rk),
l AS (SELECT script_id, rank, 170.0 AS w, count(*) * 72.0 + (count(*) - 1) * 30 AS h FROM o GROUP BY 1, 2), m AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY script_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + rank * 90 AS x, max(h) OVER (PARTITION BY script_id) AS tall FROM l)
SELECT o.script_id, id, CAST(x AS DOUBLE) AS x, CAST((tall - h) / 2 + ord * 102.0 + 36 AS DOUBLE) AS y FROM o JOIN m ON m.script_id = o.script_id AND m.rank = o.rank""")
def layer_geometry(spark, sf_dir):
    edges, nodes = dag(spark, sf_dir)
    order = Window.partitionBy("script_id", "rank").orderBy("id")
    ranked = layers.longest_path_rank(nodes, edges).withColumn("ord", F.row_number().over(order) - 1).withColumn("columns", F.array(F.concat(F.lit("col"), "id")))
    return layers.layer_geometry(ranked, "column").select("script_id", "id", "x", "y")


@query(_NORM + """SELECT coalesce(t.script_id, x.script_id) AS script_id, coalesce(t.n, 0) AS n_tables, coalesce(e.n, 0) AS n_table_edges, coalesce(x.n, 0) AS n_column_edges FROM (SELECT script_id, count(*) AS n FROM ot GROUP BY 1) AS t
LEFT JOIN (SELECT script_id, count(*) AS n FROM te GROUP BY 1) AS e ON e.script_id = t.script_id FULL JOIN (SELECT script_id, count(*) AS n FROM ce GROUP BY 1) AS x ON x.script_id = t.script_id""")
def graph_stats(spark, sf_dir):
    g = normal(spark, sf_dir)
    return stats.graph_stats(g["tables"], g["table_edges"], g["column_edges"])


@query(_TRIED.rstrip() + f", {_COLUMN_EDGES}, {_TABLE_EDGES}, {_ROLES}" + """, st AS (SELECT t.script_id, t.n AS a, coalesce(e.n, 0) AS b, coalesce(x.n, 0) AS c FROM (SELECT script_id, count(*) AS n FROM ot GROUP BY 1) AS t
LEFT JOIN (SELECT script_id, count(*) AS n FROM te GROUP BY 1) AS e ON e.script_id = t.script_id LEFT JOIN (SELECT script_id, count(*) AS n FROM ce GROUP BY 1) AS x ON x.script_id = t.script_id)
SELECT p.engine, count(*) AS n_scripts, CAST(sum(a) AS BIGINT) AS n_tables, CAST(sum(b) AS BIGINT) AS n_table_edges, CAST(sum(st.c) AS BIGINT) AS n_column_edges FROM st LEFT JOIN p ON p.script_id = st.script_id GROUP BY 1""")
def engine_stats(spark, sf_dir):
    g = normal(spark, sf_dir)
    picks = corpus.fallback_pick(derived(spark, sf_dir, fixtures.CANDIDATES))
    return stats.engine_stats(stats.graph_stats(g["tables"], g["table_edges"], g["column_edges"], picks))


# -- runs and streams --------------------------------------------------------------------------------------------


@query(f"""WITH v AS (SELECT tbl, since, max(struct_pack(a := version, b := n_columns)) AS x FROM ({fixtures.VERSIONS}) AS q GROUP BY tbl, since)
SELECT r.run_id, r.tbl, r.run_at, x.a AS version, x.b AS n_columns FROM ({fixtures.RUNS}) AS r ASOF LEFT JOIN v ON r.tbl = v.tbl AND r.run_at >= v.since""")
def catalogue_as_of(spark, sf_dir):
    """The catalogue's version that held when a script ran."""
    return runs.as_of(derived(spark, sf_dir, fixtures.RUNS), derived(spark, sf_dir, fixtures.VERSIONS), "tbl", "run_at", "since", ["version", "n_columns"])


@query(f"""WITH s AS (SELECT run_id, tbl, datediff('day', DATE '1970-01-01', CAST(began AS DATE)) AS a, datediff('day', DATE '1970-01-01', CAST(began AS DATE)) + days AS b FROM ({fixtures.SPANS}) AS q)
SELECT x.tbl AS key, x.run_id AS earlier, y.run_id AS later FROM s x JOIN s y ON x.tbl = y.tbl AND (x.a < y.a OR (x.a = y.a AND x.run_id < y.run_id)) AND y.a <= x.b""")
def overlapping_runs(spark, sf_dir):
    """Pairs of runs that were at work on one table at once."""
    spans = derived(spark, sf_dir, fixtures.SPANS).withColumn("a", F.datediff("began", F.lit("1970-01-01")))
    return runs.overlapping_runs(spans.withColumn("b", F.col("a") + F.col("days")), "run_id", "tbl", "a", "b")


@query("""WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
i AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS island FROM e)
SELECT key, min(ts) AS session_start, max(ts) AS last_at, count(*) AS n FROM i GROUP BY key, island""")
def run_sessions(spark, sf_dir):
    """Sessions of each user's events."""
    return runs.run_sessions(_table(spark, sf_dir, "events"), "user_id", "ts", "3 hours")


@query(f"""WITH c AS (SELECT script_id, source, target, sum(o) AS o, sum(n) AS n FROM (
  SELECT script_id, source, target, 1 AS o, 0 AS n FROM ({fixtures.OLD_EDGES}) AS q UNION ALL SELECT script_id, source, target, 0, 1 FROM ({fixtures.NEW_EDGES}) AS r) GROUP BY script_id, source, target),
k AS (SELECT *, row_number() OVER (PARTITION BY script_id, target, o = 0 ORDER BY source) AS k FROM c WHERE o = 0 OR n = 0)
SELECT coalesce(d.script_id, a.script_id) AS script_id, coalesce(d.target, a.target) AS target,
  CASE WHEN d.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'dropped' ELSE 'moved' END AS change, d.source AS old_source, a.source AS new_source,
  CAST(coalesce(d.o, 0) AS BIGINT) AS old_copies, CAST(coalesce(a.n, 0) AS BIGINT) AS new_copies
FROM (SELECT * FROM k WHERE n = 0) d FULL JOIN (SELECT * FROM k WHERE o = 0) a ON d.script_id = a.script_id AND d.target IS NOT DISTINCT FROM a.target AND d.k = a.k
UNION ALL SELECT script_id, target, 'recounted', source, source, CAST(o AS BIGINT), CAST(n AS BIGINT) FROM c WHERE o > 0 AND n > 0 AND o <> n""")
def graph_difference(spark, sf_dir):
    """What changed between two versions of a corpus' edges."""
    return runs.graph_difference(derived(spark, sf_dir, fixtures.OLD_EDGES), derived(spark, sf_dir, fixtures.NEW_EDGES))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark, sf_dir, name):
    return spark.readStream.schema(_table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _new_folder(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


@query(ORACLES["sql_targets"])
def stream_targets(spark, sf_dir):
    """The written tables of scripts that arrive as a stream."""
    folder = _new_folder(spark)
    _stream(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    streaming.stream_targets(spark.sql(fixtures.SQL_SCRIPTS), f"{folder}/sink", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/sink").select("script_id", "stmt_idx", "table_name")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS \"by\", count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Events of each type in windows of six hours, counted as a stream."""
    folder = _new_folder(spark)
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone
    streaming.stream_windows(events, f"{folder}/sink", f"{folder}/state", "ts", "event_type", "6 hours", "1 day").awaitTermination()
    return streaming.read_windows(spark, f"{folder}/sink").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# -- further engines and sketches --------------------------------------------------------------------------------

_DECLARED = f"WITH o AS (SELECT o_orderkey AS script_id, o_orderkey % 5 AS v, {_X} AS x FROM orders) "


@query(_DECLARED + """SELECT script_id, 'tables' AS part, 'in.s' || x AS a, 'source' AS b, NULL AS c, NULL AS d FROM o WHERE v = 0
UNION ALL SELECT script_id, 'tables', 'in.k', 'source', NULL, NULL FROM o WHERE v = 0 UNION ALL SELECT script_id, 'tables', 'out.t', 'target', NULL, NULL FROM o WHERE v = 0
UNION ALL SELECT script_id, 'tables', 'a', 'source', NULL, NULL FROM o WHERE v = 4 UNION ALL SELECT script_id, 'tables', 'b', 'target', NULL, NULL FROM o WHERE v = 4
UNION ALL SELECT script_id, 'tables', 'c' || x, 'target', NULL, NULL FROM o WHERE v = 4
UNION ALL SELECT script_id, 'table_edges', 'in.s' || x, 'out.t', NULL, NULL FROM o WHERE v = 0 UNION ALL SELECT script_id, 'table_edges', 'in.k', 'out.t', NULL, NULL FROM o WHERE v = 0
UNION ALL SELECT script_id, 'table_edges', 'a', 'b', NULL, NULL FROM o WHERE v = 4 UNION ALL SELECT script_id, 'table_edges', 'b', 'c' || x, NULL, NULL FROM o WHERE v = 4
UNION ALL SELECT script_id, 'attempts', CASE WHEN v IN (0, 4) THEN 'true' ELSE 'false' END, CASE v WHEN 1 THEN 'unreadable: in.s' || x WHEN 2 THEN 'no lineage comment' WHEN 3 THEN 'empty' ELSE '' END, NULL, NULL FROM o""")
def table_function_engine(spark, sf_dir):
    """The graphs of an engine that was added as a table function."""
    return flat_rows(corpus.engine_graph_json(extension.engine_replies(derived(spark, sf_dir, fixtures.DECLARED), extension.declared_lineage)))


_WITH_DECLARED = f"""WITH c0 AS ({fixtures.CANDIDATES}), c AS (
SELECT script_id, CASE WHEN preference = 'nosuch' THEN 'declared' ELSE preference END AS preference, engine, CASE WHEN engine = 'ai' THEN 6 ELSE engine_rank END AS engine_rank, ok, message FROM c0
UNION ALL SELECT o_orderkey, CASE o_custkey % 7 WHEN 0 THEN 'druid' WHEN 1 THEN 'declared' ELSE 'auto' END, 'declared', 5, o_orderkey % 5 IN (0, 4),
  CASE o_orderkey % 5 WHEN 1 THEN 'unreadable: in.s' || {_X} WHEN 2 THEN 'no lineage comment' WHEN 3 THEN 'empty' ELSE '' END FROM orders), """


@query(_WITH_DECLARED + _TRIED[len(_CANDIDATES):] + "SELECT * FROM p")
def table_function_fallback(spark, sf_dir):
    """The choice among engines of which one was added as a table function, before the last."""
    ranks = engine_ranks({"declared": "ai"})
    given = derived(spark, sf_dir, fixtures.CANDIDATES).withColumn("preference", F.when(F.col("preference") == "nosuch", "declared").otherwise(F.col("preference")))
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    given = given.withColumn("engine_rank", rank[F.col("engine")])
    replies = extension.engine_replies(derived(spark, sf_dir, fixtures.DECLARED), extension.declared_lineage)
    own = corpus.engine_graph_json(replies)["attempts"].select("script_id", F.lit("declared").alias("engine"), F.lit(ranks["declared"]).alias("engine_rank"), "ok", "message")
    asked = given.groupBy("script_id").agg(F.first("preference").alias("preference"))
    return corpus.fallback_pick(given.unionByName(asked.join(own, "script_id")), ranks)


_SKETCH_DIMS = ["engine", "dialect", "role"]
_LEVELS = "CAST(grouping(engine) + grouping(dialect) + grouping(role) AS INTEGER) AS level"


@query(f"""SELECT engine, dialect, role, {_LEVELS}, count(*) AS n, true AS near FROM ({fixtures.FACTS}) AS q GROUP BY ROLLUP (engine, dialect, role)""")
def sketch_distinct(spark, sf_dir):
    """Distinct tables under rollup from merged sketches, held against exact counts: within five standard errors or not."""
    facts = derived(spark, sf_dir, fixtures.FACTS)
    out = sketches.rollup_distinct(materialize(sketches.distinct_sketches(facts, "script_id", _SKETCH_DIMS, "tbl")), _SKETCH_DIMS)
    exact = facts.rollup(*_SKETCH_DIMS).agg(sketches._level(_SKETCH_DIMS), F.count_distinct("tbl").alias("exact"))
    same = [out[c].eqNullSafe(exact[c]) for c in [*_SKETCH_DIMS, "level"]]
    near = F.abs(F.col("items") - F.col("exact")) <= F.col("exact") * 5 * 1.04 / 2 ** (sketches.LOG_REGISTERS / 2)
    return out.join(exact, same).select(*[out[c] for c in [*_SKETCH_DIMS, "level", "n"]], near.alias("near"))


@query(f"""WITH g AS (SELECT engine, dialect, role, {_LEVELS}, list(n_chars ORDER BY n_chars) FILTER (n_chars IS NOT NULL) AS v FROM ({fixtures.FACTS}) AS q GROUP BY ROLLUP (engine, dialect, role)),
r AS (SELECT *, len(v) AS n, v[CAST(greatest(1, (len(v) * permille + 999) // 1000) AS BIGINT)] AS x FROM g CROSS JOIN (VALUES (0), (500), (900), (990), (1000)) AS p(permille) WHERE len(v) > 0),
s AS (SELECT *, CASE WHEN x < 0 THEN -1 - x ELSE x END AS u FROM r), t AS (SELECT *, CAST(greatest(length(bin(u)) - 7, 0) AS BIGINT) AS z FROM s),
m AS (SELECT *, (u >> z) * (1::BIGINT << z) + (1::BIGINT << z) // 2 AS mid FROM t)
SELECT engine, dialect, role, level, permille, n, CASE WHEN x < 0 THEN -1 - mid ELSE mid END AS value FROM m""")
def sketch_quantiles(spark, sf_dir):
    """Quantiles of text lengths under rollup from merged histograms; the SQL takes the exact ones and rounds them."""
    stored = materialize(sketches.quantile_sketches(derived(spark, sf_dir, fixtures.FACTS), "script_id", _SKETCH_DIMS, "n_chars"))
    return sketches.rollup_quantiles(stored, _SKETCH_DIMS, [0, 500, 900, 990, 1000])
