"""Inputs derived from the given tables by SQL that Spark and DuckDB share: queries and oracles start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "events"]

#: Case variants, blanks, stars, self edges, tables that are both source and target.
COLUMN_EDGES_RAW = """
SELECT l_orderkey AS script_id,
       CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq,
       concat(CASE WHEN l_linenumber % 3 = 0 THEN 'ODS.T' ELSE 'ods.t' END, CAST(l_partkey % 5 AS VARCHAR(9))) AS source_table,
       CASE WHEN l_partkey % 13 = 0 THEN '  ' WHEN l_partkey % 11 = 0 THEN '*'
            ELSE concat(CASE WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'c' END, CAST(l_suppkey % 7 AS VARCHAR(9))) END AS source_column,
       concat('ods.t', CAST(l_partkey % 5 + l_suppkey % 3 AS VARCHAR(9))) AS target_table,
       concat(' x', CAST(l_suppkey % 7 AS VARCHAR(9))) AS target_column
FROM lineitem
"""

TABLE_EDGES_RAW = """
SELECT l_orderkey AS script_id,
       CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq,
       CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE concat('ods.t', CAST(l_partkey % 5 AS VARCHAR(9))) END AS source,
       concat('ods.t', CAST(l_partkey % 5 + l_suppkey % 3 AS VARCHAR(9)), ' ') AS target
FROM lineitem
"""

ROLE_EVENTS = """
SELECT l_orderkey AS script_id, concat('t', CAST(l_partkey % 6 AS VARCHAR(9))) AS tbl,
       CASE l_suppkey % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'target' ELSE 'intermediate' END AS role,
       CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq
FROM lineitem
"""

#: More than 80 columns for some tables (`column_cap`).
WIDE_TABLE_COLUMNS = """
SELECT l_suppkey % 10 AS script_id, concat('w', CAST(l_suppkey % 3 AS VARCHAR(9))) AS tbl,
       CASE WHEN l_partkey % 97 = 0 THEN '*'
            ELSE concat('col', CAST(l_partkey % (40 + 50 * (l_suppkey % 3)) AS VARCHAR(9))) END AS col
FROM lineitem
"""

#: Acyclic per script: the target number is always larger than the source number.
DAG_EDGES = """
SELECT l_orderkey AS script_id, concat('n', CAST(l_partkey % 12 AS VARCHAR(9))) AS source,
       concat('n', CAST(l_partkey % 12 + 1 + l_suppkey % 3 AS VARCHAR(9))) AS target
FROM lineitem
"""

#: The same plus back edges in every 17th script.
CYCLIC_EDGES = """
SELECT l_orderkey AS script_id, concat('n', CAST(l_partkey % 12 AS VARCHAR(9))) AS source,
       concat('n', CAST(l_partkey % 12 + 1 + l_suppkey % 3 AS VARCHAR(9))) AS target
FROM lineitem
UNION ALL
SELECT l_orderkey, concat('n', CAST(l_partkey % 12 + 1 + l_suppkey % 3 AS VARCHAR(9))),
       concat('n', CAST(l_partkey % 12 AS VARCHAR(9)))
FROM lineitem WHERE l_orderkey % 17 = 0 AND l_linenumber = 1
"""

#: Hubs (nations) with very many neighbours; one component per nation that has customers.
CORPUS_EDGES = """
SELECT concat('nation', CAST(c_nationkey AS VARCHAR(9))) AS source, concat('cust', CAST(c_custkey AS VARCHAR(19))) AS target
FROM customer
UNION ALL
SELECT concat('cust', CAST(o_custkey AS VARCHAR(19))), concat('ord', CAST(o_orderkey AS VARCHAR(19)))
FROM orders JOIN customer ON o_custkey = c_custkey
"""

#: Five engines per script; success decided by arithmetic; preference auto, explicit, or unknown.
CANDIDATES = """
SELECT o_orderkey AS script_id,
       CASE o_custkey % 7 WHEN 0 THEN 'druid' WHEN 1 THEN 'nosuch' ELSE 'auto' END AS preference,
       e.engine AS engine, e.engine_rank AS engine_rank,
       (o_orderkey * (e.engine_rank + 3) + o_custkey) % 4 = 0 AS ok,
       CASE WHEN (o_orderkey * (e.engine_rank + 3) + o_custkey) % 4 = 0 THEN ''
            ELSE concat('e', CAST(o_custkey % 5 AS VARCHAR(9))) END AS message
FROM orders CROSS JOIN (VALUES ('datax', 1), ('sqllineage', 2), ('sqlglot', 3), ('druid', 4), ('ai', 5)) AS e(engine, engine_rank)
"""

REQUESTS = """
SELECT o_orderkey AS script_id,
       CASE o_custkey % 6 WHEN 0 THEN 'mysql' WHEN 1 THEN 'hive' WHEN 2 THEN 'spark' WHEN 3 THEN 'db2' WHEN 4 THEN 'nosuch' ELSE NULL END AS dialect,
       CASE o_orderkey % 4 WHEN 0 THEN '  { "job": {} }' WHEN 1 THEN '   ' WHEN 2 THEN 'select 1' ELSE '-- {' END AS text
FROM orders
"""

#: One job per order; the variant is `o_orderkey % 6`: 0 plain, 1 comments and trailing commas, 2 width mismatch, 3 stars and an HDFS reader, 4 `collection` parameter and `{name,type}` columns, 5 no writer table. Expected edges follow from `o_custkey` and the variant alone.
DATAX_JOBS = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 6
  WHEN 0 THEN concat('{"job":{"content":[{"reader":{"name":"postgresqlreader","parameter":{"column":["crew","hours"],"connection":[{"jdbcUrl":["jdbc:postgresql://pg:5432/dock?x=1"],"table":["T', CAST(o_custkey % 50 AS VARCHAR(9)), '"]}]}},"writer":{"name":"clickhousewriter","parameter":{"column":["k","v"],"connection":[{"jdbcUrl":"jdbc:clickhouse://ch:8123/yard","table":["f', CAST(o_custkey % 9 AS VARCHAR(9)), '"]}]}}}]}}')
  WHEN 1 THEN concat('{ /* c */ "job":{"content":[{"reader":{"parameter":{"column":["id","a//b",],"connection":[{"jdbcUrl":["jdbc:mysql://h/dock"],"table":["a', CAST(o_custkey % 50 AS VARCHAR(9)), '","b"],}]}},"writer":{"parameter":{"column":["k","v"],"connection":[{"table":["yard.f"]}]}},},]},}')
  WHEN 2 THEN concat('{"job":{"content":[{"reader":{"parameter":{"column":["a","b","c"],"connection":[{"table":["s.t', CAST(o_custkey % 50 AS VARCHAR(9)), '"]}]}},"writer":{"parameter":{"column":["x"],"connection":[{"table":["d.u"]}]}}}]}}')
  WHEN 3 THEN concat('{"job":{"content":[{"reader":{"parameter":{"path":"/lake/quay.db/o', CAST(o_custkey % 50 AS VARCHAR(9)), '/*","column":["*"]}},"writer":{"parameter":{"column":["*"],"connection":[{"jdbcUrl":["jdbc:db2://z/hold"],"table":["o"]}]}}}]}}')
  WHEN 4 THEN concat('{"job":{"content":[{"reader":{"parameter":{"collection":"m', CAST(o_custkey % 50 AS VARCHAR(9)), '","column":[{"name":"p","type":"string"}]}},"writer":{"parameter":{"index":"es","column":[{"name":"q","type":"string"}]}}}]}}')
  ELSE concat('{"job":{"content":["bad",{"reader":{"parameter":{"column":["a"],"connection":[{"table":["only', CAST(o_custkey % 50 AS VARCHAR(9)), '"]}]}},"writer":{"name":"streamwriter","parameter":{}}}]}}')
END AS text
FROM orders
"""

#: One script per order; the variant is `o_orderkey % 6`: 0 listed target columns and an unnamed expression, 1 a view over a CTE and a second statement, 2 a FROM-subquery, 3 a qualified star, 4 an update, 5 a query.
SQL_SCRIPTS = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 6
  WHEN 0 THEN concat('INSERT INTO fin.book (acct, fee) SELECT b.nr, coalesce(k.rate, 0) * b.vol FROM core.trade', CAST(o_custkey % 50 AS VARCHAR(9)), ' b JOIN core.cost k ON k.nr = b.nr AND k.kind <> ''x;y'' WHERE b.vol > 0')
  WHEN 1 THEN concat('CREATE VIEW web.top AS WITH hits AS (SELECT page, visitor FROM log.raw', CAST(o_custkey % 50 AS VARCHAR(9)), ' WHERE code = 200) SELECT h.page AS url, count(DISTINCT h.visitor) visitors FROM hits h; REPLACE INTO web.seen (who) SELECT visitor FROM log.raw', CAST(o_custkey % 50 AS VARCHAR(9)))
  WHEN 2 THEN concat('INSERT INTO geo.area SELECT z.land, max(z.height) AS peak FROM (SELECT land, height FROM geo.point', CAST(o_custkey % 50 AS VARCHAR(9)), ') z GROUP BY z.land')
  WHEN 3 THEN concat('CREATE TABLE arc.copy AS SELECT p.*, q.note FROM [arc].[live', CAST(o_custkey % 50 AS VARCHAR(9)), '] p LEFT JOIN arc.memo q ON q.id = p.id')
  WHEN 4 THEN concat('UPDATE hr.staff SET desk = d.room, boss = coalesce(d.head, ''none'') FROM hr.desk', CAST(o_custkey % 50 AS VARCHAR(9)), ' d WHERE d.id = staff.id')
  ELSE concat('SELECT t.k, t.v FROM kv.store', CAST(o_custkey % 50 AS VARCHAR(9)), ' AS t LIMIT 9')
END AS text
FROM orders
"""

#: One scope per script; an alias can occur twice (last wins by `pos`).
RELATIONS_FACTS = """
SELECT l_orderkey AS script_id, 1 AS stmt_idx, 1 AS scope_id, concat('a', CAST(l_partkey % 4 AS VARCHAR(9))) AS alias,
       concat('ods.t', CAST(l_suppkey % 20 AS VARCHAR(9))) AS table_name,
       CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS pos
FROM lineitem
"""

REFS_FACTS = """
SELECT l_orderkey AS script_id, 1 AS stmt_idx, 1 AS scope_id, l_linenumber AS pos,
       CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'zz' ELSE concat('A', CAST(l_suppkey % 4 AS VARCHAR(9))) END AS qualifier,
       CASE WHEN l_partkey % 9 = 0 THEN '*' ELSE concat('c', CAST(l_partkey % 6 AS VARCHAR(9))) END AS col
FROM lineitem
"""

#: Hops in `pos` order; `cte1` and `cte3` are to be folded away.
PATH_FACTS = """
SELECT l_orderkey AS script_id, l_orderkey AS path_id,
       CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS pos,
       concat(CASE WHEN l_partkey % 5 IN (1, 3) THEN 'cte' ELSE 't' END, CAST(l_partkey % 5 AS VARCHAR(9))) AS tbl,
       concat('c', CAST(l_suppkey % 3 AS VARCHAR(9))) AS col
FROM lineitem
"""

#: Fenced, bare with surrounding prose, and broken replies.
LLM_REPLIES = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 3
  WHEN 0 THEN concat('ok ```json {"tables":[{"name":" s', CAST(o_custkey % 50 AS VARCHAR(9)), ' ","role":"SOURCE","columns":["a"]},{"name":"t","role":"weird"},{"name":" "}],"table_edges":[{"source":"s","target":"t"}],"column_edges":[]} ``` done')
  WHEN 1 THEN concat('Result: {"tables":[{"name":"u', CAST(o_custkey % 50 AS VARCHAR(9)), '","role":"target"}]} end')
  ELSE 'no json here' END AS text
FROM orders
"""

#: Replies of an external engine: a graph, an error, or a graph without tables.
ENGINE_REPLIES = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 3
  WHEN 0 THEN concat('{"tables":[{"id":"s', CAST(o_custkey % 50 AS VARCHAR(9)), '","role":"source"},{"id":"t","role":"target"}],"table_edges":[{"source":"s', CAST(o_custkey % 50 AS VARCHAR(9)), '","target":"t"}],"column_edges":[{"source_table":"s', CAST(o_custkey % 50 AS VARCHAR(9)), '","source_column":"a","target_table":"t","target_column":"b"}],"warnings":["w', CAST(o_custkey % 7 AS VARCHAR(9)), '"]}')
  WHEN 1 THEN concat('{"error":"e', CAST(o_custkey % 5 AS VARCHAR(9)), '"}')
  ELSE '{"tables":[],"table_edges":[],"column_edges":[],"warnings":[]}' END AS json
FROM orders
"""

#: Outputs of an engine's process: log lines round the reply, or a trace without one.
ENGINE_STDOUT = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 3
  WHEN 0 THEN concat('INFO start\n{"old":1}\nINFO x\n  {"id":', CAST(o_custkey % 50 AS VARCHAR(9)), '}\ndone {"no":1}')
  WHEN 1 THEN concat('Exception ', CAST(o_custkey % 50 AS VARCHAR(9)), '\n at line 1')
  ELSE '{"a":1}' END AS stdout
FROM orders
"""

#: Scripts of very different lengths, a tenth of them beyond the prompt's limit.
LONG_SCRIPTS = """
SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 10 = 0 THEN repeat(concat('select ', CAST(o_custkey % 50 AS VARCHAR(9)), '; '), 900)
       ELSE concat('select ', CAST(o_custkey % 50 AS VARCHAR(9))) END AS text,
       CASE o_custkey % 3 WHEN 0 THEN 'hive' WHEN 1 THEN 'mysql' ELSE NULL END AS dialect
FROM orders
"""

#: Jobs whose readers have queries: a good second one, one with a constant and a scheduler variable, one that is none.
DATAX_QUERY_JOBS = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 3
  WHEN 0 THEN concat('{"job":{"content":[{"reader":{"name":"r","parameter":{"connection":[{"jdbcUrl":["jdbc:oracle:thin:@//h/port"],"querySql":[" ","select b.berth, c.tons * 2 as load from port.berth', CAST(o_custkey % 50 AS VARCHAR(9)), ' b, port.cargo c where c.pier = b.pier"]}]}},"writer":{"name":"hdfswriter","parameter":{"path":"/lake/quay.db/tally/day=1","column":[{"name":"k"},{"name":"v"}]}}}]}}')
  WHEN 1 THEN concat('{"job":{"content":[{"reader":{"parameter":{"querySql":"select a, 1 as one from q', CAST(o_custkey % 50 AS VARCHAR(9)), ' where dt = ''$', '{bizdate}''"}},"writer":{"parameter":{"column":["x","y"],"connection":[{"jdbcUrl":"jdbc:mysql://h/yard","table":"t"}]}}}]}}')
  ELSE concat('{"job":{"content":[{"reader":{"parameter":{"column":["p"],"connection":[{"querySql":["call p()"],"table":["s', CAST(o_custkey % 50 AS VARCHAR(9)), '"]}]}},"writer":{"parameter":{"column":["z"],"connection":[{"table":["w"]}]}}}]}}')
END AS text
FROM orders
"""

#: Statements with nested queries: a union in a subquery, a chain of CTEs, a scalar subquery, a merge.
NESTED_SCRIPTS = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 4
  WHEN 0 THEN concat('INSERT INTO t.u (x) SELECT a.k FROM (SELECT k, w FROM b.c', CAST(o_custkey % 50 AS VARCHAR(9)), ' UNION ALL SELECT k, v FROM b.d) a')
  WHEN 1 THEN concat('WITH a AS (SELECT p, q FROM r.s', CAST(o_custkey % 50 AS VARCHAR(9)), '), b AS (SELECT p AS pp FROM a) INSERT INTO o.o SELECT pp FROM b')
  WHEN 2 THEN concat('INSERT INTO t.v SELECT m.a, (SELECT max(z) FROM s.q', CAST(o_custkey % 50 AS VARCHAR(9)), ') AS mz FROM s.m m')
  ELSE concat('MERGE INTO m.t t USING s.u', CAST(o_custkey % 50 AS VARCHAR(9)), ' s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.b WHEN NOT MATCHED THEN INSERT (id, a) VALUES (s.id, s.c)')
END AS text
FROM orders
"""


#: Statements whose edges are easily lost or invented, by `o_orderkey % 8`: joins in brackets, names in Chinese, quoted names with spaces and reserved
#: words, a backslash before a quote in a dialect without escapes, brackets twenty deep, two targets of one FROM, INSERT ALL, an empty name part.
HARD_SCRIPTS = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 8 WHEN 3 THEN 'db2' WHEN 6 THEN 'oracle' ELSE NULL END AS dialect, CASE o_orderkey % 8
  WHEN 0 THEN concat('INSERT INTO mill.flour SELECT g.kg, d.day FROM ((mill.grain', CAST(o_custkey % 50 AS VARCHAR(9)), ' g JOIN mill.batch b ON b.g = g.g) JOIN mill.day d ON (d.b = b.b))')
  WHEN 1 THEN concat('INSERT INTO 码头.货物 SELECT 重量, v.船 AS 船名 FROM 码头.到港', CAST(o_custkey % 50 AS VARCHAR(9)), ' v')
  WHEN 2 THEN concat('INSERT INTO "Tea House"."Day Sum" ("order", kg) SELECT c."group", c.kg FROM tea.`cup', CAST(o_custkey % 50 AS VARCHAR(9)), ' new` c')
  WHEN 3 THEN concat('INSERT INTO disk.used SELECT ''D:', chr(92), ''' AS root, f.size FROM disk.file', CAST(o_custkey % 50 AS VARCHAR(9)), ' f')
  WHEN 4 THEN concat('INSERT INTO deep.sum SELECT ', repeat('abs(', 20), 'p.n', repeat(')', 20), ' AS n FROM ', repeat('(', 20), 'SELECT n FROM deep.part', CAST(o_custkey % 50 AS VARCHAR(9)), repeat(')', 20), ' p')
  WHEN 5 THEN concat('FROM lake.fish', CAST(o_custkey % 50 AS VARCHAR(9)), ' f JOIN lake.net n ON n.id = f.net INSERT OVERWRITE TABLE lake.caught SELECT f.kind, n.mesh WHERE f.kg > 1 INSERT INTO TABLE lake.freed SELECT f.kind AS species')
  WHEN 6 THEN concat('INSERT ALL INTO bank.debit (acct) VALUES (a) INTO bank.credit (acct, sum) VALUES (b, s) SELECT a, b, s FROM bank.move', CAST(o_custkey % 50 AS VARCHAR(9)))
  ELSE concat('INSERT INTO zoo.cage SELECT x.beast FROM zoo..arrived', CAST(o_custkey % 50 AS VARCHAR(9)), ' x, TABLE(split(x.names)) y')
END AS text
FROM orders
"""

#: A mixed corpus by `o_orderkey % 4`: a job, SQL, text that only another engine has a graph for, a blank script.
MIXED_CORPUS = """
SELECT o_orderkey AS script_id, 'hive' AS dialect, 'auto' AS preference, CASE o_orderkey % 4
  WHEN 0 THEN concat('{"job":{"content":[{"reader":{"parameter":{"column":["p"],"connection":[{"table":["in.t', CAST(o_custkey % 50 AS VARCHAR(9)), '"]}]}},"writer":{"parameter":{"column":["q"],"connection":[{"table":["out.w"]}]}}}]}}')
  WHEN 1 THEN concat('INSERT INTO out.r SELECT b.k, b.j AS l FROM in.s', CAST(o_custkey % 50 AS VARCHAR(9)), ' b')
  WHEN 2 THEN concat('beyond any grammar ', CAST(o_custkey % 50 AS VARCHAR(9)))
  ELSE '  ' END AS text
FROM orders
"""

#: The other engine's replies to it.
MIXED_REPLIES = """
SELECT o_orderkey AS script_id, CASE o_orderkey % 4
  WHEN 2 THEN concat('{"tables":[{"id":"ext.s', CAST(o_custkey % 50 AS VARCHAR(9)), '","role":"source"}],"table_edges":[{"source":"ext.s', CAST(o_custkey % 50 AS VARCHAR(9)), '","target":"ext.t"}],"column_edges":[],"warnings":["w"]}')
  ELSE '{"error":"busy"}' END AS json
FROM orders
"""


#: When a script ran on a table; a third of all runs meet one table.
RUNS = """
SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 3 = 0 THEN 't0' ELSE concat('t', CAST(o_custkey % 20 AS VARCHAR(9))) END AS tbl, o_orderdate AS run_at
FROM orders
"""

#: Versions of the tables' catalogues; several may begin on one day.
VERSIONS = """
SELECT concat('t', CAST(l_suppkey % 25 AS VARCHAR(9))) AS tbl, l_shipdate AS since, l_orderkey * 10 + l_linenumber AS version, l_partkey % 40 AS n_columns
FROM lineitem WHERE l_partkey % 7 = 0
"""

#: Runs with a duration in days, a few of them years long.
SPANS = """
SELECT l_orderkey * 10 + l_linenumber AS run_id, concat('t', CAST(l_partkey AS VARCHAR(9))) AS tbl, l_shipdate AS began,
       CASE WHEN l_orderkey % 50 = 0 THEN 2000 ELSE CAST(l_quantity AS INT) END AS days
FROM lineitem
"""

#: Two versions of a corpus' edges: some dropped, added, moved to another source, or counted twice.
OLD_EDGES = """
SELECT l_orderkey AS script_id, concat('s', CAST(l_partkey AS VARCHAR(9))) AS source, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE concat('t', CAST(l_linenumber AS VARCHAR(9))) END AS target
FROM lineitem WHERE l_suppkey % 5 > 0
"""
NEW_EDGES = """
SELECT l_orderkey AS script_id, concat(CASE WHEN l_suppkey % 7 = 0 THEN 'v' ELSE 's' END, CAST(l_partkey AS VARCHAR(9))) AS source, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE concat('t', CAST(l_linenumber AS VARCHAR(9))) END AS target
FROM lineitem WHERE l_suppkey % 5 < 4
UNION ALL
SELECT l_orderkey, concat('s', CAST(l_partkey AS VARCHAR(9))), concat('t', CAST(l_linenumber AS VARCHAR(9))) FROM lineitem WHERE l_suppkey % 13 = 0 AND l_suppkey % 7 > 0
"""

#: Scripts for an engine that reads comments: readable, unreadable, without a comment, without text, two comments.
DECLARED = """
SELECT o_orderkey AS script_id, 'hive' AS dialect, CASE o_orderkey % 5
  WHEN 0 THEN concat('-- lineage: in.s', CAST(o_custkey % 50 AS VARCHAR(9)), ', in.k -> out.t', chr(10), 'select 1')
  WHEN 1 THEN concat('-- lineage: in.s', CAST(o_custkey % 50 AS VARCHAR(9)))
  WHEN 2 THEN 'select 1'
  WHEN 3 THEN NULL
  ELSE concat('--LINEAGE: a -> b', chr(10), '-- lineage: b -> c', CAST(o_custkey % 50 AS VARCHAR(9))) END AS text
FROM orders
"""

#: What scripts read and write, by engine, dialect and role, with the length of the text; some of each are null.
FACTS = """
SELECT l_orderkey AS script_id,
       CASE l_orderkey % 3 WHEN 0 THEN 'datax' WHEN 1 THEN 'sqlglot' ELSE 'druid' END AS engine,
       CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'hive' WHEN 2 THEN 'mysql' ELSE 'spark' END AS dialect,
       CASE l_linenumber % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'target' ELSE 'intermediate' END AS role,
       CASE WHEN l_partkey % 17 > 0 THEN concat('t', CAST(l_partkey AS VARCHAR(9)), '.', CAST(l_suppkey AS VARCHAR(9))) END AS tbl,
       CASE WHEN l_suppkey % 19 > 0 THEN (l_partkey * l_suppkey - 20000) * l_linenumber END AS n_chars
FROM lineitem
"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the statements above over the tables in ``sf_dir``."""
    for name in TABLES:
        if f" {name}" in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)
