"""Column resolution as joins over flat facts: references to sources, through derived relations down to tables.

Facts carry ``script_id`` and ``stmt_idx``; a derived column's sources are rows ``(scope, pos, name, src_table,
src_scope, src_column)``: either a physical table's column, or a column of another scope that is still to be followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineage_jobs.graph import normalize_graph
from lineage_jobs.runtime import by_text, dealt_out, materialize
from lineage_jobs.sqltext import (
    KEY,
    blocks_without_relation,
    sql_blocks,
    sql_column_refs,
    sql_ctes,
    sql_physical_sources,
    sql_projections,
    sql_read_only_tables,
    sql_relations,
    set_items,
    single_blocks,
    sql_statement_kind,
    sql_statements,
    sql_table_edges,
    sql_targets,
    sql_written_relations,
    subqueries_in,
)

SCOPE = [*KEY, "scope_id"]
REF = [*SCOPE, "pos"]
OUT = [*REF, "src_table", "src_scope", "src_column"]
#: Scopes may be nested so deep, and CTEs build on one another so often, before a loop gives up.
MOST_LEVELS = 200


def scope_visible_aliases(scopes: DataFrame, relations: DataFrame, ctes: DataFrame | None = None) -> DataFrame:
    """``(script_id, stmt_idx, scope_id, alias, kind, table_name, derived_scope_id, distance)``.

    A scope sees its own aliases and its ancestors'; the nearest wins, of equal ones in a scope the last by ``pos``.
    CTE names are the second choice. ``relations`` have alias, kind, table_name, derived_scope_id and pos;
    ``ctes(script_id, stmt_idx, pos, name)`` stand for the scopes ``c<pos>``.
    """
    chain = scopes.select(*SCOPE, F.col("scope_id").alias("at"), F.lit(0).alias("distance"), "parent_scope_id")
    up = scopes.select(*KEY, F.col("scope_id").alias("parent_scope_id"), F.col("parent_scope_id").alias("next"))
    every = chain
    for _ in range(MOST_LEVELS):
        chain = materialize(chain.where("parent_scope_id is not null").join(up, [*KEY, "parent_scope_id"]).select(
            *SCOPE, F.col("parent_scope_id").alias("at"), (F.col("distance") + 1).alias("distance"), F.col("next").alias("parent_scope_id")
        ))
        if chain.isEmpty():
            break
        every = every.unionByName(chain)
    else:
        raise RuntimeError(f"scopes are nested deeper than {MOST_LEVELS}")
    there = relations.select(*KEY, F.col("scope_id").alias("at"), F.lower("alias").alias("alias"), "kind", "table_name", "derived_scope_id", F.col("pos").cast("long").alias("pos"))
    seen = every.join(there, [*KEY, "at"]).select(*SCOPE, "alias", "kind", "table_name", "derived_scope_id", "distance", "pos", F.lit(0).alias("second"))
    if ctes is not None:
        named = ctes.select(
            *KEY, F.lower("name").alias("alias"), F.lit("derived").alias("kind"), F.lit(None).cast("string").alias("table_name"),
            F.concat(F.lit("c"), F.col("pos").cast("string")).alias("derived_scope_id"), F.lit(0).alias("distance"), F.col("pos").cast("long").alias("pos"), F.lit(1).alias("second"),
        )
        seen = seen.unionByName(scopes.select(*SCOPE).join(named, KEY))
    order = Window.partitionBy(*SCOPE, "alias").orderBy("second", "distance", F.col("pos").desc())
    return seen.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "second", "pos")


def resolve_qualified(refs: DataFrame, visible: DataFrame) -> DataFrame:
    """Sources of references ``q.c``: the table's column, or the derived relation's, to be followed. An unknown
    qualifier gives nothing."""
    named = refs.where("qualifier is not null and col <> '*'").withColumn("alias", F.lower("qualifier"))
    return named.join(visible.select(*SCOPE, "alias", "table_name", "derived_scope_id"), [*SCOPE, "alias"]).select(
        *REF, F.col("table_name").alias("src_table"), F.col("derived_scope_id").alias("src_scope"), F.lower("col").alias("src_column")
    )


def resolve_unqualified(refs: DataFrame, visible: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sources of bare columns: those of the scope's derived relations that output the name, else one for each physical relation.

    ``outputs(script_id, stmt_idx, scope_id, name)`` are the output names of scopes.
    """
    near = visible.where("distance = 0").select(*SCOPE, "table_name", "derived_scope_id")
    bare = refs.where("qualifier is null and col <> '*'").withColumn("src_column", F.lower("col"))
    names = outputs.select(*KEY, F.col("scope_id").alias("derived_scope_id"), F.lower("name").alias("src_column")).distinct().withColumn("has", F.lit(True))
    met = bare.join(near, SCOPE).join(names, [*KEY, "derived_scope_id", "src_column"], "left")
    hit = F.max(F.coalesce("has", F.lit(False))).over(Window.partitionBy(*REF, "src_column"))
    chosen = met.withColumn("hit", hit).where(F.when(F.col("hit"), F.coalesce("has", F.lit(False))).otherwise(F.col("table_name").isNotNull()))
    return chosen.select(*REF, F.col("table_name").alias("src_table"), F.col("derived_scope_id").alias("src_scope"), "src_column")


def resolve_star(refs: DataFrame, visible: DataFrame) -> DataFrame:
    """Sources of ``*`` and ``q.*``: ``*`` of each physical relation, all output columns of each derived one."""
    stars = refs.where("col = '*'").withColumn("want", F.lower("qualifier"))
    near = visible.select(*SCOPE, "alias", "table_name", "derived_scope_id", "distance")
    return (
        stars.join(near, SCOPE)
        .where("(want is null and distance = 0) or want = alias")
        .select(*REF, F.col("table_name").alias("src_table"), F.col("derived_scope_id").alias("src_scope"), F.lit("*").alias("src_column"))
    )


def with_ctes(relations: DataFrame, ctes: DataFrame) -> DataFrame:
    """``relations`` in which a physical name that is a CTE's stands for the CTE's scope."""
    named = ctes.select(*KEY, F.col("name").alias("table_name"), F.concat(F.lit("c"), F.col("pos").cast("string")).alias("cte_scope"))
    return (
        relations.join(named.dropDuplicates([*KEY, "table_name"]), [*KEY, "table_name"], "left")
        # a CTE doesn't see itself: there the name is a table's
        .withColumn("cte_scope", F.when(~(F.col("scope_id") == F.col("cte_scope")) & ~F.startswith(F.col("scope_id"), F.concat("cte_scope", F.lit("."))), F.col("cte_scope")))
        .withColumn("derived_scope_id", F.coalesce("cte_scope", "derived_scope_id"))
        .withColumn("table_name", F.when(F.col("cte_scope").isNull(), F.col("table_name")))
        .withColumn("kind", F.when(F.col("cte_scope").isNotNull(), "derived").otherwise(F.col("kind")))
        .drop("cte_scope")
    )


def base_tables(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, scope_id, table_name)``: the physical tables below each scope."""
    branches = blocks.where("kind = 'branch'").select(*KEY, F.col("parent_scope_id").alias("scope_id"), F.col("scope_id").alias("below"))
    steps = relations.where("derived_scope_id is not null").select(*SCOPE, F.col("derived_scope_id").alias("below")).unionByName(branches).distinct()
    found = relations.where("table_name is not null").select(*SCOPE, "table_name").distinct()
    front = materialize(found)
    total = front
    for _ in range(MOST_LEVELS):
        up = steps.join(front.withColumnRenamed("scope_id", "below"), [*KEY, "below"]).select(*SCOPE, "table_name").distinct()
        front = materialize(up.join(total, [*SCOPE, "table_name"], "left_anti"))
        if front.isEmpty():
            return total
        total = total.unionByName(front)
    raise RuntimeError(f"scopes are nested deeper than {MOST_LEVELS}")


def resolve_derived_missing(wanted: DataFrame, outputs: DataFrame, bases: DataFrame) -> DataFrame:
    """Sources of columns that a derived relation lacks: the same name in all its base tables.

    ``wanted`` rows have ``src_scope`` and ``src_column``; those that ``outputs`` has are left out.
    """
    names = outputs.select(*KEY, F.col("scope_id").alias("src_scope"), F.lower("name").alias("src_column")).distinct()
    lacking = wanted.where("src_scope is not null and src_column <> '*'").join(names, [*KEY, "src_scope", "src_column"], "left_anti")
    below = bases.select(*KEY, F.col("scope_id").alias("src_scope"), F.col("table_name").alias("src_table"))
    return lacking.drop("src_table").join(below, [*KEY, "src_scope"]).withColumn("src_scope", F.lit(None).cast("string"))


def expression_sources(sources: DataFrame, projections: DataFrame) -> DataFrame:
    """``(scope, pos, name, src_table, src_scope, src_column)``: the distinct sources of each output column."""
    return projections.select(*REF, "name").join(sources.select(*OUT).distinct(), REF)


def scalar_subquery_sources(projections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sources of expressions with scalar subqueries: all output columns of those.

    The n-th subquery of a block's select list belongs to the expression in which the n-th one stands.
    """
    count = subqueries_in("expr")
    before = Window.partitionBy(*SCOPE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = projections.withColumn("n", count).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")
    each = placed.select(*REF, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("k"))
    scopes = blocks.where("kind = 'scalar'").select(*KEY, F.col("scope_id").alias("src_scope"))
    return (
        each.withColumn("src_scope", F.concat("scope_id", F.lit(".s"), F.col("k").cast("string")))
        .join(scopes, [*KEY, "src_scope"])
        .select(*REF, F.lit(None).cast("string").alias("src_table"), "src_scope", F.lit("*").alias("src_column"))
    )


def union_merge(derived: DataFrame, blocks: DataFrame) -> DataFrame:
    """Output columns of set operations from those of their branches, matched by name.

    A name takes the place of its first occurrence by branch and place; all branches' columns of the name are its sources.
    ``derived`` has a row for each output column: ``(scope, pos, name)``.
    """
    branch = blocks.where("kind = 'branch'").select(*KEY, "scope_id", F.col("parent_scope_id").alias("union_id"))
    rows = derived.join(branch, SCOPE).withColumn("nth", F.regexp_extract("scope_id", r"(\d+)$", 1).cast("int"))
    first = rows.groupBy(*KEY, "union_id", F.lower("name").alias("k")).agg(F.min(F.struct("nth", "pos", "name")).alias("x"))
    order = Window.partitionBy(*KEY, "union_id").orderBy("x.nth", "x.pos")
    placed = first.withColumn("at", F.row_number().over(order))
    return rows.withColumn("k", F.lower("name")).join(placed, [*KEY, "union_id", "k"]).select(
        *KEY, F.col("union_id").alias("scope_id"), F.col("at").alias("pos"), F.col("x.name").alias("name"),
        F.lit(None).cast("string").alias("src_table"), F.col("scope_id").alias("src_scope"), F.col("k").alias("src_column"),
    )


def derived_passthrough(sources: DataFrame, outputs: DataFrame, bases: DataFrame) -> DataFrame:
    """``sources`` in which every source is a physical table's column.

    Each round replaces references to other scopes by what those scopes' output columns come from; a star takes all of
    them, a name that a scope lacks its base tables' columns of that name. ``outputs(scope, pos, name)`` has also
    columns without sources. The rounds are as many as the scopes are deep.
    """
    names = outputs.select(*SCOPE, "pos", F.lower("name").alias("name")).distinct()
    done = sources.where("src_scope is null").select(*OUT).distinct()
    open_ = materialize(sources.where("src_scope is not null").select(*OUT).distinct())
    steps = (
        sources.select(*OUT)
        .join(names, REF)
        .select(*KEY, F.col("scope_id").alias("src_scope"), F.col("name").alias("src_name"), F.col("src_table").alias("t"), F.col("src_scope").alias("s"), F.col("src_column").alias("c"))
        .distinct()
    )
    steps = materialize(steps)
    for _ in range(MOST_LEVELS):
        if open_.isEmpty():
            return done
        followed = (
            open_.join(steps, [*KEY, "src_scope"])
            .where("src_column = '*' or src_column = src_name or src_name = '*'")
            # a star below stands for the name that was asked for, in its own table
            .withColumn("c", F.when((F.col("src_name") == "*") & (F.col("src_column") != "*") & (F.col("c") == "*"), F.col("src_column")).otherwise(F.col("c")))
            .select(*REF, F.col("t").alias("src_table"), F.col("s").alias("src_scope"), F.col("c").alias("src_column"))
        )
        stars = names.where("name = '*'").select(*KEY, F.col("scope_id").alias("src_scope")).distinct()
        missing = resolve_derived_missing(open_.join(stars, [*KEY, "src_scope"], "left_anti"), names, bases).select(*OUT)
        following = materialize(followed.unionByName(missing).distinct())
        done = done.unionByName(following.where("src_scope is null"))
        open_ = materialize(following.where("src_scope is not null"))
    raise RuntimeError(f"scopes are nested deeper than {MOST_LEVELS}")


def insert_column_rename(derived: DataFrame, targets: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, pos, source_table, source_column, target_table, target_column)`` of the main queries, those of each target.

    Output column i goes to the i-th listed target column, or to its own name where none is listed.
    """
    written = targets.where("kind in ('insert', 'create')").select(*SCOPE, F.col("table_name").alias("target_table"), "cols")
    return derived.join(written, SCOPE).select(
        *KEY, "pos", F.col("src_table").alias("source_table"), F.col("src_column").alias("source_column"), "target_table",
        F.coalesce(F.get("cols", F.col("pos") - 1), F.col("name")).alias("target_column"),
    )


def _assigned(items: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Column edges of assignments from the sources of their expressions; edges of the target to itself go."""
    written = targets.select(*KEY, F.col("table_name").alias("target_table"))
    return (
        items.select(*KEY, F.concat(F.lit("w"), F.lit("."), "arm").alias("scope_id"), "pos", "column")
        .join(sources.select(*REF, "src_table", "src_column"), REF)
        .join(written, KEY)
        .where("src_table <> target_table")
        .select(*KEY, "pos", F.col("src_table").alias("source_table"), F.col("src_column").alias("source_column"), "target_table", F.col("column").alias("target_column"))
        .distinct()
    )


def update_edges(set_items: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Column edges of ``SET c = expr`` of UPDATE statements: the sources of the expression to the target's column."""
    return _assigned(set_items.where("arm = 'update'"), sources, targets.where("kind = 'update'"))


def merge_edges(set_items: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column edges of both arms of MERGE statements, and a warning ``approximate`` for each."""
    merges = targets.where("kind = 'merge'")
    edges = _assigned(set_items.where("arm <> 'update'"), sources, merges).drop("pos").distinct().withColumn("pos", F.lit(0))
    return edges.select(*KEY, "pos", "source_table", "source_column", "target_table", "target_column"), merges.select(*KEY, F.lit("approximate").alias("code"))


def cte_path_fold(paths: DataFrame, ctes: DataFrame) -> DataFrame:
    """``(script_id, path_id, source_table, source_column, target_table, target_column)`` of column paths without their CTE hops.

    ``paths(script_id, path_id, pos, tbl, col)``; ``ctes(script_id, name)`` hold for the whole script. Pairs of what
    then are neighbours are the edges.
    """
    left = paths.join(ctes.select("script_id", F.col("name").alias("tbl")).distinct(), ["script_id", "tbl"], "left_anti")
    order = Window.partitionBy("script_id", "path_id").orderBy("pos")
    return left.withColumn("next", F.lead(F.struct("tbl", "col")).over(order)).where("next is not null").select(
        "script_id", "path_id", F.col("tbl").alias("source_table"), F.col("col").alias("source_column"),
        F.col("next.tbl").alias("target_table"), F.col("next.col").alias("target_column"),
    )


def no_column_lineage_warning(tables: DataFrame, column_edges: DataFrame) -> DataFrame:
    """``(script_id, code)``: scripts with tables but without a column edge."""
    return tables.select("script_id").distinct().join(column_edges.select("script_id").distinct(), "script_id", "left_anti").withColumn("code", F.lit("no_column_lineage"))


def statement_facts(statements: DataFrame) -> dict[str, DataFrame]:
    """All facts of mined statements with ``kind``: targets, ctes, blocks, relations, outputs, sources, derived.

    ``derived`` has ``(scope, pos, name, src_table, src_column)`` with physical sources only; ``outputs`` every output column.
    """
    usable = statements.where("not needs_parser")
    ctes = materialize(sql_ctes(usable))
    written_relations = materialize(sql_written_relations(usable))
    none = F.lit(None).cast("string")
    using = written_relations.where("kind = 'derived'").select(
        *KEY, F.col("derived_scope_id").alias("scope_id"), none.alias("parent_scope_id"), F.lit("derived").alias("kind"),
        F.col("sub_body").alias("body"),
    )
    items = materialize(set_items(usable))
    nth = F.row_number().over(Window.partitionBy(*KEY, "arm").orderBy("pos", "k")) - 1
    arm_scope = F.concat(F.lit("w."), "arm")
    asked = items.select(*KEY, "arm", "pos", F.posexplode("asked").alias("k", "body")).select(
        *KEY, F.concat(arm_scope, F.lit(".s"), nth.cast("string")).alias("scope_id"), arm_scope.alias("parent_scope_id"), F.lit("scalar").alias("kind"), "body"
    )
    blocks = materialize(sql_blocks(usable, ctes, using.unionByName(asked)))
    single = materialize(single_blocks(blocks))
    raw = sql_relations(single).unionByName(written_relations.drop("sub_body"))
    relations = materialize(with_ctes(raw, ctes))
    targets = sql_targets(usable)
    selected = sql_projections(single)
    assigned = items.select(*KEY, F.concat(F.lit("w."), "arm").alias("scope_id"), "pos", F.col("column").alias("name"), "expr")
    projections = materialize(selected.unionByName(assigned))
    arms = assigned.select(*KEY, "scope_id", F.lit("w").alias("parent_scope_id")).distinct()
    scopes = (
        blocks.select(*KEY, "scope_id", "parent_scope_id")
        .unionByName(arms)
        .unionByName(arms.select(*KEY, F.lit("w").alias("scope_id"), none.alias("parent_scope_id")).distinct())
    )
    visible = materialize(scope_visible_aliases(scopes, relations))
    refs = materialize(sql_column_refs(projections))
    own = projections.select(*REF, "name")
    unions = union_merge(own, blocks)
    unions = materialize(unions)
    outputs = own.unionByName(unions.select(*REF, "name").distinct())
    # an assignment sees the relations of its statement as its own
    shown = visible.withColumn("distance", F.when(F.col("scope_id").rlike(r"^w\.[a-z_]+$"), 0).otherwise(F.col("distance")))
    sources = materialize(
        resolve_qualified(refs, visible)
        .unionByName(resolve_unqualified(refs, shown, outputs))
        .unionByName(resolve_star(refs, shown))
        .unionByName(scalar_subquery_sources(projections, blocks))
        .unionByName(unions.select(*OUT))
        .distinct()
    )
    bases = materialize(base_tables(relations, blocks))
    derived = derived_passthrough(sources, outputs, bases)
    return {
        "ctes": ctes, "blocks": blocks, "relations": relations, "targets": targets, "set_items": items, "projections": projections,
        "refs": refs, "visible": visible, "outputs": outputs, "unread": blocks_without_relation(single), "sources": derived.where("src_table is not null"), "bases": bases,
        "derived": outputs.join(derived.where("src_table is not null"), REF).select(*REF, "name", "src_table", "src_column").distinct(),
    }


def query_outputs(queries: DataFrame) -> DataFrame:
    """``(script_id, content_idx, query_pos, pos, name, sources, tables)`` of the analysed readers' queries.

    ``queries(script_id, content_idx, query_pos, sql)``; ``pos`` counts from 0; ``sources`` are structs of table and column; ``tables``
    the query's physical tables. A query that isn't a SELECT with output columns gives no row. Equal queries are mined once.
    """
    place = F.struct("script_id", "content_idx", "query_pos").alias("script_id")
    found = by_text(queries.select(place, "sql"), lambda texts: {"outputs": _query_outputs(texts)}, ["sql"])["outputs"]
    return found.select("script_id.*", "pos", "name", "sources", "tables")


def _query_outputs(queries: DataFrame) -> DataFrame:
    """``(script_id, pos, name, sources, tables)`` of queries ``(script_id, sql)`` each of which is mined."""
    keyed = dealt_out(queries).withColumn("stmt_idx", F.lit(1))
    statements = materialize(sql_statement_kind(keyed.select(*KEY, "sql")).where("kind = 'select'"))
    facts = statement_facts(statements)
    sources = facts["derived"].where("scope_id = 'm'").groupBy(*KEY, "pos").agg(F.sort_array(F.collect_set(F.struct("src_table", "src_column"))).alias("sources"))
    tables = facts["bases"].where("scope_id = 'm'").groupBy(*KEY).agg(F.sort_array(F.collect_set("table_name")).alias("tables"))
    outputs = facts["outputs"].where("scope_id = 'm'").select(*KEY, "pos", "name").distinct()
    return (
        outputs.join(sources, [*KEY, "pos"], "left")
        .join(tables, KEY, "left")
        .select(
            "script_id", (F.col("pos") - 1).cast("int").alias("pos"), "name",
            F.coalesce("sources", F.array().cast("array<struct<src_table:string,src_column:string>>")).alias("sources"),
            F.coalesce("tables", F.array().cast("array<string>")).alias("tables"),
        )
    )


def sql_edges(statements: DataFrame) -> dict[str, DataFrame]:
    """Raw tables with roles, table edges and column edges of mined statements, by statement, and warnings."""
    facts = statement_facts(statements)
    targets = materialize(facts["targets"])
    sources = materialize(sql_physical_sources(facts["relations"].where("table_name is not null"), facts["ctes"], by_root=True))
    merged, approximate = merge_edges(facts["set_items"], facts["sources"], targets)
    columns = (
        insert_column_rename(facts["derived"], targets)
        .unionByName(update_edges(facts["set_items"], facts["sources"], targets))
        .unionByName(merged)
    )
    edges, columns = materialize(sql_table_edges(sources, targets)), materialize(columns)
    written = targets.select(*KEY, F.col("table_name").alias("id"), F.lit("target").alias("role"))
    own = targets.select(*KEY, F.col("table_name").alias("own"), "kind", F.col("scope_id").alias("fed"))
    met = sources.join(own, KEY).where("table_name <> own and (kind = 'delete' or root is null or root = fed)")
    read = met.select(*KEY, F.col("table_name").alias("id"), F.lit("source").alias("role")).distinct()
    unread = statements.where("needs_parser").select(*KEY).unionByName(facts["unread"]).distinct()
    return {
        "tables": sql_read_only_tables(statements, sources).unionByName(written).unionByName(read),
        "table_edges": edges,
        "column_edges": columns,
        "warnings": approximate.unionByName(unread.select(*KEY, F.lit("needs_parser").alias("code"))).unionByName(
            edges.select(*KEY).distinct().join(columns.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit("no_column_lineage").alias("code"))
        ),
    }


def sql_lineage(scripts: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """The normalised graph tables of a corpus of SQL scripts, with ``warnings`` and ``attempts``.

    Statements whose brackets don't balance, whose written table isn't found or that write in an unknown form are left out, and these and
    blocks whose FROM clause can't be read are named ``needs_parser`` in the warnings; those with table edges but no column edge
    are named ``no_column_lineage``. A script from which no table comes, or of which a statement needs a parser, is a failed
    attempt, so that another engine is tried; what was found in it stays. Scripts with the same text are mined once.
    """
    return by_text(scripts, lambda texts: _sql_lineage(texts, strict))


def _sql_lineage(scripts: DataFrame, strict: bool) -> dict[str, DataFrame]:
    """:func:`sql_lineage` of scripts each of which is mined."""
    statements = materialize(sql_statement_kind(sql_statements(dealt_out(scripts))))
    raw = sql_edges(statements)
    seq = F.col("stmt_idx").cast("long") * 1_000_000
    declared = raw["tables"].select("script_id", "id", "role", F.array().cast("array<string>").alias("columns"), seq.alias("seq"))
    graph = normalize_graph(
        declared,
        raw["table_edges"].select("script_id", "source", "target", seq.alias("seq")),
        raw["column_edges"].select("script_id", "source_table", "source_column", "target_table", "target_column", (seq + F.col("pos")).alias("seq")),
        strict,
    )
    warnings = materialize(raw["warnings"])
    some = raw["tables"].select("script_id").distinct().withColumn("some", F.lit(True))
    lost = warnings.where("code = 'needs_parser'").select("script_id").distinct().withColumn("lost", F.lit(True))
    message = F.when(F.col("some").isNull(), "no table found").when(F.col("lost"), "a statement needs a parser").otherwise("")
    attempts = scripts.select("script_id").join(some, "script_id", "left").join(lost, "script_id", "left").select("script_id", (message == "").alias("ok"), message.alias("message"))
    return graph | {"warnings": warnings, "attempts": attempts}
