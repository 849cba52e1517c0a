"""Mining of SQL text into flat facts: statements, targets, blocks, relations, columns.

Three steps, all of built-in functions, come before any pattern looks at a statement:

* :func:`masked` empties literals by the rules of the script's dialect and turns quoted names that aren't plain words into marks that hold
  the name, so that reserved words, spaces and dots in them can't be taken for syntax;
* :func:`folded` replaces brackets, however deep, by numbered marks of their contents, innermost first. What is left is
  flat: a clause ends at a keyword, an item at a comma. Marks of queries and of other brackets differ;
* FROM items that are brackets themselves are unwrapped level by level (:func:`from_items`).

Only text whose brackets don't balance, or whose form isn't known, is flagged. Names are lower-cased.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize, strip
from lineage_jobs.schemas import BACKSLASH_DIALECTS, QUOTED_TEXT_DIALECTS, STANDARD_DIALECTS

#: Marks: a quoted name stands between the first two as hex digits; a bracket's number between the third or, of a query, the fourth, and the last.
NAMED, NAMED_END, GROUP, QUERY, MARK_END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
COMMENT = r"--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
#: Literals in which a backslash escapes, and in which it doesn't.
LITERAL, PLAIN_LITERAL = r"'(?:[^'\\]++|\\.|'')*+'", r"'(?:[^']++|'')*+'"
TEXT = r'"(?:[^"\\]++|\\.|"")*+"'
QUOTED = r'"(?:[^"]++|"")*+"'
TICKED = r"`[^`]*+`"
BRACKETED = rf"(?<![\w\])`\"{NAMED_END}])\[[^\[\],'\"]++\]"
WORD = rf"(?:[\w$]++|{NAMED}[0-9A-F]*+{NAMED_END})"
#: A name that can't start with a digit.
ID = rf"(?:[\p{{L}}_$][\w$]*+|{NAMED}[0-9A-F]*+{NAMED_END})"
DOT = r"\s*+\.\s*+(?:\.\s*+)*+"
NAME = rf"{WORD}(?:{DOT}{WORD})*+"
PLAIN_GROUP, QUERY_GROUP = rf"{GROUP}(\d++){MARK_END}", rf"{QUERY}(\d++){MARK_END}"
ANY_GROUP = rf"[{GROUP}{QUERY}]\d++{MARK_END}"
CTE = rf"{WORD}\s*+(?:{ANY_GROUP}\s*+)?AS\s*+(?:(?:NOT\s++)?MATERIALIZED\s*+)?{ANY_GROUP}"
WITH = rf"(?iU)\bWITH\s++(?:RECURSIVE\s++)?{CTE}(?:\s*+,\s*+{CTE})*+"
SETS = "UNION|INTERSECT|EXCEPT|MINUS"
#: What the brackets of a query start with.
STARTS_QUERY = rf"(?iU)^\s*+(?:(?:SELECT|WITH)\b|{QUERY}\d++{MARK_END}\s*+(?:{SETS})\b)"
#: What can't be an alias or a column.
KEYWORDS = (
    "select from where group by having order limit offset union all intersect except minus distinct as on using and or not in is null "
    "like rlike between exists case when then else end join left right inner outer full cross natural lateral set values into over "
    "partition rows range unbounded preceding following current row asc desc interval true false cast date timestamp window qualify "
    "returning escape nulls first last filter within"
).split()
#: What else can't be the alias of a relation.
FROM_KEYWORDS = "with table tablesample pivot unpivot for use force ignore final prewhere anti semi asof positional insert fetch connect start cluster distribute sort when".split()
NOT_KEYWORD = rf"(?!(?:{'|'.join(KEYWORDS)})\b)"
NOT_IN_FROM = rf"(?!(?:{'|'.join(KEYWORDS + FROM_KEYWORDS)})\b)"
#: What can't be a table; words such as date or first can.
NOT_TABLE = r"(?!(?:select|values|from|where|set|with|into|overwrite|using|on|lateral|join|left|right|full|inner|outer|cross|natural|group|order|limit|union)\b)"
#: Query blocks may be nested so deep before the loop gives up with an error.
MOST_LEVELS = 200
KEY = ["script_id", "stmt_idx"]


def until(stops: str) -> str:
    """Text up to one of the words ``stops``, in folded text."""
    return rf"(?:(?!\b(?:{stops})\b).)*+"


# -- masking ---------------------------------------------------------------------------------------------------


def _lexed(text: str, dialect: str | None, work):
    """``work(literals, names)`` with the patterns of a dialect's literals and quoted names, for the column ``text``.

    Where no dialect is known, a backslash escapes unless quotes then don't balance, and double quotes hold names.
    """
    rest = F.regexp_replace(text, rf"(?s){COMMENT}|{LITERAL}|{QUOTED}|{TICKED}", "")
    unknown = F.when(F.contains(rest, F.lit("'")), work(PLAIN_LITERAL, f"{QUOTED}|{TICKED}")).otherwise(work(LITERAL, f"{QUOTED}|{TICKED}"))
    if dialect is None:
        return unknown
    key = F.lower(F.col(dialect))
    return (
        F.when(key.isin(QUOTED_TEXT_DIALECTS), work(f"{LITERAL}|{TEXT}", TICKED))
        .when(key.isin(BACKSLASH_DIALECTS), work(LITERAL, f"{QUOTED}|{TICKED}"))
        .when(key.isin(STANDARD_DIALECTS), work(PLAIN_LITERAL, f"{QUOTED}|{TICKED}"))
        .otherwise(unknown)
    )


def _stitched(pieces, between):
    """The pieces of a split text with what now stands between them."""
    return F.array_join(F.zip_with(pieces, between, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def _name_mark(quoted):
    """A quoted name as it can stand in the text: bare if it is plain words, else as a mark."""
    name = F.regexp_replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), '""', '"')
    plain = name.rlike(rf"(?iU)^(?!(?:{'|'.join(KEYWORDS + FROM_KEYWORDS)})$)[\w$]++(?:\.[\w$]++)*+$")
    return F.when(plain, name).otherwise(F.concat(F.lit(NAMED), F.hex(F.encode(name, "UTF-8")), F.lit(NAMED_END)))


def masked(text: str, dialect: str | None = None):
    """The column ``text`` without comments, with empty literals, and with quoted names bare or as marks; single spaces."""

    def work(literals, names):
        any_token = rf"(?s){COMMENT}|{literals}|{names}|{BRACKETED}"
        found = F.transform(
            F.regexp_extract_all(text, F.lit(any_token), F.lit(0)),
            lambda t: F.when(t.rlike(r"^(?:--|/\*)"), " ").when(t.rlike(rf"(?s)^(?:{literals})$"), "''").otherwise(_name_mark(t)),
        )
        return _stitched(F.split(text, any_token, -1), found)

    return strip(F.regexp_replace(_lexed(text, dialect, work), r"\s++", " "))


def unmasked(name):
    """A name in which marks are the quoted names again."""
    parts = F.transform(
        F.split(name, NAMED, -1),
        lambda p, k: F.when(k == 0, p).otherwise(
            F.concat(F.decode(F.unhex(F.substring_index(p, NAMED_END, 1)), "UTF-8"), F.substring_index(p, NAMED_END, -1))
        ),
    )
    return F.when(F.contains(name, F.lit(NAMED)), F.array_join(parts, "")).otherwise(name)


def _squeeze(name):
    """A qualified name in lower case, without spaces round its dots and without empty parts."""
    return F.lower(unmasked(F.regexp_replace(name, DOT, ".")))


# -- folding ---------------------------------------------------------------------------------------------------


def _depth(text):
    """How deep the brackets of a text go; null if they don't balance."""
    steps = F.transform(F.split(F.regexp_replace(text, "[^()]++", ""), ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("least"))
    gone = lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most"), F.least(s["least"], s["now"] + d).alias("least"))
    return F.aggregate(steps, start, gone, lambda s: F.when((s["now"] == 0) & (s["least"] == 0), s["most"]))


def _rounds(depth):
    """An array with an item for each level."""
    return F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))


def folded(text):
    """``(code, groups, depth)``: a text whose brackets are marks, and the contents of the brackets, innermost first.

    A bracket round nothing but another query is that query. Null if brackets don't balance.
    """
    pair = r"\(([^()]*+)\)"
    depth = _depth(text)
    start = F.struct(text.alias("code"), F.array().cast("array<string>").alias("groups"))

    def inner(state, _):
        found = F.regexp_extract_all(state["code"], F.lit(pair), F.lit(1))
        first = F.size(state["groups"])
        number = lambda k: F.concat((first + k).cast("string"), F.lit(MARK_END))
        marks = F.transform(
            found,
            lambda g, k: F.when(g.rlike(rf"^\s*+{QUERY}\d++{MARK_END}\s*+$"), F.concat(F.lit(" "), F.trim(g), F.lit(" "))).otherwise(
                F.concat(F.lit(" "), F.when(g.rlike(STARTS_QUERY), QUERY).otherwise(GROUP), number(k), F.lit(" "))
            ),
        )
        return F.struct(_stitched(F.split(state["code"], pair, -1), marks).alias("code"), F.concat(state["groups"], found).alias("groups"))

    return F.aggregate(_rounds(depth), start, inner, lambda s: F.when(depth.isNotNull(), F.struct(s["code"].alias("code"), s["groups"].alias("groups"), depth.alias("depth"))))


def unfolded(code, fold, queries: bool = True):
    """Folded text with its brackets again; ``queries=False`` leaves the marks of queries."""
    mark = rf" ?[{GROUP}{QUERY if queries else ''}](\d++){MARK_END} ?"

    def outer(text, _):
        inside = F.transform(F.regexp_extract_all(text, F.lit(mark), F.lit(1)), lambda n: F.concat(F.lit("("), F.get(fold["groups"], n.cast("int")), F.lit(")")))
        return _stitched(F.split(text, mark, -1), inside)

    return F.aggregate(_rounds(fold["depth"]), code, outer)


def content(mark, fold):
    """What stands in the brackets of a mark, folded."""
    return F.get(fold["groups"], F.regexp_extract(mark, r"(\d++)", 1).cast("int"))


def inside(mark, fold):
    """What stands in the brackets of a mark, as text."""
    return strip(unfolded(content(mark, fold), fold))


def with_fold(rows: DataFrame, text: str, out: str = "fold") -> DataFrame:
    """``rows`` with :func:`folded` of a column, computed once."""
    return rows.withColumn(out, F.explode(F.array(folded(F.col(text)))))


# -- statements ------------------------------------------------------------------------------------------------


def sql_statements(scripts: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, sql)``: the statements of each script, from 1; a semicolon in a literal, a quoted name or a comment
    ends none, and statements without code are dropped. Scripts with a ``dialect`` hand it on."""
    kept = [c for c in ("dialect",) if c in scripts.columns]

    def work(literals, names):
        part = rf"(?s)(?:[^;'\"`/-]++|{COMMENT}|{literals}|{names}|[-/'\"`])++"
        some = lambda s: strip(F.regexp_replace(s, rf"(?s)({literals})|{COMMENT}", "$1")) != ""
        return F.filter(F.transform(F.regexp_extract_all("text", F.lit(part), F.lit(0)), lambda s: strip(s)), some)

    found = _lexed("text", "dialect" if kept else None, work)
    return scripts.select("script_id", *kept, F.posexplode(found).alias("pos", "sql")).select("script_id", (F.col("pos") + 1).alias("stmt_idx"), "sql", *kept)


def mined(statements: DataFrame) -> DataFrame:
    """``statements`` with ``fold`` (of what is left without CTEs), ``code``, ``ctes``, ``main`` (the code without its CTEs) and ``needs_parser`` (brackets don't balance).

    ``ctes`` are structs of name and body; those of nested queries come before those of the statement.
    """
    coded = statements.withColumn("code", F.explode(F.array(masked("sql", "dialect" if "dialect" in statements.columns else None))))
    rows = with_fold(coded, "code", "raw_fold")
    fold = F.col("raw_fold")
    texts = F.concat(fold["groups"], F.array(fold["code"]))
    items = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.regexp_extract(t, WITH, 0), F.lit(f"(?iU){CTE}"), F.lit(0))))
    bare = F.struct(
        strip(F.regexp_replace(fold["code"], WITH, " ")).alias("code"),
        F.transform(fold["groups"], lambda g: F.regexp_replace(g, WITH, " ")).alias("groups"),
        fold["depth"].alias("depth"),
    )
    rows = rows.withColumn("items", items).withColumn("fold", F.explode(F.array(F.when(fold.isNotNull(), bare))))
    found = F.transform(
        F.filter("items", lambda i: i != ""),
        lambda i: F.struct(
            F.lower(unmasked(F.regexp_extract(i, rf"(?iU)^({WORD})", 1))).alias("name"),
            inside(F.regexp_extract(i, rf"({ANY_GROUP})$", 1), F.col("fold")).alias("body"),
        ),
    )
    none = F.array().cast("array<struct<name:string,body:string>>")
    return (
        rows.withColumn("ctes", F.coalesce(found, none))
        .withColumn("main", F.coalesce(strip(F.regexp_replace(unfolded(F.col("fold")["code"], F.col("fold")), r"\s++", " ")), F.col("code")))
        .withColumn("needs_parser", fold.isNull())
        .drop("items", "raw_fold")
    )


def statement_kind(main):
    """The kind of a statement by its first words."""
    starts = lambda p: main.rlike(rf"(?i)^\(*\s*+{p}")
    return (
        F.when(starts(r"(?:INSERT|REPLACE\s++INTO|COPY\s++INTO)\b"), "insert")
        .when(starts(r"CREATE\b(?:(?!\b(?:TABLE|VIEW)\b)[^(])*+\b(?:TABLE|VIEW)\b"), "create")
        .when(starts(r"UPDATE\b"), "update")
        .when(starts(r"MERGE\b"), "merge")
        .when(starts(r"DELETE\b"), "delete")
        .when(starts(r"SELECT\b"), "select")
        .when(starts(r"(?:SET|USE|DROP|ALTER|TRUNCATE|GRANT|REVOKE|SHOW|DESCRIBE|EXPLAIN|ANALYZE|REFRESH|MSCK|ADD|CACHE|COMMIT|BEGIN|ROLLBACK|CALL|CREATE)\b"), "command")
        .otherwise("other")
    )


FROM_FIRST = rf"(?isU)^FROM\b\s*+({until('INSERT|SELECT')})"
FROM_ARM = rf"(?isU)\b(INSERT\b{until('INSERT|SELECT')})(SELECT\b{until('INSERT|WHERE|GROUP|HAVING|ORDER|LIMIT|CLUSTER|DISTRIBUTE|SORT|WINDOW|QUALIFY|LATERAL')})({until('INSERT')})"
FROM_QUERY = rf"(?isU)(SELECT\b{until('WHERE|GROUP|HAVING|ORDER|LIMIT|CLUSTER|DISTRIBUTE|SORT|WINDOW|QUALIFY|LATERAL')})(.*+)$"
ALL_ARM = rf"(?isU)\bINTO\s++{NOT_TABLE}({NAME})\s*+({GROUP}\d++{MARK_END})?+\s*+(?:VALUES\s*+({ANY_GROUP}))?+"
SELECT_INTO = rf"(?isU)^(SELECT\b{until('INTO|FROM')})\bINTO\s++(?:(?:TEMPORARY|TEMP|UNLOGGED)\s++)?+(?:TABLE\s++)?+({NAME})\s++(FROM\b.*+)$"
VALUES_ROWS = rf"(?isU)\bVALUES\s*+({ANY_GROUP}(?:\s*+,\s*+{ANY_GROUP})*+)"
BODY = rf"(?isU)(?:\bSELECT\b|{QUERY}).*+$"


def _writes(kind, fold):
    """The arms of a statement: structs of scope, head (what names the target) and query."""
    code = fold["code"]
    # the arms' texts stay folded until the end, where they are unfolded once
    arm = lambda k, head, query: F.struct(F.concat(F.lit("m"), F.when(k == 0, "").otherwise(k.cast("string"))).alias("scope_id"), head.alias("head"), query.alias("query"))
    none, one = F.lit(""), F.lit(0)
    shared = F.regexp_extract(code, FROM_FIRST, 1)
    part = lambda a, n: F.regexp_extract(a, FROM_ARM, n)
    from_arms = F.transform(
        F.regexp_extract_all(code, F.lit(FROM_ARM), F.lit(0)),
        lambda a, k: arm(k, part(a, 1), F.concat_ws(" ", part(a, 2), F.lit("FROM"), shared, part(a, 3))),
    )
    asked = F.concat_ws(" ", F.regexp_extract(code, FROM_QUERY, 1), F.lit("FROM"), shared, F.regexp_extract(code, FROM_QUERY, 2))
    from_query = F.when(code.rlike(r"(?iU)\bSELECT\b"), asked).otherwise(F.concat(F.lit("SELECT * "), code))
    source = F.regexp_extract(code, BODY, 0)
    into = lambda a, n: F.regexp_extract(a, ALL_ARM, n)
    all_arms = F.transform(
        F.regexp_extract_all(code, F.lit(ALL_ARM), F.lit(0)),
        lambda a, k: arm(
            k,
            F.concat(F.lit("INSERT INTO "), into(a, 1), into(a, 2)),
            F.when(into(a, 3) == "", source).otherwise(F.concat(F.lit("SELECT "), content(into(a, 3), fold), F.lit(" FROM ("), source, F.lit(") src"))),
        ),
    )
    rows = F.transform(
        F.regexp_extract_all(F.regexp_extract(code, VALUES_ROWS, 1), F.lit(f"({ANY_GROUP})"), F.lit(1)),
        lambda m: F.concat(F.lit("SELECT "), F.when(F.startswith(m, F.lit(QUERY)), m).otherwise(content(m, fold))),
    )
    with_values = code.rlike(rf"(?iU)\bVALUES\s*+{ANY_GROUP}") & ~code.rlike(r"(?iU)\bSELECT\b")
    values_query = F.when(F.exists(fold["groups"], lambda g: g.rlike(STARTS_QUERY)), F.array_join(rows, " UNION ALL ")).otherwise(none)
    into_query = F.concat_ws(" ", F.regexp_extract(code, SELECT_INTO, 1), F.regexp_extract(code, SELECT_INTO, 3))
    arms = (
        F.when(code.rlike(r"(?iU)^FROM\b") & (F.size(from_arms) > 0), from_arms)
        .when(code.rlike(r"(?iU)^FROM\b"), F.array(arm(one, none, from_query)))
        .when(code.rlike(r"(?iU)^INSERT\s++(?:ALL|FIRST)\b"), all_arms)
        .when(code.rlike(SELECT_INTO), F.array(arm(one, F.concat(F.lit("CREATE TABLE "), F.regexp_extract(code, SELECT_INTO, 2)), into_query)))
        .when((kind == "insert") & with_values, F.array(arm(one, code, values_query)))
        .when(kind.isin("insert", "create", "select", "other"), F.array(arm(one, code, source)))
        .otherwise(F.array(arm(one, code, none)))
    )
    texts = lambda a: F.transform(F.array(a["head"], a["query"]), lambda t: strip(unfolded(t, fold)))
    plain = F.transform(arms, lambda a: F.struct(a["scope_id"].alias("scope_id"), texts(a).alias("texts")))
    return F.transform(plain, lambda a: F.struct(a["scope_id"].alias("scope_id"), F.get(a["texts"], F.lit(0)).alias("head"), F.get(a["texts"], F.lit(1)).alias("query")))


def sql_statement_kind(statements: DataFrame) -> DataFrame:
    """:func:`mined` statements with ``kind`` and ``arms``: structs ``(scope_id, head, query)``, one for each table that is written.

    Several arms come from ``FROM s INSERT ... INSERT ...`` and ``INSERT ALL``; they share what they read. Writing statements whose
    table isn't found, and others that write in a form that isn't known, need a parser.
    """
    rows = mined(statements).withColumn("first", statement_kind(F.col("main")))
    code, first = F.col("fold")["code"], F.col("first")
    kind = (
        F.when(code.rlike(r"(?isU)^FROM\b.*\bINSERT\b"), "insert").when(code.rlike(r"(?iU)^FROM\b"), "select")
        .when(code.rlike(SELECT_INTO), "create").otherwise(first)
    )
    rows = rows.withColumn("kind", kind)
    none = F.array().cast("array<struct<scope_id:string,head:string,query:string>>")
    rows = rows.withColumn("arms", F.explode(F.array(F.coalesce(_writes(F.col("kind"), F.col("fold")), none))))
    heads = F.filter("arms", lambda a: F.regexp_extract(a["head"], WRITTEN, 1) == "")
    writing = F.col("kind").isin("insert", "create", "update", "merge", "delete")
    lost = writing & ((F.size(heads) > 0) | (F.size("arms") == 0))
    unknown = (F.col("kind") == "other") & F.col("main").rlike(r"(?iU)\b(?:INTO|OVERWRITE|MERGE|INSERT)\b") & ~F.col("main").rlike(r"(?i)^LOAD\b")
    return rows.withColumn("needs_parser", F.col("needs_parser") | F.coalesce(lost | unknown, F.lit(False))).drop("first", "fold")


IF_NOT = r"(?:IF\s++NOT\s++EXISTS\s++)?+"
INSERT_HEAD = rf"(?:INSERT|REPLACE|COPY)\s++(?:OVERWRITE\s++|INTO\s++|IGNORE\s++)*+(?:LOCAL\s++)?+(?:TABLE\s++)?+{IF_NOT}"
CREATE_HEAD = rf"CREATE\b(?:(?!\b(?:TABLE|VIEW)\b)[^(])*+\b(?:TABLE|VIEW)\s++{IF_NOT}"
DELETE_HEAD = rf"DELETE\s++(?:FROM\s++|(?:{NAME}(?:\s*+,\s*+{NAME})*+)\s++FROM\s++)?+"
WRITTEN = rf"(?iU)^(?:{INSERT_HEAD}|{CREATE_HEAD}|UPDATE\s++(?:ONLY\s++)?+|MERGE\s++(?:INTO\s++)?+|{DELETE_HEAD}){NOT_TABLE}({NAME})"
LISTED = rf"(?iU)^(?:{INSERT_HEAD}{NAME}(?:\s*+PARTITION\s*+\([^()]*+\))?+\s*+\((?!\s*+(?:SELECT|WITH)\b)([^()]*+)\)|{CREATE_HEAD}{NAME}\s*+\(([^()]*+)\)(?=\s*+AS\b))"
WRITING = ["insert", "create", "update", "merge", "delete"]


def sql_targets(statements: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, kind, scope_id, table_name, cols)``: the tables that a statement writes, the scope that feeds each, and the explicit columns."""
    rows = statements.where(F.col("kind").isin(WRITING)).select(*KEY, "kind", F.explode("arms").alias("arm")).select(
        *KEY,
        "kind",
        F.when(F.col("kind").isin("insert", "create"), F.col("arm.scope_id")).otherwise("w").alias("scope_id"),
        _squeeze(F.regexp_extract("arm.head", WRITTEN, 1)).alias("table_name"),
        F.concat(F.regexp_extract("arm.head", LISTED, 1), F.regexp_extract("arm.head", LISTED, 2)).alias("listed"),
    )
    listed = F.transform(F.split("listed", ","), lambda c: unmasked(strip(c)))
    return rows.where("table_name <> ''").select(
        *KEY, "kind", "scope_id", "table_name", F.when(strip(F.col("listed")) != "", listed).otherwise(F.array().cast("array<string>")).alias("cols")
    )


def sql_ctes(statements: DataFrame, max_ctes: int | None = None) -> DataFrame:
    """``(script_id, stmt_idx, pos, name, body)``: the CTEs of a statement, from 0; ``max_ctes`` drops later ones."""
    out = statements.select(*KEY, F.posexplode("ctes").alias("pos", "cte")).select(*KEY, "pos", "cte.name", "cte.body")
    return out if max_ctes is None else out.where(F.col("pos") < max_ctes)


# -- blocks and relations --------------------------------------------------------------------------------------

FROM_STOPS = "WHERE|GROUP|HAVING|ORDER|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|WINDOW|QUALIFY|RETURNING|CONNECT|START|PREWHERE|CLUSTER|DISTRIBUTE|SORT|FETCH"
SELECT_LIST = rf"(?isU)^SELECT\b\s*+(?:DISTINCT\b\s*+(?:ON\s*+{ANY_GROUP}\s*+)?+|ALL\b\s*+)?+({until('FROM')})"
FROM_CLAUSE = rf"(?isU)^SELECT\b{until('FROM')}\bFROM\b\s*+({until(FROM_STOPS)})"
BRANCHES = rf"(?iU)\b(?:{SETS})\b(?:\s++(?:ALL|DISTINCT)\b)?+(?:\s++BY\s++NAME\b)?+"
FROM_ITEM = r"(?isU)(?:\bJOIN\b)?+((?:(?!\bJOIN\b)[^,])++)"
ITEM = rf"(?isU)^\s*+(?:LATERAL\s++)?+({NAME}|{QUERY}\d++{MARK_END})\s*+({ANY_GROUP})?+(?:\s*+(?:AS\s++)?+{NOT_IN_FROM}({ID}))?"
#: What the brackets behind a table hold where they aren't a call.
HINT = r"(?i)^\s*+(?:NOLOCK|NOWAIT|(?:UP|HOLD|ROW|PAG|X)LOCK|TABLOCKX?|READ(?:UNCOMMITTED|COMMITTED|PAST)|SERIALIZABLE|INDEX\b)"
#: A bracket where a FROM item starts.
WRAPPED = rf"(?isU)(^\s*+|,\s*+|\bJOIN\s*+|\bLATERAL\s*+){PLAIN_GROUP}"


def unwrapped(clause, fold):
    """A folded FROM clause whose items aren't brackets round joins, to any depth."""

    def outer(text, _):
        heads = F.regexp_extract_all(text, F.lit(WRAPPED), F.lit(1))
        numbers = F.regexp_extract_all(text, F.lit(WRAPPED), F.lit(2))
        inner = F.zip_with(heads, numbers, lambda h, n: F.concat(h, F.get(fold["groups"], n.cast("int")), F.lit(" ")))
        return _stitched(F.split(text, WRAPPED, -1), inner)

    return F.aggregate(_rounds(fold["depth"]), clause, outer)


def from_items(code, fold, clause: str = FROM_CLAUSE):
    """The items of a FROM clause, folded."""
    return F.regexp_extract_all(unwrapped(F.regexp_extract(code, clause, 1), fold), F.lit(FROM_ITEM), F.lit(1))


def _body(text):
    """A body without brackets round the whole of it."""
    fold = folded(text)
    return F.when(fold["code"].rlike(rf"^\s*+{ANY_GROUP}\s*+$"), inside(fold["code"], fold)).otherwise(strip(text))


def branches_of(code):
    """The operands of the set operations of folded text."""
    return F.filter(F.split(code, BRANCHES, -1), lambda b: b.rlike(rf"(?iU)^\s*+(?:SELECT\b|{QUERY})"))


def sql_blocks(statements: DataFrame, ctes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``(script_id, stmt_idx, scope_id, parent_scope_id, kind, body)``: the tree of query blocks.

    Kinds are ``main``, ``cte``, ``derived`` (FROM-subquery), ``branch`` (of a set operation), ``scalar`` and ``filter`` (a query in a
    DELETE). ``more`` are further blocks whose own blocks are wanted. A scope's id is its path: ``m`` for the main query, ``m1``, ``m2``, ... for those of further targets, ``c0``, ``c1``, ... for
    CTEs, ``d0``, ... for filters, then ``.u``, ``.f`` or ``.s`` with the place in the parent.
    """
    none = F.lit(None).cast("string")
    arms = statements.where(F.col("kind").isin("insert", "create", "select", "other")).select(*KEY, F.explode("arms").alias("arm")).where("arm.query <> ''")
    main = arms.select(*KEY, "arm.scope_id", none.alias("parent_scope_id"), F.lit("main").alias("kind"), _body(F.col("arm.query")).alias("body"))
    named = ctes.select(*KEY, F.concat(F.lit("c"), F.col("pos").cast("string")).alias("scope_id"), none.alias("parent_scope_id"), F.lit("cte").alias("kind"), _body(F.col("body")).alias("body"))
    deletes = with_fold(statements.where("kind = 'delete'").select(*KEY, "main"), "main")
    flat = unfolded(F.col("fold")["code"], F.col("fold"), queries=False)
    filters = deletes.select(*KEY, "fold", F.posexplode(F.regexp_extract_all(flat, F.lit(f"({QUERY}\\d++{MARK_END})"), F.lit(1))).alias("n", "mark")).select(
        *KEY, F.concat(F.lit("d"), F.col("n").cast("string")).alias("scope_id"), none.alias("parent_scope_id"), F.lit("filter").alias("kind"), inside(F.col("mark"), F.col("fold")).alias("body")
    )
    tops = main.unionByName(named).unionByName(filters)
    level = materialize(tops if more is None else tops.unionByName(more))
    out = level
    for _ in range(MOST_LEVELS):
        fold = F.col("fold")
        code = fold["code"]
        several = F.size(branches_of(code)) > 1
        bare = lambda b: F.when(b.rlike(rf"^\s*+{ANY_GROUP}\s*+$"), content(b, fold)).otherwise(b)
        derived = F.filter(F.transform(from_items(code, fold), lambda i: F.regexp_extract(i, ITEM, 1)), lambda r: F.startswith(r, F.lit(QUERY)))
        listed = unfolded(F.regexp_extract(code, SELECT_LIST, 1), fold, queries=False)
        scalar = F.regexp_extract_all(listed, F.lit(f"({QUERY}\\d++{MARK_END})"), F.lit(1))
        tag = lambda items, letter, kind: F.transform(
            items, lambda b, k: F.struct(F.concat(F.lit(letter), k.cast("string")).alias("at"), F.lit(kind).alias("kind"), bare(b).alias("body"))
        )
        tagged = F.when(several, tag(branches_of(code), ".u", "branch")).otherwise(F.concat(tag(derived, ".f", "derived"), tag(scalar, ".s", "scalar")))
        children = F.transform(tagged, lambda x: F.struct(x["at"].alias("at"), x["kind"].alias("kind"), strip(unfolded(x["body"], fold)).alias("body")))
        nested = with_fold(level.where(F.contains("body", F.lit("(")) | F.col("body").rlike(BRANCHES)), "body")
        below = nested.select(*KEY, F.col("scope_id").alias("parent_scope_id"), F.explode(children).alias("x")).select(
            *KEY, F.concat("parent_scope_id", "x.at").alias("scope_id"), "parent_scope_id", "x.kind", "x.body"
        )
        level = materialize(below)
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"query blocks are nested deeper than {MOST_LEVELS}")


def single_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` that aren't set operations, with ``fold``; what has it already is returned as it is."""
    if "fold" in blocks.columns:
        return blocks
    return with_fold(blocks, "body").where(F.size(branches_of(F.col("fold")["code"])) <= 1)


def _relations(rows: DataFrame, items) -> DataFrame:
    """Relations of ``rows`` with ``fold``: one for each of the ``items`` that is a table or a query, not a function's call."""
    taken = rows.select(*KEY, "scope_id", "fold", F.explode(F.array(items)).alias("items")).select(*KEY, "scope_id", "fold", "items", F.posexplode("items").alias("pos", "item")).select(
        *KEY, "scope_id", "fold", "items", "pos", F.regexp_extract("item", ITEM, 1).alias("ref"), F.regexp_extract("item", ITEM, 2).alias("called"), F.lower(unmasked(F.regexp_extract("item", ITEM, 3))).alias("as_name")
    )
    sub = F.startswith("ref", F.lit(QUERY))
    name = _squeeze(F.col("ref"))
    table = (F.col("called") == "") | content(F.col("called"), F.col("fold")).rlike(HINT)
    # the place of a subquery among those of its block is part of its scope's id
    before = F.size(F.filter(F.slice("items", 1, F.col("pos")), lambda i: F.startswith(F.regexp_extract(i, ITEM, 1), F.lit(QUERY))))
    return taken.where((F.col("ref") != "") & (sub | (table & F.col("ref").rlike(rf"(?iU)^{NOT_TABLE}")))).select(
        *KEY,
        "scope_id",
        "pos",
        F.when(F.col("as_name") != "", F.col("as_name")).when(~sub, F.element_at(F.split(name, r"\."), -1)).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string"))).alias("alias"),
        F.when(sub, "derived").otherwise("table").alias("kind"),
        F.when(~sub, name).alias("table_name"),
        F.when(sub, inside(F.col("ref"), F.col("fold"))).alias("sub_body"),
        F.when(sub, F.concat("scope_id", F.lit(".f"), before.cast("string"))).alias("derived_scope_id"),
    )


def sql_relations(blocks: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, scope_id, pos, alias, kind, table_name, derived_scope_id)``: what blocks read from.

    The alias is the written one, else the last part of the name. A FROM-subquery points to its own scope. Calls of table functions are none.
    """
    single = single_blocks(blocks)
    return _relations(single, from_items(F.col("fold")["code"], F.col("fold"))).drop("sub_body")


def blocks_without_relation(blocks: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx)`` of blocks that have a FROM clause of which no item could be read."""
    single = single_blocks(blocks)
    items = from_items(F.col("fold")["code"], F.col("fold"))
    empty = ~F.exists(items, lambda i: i.rlike(ITEM))
    return single.where(F.col("fold")["code"].rlike(r"(?iU)\bFROM\b") & empty).select(*KEY).distinct()


UPDATE_FROM = rf"(?isU)^UPDATE\s++{until('FROM')}\bFROM\s++({until('WHERE|RETURNING')})"
UPDATE_JOIN = rf"(?isU)^UPDATE\s++({until('SET')})"
MERGE_USING = rf"(?isU)^MERGE\s++{until('USING')}\bUSING\s*+({until('ON')})"
DELETE_USING = rf"(?isU)^DELETE\b{until('USING|WHERE')}\bUSING\s++({until('WHERE|RETURNING')})"
DELETE_FROM = rf"(?isU)^DELETE\b{until('FROM')}\bFROM\s++({until('USING|WHERE|RETURNING')})"
NAMED_TABLES = rf"(?isU)\bTABLE\s++({NAME})"


def sql_written_relations(statements: DataFrame) -> DataFrame:
    """Relations of UPDATE (FROM items and joined tables), MERGE (USING) and DELETE (USING and joined tables), and the tables that
    LOAD and EXCHANGE PARTITION name, under the scope ``w``.

    An UPDATE's own table isn't among them, so references to its alias resolve to nothing.
    """
    rows = with_fold(statements.where(F.col("kind").isin("update", "merge", "delete", "other", "command")), "main")
    fold, code, kind = F.col("fold"), F.col("fold")["code"], F.col("kind")
    rest = lambda clause: F.filter(from_items(code, fold, clause), lambda _, k: k > 0)
    named = code.rlike(r"(?iU)^(?:LOAD\b|ALTER\b.*\bEXCHANGE\b)")
    items = (
        F.when(kind == "update", F.concat(from_items(code, fold, UPDATE_FROM), rest(UPDATE_JOIN)))
        .when(kind == "merge", from_items(code, fold, MERGE_USING))
        .when(kind == "delete", F.concat(from_items(code, fold, DELETE_USING), rest(DELETE_FROM)))
        .when(named, F.regexp_extract_all(code, F.lit(NAMED_TABLES), F.lit(1)))
    )
    found = _relations(rows.withColumn("scope_id", F.lit("w")).where(items.isNotNull()), items)
    return found.select(*KEY, "scope_id", "pos", "alias", "kind", "table_name", "derived_scope_id", "sub_body")


def sql_physical_sources(relations: DataFrame, ctes: DataFrame, by_root: bool = False) -> DataFrame:
    """``(script_id, stmt_idx, table_name)``: the relations of a statement that name no CTE of it.

    ``by_root`` adds ``root``, the scope of the arm that reads the table; it is null for tables of CTEs, which all arms may read.
    """
    named = ctes.select(*KEY, F.col("name").alias("table_name"))
    root = F.substring_index("scope_id", ".", 1)
    more = [F.when(~root.rlike(r"^c\d+$"), root).alias("root")] if by_root else []
    return relations.where("kind = 'table'").select(*KEY, "table_name", *more).distinct().join(named, [*KEY, "table_name"], "left_anti")


def sql_table_edges(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, source, target)``: each physical source to the statement's targets, self edges dropped.

    Sources with a ``root`` go to the targets that their root feeds.
    """
    written = targets.where("kind <> 'delete'")
    if "root" in sources.columns:
        met = sources.join(written.select(*KEY, F.col("table_name").alias("target"), F.col("scope_id").alias("fed")), KEY).where("root is null or root = fed")
    else:
        met = sources.join(written.select(*KEY, F.col("table_name").alias("target")), KEY)
    return met.withColumnRenamed("table_name", "source").where("source <> target").select(*KEY, "source", "target").distinct()


def sql_read_only_tables(statements: DataFrame, sources: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, id, role)``: the tables of pure queries and of other statements, all sources; commands give those they name as tables."""
    kinds = statements.where(F.col("kind").isin("select", "other", "command")).select(*KEY)
    return sources.join(kinds, KEY).select(*KEY, F.col("table_name").alias("id"), F.lit("source").alias("role")).distinct()


# -- columns ---------------------------------------------------------------------------------------------------

TOP_COMMAS = r"[^,]++"
ALIAS_AS = rf"(?isU)\bAS\s++({WORD}|'')\s*$"
ALIAS_BARE = rf"(?isU)[\w)'\]{NAMED_END}{MARK_END}]\s++{NOT_KEYWORD}({ID})\s*$"
PLAIN = rf"(?isU)^(?:{WORD}\s*\.\s*)*({WORD}|\*)$"


def top_items(text):
    """The parts between the commas of folded text."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TOP_COMMAS), F.lit(0)), lambda x: strip(x)), lambda x: x != "")


def sql_projections(blocks: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, scope_id, pos, name, expr)``: the output columns of the blocks, from 1.

    The name is the alias, else the column's, ``*`` for a star, else ``col_<pos>``; ``expr`` has no alias, and marks for subqueries.
    """
    single = single_blocks(blocks)
    items = single.select(*KEY, "scope_id", "fold", F.posexplode(top_items(F.regexp_extract(F.col("fold")["code"], SELECT_LIST, 1))).alias("at", "item"))
    stated = F.regexp_extract("item", ALIAS_AS, 1)
    bare = F.when(F.col("stated") == "", F.regexp_extract("item", ALIAS_BARE, 1)).otherwise("")
    plain = F.regexp_extract("expr", PLAIN, 1)
    without = (
        F.when(F.col("stated") != "", F.regexp_replace("item", rf"(?isU)\bAS\s+(?:{WORD}|'')\s*$", ""))
        .when(F.col("bare") != "", F.regexp_replace("item", rf"(?isU){ID}\s*$", ""))
        .otherwise(F.col("item"))
    )
    named = F.when(F.col("stated") != "", F.col("stated")).when(F.col("bare") != "", F.col("bare")).when(plain != "", plain)
    return (
        items.withColumn("stated", stated)
        .withColumn("bare", bare)
        .withColumn("expr", strip(unfolded(without, F.col("fold"), queries=False)))
        .select(*KEY, "scope_id", (F.col("at") + 1).alias("pos"), F.coalesce(unmasked(named), F.concat(F.lit("col_"), (F.col("at") + 1).cast("string"))).alias("name"), "expr")
    )


REFERENCE = rf"(?iU)(?<![\w$.{NAMED}{NAMED_END}{QUERY}]){ID}(?:{DOT}{ID})*+(?!\s*+[(.])"


def subqueries_in(expr):
    """How many subqueries an expression has."""
    return F.size(F.regexp_extract_all(expr, F.lit(QUERY_GROUP), F.lit(0)))


def sql_column_refs(projections: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, scope_id, pos, qualifier, col)``: the columns that an expression refers to.

    Function names, keywords and literals are none; a star is one only if it is the whole item. Subqueries are left
    to their own scopes. Names are lower-cased; the qualifier is the last name before the column's.
    """
    star = F.col("expr").rlike(rf"(?isU)^(?:{WORD}\s*\.\s*)*\*(?:\s*+(?:EXCEPT|EXCLUDE|REPLACE)\b.*+)?$")
    words = F.filter(F.regexp_extract_all("expr", F.lit(REFERENCE), F.lit(0)), lambda w: ~F.lower(w).isin(KEYWORDS))
    found = F.when(star, F.array(F.regexp_extract("expr", rf"(?isU)^((?:{WORD}\s*\.\s*)*\*)", 1))).otherwise(words)
    parts = F.transform(F.split("ref", DOT), lambda p: F.lower(unmasked(strip(p))))
    return (
        projections.select(*KEY, "scope_id", "pos", F.explode(F.array_distinct(found)).alias("ref"))
        .select(*KEY, "scope_id", "pos", parts.alias("parts"))
        .select(*KEY, "scope_id", "pos", F.when(F.size("parts") > 1, F.element_at("parts", -2)).alias("qualifier"), F.element_at("parts", -1).alias("col"))
        .distinct()
    )


SET_CLAUSE = rf"(?isU)^UPDATE\s++{until('SET')}\bSET\s++({until('FROM|WHERE|RETURNING|ORDER|LIMIT')})"
MERGE_SET = rf"(?isU)\bUPDATE\s++SET\s++({until('WHEN|WHERE|DELETE')})"
MERGE_INSERT = rf"(?isU)\bINSERT\s*+({ANY_GROUP})\s*+VALUES\s*+({ANY_GROUP})"


def set_items(statements: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, arm, pos, column, expr, asked)``: :func:`sql_set_items` with the subqueries of each expression."""
    rows = with_fold(statements.where(F.col("kind").isin("update", "merge")).select(*KEY, "kind", "main"), "main")
    fold, code = F.col("fold"), F.col("fold")["code"]
    last = lambda name: F.lower(F.element_at(F.transform(F.split(strip(name), DOT), lambda p: unmasked(strip(p))), -1))

    def item(column, value):
        expr = strip(unfolded(value, fold, queries=False))
        asked = F.transform(F.regexp_extract_all(expr, F.lit(f"({QUERY}\\d++{MARK_END})"), F.lit(1)), lambda m: inside(m, fold))
        return F.struct(last(column).alias("column"), expr.alias("expr"), asked.alias("asked"))

    split = lambda clause: F.transform(
        F.filter(top_items(clause), lambda i: F.contains(i, F.lit("="))),
        lambda i: item(F.regexp_extract(i, r"(?s)^([^=]+)=", 1), F.regexp_extract(i, r"(?s)^[^=]+=(.*)$", 1)),
    )
    paired = F.flatten(
        F.transform(
            F.regexp_extract_all(code, F.lit(MERGE_INSERT), F.lit(0)),
            lambda a: F.filter(
                F.zip_with(top_items(content(F.regexp_extract(a, MERGE_INSERT, 1), fold)), top_items(content(F.regexp_extract(a, MERGE_INSERT, 2), fold)), item),
                lambda x: x["column"].isNotNull() & x["expr"].isNotNull(),
            ),
        )
    )
    arms = (
        ("update", "update", split(F.regexp_extract(code, SET_CLAUSE, 1))),
        ("merge", "merge_update", F.flatten(F.transform(F.regexp_extract_all(code, F.lit(MERGE_SET), F.lit(1)), split))),
        ("merge", "merge_insert", paired),
    )
    parts = [
        rows.where(F.col("kind") == kind).select(*KEY, F.lit(arm).alias("arm"), F.posexplode(items).alias("at", "x")).select(
            *KEY, "arm", (F.col("at") + 1).alias("pos"), "x.column", "x.expr", "x.asked"
        )
        for kind, arm, items in arms
    ]
    return reduce(DataFrame.unionByName, parts)


def sql_set_items(statements: DataFrame) -> DataFrame:
    """``(script_id, stmt_idx, arm, pos, column, expr)``: the assignments of UPDATE and MERGE, from 1 in each arm.

    Arms are ``update``, ``merge_update`` and ``merge_insert``, each with all WHEN clauses of its kind; an insert arm pairs column i with value i.
    """
    return set_items(statements).drop("asked")
