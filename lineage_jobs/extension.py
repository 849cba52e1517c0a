"""Further engines as table functions: rows of scripts go in, rows of replies come out and take part in the fallback."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lineage_jobs.runtime import dealt_out, materialize

#: By part of a graph: the keys of its items that must be text, and those that may be missing or null.
CONTRACT = {
    "tables": (["id"], ["role"]),
    "table_edges": (["source", "target"], []),
    "column_edges": (["source_table", "source_column", "target_table", "target_column"], []),
}
COMMENT = re.compile(r"--[ \t]*lineage:[ \t]*([^\r\n]*)", re.IGNORECASE)


def breach(graph) -> str | None:
    """Where a graph breaks the contract of engines, or None.

    A graph is a mapping with a list ``tables`` of mappings; ``table_edges``, ``column_edges`` and ``warnings`` may be missing.
    Names are text; keys that the contract doesn't name count for nothing.
    """
    if not isinstance(graph, dict):
        return "no mapping"
    if not isinstance(graph.get("tables"), list):
        return "tables: no list"
    for part, (needed, free) in CONTRACT.items():
        items = graph.get(part) or []
        if not isinstance(items, list):
            return f"{part}: no list"
        for k, item in enumerate(items):
            if not isinstance(item, dict):
                return f"{part}[{k}]: no mapping"
            for name in needed + free:
                value = item.get(name)
                if not (isinstance(value, str) or value is None and name in free):
                    return f"{part}[{k}].{name}: no text"
            columns = item.get("columns") or [] if part == "tables" else []
            if not isinstance(columns, list) or not all(isinstance(c, str) for c in columns):
                return f"{part}[{k}].columns: no list of texts"
    warnings = graph.get("warnings") or []
    return None if isinstance(warnings, list) and all(isinstance(w, str) for w in warnings) else "warnings: no list of texts"


def reply(parse: Callable[[str, str | None], dict], text: str | None, dialect: str | None) -> str:
    """An engine's answer to one script as JSON: its graph, or an ``error``."""
    if text is None or not text.strip():
        return json.dumps({"error": "empty"})
    try:
        graph = parse(text, dialect)
        broken = breach(graph)
        return json.dumps({"error": f"contract: {broken}"} if broken else {k: graph[k] for k in [*CONTRACT, "warnings"] if graph.get(k) is not None}, ensure_ascii=False)
    except Exception as error:  # whatever an engine raises is a failed attempt, after which the next engine is tried
        return json.dumps({"error": str(error) or type(error).__name__}, ensure_ascii=False)


def engine_function(parse: Callable[[str, str | None], dict]):
    """The table function of an engine, for ``function(scripts.asTable(), F.lit(script), F.lit(text), F.lit(dialect))`` or SQL.

    It is polymorphic: the first column of its result has the name and type of the scripts' own key.
    """

    class Engine:
        @staticmethod
        def analyze(rows, script, text, dialect):
            from pyspark.sql.functions import AnalyzeResult  # the classes of this module go to workers by value

            fields = {f.name: f for f in rows.dataType.fields}
            for name in (script.value, text.value, dialect.value):
                if name not in fields:
                    raise ValueError(f"no column {name} in the scripts")
            if not isinstance(fields[text.value].dataType, StringType):
                raise ValueError(f"column {text.value} holds no text")
            return AnalyzeResult(StructType().add(script.value, fields[script.value].dataType).add("json", StringType()))

        def eval(self, row, script, text, dialect):
            yield row[script], reply(parse, row[text], row[dialect])

    return F.udtf(Engine)


def engine_replies(scripts: DataFrame, parse: Callable[[str, str | None], dict], script: str = "script_id", text: str = "text", dialect: str = "dialect") -> DataFrame:
    """``(script_id, json)``: one reply for each row of ``scripts``, to be read by :func:`corpus.engine_graph_json`.

    Rows stay in their partitions; only the three columns go to Python. Null and blank texts give the error ``empty`` without
    a call, repeated rows a reply each, null ids are kept, long texts go whole, an empty table gives an empty one. What
    ``parse`` raises and graphs that break the contract are errors of that script alone. The replies are written once, as every
    part of a graph is read from them and engines may be dear or answer differently when asked again.
    """
    few = dealt_out(scripts.select(script, text, dialect))
    return materialize(engine_function(parse)(few.asTable(), F.lit(script), F.lit(text), F.lit(dialect)))


def declared_lineage(text: str, dialect: str | None) -> dict:
    """A small engine: edges between tables that comments of the form ``-- lineage: a, b -> c`` declare."""
    found = COMMENT.findall(text)
    if not found:
        raise ValueError("no lineage comment")
    tables, edges = {}, []
    for comment in found:
        left, arrow, right = comment.partition("->")
        target, sources = right.strip(), [s.strip() for s in left.split(",") if s.strip()]
        if not arrow or not target or not sources:
            raise ValueError(f"unreadable: {comment.strip()}")
        for name in sources:
            tables.setdefault(name, "source")
            edges.append({"source": name, "target": target})
        tables[target] = "target"
    return {"tables": [{"id": name, "role": role} for name, role in tables.items()], "table_edges": edges}
