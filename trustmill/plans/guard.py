"""SQL texts from outside: one plain SELECT over registered tables, checked on the tree that Spark's own parser makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustmill.model import SpecError

#: Plan nodes and functions that are allowed.
NODES = frozenset({"Project", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Join", "SubqueryAlias", "UnresolvedRelation", "Aggregate", "UnresolvedHaving", "NameParameterizedQuery"})
FUNCTIONS = frozenset({"avg", "count", "max", "min", "sum", "abs", "round", "coalesce", "if"})


def _walk(node, visit) -> None:
    visit(node)
    children = node.children()
    for k in range(children.size()):
        _walk(children.apply(k), visit)


def check(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raises SpecError for anything but one SELECT without sub-queries, stars, comments, values or unknown names."""
    if "--" in sql or "/*" in sql or "*/" in sql:
        raise SpecError("comments are not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's own error
        raise SpecError(f"not one statement: {str(e).splitlines()[0]}") from e

    def expression(e) -> None:
        name = e.getClass().getSimpleName()
        if name in ("UnresolvedStar", "ScalarSubquery", "Exists", "ListQuery", "InSubquery"):
            raise SpecError(f"{name} is not allowed")
        if name == "UnresolvedFunction":
            called = e.nameParts().mkString(".").lower()
            if called not in FUNCTIONS:
                raise SpecError(f"function {called!r} is not allowed")
        if name == "Literal":
            raise SpecError("values must be bound parameters")

    def operator(p) -> None:
        name = p.getClass().getSimpleName()
        if name not in NODES:
            raise SpecError(f"{name} is not allowed")
        if name == "SubqueryAlias" and p.child().getClass().getSimpleName() != "UnresolvedRelation":
            raise SpecError("sub-queries are not allowed")
        if name == "UnresolvedRelation" and p.tableName() not in tables:
            raise SpecError(f"unknown table {p.tableName()!r}")
        expressions = p.expressions()
        for k in range(expressions.size()):
            _walk(expressions.apply(k), expression)

    _walk(plan, operator)


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """The checked statement with its parameters bound by Spark."""
    check(spark, sql, set(tables))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


def audit_record(query_id: str, status: str, rows: int | None, error: str | None = None) -> dict:
    """What is logged of each query: never its values."""
    return {"query_id": query_id, "status": status, "row_count": rows, "error": error}
