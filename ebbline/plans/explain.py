"""SQL over registered tables: what a statement would do, and doing it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from ebbline.operators.store import RoutingError


@dataclass
class Statement:
    kind: str  # select, update, delete, insert
    tables: list[str] = field(default_factory=list)
    #: Expressions as columns, with the trees that Spark's parser made of them.
    where: tuple[Column, object] | None = None
    assign: dict[str, tuple[Column, object]] = field(default_factory=dict)
    query: object = None  # a parsed plan
    columns: list[str] | None = None  # an insert's column list
    by_name: bool = False


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _name(relation) -> str:
    while relation.nodeName() in ("SubqueryAlias", "PlanWithUnresolvedIdentifier"):
        relation = relation.children().head()
    if relation.nodeName() != "UnresolvedRelation":
        raise RoutingError("only a plain table can be written")
    return ".".join(_seq(relation.multipartIdentifier()))


def _relations(plan, out: list[str]) -> list[str]:
    """Names of all tables a plan reads, in subqueries and common table expressions too."""
    if plan.nodeName() == "UnresolvedRelation":
        out.append(".".join(_seq(plan.multipartIdentifier())))
    for c in _seq(plan.children()):
        _relations(c, out)
    if plan.nodeName() == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            _relations(pair._2(), out)
    for e in _seq(plan.expressions()):
        _in_expression(e, out)
    return out


def _in_expression(e, out: list[str]) -> None:
    if hasattr(e, "plan") and e.nodeName() in ("Exists", "ScalarSubquery", "ListQuery"):
        _relations(e.plan(), out)
    for c in _seq(e.children()):
        _in_expression(c, out)


def _column(spark: SparkSession, expression) -> tuple[Column, object]:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression)), expression


def run(spark: SparkSession, plan) -> DataFrame:
    """The rows of a parsed plan."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _insert(spark: SparkSession, plan) -> Statement | None:
    """An INSERT, also one behind common table expressions, which then belong to its query."""
    into = plan.children().head() if plan.nodeName() == "UnresolvedWith" else plan
    if into.nodeName() != "InsertIntoStatement":
        return None
    if into.overwrite() or into.partitionSpec().size():
        raise RoutingError("INSERT OVERWRITE and PARTITION aren't supported: a routed insert only adds rows")
    query = into.query()
    if plan is not into:
        query = plan.withNewChildren(spark._jvm.org.apache.spark.api.python.PythonUtils.toSeq([query]))
    return Statement("insert", [_name(into.table())], query=query, columns=_seq(into.userSpecifiedCols()) or None, by_name=into.byName())


def _read_by(statement: Statement, expressions: list) -> Statement:
    for e in expressions:
        _in_expression(e, statement.tables)
    return statement


def parse(spark: SparkSession, sql: str) -> Statement:
    """tables: the written table first, then those that are read."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kind = plan.nodeName()
    if kind == "UpdateTable":
        assign = {}
        for a in _seq(plan.assignments()):
            parts = _seq(a.key().nameParts())
            if len(parts) > 1:
                raise RoutingError("only whole columns can be set")
            assign[parts[0]] = _column(spark, a.value())
        where = _column(spark, plan.condition().get()) if plan.condition().isDefined() else None
        return _read_by(Statement("update", [_name(plan.table())], where, assign), [x[1] for x in (*assign.values(), where) if x])
    if kind == "DeleteFromTable":
        where = plan.condition()
        if where.nodeName() == "Literal":
            return Statement("delete", [_name(plan.table())], None if str(where.value()) == "true" else _column(spark, where))
        return _read_by(Statement("delete", [_name(plan.table())], _column(spark, where)), [where])
    if insert := _insert(spark, plan):
        insert.tables += _relations(insert.query, [])
        return insert
    if kind == "MergeIntoTable":
        raise RoutingError(f"{kind} isn't supported")
    return Statement("select", list(dict.fromkeys(_relations(plan, []))), query=plan)
