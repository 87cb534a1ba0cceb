"""QuerySpec to one DataFrame plan over trusted facts.

The facts of all metrics asked for are read once, filtered, joined with their current sources, and pivoted; no join for each
metric. Names come from the registry only, values enter as literals. What must not happen comes out as violations, which
`run` looks at before it hands out a result.
"""

from __future__ import annotations

import functools
import operator
import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.periods import order_value
from trustmill.model import COMMON, Registry, SpecError, period_type
from trustmill.operators import post_compute
from trustmill.plans.spec import QuerySpec

_OPS = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
MAX_ROWS = 100
REASON_ROWS = 20
TIMEOUT_S = 5.0


class Untrusted(RuntimeError):
    """A result that may not be shown: rows over the cap, conflicts of facts, or undefined calculations."""


@dataclass(frozen=True)
class Catalog:
    facts: DataFrame
    sources: DataFrame
    companies: DataFrame


def trusted_facts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Validated, consolidated facts whose current source names the same company and period."""
    kind = F.when(F.col("table_name") == "balance_sheet", "instant").otherwise("duration")
    good = facts.filter((F.col("validation_status") == "VALIDATED") & (F.col("statement_scope") == "consolidated") & (F.col("period_type") == kind))
    current = sources.filter(F.col("authority_status") == "CURRENT").select("source_key", "stock_code", "period")
    return good.join(current, ["source_key", "stock_code", "period"])


def _scope(spec: QuerySpec) -> list[Column]:
    """Predicates on companies and periods; they reach the scan of the facts."""
    out = []
    if spec.stock_code:
        out.append(F.col("stock_code") == spec.stock_code)
    if spec.report_period:
        out.append(F.col("period") == spec.report_period)
    if spec.periods:
        out.append(F.col("period").isin(*spec.periods))
    for period, compare, years in ((spec.start_period, operator.ge, operator.ge), (spec.end_period, operator.le, operator.le)):
        if period:
            out.append(compare(F.col("period_ord"), order_value(period)))
            out.append(years(F.col("report_year"), int(period[:4])))  # prunes where facts are partitioned by year
    return out


def compile_spec(spec: QuerySpec, catalog: Catalog, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): rows as asked for, and (stock_code, report_period, metric, n) where more than one fact is trusted."""
    registry = registry or Registry()
    spec.check(registry)
    base = spec.table or registry.table_of_metric(spec.metric)
    shown = spec.select_fields or ("stock_abbr", "report_period", spec.metric)
    needed = list(dict.fromkeys([*(f for f in shown if f not in COMMON), *(f.field for f in spec.filters if f.field not in COMMON), *spec.metrics, spec.metric]))
    wanted = F.lit(False)
    for m in needed:
        wanted |= (F.col("metric") == m) & (F.col("table_name") == registry.resolve(m, base)) & (F.col("period_type") == period_type(registry.resolve(m, base)))
    facts = catalog.facts.filter(F.col("metric").isin(*needed))
    for predicate in _scope(spec):
        facts = facts.filter(predicate)
    trusted = trusted_facts(facts, catalog.sources).filter(wanted)
    each = [F.max(F.when(F.col("metric") == m, F.col("normalized_value"))).alias(m) for m in needed]
    counts = [F.count_if(F.col("metric") == m).alias(f"n_{m}") for m in needed]
    wide = trusted.groupBy("stock_code", "period", "report_year", "period_ord").agg(*each, *counts)
    wide = wide.filter(" AND ".join(f"n_{m} >= 1" for m in needed)).withColumnRenamed("period", "report_period")
    twice = F.array_compact(F.array(*(F.when(F.col(f"n_{m}") > 1, F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"))) for m in needed)))
    violations = wide.select("stock_code", "report_period", F.explode(twice).alias("x")).select("stock_code", "report_period", "x.metric", "x.n")
    abbr = catalog.companies.select("stock_code", "stock_abbr")
    rows = wide.join(abbr.filter(F.col("stock_abbr") == spec.stock_abbr) if spec.stock_abbr else abbr, "stock_code")
    for f in spec.filters:
        rows = rows.filter(_OPS[f.op](F.col(f.field), F.lit(f.value)))
    rows = rows.orderBy(*ordering(spec))
    if spec.analysis_type == "topn_metric":
        rows = rows.limit(spec.top_n)
    elif spec.analysis_type == "reason":
        rows = rows.limit(REASON_ROWS)
    keep = dict.fromkeys([*shown, *((*COMMON, *needed) if spec.post_compute else ())])
    return rows.select(*keep), violations


def ordering(spec: QuerySpec) -> list[Column]:
    """A total order: the company's code is last everywhere."""
    if spec.analysis_type in ("topn_metric", "filter", "intersection_topn"):
        return [F.desc_nulls_last(spec.metric), F.asc("stock_code"), F.asc("period_ord")]
    return [F.asc("period_ord"), F.asc("stock_code")]


def plan(spec: QuerySpec, catalog: Catalog, registry: Registry | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The result with the calculation applied, and all that must be empty, by name."""
    rows, conflicts = compile_spec(spec, catalog, registry)
    violations = {"conflicting_facts": conflicts}
    if spec.post_compute:
        if spec.post_compute not in post_compute.OPERATORS:
            raise SpecError(f"unknown post-compute operator {spec.post_compute!r}")
        rows, more = post_compute.OPERATORS[spec.post_compute](rows, spec)
        violations |= more
    return rows, violations


def run(spec: QuerySpec, catalog: Catalog, max_rows: int = MAX_ROWS, timeout_s: float | None = TIMEOUT_S) -> list[dict]:
    """The rows, or Untrusted: violations are materialized first, more rows than the cap are refused, never cut."""
    spark = catalog.facts.sparkSession
    rows, violations = plan(spec, catalog)
    group = f"trusted-{id(rows)}"
    spark.sparkContext.setJobGroup(group, spec.analysis_type, interruptOnCancel=True)
    timer = threading.Timer(timeout_s, spark.sparkContext.cancelJobGroup, [group]) if timeout_s else None
    if timer:
        timer.start()
    try:
        # one job for all rules, in which what they share with each other is made once
        each = [found.limit(3).select(F.lit(name).alias("rule"), F.to_json(F.struct("*")).alias("row")) for name, found in violations.items()]
        if bad := functools.reduce(DataFrame.unionByName, each).collect():
            raise Untrusted(f"{bad[0].rule}: {[r.row for r in bad if r.rule == bad[0].rule]}")
        got = rows.limit(max_rows + 1).collect()
    finally:
        if timer:
            timer.cancel()
    if len(got) > max_rows:
        raise Untrusted(f"more than {max_rows} rows")
    return [r.asDict() for r in got]
