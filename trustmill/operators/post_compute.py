"""Calculations on query rows: each gives the rows and, by name, what must be empty for them to be trusted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Result = tuple[DataFrame, dict[str, DataFrame]]
VALUE = "decimal(24,4)"
RATIO = "decimal(38,18)"


def metrics_of(spec: Any) -> list[str]:
    return list(spec.metrics or (spec.metric,))


def quotient(a: Column, b: Column) -> Column:
    """a / b with six places, null where b is zero; both exact decimals."""
    return F.try_divide(a.cast(VALUE), b.cast(VALUE)).cast("decimal(38,6)")


def not_finite(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows of which a value is NaN or infinite; decimals never are."""
    kinds = dict(rows.dtypes)
    bad = [F.isnan(m) | (F.abs(F.col(m)) == F.lit(float("inf"))) for m in metrics if kinds[m] in ("double", "float")]
    return rows.filter(reduce(lambda a, b: a | b, bad, F.lit(False)))


def above_industry_mean(rows: DataFrame, spec: Any) -> Result:
    """Rows of which every metric exceeds its mean over all rows; nulls don't count towards a mean.

    The rows stay where they are.
    """
    metrics = metrics_of(spec)
    means = rows.agg(*(F.avg(F.col(m).cast(VALUE)).alias(f"mean_{m}") for m in metrics))
    kept = rows
    for m in metrics:  # scalar subqueries: one small value each
        kept = kept.filter(F.col(m) > means.select(f"mean_{m}").scalar())
    empty = means.filter(" OR ".join(f"mean_{m} IS NULL" for m in metrics))
    return kept, {"mean_without_values": empty, "not_finite": not_finite(rows, metrics)}


def period_comparison(rows: DataFrame, spec: Any) -> Result:
    """Each company's periods in order: previous value, change, and change in percent of the previous one's size."""
    from trustmill.functions.periods import order_column

    metrics = metrics_of(spec)
    order = order_column(F.col("report_period"))
    by = Window.partitionBy("stock_code", "stock_abbr").orderBy(order)
    out = rows
    for m in metrics:
        previous = F.lag(F.col(m).cast(VALUE)).over(by)
        change = F.col(m).cast(VALUE) - previous
        out = out.withColumns({f"{m}_previous_value": previous, f"{m}_absolute_change": change, f"{m}_change_pct": quotient(change * 100, F.abs(previous))})
    missing = rows.filter((order == 0) | reduce(lambda a, b: a | b, (F.col(m).isNull() for m in metrics)))
    return out.orderBy("stock_code", "stock_abbr", order), {"period_or_value_missing": missing, "not_finite": not_finite(rows, metrics)}


def zero_bases(compared: DataFrame, metrics: list[str]) -> DataFrame:
    """(stock_code, report_period, metric, reason) where a change has no percentage."""
    found = F.array_compact(F.array(*(F.when(F.col(f"{m}_previous_value") == 0, F.lit(m)) for m in metrics)))
    return compared.select("stock_code", "report_period", F.explode(found).alias("metric"), F.lit("zero_base").alias("reason"))


def ratio(rows: DataFrame, spec: Any) -> Result:
    """numerator / denominator of the calculation as its output field."""
    top, bottom, name = (spec.calculation[k] for k in ("numerator", "denominator", "output_field"))
    bad = rows.filter(F.col(top).isNull() | F.col(bottom).isNull() | (F.col(bottom) == 0))
    return rows.withColumn(name, quotient(F.col(top), F.col(bottom))), {"undefined_ratio": bad}


def intersection_topn(rows: DataFrame, spec: Any) -> Result:
    """Companies among the first top_n for every metric, exactly top_n of each, ties by code; in the order given.

    Each ranking is a bounded top-k, so nothing is sorted as a whole.
    """
    metrics = metrics_of(spec)
    kept = rows
    for m in metrics:
        best = rows.filter(F.col(m).isNotNull()).orderBy(F.desc(m), "stock_code").limit(spec.top_n).select("stock_code")
        kept = kept.join(F.broadcast(best), "stock_code", "left_semi")
    ids = rows.groupBy("stock_code").count().filter((F.col("count") > 1) | F.col("stock_code").isNull() | (F.col("stock_code") == ""))
    few = rows.limit(1).filter(F.lit(len(metrics) < 2))
    return kept.orderBy(F.desc_nulls_last(metrics[0]), "stock_code").select(*rows.columns), {"company_not_unique": ids, "needs_two_metrics": few, "not_finite": not_finite(rows, metrics)}


OPERATORS: dict[str, Callable[[DataFrame, Any], Result]] = {
    "above_industry_mean": above_industry_mean,
    "intersection_topn": intersection_topn,
    "period_comparison": period_comparison,
    "ratio": ratio,
}
