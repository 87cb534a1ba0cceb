"""Checks of facts: accounting rules, coverage, traceability, overall status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.operators.post_compute import quotient

ASSETS, LIABILITIES, EQUITY = "asset_total_assets", "liability_total_liabilities", "equity_total_equity"
REQUIRED = ("income_sheet", "balance_sheet", "cash_flow_sheet")


def balance_issues(wide: DataFrame) -> DataFrame:
    """Rows of which assets differ from liabilities and equity by more than 0.5 % or 1."""
    off = F.col(ASSETS) - F.col(LIABILITIES) - F.col(EQUITY)
    allowed = F.greatest(F.lit("0.005").cast("decimal(4,3)") * F.abs(F.col(ASSETS)), F.lit(1).cast("decimal(4,3)"))
    return wide.filter(F.abs(off) > allowed).select("stock_code", "period", off.cast("decimal(24,4)").alias("difference"))


def with_prior_year(wide: DataFrame, values: list[str]) -> DataFrame:
    """Each row with the same period's values of the year before, by one equi-join."""
    year, tail = F.substring("period", 1, 4).cast("int"), F.substring("period", 5, 2)
    before = wide.select("stock_code", F.concat((year + 1).cast("string"), tail).alias("period"), *(F.col(v).alias(f"prior_{v}") for v in values))
    return wide.join(before, ["stock_code", "period"])


def growth_issues(wide: DataFrame, metric: str, stated: str) -> DataFrame:
    """Rows of which the stated growth differs from the recomputed one (over the signed prior value) by more than 0.1 points."""
    rows = with_prior_year(wide.select("stock_code", "period", metric, stated), [metric])
    growth = quotient((F.col(metric) - F.col(f"prior_{metric}")) * 100, F.col(f"prior_{metric}"))
    return rows.filter(F.abs(growth - F.col(stated)) > F.lit("0.1").cast("decimal(4,1)")).select("stock_code", "period", growth.alias("recomputed"), F.col(stated).alias("stated"))


def status(total: Column, validated: Column, pending: Column, issues: Column, eligible: Column) -> Column:
    """One word for all checks together."""
    return F.when(issues > 0, "FAILED").when(total == 0, "UNAVAILABLE").when(pending > 0, "NEEDS_REVIEW").when(eligible == 0, "VALIDATION_UNAVAILABLE").otherwise("PASS")


def traceability(facts: DataFrame) -> DataFrame:
    """Facts, and the share that has each part of a place in its source; six places."""
    has = {c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in ("page_no", "table_name", "row_label", "column_label")}
    all_of = has["page_no"] & has["table_name"] & has["row_label"] & has["column_label"]
    share = lambda c: F.round(F.try_divide(F.count_if(c), F.count("*")), 6)
    return facts.agg(F.count("*").alias("facts"), *(share(c).alias(f"{n}_coverage") for n, c in has.items()), share(all_of).alias("coverage"))


def missing_statements(facts: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(stock_code, period, table_name) without any fact, for periods that have some."""
    known = facts.select("stock_code", "period").distinct()
    wanted = known.withColumn("table_name", F.explode(F.array(*map(F.lit, required))))
    return wanted.join(facts.select("stock_code", "period", "table_name").distinct(), ["stock_code", "period", "table_name"], "left_anti")


def ready(facts: DataFrame, issues: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """One row: may queries be answered, and why not."""
    counts = facts.agg(F.count_if(F.col("validation_status") == "VALIDATED").alias("validated"), *(F.count_if(F.col("table_name") == t).alias(t) for t in tables))
    found = issues.agg(F.count("*").alias("issues"))
    row = counts.withColumn("issues", found.scalar())
    reasons = F.array_compact(F.array(F.when(F.col("validated") == 0, F.lit("no_validated_fact")), F.when(F.col("issues") > 0, F.lit("inconsistent")), *(F.when(F.col(t) == 0, F.lit(f"empty:{t}")) for t in tables)))
    return row.select("validated", "issues", reasons.alias("reasons"), (F.size(reasons) == 0).alias("ready"))


def candidate_checks(wide: DataFrame) -> DataFrame:
    """Per company and period: each check as passed, failed or unavailable."""
    outcome = lambda ok: F.when(ok.isNull(), "unavailable").when(ok, "passed").otherwise("failed")
    liabilities_equity = F.col(LIABILITIES) + F.col(EQUITY)
    tolerance = F.greatest(F.lit("0.005").cast("decimal(4,3)") * F.greatest(F.abs(F.col(ASSETS)), F.abs(liabilities_equity)), F.lit(1).cast("decimal(4,3)"))
    balance = F.abs(F.col(ASSETS) - liabilities_equity) <= tolerance
    ratio = quotient(F.col(LIABILITIES) * 100, F.col(ASSETS))
    margin = quotient(F.col("net_profit") * 100, F.col("total_operating_revenue"))
    return wide.select("stock_code", "period", outcome(balance).alias("balance"), outcome(ratio.between(0, 100)).alias("asset_liability_ratio"), outcome(F.abs(margin) <= 100).alias("net_margin"))
