"""The compiler, trust, and the calculations on literal rows."""

from decimal import Decimal

import pytest

from trustmill import model
from trustmill.model import Registry, SpecError
from trustmill.operators import post_compute
from trustmill.plans import compiler
from trustmill.plans.spec import Filter, QuerySpec, from_slots

FACT = "fact_key string, stock_code string, period string, report_year int, period_ord int, statement_scope string, period_type string, metric string, table_name string, normalized_value decimal(24,4), source_key string, page_no int, validation_status string"


def fact(key, code, period, metric, value, status="VALIDATED", scope="consolidated", source=None, table=None):
    table = table or Registry().table_of_metric(metric)
    ord_ = int(period[:4]) * 10 + model.PERIODS[period[4:]]
    return key, code, period, ord_ // 10, ord_, scope, model.period_type(table), metric, table, Decimal(value), source or f"s-{code}-{period}", 1, status


def catalog(spark, facts, dropped=(), renamed=None):
    rows = [fact(*f) if isinstance(f, tuple) else f for f in facts]
    sources = {(r[10], r[1], r[2]): "CURRENT" for r in rows}
    found = [(k, (renamed or {}).get(k, c), p, "SUPERSEDED" if k in dropped else s) for (k, c, p), s in sources.items()]
    companies = sorted({(r[1], f"co{r[1]}") for r in rows})
    return compiler.Catalog(spark.createDataFrame([tuple(r) for r in rows], FACT), spark.createDataFrame(found, "source_key string, stock_code string, period string, authority_status string"), spark.createDataFrame(companies, "stock_code string, stock_abbr string"))


def test_an_unreviewed_value_never_outranks_a_reviewed_one(spark):
    c = catalog(spark, [("a", "000001", "2024FY", "net_profit", 999, "NEEDS_REVIEW"), ("b", "000002", "2024FY", "net_profit", 100)])
    top = QuerySpec("topn_metric", "net_profit", report_period="2024FY", top_n=1, select_fields=("stock_code", "net_profit"))
    assert compiler.run(top, c, timeout_s=None) == [{"stock_code": "000002", "net_profit": Decimal("100.0000")}]
    big = QuerySpec("filter", "net_profit", filters=(Filter("net_profit", ">", 50),), select_fields=("stock_code",))
    assert compiler.run(big, c, timeout_s=None) == [{"stock_code": "000002"}]


@pytest.mark.parametrize("change", ["superseded", "parent", "other company"])
def test_what_is_not_trusted_is_not_there(spark, change):
    facts = [("a", "000001", "2024FY", "net_profit", 5, "VALIDATED", "parent" if change == "parent" else "consolidated", "x"), ("b", "000002", "2024FY", "net_profit", 4)]
    c = catalog(spark, facts, dropped=["x"] if change == "superseded" else [], renamed={"x": "000009"} if change == "other company" else None)
    rows = compiler.run(QuerySpec("filter", "net_profit", select_fields=("stock_code",)), c, timeout_s=None)
    assert rows == [{"stock_code": "000002"}]


def test_two_trusted_facts_for_a_cell_are_refused(spark):
    c = catalog(spark, [("a", "000001", "2024FY", "net_profit", 5), ("b", "000001", "2024FY", "net_profit", 6)])
    with pytest.raises(compiler.Untrusted, match="conflicting"):
        compiler.run(QuerySpec("filter", "net_profit"), c, timeout_s=None)


def test_the_row_cap_refuses_and_never_cuts(spark):
    c = catalog(spark, [(str(k), f"{k:06d}", "2024FY", "net_profit", k) for k in range(1, 8)])
    assert len(compiler.run(QuerySpec("filter", "net_profit"), c, max_rows=7, timeout_s=None)) == 7
    with pytest.raises(compiler.Untrusted, match="more than 6"):
        compiler.run(QuerySpec("filter", "net_profit"), c, max_rows=6, timeout_s=None)


def test_top_n_is_a_bounded_sort(spark):
    c = catalog(spark, [("a", "000001", "2024FY", "net_profit", 5)])
    rows, _ = compiler.compile_spec(QuerySpec("topn_metric", "net_profit", report_period="2024FY"), c)
    assert "TakeOrderedAndProject" in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "bad",
    [
        {"analysis_type": "drop", "metric": "roe"}, {"analysis_type": "trend", "metric": ""}, {"analysis_type": "trend", "metric": "roe", "top_n": 0}, {"analysis_type": "trend", "metric": "roe", "top_n": 101}, {"analysis_type": "trend", "metric": "roe", "top_n": True},
        {"analysis_type": "trend", "metric": "roe", "metrics": ["net_profit"]}, {"analysis_type": "trend", "metric": "roe", "report_period": "2024Q4"}, {"analysis_type": "trend", "metric": "roe", "sql": "x"}, {"analysis_type": "trend", "metric": "roe", "metrics": "roe"},
        {"analysis_type": "filter", "metric": "roe", "filters": [{"field": "roe", "op": ">", "value": "1"}]}, {"analysis_type": "filter", "metric": "roe", "filters": [{"field": "roe", "op": ">", "value": float("nan")}]},
    ],
)
def test_bad_specs(bad):
    with pytest.raises((SpecError, TypeError)):
        QuerySpec.of(bad)


@pytest.mark.parametrize("spec", [QuerySpec("trend", "password"), QuerySpec("trend", "roe", select_fields=("secret",)), QuerySpec("trend", "roe", table="financial_fact"), QuerySpec("filter", "roe", filters=(Filter("roe", "LIKE", 1),))])
def test_unknown_names(spec):
    with pytest.raises(SpecError):
        spec.check(Registry())


def test_slots():
    spec = from_slots("topn_metric", {"metric": "roe", "report_period": "2024FY", "top_n": 3})
    assert spec.select_fields == ("stock_code", "stock_abbr", "roe", "report_period") and spec.table == "core_performance_indicators_sheet"
    with pytest.raises(SpecError):
        from_slots("filter", {"metric": "roe"})


ROWS = "stock_code string, stock_abbr string, report_period string, profit double, net double"


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


class Spec:
    def __init__(self, *metrics, top_n=10, calculation=None):
        self.metrics, self.metric, self.top_n, self.calculation = metrics, metrics[0], top_n, calculation


def empty(violations):
    return [k for k, v in violations.items() if v.count()]


def test_above_industry_mean(spark):
    data = rows(spark, [("001", "a", "2024FY", 10.0, 3.0), ("002", "b", "2024FY", 30.0, 4.0), ("003", "c", "2024FY", 40.0, None)])
    got, bad = post_compute.above_industry_mean(data, Spec("profit", "net"))
    assert [r.stock_code for r in got.collect()] == ["002"] and empty(bad) == []
    assert empty(post_compute.above_industry_mean(data.filter("net IS NULL"), Spec("net"))[1]) == ["mean_without_values"]


def test_period_comparison(spark):
    data = rows(spark, [("001", "a", "2024FY", 120.0, 1.0), ("001", "a", "2023FY", 100.0, 1.0), ("002", "b", "2024FY", 50.0, 1.0), ("002", "b", "2023FY", 40.0, 1.0), ("003", "c", "2023FY", 0.0, 1.0), ("003", "c", "2024FY", 5.0, 1.0), ("004", "d", "2023FY", -10.0, 1.0), ("004", "d", "2024FY", -5.0, 1.0)])
    got, bad = post_compute.period_comparison(data, Spec("profit"))
    found = {r.stock_code: (r.profit_absolute_change, r.profit_change_pct) for r in got.collect() if r.report_period == "2024FY"}
    assert found == {"001": (20, 20), "002": (10, 25), "003": (5, None), "004": (5, 50)} and empty(bad) == []
    assert [tuple(r) for r in post_compute.zero_bases(got, ["profit"]).collect()] == [("003", "2024FY", "profit", "zero_base")]
    assert empty(post_compute.period_comparison(rows(spark, [("1", "a", "2024Q4", 1.0, 1.0)]), Spec("profit"))[1]) == ["period_or_value_missing"]


def test_ratio(spark):
    calc = {"numerator": "profit", "denominator": "net", "output_field": "r"}
    got, bad = post_compute.ratio(rows(spark, [("001", "a", "2024FY", 100.0, 20.0)]), Spec("profit", "net", calculation=calc))
    assert got.first().r == 5 and empty(bad) == []
    assert empty(post_compute.ratio(rows(spark, [("001", "a", "2024FY", 100.0, 0.0)]), Spec("profit", "net", calculation=calc))[1]) == ["undefined_ratio"]


def test_intersection_topn(spark):
    data = rows(spark, [("001", "a", "2024FY", 100.0, 20.0), ("002", "b", "2024FY", 90.0, 80.0), ("003", "c", "2024FY", 80.0, 70.0)])
    got, bad = post_compute.intersection_topn(data, Spec("profit", "net", top_n=2))
    assert [r.stock_code for r in got.collect()] == ["002"] and empty(bad) == []
    assert empty(post_compute.intersection_topn(data.unionByName(data), Spec("profit", "net", top_n=2))[1]) == ["company_not_unique"]
    assert empty(post_compute.intersection_topn(data, Spec("profit"))[1]) == ["needs_two_metrics"]
    assert empty(post_compute.intersection_topn(rows(spark, [("1", "a", "2024FY", float("nan"), 1.0)]), Spec("profit", "net"))[1]) == ["not_finite"]
