"""Queries over trusted facts: the compiler, its predicates and orders, and the calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.model import AMOUNT
from trustmill.operators import post_compute
from trustmill.plans.compiler import Catalog, plan, trusted_facts
from trustmill.plans.spec import Filter, QuerySpec
from trustmill.sources import testdata

from .registry import catalog, query


def _rows(spark: SparkSession, sf_dir: str, spec: QuerySpec) -> DataFrame:
    return plan(spec, catalog(spark, sf_dir))[0]


def _one(metric: str, where: str = "TRUE") -> str:
    return f"(SELECT stock_code, period, report_year, period_ord, normalized_value AS {metric} FROM trusted WHERE metric = '{metric}' AND {where})"


TOP10 = f"SELECT stock_code, stock_abbr, total_profit::DOUBLE AS total_profit FROM {_one('total_profit', chr(39).join(['period = ', '1999FY', '']))} t JOIN company USING (stock_code) ORDER BY total_profit DESC, stock_code LIMIT 10"


@query(TOP10, facts=True)
def trusted_topn(spark, sf_dir):
    """PRJ-01, FLT-01, FLT-05, JON-02, JON-03, SRT-02, SRT-03."""
    return _rows(spark, sf_dir, QuerySpec("topn_metric", "total_profit", report_period="1999FY", select_fields=("stock_code", "stock_abbr", "total_profit")))


@query(f"SELECT stock_abbr, period AS report_period, net_profit::DOUBLE AS net_profit FROM {_one('net_profit', chr(39).join(['period = ', '1998Q2', ' AND stock_code = ', '600007', '']))} JOIN company USING (stock_code)", facts=True)
def flt01_single_metric(spark, sf_dir):
    return _rows(spark, sf_dir, QuerySpec("single_metric", "net_profit", stock_code="600007", report_period="1998Q2"))


@query(f"SELECT period AS report_period, report_year::BIGINT AS report_year, stock_abbr, total_operating_revenue::DOUBLE AS total_operating_revenue FROM {_one('total_operating_revenue', 'period_ord BETWEEN 19962 AND 19993')} JOIN company USING (stock_code) WHERE stock_abbr = 'Supplier#000000003'", facts=True)
def flt03_srt01_trend(spark, sf_dir):
    return _rows(spark, sf_dir, QuerySpec("trend", "total_operating_revenue", stock_abbr="Supplier#000000003", start_period="1996Q2", end_period="1999Q3", select_fields=("report_period", "report_year", "stock_abbr", "total_operating_revenue")))


@query(f"SELECT stock_code, period AS report_period, operating_cf_net_amount::DOUBLE AS operating_cf_net_amount FROM {_one('operating_cf_net_amount', chr(39).join(['period = ', '2000FY', '']))} JOIN company USING (stock_code) WHERE operating_cf_net_amount < 0", facts=True)
def flt04_srt02_filter(spark, sf_dir):
    return _rows(spark, sf_dir, QuerySpec("filter", "operating_cf_net_amount", report_period="2000FY", filters=(Filter("operating_cf_net_amount", "<", 0),), select_fields=("stock_code", "report_period", "operating_cf_net_amount")))


@query(f"SELECT stock_code, period AS report_period, net_profit::DOUBLE AS net_profit FROM {_one('net_profit')} JOIN company USING (stock_code) WHERE period IN ('1997Q1', '1998Q1', '1999FY')", facts=True)
def flt02_period_in(spark, sf_dir):
    return _rows(spark, sf_dir, QuerySpec("comparison", "net_profit", periods=("1997Q1", "1998Q1", "1999FY"), select_fields=("stock_code", "report_period", "net_profit")))


@query(f"SELECT stock_code, a.net_profit::DOUBLE AS net_profit, b.asset_inventory::DOUBLE AS asset_inventory FROM {_one('net_profit')} a JOIN {_one('asset_inventory')} b USING (stock_code, period) JOIN company USING (stock_code) WHERE period = '1997FY' AND asset_inventory >= 500", facts=True)
def jon01_cross_statement(spark, sf_dir):
    return _rows(spark, sf_dir, QuerySpec("filter", "net_profit", ("net_profit", "asset_inventory"), report_period="1997FY", filters=(Filter("asset_inventory", ">=", 500),), select_fields=("stock_code", "net_profit", "asset_inventory")))


@query(f"SELECT stock_code, stock_abbr, period AS report_period, total_profit::DOUBLE AS total_profit FROM {_one('total_profit')} JOIN company USING (stock_code) ORDER BY period_ord, stock_code LIMIT 20", facts=True)
def srt03_reason(spark, sf_dir):
    return _rows(spark, sf_dir, QuerySpec("reason", "total_profit", select_fields=("stock_code", "stock_abbr", "report_period", "total_profit")))


@query("SELECT fact_key, stock_code, period, metric, normalized_value::DOUBLE AS normalized_value FROM trusted", facts=True)
def flt05_jon02_jon03_trusted_facts(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return trusted_facts(c.facts, c.sources).select("fact_key", "stock_code", "period", "metric", "normalized_value")


@query("SELECT fact_key, validation_status, stock_code, period FROM fact WHERE stock_code = '600005' AND validation_status = 'NEEDS_REVIEW' ORDER BY fact_key LIMIT 10 OFFSET 5", facts=True)
def flt06_fact_listing(spark, sf_dir):
    f = testdata.facts(spark, sf_dir).filter("stock_code = '600005' AND validation_status = 'NEEDS_REVIEW'")
    return f.orderBy("fact_key").offset(5).limit(10).select("fact_key", "validation_status", "stock_code", "period")


@query("SELECT stock_code, period, fact_key FROM fact WHERE metric = 'net_profit' ORDER BY fact_key LIMIT 11 OFFSET 20", facts=True)
def srt05_page(spark, sf_dir):
    return testdata.facts(spark, sf_dir).filter("metric = 'net_profit'").orderBy("fact_key").offset(20).limit(11).select("stock_code", "period", "fact_key")


@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS quantity, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL")
def src01_table_scan(spark, sf_dir):
    t = testdata.table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def src03_parameters(spark, sf_dir):
    orders = testdata.table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status ORDER BY o_orderkey LIMIT :n", args={"least": 400000, "status": "F", "n": 50}, orders=orders)


@query("SELECT stock_code, stock_abbr, company_name, industry FROM company", facts=True)
def src05_company_master(spark, sf_dir):
    return testdata.companies(spark, sf_dir)


@query("SELECT stock_code, period, source_key, authority_status FROM source", facts=True)
def src02_sources(spark, sf_dir):
    return testdata.sources(spark, sf_dir).select("stock_code", "period", "source_key", "authority_status")


# ---------------------------------------------------------------- calculations

_TWO = f"FROM {_one('total_profit')} a JOIN {_one('total_operating_revenue')} b USING (stock_code, period) JOIN company USING (stock_code) WHERE period = '1999FY'"


@query(f"+ p AS (SELECT stock_code, a.total_profit, b.total_operating_revenue {_TWO}) SELECT stock_code, total_profit::DOUBLE AS total_profit, total_operating_revenue::DOUBLE AS total_operating_revenue FROM p WHERE total_profit::DOUBLE > (SELECT avg(total_profit::DOUBLE) FROM p) AND total_operating_revenue::DOUBLE > (SELECT avg(total_operating_revenue::DOUBLE) FROM p)", facts=True)
def win03_agg05_above_industry_mean(spark, sf_dir):
    spec = QuerySpec("filter", "total_profit", ("total_profit", "total_operating_revenue"), report_period="1999FY", select_fields=("stock_code", "total_profit", "total_operating_revenue"), post_compute="above_industry_mean")
    return _rows(spark, sf_dir, spec).select("stock_code", "total_profit", "total_operating_revenue")


_LAG = f"""+ p AS (SELECT stock_code, period, period_ord, net_profit FROM {_one('net_profit')} JOIN company USING (stock_code) WHERE period IN ('1997FY', '1998FY', '1999FY')),
l AS (SELECT *, lag(net_profit) OVER (PARTITION BY stock_code ORDER BY period_ord) AS before FROM p)"""


@query(f"{_LAG} SELECT stock_code, period AS report_period, net_profit::DOUBLE AS net_profit, before::DOUBLE AS net_profit_previous_value, (net_profit - before)::DOUBLE AS net_profit_absolute_change, CASE WHEN before <> 0 THEN round((net_profit - before)::DOUBLE * 100 / abs(before)::DOUBLE, 6) END AS change_pct FROM l", facts=True)
def win01_period_comparison(spark, sf_dir):
    spec = QuerySpec("comparison", "net_profit", periods=("1997FY", "1998FY", "1999FY"), post_compute="period_comparison")
    r = _rows(spark, sf_dir, spec)
    return r.select("stock_code", "report_period", "net_profit", "net_profit_previous_value", "net_profit_absolute_change", F.col("net_profit_change_pct").alias("change_pct"))


@query(f"{_LAG} SELECT stock_code, period AS report_period, 'net_profit' AS metric, 'zero_base' AS reason FROM l WHERE before = 0", facts=True)
def win01_zero_bases(spark, sf_dir):
    spec = QuerySpec("comparison", "net_profit", periods=("1997FY", "1998FY", "1999FY"), post_compute="period_comparison")
    return post_compute.zero_bases(_rows(spark, sf_dir, spec), ["net_profit"])


@query(f"SELECT stock_code, total_profit::DOUBLE AS total_profit, round(total_profit::DOUBLE / total_operating_revenue::DOUBLE, 6) AS ratio {_TWO}", facts=True)
def win04_ratio(spark, sf_dir):
    spec = QuerySpec("filter", "total_profit", ("total_profit", "total_operating_revenue"), report_period="1999FY", post_compute="ratio", calculation={"numerator": "total_profit", "denominator": "total_operating_revenue", "output_field": "ratio"})
    return _rows(spark, sf_dir, spec).select("stock_code", "total_profit", "ratio")


@query(f"+ p AS (SELECT stock_code, a.total_profit, b.total_operating_revenue {_TWO}), r AS (SELECT *, row_number() OVER (ORDER BY total_profit DESC, stock_code) AS x, row_number() OVER (ORDER BY total_operating_revenue DESC, stock_code) AS y FROM p) SELECT stock_code, total_profit::DOUBLE AS total_profit FROM r WHERE x <= 20 AND y <= 20", facts=True)
def win02_set02_intersection_topn(spark, sf_dir):
    spec = QuerySpec("intersection_topn", "total_profit", ("total_profit", "total_operating_revenue"), report_period="1999FY", top_n=20, post_compute="intersection_topn")
    return _rows(spark, sf_dir, spec).select("stock_code", "total_profit")


@query(f"SELECT stock_code, 'total_profit' AS metric, 'undefined_ratio' AS rule {_TWO} AND total_operating_revenue = 0", facts=True)
def win06_violations(spark, sf_dir):
    spec = QuerySpec("filter", "total_profit", ("total_profit", "total_operating_revenue"), report_period="1999FY", post_compute="ratio", calculation={"numerator": "total_profit", "denominator": "total_operating_revenue", "output_field": "ratio"})
    bad = plan(spec, catalog(spark, sf_dir))[1]["undefined_ratio"]
    return bad.select("stock_code", F.lit("total_profit").alias("metric"), F.lit("undefined_ratio").alias("rule"))


@query(f"+ top AS (SELECT stock_code, period, total_profit FROM {_one('total_profit', chr(39).join(['period = ', '1999FY', '']))} JOIN company USING (stock_code) ORDER BY total_profit DESC, stock_code LIMIT 10) SELECT stock_code, period, total_profit::DOUBLE AS total_profit, fact_key, source_key, page_no::BIGINT AS page_no FROM top JOIN trusted t USING (stock_code, period) WHERE t.metric = 'total_profit' AND t.normalized_value = total_profit", facts=True)
def jon06_provenance(spark, sf_dir):
    """Every value shown again with its only fact."""
    c = catalog(spark, sf_dir)
    rows = plan(QuerySpec("topn_metric", "total_profit", report_period="1999FY", select_fields=("stock_code", "report_period", "total_profit")), c)[0]
    long = rows.withColumnRenamed("report_period", "period").unpivot(["stock_code", "period"], ["total_profit"], "metric", "value")
    found = long.join(trusted_facts(c.facts, c.sources), ["stock_code", "period", "metric"]).filter("value = normalized_value")
    return found.select("stock_code", "period", F.col("value").alias("total_profit"), "fact_key", "source_key", "page_no")


@query("SELECT stock_code, period, metric, count(*) AS n FROM trusted GROUP BY ALL HAVING count(*) > 1", facts=True)
def jon06_agg02_conflicts(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return trusted_facts(c.facts, c.sources).groupBy("stock_code", "period", "metric").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT abs(round(avg(o_totalprice), 2)) AS mean, count(*) AS n, max(o_totalprice) AS high, min(o_totalprice) AS low, coalesce(max(NULLIF(o_orderstatus, 'P')), '-') AS state, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM orders")
def agg14_mat06_functions(spark, sf_dir):
    t = testdata.table(spark, sf_dir, "orders")
    return t.agg(F.abs(F.round(F.avg("o_totalprice"), 2)).alias("mean"), F.count("*").alias("n"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.coalesce(F.max(F.nullif("o_orderstatus", F.lit("P"))), F.lit("-")).alias("state"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"))


@query(f"SELECT period AS x, total_operating_revenue::DOUBLE AS y FROM {_one('total_operating_revenue')} WHERE stock_code = '600003'", facts=True)
def snk03_snk04_chart_points(spark, sf_dir):
    r = _rows(spark, sf_dir, QuerySpec("trend", "total_operating_revenue", stock_code="600003", select_fields=("report_period", "total_operating_revenue")))
    return r.select(F.col("report_period").alias("x"), F.col("total_operating_revenue").alias("y"))


@query("SELECT stock_code, arg_min(v, o)::DOUBLE AS first, arg_max(v, o)::DOUBLE AS last, CASE WHEN arg_max(v, o) >= arg_min(v, o) THEN 'up' ELSE 'down' END AS direction, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM (SELECT stock_code, period_ord AS o, normalized_value AS v FROM trusted WHERE metric = 'net_profit') GROUP BY stock_code", facts=True)
def win08_trend_summary(spark, sf_dir):
    from trustmill.plans.dialogue import trend_summary

    c = catalog(spark, sf_dir)
    rows = trusted_facts(c.facts.filter("metric = 'net_profit'"), c.sources).select("stock_code", F.col("period").alias("report_period"), F.col("normalized_value").alias("net_profit"))
    return trend_summary(rows, "net_profit").select("stock_code", "first", "last", "direction", "low", "high")


@query(f"SELECT stock_abbr || ' 在 ' || period || ' 的利润总额为 ' || printf('%.2f', total_profit::DOUBLE) || '万元。' AS answer FROM {_one('total_profit')} JOIN company USING (stock_code) WHERE period = '1999FY'", facts=True)
def nlq07_answers(spark, sf_dir):
    from trustmill.plans.dialogue import answer_text

    r = _rows(spark, sf_dir, QuerySpec("filter", "total_profit", report_period="1999FY", select_fields=("stock_abbr", "report_period", "total_profit")))
    return answer_text(r, "total_profit")


_METRICS = ", ".join(f"'{m}'" for m, _ in testdata.DERIVED)


@query("SELECT stock_code, period, metric, normalized_value::DOUBLE AS value, fact_key, source_key FROM trusted WHERE report_year = 1999", facts=True)
def jon04_validated_projection(spark, sf_dir):
    """Cells of the wide projection with the fact and source they come from."""
    from trustmill.operators.lifecycle import projection

    c = catalog(spark, sf_dir)
    names = [m for m, _ in testdata.DERIVED]
    trusted = trusted_facts(c.facts.filter("report_year = 1999"), c.sources)
    cells = projection(trusted, names)[0].unpivot(["stock_code", "period"], names, "metric", "value").filter("value IS NOT NULL")
    return cells.join(trusted, ["stock_code", "period", "metric"]).select("stock_code", "period", "metric", "value", "fact_key", "source_key")


@query("SELECT least(count(*), 101) AS taken, count(*) > 100 AS refused FROM trusted WHERE metric = 'net_profit'", facts=True)
def srt04_row_cap(spark, sf_dir):
    """The cap is the feature: one row more than allowed is enough to refuse."""
    rows = _rows(spark, sf_dir, QuerySpec("filter", "net_profit"))
    return rows.limit(101).agg(F.count("*").alias("taken"), (F.count("*") > 100).alias("refused"))


# ---------------------------------------------------------------- rules at work on facts that break them

#: Zero revenues, zero profits of earlier years, and cells with two facts, by the company's code.
_BROKEN = """+ broken AS (SELECT * REPLACE (CASE WHEN metric = 'total_operating_revenue' AND period = '1999FY' AND stock_code::INT % 5 = 0 OR metric = 'net_profit' AND period IN ('1997FY', '1998FY') AND stock_code::INT % 7 = 0 THEN 0 ELSE normalized_value END AS normalized_value) FROM trusted
  UNION ALL SELECT * FROM trusted WHERE metric = 'asset_inventory' AND stock_code::INT % 9 = 0)"""


def _broken(spark: SparkSession, sf_dir: str) -> Catalog:
    c = catalog(spark, sf_dir)
    code, is_metric = F.col("stock_code").cast("int"), lambda m: F.col("metric") == m
    zero = is_metric("total_operating_revenue") & (F.col("period") == "1999FY") & (code % 5 == 0) | is_metric("net_profit") & F.col("period").isin("1997FY", "1998FY") & (code % 7 == 0)
    facts = c.facts.withColumn("normalized_value", F.when(zero, F.lit(0).cast(AMOUNT)).otherwise(F.col("normalized_value")))
    twice = facts.filter(is_metric("asset_inventory") & (code % 9 == 0)).withColumn("fact_key", F.concat("fact_key", F.lit("+")))
    return Catalog(facts.unionByName(twice), c.sources, c.companies)


@query(f"{_BROKEN}, p AS (SELECT stock_code, period, period_ord, normalized_value AS v FROM broken JOIN company USING (stock_code) WHERE metric = 'net_profit' AND period IN ('1997FY', '1998FY', '1999FY')), l AS (SELECT *, lag(v) OVER (PARTITION BY stock_code ORDER BY period_ord) AS before FROM p) SELECT stock_code, period AS report_period, 'net_profit' AS metric, 'zero_base' AS reason FROM l WHERE before = 0", facts=True)
def win01_zero_bases_found(spark, sf_dir):
    spec = QuerySpec("comparison", "net_profit", periods=("1997FY", "1998FY", "1999FY"), post_compute="period_comparison")
    return post_compute.zero_bases(plan(spec, _broken(spark, sf_dir))[0], ["net_profit"])


@query(f"{_BROKEN} SELECT a.stock_code, 'undefined_ratio' AS rule FROM broken a JOIN broken b USING (stock_code, period) JOIN company USING (stock_code) WHERE a.metric = 'total_profit' AND b.metric = 'total_operating_revenue' AND period = '1999FY' AND b.normalized_value = 0", facts=True)
def win06_undefined_ratios_found(spark, sf_dir):
    spec = QuerySpec("filter", "total_profit", ("total_profit", "total_operating_revenue"), report_period="1999FY", post_compute="ratio", calculation={"numerator": "total_profit", "denominator": "total_operating_revenue", "output_field": "ratio"})
    return plan(spec, _broken(spark, sf_dir))[1]["undefined_ratio"].select("stock_code", F.lit("undefined_ratio").alias("rule"))


@query(f"{_BROKEN} SELECT stock_code, period, metric, count(*) AS n FROM broken GROUP BY ALL HAVING count(*) > 1", facts=True)
def jon06_agg02_conflicts_found(spark, sf_dir):
    c = _broken(spark, sf_dir)
    return trusted_facts(c.facts, c.sources).groupBy("stock_code", "period", "metric").agg(F.count("*").alias("n")).filter("n > 1")
