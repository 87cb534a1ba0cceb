"""Turn analysis: slots, specs, the batch and the stream."""

import json

from pyspark.sql import functions as F

from trustmill.plans import turns
from trustmill.plans.dialogue import CLARIFY

COMPANIES = [("600080", "金花股份", "金花企业"), ("000999", "华润三九", "华润三九医药"), ("002275", "桂林三金", "桂林三金药业"), ("600332", "白云山", "白云山医药")]


def find(question):
    return next(({"stock_code": c, "stock_abbr": a} for c, a in (("600080", "金花股份"), ("000999", "华润三九")) if a in question or c in question), None)


def test_dialogue_keeps_and_clears_slots():
    one = turns.analyze("金花股份利润总额是多少", {}, find)
    assert one["clarify"] == CLARIFY["period"] and one["spec"] is None
    two = turns.analyze("2025年第三季度的", one["slots"], find)
    assert two["spec"]["metric"] == "total_profit" and two["spec"]["report_period"] == "2025Q3" and two["spec"]["stock_code"] == "600080"
    chart = turns.analyze("绘制折线图", two["slots"], find)
    assert chart["spec"]["chart_request"] == "line" and chart["spec"]["metric"] == "total_profit"
    three = turns.analyze("华润三九呢", two["slots"], find)
    assert three["clarify"] == CLARIFY["metric"] and "report_period" not in three["slots"]
    assert "report_period" in two["slots"]


def test_dialogue_specs():
    slots = turns.analyze("2024年哪些公司净利润和经营性现金流量净额且", {}, find)
    assert [(f["field"], f["op"]) for f in slots["spec"]["filters"]] == [("net_profit", ">"), ("operating_cf_net_amount", "<")]
    ratio = turns.analyze("金花股份2024年存货与营业总收入的比值", {}, find)["spec"]
    assert ratio["post_compute"] == "ratio" and ratio["calculation"]["numerator"] == "asset_inventory"
    both = turns.analyze("2024年利润总额和营业总收入均排名前5的企业", {}, find)["spec"]
    assert both["analysis_type"] == "intersection_topn" and both["post_compute"] == "intersection_topn"


def asked(question, slots=None):
    return turns.analyze(question, slots or {}, find)


def test_needs_of_each_kind():
    assert asked("2024年营业收入是多少")["clarify"] == CLARIFY["company"]
    assert asked("金花股份2024年")["clarify"] == CLARIFY["metric"]
    assert asked("去年的利润总额", {"stock_abbr": "金花股份", "stock_code": "600080"})["clarify"] == CLARIFY["period_anchor"]
    assert asked("金花股份 2024 年年度利润总额是多少")["spec"]["report_period"] == "2024FY"
    last_year = asked("去年的呢", asked("金花股份2024年净利润")["slots"])["spec"]
    assert last_year["report_period"] == "2023FY" and last_year["metric"] == "net_profit"
    ranged = asked("金花股份 2022 年至 2025 年第三季度的营业收入")["spec"]
    assert (ranged["start_period"], ranged["end_period"]) == ("2022Q1", "2025Q3")


def test_a_drawing_repeats_the_last_query_only():
    two = asked("金花股份2024年净利润")
    again = asked("华润三九绘制柱状图", two["slots"])
    assert again["spec"]["stock_code"] == "600080" and again["spec"]["chart_request"] == "bar"
    first = asked("绘制柱状图")
    assert first["spec"] is None and first["slots"]["chart_request"] == "bar"


def test_filters_of_questions():
    found = asked("2025年第三季度，资产负债率超过60%的上市公司有哪些？")
    assert found["intent"] == "filter" and found["spec"]["filters"] == [{"field": "asset_liability_ratio", "op": ">", "value": 60}]
    assert [f["op"] for f in asked("2024年净利润为负的公司有哪些")["spec"]["filters"]] == ["<"]
    assert asked("2024年净利润、营业总收入均高于行业均值的公司有哪些")["spec"]["post_compute"] == "above_industry_mean"


def conversations(spark):
    rows = [(1, 2, "2024年"), (1, 1, "金花股份净利润"), (2, 1, "2024年净利润最高的公司"), (1, 3, "华润三九呢"), (1, 4, "利润总额 2023年"), (1, 5, "绘制饼图"), (3, 1, None), (None, 1, "企业名称：三金，净利润"), (None, 2, "2024年第三季度的")]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, question string, slots string"), spark.createDataFrame(COMPANIES, "stock_code string, stock_abbr string, company_name string")


def test_conversations_fold_in_order(spark):
    asked_turns, companies = conversations(spark)
    got = {(r.conv_id, r.turn): (r.intent, r.clarify, json.loads(r.slots).get("stock_code"), (json.loads(r.spec) if r.spec else {}).get("report_period")) for r in turns.analyze_conversations(asked_turns, companies).collect()}
    assert got == {
        (1, 1): ("single_metric", CLARIFY["period"], "600080", None), (1, 2): ("single_metric", "", "600080", "2024FY"), (1, 3): ("single_metric", CLARIFY["metric"], "000999", None),
        (1, 4): ("single_metric", "", "000999", "2023FY"), (1, 5): ("single_metric", "", "000999", "2023FY"), (2, 1): ("topn_metric", "", None, "2024FY"), (3, 1): ("single_metric", CLARIFY["company"], None, None),
        (None, 1): ("single_metric", CLARIFY["period"], "002275", None), (None, 2): ("single_metric", "", "002275", "2024Q3"),
    }


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    """Turns come over several micro-batches; the slots are kept between them, and over a restart."""
    from trustmill.queries.facts import asked_turns
    from trustmill.queries.texts import named_companies

    rows = turns.with_companies(asked_turns(spark, sf_dir), named_companies(spark, sf_dir))
    rows.write.parquet(f"file://{tmp_path}/all")
    rows = spark.read.parquet(f"file://{tmp_path}/all")
    batch = sorted(map(tuple, turns.fold(rows).collect()))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(2):  # the second half comes after the query has ended once
            half = rows.filter(F.col("turn") <= 3 if part == 0 else F.col("turn") > 3)
            for k in range(2):
                low = half.filter(F.col("turn") % 4 < 2 if k == 0 else F.col("turn") % 4 >= 2)
                low.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
                source = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
                turns.fold_stream(source).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"file://{tmp_path}/out")
        assert sorted(map(tuple, got.collect())) == batch
        late = rows.filter("turn = 0").limit(1)
        late.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        turns.fold_stream(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").filter("intent = 'late'").count() == 1
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
