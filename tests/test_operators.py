"""Functions and operators on literal rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trustmill.functions import numbers as nu
from trustmill.functions import periods as pe
from trustmill.functions import text as tx
from trustmill.operators import evaluation as ev
from trustmill.operators import extraction as ex
from trustmill.operators import lifecycle as life
from trustmill.operators import quality as ql
from trustmill.operators import retrieval as rt
from trustmill.plans import dialogue as dl
from trustmill.sources import inputs, versions
from trustmill.streaming import events as st


def of(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "source", "target", "want"), [("(1,234.50)", "元", "元", "-1234.5"), ("31,401,852.36", "元", "万元", "3140.1852"), ("12.5%", "%", "%", "12.5"), ("--", "元", "元", None), ("x", "元", "元", None), ("1e16", "元", "元", None), ("5", "万元", "元", "50000"), (None, "元", "元", None)])
def test_parse(spark, raw, source, target, want):
    got = of(spark, raw, lambda x: nu.parse(x, F.lit(source), F.lit(target)))
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("raw", "want"), [("1,234.5", "1234.5"), ("1234", "1234"), ("12,34", None), (" 1", None), ("—", None), ("(5)", None)])
def test_parse_strict(spark, raw, want):
    got = of(spark, raw, nu.parse_strict)
    assert got == (None if want is None else Decimal(want))


def test_ungrouped_integers_fall_apart(spark):
    assert of(spark, "1234567 and -12.5", nu.numbers) == ["123", "456", "7", "-12.5"]


def test_tokens(spark):
    assert of(spark, "营业收入 ab a 12 利润 3", tx.tokens) == ["营业收入", "营业", "业收", "收入", "ab", "12", "利润"]


@pytest.mark.parametrize(("title", "want"), [("甲：2024 年第一季度报告.pdf", "2024Q1"), ("2023年半年度报告摘要", "2023Q2"), ("2023年三季度", "2023Q3"), ("2022年年报", "2022FY"), ("2022-03-01", None)])
def test_title_periods(spark, title, want):
    assert of(spark, title, lambda x: pe.from_title(x, F.lit(""))) == want


@pytest.mark.parametrize(
    ("question", "context", "want"),
    [
        ("2021年至2023年三季度", {}, {"start_period": "2021Q1", "end_period": "2023Q3"}), ("2023年一季度和2022年年报", {}, {"periods": ["2022FY", "2023Q1"], "start_period": "2022FY", "end_period": "2023Q1"}), ("2023年上半年", {}, {"report_period": "2023Q2"}), ("2023年", {}, {"report_period": "2023FY"}),
        ("去年", {"report_period": "2023Q2"}, {"report_period": "2022FY"}), ("去年", {}, {"needs_period_anchor": True}), ("近三年", {"end_period": "2023Q3"}, {"start_period": "2021Q1", "end_period": "2023Q3"}), ("前三季度", {"report_period": "2023FY"}, {"report_period": "2023Q3"}), ("上半年", {}, {"needs_period_anchor": True}), ("利润", {}, {}),
    ],
)
def test_resolve_periods(question, context, want):
    assert pe.resolve(question, context) == want


@pytest.mark.parametrize(("question", "want"), [("top 300", 100), ("TOP5", 5), ("前三名", 3), ("前三季度", 3), ("最高", 10)])
def test_top_n(spark, question, want):
    assert of(spark, question, tx.top_n) == want == dl.top_n_of(question)


@pytest.mark.parametrize(("question", "want"), [("超过 2.5亿元", 25000), ("低于30元", 0.003), ("大于12%", 12), ("没有", None)])
def test_threshold(spark, question, want):
    got = of(spark, question, tx.threshold)
    assert (None if got is None else float(got)) == want
    assert dl.threshold_of(question) == (None if want is None else pytest.approx(want))


def test_aliases_and_uris():
    assert tx.field_aliases("营业总支出-研发费用（万元）")[-1] == "研发费用"
    assert tx.dataset_uri("/d/a b/c.pdf", "/d") == "dataset:///a%20b/c.pdf"
    with pytest.raises(ValueError):
        tx.dataset_uri("/d/../x", "/d")


def test_snapshot_of_a_quarter_line(spark):
    text = "项目 本报告期 营业收入 142,615,399.97 -17.55 利润总额 31,401,852.36 35.31 归属于上市公司股东的净利润 28,286,232.43 32.75"
    r = ex.snapshot(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.revenue, r.revenue_yoy) == (Decimal("142615399.97"), Decimal("-17.55"))
    assert (r.total_profit, r.total_profit_yoy) == (Decimal("31401852.36"), Decimal("35.31"))
    assert (r.net_profit, r.net_profit_yoy) == (Decimal("28286232.43"), Decimal("32.75"))
    assert r.eps is None


def test_field_values(spark):
    df = spark.createDataFrame([("存货\n\n 1,200 3\n净利润 5 6",), ("甲存货乙",), (None,)], "text string")
    got = [r["values"] for r in ex.field_values(df, ["存货"]).collect()]
    assert got == [[1200.0], [], []]
    chosen = df.select(ex.choose(F.array(F.lit(5000.0), F.lit(12.0)), "growth").alias("g"), ex.choose(F.array(F.lit(-7.0), F.lit(3.0)), "amount").alias("a")).first()
    assert (chosen.g, chosen.a) == (12.0, -7.0)


def test_chunks(spark):
    text = "甲" * 200 + "。" + "乙" * 100 + "！丙；" + "丁" * 300
    assert [len(c) for c in of(spark, text, rt.chunks)] == [200, 102, 300]


def test_search_order_and_quotes(spark):
    pages = spark.createDataFrame([("b", "/b", 2, "利润 增长"), ("a", "/a", 3, "利润 增长"), ("a", "/a", 1, "利润 增长"), ("n", "/n", None, "利润 增长"), ("z", "/z", 1, "无关")], "title string, paper_path string, page_no int, text string")
    got = rt.search(pages, spark.createDataFrame([(1, "利润增长")], "query_id long, query string")).orderBy("rank").collect()
    assert [(r.paper_path, r.page_no) for r in got] == [("/a", 1), ("/a", 3), ("/b", 2)]
    assert rt.search(pages, spark.createDataFrame([(1, "什么")], "query_id long, query string")).count() == 0
    held = rt.verified(spark.createDataFrame([("/a", 1, "增长"), ("/a", 9, "增长")], "paper_path string, page_no int, quote string"), pages)
    assert sorted(r.holds for r in held.collect()) == [False, True]


def test_search_with_vectors(spark):
    pages = spark.createDataFrame([("a", "/a", 1, "x y", [1.0, 0.0]), ("b", "/b", 1, "x y", [0.0, 1.0])], "title string, paper_path string, page_no int, text string, embedding array<double>")
    got = rt.search(pages, spark.createDataFrame([(1, "zz", [0.0, 2.0])], "query_id long, query string, embedding array<double>")).collect()
    assert [(r.paper_path, r.score) for r in got] == [("/b", 0.3)]


def test_evidence_filter_guards():
    with pytest.raises(ValueError):
        rt.EvidenceFilter(published_from="2024-02-01", published_to="2024-01-01")
    with pytest.raises(ValueError):
        rt.EvidenceFilter(published_on="2024-13-01")


REPORT = "path string, stock_code string, period string, in_master boolean, is_summary boolean, is_english boolean, revision string, published_date string, copy_index int"


def test_authority(spark):
    rows = [("old", "1", "p", True, False, False, "original", "20240101", 0), ("sum", "1", "p", True, True, False, "original", None, 0), ("pre", "1", "p", True, False, False, "pre_revision", None, 0), ("late", "1", "p", True, False, False, "original", "20240301", 0), ("rev", "1", "p", True, False, False, "revised", None, 0), ("x", "2", "p", True, False, False, "original", None, 0), ("y", "2", "p", True, False, False, "original", None, 0), ("z", "2", "p", True, False, False, "original", None, 1), ("out", "3", "p", False, False, False, "original", None, 0)]
    got = {r.path: r.status for r in life.select_authoritative(spark.createDataFrame(rows, REPORT)).collect()}
    assert got == {"old": "superseded", "sum": "skipped_summary", "pre": "superseded", "late": "superseded", "rev": "selected", "x": "needs_review", "y": "needs_review", "z": "superseded", "out": "needs_review"}


def test_regions_and_routing_sample(spark):
    df = spark.createDataFrame([(" ab cde \n\n" + "x" * 5, [f"p{k}" for k in range(1, 6)] + ["利润表"] + [f"p{k}" for k in range(7, 15)]), (None, [])], "text string, pages array<string>")
    got = df.select(inputs.regions(F.col("text"), 4).alias("r"), inputs.routing_sample(F.col("pages"), ("利润表",)).alias("s")).collect()
    assert [tuple(x) for x in got[0].r] == [(1, 0, "ab c"), (1, 1, "de"), (3, 0, "xxxx"), (3, 1, "x")] and got[0].s == [1, 2, 3, 5, 6, 7, 8, 13, 14]
    assert got[1].r == [] and got[1].s == []


def test_reconcile_refuses_other_owners(spark):
    old = spark.createDataFrame([("k1", "1", "p", "WEB", "CURRENT"), ("k2", "2", "p", "BATCH", "CURRENT"), ("k3", "3", "p", "BATCH", "CURRENT")], "source_key string, stock_code string, period string, source_owner string, authority_status string")
    new = spark.createDataFrame([("n1", "1", "p"), ("k2", "2", "p")], "source_key string, stock_code string, period string")
    decided, conflicts = life.reconcile(old, new)
    assert sorted((r.source_key, r.status) for r in decided.collect()) == [("k2", "CURRENT"), ("k3", "REMOVED")]
    assert [r.old_key for r in conflicts.collect()] == ["k1"]


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/facts"
    df = spark.createDataFrame([(1, 5)], "k long, v long")
    assert versions.current(spark, root) is None
    versions.commit(df, root, {"negative": df.filter("v < 0")})
    with pytest.raises(ValueError, match="negative"):
        versions.commit(df.selectExpr("k", "-v AS v"), root, {"negative": df.filter("v > 0")})
    assert [tuple(r) for r in versions.read(spark, root).collect()] == [(1, 5)]
    versions.commit(df.selectExpr("k", "v + 1 AS v"), root)
    assert [tuple(r) for r in versions.read(spark, root).collect()] == [(1, 6)]
    versions.write_report(df, f"file://{tmp_path}/r", "csv")
    assert spark.read.csv(f"file://{tmp_path}/r", header=True).count() == 1


def test_field_list(spark, tmp_path):
    (tmp_path / "f.csv").write_text("table,field,cn_name,raw_type,description\na,x,甲,decimal,\na,x,甲,int,\na,1y,乙,varchar,\n")
    fields, bad = inputs.read_field_list(spark, f"file://{tmp_path}/f.csv")
    assert fields.count() == 3 and sorted(r.reason for r in bad.collect()) == ["bad_name", "duplicate"]
    assert [f.dataType.simpleString() for f in inputs.struct_of([("a", "int"), ("b", "decimal"), ("c", "varchar")])] == ["bigint", "decimal(24,4)", "string"]


def test_company_master_and_questions(spark):
    rows = spark.createDataFrame([("80", "甲", "甲公司", 1), ("80", "乙 ", None, 2), (None, "x", "y", 3)], "code string, abbr string, name string, ord int")
    assert [tuple(r) for r in inputs.company_master(rows).collect()] == [("000080", "乙", "")]
    asked = inputs.questions(spark.createDataFrame([("B1", "k", '[{"Q": "a"}, {"Q": "b"}]')], "id string, kind string, questions string"))
    assert [(r.turn, r.question) for r in asked.collect()] == [(0, "a"), (1, "b")]


def test_strict_json():
    assert inputs.strict_json('{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            inputs.strict_json(bad)


def test_inventory(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x")
    r = inputs.file_inventory(spark, f"file://{tmp_path}").first()
    assert (r.extension, r.length) == ("txt", 1)


def test_balance_and_growth(spark):
    d = Decimal
    wide = spark.createDataFrame([("1", "2024FY", d(1000), d(400), d(500), d(120), d(20)), ("1", "2023FY", d(1000), d(400), d(600), d(100), None), ("2", "2024FY", None, d(1), d(1), d(1), None)], "stock_code string, period string, asset_total_assets decimal(24,4), liability_total_liabilities decimal(24,4), equity_total_equity decimal(24,4), total_operating_revenue decimal(24,4), yoy decimal(24,4)")
    assert [tuple(r) for r in ql.balance_issues(wide).collect()] == [("1", "2024FY", Decimal("100.0000"))]
    assert ql.growth_issues(wide, "total_operating_revenue", "yoy").count() == 0
    off = wide.withColumn("yoy", F.lit(25).cast("decimal(24,4)"))
    assert ql.growth_issues(off, "total_operating_revenue", "yoy").count() == 1


def test_traceability(spark):
    facts = spark.createDataFrame([(1, "t", "r", "c"), (None, "t", "r", None)], "page_no int, table_name string, row_label string, column_label string")
    r = ql.traceability(facts).first()
    assert (r.facts, r.table_name_coverage, r.page_no_coverage, r.column_label_coverage, r.coverage) == (2, 1.0, 0.5, 0.5, 0.5)


GOLD = "record_id string, company_id string, period string, statement_scope string, period_type string, metric string, normalized_value decimal(38,18), unit string, currency string, source struct<source_file:string,page_no:int,table_name:string,row_label:string,column_label:string>"
PRED = "company_id string, period string, statement_scope string, period_type string, metric string, value decimal(38,18), unit string, currency string, source struct<source_file:string,page_no:int,table_name:string,row_label:string,column_label:string>"


def test_evaluation(spark):
    src = ("a.pdf", 1, "t", None, None)
    golden = spark.createDataFrame([("g1", "c", "p", "s", "d", "m1", Decimal("10"), "u", "CNY", src), ("g2", "c", "p", "s", "d", "m2", Decimal("5"), "u", "CNY", src)], GOLD)
    predicted = spark.createDataFrame([("c", "p", "s", "d", "m1", Decimal("10.01"), "u", "CNY", ("./a.pdf", 1, "t", "any", None))], PRED)
    facts = ev.compare_facts(golden, predicted)
    questions = spark.createDataFrame([("q1", "number", "3")], "record_id string, answer_type string, expected_answer string")
    answers = ev.compare_answers(questions, spark.createDataFrame([("q1", "3.0")], "question_id string, answer string"))
    got = {r.metric: (r.numerator, r.denominator) for r in ev.summary(facts, answers, predicted).collect()}
    assert got == {"fact_recall": (1, 2), "cell_accuracy": (1, 2), "fact_precision": (1, 1), "answer_accuracy": (1, 1), "source_accuracy": (1, 2)}
    assert [r.failure for r in facts.orderBy("record_id").collect()] == [None, "missing_prediction"]


def test_subtasks():
    got = dl.subtasks("2024年净利润多少？下降的原因？总结一下")
    assert [(t["id"], t["kind"], t["depends_on"]) for t in got] == [("s1", "sql", []), ("s2", "retrieval", ["s1"]), ("s3", "reason", ["s2"])]
    assert [t["kind"] for t in dl.subtasks("有哪些研报")] == ["retrieval", "reason"]


def test_answer_texts(spark):
    rows = spark.createDataFrame([("1", "甲", "2023FY", 5.0, 1.0), ("1", "甲", "2024FY", 7.5, None), ("2", "乙", "2024FY", 9.0, 3.0)], "stock_code string, stock_abbr string, report_period string, net_profit double, operating_revenue_yoy_growth double")
    assert dl.answer_text(rows, "net_profit").first().answer == "甲 在 2023FY 的净利润为 5.00万元。"
    trend = {r.stock_code: r.answer for r in dl.trend_text(dl.trend_summary(rows, "net_profit"), "净利润").collect()}
    assert trend["1"] == "净利润在 2023FY 至 2024FY 整体呈上升趋势。区间最小值为 5.00（2023FY），最大值为 7.50（2024FY）。最近区间数据点为 2023FY:5.00；2024FY:7.50。"
    assert dl.topn_text(rows, "net_profit", "净利润").first().answer == "乙：净利润 9.00，销售额同比 3.00%；甲：净利润 7.50，销售额同比 N/A。其中销售额同比涨幅最大的是 乙（3.00%）。"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS event_id", "timestamp_seconds(86400 + id * 60) AS ts", "id % 7 AS user_id", "concat('t', id % 3) AS event_type", "1.0D AS value", "'{}' AS props")
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    got = st.run_available(st.counts(st.stream(spark, f"file://{tmp_path}/in")), "counts_test", f"file://{tmp_path}/cp")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.counts(rows).collect()))
    st.ingest(st.once_each(st.stream(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp2")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 100
