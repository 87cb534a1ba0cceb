"""What shows on larger tables only: values at a tie, keys that meet, work that must stay bounded for a task."""

import random

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T
from trustmill.functions import numbers as nu
from trustmill.operators import companies, extraction
from trustmill.plans import dialogue as dl
from trustmill.queries import ORACLES, QUERIES
from trustmill.sources import testdata


def test_two_places_are_those_of_the_binary_value(spark):
    rnd = random.Random(7)
    values = [0.125, 0.375, 2.625, 1.005, 2.675, 0.995, 99.995, 999.995, -0.001, -2.5, 0.0, 1e15 + 0.125, 4503599627370495.5, 5e-324, 123456789012345680.0]
    values += [rnd.choice((-1, 1)) * (rnd.randrange(10 ** rnd.randrange(1, 12)) * 100 + 50) / 10000 for _ in range(3000)] + [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-3, 17) for _ in range(1000)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", nu.two_places(F.col("x")).alias("t")).collect()
    assert all(r.t == "%.2f" % r.x for r in got)
    con = duckdb.connect()
    assert [r.t for r in got[:200]] == [con.execute("SELECT printf('%.2f', ?::DOUBLE)", [r.x]).fetchall()[0][0] for r in got[:200]]


def test_answers_round_as_printf(spark):
    rows = spark.createDataFrame([("甲", "2023FY", 1.005), ("乙", "2023FY", 0.125), ("丙", "2023FY", None)], "stock_abbr string, report_period string, net_profit double")
    assert [r.answer for r in dl.answer_text(rows, "net_profit").collect()] == ["甲 在 2023FY 的净利润为 1.00万元。", "乙 在 2023FY 的净利润为 0.12万元。", "丙 在 2023FY 的净利润为 N/A万元。"]


def test_added_parts_meet_keys_of_the_table(spark, tmp_path):
    """Keys a million apart, as larger copies have them."""
    parts = [(k + add, f"b{k % 3}", k % 50) for k in range(0, 300, 25) for add in (0, 1_000_000, 2_000_000)]
    spark.createDataFrame(parts, T.StructType.fromDDL("p_partkey long, p_brand string, p_size int")).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, QUERIES["snk08_upsert_wide"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["snk08_upsert_wide"]).fetchall(), key=str)


def test_facts_are_dealt_before_they_are_many(spark, sf_dir):
    """Each task holds one bucket, and the rows are those of the plain table."""
    plain, dealt = testdata.derived_facts(spark, sf_dir), testdata.derived_facts(spark, sf_dir, 16)
    assert dealt.filter(F.pmod(F.hash(*testdata.TRUST_KEY), F.lit(16)) != F.spark_partition_id()).isEmpty()
    assert plain.schema == dealt.schema and plain.count() == dealt.count() and plain.exceptAll(dealt).isEmpty()
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(array(struct(no") < plan.index("RepartitionByExpression")  # above it, so later
    assert testdata.BUCKET_BYTES <= 16 << 20


def test_parts_of_names_are_cut_by_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(companies, "CUT", 5)
    known = spark.createDataFrame([(f"{k:06d}", f"名{k}", f"公司{k}号药业") for k in range(100)], "stock_code string, stock_abbr string, company_name string")
    index = companies.name_index(known, [2, 4])
    assert ", 20)" in next(x for x in index._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in x)
    want = {(r.part, r.stock_code) for r in companies.name_index(known).collect() if len(r.part) in (2, 4)}
    assert {tuple(r) for r in index.select("part", "stock_code").collect()} == want and want


def test_a_section_is_searched_once_for_each_heading(spark):
    made = spark.range(1).select(extraction.section(F.col("id").cast("string"), "income_sheet").alias("s"))._jdf.queryExecution().analyzed().toString()
    assert 0 < made.count("aggregate(") <= sum(len(words) for words in extraction.SECTIONS.values())
