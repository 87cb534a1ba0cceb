"""Company resolution: every rule, names that end alike, shards, odd texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from trustmill.operators import companies as co
from trustmill.operators.retrieval import inferred_filters

SCHEMA = "stock_code string, stock_abbr string, company_name string"
COMPANIES = [
    ("600080", "金花股份", "金花企业股份有限公司"), ("000999", "华润三九", "华润三九医药股份有限公司"), ("002275", "桂林三金", "桂林三金药业股份有限公司"), ("000002", "万科A", "万科企业股份有限公司"),
    ("600031", "三一", "三一重工股份有限公司"), ("300147", "香雪制药", "广州市香雪制药股份有限公司"), ("000001", None, "平安银行股份有限公司"), ("000003", "", None),
]


def brute(text, companies):
    """The same rules, company by company."""
    rows = sorted(companies)
    by_code = {c: c for c, _, _ in rows}
    text = text or ""
    for size in (6, 3):
        for m in re.finditer(rf"(?<!\w)[0-9]{{{size}}}(?!\w)", text):
            if m[0].zfill(6) in by_code:
                return m[0].zfill(6)
    for k in (1, 2):
        for row in rows:
            if row[k] and row[k] in text:
                return row[0]
    mark = re.search("企业名称[:：]([^，,]*)", text)
    for part in ([mark[1].strip()] if mark else []) + sorted(re.findall("[一-鿿]{2,}", text), key=len, reverse=True):
        hits = [r[0] for r in rows if part and (part in (r[1] or "") or part in (r[2] or ""))]
        if len(hits) == 1:
            return hits[0]
    return None


TEXTS = ["代码 600080 如何", "600080的利润", "999", "请问 999，谢谢", "1 和 003", "请问 万科A 的利润", "三一 2024年净利润", "企业名称：三金", "企业名称:  三金 ,利润", "企业名称：不存在制药，2024年营业收入是多少？", "华润三九医药的利润", "平安银行股份有限公司", "重工 如何", "有限公司", "股份有限公司的香雪", "", None, "x", "123456 002275 600031", "a999 000999b", "金花股份与三一", "三金药业 重工"]


@pytest.mark.parametrize("shard", [50_000, 3])
def test_rules(spark, monkeypatch, shard):
    monkeypatch.setattr(co, "SHARD", shard)
    known = spark.createDataFrame(COMPANIES, SCHEMA)
    asked = spark.createDataFrame([(k, t, "old", 1) for k, t in enumerate(TEXTS)], "id int, text string, stock_code string, part int")
    found = co.resolve_companies(asked, known)
    assert found.columns == ["id", "text", "part", "stock_code"]
    got = {r.id: r.stock_code for r in found.collect()}
    assert got == {k: brute(t, COMPANIES) for k, t in enumerate(TEXTS)}
    assert got[2] == "000999" and got[5] == "000002" and got[6] == "600031" and got[7] == "002275" and got[9] is None


def test_random_names_against_brute_force(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("甲乙丙丁") for _ in range(n))
    rows = [(f"{k:06d}", word(r.randint(1, 3)) if k % 5 else None, word(r.randint(2, 5)) + "公司") for k in range(60)]
    texts = [" ".join(r.choice([word(r.randint(1, 6)), f"{r.randint(0, 99):03d}", "公司", "企业名称：" + word(2) + "，"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    got = co.resolve_companies(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string"), spark.createDataFrame(rows, SCHEMA))
    assert {x.id: x.stock_code for x in got.collect()} == {k: brute(t, rows) for k, t in enumerate(texts)}


def test_many_companies_that_end_alike(spark):
    """A hundred thousand names, two shards: an ending that all have names none, a part of one names it."""
    n = 100_000
    digits = lambda c: F.translate(F.lpad(c.cast("string"), 6, "0"), "0123456789", "零一二三四五六七八九")
    known = spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.concat(F.lit("牌"), digits(F.col("id"))).alias("stock_abbr"), F.concat(digits(F.col("id")), F.lit("集团股份有限公司")).alias("company_name"))
    asked = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("问"), digits(F.col("id")), F.lit("集"))).when(F.col("id") % 3 == 1, "股份有限公司").otherwise(F.concat(F.lit("牌"), digits(F.col("id")), F.lit("好"))).alias("text"))
    began = time.time()
    got = co.resolve_companies(asked, known).groupBy(F.col("id") % 3).agg(F.count("stock_code"), F.count_if(F.col("stock_code").cast("int") == F.col("id"))).collect()
    assert time.time() - began < 120
    # a run with a character before it is no part of a name
    assert sorted(map(tuple, got)) == [(0, 0, 0), (1, 0, 0), (2, 6666, 6666)]


def test_filters_of_questions(spark):
    known = spark.createDataFrame([(*c, i) for c, i in zip(COMPANIES, ["医药", "中药", "中药材", "地产", "机械", "医药", "银行", "银行"])], SCHEMA + ", industry string")
    asked = spark.createDataFrame([(1, "三一 的 机械"), (2, "中药材的行业"), (3, "999 医药")], "query_id int, query string")
    assert {r.query_id: (r.company, r.industry) for r in inferred_filters(asked, known).collect()} == {1: ("600031", "机械"), 2: (None, "中药材"), 3: ("000999", "医药")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([("三一",)], "text string")
    assert co.resolve_companies(asked, none).first().stock_code is None
    assert co.resolve_companies(asked.limit(0), spark.createDataFrame(COMPANIES, SCHEMA)).count() == 0
