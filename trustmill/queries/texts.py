"""Texts: parsing, extraction, retrieval, dialogue words."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustmill.functions import issues as iss
from trustmill.functions import numbers as nu
from trustmill.functions import periods as pe
from trustmill.functions import text as tx
from trustmill.operators import companies as co
from trustmill.operators import extraction as ex
from trustmill.operators import nearest as ne
from trustmill.operators import retrieval as rt
from trustmill.operators import search_index as si
from trustmill.plans import dialogue as dl
from trustmill.sources import inputs, testdata

from .registry import query


def _docs(spark, sf_dir):
    return testdata.table(spark, sf_dir, "documents")


@query(r"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, sum(CASE WHEN l_linenumber = 2 THEN -1 WHEN l_linenumber = 3 THEN NULL ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS value FROM lineitem GROUP BY ALL")
def str01_parse_number(spark, sf_dir):
    li = testdata.table(spark, sf_dir, "lineitem")
    printed = F.format_number("l_extendedprice", 2)
    raw = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("("), printed, F.lit(")"))).when(F.col("l_linenumber") == 3, "--").otherwise(F.concat(printed, F.lit("%")))
    return li.select("l_orderkey", "l_linenumber", nu.parse(raw, F.lit("元"), F.lit("元")).alias("v")).groupBy("l_orderkey", "l_linenumber").agg(F.sum("v").alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN -o_totalprice END AS value FROM orders")
def str02_parse_strict(spark, sf_dir):
    o = testdata.table(spark, sf_dir, "orders")
    printed = F.format_number("o_totalprice", 2)
    raw = F.when(F.col("o_orderkey") % 3 == 0, printed).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("("), printed, F.lit(")"))).otherwise(F.concat(F.lit(" "), printed, F.lit(" ")))
    return o.select("o_orderkey", nu.parse_strict(raw, parentheses=True).alias("value"))


@query("SELECT o_orderkey, year(o_orderdate) || CASE quarter(o_orderdate) WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' ELSE 'FY' END AS period, (year(o_orderdate) * 10 + quarter(o_orderdate))::BIGINT AS ord FROM orders")
def str03_srt07_dat02_periods(spark, sf_dir):
    """Titles written in words, and read again."""
    q = F.quarter("o_orderdate")
    word = F.when(q == 1, "第一季度").when(q == 2, "半年度").when(q == 3, "三季度").otherwise("年度")
    o = testdata.table(spark, sf_dir, "orders").withColumn("period", pe.from_title(F.concat(F.lit("公司："), F.year("o_orderdate").cast("string"), F.lit(" 年 "), word, F.lit("报告.pdf")), F.lit("")))
    return o.select("o_orderkey", "period", pe.order_column(F.col("period")).alias("ord"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice::DECIMAL(18,2) * 10000 WHEN 1 THEN (o_totalprice::DECIMAL(18,2) * 0.0001) WHEN 2 THEN o_totalprice::DECIMAL(18,2) END::DOUBLE AS value FROM orders")
def str04_threshold(spark, sf_dir):
    o = testdata.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 4
    said = F.concat(F.lit("利润"), F.when(n == 3, "不到").otherwise("超过"), F.format_string("%.2f", "o_totalprice"), F.when(n == 0, "亿元").when(n == 1, "元").otherwise("万元"))
    return o.select("o_orderkey", tx.threshold(said).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 10 WHEN p_size > 30 THEN 3 WHEN p_size > 20 THEN 100 ELSE p_size END::BIGINT AS n FROM part")
def str05_top_n(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") > 40, "最高").when(F.col("p_size") > 30, "前三").when(F.col("p_size") > 20, F.concat(F.lit("TOP "), (F.col("p_size") + 100).cast("string"))).otherwise(F.concat(F.lit("top"), F.col("p_size").cast("string")))
    return p.select("p_partkey", tx.top_n(said).alias("n"))


@query("SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]{2,}|[0-9]{2,}'), lambda x: lower(x)), ' ') AS tokens FROM benchmark")
def str06_tokens(spark, sf_dir):
    b = testdata.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(F.transform(tx.tokens(F.col("text")), F.lower), " ").alias("tokens"))


@query("SELECT item_id, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{2,}|[0-9]{2,}'), lambda x: lower(x))))::BIGINT AS n FROM benchmark")
def arr01_distinct_tokens(spark, sf_dir):
    return testdata.table(spark, sf_dir, "benchmark").select("item_id", F.size(tx.query_tokens(F.col("text"))).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'total_profit,net_profit' WHEN 1 THEN 'total_operating_revenue' ELSE '' END AS metrics, CASE p_partkey % 3 WHEN 0 THEN 'filter' WHEN 1 THEN 'trend' ELSE 'single_metric' END AS analysis FROM part")
def str07_nlq02_metrics_in_questions(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 3
    q = p.select("p_partkey", F.when(n == 0, "哪些公司利润总额和净利润为正").when(n == 1, "营业总收入变化").otherwise("你好").alias("q")).withColumn("m", dl.metrics_in(F.col("q")))
    return q.select("p_partkey", F.array_join("m", ",").alias("metrics"), dl.analysis_column(F.col("q"), F.size("m") > 0, F.lit(0)).alias("analysis"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'horizontal_bar' WHEN 1 THEN 'bar' WHEN 2 THEN 'line' END AS chart, CASE WHEN p_partkey % 5 = 0 THEN '请补充你要查询的财务指标。' WHEN p_partkey % 5 = 1 THEN '请补充公司名称或股票代码。' ELSE '' END AS ask FROM part")
def nlq03_nlq05_clarify_and_charts(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part")
    n, m = F.col("p_partkey") % 4, F.col("p_partkey") % 5
    said = F.when(n == 0, "画水平柱状图").when(n == 1, "柱状图").when(n == 2, "趋势图").otherwise("表格")
    ask = dl.clarify_column(F.lit("single_metric"), F.lit(False), F.when(m != 1, "A"), F.when(m != 0, "roe"), F.lit("1999FY"))
    return p.select("p_partkey", dl.chart_column(said).alias("chart"), ask.alias("ask"))


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS same FROM customer")
def str08_company_names(spark, sf_dir):
    c = testdata.table(spark, sf_dir, "customer")
    n = F.col("c_custkey") % 3
    other = F.when(n == 0, F.upper(F.concat_ws(" ", F.lit(" "), "c_name"))).when(n == 1, F.concat(F.lit("x"), "c_name")).otherwise("none")
    return c.select("c_custkey", tx.compatible_names(F.col("c_name"), other).alias("same"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS key, 'a/' || p_partkey AS path, true AS same FROM part")
def str09_str10_str11_normal_forms(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.title_key(F.translate("p_name", " ", "/")).alias("key"), tx.source_path(F.concat(F.lit(".\\./a\\"), F.col("p_partkey").cast("string"))).alias("path"), tx.same_text(F.concat(F.lit(" \n"), "p_name"), F.col("p_name")).alias("same"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lpad((600000 + s_suppkey)::VARCHAR, 6, '0') END AS code FROM supplier")
def str12_stock_codes(spark, sf_dir):
    s = testdata.table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey") % 3
    code = testdata.code(F.col("s_suppkey"))
    return s.select("s_suppkey", tx.stock_code_in(F.when(n == 0, F.concat(F.lit("代码："), code, F.lit("，年报"))).when(n == 1, F.concat(code, F.lit("1"))).otherwise("000000")).alias("code"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS is_summary, o_orderkey % 3 = 0 AS is_english, CASE o_orderkey % 5 WHEN 0 THEN 'pre_revision' WHEN 1 THEN 'revised' ELSE 'original' END AS revision, strftime(o_orderdate, '%Y%m%d') AS published_date, (o_orderkey % 4)::BIGINT AS copy_index FROM orders WHERE year(o_orderdate) >= 2000 OR true")
def str14_file_name_marks(spark, sf_dir):
    o = testdata.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    date = F.concat(F.lit("20"), F.date_format("o_orderdate", "yyMMdd"))
    name = F.concat(F.lit("甲：1999年年度报告"), F.when(k % 2 == 0, "摘要").otherwise(""), F.when(k % 3 == 0, "（英文版）").otherwise(""), F.when(k % 5 == 0, "更正前").when(k % 5 == 1, "更正后").otherwise(""), F.lit("_"), date, F.lit("_x"), F.when(k % 4 > 0, F.concat(F.lit("("), (k % 4).cast("string"), F.lit(")"))).otherwise(""), F.lit(".pdf"))
    marks = tx.file_name_marks(name, F.lit(""))
    got = o.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("own"), date.alias("date"), *(v.alias(n) for n, v in marks.items()))
    return got.select("o_orderkey", "is_summary", "is_english", "revision", F.when(F.col("published_date") == F.col("date"), F.col("own")).alias("published_date"), "copy_index")


@query("SELECT doc_id, '图表 ' || doc_id || '：' || substr(source, 1, 40) AS caption FROM documents")
def str16_captions(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", tx.caption(F.concat(F.lit("前文\n图表 "), F.col("doc_id").cast("string"), F.lit("："), F.col("source"), F.lit("\n后文"))).alias("caption"))


@query("SELECT count(*) FILTER (trim(c_mktsegment) = 'BUILDING') AS buildings, count(*) FILTER (c_name LIKE '%7') AS sevens FROM customer")
def str18_trim_and_suffix(spark, sf_dir):
    return testdata.table(spark, sf_dir, "customer").agg(F.count_if(F.trim("c_mktsegment") == "BUILDING").alias("buildings"), F.count_if(F.col("c_name").endswith("7")).alias("sevens"))


@query("SELECT fact_key FROM fact", facts=True)
def str19_fact_keys(spark, sf_dir):
    return testdata.facts(spark, sf_dir).select("fact_key")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS day FROM orders")
def dat03_dates(spark, sf_dir):
    o = testdata.table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00")).otherwise("2024-13-40")
    return o.select("o_orderkey", F.try_to_date(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})(?: 00:00:00)?$", 1), "yyyy-MM-dd").alias("day"))


@query("SELECT DISTINCT period, period_type, CASE period_type WHEN 'duration' THEN make_date(report_year, 1, 1) ELSE last_day(make_date(report_year, (period_ord % 10) * 3, 1)) END AS first, last_day(make_date(report_year, (period_ord % 10) * 3, 1)) AS last FROM fact", facts=True)
def dat04_boundaries(spark, sf_dir):
    f = testdata.facts(spark, sf_dir).select("period", "period_type").distinct()
    first, last = pe.boundary(F.col("period"), F.col("period_type"))
    return f.select("period", "period_type", first.alias("first"), last.alias("last"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, abs(l_quantity - 25) <= greatest(5, 0.1 * 25) AS near FROM lineitem")
def mat04_tolerance(spark, sf_dir):
    li = testdata.table(spark, sf_dir, "lineitem")
    d = lambda x: F.lit(x).cast("decimal(18,4)")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", nu.within(F.col("l_quantity").cast("decimal(18,4)"), d("25"), d("5"), d("0.1")).alias("near"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '%' WHEN 1 THEN '万元' ELSE '元' END AS unit, CASE p_partkey % 3 WHEN 1 THEN p_retailprice ELSE p_retailprice * 10000 END::DECIMAL(18,2)::DOUBLE AS value FROM part")
def mat07_units(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 3
    unit = nu.target_unit(F.when(n == 1, "净利润(万元)").otherwise("净利润"), F.when(n == 0, "roe_yoy").otherwise("net"))
    return p.select("p_partkey", unit.alias("unit"), nu.convert(F.col("p_retailprice").cast("decimal(18,2)") * 10000, F.lit("元"), unit).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_acctbal BETWEEN -1000 AND 1000 THEN c_acctbal END AS growth, CASE WHEN c_acctbal BETWEEN 0 AND 100 THEN c_acctbal END AS ratio, CASE WHEN c_acctbal BETWEEN -1000 AND 1000 THEN '' ELSE 'invalid_growth:a_yoy' END AS issues FROM customer")
def flt09_flt10_outliers(spark, sf_dir):
    c = testdata.table(spark, sf_dir, "customer")
    v = F.col("c_acctbal")
    return c.select("c_custkey", nu.growth_or_null(v).alias("growth"), nu.ratio_or_null(v).alias("ratio"), F.array_join(nu.row_issues({"a_yoy": v, "b": F.col("c_custkey")}), ",").alias("issues"))


# ---------------------------------------------------------------- pages

@query("SELECT doc_id, (k - 1)::BIGINT AS p, list_extract(string_split(text, chr(10)), k) AS text, len(string_split(text, chr(10)))::BIGINT AS pages FROM documents, unnest(range(1, 3)) AS t(k) WHERE k <= len(string_split(text, chr(10)))")
def src09_head_pages(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("x"))
    return d.select("doc_id", F.size("x").alias("pages"), F.posexplode(F.slice("x", 1, 2)).alias("p", "text")).select("doc_id", "p", "text", "pages")


@query("SELECT doc_id, (len(x) - CASE WHEN len(x) > 1 AND trim(x[-1]) = '' THEN 1 ELSE 0 END)::BIGINT AS pages FROM (SELECT doc_id, string_split(text || chr(10), chr(10)) AS x FROM documents)")
def src10_form_feeds(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.size(inputs.pages_of(F.concat(F.replace("text", F.lit("\n"), F.lit("\f")), F.lit("\f")))).alias("pages"))
    return d


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || 'x' END AS text FROM documents")
def src11_longer_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    other = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("   "))).otherwise(F.concat("text", F.lit("x")))
    return d.select("doc_id", inputs.longer_text(F.col("text"), other).alias("text"))


@query("SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) < 80 OR doc_id % 10 = 0 AS ocr FROM documents")
def src12_needs_ocr(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", inputs.needs_ocr(F.col("text"), F.col("doc_id") % 10 == 0).alias("ocr"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || chr(10) || '§' END AS text FROM documents")
def src15_merged_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", inputs.merged_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 2, 20)).otherwise("§")).alias("text"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def src22_content_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, k::BIGINT AS line_no, p::BIGINT AS part, substr(trim(line), p * 40 + 1, 40) AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents), unnest(range(0, (length(trim(line)) + 39) // 40)) AS t(p) WHERE trim(line) <> ''")
def arr02_regions(spark, sf_dir):
    """Parts of 40 characters, so that lines of these texts do part."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(inputs.regions(F.col("text"), 40)).alias("r")).select("doc_id", "r.line_no", "r.part", F.col("r.text").alias("line"))


@query("SELECT doc_id, k::BIGINT AS page_no, floor((k - 1) / 3)::BIGINT AS page_window FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)")
def arr03_page_windows(spark, sf_dir):
    """Pages lie in one array of a document, so their places give the windows without an exchange."""
    return _docs(spark, sf_dir).select("doc_id", F.inline(inputs.page_windows(F.split("text", "\n", -1))))


@query("""WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS page FROM documents),
h AS (SELECT doc_id, k FROM p WHERE contains(page, 'tion') OR contains(page, 'heit'))
SELECT doc_id, k::BIGINT AS page_no FROM p WHERE k <= 3 OR k > n - 2 UNION SELECT p.doc_id, p.k FROM p JOIN h ON h.doc_id = p.doc_id AND p.k BETWEEN h.k - 1 AND h.k + 2""")
def arr04_routing_sample(spark, sf_dir):
    """Two word ends stand for the headings of statements."""
    sample = inputs.routing_sample(F.split("text", "\n", -1), ("tion", "heit"))
    return _docs(spark, sf_dir).select("doc_id", F.explode(sample).alias("page_no"))


@query("""SELECT c_custkey, '["a","' || c_mktsegment || '"]' AS json, c_mktsegment AS second FROM customer""")
def jsn02_issue_lists(spark, sf_dir):
    c = testdata.table(spark, sf_dir, "customer").withColumn("json", F.to_json(F.array(F.lit("a"), F.col("c_mktsegment"))))
    return c.select("c_custkey", "json", F.from_json("json", "array<string>")[1].alias("second"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 AS w, o_orderstatus AS st, o_orderpriority AS p FROM orders),
t AS (SELECT k, w, st, p, CASE w WHEN 4 THEN '{"code":"' || st || '"}' WHEN 5 THEN '[' || k WHEN 6 THEN '[' || k || ']' WHEN 7 THEN '[{"code":"a","message":"b","level":' || k || '}]' WHEN 8 THEN '[{"code":"' || st || '","message":" "}]' WHEN 3 THEN '[]'
  WHEN 2 THEN '[{"code":"' || st || '","field":null,"message":"' || p || '"},{"code":"late","field":"' || p || '","message":"m' || k || '"}]' ELSE '[{"code":"' || st || '","field":' || CASE w WHEN 0 THEN 'null' ELSE '"x"' END || ',"message":"' || p || '"}]' END AS text FROM o)
SELECT k AS o_orderkey, CASE w WHEN 4 THEN 'not a list' WHEN 5 THEN 'not JSON' WHEN 6 THEN 'not an object' WHEN 7 THEN 'unknown field' WHEN 8 THEN 'code or message is missing' ELSE '' END AS fault, CASE w WHEN 3 THEN 0 WHEN 2 THEN 2 WHEN 0 THEN 1 WHEN 1 THEN 1 END::BIGINT AS n, CASE WHEN w < 4 THEN text END AS again FROM t""")
def jsn02_issue_texts(spark, sf_dir):
    """Issue lists as texts, sound and faulty ones; the sound ones are read and written again."""
    w, st, p, key = F.col("o_orderkey") % 9, F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    one = lambda code, field, message: F.struct(code.alias("code"), field.cast("string").alias("field"), message.alias("message"))
    sound = F.when(w == 3, F.array().cast(iss.ISSUES)).when(w == 2, F.array(one(st, F.lit(None), p), one(F.lit("late"), p, F.concat(F.lit("m"), key)))).otherwise(F.array(one(st, F.when(w == 1, F.lit("x")), p)))
    text = F.when(w == 4, F.concat(F.lit('{"code":"'), st, F.lit('"}'))).when(w == 5, F.concat(F.lit("["), key)).when(w == 6, F.concat(F.lit("["), key, F.lit("]"))).when(w == 7, F.concat(F.lit('[{"code":"a","message":"b","level":'), key, F.lit("}]"))).when(w == 8, F.concat(F.lit('[{"code":"'), st, F.lit('","message":" "}]'))).otherwise(iss.write(sound))
    t = testdata.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return t.select("o_orderkey", F.coalesce(iss.fault(F.col("text")), F.lit("")).alias("fault"), F.size(iss.read(F.col("text"))).alias("n"), F.when(iss.read(F.col("text")).isNotNull(), iss.write(iss.read(F.col("text")))).alias("again"))


# ---------------------------------------------------------------- extraction

def _report_lines(spark, sf_dir):
    """A report line for each order, with a value, a growth rate and a keyword."""
    o = testdata.table(spark, sf_dir, "orders")
    line = F.concat(F.lit("合并利润表 项目 营业收入 "), F.format_number(F.col("o_totalprice") * 100, 2), F.lit(" -17.55 利润总额 "), F.format_number("o_totalprice", 2), F.lit(" 35.31 净利润 3,000"))
    return o.select("o_orderkey", "o_totalprice", line.alias("text"))


def _report_texts(spark, sf_dir):
    """A passage of a report for each order, of one of six kinds: a full table line, names to fall back to with last year's
    amounts, a passage about the industry before the company's own, implausibly small amounts, numbers without commas, nothing."""
    o = testdata.table(spark, sf_dir, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    money = lambda k: F.format_number(F.col("p") * k, 2)
    whole = lambda k: F.floor(F.col("p") * k).cast("string")
    kinds = (
        (F.lit("合并利润表 项目 营业收入 "), money(100), F.lit(" -17.55 利润总额 "), money(10), F.lit("\n35.31 归属于上市公司股东的净利润 "), money(5), F.lit(" 32.75 经营活动产生的现金流量净额  "), money(20), F.lit(" 4.5 资产负债率 41.2 基本每股收益 0.35")),
        (F.lit("营业总收入 "), money(300), F.lit(" "), money(200), F.lit(" 净利润 "), money(30), F.lit(" "), money(24), F.lit(" 经营活动产生的现金流量净额 "), money(8), F.lit(" "), money(9)),
        (F.lit("行业 营业收入 9,999,999,999.00 亿元 国家统计局 "), F.repeat(F.lit("文字"), 140), F.lit(" 本报告期 营业收入 "), money(100), F.lit(" 5.5")),
        (F.lit("营业收入 500 1.5 利润总额 "), money(1), F.lit(" 2.5 利润总额 "), money(2), F.lit(" 3.5")),
        (F.lit("营业收入"), whole(100), F.lit("元；利润总额"), F.repeat(F.lit("长"), 175), F.lit("："), money(1)),
        (F.lit("无数据 营业收入 利润总额"),),
    )
    text = F.lit(None).cast("string")
    for k, parts in enumerate(kinds):
        text = F.when(F.col("o_orderkey") % len(kinds) == k, F.concat(*parts)).otherwise(text)
    return o.select("o_orderkey", text.alias("text"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT)::VARCHAR AS w, format('{:,.2f}', o_totalprice) AS f FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN p * 100 WHEN 1 THEN p * 300 WHEN 2 THEN CASE WHEN p >= 10000 THEN p * 100 ELSE 9999999999 END WHEN 3 THEN 500 WHEN 4 THEN left(w, 3)::INT END::DOUBLE AS revenue,
CASE k WHEN 0 THEN -17.55 WHEN 1 THEN 50 WHEN 2 THEN CASE WHEN p >= 10000 THEN 5.5 END WHEN 3 THEN 1.5 WHEN 4 THEN substr(w, 4, 3)::INT END::DOUBLE AS revenue_yoy,
CASE k WHEN 0 THEN p * 10 WHEN 3 THEN p * 2 WHEN 4 THEN regexp_extract(f, '^[0-9]{1,3}', 0)::INT END::DOUBLE AS total_profit,
CASE k WHEN 0 THEN 35.31 WHEN 3 THEN 3.5 WHEN 4 THEN CASE WHEN p < 10000 THEN substr(f, 3, 2)::INT WHEN p < 100000 THEN substr(f, 4, 1)::INT END END::DOUBLE AS total_profit_yoy, CASE k WHEN 0 THEN p * 5 WHEN 1 THEN p * 30 END::DOUBLE AS net_profit, CASE k WHEN 0 THEN 32.75 WHEN 1 THEN 25 END::DOUBLE AS net_profit_yoy,
CASE k WHEN 0 THEN p * 20 WHEN 1 THEN p * 8 END::DOUBLE AS operating_cf, CASE k WHEN 0 THEN 4.5 END::DOUBLE AS operating_cf_yoy, CASE k WHEN 0 THEN 41.2 END::DOUBLE AS asset_liability_ratio, CASE k WHEN 0 THEN 0.35 END::DOUBLE AS asset_liability_ratio_yoy, CASE k WHEN 0 THEN 0.35 END::DOUBLE AS eps, NULL::DOUBLE AS eps_yoy FROM o""")
def ext01_ext02_ext03_snapshot(spark, sf_dir):
    return ex.snapshot(_report_texts(spark, sf_dir)).drop("text")


@query("SELECT o_orderkey, '利润表 营业总收入 净利润 1' || o_orderkey || ' ' AS section, 'income_sheet,balance_sheet' AS statements FROM orders")
def ext04_ext10_mat05_sections(spark, sf_dir):
    o = testdata.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("目录 利润表 资产负债表 正文 利润表 营业总收入 净利润 1"), F.col("o_orderkey").cast("string"), F.lit(" 资产负债表 存货"))
    t = o.select("o_orderkey", text.alias("t"))
    return t.select("o_orderkey", ex.section(F.col("t"), "income_sheet").alias("section"), F.array_join(ex.statements_in(F.col("t")), ",").alias("statements"))


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders")
def ext05_ext06_ext07_field_values(spark, sf_dir):
    found = ex.field_values(_report_lines(spark, sf_dir), ["利润总额"])
    return found.select("o_orderkey", ex.choose(F.col("values"), "amount").alias("amount"))


@query("SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) * 0.01)::DOUBLE AS total_operating_revenue, (o_totalprice::DECIMAL(18,2) * 100)::DOUBLE AS net_cash_flow FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, NULL FROM orders WHERE o_orderkey % 2 = 1")
def ext08_overlay(spark, sf_dir):
    """Orders of odd keys have no snapshot."""
    o = testdata.table(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("decimal(24,4)"))
    nothing = F.lit(None).cast("decimal(24,4)")
    row = ex.overlay({"total_operating_revenue": F.lit(1).cast("decimal(24,4)"), "net_cash_flow": nothing}, {"revenue": amount, "operating_cf": amount})
    return o.select("o_orderkey", *(v.alias(n) for n, v in row.items()))


@query("SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS metric, unnest([p_size::DOUBLE, p_retailprice]) AS value, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence FROM part")
def ext09_to_facts(spark, sf_dir):
    p = testdata.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, 1).alias("page_no"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return ex.to_facts(p, ["p_size", "p_retailprice"]).select("p_partkey", "metric", "value", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT doc_id AS doc, min(k)::BIGINT AS page_no FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'tion') OR contains(line, 'ung') GROUP BY doc_id")
def jon14_source_pages(spark, sf_dir):
    d = _docs(spark, sf_dir)
    pages = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("k", "text")).select("doc", (F.col("k") + 1).alias("page_no"), "text")
    fields = d.select(F.col("doc_id").alias("doc"), F.lit("f").alias("field"), F.array(F.lit("tion"), F.lit("ung")).alias("aliases"))
    return ex.source_page(fields, pages).select("doc", "page_no")


#: Company names of the test tables: numbers in Chinese digits, so short names are parts of others, and all full names end alike.
_DIGITS = ("0123456789", "零一二三四五六七八九")
_COMPANY = f"""c AS (SELECT lpad((s_suppkey + 1)::VARCHAR, 6, '0') AS stock_code, translate(lpad(s_suppkey::VARCHAR, 2, '0'), '{_DIGITS[0]}', '{_DIGITS[1]}') AS stock_abbr,
      n_name || translate(lpad(s_suppkey::VARCHAR, 2, '0'), '{_DIGITS[0]}', '{_DIGITS[1]}') || '药业' || translate((s_suppkey * 7 % 1000)::VARCHAR, '{_DIGITS[0]}', '甲乙丙丁戊己庚辛壬癸') || '股份有限公司' AS company_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def named_companies(spark, sf_dir):
    """stock_code, stock_abbr, company_name."""
    number = F.translate(F.lpad(F.col("s_suppkey").cast("string"), 2, "0"), *_DIGITS)
    town = F.translate((F.col("s_suppkey") * 7 % 1000).cast("string"), _DIGITS[0], "甲乙丙丁戊己庚辛壬癸")
    s = testdata.table(spark, sf_dir, "supplier").join(testdata.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.lpad((F.col("s_suppkey") + 1).cast("string"), 6, "0").alias("stock_code"), number.alias("stock_abbr"), F.concat("n_name", number, F.lit("药业"), town, F.lit("股份有限公司")).alias("company_name"))


#: Ways to name a company, by a part's number modulo their count: SQL of a text about (stock_code, stock_abbr, company_name).
_WAYS = (
    "'请问 ' || stock_code || ' 的利润'", "'代码' || stock_code || '在汉字之间'", "'看 ' || right(stock_code, 3) || '，谢谢'", "stock_abbr || '2024年净利润'",
    "'请问' || company_name || '的利润'", "'企业名称：' || substr(company_name, strpos(company_name, '药业'), 4) || '，利润'", "'业绩 ' || substr(company_name, strpos(company_name, '药业') + 1, 4)",
    "'企业名称:不存在制药,利润'", "'有限公司 的 股份有限公司'", "'与 ' || right(stock_code, 3) || ' 相比，' || stock_abbr || '和000002如何'",
)


@query(rf"""WITH {_COMPANY}, n AS (SELECT count(*) AS n FROM supplier),
t AS (SELECT p_partkey, CASE p_partkey % {len(_WAYS)} {" ".join(f"WHEN {k} THEN {way}" for k, way in enumerate(_WAYS))} END AS text FROM part, n JOIN c ON c.stock_code = lpad((p_partkey % n.n + 1)::VARCHAR, 6, '0')),
w AS (SELECT p_partkey, unnest(x) AS word, generate_subscripts(x, 1) AS nth FROM (SELECT p_partkey, regexp_split_to_array(text, '[^0-9A-Za-z_\x{{4e00}}-\x{{9fff}}]+') AS x FROM t)),
p AS (SELECT p_partkey, -1 AS rank, trim(regexp_extract(text, '企业名称[:：]([^，,]*)', 1)) AS part FROM t WHERE regexp_matches(text, '企业名称[:：]')
      UNION ALL SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY -length(x), nth), x FROM (SELECT p_partkey, unnest(r) AS x, generate_subscripts(r, 1) AS nth FROM (SELECT p_partkey, regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{2,}}') AS r FROM t))),
hit AS (SELECT p_partkey, 0 AS rule, nth AS place, stock_code FROM w JOIN c ON word = stock_code WHERE regexp_full_match(word, '[0-9]{{6}}')
  UNION ALL SELECT p_partkey, 1, nth, stock_code FROM w JOIN c ON '000' || word = stock_code WHERE regexp_full_match(word, '[0-9]{{3}}')
  UNION ALL SELECT p_partkey, 2, 0, min(stock_code) FROM t JOIN c ON contains(text, stock_abbr) GROUP BY p_partkey
  UNION ALL SELECT p_partkey, 3, 0, min(stock_code) FROM t JOIN c ON contains(text, company_name) GROUP BY p_partkey
  UNION ALL SELECT p_partkey, 4, rank, min(stock_code) FROM p JOIN c ON contains(stock_abbr, part) OR contains(company_name, part) WHERE part <> '' GROUP BY p_partkey, rank HAVING count(*) = 1)
SELECT t.p_partkey, x.stock_code, x.rule IS NOT NULL AS named FROM t LEFT JOIN (SELECT p_partkey, arg_min(stock_code, (rule, place)) AS stock_code, min(rule) AS rule FROM hit GROUP BY p_partkey) x USING (p_partkey)""")
def jon13_rag06_company_match(spark, sf_dir):
    """Questions that name a company by six or three digits, a short or full name, a part of one, or not at all."""
    companies = named_companies(spark, sf_dir)
    n = companies.count()
    p = testdata.table(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") % n + 1).cast("string"), 6, "0").alias("stock_code")).join(companies, "stock_code")
    way = F.lit(None).cast("string")
    for k, text in enumerate(_WAYS):
        way = F.when(F.col("p_partkey") % len(_WAYS) == k, F.expr(text.replace("strpos(company_name, '药业')", "instr(company_name, '药业')"))).otherwise(way)
    found = co.resolve_companies(p.select("p_partkey", way.alias("text")), companies)
    return found.select("p_partkey", "stock_code", F.col("stock_code").isNotNull().alias("named"))


# ---------------------------------------------------------------- retrieval

_Q = "q AS (SELECT item_id AS query_id, lower(trim(text)) AS phrase, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{2,}|[0-9]{2,}'), lambda x: lower(x))) AS tokens FROM benchmark)"


@query(f"""WITH {_Q}, d AS (SELECT doc_id, source || '-' || doc_id AS title, '/' || doc_id AS paper_path, lower(text) AS t FROM documents),
s AS (SELECT query_id, paper_path, title, least(1.0, len(list_filter(tokens, lambda x: contains(t, x)))::DOUBLE / len(tokens) + CASE WHEN contains(t, phrase) THEN 0.15 ELSE 0 END) AS kw FROM q, d),
r AS (SELECT *, round(0.7 * kw, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * kw, 8) DESC, round(kw, 8) DESC, paper_path, title) AS rank FROM s WHERE kw > 0)
SELECT query_id, rank::BIGINT AS rank, paper_path, round(score, 6) AS score FROM r WHERE rank <= 3""")
def rag03_mat01_mat03_srt06_search(spark, sf_dir):
    q = testdata.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return si.search(spark, document_index(spark, sf_dir), q, 3).select("query_id", "rank", "paper_path", F.round("score", 6).alias("score"))


def document_index(spark, sf_dir):
    """The stored index of the documents, a page each."""

    def make_document_index(root):
        d = _docs(spark, sf_dir).select(F.concat_ws("-", "source", "doc_id").alias("title"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("paper_path"), F.lit(1).alias("page_no"), "text")
        si.build(d, root)

    return si.Index(testdata.ingested(spark, sf_dir, "documents", make_document_index), False)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT doc_id, source || '-' || doc_id AS title, '/' || doc_id AS paper_path, lower(text) AS t, v.e FROM documents LEFT JOIN v ON doc_id = vec_id),
q AS (SELECT item_id AS query_id, v.e AS qe, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{2,}|[0-9]{2,}'), lambda x: lower(x))) AS tokens FROM benchmark LEFT JOIN v ON vec_id = item_id * 3),
s AS (SELECT query_id, paper_path, title, len(list_filter(tokens, lambda x: contains(t, x)))::DOUBLE / len(tokens) AS kw, coalesce(greatest(0, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))), 0) AS vec FROM q, p),
r AS (SELECT *, round(0.7 * kw + 0.3 * vec, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * kw + 0.3 * vec, 8) DESC, round(kw, 8) DESC, round(vec, 8) DESC, paper_path, title) AS rank FROM s WHERE kw > 0 OR vec > 0)
SELECT query_id, rank::BIGINT AS rank, paper_path, round(score, 6) AS score FROM r WHERE rank <= 3""")
def rag03_mat03_hybrid_search(spark, sf_dir):
    """Documents with the vector of their number, asked by items with vectors of their own."""
    v = testdata.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    pages = _docs(spark, sf_dir).join(v, "doc_id", "left").select(F.concat_ws("-", "source", "doc_id").alias("title"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("paper_path"), F.lit(1).alias("page_no"), "text", "embedding")
    q = testdata.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") * 3).alias("doc_id")).join(v, "doc_id", "left")
    return rt.search(pages, q, 3).select("query_id", "rank", "paper_path", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e FROM d WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, greatest(0, list_dot_product(d.e, q.e) / (sqrt(list_dot_product(d.e, d.e)) * sqrt(list_dot_product(q.e, q.e)))) AS score FROM d, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, vec_id) AS rank FROM s WHERE score > 0)
SELECT query_id, rank::BIGINT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def mat02_cosine(spark, sf_dir):
    """A search: every row whose id is divisible by 50, against all rows."""
    e = testdata.table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ne.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), asked)[0].select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT doc_id, page_no::BIGINT AS page_no FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page_no, (DATE '2024-01-01' + (doc_id % 365)::INT) AS published FROM documents) WHERE published BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'")
def flt07_evidence_filter(spark, sf_dir):
    pages = testdata.research_pages(spark, sf_dir)
    return rt.EvidenceFilter(published_from="2024-03-01", published_to="2024-06-30").apply(pages).select("doc_id", "page_no")


@query("SELECT conv_id, turn, CASE WHEN length(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) > 0 THEN trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) END AS chunk FROM conversations WHERE trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> ''")
def rag01_chunks(spark, sf_dir):
    """Texts without sentence ends in Chinese are one chunk each."""
    t = testdata.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.explode(rt.chunks(F.col("text"))).alias("chunk"))


@query(r"""WITH RECURSIVE s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(replace(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '. ', '。'), '[。！？；]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
w AS (SELECT conv_id, turn, 1 AS k, parts[1] AS open, []::VARCHAR[] AS done, parts FROM s WHERE len(parts) > 0
  UNION ALL SELECT conv_id, turn, k + 1, CASE WHEN length(open) + 1 + length(parts[k + 1]) <= 280 THEN open || '。' || parts[k + 1] ELSE parts[k + 1] END, CASE WHEN length(open) + 1 + length(parts[k + 1]) <= 280 THEN done ELSE list_append(done, open) END, parts FROM w WHERE k < len(parts))
SELECT conv_id, turn, unnest(list_append(done, open)) AS chunk FROM w WHERE k = len(parts)""")
def rag01_split_chunks(spark, sf_dir):
    """Turns with the sentence ends of Chinese texts: most are several chunks."""
    t = testdata.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.explode(rt.chunks(F.replace(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(". "), F.lit("。")))).alias("chunk"))


@query("""SELECT paper_path, page_no::BIGINT AS page_no FROM (SELECT '/' || doc_id AS paper_path, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents) WHERE page_no <= 20 ORDER BY paper_path, page_no LIMIT 5000""")
def rag02_capped_index(spark, sf_dir):
    """The caps are the feature: an index of at most 20 chunks for a paper and 5000 in all."""
    pages = testdata.research_pages(spark, sf_dir).withColumn("chunk_no", F.lit(0))
    return rt.capped_index(pages).select("paper_path", "page_no")


@query("WITH x AS (SELECT doc_id, text, instr(lower(text), 'tion') AS p FROM documents) SELECT doc_id, substr(text, greatest(1, CASE WHEN p > 0 THEN p ELSE 1 END - 80), 240) AS quote, true AS holds FROM x")
def rag04_rag05_quotes(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("paper_path"), F.lit(1).alias("page_no"), "text")
    cited = d.select("doc_id", "paper_path", "page_no", rt.quote(F.col("text"), F.array(F.lit("tion"))).alias("quote"))
    return rt.verified(cited, d.drop("doc_id")).select("doc_id", "quote", "holds")


# ---------------------------------------------------------------- evidence

@query("""SELECT event_id, '/k' AS pointer, json_extract_string(props, '$.k') AS leaf FROM events""")
def jsn03_json_leaves(spark, sf_dir):
    from trustmill.operators.evidence import json_leaves

    return json_leaves(testdata.table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "pointer", "leaf")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'value_not_in_evidence' WHEN 2 THEN 'unknown_region' ELSE 'other_page' END AS fault FROM orders WHERE o_orderkey % 4 <> 0")
def qlt11_open_evidence(spark, sf_dir):
    from trustmill.operators.evidence import open_evidence

    k = F.col("o_orderkey")
    printed = F.format_number("o_totalprice", 2)
    o = testdata.table(spark, sf_dir, "orders")
    regions = o.select(k.cast("string").alias("document_id"), F.lit("r").alias("region_id"), F.concat(F.lit("净利润 "), printed).alias("text"), F.lit(1).alias("page_no"))
    facts = o.select("o_orderkey", k.cast("string").alias("document_id"), F.when(k % 4 == 2, "q").otherwise("r").alias("region_id"), printed.alias("raw_value"), F.when(k % 4 == 1, "净利润").otherwise(printed).alias("evidence_text"), F.when(k % 4 == 3, 2).otherwise(1).alias("page_no"))
    return open_evidence(facts, regions).select("o_orderkey", "fault")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_totalprice::DECIMAL(18,2) * 0.0001)::DOUBLE END AS normalized_value, CASE o_orderkey % 3 WHEN 1 THEN 'other_rule' WHEN 2 THEN 'other_value' END AS fault FROM orders")
def qlt06_recomputed_plans(spark, sf_dir):
    from trustmill.operators.evidence import recomputed

    k = F.col("o_orderkey")
    o = testdata.table(spark, sf_dir, "orders")
    candidates = o.select(k.alias("candidate_id"), F.format_number("o_totalprice", 2).alias("raw_value"), F.lit("元").alias("source_unit"), F.lit("万元").alias("target_unit"), F.lit(False).alias("negative"))
    plans = o.select(k.alias("candidate_id"), F.when(k % 3 == 1, "IDENTITY_CNY_YUAN_V1").otherwise("CNY_YUAN_TO_WANYUAN_V1").alias("rule_id"), F.lit("0.0001").alias("factor"), F.when(k % 3 == 2, "1").otherwise(F.format_string("%.2f", "o_totalprice")).alias("proposal"))
    return recomputed(candidates, plans).select(F.col("candidate_id").alias("o_orderkey"), "normalized_value", "fault")


@query("SELECT l_orderkey::VARCHAR AS doc, count(*) AS tokens, max(l_linenumber)::BIGINT AS lines FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY l_orderkey")
def src14_reading_order(spark, sf_dir):
    """Lineitems as boxes: a line for each number, one box for each part."""
    from trustmill.operators.evidence import reading_order

    li = testdata.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    top = F.col("l_linenumber") / 100
    left = F.col("l_partkey") / 1e9
    boxes = li.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("page_no"), left.alias("left"), top.alias("top"), (left + 1e-10).alias("right"), (top + 0.005).alias("bottom"), F.col("l_partkey").cast("string").alias("text"), F.lit(0.9).alias("confidence"), "l_linenumber")
    tokens = reading_order(boxes.drop("l_linenumber"))
    lines = li.groupBy(F.col("l_orderkey").cast("string").alias("doc")).agg(F.max("l_linenumber").alias("lines"))
    return tokens.groupBy("doc").agg(F.count("*").alias("tokens")).join(lines, "doc")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, '#', '') ELSE 'known' END AS abbr FROM supplier")
def str13_abbreviations(spark, sf_dir):
    s = testdata.table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.translate("s_name", "#", " "), F.lit("：年报.pdf"))).otherwise("600001_2024.pdf")
    return s.select("s_suppkey", tx.stock_abbr_in(name, F.lit("known")).alias("abbr"))


@query("SELECT s_suppkey AS query_id, lpad((600000 + s_suppkey)::VARCHAR, 6, '0') AS company, r_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rag06_inferred_filters(spark, sf_dir):
    companies = testdata.companies(spark, sf_dir)
    asked = companies.select((F.col("stock_code").cast("long") - 600000).alias("query_id"), F.concat_ws(" ", "stock_abbr", F.lit("in"), "industry").alias("query"))
    return rt.inferred_filters(asked, companies)
