"""Checks, evaluation and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustmill.operators import audit
from trustmill.operators import evaluation as ev
from trustmill.operators import lifecycle as life
from trustmill.operators import quality as ql
from trustmill.plans.compiler import trusted_facts
from trustmill.sources import testdata

from .facts import _REPORTS, reports
from .registry import catalog, query

_METRICS = [m for m, _ in testdata.DERIVED]
_W = "w AS (SELECT stock_code, period, report_year AS y, " + ", ".join(f"max(normalized_value) FILTER (metric = '{m}') AS {m}" for m in _METRICS) + " FROM trusted GROUP BY ALL)"


def _wide(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return life.projection(trusted_facts(c.facts, c.sources), _METRICS)[0]


@query(f"+ {_W} SELECT stock_code, period, (asset_total_assets - liability_total_liabilities - equity_total_equity)::DOUBLE AS difference FROM w WHERE abs(asset_total_assets - liability_total_liabilities - equity_total_equity) > greatest(0.005 * abs(asset_total_assets), 1)", facts=True)
def qlt01_balance_issues(spark, sf_dir):
    return ql.balance_issues(_wide(spark, sf_dir))


@query(f"+ {_W} SELECT a.stock_code, a.period, b.net_profit::DOUBLE AS prior_net_profit FROM w a JOIN w b ON a.stock_code = b.stock_code AND b.y = a.y - 1 AND substr(a.period, 5) = substr(b.period, 5)", facts=True)
def jon07_prior_year(spark, sf_dir):
    return ql.with_prior_year(_wide(spark, sf_dir), ["net_profit"]).select("stock_code", "period", "prior_net_profit")


@query(f"""+ {_W}, g AS (SELECT a.stock_code, a.period, CASE WHEN b.net_profit <> 0 THEN (a.net_profit - b.net_profit)::DOUBLE * 100 / b.net_profit::DOUBLE END AS x FROM w a JOIN w b ON a.stock_code = b.stock_code AND b.y = a.y - 1 AND substr(a.period, 5) = substr(b.period, 5))
SELECT stock_code, period, round(x, 6) AS recomputed FROM g WHERE abs(x - 20) > 0.1""", facts=True)
def qlt02_growth_issues(spark, sf_dir):
    """Every growth stated as 20 %."""
    wide = _wide(spark, sf_dir).withColumn("stated", F.lit(20).cast("decimal(24,4)"))
    return ql.growth_issues(wide, "net_profit", "stated").select("stock_code", "period", "recomputed")


@query(f"+ {_W} SELECT stock_code, period, CASE WHEN asset_total_assets IS NULL OR liability_total_liabilities IS NULL OR equity_total_equity IS NULL THEN 'unavailable' WHEN abs(asset_total_assets - liability_total_liabilities - equity_total_equity) <= greatest(0.005 * greatest(abs(asset_total_assets), abs(liability_total_liabilities + equity_total_equity)), 1) THEN 'passed' ELSE 'failed' END AS balance, CASE WHEN liability_total_liabilities IS NULL OR asset_total_assets IS NULL OR asset_total_assets = 0 THEN 'unavailable' WHEN liability_total_liabilities::DOUBLE / asset_total_assets::DOUBLE BETWEEN 0 AND 1 THEN 'passed' ELSE 'failed' END AS asset_liability_ratio FROM w", facts=True)
def qlt05_candidate_checks(spark, sf_dir):
    return ql.candidate_checks(_wide(spark, sf_dir)).select("stock_code", "period", "balance", "asset_liability_ratio")


@query("SELECT count(*) AS facts, round(count(column_label) / count(*), 6) AS column_label_coverage, round(count(page_no) / count(*), 6) AS page_no_coverage, round(count(*) FILTER (column_label IS NOT NULL AND page_no IS NOT NULL) / count(*), 6) AS coverage FROM fact WHERE validation_status = 'VALIDATED'", facts=True)
def agg03_traceability(spark, sf_dir):
    return ql.traceability(testdata.facts(spark, sf_dir).filter("validation_status = 'VALIDATED'")).select("facts", "column_label_coverage", "page_no_coverage", "coverage")


@query("+ k AS (SELECT DISTINCT stock_code, period FROM trusted), r AS (SELECT *, unnest(['income_sheet', 'balance_sheet', 'cash_flow_sheet']) AS table_name FROM k) SELECT stock_code, period, table_name FROM r ANTI JOIN trusted USING (stock_code, period, table_name)", facts=True)
def jon10_set03_missing_statements(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return ql.missing_statements(trusted_facts(c.facts, c.sources))


@query(f"+ {_W}, i AS (SELECT count(*) AS n FROM w WHERE abs(asset_total_assets - liability_total_liabilities - equity_total_equity) > greatest(0.005 * abs(asset_total_assets), 1)) SELECT count(*) FILTER (validation_status = 'VALIDATED') AS validated, (SELECT n FROM i) AS issues, (SELECT n FROM i) = 0 AS ready FROM fact", facts=True)
def qlt04_ready(spark, sf_dir):
    facts = testdata.facts(spark, sf_dir)
    return ql.ready(facts, ql.balance_issues(_wide(spark, sf_dir)), ("income_sheet", "balance_sheet", "cash_flow_sheet")).select("validated", "issues", "ready")


@query("SELECT source_key, CASE WHEN count(*) FILTER (validation_status = 'REJECTED') > 2 THEN 'FAILED' WHEN count(*) FILTER (validation_status = 'NEEDS_REVIEW') > 0 THEN 'NEEDS_REVIEW' WHEN count(*) FILTER (metric = 'asset_total_assets' AND validation_status = 'VALIDATED') = 0 THEN 'VALIDATION_UNAVAILABLE' ELSE 'PASS' END AS status FROM fact GROUP BY source_key", facts=True)
def qlt03_status(spark, sf_dir):
    f = testdata.facts(spark, sf_dir).groupBy("source_key").agg(F.count("*").alias("total"), F.count_if(F.col("validation_status") == "VALIDATED").alias("validated"), F.count_if(F.col("validation_status") == "NEEDS_REVIEW").alias("pending"), F.count_if(F.col("validation_status") == "REJECTED").alias("rejected"), F.count_if((F.col("metric") == "asset_total_assets") & (F.col("validation_status") == "VALIDATED")).alias("eligible"))
    return f.select("source_key", ql.status(F.col("total"), F.col("validated"), F.col("pending"), F.greatest(F.lit(0), F.col("rejected") - 2), F.col("eligible")).alias("status"))


@query(f"+ {_W} SELECT count(*) FILTER (asset_total_assets IS NOT NULL AND liability_total_liabilities IS NOT NULL AND equity_total_equity IS NOT NULL) AS balance_eligible, count(*) FILTER (net_profit IS NOT NULL AND total_operating_revenue IS NOT NULL) AS margin_eligible, count(*) AS records FROM w", facts=True)
def agg09_eligible(spark, sf_dir):
    every = lambda *cs: F.count_if(sum((F.col(c).isNull().cast("int") for c in cs), F.lit(0)) == 0)
    return _wide(spark, sf_dir).agg(every(ql.ASSETS, ql.LIABILITIES, ql.EQUITY).alias("balance_eligible"), every("net_profit", "total_operating_revenue").alias("margin_eligible"), F.count("*").alias("records"))


# ---------------------------------------------------------------- evaluation: labels as golden classes


def _golden(spark, sf_dir):
    """Lineitems as golden facts, and predictions that lack some, miss some values and pages, and add some."""
    li = testdata.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").cast("decimal(38,18)").alias("v"))
    source = lambda page: F.struct(F.concat(F.lit("./a/"), F.col("l_orderkey").cast("string")).alias("source_file"), page.alias("page_no"), F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("row_label"), F.lit(None).cast("string").alias("column_label"))
    key = [F.col("l_orderkey").cast("string").alias("company_id"), F.lit("1999FY").alias("period"), F.lit("consolidated").alias("statement_scope"), F.lit("duration").alias("period_type"), F.col("l_linenumber").cast("string").alias("metric")]
    golden = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), *key, F.col("v").alias("normalized_value"), F.lit("元").alias("unit"), F.lit("CNY").alias("currency"), source(F.lit(1)).alias("source"))
    n = F.col("l_orderkey")
    predicted = li.filter(n % 5 != 0).select(*key, (F.col("v") + F.when(n % 7 == 0, F.lit("1")).when(n % 7 == 1, F.lit("0.01")).otherwise(F.lit("0")).cast("decimal(4,2)")).cast("decimal(38,18)").alias("value"), F.lit("元").alias("unit"), F.lit("CNY").alias("currency"), source(F.when(n % 3 == 0, 2).otherwise(1)).alias("source"))
    extra = li.filter(n % 11 == 0).select(F.concat(F.lit("x"), n.cast("string")).alias("company_id"), *key[1:], F.col("v").alias("value"), F.lit("元").alias("unit"), F.lit("CNY").alias("currency"), source(F.lit(1)).alias("source"))
    return golden, predicted.unionByName(extra)


_G = "g AS (SELECT l_orderkey AS n, l_linenumber AS k FROM lineitem GROUP BY ALL)"


@query(f"WITH {_G} SELECT n || '-' || k AS record_id, n % 5 <> 0 AS found, n % 5 <> 0 AND n % 7 <> 0 AS value_ok, n % 5 <> 0 AND n % 3 <> 0 AS source_ok, CASE WHEN n % 5 = 0 THEN 'missing_prediction' WHEN n % 7 = 0 THEN 'value_mismatch' WHEN n % 3 = 0 THEN 'source_mismatch' END AS failure FROM g")
def jon08_qlt07_qlt08_mat04_compare_facts(spark, sf_dir):
    golden, predicted = _golden(spark, sf_dir)
    return ev.compare_facts(golden, predicted).select("record_id", "found", "value_ok", "source_ok", "failure")


@query(f"WITH {_G} SELECT 'x' || n AS company_id, k::VARCHAR AS metric FROM g WHERE n % 11 = 0")
def jon09_unexpected(spark, sf_dir):
    return ev.unexpected(*_golden(spark, sf_dir)).select("company_id", "metric")


@query(f"""WITH {_G}, c AS (SELECT count(*) AS golden, count(*) FILTER (n % 5 <> 0) AS found, count(*) FILTER (n % 5 <> 0 AND n % 7 <> 0) AS right_n, count(*) FILTER (n % 5 <> 0 AND n % 3 <> 0) AS sourced, count(*) FILTER (n % 5 <> 0) + count(*) FILTER (n % 11 = 0) AS predicted FROM g),
q AS (SELECT count(*) AS n, count(*) FILTER (length(text) % 2 = 0) AS ok FROM benchmark),
r AS (SELECT unnest(['fact_recall', 'cell_accuracy', 'fact_precision', 'answer_accuracy', 'source_accuracy']) AS metric, unnest([found, right_n, right_n, q.ok, sourced]) AS numerator, unnest([golden, golden, predicted, q.n, golden]) AS denominator FROM c, q)
SELECT metric, numerator::BIGINT AS numerator, denominator::BIGINT AS denominator, numerator::DOUBLE / denominator AS value FROM r""")
def agg10_qlt07_summary(spark, sf_dir):
    golden, predicted = _golden(spark, sf_dir)
    b = testdata.table(spark, sf_dir, "benchmark")
    questions = b.select(F.col("item_id").cast("string").alias("record_id"), F.lit("text").alias("answer_type"), F.col("text").alias("expected_answer"))
    answers = b.select(F.col("item_id").cast("string").alias("question_id"), F.when(F.length("text") % 2 == 0, F.concat(F.lit("  "), F.col("text"))).otherwise("?").alias("answer"))
    return ev.summary(ev.compare_facts(golden, predicted), ev.compare_answers(questions, answers), predicted)


@query("SELECT coalesce(a.k, b.k)::VARCHAR AS title_key, CASE WHEN a.k IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'orphan' WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' ELSE 'matched' END AS state FROM (SELECT c_custkey AS k, 1 AS n FROM customer) a FULL JOIN (SELECT CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN 1000000 + o_orderkey ELSE 3000000 + o_custkey END AS k, count(*) AS n FROM orders GROUP BY ALL) b ON a.k = b.k")
def jon11_title_matches(spark, sf_dir):
    """Customers as files, all orders as metadata: a third of them under the file's title, others under titles no file has."""
    files = testdata.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("title_key"))
    k = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).when(F.col("o_orderkey") % 3 == 1, 1000000 + F.col("o_orderkey")).otherwise(3000000 + F.col("o_custkey"))
    metadata = testdata.table(spark, sf_dir, "orders").select(k.cast("string").alias("title_key"))
    return ev.title_matches(files, metadata)


@query("SELECT c_custkey AS id, 'missing' AS fault FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'repeated' FROM orders GROUP BY ALL HAVING count(*) > 1")
def jon12_partition_faults(spark, sf_dir):
    expected = testdata.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    actual = testdata.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return ev.partition_faults(expected, actual, "id")


@query("SELECT source, count(*) AS pages, sum(n)::BIGINT AS lines, min(n)::BIGINT AS least, max(n)::BIGINT AS most, count(*) FILTER (lang = 'en') AS english FROM (SELECT source, lang, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY source")
def agg11_qlt10_report_audit(spark, sf_dir):
    d = testdata.table(spark, sf_dir, "documents").withColumn("n", F.size(F.split("text", "\n", -1)))
    return d.groupBy("source").agg(F.count("*").alias("pages"), F.sum("n").alias("lines"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("lang") == "en").alias("english"))


@query("SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n FROM labels GROUP BY ALL")
def qlt07_label_counts(spark, sf_dir):
    return testdata.table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- the whole audit

_NAMES = ("附件2/f{k}.pdf", "附件5/x{k}.PDF", "附件2/~$f{k}.xlsx", "master{k}.xlsx", "附件2/readme", ".hidden{k}.pdf", "data/{k}.tar.gz")
_PATH = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{name.split('{k}')[0]}' || " + ("doc_id || '" + name.split("{k}")[1] + "'" if "{k}" in name else "''") for k, name in enumerate(_NAMES)) + " END"
_TABLES = ("core_performance_indicators_sheet", "balance_sheet", "cash_flow_sheet", "income_sheet")
_QUESTIONS = "CASE conv_id % 8 WHEN 3 THEN 'no json {' WHEN 4 THEN '{\"Q\":\"x\"}' WHEN 5 THEN '[{\"Q\":\" \"},{\"Q\":5},{\"A\":\"b\"},7,{\"Q\":\"fine\"}]' WHEN 6 THEN '[]' ELSE '[' || repeat('{\"Q\":\"why\"},', n - 1) || '{\"Q\":\"end\"}]' END"
_CODES = "SELECT lpad((600000 + s_suppkey % 50)::VARCHAR, 6, '0') AS stock_code, CASE WHEN s_suppkey % 9 = 0 THEN s_name ELSE 'n' || s_suppkey % 50 END AS stock_abbr FROM supplier WHERE s_suppkey % 50 < 45"


def _count_sql(section: str, source: str, items: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{item}' AS item, '' AS key, coalesce(({expr}), 0)::BIGINT AS n FROM {source}" for item, expr in items.items())


@query(f"""WITH {_REPORTS}, f AS (SELECT {_PATH} AS path, n_chars AS length FROM documents), f1 AS (SELECT *, regexp_matches(path, '(^|/)(~[$]|[.])[^/]*$') AS tmp, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.[.]([^./]+)$', 1)) AS ext FROM f),
m AS ({_CODES}), m1 AS (SELECT stock_code, count(DISTINCT stock_abbr) AS names, count(*) AS r FROM m GROUP BY 1),
d AS (SELECT p_partkey % 5 AS t, p_name FROM part), q AS (SELECT conv_id, {_QUESTIONS} AS questions, conv_id % 8 AS k, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)),
s AS (SELECT *, stock_code IN (SELECT stock_code FROM m) AS known, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 300 END AS page_count, (o_orderkey % 200) AS head_length, CASE WHEN o_orderkey % 29 = 0 THEN 'broken' END AS read_error FROM r),
s1 AS (SELECT *, CASE WHEN NOT known THEN 'needs_review:outside_company_master' WHEN is_summary THEN 'skipped_summary:summary_not_authoritative' WHEN is_english THEN 'superseded:english_translation' WHEN revision = 'pre_revision' THEN 'superseded:pre_revision' END AS out FROM s),
c AS (SELECT *, rank() OVER (PARTITION BY stock_code, period ORDER BY (revision = 'revised') DESC, published_date DESC, copy_index) AS k FROM s1 WHERE out IS NULL), t AS (SELECT stock_code, period, count(*) AS n FROM c WHERE k = 1 GROUP BY ALL),
dec AS (SELECT out AS key FROM s1 WHERE out IS NOT NULL UNION ALL SELECT CASE WHEN k = 1 AND n = 1 THEN 'selected:authoritative_version' WHEN k = 1 THEN 'needs_review:ambiguous_authoritative_version' WHEN n = 1 THEN 'superseded:higher_ranked_version_selected' ELSE 'superseded:higher_ranked_version_exists' END FROM c JOIN t USING (stock_code, period)),
rf AS (SELECT c_custkey::VARCHAR AS title, CASE WHEN c_custkey % 3 = 0 THEN 'industry' ELSE 'stock' END AS kind FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'stock' FROM customer WHERE c_custkey % 11 = 0),
rm AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN o_custkey::VARCHAR WHEN o_orderkey % 6 = 1 THEN (1000000 + o_orderkey)::VARCHAR END AS title, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS context, CASE WHEN o_orderkey % 4 > 0 THEN '2024' END AS published FROM orders),
rt AS (SELECT title, count(DISTINCT (coalesce(context, ''), coalesce(published, ''))) AS v FROM rm WHERE title IS NOT NULL GROUP BY 1), rp AS (SELECT title, count(*) AS n FROM rf GROUP BY 1),
rx AS (SELECT CASE WHEN p.title IS NULL THEN 'missing' WHEN o.title IS NULL THEN 'orphan' ELSE 'matched' END AS key FROM rp p FULL JOIN (SELECT title FROM rt WHERE v = 1) o ON p.title = o.title),
g AS (SELECT r_name || '/manifest.json' AS path FROM region WHERE r_regionkey = 0)
{_count_sql("inventory", "f1", {"total_files": "count(*)", "usable_files": "count(*) FILTER (NOT tmp)", "temporary_files": "count(*) FILTER (tmp)", "total_bytes": "sum(length)", "usable_bytes": "sum(length) FILTER (NOT tmp)"})}
UNION ALL SELECT 'inventory', 'category', CASE WHEN ext = 'pdf' AND path LIKE '附件2/%' THEN 'financial_report_pdf' WHEN ext = 'pdf' AND path LIKE '附件5/%' THEN 'research_report_pdf' WHEN ext IN ('xlsx', 'xlsm') THEN 'excel_workbook' ELSE 'other' END AS key, count(*) FROM f1 WHERE NOT tmp GROUP BY ALL
UNION ALL SELECT 'inventory', 'extension', CASE WHEN ext = '' THEN '<none>' ELSE '.' || ext END AS key, count(*) FROM f1 GROUP BY ALL
UNION ALL {_count_sql("company_master", "m1", {"company_count": "count(*)", "repeated_codes": "count(*) FILTER (r > 1)", "conflicting_codes": "count(*) FILTER (names > 1)"})} UNION ALL SELECT 'company_master', 'status', 'ok', 1
UNION ALL SELECT 'database_schema', 'field_count', key, count(DISTINCT p_name) FROM (SELECT unnest({list(_TABLES)}) AS key, unnest([0, 1, 2, 3]) AS t) LEFT JOIN d USING (t) GROUP BY key UNION ALL SELECT 'database_schema', 'status', 'ok', 1
UNION ALL {_count_sql("question_set", "q", {"case_count": "count(*)", "question_count": "sum(CASE WHEN k IN (3, 4, 6) THEN 0 WHEN k = 5 THEN 1 ELSE n END)", "no_json": "count(*) FILTER (k = 3)", "no_list": "count(*) FILTER (k = 4)", "no_question": "4 * count(*) FILTER (k = 5)"})}
UNION ALL {_count_sql("financial_reports", "s", {"discovered": "count(*)", "read_errors": "count(read_error)", "known_page_counts": "count(*) FILTER (page_count > 0)", "pages": "sum(page_count) FILTER (page_count > 0)", "least_pages": "min(page_count) FILTER (page_count > 0)", "most_pages": "max(page_count) FILTER (page_count > 0)", "readable_heads": "count(*) FILTER (head_length >= 80)", "summaries": "count(*) FILTER (is_summary)", "english": "count(*) FILTER (is_english)", "outside_company_master": "count(*) FILTER (NOT known)", "codes_outside": "count(DISTINCT stock_code) FILTER (NOT known)"})}
UNION ALL SELECT 'financial_reports', 'revision', revision, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'financial_reports', 'decision', key, count(*) FROM dec GROUP BY ALL
UNION ALL {_count_sql("research_reports", "rm", {"rows": "count(*)", "title_rows": "count(title)", "context_rows": "count(*) FILTER (title IS NOT NULL AND context IS NOT NULL)", "publication_date_rows": "count(*) FILTER (title IS NOT NULL AND published IS NOT NULL)"})}
UNION ALL SELECT 'research_reports', 'conflicts', '', count(*) FILTER (v > 1) FROM rt UNION ALL SELECT 'research_reports', 'repeated_file_titles', '', count(*) FILTER (n > 1) FROM rp UNION ALL SELECT 'research_reports', 'discovered', '', count(*) FROM rf
UNION ALL SELECT 'research_reports', 'kind', kind, count(*) FROM rf GROUP BY ALL UNION ALL SELECT 'research_reports', 'match', key, count(*) FROM rx GROUP BY ALL
UNION ALL SELECT 'gold_readiness', 'blocker', unnest(['missing_annotation_files', 'manifest_requires_evaluation_loader_verification']), 1 FROM g""")
def qlt10_src21_dataset_audit(spark, sf_dir):
    """All seven sections: files, company master, schema, questions, financial and research reports, readiness of the golden set."""
    t = lambda name: testdata.table(spark, sf_dir, name)
    files = t("documents").select(F.expr(_PATH).alias("path"), F.col("n_chars").alias("length"))
    s = F.col("s_suppkey")
    companies = t("supplier").filter(s % 50 < 45).select(testdata.code(s % 50).alias("stock_code"), F.when(s % 9 == 0, F.col("s_name")).otherwise(F.concat(F.lit("n"), s % 50)).alias("stock_abbr"))
    fields = t("part").select(F.get(F.lit(list(_TABLES)), (F.col("p_partkey") % 5).cast("int")).alias("table_name"), F.col("p_name").alias("field_name"))
    questions = t("conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n")).select(F.col("conv_id").alias("id"), F.expr(_QUESTIONS).alias("questions"))
    k = F.col("o_orderkey")
    found = reports(spark, sf_dir).drop("in_master").withColumns({"page_count": F.when(k % 13 != 0, k % 300), "head_length": k % 200, "read_error": F.when(k % 29 == 0, "broken")})
    c = F.col("c_custkey")
    pdf = t("customer").select(c.cast("string").alias("title_key"), F.when(c % 3 == 0, "industry").otherwise("stock").alias("kind"), c)
    pdf = pdf.unionByName(pdf.filter(c % 11 == 0).withColumn("kind", F.lit("stock"))).drop("c_custkey")
    metadata = t("orders").select(F.when(k % 6 == 0, F.col("o_custkey")).when(k % 6 == 1, 1000000 + k).cast("string").alias("title_key"), F.when(k % 5 > 0, F.col("o_orderstatus")).alias("context"), F.when(k % 4 > 0, "2024").alias("published"))
    manifests = t("region").filter("r_regionkey = 0").select(F.concat("r_name", F.lit("/manifest.json")).alias("path"), F.to_json(F.struct(F.col("r_name").alias("dataset_kind"))).alias("json"))
    return audit.dataset([audit.inventory(files, "附件2", "附件5"), audit.company_master(companies), audit.database_schema(fields), audit.question_set(questions), audit.financial_reports(found, companies), audit.research_reports(pdf, metadata), audit.gold_readiness(manifests)])
