"""The star-schema tables as a fact store: facts, sources and companies derived by fixed rules.

One exchange, by company and year, makes all quarter sums; running sums within the year are plain columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.periods import period_column
from trustmill.model import AMOUNT
from trustmill.sources import versions
from trustmill.sources.folders import shared_folder

#: Derived metrics in their number's order, and their statements.
DERIVED = (
    ("total_operating_revenue", "income_sheet"),
    ("total_profit", "income_sheet"),
    ("net_profit", "income_sheet"),
    ("operating_cf_net_amount", "cash_flow_sheet"),
    ("asset_inventory", "balance_sheet"),
    ("asset_total_assets", "balance_sheet"),
    ("liability_total_liabilities", "balance_sheet"),
    ("equity_total_equity", "balance_sheet"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(key: Column) -> Column:
    return F.lpad((F.lit(600000) + key).cast("string"), 6, "0")


def company_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, year, q, period_ord and the eight metric values m1..m8 of each company and quarter with sales."""
    price, discount, tax = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(3,2)"), F.col("l_tax").cast("decimal(3,2)")
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0).otherwise(-1).cast("decimal(1,0)")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("q"), (price * (1 - discount)).alias("rev"), (price * tax).alias("tax"), (price * discount).alias("disc"), (price * sign).alias("cash"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    zero = F.lit(0).cast("decimal(33,4)")
    parts = ("rev", "tax", "disc", "cash", "qty")
    sums = [F.coalesce(F.sum(F.when(F.col("q") == q, F.col(c))).cast("decimal(33,4)"), zero).alias(f"{c}{q}") for q in range(1, 5) for c in parts]
    counts = [F.count_if(F.col("q") == q).alias(f"n{q}") for q in range(1, 5)]
    wide = lines.groupBy("k", "year").agg(*sums, *counts)
    ytd = lambda c, q: sum((F.col(f"{c}{x}") for x in range(1, q + 1)), zero)
    quarters = F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"n{q}").alias("n"), *(ytd(c, q).alias(c) for c in parts[:4]), F.col(f"qty{q}").alias("qty")) for q in range(1, 5)))
    rows = wide.select("k", "year", F.explode(quarters).alias("x")).select("k", "year", "x.*").filter("n > 0").withColumn("period_ord", (F.col("year") * 10 + F.col("q")).cast("int"))
    profit = F.col("rev") - 5 * F.col("tax")
    equity = F.when((F.col("k") + F.col("period_ord")) % 13 == 0, 5).otherwise(6)
    values = (F.col("rev"), profit, profit - F.col("disc"), F.col("cash"), F.col("qty"), F.col("qty") * 10, F.col("qty") * 4, F.col("qty") * equity)
    return rows.select("k", F.col("year").cast("int").alias("year"), "q", "period_ord", *(v.cast(AMOUNT).alias(f"m{i}") for i, v in enumerate(values, 1)))


def _source_key(code: Column, period: Column, kind: str) -> Column:
    return F.concat_ws(":", F.lit("src"), code, period, F.lit(kind))


def derived_facts(spark: SparkSession, sf_dir: str, number: int | None = None) -> DataFrame:
    """Base facts, and decoys that a right engine must not see; with a number, dealt to so many buckets of `TRUST_KEY`.

    They are dealt as a row for each report, before its metrics are rows with texts and keys of their own.
    """
    base = company_periods(spark, sf_dir)
    metrics = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(name).alias("metric"), F.lit(t).alias("table_name"), F.lit("instant" if t == "balance_sheet" else "duration").alias("period_type"), F.col(f"m{i}").alias("v")) for i, (name, t) in enumerate(DERIVED, 1)))
    k, o = F.col("k"), F.col("period_ord")
    kinds = F.array_compact(F.array(F.lit("current"), F.when((k + o) % 9 == 0, F.lit("old")), F.when(k % 4 == 0, F.lit("parent")), F.when((k + o) % 10 == 3, F.lit("foreign"))))
    holder = F.when(F.col("kind") == "parent", "current").otherwise(F.col("kind"))
    rows = base.withColumn("kind", F.explode(kinds)).withColumns({"stock_code": code(k), "period": period_column(F.col("year"), F.col("q"))})
    rows = rows.withColumn("source_key", F.concat_ws(":", F.lit("src"), "stock_code", "period", holder))
    rows = rows if number is None else rows.repartition(number, *TRUST_KEY)
    rows = rows.select("k", "year", "q", "period_ord", "kind", *TRUST_KEY, F.explode(metrics).alias("m")).select("k", "year", "q", "period_ord", "kind", *TRUST_KEY, "m.*")
    mark = k * 7 + o * 3 + F.col("no")
    status = F.when(F.col("kind") != "current", "VALIDATED").when(mark % 10 == 0, "NEEDS_REVIEW").when(mark % 10 == 1, "REJECTED").otherwise("VALIDATED")
    factor = F.when(F.col("kind") == "old", 2).when(F.col("kind") == "parent", 0.5).when(F.col("kind") == "foreign", 5).otherwise(1).cast("decimal(3,1)")
    scope = F.when(F.col("kind") == "parent", "parent").otherwise("consolidated")
    rows = rows.withColumns({"statement_scope": scope, "normalized_value": (F.col("v") * factor).cast(AMOUNT), "validation_status": status})
    key = F.sha2(F.concat_ws("\x1f", "stock_code", "period", "statement_scope", "period_type", "metric", "source_key"), 256)
    return rows.select(
        key.alias("fact_key"), "stock_code", "period", F.col("year").alias("report_year"), "period_ord", "statement_scope", "period_type", "metric", "table_name", "normalized_value", "source_key",
        ((k + o + F.col("no")) % 40 + 1).cast("int").alias("page_no"), F.col("metric").alias("row_label"), F.when(mark % 17 != 0, F.lit("本期")).alias("column_label"), F.when(mark % 3 == 0, 0.5).otherwise(0.25).alias("confidence"), "validation_status", F.lit(1).alias("review_version"),
    )


def derived_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("q")).distinct()
    k, o = F.col("k"), F.col("year") * 10 + F.col("q")
    rows = lines.withColumns({"own": code(k), "period": period_column(F.col("year"), F.col("q"))})
    kinds = F.array_compact(F.array(F.struct(F.lit("current").alias("kind"), F.col("own").alias("stock_code"), F.lit("CURRENT").alias("status")), F.when((k + o) % 9 == 0, F.struct(F.lit("old").alias("kind"), F.col("own").alias("stock_code"), F.lit("SUPERSEDED").alias("status"))), F.when((k + o) % 10 == 3, F.struct(F.lit("foreign").alias("kind"), code(k + 1).alias("stock_code"), F.lit("CURRENT").alias("status")))))
    rows = rows.select("own", "period", F.explode(kinds).alias("x"))
    key = F.concat_ws(":", F.lit("src"), "own", "period", "x.kind")
    return rows.select(key.alias("source_key"), F.concat(key, F.lit(".pdf")).alias("source_file"), F.sha2(key, 256).alias("content_sha256"), "x.stock_code", "period", F.lit("BATCH").alias("source_owner"), F.col("x.status").alias("authority_status"), F.when(F.col("x.status") == "CURRENT", "CURRENT").alias("current_slot"))


#: The trust join's columns: facts and sources lie in buckets of them.
TRUST_KEY = ("source_key", "stock_code", "period")
#: Bytes of input for a bucket, and buckets at least. A task writes or reads a bucket, whose facts are several times its input.
BUCKET_BYTES, BUCKETS = 8 << 20, 8


_INGESTED: dict[tuple, str] = {}


def ingested(spark: SparkSession, sf_dir: str, table_name: str, make: Callable[[str], None]) -> str:
    """The folder of what make writes from a table: made once by an application, and again when the table's files have changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table_name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listStatus(path)
    state = sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in files)
    key = (spark.sparkContext.applicationId, make.__qualname__, sf_dir, str(state))
    if key not in _INGESTED:
        root = f"{shared_folder(spark)}/ingested-{uuid.uuid4().hex}"
        make(root)
        _INGESTED[key] = root
    return _INGESTED[key]


def _store(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the fact store of an input."""

    def make_store(root: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
        size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        number = max(BUCKETS, -(-size // BUCKET_BYTES))
        versions.commit(derived_facts(spark, sf_dir, number), f"{root}/facts", partition_by=("report_year",), buckets=versions.Buckets(number, TRUST_KEY, ("metric", "stock_code")), dealt=True)
        versions.commit(derived_sources(spark, sf_dir), f"{root}/sources", buckets=versions.Buckets(number, TRUST_KEY))

    return ingested(spark, sf_dir, "lineitem", make_store)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the store: a versioned table by year, in buckets of `TRUST_KEY`, sorted by metric: years prune folders, metrics row groups, and the trust join moves no fact."""
    return versions.read(spark, f"{_store(spark, sf_dir)}/facts")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.read(spark, f"{_store(spark, sf_dir)}/sources")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(code(F.col("s_suppkey")).alias("stock_code"), F.col("s_name").alias("stock_abbr"), F.concat_ws(" ", "s_name", "n_name").alias("company_name"), F.col("r_name").alias("industry"))


def research_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each line of a document: title, paper_path, page_no, text, company, published_at."""
    docs = table(spark, sf_dir, "documents")
    n = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    pages = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    return pages.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("paper_path"), F.col("doc_id"), (F.col("p") + 1).cast("int").alias("page_no"), "text", code(F.col("doc_id") % n).alias("company"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("published_at"))


_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_DISC = "CAST(l_discount AS DECIMAL(3,2))"
#: The same rules as common table expressions for a second engine: fact, source, company.
SQL = f"""
q0 AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q, sum({_PRICE} * (1 - {_DISC})) AS rev, sum({_PRICE} * CAST(l_tax AS DECIMAL(3,2))) AS tax,
       sum({_PRICE} * {_DISC}) AS disc, sum({_PRICE} * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE -1 END) AS cash, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem GROUP BY ALL),
q1 AS (SELECT k, y, q, y * 10 + q AS o, sum(rev) OVER w AS rev, sum(tax) OVER w AS tax, sum(disc) OVER w AS disc, sum(cash) OVER w AS cash, qty FROM q0 WINDOW w AS (PARTITION BY k, y ORDER BY q)),
m0 AS (SELECT k, y, q, o, unnest([1,2,3,4,5,6,7,8]) AS no, unnest([{", ".join(f"'{m}'" for m, _ in DERIVED)}]) AS metric, unnest([{", ".join(f"'{t}'" for _, t in DERIVED)}]) AS table_name,
       unnest([CAST(rev AS DECIMAL(24,4)), CAST(rev - 5 * tax AS DECIMAL(24,4)), CAST(rev - 5 * tax - disc AS DECIMAL(24,4)), CAST(cash AS DECIMAL(24,4)), CAST(qty AS DECIMAL(24,4)), CAST(qty * 10 AS DECIMAL(24,4)), CAST(qty * 4 AS DECIMAL(24,4)),
               CAST(qty * CASE WHEN (k + o) % 13 = 0 THEN 5 ELSE 6 END AS DECIMAL(24,4))]) AS v FROM q1),
f0 AS (SELECT *, 'current' AS kind FROM m0 UNION ALL SELECT *, 'old' FROM m0 WHERE (k + o) % 9 = 0 UNION ALL SELECT *, 'parent' FROM m0 WHERE k % 4 = 0 UNION ALL SELECT *, 'foreign' FROM m0 WHERE (k + o) % 10 = 3),
f1 AS (SELECT *, lpad(CAST(600000 + k AS VARCHAR), 6, '0') AS stock_code, y || CASE q WHEN 4 THEN 'FY' ELSE 'Q' || q END AS period, CASE kind WHEN 'parent' THEN 'parent' ELSE 'consolidated' END AS statement_scope,
       CASE table_name WHEN 'balance_sheet' THEN 'instant' ELSE 'duration' END AS period_type, k * 7 + o * 3 + no AS mark FROM f0),
f2 AS (SELECT *, 'src:' || stock_code || ':' || period || ':' || CASE kind WHEN 'parent' THEN 'current' ELSE kind END AS source_key FROM f1),
fact AS (SELECT sha256(concat_ws(chr(31), stock_code, period, statement_scope, period_type, metric, source_key)) AS fact_key, stock_code, period, y AS report_year, o AS period_ord, statement_scope, period_type, metric, table_name,
         CAST(v * CASE kind WHEN 'old' THEN 2 WHEN 'parent' THEN 0.5 WHEN 'foreign' THEN 5 ELSE 1 END AS DECIMAL(24,4)) AS normalized_value, source_key, CAST((k + o + no) % 40 + 1 AS INT) AS page_no, metric AS row_label,
         CASE WHEN mark % 17 <> 0 THEN '本期' END AS column_label, CASE WHEN mark % 3 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence,
         CASE WHEN kind <> 'current' THEN 'VALIDATED' WHEN mark % 10 = 0 THEN 'NEEDS_REVIEW' WHEN mark % 10 = 1 THEN 'REJECTED' ELSE 'VALIDATED' END AS validation_status, 1 AS review_version FROM f2),
s0 AS (SELECT DISTINCT k, y, q, o FROM q1),
s1 AS (SELECT k, k AS own, 'current' AS kind, 'CURRENT' AS authority_status, y, q FROM s0 UNION ALL SELECT k, k, 'old', 'SUPERSEDED', y, q FROM s0 WHERE (k + o) % 9 = 0 UNION ALL SELECT k, k + 1, 'foreign', 'CURRENT', y, q FROM s0 WHERE (k + o) % 10 = 3),
source AS (SELECT 'src:' || lpad(CAST(600000 + k AS VARCHAR), 6, '0') || ':' || y || CASE q WHEN 4 THEN 'FY' ELSE 'Q' || q END || ':' || kind AS source_key, lpad(CAST(600000 + own AS VARCHAR), 6, '0') AS stock_code, y || CASE q WHEN 4 THEN 'FY' ELSE 'Q' || q END AS period, authority_status FROM s1),
company AS (SELECT lpad(CAST(600000 + s_suppkey AS VARCHAR), 6, '0') AS stock_code, s_name AS stock_abbr, s_name || ' ' || n_name AS company_name, r_name AS industry
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
trusted AS (SELECT f.* FROM fact f JOIN source s USING (source_key, stock_code, period) WHERE f.validation_status = 'VALIDATED' AND f.statement_scope = 'consolidated' AND s.authority_status = 'CURRENT')
"""
