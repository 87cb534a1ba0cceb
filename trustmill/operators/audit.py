"""Audit of a dataset before it is ingested: one table (section, item, key, n), each section one pass over its input.

Counts that share an input are made together, by several aggregates or by grouping sets; a section of a missing input has
one row with the item `status` and the key `missing`. Nothing is collected: findings are rows, as many as there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.operators import evaluation as ev
from trustmill.operators import lifecycle as life

#: Statement tables that a schema must have, and the characters that a readable report begins with at least.
TABLES = ("core_performance_indicators_sheet", "balance_sheet", "cash_flow_sheet", "income_sheet")
HEAD_CHARACTERS = 80
SCHEMA = "section string, item string, key string, n long"
ARRAY_OF_QUESTIONS = "array<struct<Q:string>>"


def _rows(section: str, df: DataFrame, items: dict[str, Column], by: tuple[str, Column] | None = None) -> DataFrame:
    """One aggregate: a row for each item; with by, one for each value of it, under its name."""
    if by is not None:
        name, key = by
        return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.lit(name).alias("item"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "n")
    each = F.array(*(F.struct(F.lit(k).alias("item"), F.col(k).cast("long").alias("n")) for k in items))
    return df.agg(*(v.alias(k) for k, v in items.items())).select(F.explode(each).alias("x")).select(F.lit(section).alias("section"), "x.item", F.lit("").alias("key"), F.coalesce("x.n", F.lit(0).cast("long")).alias("n"))


def _status(section: str, of: DataFrame, key: Column) -> DataFrame:
    """A row that tells the section's state, from a table of one row."""
    return of.select(F.lit(section).alias("section"), F.lit("status").alias("item"), key.alias("key"), F.lit(1).cast("long").alias("n"))


def is_temporary(path: Column) -> Column:
    """Lock and system files of other programs."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.startswith("~$") | name.startswith(".")


def category(path: Column, financial: str, research: str) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when((extension == "pdf") & path.startswith(f"{financial}/"), "financial_report_pdf").when((extension == "pdf") & path.startswith(f"{research}/"), "research_report_pdf").when(extension.isin("xlsx", "xlsm"), "excel_workbook").otherwise("other")


def inventory(files: DataFrame, financial: str, research: str) -> DataFrame:
    """files: path, length. Categories count usable files, extensions all of them: two grouping sets of one pass."""
    temporary = is_temporary(F.col("path"))
    extension = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r".\.([^./]+)$", 1))
    x = files.select("length", temporary.alias("temporary"), F.when(extension == "", "<none>").otherwise(F.concat(F.lit("."), extension)).alias("extension"), F.when(~temporary, category(F.col("path"), financial, research)).alias("category"))
    total = _rows("inventory", x, {"total_files": F.count("*"), "usable_files": F.count_if(~F.col("temporary")), "temporary_files": F.count_if("temporary"), "total_bytes": F.sum("length"), "usable_bytes": F.sum(F.when(~F.col("temporary"), F.col("length")))})
    sets = x.groupingSets([[F.col("category")], [F.col("extension")]], "category", "extension").agg(F.count("*").alias("n"), F.grouping("extension").alias("_by_category"))
    groups = sets.filter("_by_category = 0 OR category IS NOT NULL").select(F.lit("inventory").alias("section"), F.when(F.col("_by_category") == 1, "category").otherwise("extension").alias("item"), F.coalesce("category", "extension").alias("key"), "n")
    return total.unionByName(groups)


def company_master(companies: DataFrame) -> DataFrame:
    """companies: stock_code, stock_abbr. Codes with several names are faults."""
    each = companies.groupBy("stock_code").agg(F.count_distinct("stock_abbr").alias("names"), F.count("*").alias("rows"))
    items = _rows("company_master", each, {"company_count": F.count("*"), "repeated_codes": F.count_if(F.col("rows") > 1), "conflicting_codes": F.count_if(F.col("names") > 1)})
    return items.unionByName(_status("company_master", each.agg(F.count("*").alias("n")), F.when(F.col("n") > 0, "ok").otherwise("missing")))


def database_schema(fields: DataFrame) -> DataFrame:
    """fields: table_name, field_name. Complete if each statement has a table with fields."""
    counts = _rows("database_schema", fields, {t: F.count_distinct(F.when(F.col("table_name") == t, F.col("field_name"))) for t in TABLES})
    state = counts.agg(F.min("n").alias("least"))
    return counts.withColumns({"key": F.col("item"), "item": F.lit("field_count")}).select("section", "item", "key", "n").unionByName(_status("database_schema", state, F.when(F.col("least") > 0, "ok").otherwise("incomplete")))


def question_set(questions: DataFrame, section: str = "question_set") -> DataFrame:
    """questions: id, questions (JSON text). Cases, questions and faults by kind, as far as each text can be read."""
    text = F.col("questions")
    valid = F.try_parse_json(text).isNotNull()
    listed = valid & F.rlike(F.trim(text), F.lit(r"^\["))
    # arrays of anything: their items as variants, so that one odd item doesn't hide the others
    items = F.when(listed, F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"))
    good = lambda v: F.trim(F.coalesce(F.try_variant_get(v, "$.Q", "string"), F.lit(""))) != ""
    is_text = lambda v: F.coalesce(F.schema_of_variant(F.coalesce(F.try_variant_get(v, "$.Q", "variant"), F.parse_json(F.lit("null")))) == "STRING", F.lit(False))
    x = questions.select(valid.alias("valid"), listed.alias("listed"), F.coalesce(F.size(items), F.lit(0)).alias("many"), F.coalesce(F.size(F.filter(items, lambda v: good(v) & is_text(v))), F.lit(0)).alias("fine"))
    return _rows(section, x, {"case_count": F.count("*"), "question_count": F.sum("fine"), "no_json": F.count_if(~F.coalesce("valid", F.lit(False))), "no_list": F.count_if(F.col("valid") & ~F.col("listed")), "no_question": F.sum(F.col("many") - F.col("fine"))})


def financial_reports(reports: DataFrame, companies: DataFrame) -> DataFrame:
    """reports: stock_code, period, page_count, head_length, is_summary, is_english, revision, published_date, copy_index, read_error."""
    section = "financial_reports"
    master = companies.select("stock_code", F.lit(True).alias("in_master")).distinct()
    r = reports.join(master, "stock_code", "left").withColumn("in_master", F.coalesce("in_master", F.lit(False)))
    known = F.col("page_count") > 0
    totals = _rows(section, r, {
        "discovered": F.count("*"), "read_errors": F.count("read_error"), "known_page_counts": F.count_if(known), "pages": F.sum(F.when(known, F.col("page_count"))), "least_pages": F.min(F.when(known, F.col("page_count"))), "most_pages": F.max(F.when(known, F.col("page_count"))),
        "readable_heads": F.count_if(F.col("head_length") >= HEAD_CHARACTERS), "summaries": F.count_if("is_summary"), "english": F.count_if("is_english"), "outside_company_master": F.count_if(~F.col("in_master")), "codes_outside": F.count_distinct(F.when(~F.col("in_master"), F.col("stock_code"))),
    })
    decided = life.select_authoritative(r)
    parts = [totals, _rows(section, r, {}, ("revision", F.col("revision"))), _rows(section, decided, {}, ("decision", F.concat_ws(":", "status", "reason")))]
    return reduce(DataFrame.unionByName, parts)


def research_reports(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files: title_key, kind; metadata: title_key (null: none), context, published. Titles whose rows differ are conflicts and match nothing."""
    section = "research_reports"
    named = metadata.filter("title_key IS NOT NULL")
    rows = _rows(section, metadata, {"rows": F.count("*"), "title_rows": F.count("title_key"), "context_rows": F.count_if(F.col("title_key").isNotNull() & F.col("context").isNotNull()), "publication_date_rows": F.count_if(F.col("title_key").isNotNull() & F.col("published").isNotNull())})
    titles = named.groupBy("title_key").agg(F.count_distinct(F.struct(F.coalesce("context", F.lit("")), F.coalesce("published", F.lit("")))).alias("variants"))
    conflicts = _rows(section, titles, {"conflicts": F.count_if(F.col("variants") > 1)})
    matched = ev.title_matches(files.select("title_key").distinct(), titles.filter("variants = 1").select("title_key"))
    pdf = files.groupBy("title_key").agg(F.count("*").alias("files"))
    repeated = _rows(section, pdf, {"repeated_file_titles": F.count_if(F.col("files") > 1), "discovered": F.sum("files")})
    return reduce(DataFrame.unionByName, [rows, conflicts, repeated, _rows(section, files, {}, ("kind", F.col("kind"))), _rows(section, matched, {}, ("match", F.col("state")))])


def gold_readiness(manifests: DataFrame) -> DataFrame:
    """manifests: path, json. What stands between the files and a golden set that can be evaluated."""
    one = manifests.agg(F.count("*").alias("m"), F.max("json").alias("json"))
    valid = F.coalesce(F.rlike(F.trim("json"), F.lit(r"^\{")) & F.try_parse_json("json").isNotNull(), F.lit(False))
    annotated = F.coalesce(F.size(F.from_json("json", "annotation_files array<string>")["annotation_files"]) > 0, F.lit(False))
    blockers = F.when(F.col("m") == 0, F.array(F.lit("missing_manifest"))).when(F.col("m") > 1, F.array(F.lit("multiple_manifests"))).when(~valid, F.array(F.lit("invalid_manifest"))).otherwise(F.array_compact(F.array(F.when(~annotated, F.lit("missing_annotation_files")), F.lit("manifest_requires_evaluation_loader_verification"))))
    found = one.select(F.explode(blockers).alias("key"))
    return found.select(F.lit("gold_readiness").alias("section"), F.lit("blocker").alias("item"), "key", F.lit(1).cast("long").alias("n"))


def dataset(sections: list[DataFrame]) -> DataFrame:
    """The report: the sections' rows."""
    return reduce(DataFrame.unionByName, sections)
