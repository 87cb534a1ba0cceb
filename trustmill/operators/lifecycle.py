"""The life of facts and sources: candidates, authority, reviews, projections.

Tables are immutable; a change is a new version made from the old one and a log. Rules that must hold are queries for what
breaks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustmill.functions.numbers import parse
from trustmill.operators import reviews

BUSINESS_KEY = reviews.CELL


def from_candidates(candidates: DataFrame) -> DataFrame:
    """Facts from candidates (raw_value, units, page_no, issues): all wait for review; a missing page is one more issue."""
    value = parse(F.col("raw_value"), F.col("source_unit"), F.col("target_unit"))
    issues = F.when(F.col("page_no").isNull(), F.array_append("issues", "missing_page")).otherwise(F.col("issues"))
    return candidates.withColumns({"normalized_value": value, "validation_status": F.lit("NEEDS_REVIEW"), "issues": issues})


def select_authoritative(reports: DataFrame) -> DataFrame:
    """Adds status and reason: one full, current report for each company and period.

    Order: revised before original, later publication, smaller copy index. Equal best ones all need review.
    """
    excluded = F.when(~F.col("in_master"), F.struct(F.lit("needs_review").alias("status"), F.lit("outside_company_master").alias("reason")))
    excluded = excluded.when(F.col("is_summary"), F.struct(F.lit("skipped_summary").alias("status"), F.lit("summary_not_authoritative").alias("reason")))
    excluded = excluded.when(F.col("is_english"), F.struct(F.lit("superseded").alias("status"), F.lit("english_translation").alias("reason")))
    excluded = excluded.when(F.col("revision") == "pre_revision", F.struct(F.lit("superseded").alias("status"), F.lit("pre_revision").alias("reason")))
    score = F.struct((F.col("revision") == "revised").cast("int"), F.coalesce("published_date", F.lit("")), -F.col("copy_index"))
    marked = reports.withColumn("_out", excluded).withColumn("_score", F.when(F.col("_out").isNull(), score))
    # the best score and how often it occurs come from one aggregate; groups are joined, not windowed
    best = marked.filter("_score IS NOT NULL").groupBy("stock_code", "period").agg(F.max("_score").alias("_best"))
    ties = marked.join(best, ["stock_code", "period"]).filter("_score = _best").groupBy("stock_code", "period").agg(F.count("*").alias("_n"))
    found = marked.join(best.join(ties, ["stock_code", "period"]), ["stock_code", "period"], "left")
    top = F.col("_score") == F.col("_best")
    of = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    ranked = F.when(top & (F.col("_n") == 1), of("selected", "authoritative_version")).when(top, of("needs_review", "ambiguous_authoritative_version")).when(F.col("_n") == 1, of("superseded", "higher_ranked_version_selected")).otherwise(of("superseded", "higher_ranked_version_exists"))
    return found.withColumn("_d", F.coalesce("_out", ranked)).select(*reports.columns, "_d.status", "_d.reason")


def reconcile(current: DataFrame, new: DataFrame, owner: str = "BATCH") -> tuple[DataFrame, DataFrame]:
    """(decisions, conflicts): the new set (stock_code, period, source_key) replaces what the owner holds.

    Decisions name what becomes of every source: CURRENT, SUPERSEDED or REMOVED. Slots of another owner conflict.
    """
    old = current.filter("authority_status = 'CURRENT'").select("stock_code", "period", F.col("source_key").alias("old_key"), "source_owner")
    both = old.join(new.select("stock_code", "period", F.col("source_key").alias("new_key")), ["stock_code", "period"], "full_outer")
    conflicts = both.filter((F.col("source_owner") != owner) & F.col("new_key").isNotNull() & ~F.col("old_key").eqNullSafe(F.col("new_key")))
    own = both.filter(F.col("source_owner").isNull() | (F.col("source_owner") == owner))
    fate = F.array_compact(F.array(F.when(F.col("new_key").isNotNull(), F.struct(F.col("new_key").alias("source_key"), F.lit("CURRENT").alias("status"))), F.when(F.col("old_key").isNotNull() & ~F.col("old_key").eqNullSafe(F.col("new_key")), F.struct(F.col("old_key").alias("source_key"), F.when(F.col("new_key").isNull(), "REMOVED").otherwise("SUPERSEDED").alias("status")))))
    return own.select("stock_code", "period", F.explode(fate).alias("x")).select("stock_code", "period", "x.*"), conflicts


def activate(sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sources with chosen ones (source_key, source_file, stock_code, period) CURRENT; other versions of the file, and other current ones of the period, are superseded."""
    keys = chosen.select("source_key", F.lit(True).alias("_chosen"))
    files = chosen.select("source_file", F.lit(True).alias("_file")).distinct()
    slots = chosen.select("stock_code", "period", F.lit(True).alias("_slot")).distinct()
    found = sources.join(keys, "source_key", "left").join(files, "source_file", "left").join(slots, ["stock_code", "period"], "left")
    replaced = (F.col("_file").isNotNull() | F.col("_slot").isNotNull()) & (F.col("authority_status") == "CURRENT")
    status = F.when(F.col("_chosen").isNotNull(), "CURRENT").when(replaced, "SUPERSEDED").otherwise(F.col("authority_status"))
    return found.withColumn("authority_status", status).select(*sources.columns)


def register_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that facts name and the table lacks: CURRENT where the slot is free, else NEEDS_REVIEW."""
    unknown = facts.select("source_key", "stock_code", "period").distinct().join(sources.select("source_key"), "source_key", "left_anti")
    taken = sources.filter("authority_status = 'CURRENT'").select("stock_code", "period").distinct().withColumn("_taken", F.lit(True))
    first = Window.partitionBy("stock_code", "period").orderBy("source_key")
    found = unknown.join(taken, ["stock_code", "period"], "left").withColumn("_n", F.row_number().over(first))
    return found.select("source_key", "stock_code", "period", F.when(F.col("_taken").isNull() & (F.col("_n") == 1), "CURRENT").otherwise("NEEDS_REVIEW").alias("authority_status"))


def upsert_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts by fact_key: new values win, the review's outcome stays."""
    kept = {"validation_status", "validation_issues", "review_version"}
    n = new.select(F.col("fact_key"), *(F.col(c).alias(f"_{c}") for c in new.columns if c != "fact_key"), F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, "fact_key", "full_outer")
    take = lambda c: F.when(F.col("_old").isNotNull() & (F.lit(c in kept) | F.col("_new").isNull()), F.col(c)).otherwise(F.col(f"_{c}"))
    return both.select("fact_key", *(take(c).alias(c) for c in old.columns if c != "fact_key"))


def upsert_wide(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key; a new null leaves the old value."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in new.columns if c not in keys))
    both = old.join(n, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in old.columns if c not in keys))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate, so a key with many rows is combined before rows move."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def projection(trusted: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(wide rows, conflicts): one row for a company and period, a column for each metric; two facts for a cell conflict."""
    wide = trusted.groupBy("stock_code", "period").pivot("metric", metrics).agg(F.max("normalized_value"))
    conflicts = trusted.groupBy("stock_code", "period", "metric").count().filter("count > 1")
    return wide, conflicts


def unchanged(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files of which path, size, time, hash, context and extractor version are what the state has."""
    return files.join(state, ["path", "size", "mtime", "sha256", "context", "extractor_version"], "left_semi")


def context_fingerprint(*hashes: Column, version: str) -> Column:
    return F.sha2(F.to_json(F.struct(*(h.alias(f"h{k}") for k, h in enumerate(hashes)), F.lit(version).alias("version"))), 256)


def violations(facts: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """What breaks the rules of facts and sources, by rule; all must be empty."""
    current = sources.filter("authority_status = 'CURRENT'")
    kind = F.when(F.col("table_name") == "balance_sheet", "instant").otherwise("duration")
    return {
        "two_current_sources": current.groupBy("stock_code", "period").count().filter("count > 1"),
        "slot_differs_from_status": sources.filter(~(F.col("current_slot").eqNullSafe(F.lit("CURRENT")) == (F.col("authority_status") == "CURRENT"))),
        "file_of_two_periods": sources.groupBy("source_file").agg(F.count_distinct("stock_code", "period").alias("n")).filter("n > 1"),
        "validated_without_place": facts.filter("validation_status = 'VALIDATED' AND (page_no IS NULL OR table_name IS NULL OR row_label IS NULL OR column_label IS NULL)"),
        "period_type_of_other_table": facts.filter(F.col("period_type") != kind),
        "value_out_of_range": facts.filter("abs(normalized_value) > 1e15 OR confidence NOT BETWEEN 0 AND 1 OR page_no < 1"),
        "two_trusted_facts": facts.filter("validation_status = 'VALIDATED'").join(current.select("source_key"), "source_key", "left_semi").groupBy(*BUSINESS_KEY).count().filter("count > 1"),
    }
