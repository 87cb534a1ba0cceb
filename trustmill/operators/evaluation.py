"""Golden sets against predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.numbers import within
from trustmill.functions.text import same_text, source_path

KEY = ["company_id", "period", "statement_scope", "period_type", "metric"]
PLACES = ("table_name", "row_label", "column_label")


def source_matches(expected: str, actual: str) -> Column:
    """File and page always; a table, row or column only where the golden source has one."""
    e, a = F.col(expected), F.col(actual)
    found = (source_path(e["source_file"]) == source_path(a["source_file"])) & (e["page_no"] == a["page_no"])
    for place in PLACES:
        found = found & (e[place].isNull() | e[place].eqNullSafe(a[place]))
    return F.coalesce(found, F.lit(False))


def compare_facts(golden: DataFrame, predicted: DataFrame, absolute: str = "0.01", relative: str = "0") -> DataFrame:
    """Golden facts with their prediction's outcome: found, value_ok, source_ok, failure."""
    p = predicted.select(*KEY, F.col("value").alias("p_value"), F.col("unit").alias("p_unit"), F.col("currency").alias("p_currency"), F.col("source").alias("p_source"), F.lit(True).alias("_p"))
    both = golden.join(p, KEY, "left")
    found = F.col("_p").isNotNull()
    value_ok = F.coalesce(within(F.col("p_value"), F.col("normalized_value"), F.lit(absolute).cast("decimal(38,18)"), F.lit(relative).cast("decimal(9,6)")) & (F.col("p_unit") == F.col("unit")) & F.col("p_currency").eqNullSafe(F.col("currency")), F.lit(False))
    source_ok = found & source_matches("source", "p_source")
    failure = F.when(~found, "missing_prediction").when(~value_ok, "value_mismatch").when(~source_ok, "source_mismatch")
    return both.select("record_id", *KEY, found.alias("found"), value_ok.alias("value_ok"), source_ok.alias("source_ok"), failure.alias("failure"))


def unexpected(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    return predicted.join(golden.select(*KEY), KEY, "left_anti")


def compare_answers(golden: DataFrame, predicted: DataFrame, absolute: str = "0.01") -> DataFrame:
    """Answers by question: numbers within a tolerance, texts up to blanks."""
    p = predicted.select(F.col("question_id").alias("record_id"), F.col("answer"), F.lit(True).alias("_p"))
    both = golden.join(p, "record_id", "left")
    number = within(F.col("answer").try_cast("decimal(38,18)"), F.col("expected_answer").try_cast("decimal(38,18)"), F.lit(absolute).cast("decimal(38,18)"), F.lit(0).cast("decimal(9,6)"))
    ok = F.when(F.col("answer_type") == "number", number).otherwise(same_text(F.col("answer"), F.col("expected_answer")))
    return both.select("record_id", F.col("_p").isNotNull().alias("found"), F.coalesce(ok, F.lit(False)).alias("answer_ok"))


def ratio_rows(counts: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric, numerator, denominator, value) of one row of counts; no value for a zero denominator."""
    each = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(a).cast("long").alias("numerator"), F.col(b).cast("long").alias("denominator")) for name, (a, b) in ratios.items()))
    rows = counts.select(F.explode(each).alias("x")).select("x.*")
    return rows.withColumn("value", F.try_divide(F.col("numerator").cast("double"), F.col("denominator")))


def summary(facts: DataFrame, answers: DataFrame, n_predicted: DataFrame) -> DataFrame:
    """Recall, cell accuracy, precision, answers and sources as ratios."""
    one = facts.agg(F.count("*").alias("golden"), F.count_if("found").alias("found"), F.count_if(F.col("value_ok")).alias("right"), F.count_if("source_ok").alias("sourced"))
    more = answers.agg(F.count("*").alias("questions"), F.count_if("answer_ok").alias("answered"))
    row = one.withColumns({"questions": more.select("questions").scalar(), "answered": more.select("answered").scalar(), "predicted": n_predicted.agg(F.count("*").alias("n")).scalar()})
    return ratio_rows(row, {"fact_recall": ("found", "golden"), "cell_accuracy": ("right", "golden"), "fact_precision": ("right", "predicted"), "answer_accuracy": ("answered", "questions"), "source_accuracy": ("sourced", "golden")})


def title_matches(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """title_key with state: matched, missing (no file), orphan (no metadata), duplicate (more files)."""
    f = files.groupBy("title_key").agg(F.count("*").alias("files"))
    m = metadata.groupBy("title_key").agg(F.count("*").alias("rows"))
    state = F.when(F.col("files").isNull(), "missing").when(F.col("rows").isNull(), "orphan").when((F.col("files") > 1) | (F.col("rows") > 1), "duplicate").otherwise("matched")
    return f.join(m, "title_key", "full_outer").select("title_key", state.alias("state"))


def partition_faults(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, fault): ids missing, unknown or repeated where both sets must be the same."""
    missing = expected.select(key).join(actual.select(key), key, "left_anti").withColumn("fault", F.lit("missing"))
    unknown = actual.select(key).join(expected.select(key), key, "left_anti").withColumn("fault", F.lit("unknown"))
    twice = actual.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("fault"))
    return missing.unionByName(unknown).unionByName(twice)
