"""Golden sets and predictions: JSON lines with fixed schemas, and the proof of where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.sources.inputs import file_inventory, strict_json

PLACE = "struct<source_file:string,page_no:int,table_name:string,row_label:string,column_label:string>"
FACTS = f"record_type string, record_id string, company_id string, period string, statement_scope string, period_type string, metric string, normalized_value string, unit string, currency string, source {PLACE}"
PREDICTIONS = f"record_type string, prediction_id string, company_id string, period string, statement_scope string, period_type string, metric string, value string, unit string, currency string, source {PLACE}"
ANSWERS = f"record_type string, record_id string, question string, answer_type string, expected_answer string, question_id string, answer string, source {PLACE}"


def _read(spark: SparkSession, path: str, schema: str, record_type: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).filter(F.col("record_type") == record_type).drop("record_type")


def golden_facts(spark: SparkSession, path: str) -> DataFrame:
    found = _read(spark, path, FACTS, "financial_fact")
    return found.withColumn("normalized_value", F.col("normalized_value").cast("decimal(38,18)"))


def predicted_facts(spark: SparkSession, path: str) -> DataFrame:
    found = _read(spark, path, PREDICTIONS, "financial_fact_prediction")
    return found.withColumn("value", F.col("value").cast("decimal(38,18)"))


def answers(spark: SparkSession, path: str, predicted: bool = False) -> DataFrame:
    return _read(spark, path, ANSWERS, "question_answer_prediction" if predicted else "question_answer")


def manifest(text: str) -> dict:
    """The manifest, with the keys it must have."""
    found = strict_json(text)
    missing = {"schema_version", "dataset_kind", "annotation_files", "tolerance"} - set(found)
    if missing:
        raise ValueError(f"manifest lacks {sorted(missing)}")
    if found["dataset_kind"] == "real":
        proof = found.get("provenance") or {}
        if len(set(proof.get("reviewers", ()))) < 2 or proof.get("status") != "approved":
            raise ValueError("a real set needs two reviewers and approval")
    return found


def provenance_faults(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(path, fault) for expected files (path relative to the folder, sha256) that are missing or differ."""
    files = file_inventory(spark, folder).select(F.regexp_replace("path", rf"^.*?{folder.rstrip('/').split('://')[-1]}/", "").alias("path"), F.col("sha256").alias("found"))
    both = expected.join(files, "path", "left")
    return both.select("path", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "hash_mismatch").alias("fault")).filter("fault IS NOT NULL")
