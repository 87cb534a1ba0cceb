"""Readers of the inputs: field lists, companies, question sets, page texts, manifests."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
FIELD_LIST = "table string, field string, cn_name string, raw_type string, description string"


def read_field_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fields, violations) of a CSV list; names must be identifiers and unique in their table."""
    fields = spark.read.schema(FIELD_LIST).csv(path, header=True)
    bad = fields.filter(~F.col("field").rlike(IDENTIFIER.pattern) | F.col("field").isNull()).select("table", "field", F.lit("bad_name").alias("reason"))
    twice = fields.groupBy("table", "field").count().filter("count > 1").select("table", "field", F.lit("duplicate").alias("reason"))
    return fields, bad.unionByName(twice)


def struct_of(fields: list[tuple[str, str]]):
    """A schema from (field, raw type): whole numbers, decimals, and texts for all others."""
    from pyspark.sql import types as T

    kind = lambda raw: T.LongType() if "int" in raw.lower() else T.DecimalType(24, 4) if re.search("decimal|float|double", raw.lower()) else T.StringType()
    return T.StructType([T.StructField(name, kind(raw)) for name, raw in fields])


def company_master(rows: DataFrame) -> DataFrame:
    """(code, abbr, name, ord) with six-digit codes; the last row of a code wins."""
    coded = rows.filter("code IS NOT NULL AND abbr IS NOT NULL").withColumn("stock_code", F.lpad(F.col("code").cast("long").cast("string"), 6, "0"))
    return coded.groupBy("stock_code").agg(F.max_by(F.trim("abbr"), "ord").alias("stock_abbr"), F.max_by(F.trim(F.coalesce("name", F.lit(""))), "ord").alias("company_name"))


def questions(rows: DataFrame) -> DataFrame:
    """(id, kind, turn, question) from a JSON array of turns like [{"Q": ...}]."""
    turns = F.from_json("questions", "array<struct<Q:string>>", {"mode": "FAILFAST"})
    return rows.select("id", "kind", F.posexplode(turns).alias("turn", "q")).select("id", "kind", "turn", F.col("q.Q").alias("question"))


def research_metadata(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row for a title; equal repetitions are one, titles with differing rows are left out altogether."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("_n"), F.first(F.struct(*values)).alias("_v")).filter("_n = 1").select(key, "_v.*")


def pages_of(text: Column, separator: str = "\f") -> Column:
    """(page number from 0, text) of a text with page breaks; a blank last page goes."""
    parts = F.split(text, separator, -1)
    return F.when((F.size(parts) > 1) & (F.trim(F.element_at(parts, -1)) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", ""))


def longer_text(native: Column, other: Column) -> Column:
    """The text with more characters that are no blanks; the native one if equal."""
    return F.when(visible_length(F.coalesce(native, F.lit(""))) >= visible_length(F.coalesce(other, F.lit(""))), native).otherwise(other)


def needs_ocr(text: Column, has_large_image: Column, policy: str = "auto", least: int = 80) -> Column:
    """Pages to recognize: all, those with little text, those with a statement's title or a large image."""
    if policy == "always":
        return F.lit(True)
    title = F.rlike(text, F.lit(r"(?m)^\s*(?:(?:合并|母公司)?(?:资产负债表|利润表|损益表|现金流量表)|主要会计数据(?:和|及)财务指标|主要财务指标)\s*$"))
    return (visible_length(text) < least) | title | has_large_image


def merged_text(layer: Column, recognized: Column) -> Column:
    """Both texts, or the one that holds the other."""
    layer, recognized = F.coalesce(layer, F.lit("")), F.coalesce(recognized, F.lit(""))
    return F.when(F.contains(layer, recognized), layer).when(F.contains(recognized, layer), recognized).otherwise(F.concat_ws("\n", layer, recognized))


def regions(text: Column, longest: int = 4000) -> Column:
    """(line_no, part, text) of the lines that aren't blank, stripped, in parts of bounded length."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line, k: F.struct((k + 1).alias("line_no"), F.trim(line).alias("text")))
    starts = lambda x: F.sequence(F.lit(0), F.floor((F.length(x.text) - 1) / longest).cast("int"))
    cut = lambda x: F.transform(starts(x), lambda p: F.struct(x.line_no.alias("line_no"), p.alias("part"), F.substring(x.text, p * longest + 1, F.lit(longest)).alias("text")))
    return F.flatten(F.transform(F.filter(lines, lambda x: x.text != ""), cut))


def page_windows(pages: Column, size: int = 3) -> Column:
    """(page_no, page_window) of an array of pages: windows of so many pages, by place."""
    return F.transform(pages, lambda _, k: F.struct((k + 1).alias("page_no"), F.floor(k / size).alias("page_window")))


def routing_sample(pages: Column, headings: tuple[str, ...], first: int = 3, last: int = 2) -> Column:
    """Numbers of the pages that show what a document is: the first and last ones, and from each page with one of the
    headings the page before to the second page after it."""
    n = F.size(pages)
    held = lambda page: reduce(lambda a, b: a | b, (F.contains(page, F.lit(h)) for h in headings))
    near = F.transform(F.filter(F.transform(pages, lambda page, k: F.when(held(page), k + 1)), lambda k: k.isNotNull()), lambda k: F.sequence(F.greatest(k - 1, F.lit(1)), F.least(k + 2, n)))
    ends = F.concat(F.sequence(F.lit(1), F.least(n, F.lit(first))), F.sequence(F.greatest(n - last + 1, F.lit(1)), n))
    return F.when(n > 0, F.array_sort(F.array_distinct(F.concat(ends, F.flatten(near))))).otherwise(F.array().cast("array<int>"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, length, sha256 of the files below a folder; hashes are made where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "length", F.sha2("content", 256).alias("sha256"))


def strict_json(text: str) -> object:
    """JSON without repeated keys, NaN or infinities."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("repeated key")
        return found

    def refuse(x: str) -> None:
        raise ValueError(f"no number: {x}")

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)
