"""Layout and evidence: reading order of recognized pages, leaves of JSON answers, closure of evidence, recomputed plans."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.numbers import parse_strict

#: Rules of conversion, by source and target unit.
RULES = (
    ("元", "元", "IDENTITY_CNY_YUAN_V1", "1"),
    ("万元", "万元", "IDENTITY_CNY_WANYUAN_V1", "1"),
    ("元", "万元", "CNY_YUAN_TO_WANYUAN_V1", "0.0001"),
    ("万元", "元", "CNY_WANYUAN_TO_YUAN_V1", "10000"),
    ("%", "%", "IDENTITY_PERCENT_V1", "1"),
)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Boxes by the middle of their height; a box joins the open row if it is off its mean by half a height at most."""
    pdf = pdf.assign(mid=(pdf.top + pdf.bottom) / 2, height=pdf.bottom - pdf.top).sort_values(["doc", "page_no", "mid", "left"], kind="stable")
    numbers, page, n, total, count, tall = [], None, 0, 0.0, 0, 0.0
    for doc, page_no, mid, height in zip(pdf.doc, pdf.page_no, pdf.mid, pdf.height):
        if (doc, page_no) != page:
            page, n, total, count, tall = (doc, page_no), 0, mid, 1, height
        elif abs(mid - total / count) <= max(height, tall) / 2:
            total, count, tall = total + mid, count + 1, max(tall, height)
        else:
            n, total, count, tall = n + 1, mid, 1, height
        numbers.append(n)
    pdf = pdf.assign(row_no=numbers).sort_values(["doc", "page_no", "row_no", "left"], kind="stable")
    return pdf.assign(token_no=pdf.groupby(["doc", "page_no"]).cumcount() + 1)[["doc", "page_no", "row_no", "token_no", "text", "confidence"]]


def _whole_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages lie together in a partition; the last one of a batch waits for the next batch."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf])
        if len(pdf):
            last = (pdf.doc == pdf.doc.iloc[-1]) & (pdf.page_no == pdf.page_no.iloc[-1])
            held = pdf[last]
            yield _ordered(pdf[~last])
    if held is not None:
        yield _ordered(held)


def reading_order(boxes: DataFrame) -> DataFrame:
    """(doc, page_no, row_no, token_no, text, confidence) of recognized boxes with relative corners.

    Boxes without text, area or a confidence between 0 and 1 are left out.
    """
    good = boxes.filter((F.trim("text") != "") & F.col("confidence").between(0, 1) & (F.col("left") < F.col("right")) & (F.col("top") < F.col("bottom")))
    columns = good.select(F.col("doc").cast("string").alias("doc"), F.col("page_no").cast("int").alias("page_no"), "left", "top", "right", "bottom", "text", "confidence")
    together = columns.repartition("doc", "page_no").sortWithinPartitions("doc", "page_no")
    return together.mapInPandas(_whole_pages, "doc string, page_no int, row_no int, token_no int, text string, confidence double")


def page_texts(tokens: DataFrame) -> DataFrame:
    """The text of each page: rows as lines, tokens with blanks."""
    rows = tokens.groupBy("doc", "page_no", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_no", "text"))), lambda t: t.text), " ").alias("line"))
    return rows.groupBy("doc", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r.line), "\n").alias("text"))


def leaves(value: object, path: str = "") -> list[tuple[str, str]]:
    """JSON pointers of all leaves, empty objects and lists included, with their values as JSON."""
    if isinstance(value, dict) and value:
        return [x for k in sorted(value) for x in leaves(value[k], f"{path}/{k.replace('~', '~0').replace('/', '~1')}")]
    if isinstance(value, list) and value:
        return [x for k, v in enumerate(value) for x in leaves(v, f"{path}/{k}")]
    return [(path, json.dumps(value, ensure_ascii=False))]


def json_leaves(df: DataFrame, column: str) -> DataFrame:
    """All columns, and `pointer` and `leaf` for every leaf of a JSON column."""

    def found(texts):
        return texts.map(lambda t: [{"pointer": p, "leaf": v} for p, v in leaves(json.loads(t))] if t else [])

    found.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(found, "array<struct<pointer:string,leaf:string>>")
    return df.withColumn("_l", F.explode(udf(column))).select(*df.columns, "_l.*")


def open_evidence(facts: DataFrame, regions: DataFrame) -> DataFrame:
    """Facts (document_id, region_id, raw_value, evidence_text, page_no) with the first thing that breaks their evidence.

    The value must stand in its evidence, the region must exist in the immutable input, hold the value and be on the page.
    """
    r = regions.select("document_id", "region_id", F.col("text").alias("_text"), F.col("page_no").alias("_page"))
    both = facts.join(r, ["document_id", "region_id"], "left")
    fault = F.when(~F.contains("evidence_text", F.col("raw_value")), "value_not_in_evidence").when(F.col("_text").isNull(), "unknown_region").when(~F.contains("_text", F.col("raw_value")), "value_not_in_region").when(~F.col("page_no").eqNullSafe(F.col("_page")), "other_page")
    return both.select(*facts.columns, fault.alias("fault")).filter("fault IS NOT NULL")


def _rule(field: int, source: Column, target: Column) -> Column:
    out = F.lit(None).cast("string")
    for rule in RULES:
        out = F.when((source == rule[0]) & (target == rule[1]), rule[field]).otherwise(out)
    return out


def recomputed(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Candidates (candidate_id, raw_value, source_unit, target_unit, negative) with their value and what is wrong with the plan.

    A plan (candidate_id, rule_id, factor, proposal) must name the registered rule and propose the value that is printed.
    """
    both = candidates.join(plans, "candidate_id", "left")
    printed = F.when(F.col("negative"), parse_strict(F.col("raw_value"), True)).otherwise(parse_strict(F.col("raw_value")))
    rule, factor = _rule(2, F.col("source_unit"), F.col("target_unit")), _rule(3, F.col("source_unit"), F.col("target_unit")).cast("decimal(9,4)")
    fault = F.when(F.col("rule_id").isNull(), "no_plan").when(rule.isNull(), "unknown_conversion").when((F.col("rule_id") != rule) | (F.col("factor").try_cast("decimal(9,4)") != factor), "other_rule").when(printed.isNull(), "unreadable").when(F.coalesce(F.col("proposal").try_cast("decimal(38,8)") != printed, F.lit(True)), "other_value")
    value = (printed.cast("decimal(28,8)") * factor).cast("decimal(38,8)")
    return both.select("candidate_id", F.when(fault.isNull(), value).alias("normalized_value"), rule.alias("rule_id"), fault.alias("fault"))
