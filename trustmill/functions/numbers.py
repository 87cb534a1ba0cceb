"""Numbers in reports: parsing, units, tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustmill.model import MAX_ABS

#: A number as reports print it, and texts that stand for no value.
NUMBER = r"-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+\.\d+|-?\d+"
NO_VALUE = ("", "--", "-", "N/A", "nan", "None")
STRICT = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$"
#: Conversions between units, as exact factors.
CONVERSIONS = {("元", "万元"): "0.0001", ("万元", "元"): "10000"}


def numbers(text: Column) -> Column:
    """All numbers of a text, in order, as they are written."""
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))


def to_number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).try_cast("decimal(38,8)")


def convert(value: Column, source_unit: Column, target_unit: Column) -> Column:
    """Exact decimals with four places; other pairs of units leave the value."""
    factor = F.lit(1).cast("decimal(9,4)")
    for (a, b), by in CONVERSIONS.items():
        factor = F.when((source_unit == a) & (target_unit == b), F.lit(by).cast("decimal(9,4)")).otherwise(factor)
    return F.bround((value.cast("decimal(28,8)") * factor).cast("decimal(38,12)"), 4).cast("decimal(24,4)")


def parse(raw: Column, source_unit: Column, target_unit: Column) -> Column:
    """A printed value in the target unit; null where the text is none or too large. (x) is negative."""
    text = F.trim(raw)
    negative = text.startswith("(") & text.endswith(")")
    cleaned = F.regexp_replace(F.btrim(text, F.lit("()")), "[,%]", "")
    value = F.when(cleaned.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), cleaned.try_cast("decimal(38,8)"))
    value = F.when(negative, -value).otherwise(value)
    return F.when(~text.isin(*NO_VALUE) & (F.abs(value) <= MAX_ABS), convert(value, source_unit, target_unit))


def parse_strict(raw: Column, parentheses: bool = False) -> Column:
    """Exactly grouped numbers only; null where a caller must raise a violation."""
    inner = F.when(raw.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.substring(raw, F.lit(2), F.length(raw) - 2))) if parentheses else F.lit(None).cast("string")
    text = F.coalesce(inner, raw)
    return F.when(text.rlike(STRICT), F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(38,8)"))


def target_unit(cn_name: Column, field_name: Column) -> Column:
    percent = F.contains(cn_name, F.lit("%")) | F.contains(field_name, F.lit("ratio")) | F.contains(field_name, F.lit("yoy")) | F.contains(field_name, F.lit("qoq"))
    return F.when(percent, "%").when(F.contains(cn_name, F.lit("万元")), "万元").otherwise("元")


def within(actual: Column, expected: Column, absolute: Column, relative: Column) -> Column:
    """Inclusive: off by at most the larger of both tolerances."""
    return F.abs(actual - expected) <= F.greatest(absolute, relative * F.abs(expected))


def two_places(value: Column) -> Column:
    """A double with two places, by its exact binary value and ties to even, as C and Python print it.

    `format_string` rounds the shortest decimal of the double half up instead. All steps are exact: the fraction is cut into 26
    bits and the rest, and a hundred times either has at most 53.
    """
    x = value.cast("double")
    whole = F.floor(F.abs(x))
    bits = (F.abs(x) - whole.cast("double")) * float(1 << 26)
    hundred = F.floor(bits) * 100
    cents, over = F.floor(hundred / F.lit(float(1 << 26))), F.pmod(hundred, F.lit(1 << 26))
    rest, half = (bits - F.floor(bits).cast("double")) * 100, ((1 << 25) - over).cast("double")
    cents = cents + F.when((rest > half) | ((rest == half) & (cents % 2 == 1)), 1).otherwise(0)
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    text = F.concat(sign, (whole + F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(F.abs(x) < float(1 << 62), text).otherwise(F.format_string("%.2f", x))


def growth_or_null(value: Column) -> Column:
    return F.when(value.between(-1000, 1000), value)


def ratio_or_null(value: Column) -> Column:
    return F.when(value.between(0, 100), value)


def row_issues(values: dict[str, Column]) -> Column:
    """Issues of an extracted row: too few values, growth rates and ratios out of range."""
    filled = sum((v.isNotNull().cast("int") for v in values.values()), F.lit(0))
    share = filled / F.lit(max(1, len(values)))
    issues = [F.when(share < 0.12, F.concat(F.lit("non_null_ratio_too_low:"), F.format_string("%.3f", share.cast("double"))))]
    issues += [F.when(~v.between(-1000, 1000), F.lit(f"invalid_growth:{k}")) for k, v in values.items() if "yoy" in k or "qoq" in k]
    issues += [F.when(~v.between(0, 100), F.lit("invalid_asset_liability_ratio")) for k, v in values.items() if k == "asset_liability_ratio"]
    return F.array_compact(F.array(*issues))
