"""Issue lists of facts: (code, message, field) as canonical JSON texts, and back, with what is wrong with a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUES = "array<struct<code:string,field:string,message:string>>"
NAMES = ("code", "field", "message")
#: Faults, in the order in which they are told.
FAULTS = ("not JSON", "not a list", "not an object", "unknown field", "code or message is missing", "field is no text")


def write(issues: Column) -> Column:
    """A JSON array with sorted names; a null field is written, a null list is an empty one."""
    full = F.transform(F.coalesce(issues, F.array().cast(ISSUES)), lambda x: F.struct(*(x[n].alias(n) for n in NAMES)))
    return F.to_json(full, {"ignoreNullFields": "false"})


def fault(text: Column) -> Column:
    """The first of FAULTS that a text has; null if none."""
    parsed = F.try_parse_json(text)
    listed = F.rlike(F.trim(text), F.lit(r"^\["))
    items = F.when(listed, F.try_variant_get(parsed, "$", "array<variant>"))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    is_text = lambda v, name: F.coalesce(kind(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.lit(False)) & (F.trim(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))) != "")
    is_object = lambda v: F.startswith(kind(v), F.lit("OBJECT"))
    odd_name = lambda v: F.size(F.array_except(F.coalesce(keys(v), F.array().cast("array<string>")), F.lit(list(NAMES)))) > 0
    return (
        F.when(parsed.isNull(), FAULTS[0]).when(~listed, FAULTS[1]).when(F.exists(items, lambda v: ~is_object(v)), FAULTS[2])
        .when(F.exists(items, odd_name), FAULTS[3]).when(F.exists(items, lambda v: ~(is_text(v, "code") & is_text(v, "message"))), FAULTS[4])
        .when(F.exists(items, lambda v: (kind(F.try_variant_get(v, "$.field", "variant")) != "VOID") & ~is_text(v, "field")), FAULTS[5])
    )


def read(text: Column) -> Column:
    """The issues of a text; null where it has a fault, which must be looked at."""
    return F.when(fault(text).isNull(), F.from_json(text, ISSUES))
