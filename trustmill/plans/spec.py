"""The declarative query: what is asked, checked before any plan is built."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from trustmill.functions.periods import PERIOD
from trustmill.model import Registry, SpecError

#: Kinds of analysis.
ANALYSES = ("single_metric", "trend", "topn_metric", "comparison", "filter", "intersection_topn", "reason")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: float


@dataclass(frozen=True)
class QuerySpec:
    analysis_type: str
    metric: str
    metrics: tuple[str, ...] = ()
    table: str = ""
    stock_code: str = ""
    stock_abbr: str = ""
    report_period: str = ""
    start_period: str = ""
    end_period: str = ""
    periods: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    select_fields: tuple[str, ...] = ()
    top_n: int = 10
    post_compute: str | None = None
    calculation: Mapping[str, str] = field(default_factory=dict)
    chart_request: str | None = None

    def __post_init__(self) -> None:
        if self.analysis_type not in ANALYSES:
            raise SpecError(f"unknown analysis type {self.analysis_type!r}")
        if not isinstance(self.top_n, int) or isinstance(self.top_n, bool) or not 1 <= self.top_n <= 100:
            raise SpecError("top_n must be a whole number from 1 to 100")
        if self.metrics and self.metric not in self.metrics:
            raise SpecError("metric must be one of metrics")
        for x in (self.metric, *self.metrics, *self.select_fields):
            if not isinstance(x, str) or not x:
                raise SpecError("names must be non-empty texts")
        for period in (self.report_period, self.start_period, self.end_period, *self.periods):
            if period and not PERIOD.match(period):
                raise SpecError(f"invalid report period {period!r}")
        for f in self.filters:
            if isinstance(f.value, bool) or not isinstance(f.value, (int, float)) or not math.isfinite(f.value):
                raise SpecError("filter values must be finite numbers")

    @classmethod
    def of(cls, given: Mapping[str, Any]) -> QuerySpec:
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise SpecError(f"unknown keys {sorted(unknown)}")
        x = {k: v for k, v in given.items() if v is not None}
        for name in ("metrics", "periods", "select_fields"):
            if isinstance(x.get(name), str):
                raise SpecError(f"{name} must be a list")
            x[name] = tuple(x.get(name, ()))
        x["filters"] = tuple(f if isinstance(f, Filter) else Filter(**f) for f in x.get("filters", ()))
        return cls(**x)

    def check(self, registry: Registry) -> None:
        """Every name is known; values never take part in that."""
        base = self.table or registry.table_of_metric(self.metric)
        for name in (self.metric, *self.metrics, *self.select_fields, *(f.field for f in self.filters)):
            registry.resolve(name, base)
        for f in self.filters:
            if f.op not in registry.operators:
                raise SpecError(f"unknown operator {f.op!r}")


def from_slots(intent: str, slots: Mapping[str, Any], registry: Registry | None = None) -> QuerySpec:
    """A query from plain slots, with the columns that each kind of analysis shows."""
    registry = registry or Registry()
    metric = slots.get("metric")
    if not isinstance(metric, str) or not metric:
        raise SpecError("slots need a metric")
    shown = {
        "single_metric": (metric, "stock_abbr", "report_period"),
        "trend": ("report_period", metric, "stock_abbr"),
        "topn_metric": ("stock_code", "stock_abbr", metric, "report_period"),
        "comparison": ("stock_code", "stock_abbr", metric),
        "reason": ("stock_code", "stock_abbr", "report_period", metric),
    }
    if intent not in shown:
        raise SpecError(f"unknown analysis type {intent!r}")
    kept = {k: slots.get(k, "") for k in ("stock_abbr", "stock_code", "report_period", "start_period", "end_period")}
    return QuerySpec(intent, metric, table=registry.table_of_metric(metric), select_fields=shown[intent], top_n=slots.get("top_n", 10), **kept)
