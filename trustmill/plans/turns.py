"""Turn analysis: what each turn of a conversation says changes slots, and the slots make a query or a question back.

What a turn can say, which slots that sets and which it clears is a table; so is what must be known for each kind of
analysis, and the shape of its query. A batch folds each conversation in order, a stream keeps the slots as state; both
take the same step.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trustmill.functions import periods
from trustmill.model import METRICS
from trustmill.operators.companies import resolve_companies
from trustmill.plans.dialogue import CHARTS, CLARIFY, COMPANY_SLOTS, KINDS, threshold_of, top_n_of

Slots = dict[str, Any]


class Effect(NamedTuple):
    """What saying something does to the slots."""

    sets: tuple[str, ...] = ()
    clears: tuple[str, ...] = ()


#: In the order in which they take effect.
EFFECTS = {
    "another_company": Effect(clears=COMPANY_SLOTS),
    "company": Effect(("stock_code", "stock_abbr")),
    "metrics": Effect(("metric", "metrics")),
    "period": Effect(("report_period",), ("start_period", "end_period", "periods", "needs_period_anchor")),
    "periods": Effect(("periods", "start_period", "end_period"), ("report_period", "needs_period_anchor")),
    "range": Effect(("start_period", "end_period"), ("report_period", "periods", "needs_period_anchor")),
    "relative": Effect(("needs_period_anchor",)),
    "chart": Effect(("chart_request",)),
}


class Need(NamedTuple):
    """Something that must be known for some kinds of analysis: one of the slots."""

    ask: str
    slots: tuple[str, ...]
    kinds: tuple[str, ...]


_ALL = ("single_metric", *(kind for kind, _ in KINDS))
NEEDS = (Need("company", ("stock_abbr",), ("single_metric", "trend", "comparison")), Need("metric", ("metric",), _ALL), Need("period", ("report_period", "start_period"), ("single_metric", "filter", "topn_metric", "comparison")))


class Shape(NamedTuple):
    """Fields before and after which the metrics stand (the first one alone, or all), and what the kind adds."""

    before: tuple[str, ...]
    every_metric: bool = False
    extra: tuple[tuple[str, Any], ...] = ()


_LIST = ("stock_code", "stock_abbr")
SHAPES = {
    "single_metric": Shape(("stock_abbr", "report_period")),
    "trend": Shape(("report_period", "report_year", "stock_abbr")),
    "comparison": Shape(("report_period", "report_year", "stock_abbr")),
    "topn_metric": Shape(_LIST, True),
    "filter": Shape(_LIST, True),
    "intersection_topn": Shape(_LIST, True, (("post_compute", "intersection_topn"), ("chart_request", None))),
}
#: Words for a sign, and the signs that two metrics together stand for.
SIGNS = (("为负", "<"), ("为正", ">"))
PAIRED_SIGNS = {"operating_cf_net_amount": "<", "net_profit": ">"}
DRAW_WORDS = ("绘制", "柱状图", "折线图", "饼图")
ASK_WORDS = ("多少", "哪些", "同比", "环比")


class Said(NamedTuple):
    """What a turn says by itself."""

    question: str
    company: Slots | None
    metrics: list[str]
    chart: str | None
    draws: bool


def said(question: str, company: Slots | None) -> Said:
    question = question.strip()
    named = []
    for m in METRICS.values():
        places = [(at, -len(a)) for a in m.aliases if (at := question.find(a)) >= 0]
        named += [(*min(places), m.key)] if places else []
    chart = next((kind for kind, words in CHARTS if any(w in question for w in words)), None)
    draws = any(w in question for w in DRAW_WORDS) and not any(w in question for w in ASK_WORDS)
    return Said(question, company, [key for *_, key in sorted(named, key=lambda x: x[:2])], chart, draws)


def period_said(question: str, slots: Slots) -> tuple[str, Slots] | None:
    """Which of the effects on periods a question has, and the values."""
    found = periods.resolve(question, slots)
    for name, mark in (("period", "report_period"), ("periods", "periods"), ("range", "start_period"), ("relative", "needs_period_anchor")):
        if mark in found:
            return name, found
    return None


def kind_of(question: str, slots: Slots) -> str:
    """The first kind of analysis whose words stand in a question; one of its conditions on the slots may rule it out or in."""
    text = question.lower()
    for kind, words in KINDS:
        spoken = any(w in text for w in words)
        if kind == "filter" and not slots.get("metric"):
            continue
        if spoken or kind == "comparison" and len(slots.get("periods", ())) >= 2:
            return kind
    return "single_metric"


def missing(kind: str, slots: Slots) -> str:
    """What must be asked back; an empty text if nothing."""
    if slots.get("needs_period_anchor"):
        return CLARIFY["period_anchor"]
    return next((CLARIFY[n.ask] for n in NEEDS if kind in n.kinds and not any(slots.get(s) for s in n.slots)), "")


def filters_of(question: str, metrics: list[str]) -> list[Slots]:
    value = threshold_of(question)
    below = "低于" in question or "小于" in question
    found = [] if value is None else [(metrics[0], "<" if below else ">", value)]
    found += [(metrics[0], op, 0) for word, op in SIGNS if word in question]
    if not found and len(metrics) > 1 and "且" in question:
        found = [(m, PAIRED_SIGNS[m], 0) for m in metrics if m in PAIRED_SIGNS]
    return [{"field": f, "op": op, "value": v} for f, op, v in found]


def ratio_of(question: str, metrics: list[str]) -> Slots:
    """The two metrics named last before the word for a ratio."""
    before = question.rpartition("比值")[0]
    last = sorted((at, m) for m in metrics if (at := max(before.rfind(a) for a in METRICS[m].aliases)) >= 0)[-2:]
    if len(last) < 2:
        return {}
    (_, top), (_, bottom) = last
    return {"post_compute": "ratio", "calculation": {"numerator": top, "denominator": bottom, "output_field": f"{top}_to_{bottom}_ratio"}}


def spec_of(question: str, slots: Slots) -> Slots:
    """The query that slots describe."""
    metrics, kind = list(slots.get("metrics") or [slots["metric"]]), slots["analysis_type"]
    shape = SHAPES[kind]
    spec = {
        "analysis_type": kind, "metric": metrics[0], "metrics": metrics, "table": METRICS[metrics[0]].table, "top_n": top_n_of(question), "chart_request": slots.get("chart_request"), "filters": [],
        "end_period": slots.get("end_period", slots.get("report_period", "")), **{k: slots.get(k, "") for k in ("stock_code", "stock_abbr", "report_period", "start_period")},
        **ratio_of(question, metrics), "select_fields": [*shape.before, *(metrics if shape.every_metric else metrics[:1])], **dict(shape.extra),
    }
    if kind == "trend":
        spec["chart_request"] = spec["chart_request"] or "line"
    if kind == "comparison":
        spec["periods"] = list(slots.get("periods", []))
        spec["post_compute"] = "period_comparison" if len(spec["periods"]) > 1 else None
    if kind == "filter":
        spec["filters"] = filters_of(question, metrics)
        if len(metrics) > 1 and "均高于行业均值" in question:
            spec["post_compute"] = "above_industry_mean"
    return spec


def step(slots: Slots, turn: Said) -> Slots:
    """One turn: {intent, clarify, slots, spec}. The given slots stay as they are.

    A turn that only asks for another drawing repeats the last query; whatever else it says has no effect.
    """
    last = slots.get("last_query_spec")
    if turn.draws and last:
        spec = last | {"chart_request": turn.chart or last.get("chart_request")}
        return {"intent": spec["analysis_type"], "clarify": "", "slots": slots | {"analysis_type": spec["analysis_type"], "chart_request": spec["chart_request"], "last_query_spec": spec}, "spec": spec}
    now = dict(slots)

    def apply(name: str, values: Slots) -> None:
        for slot in EFFECTS[name].clears:
            now.pop(slot, None)
        now.update({slot: values[slot] for slot in EFFECTS[name].sets if slot in values})

    if turn.company:
        if now.get("stock_code") not in (None, "", turn.company["stock_code"]):
            apply("another_company", {})
        apply("company", turn.company)
    if turn.metrics:
        apply("metrics", {"metric": turn.metrics[0], "metrics": turn.metrics})
    if period := period_said(turn.question, now):  # relative words count from the slots as they are by then
        apply(*period)
    if turn.chart:
        apply("chart", {"chart_request": turn.chart})
    now["analysis_type"] = kind_of(turn.question, now)
    ask = missing(now["analysis_type"], now)
    spec = None if ask else spec_of(turn.question, now)
    return {"intent": now["analysis_type"], "clarify": ask, "slots": now | ({"last_query_spec": spec} if spec else {}), "spec": spec}


def analyze(question: str, slots: Slots, find_company: Callable[[str], Slots | None]) -> Slots:
    """One turn, from its text."""
    return step(slots, said(str(question), find_company(str(question))))


# ---------------------------------------------------------------- tables and streams

RESULT = "conv_id long, turn long, intent string, clarify string, slots string, spec string"
LATE = "late"


def with_companies(turns: DataFrame, companies: DataFrame) -> DataFrame:
    """(conv_id, turn, question, stock_code, stock_abbr): turns with the company that each names."""
    known = companies.select("stock_code", "stock_abbr")
    return resolve_companies(turns.select("conv_id", "turn", "question"), companies, "question").join(known, "stock_code", "left").select("conv_id", "turn", "question", "stock_code", "stock_abbr")


def _row(conv_id: int, turn: int, got: Slots) -> tuple:
    plain = {k: v for k, v in got["slots"].items() if k != "last_query_spec"}
    dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
    return conv_id, turn, got["intent"], got["clarify"], dump(plain), dump(got["spec"]) if got["spec"] else None


def _company(code: str | None, abbr: str | None) -> Slots | None:
    return {"stock_code": code, "stock_abbr": abbr or ""} if code else None


def fold(turns: DataFrame) -> DataFrame:
    """`RESULT` for each turn of `with_companies`: turns stream by in order, and only a conversation's slots are held."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation: Any = object()
        slots: Slots = {}
        for batch in batches:
            out = []
            for conv_id, turn, question, code, abbr in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != conversation:
                    conversation, slots = conv_id, {}
                got = step(slots, said(question or "", _company(code, abbr)))
                slots = got["slots"]
                out.append(_row(conv_id, turn, got))
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    ordered = turns.select("conv_id", "turn", "question", "stock_code", "stock_abbr").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "question")
    return ordered.mapInArrow(run, RESULT)


class Turns(StatefulProcessor):
    """Slots and last turn of each conversation as state; a micro-batch's turns are taken in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slots", "last long, slots string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import pandas as pd

        last, held = self.state.get() if self.state.exists() else (None, "{}")
        slots, out = json.loads(held), []
        for r in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: (r.turn, r.question or "")):
            if last is not None and r.turn <= last:
                out.append((r.conv_id, r.turn, LATE, "", None, None))
                continue
            got = step(slots, said(r.question or "", _company(r.stock_code, r.stock_abbr)))
            last, slots = int(r.turn), got["slots"]
            out.append(_row(r.conv_id, r.turn, got))
        self.state.update((last, json.dumps(slots, ensure_ascii=False)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    def close(self) -> None:
        pass


def fold_stream(turns: DataFrame) -> DataFrame:
    """The same for a stream of `with_companies` rows. A turn that comes after a later one of its conversation is `LATE`.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    return turns.groupBy("conv_id").transformWithStateInPandas(Turns(), RESULT, "Append", "None")


def analyze_conversations(turns: DataFrame, companies: DataFrame) -> DataFrame:
    """`RESULT` for every turn of (conv_id, turn, question)."""
    return fold(with_companies(turns, companies))


def carry_slots(turns: DataFrame, slots: list[str]) -> DataFrame:
    """Each turn (conv_id, turn) with the last value said of every slot."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumns({s: F.last(s, ignorenulls=True).over(before) for s in slots})
