"""Report periods: YYYYQ1, YYYYQ2, YYYYQ3, YYYYFY."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustmill.model import PERIODS, SpecError

PERIOD = re.compile(r"^\d{4}(?:Q[1-3]|FY)$")
#: Words for a period, longer ones first where one holds another.
PERIOD_WORDS = r"(第一季度|一季度|上半年|半年度|前三季度|第三季度|三季度|年度|年报)"
TITLE_WORDS = r"(一季度|半年度|三季度|年度|年报|第三季度|第一季度)"
CODES = {"第一季度": "Q1", "一季度": "Q1", "上半年": "Q2", "半年度": "Q2", "半年度报告": "Q2", "前三季度": "Q3", "第三季度": "Q3", "三季度": "Q3"}
JOINERS = ("至", "到", "-")
#: Words that count from another period's year, the first that is found wins: years back, and the period's code
#: (none: from that year's first quarter to the other period).
RELATIVE = {"去年": (1, "FY"), "近三年": (2, None), "近几年": (2, None), "前三季度": (0, "Q3"), "上半年": (0, "Q2")}
_MENTION = re.compile(rf"(\d{{4}})(?!\d)\s*(年?)\s*{PERIOD_WORDS}?")


def order_value(period: str) -> int:
    if not PERIOD.match(period):
        raise SpecError(f"invalid report period {period!r}")
    return int(period[:4]) * 10 + PERIODS[period[4:]]


def order_column(period: Column) -> Column:
    """year * 10 + ordinal; 0 where the text is no period."""
    year, tail = F.regexp_extract(period, r"^(\d{4})(Q1|Q2|Q3|FY)", 1), F.regexp_extract(period, r"^(\d{4})(Q1|Q2|Q3|FY)", 2)
    ordinal = F.lit(0)
    for name, number in PERIODS.items():
        ordinal = F.when(tail == name, number).otherwise(ordinal)
    return F.when((year != "") & (year.try_cast("int") > 0), year.try_cast("int") * 10 + ordinal).otherwise(0)


def period_column(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.when(quarter == 4, "FY").otherwise(F.concat(F.lit("Q"), quarter.cast("string"))))


def code_of_word(word: Column) -> Column:
    """The period code that a word stands for; FY where it is none of the others."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), F.trim(word)), F.lit("FY"))


def from_title(name: Column, head: Column) -> Column:
    """The period named first in a file name or its first pages; null if none is."""
    text = F.concat_ws("\n", name, head)
    pattern = rf"(\d{{4}})\s*年\s*{TITLE_WORDS}"
    year, word = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(year != "", F.concat(year, code_of_word(word)))


def boundary(period: Column, kind: Column) -> tuple[Column, Column]:
    """First and last day: the last of the quarter; durations start in January, states on their day."""
    year, ordinal = F.substring(period, 1, 4).cast("int"), order_column(period) % 10
    end = F.last_day(F.make_date(year, ordinal * 3, F.lit(1)))
    return F.when(kind == "duration", F.make_date(year, F.lit(1), F.lit(1))).otherwise(end), end


class Mention(NamedTuple):
    """A year in a question, with what follows it."""

    start: int
    end: int
    year: int
    marked: bool  # by the character for year
    word: str | None

    def period(self, word: str | None = None) -> str:
        return f"{self.year}{CODES.get(word or self.word or '', 'FY')}"


def mentions(question: str) -> list[Mention]:
    return [Mention(m.start(), m.end(), int(m[1]), bool(m[2]), m[3]) for m in _MENTION.finditer(question)]


def relative(question: str, anchor: str) -> dict[str, Any]:
    """The slots of a word that counts from the anchor's year; without a word none, without an anchor the wish for one."""
    word = next((w for w in RELATIVE if w in question), None)
    if word is None:
        return {}
    if not PERIOD.match(anchor):
        return {"needs_period_anchor": True}
    back, tail = RELATIVE[word]
    year = int(anchor[:4]) - back
    return {"report_period": f"{year}{tail}"} if tail else {"start_period": f"{year}Q1", "end_period": anchor}


def resolve(question: str, context: dict[str, Any] | None = None) -> dict[str, Any]:
    """The period slots that a question fills: a range, else the periods it names, else its year, else what a relative word says."""
    found = mentions(question)
    for first, second in zip(found, found[1:]):
        if first.word is None and question[first.end : second.start].strip() in JOINERS:
            return {"start_period": f"{first.year}Q1", "end_period": second.period()}
    named = [m for m in found if m.marked and m.word]
    if named:
        periods = sorted({m.period() for m in named}, key=order_value)
        return {"report_period": periods[0]} if len(named) == 1 else {"periods": periods, "start_period": periods[0], "end_period": periods[-1]}
    if year := next((m for m in found if m.marked), None):
        return {"report_period": f"{year.year}FY"}
    slots = context or {}
    return relative(question, str(slots.get("report_period") or slots.get("end_period") or ""))
