"""Texts of reports and questions: tokens, names, file names, thresholds, keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
#: Counts in words.
TOP_WORDS = {"前一": 1, "前二": 2, "前三": 3, "前四": 4, "前五": 5, "前六": 6, "前七": 7, "前八": 8, "前九": 9, "前十": 10}


def tokens(text: Column) -> Column:
    """Runs of two or more Chinese characters, Latin letters or digits; Chinese runs of three or more also give their pairs."""
    runs = F.regexp_extract_all(text, F.lit(rf"({CJK}{{2,}}|[A-Za-z]{{2,}}|[0-9]{{2,}})"), F.lit(1))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda k: F.substring(t, k, F.lit(2)))
    return F.flatten(F.transform(runs, lambda t: F.when((F.length(t) >= 3) & F.rlike(t, F.lit(f"^{CJK}+$")), F.concat(F.array(t), pairs(t))).otherwise(F.array(t))))


def query_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), F.lower))


def threshold(question: Column) -> Column:
    """The number after a comparing word, in 万元 where an amount is meant."""
    pattern = r"(超过|高于|大于|低于|小于)\s*([0-9]+(?:\.[0-9]+)?)\s*(亿元|万元|%|元)?"
    value, unit = F.regexp_extract(question, pattern, 2).try_cast("decimal(28,8)"), F.regexp_extract(question, pattern, 3)
    return F.when(unit == "亿元", value * 10000).when(unit == "元", value / 10000).otherwise(value).cast("decimal(38,8)")


def top_n(question: Column, default: int = 10) -> Column:
    """`top N` from 1 to 100, or the first of the words for counts in their order."""
    said = F.regexp_extract(question, r"(?i)top\s*([0-9]+)", 1).try_cast("int")
    words = F.lit(None).cast("int")
    for word, n in reversed(TOP_WORDS.items()):
        words = F.when(F.contains(question, F.lit(word)), n).otherwise(words)
    return F.coalesce(F.when(said.isNotNull(), F.greatest(F.lit(1), F.least(said, F.lit(100)))), words, F.lit(default))


def squeezed(text: Column) -> Column:
    """One blank for each run of them, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def company_name(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def compatible_names(a: Column, b: Column) -> Column:
    """Equal without blanks and case, or one of four or more characters inside the other."""
    a, b = F.lower(company_name(a)), F.lower(company_name(b))
    inside = lambda x, y: (F.length(x) >= 4) & F.contains(y, x)
    return (a == b) | inside(a, b) | inside(b, a)


def title_key(title: Column) -> Column:
    return F.translate(squeezed(title), "/\\", "__")


def source_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^(?:\./)+", "")


def same_text(a: Column, b: Column) -> Column:
    return squeezed(a) == squeezed(b)


def file_name_marks(name: Column, head: Column) -> dict[str, Column]:
    """What a report's file name and head say about its version."""
    text = F.concat_ws("\n", name, head)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    copy = F.regexp_extract(stem, r"[（(](\d+)[)）]\s*$", 1)
    date = F.regexp_extract(name, r"(?:^|_)(20\d{6})(?:_|\.)", 1)
    return {
        "is_summary": text.rlike(r"\d{4}\s*年\s*(?:一季度|半年度|三季度|年度|年报|第三季度|第一季度)\s*(?:报告)?\s*摘要"),
        "is_english": text.rlike(r"(?i)英文版|English\s+Version"),
        "revision": F.when(text.rlike("更新前|更正前|修订前"), "pre_revision").when(text.rlike("更新后|更正后|修订后|修订版|修订稿|更新版|更正版"), "revised").otherwise("original"),
        "published_date": F.when(date != "", date),
        "copy_index": F.coalesce(F.when(copy != "", copy.try_cast("int")), F.lit(0)),
    }


def caption(text: Column) -> Column:
    """The first caption of a chart, of at most 40 characters."""
    return F.regexp_extract(text, r"(图表\s*[0-9]+\s*[：:][^\n]{1,40})", 1)


def stock_code_in(text: Column) -> Column:
    """The first six digits that no digit touches."""
    found = F.regexp_extract(text, r"(?:^|\D)(\d{6})(?:\D|$)", 1)
    return F.when((found != "") & (found != "000000"), found)


def key_of(*parts: Column) -> Column:
    """sha256 of the parts with unit separators; nulls read as empty texts."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def field_aliases(cn_name: str) -> list[str]:
    """Names under which a field may stand in a report, longer ones first."""
    plain = re.sub(r"（.*?）|\(.*?\)", "", cn_name).strip()
    found = {cn_name, plain, cn_name.replace("营业总支出", "营业总成本"), cn_name.replace("净利润", "归属于上市公司股东的净利润")}
    for name in (cn_name, plain):
        found.add(name.replace("同比增长", "同比").replace("季度环比增长", "环比"))
        found.update(name.split(dash, 1)[1].strip() for dash in "-—–" if dash in name)
    for short, full in (("经营性现金流", "经营活动产生的现金流量净额"), ("融资性现金流", "融资活动产生的现金流量净额"), ("投资性现金流", "投资活动产生的现金流量净额")):
        if short in plain:
            found.add(full)
    return sorted(filter(None, found), key=lambda x: (-len(x), x))


def dataset_uri(path: str, root: str) -> str:
    """A path under the root as a relocatable dataset URI; paths outside are refused."""
    from pathlib import PurePosixPath
    from urllib.parse import quote

    rest = PurePosixPath(path).relative_to(PurePosixPath(root))
    if ".." in rest.parts:
        raise ValueError(f"{path!r} leaves its dataset")
    return "dataset:///" + quote(str(rest))


def stock_abbr_in(name: Column, known: Column) -> Column:
    """The company before the colon of a file name, else the one known for the code."""
    before = company_name(F.regexp_extract(name, r"^([^:：]+)[:：]", 1))
    return F.coalesce(F.when(before != "", before), known)
