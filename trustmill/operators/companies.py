"""Which company a text names: by code, short name, full name, or a part of a name that only one company has.

Codes and names are patterns of Aho-Corasick automata over shards of the company table; texts stream past them, each text
is read once for a shard, and nothing is shuffled, so names that all end alike are no hot key. Texts that name none are
compared by their parts: an index holds every substring of the names that belongs to one company only.

First rule that applies: a six-digit code, a three-digit one (of 000xyz), each by its place in the text; a short name, a full
name, each by the company's code; what follows the mark for a company name, then runs of Chinese characters, longer ones
first, as a part of a name. A part that several companies have names none.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.text import CJK
from trustmill.sources.folders import stored

#: Companies of an automaton; a larger table is searched shard by shard.
SHARD = 50_000
#: Companies whose names a task cuts into parts.
CUT = 2_000
#: The mark before a company name, and what ends the name.
MARK = r"企业名称[:：]([^，,]*)"
CODE, SHORT_CODE, SHORT_NAME, FULL_NAME = range(4)


def automaton(companies: list[tuple[str, str | None, str | None]]) -> ahocorasick.Automaton:
    """Patterns of (code, short name, full name), each with its rule and company; of equal patterns the first counts."""
    best: dict[str, list[tuple[int, str]]] = {}
    for code, abbr, name in companies:
        patterns = [(CODE, code), (SHORT_CODE, code[3:] if code.startswith("000") else ""), (SHORT_NAME, abbr or ""), (FULL_NAME, name or "")]
        for rule, text in patterns:
            if text:
                best.setdefault(text, []).append((rule, code))
    found = ahocorasick.Automaton()
    for text, uses in best.items():
        found.add_word(text, (len(text), {rule: min(c for r, c in uses if r == rule) for rule, _ in uses}))
    found.make_automaton()
    return found


def named(text: str, patterns: ahocorasick.Automaton) -> tuple[int, int, str] | None:
    """(rule, place, code) of the first rule that applies."""
    best: tuple[int, int, str] | None = None
    word = lambda at: 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")
    for last, (size, uses) in patterns.iter(text):
        for rule, code in uses.items():
            at = 0
            if rule in (CODE, SHORT_CODE):
                at = last - size + 1
                if word(at - 1) or word(last + 1):
                    continue
            if best is None or (rule, at, code) < best:
                best = rule, at, code
    return best


def _search_pass(rows: DataFrame, patterns: Broadcast, text: str, first: bool) -> DataFrame:
    """Adds `_named`, or betters it."""
    place = {c: k for k, c in enumerate(rows.columns)}
    columns = [c for c in rows.columns if c != "_named"]
    kind = pa.struct([("rule", pa.int32()), ("at", pa.int64()), ("stock_code", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(patterns.value)
        for batch in batches:
            texts = batch.column(place[text])
            found = [named(x.as_py() or "", known) if len(known) else None for x in texts]
            if not first:
                old = [x and (x["rule"], x["at"], x["stock_code"]) for x in batch.column(place["_named"]).to_pylist()]
                found = [min(filter(None, pair), default=None) for pair in zip(old, found)]
            made = pa.array([x and {"rule": x[0], "at": x[1], "stock_code": x[2]} for x in found], kind)
            yield pa.record_batch([*(batch.column(place[c]) for c in columns), made], [*columns, "_named"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", `_named` struct<rule:int,at:long,stock_code:string>")


def name_index(companies: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """part, stock_code: the substrings of short and full names that only one company has; of some sizes only, if they are given.

    A name has many parts for its bytes, so a task gets a bounded number of names. Parts are counted with a combine on the map
    side, so one that all names share is a single row for each task.
    """
    n = companies.count()
    tasks = max(companies.sparkSession.sparkContext.defaultParallelism, -(-n // CUT))
    names = companies.repartition(tasks, "stock_code").select("stock_code", F.explode(F.array_compact(F.array("stock_abbr", "company_name"))).alias("name")).filter("name <> ''")
    wanted = F.sequence(F.lit(1), F.length("name")) if sizes is None else F.filter(F.lit(sizes).cast("array<int>"), lambda n: n <= F.length("name"))
    parts = F.flatten(F.transform(wanted, lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda k: F.substring(F.col("name"), k, n))))
    each = names.select("stock_code", F.explode(F.array_distinct(parts)).alias("part"))
    return each.groupBy("part").agg(F.min("stock_code").alias("stock_code"), F.max("stock_code").alias("_other")).filter("stock_code = _other").drop("_other")


def parts_of(text: str) -> Column:
    """What may be a part of a name, best first: what follows the mark, then runs of Chinese characters by falling length."""
    marked = F.filter(F.array(F.trim(F.regexp_extract(text, MARK, 1), F.lit(" \t\n\x0b\x0c\r　"))), lambda x: x != "")
    runs = F.regexp_extract_all(F.col(text), F.lit(f"({CJK}{{2,}})"), F.lit(1))
    ordered = F.transform(F.array_sort(F.transform(runs, lambda x, k: F.struct((-F.length(x)).alias("n"), k.alias("k"), x.alias("x")))), lambda s: s.x)
    return F.array_distinct(F.concat(marked, ordered))


def resolve_companies(texts: DataFrame, companies: DataFrame, text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Rows of texts with stock_code; null if they name no company. companies: stock_code, stock_abbr, company_name.

    index: a stored `name_index` of the companies, else one of the sizes that are asked for is made. Only texts that no code or name settles are dealt to their
    parts, and only those as long as names are looked up.
    """
    spark = texts.sparkSession
    own = [c for c in texts.columns if c != "stock_code"]
    c = companies.select("stock_code", "stock_abbr", "company_name")
    n, longest = c.agg(F.count("*"), F.max(F.greatest(F.length("stock_abbr"), F.length("company_name")))).first()
    shards = max(1, -(-n // SHARD))
    rows = texts.select(*own)
    for k in range(shards):
        shard = c if shards == 1 else c.filter(F.pmod(F.xxhash64("stock_code"), F.lit(shards)) == k)
        rows = _search_pass(rows, spark.sparkContext.broadcast([tuple(x) for x in shard.toLocalIterator()]), text, k == 0)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "named")
    asked = rows.filter("_named IS NULL").select("_row", F.posexplode(parts_of(text)).alias("rank", "part")).filter(F.length("part") <= (longest or 0))
    if index is None:  # a part is no longer than the longest name, so these are few numbers
        index = name_index(c, sorted(r[0] for r in asked.select(F.length("part")).distinct().collect()))
    best = asked.join(index, "part").groupBy("_row").agg(F.min_by("stock_code", "rank").alias("_by_part"))
    return rows.join(best, "_row", "left").select(*own, F.coalesce("_named.stock_code", "_by_part").alias("stock_code"))
