"""Secret scans with multipart credential linking.

Patterns find strong parts (assigned secrets, access identifiers, hexadecimal keys) and weak ones: user or client names,
mixed-character strings, endpoints. An interval join brings parts of one document together whose distance is at most
`SCOPE` code points. A weak part is reported only where its complements stand in its scope: a weak secret near an
identifier, a weak identifier near a secret, an endpoint near both.

Defined results: null and empty texts have no spans; very long texts take time in proportion to their length, even as one
unbroken run; positions are code points, ends exclusive; repeated rows are judged
separately; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: The base patterns; matches that fail the length are dropped, and searching goes on behind them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts.
WEAK_ID = re.compile(r"""(?:user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=])")
HOST = re.compile(r"(?:endpoint|host)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::[0-9]+)?", re.A)
_AFTER_SCHEME = re.compile(r"[^\s\"'<>]+", re.A)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
#: Words of which one must be there before a slow pattern runs.
_ASSIGN_CUES = re.compile("passw|secret|token|api_?key", re.I | re.A)
_ID_CUES = re.compile("user|login|client|access", re.I | re.A)
#: Kinds in the order of equal starts; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
SCOPE = 400


def urls(text: str) -> list[tuple[int, int]]:
    """scheme://rest: each `://` is expanded to its left and right, so that every character is looked at a bounded number of times."""
    found, floor = [], 0
    at = text.find("://")
    while at >= 0:
        run = at
        while run > floor and text[run - 1] in _SCHEME:
            run -= 1
        start = next((k for k in range(run, at) if "a" <= text[k] <= "z"), at)
        rest = _AFTER_SCHEME.match(text, at + 3)
        if start < at and rest:
            found.append((start, rest.end()))
        floor = rest.end() if start < at and rest else at + 3
        at = text.find("://", floor)
    return found


class Taken:
    """Whether a span meets one of many, which may overlap each other."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def free(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)
        return not before or self.reach[before - 1] <= a


def parts(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of strong and weak parts, in order."""
    found = []
    if _ASSIGN_CUES.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    free = Taken([(a, b) for a, _, b in found]).free
    for m in WEAK_SECRET.finditer(text):
        x = m[0]
        if any(map(str.isdigit, x)) and any(map(str.isupper, x)) and any(map(str.islower, x)) and free(*m.span()):
            found.append((m.start(), 3, m.end()))
    if _ID_CUES.search(text):
        found += [(m.start(), 4, m.end()) for m in WEAK_ID.finditer(text) if free(*m.span())]
    links = urls(text)
    found += [(a, 5, b) for a, b in links]
    if "host" in text or "endpoint" in text:
        unlinked = Taken(links).free
        found += [(m.start(), 5, m.end()) for m in HOST.finditer(text) if unlinked(*m.span())]
    return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and parts: array of (start, kind, end), strong and weak, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[{"start": a, "kind": k, "end": b} for a, k, b in parts(x.as_py() or "")] for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], ["doc_id", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, parts array<struct<start:int,kind:int,end:int>>")


def _near(weak: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Rows of weak with a row of others in the same document at most scope away; an interval semi-join by blocks of positions.

    A semi-join stops at the first partner, so many parts in one scope make no pairs.
    """
    block = 2 * scope
    left = weak.withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("start") - scope) / block), F.floor((F.col("end") + scope) / block))))
    right = others.select("row", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))).alias("block"))
    close = (F.col("s") <= F.col("end") + scope) & (F.col("e") >= F.col("start") - scope)
    return left.alias("l").join(right.alias("r"), (F.col("l.row") == F.col("r.row")) & (F.col("l.block") == F.col("r.block")) & close, "left_semi").drop("block").distinct()


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, spans: array of (start, kind number, end) in order: all strong parts and the weak ones that link."""
    scanned = materialize(scan(docs).withColumn("row", F.monotonically_increasing_id()), "parts")
    part = scanned.filter(F.exists("parts", lambda p: p.kind >= 3)).select("row", F.explode("parts").alias("p")).select("row", "p.start", "p.kind", "p.end")
    of = lambda *kinds: part.filter(F.col("kind").isin(*kinds))
    secret = _near(of(3), of(1, 4), scope)
    secrets = of(0, 2).unionByName(secret)
    identifier = _near(of(4), secrets, scope)
    endpoint = _near(_near(of(5), of(1).unionByName(identifier), scope), secrets, scope)
    linked = secret.unionByName(identifier).unionByName(endpoint).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    strong = F.filter("parts", lambda p: p.kind < 3)
    return scanned.join(linked, "row", "left").select("doc_id", F.array_sort(F.concat(strong, F.coalesce("linked", F.filter("parts", lambda p: F.lit(False))))).alias("spans"))
