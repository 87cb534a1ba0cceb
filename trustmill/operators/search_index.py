"""Evidence search by a stored inverted index: postings of runs of characters, met by the queries' tokens through joins.

A token is a run of Chinese characters, letters or digits, or a pair of such characters, and counts where a page's lowered
text holds it anywhere; that is where one of the page's own runs holds it. So the index lists the pages of each different run,
block by block, and has the different runs once, in packs. A pass over the packs finds the runs that hold a query's tokens, the
runs find their lists, and one task for a block of pages and a block of queries adds them up to all scores at once. Only its best
pages go on. Queries never come to the driver, and texts are read only of the pages that are returned.

The whole query in a page adds nothing: then all its tokens are there, and the score is at its upper end already.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustmill.functions.text import query_tokens
from trustmill.operators.retrieval import KEYWORD, ORDER, VECTOR, EvidenceFilter, quote
from trustmill.sources.folders import dealt, shared_folder

#: Pages of a block, and queries of one on average.
BLOCK, QUERIES = 1024, 256
#: Lists of an index that are added at once.
POSTED_AT_ONCE = 4096
#: Places that a task holds while it inverts a block, and runs of a pack (a power of two).
INVERTED_AT_ONCE, PACK = 4_000_000, 4096
RUNS = re.compile("[a-z][a-z]+|[0-9][0-9]+|[\u4e00-\u9fff][\u4e00-\u9fff]+")
#: Kinds of rows that meet in a task, in the order in which it reads them.
ASKED, ALLOWED, EMBEDDED, POSTED = range(4)


class Index(NamedTuple):
    """Where the tables of an index are: pages, postings, words and, with embeddings, vectors."""

    root: str
    vectors: bool

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{name}")


def build(pages: DataFrame, root: str, block: int = BLOCK) -> Index:
    """Writes the index of pages (title, paper_path, page_no, text, and embedding, company, industry, published_at if there).

    Pages without a number can't be cited and are left out. Pages are numbered in the order of ties: path, number, title.
    """
    spark = pages.sparkSession
    vectors = "embedding" in pages.columns
    own = [c for c in ("title", "paper_path", "page_no", "text", "company", "industry", "published_at", "embedding") if c in pages.columns]
    order = ["paper_path", "page_no", "title"]
    at = F.monotonically_increasing_id()
    low = (1 << 33) - 1
    p = pages.select(*own).filter("page_no IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("page", at)
    # a block never spans partitions: its number is that of its first page
    p.withColumns({"block": F.col("page") - F.pmod(F.col("page").bitwiseAND(low), F.lit(block)), "place": F.pmod(F.col("page").bitwiseAND(low), F.lit(block)).cast("int")}).write.parquet(f"{root}/pages")
    p = spark.read.parquet(f"{root}/pages")
    p.select("block", "place", F.lower("text").alias("text")).mapInArrow(_inverted, "run string, block long, places array<int>").write.parquet(f"{root}/postings")
    words = spark.read.parquet(f"{root}/postings").select("run").distinct().withColumn("pack", F.floor(F.monotonically_increasing_id() / PACK))
    words.groupBy("pack").agg(F.collect_list("run").alias("runs")).select("runs").write.parquet(f"{root}/words")
    if vectors:
        p.filter("embedding IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("place", F.col("embedding").cast("array<double>").alias("embedding"))).alias("embedded")).write.parquet(f"{root}/vectors")
    return Index(root, vectors)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each block in order, with the places that hold them; a run may come again where a block is cut."""
    block, found, places = None, [], []

    def made() -> pa.RecordBatch:
        numbered = pa.array(found, pa.string()).dictionary_encode()
        number, runs = numbered.indices.to_numpy(), numbered.dictionary
        offsets = np.r_[0, np.cumsum(np.bincount(number, minlength=len(runs)))].astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, np.concatenate(places)[np.argsort(number, kind="stable")])
        order = pc.sort_indices(runs)
        return pa.record_batch([runs.take(order), pa.array(np.full(len(runs), block)), lists.take(order)], ["run", "block", "places"])

    for batch in batches:
        for at, place, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != block or len(found) > INVERTED_AT_ONCE:
                if found:
                    yield made()
                block, found, places = at, [], []
            own = set(RUNS.findall(text or ""))
            found += own
            places.append(np.full(len(own), place, np.int32))
    if found:
        yield made()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of runs beside the tokens of a block of queries: the runs that hold some, with the tokens' places in their list."""
    part, automaton = None, None
    for batch in batches:
        parts = batch.column(1).to_pylist()
        for k, runs in enumerate(batch.column(0)):
            if parts[k] != part:
                part, known, automaton = parts[k], batch.column(2)[k].as_py(), ahocorasick.Automaton()
                for n, token in enumerate(known):
                    automaton.add_word(token, n)
                automaton.make_automaton()
            if not known:
                continue
            runs = runs.values
            # no token has a line feed; a hit is in the run that ends first at or after it
            hits = np.fromiter(chain.from_iterable(automaton.iter("\n".join(runs.to_pylist()))), np.int64).reshape(-1, 2)
            row = np.searchsorted(np.cumsum(pc.utf8_length(runs).to_numpy().astype(np.int64) + 1), hits[:, 0], "right")
            row, token = np.divmod(np.unique(row * len(known) + hits[:, 1]), len(known))
            some, at = np.unique(row, return_index=True)
            offsets = pa.array(np.r_[at, len(row)].astype(np.int32))
            yield pa.record_batch([runs.take(pa.array(some)), pa.array(np.full(len(some), part, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(token.astype(np.int32)))], ["run", "part", "tokens"])


class Block:
    """Scores of a block of pages for a block of queries, as its rows come."""

    def __init__(self, members: list[dict], known: list[str], size: int, top_k: int) -> None:
        self.top_k, self.members = top_k, sorted(members, key=lambda m: m["number"])
        number = {t: n for n, t in enumerate(known)}
        pairs = [(number[t], k) for k, m in enumerate(self.members) for t in m["tokens"]]
        self.sizes = np.array([len(m["tokens"]) for m in self.members], float)
        self.holds = np.zeros((len(known), len(self.members)), np.float32)
        self.holds[tuple(np.array(pairs, int).reshape(-1, 2).T)] = 1
        self.found = np.zeros((size, len(known)), np.float32)
        self.vector = np.zeros((size, len(self.members)))
        self.allowed: np.ndarray | None = None

    def allow(self, places: list[int]) -> None:
        self.allowed = np.zeros(len(self.found), bool)
        self.allowed[places] = True

    def post(self, places: pa.ListArray, tokens: pa.ListArray) -> None:
        """Rows of places and of the tokens that stand there: every place of a row with every token of it."""
        place, many = places.flatten().to_numpy(), places.value_lengths().to_numpy()
        token, row = tokens.flatten().to_numpy(), np.repeat(np.arange(len(many)), tokens.value_lengths().to_numpy())
        size = many[row]
        at = np.arange(int(size.sum())) + np.repeat((np.cumsum(many) - many)[row] - (np.cumsum(size) - size), size)
        self.found[place[at], np.repeat(token, size)] = 1

    def embed(self, embedded: list[dict]) -> None:
        """Cosines, 0 for other lengths or zero vectors, never below 0."""
        by_length: dict[int, tuple[list[int], list[int]]] = {}
        for k, x in enumerate(embedded):
            by_length.setdefault(len(x["embedding"]), ([], []))[0].append(k)
        for k, m in enumerate(self.members):
            if m["embedding"] and len(m["embedding"]) in by_length:
                by_length[len(m["embedding"])][1].append(k)
        for pages, queries in by_length.values():
            if queries and embedded[pages[0]]["embedding"]:
                p, q = np.array([embedded[k]["embedding"] for k in pages], float), np.array([self.members[k]["embedding"] for k in queries], float)
                norm = np.sqrt((p * p).sum(1))[:, None] * np.sqrt((q * q).sum(1))
                self.vector[np.ix_([embedded[k]["place"] for k in pages], queries)] = np.divide(np.maximum(p @ q.T, 0), norm, out=np.zeros_like(norm), where=norm > 0)

    def best(self) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """(place, query, keyword score, vector score) of each query's best pages, with those whose rank rounding may change."""
        with np.errstate(divide="ignore", invalid="ignore"):
            keyword = np.where(self.sizes > 0, (self.found @ self.holds).astype(float) / self.sizes, 0.0)
        score = np.round(KEYWORD * keyword + VECTOR * self.vector, 8)
        fit = (keyword > 0) | (self.vector > 0)
        if self.allowed is not None:
            fit &= self.allowed[:, None]
        places, queries = [], []
        for q in np.flatnonzero(fit.any(0)).tolist():
            some = np.flatnonzero(fit[:, q])
            if len(some) > self.top_k:
                some = some[score[some, q] >= np.partition(score[some, q], -self.top_k)[-self.top_k] - 2e-8]
                some = some[np.lexsort((some, -np.round(self.vector[some, q], 8), -np.round(keyword[some, q], 8), -score[some, q]))][: 2 * self.top_k]
            places += some.tolist()
            queries += [q] * len(some)
        return places, queries, keyword[places, queries], self.vector[places, queries]


def search(spark: SparkSession, index: Index, queries: DataFrame, top_k: int = 3, filters: EvidenceFilter | None = None) -> DataFrame:
    """The best pages for every query (query_id, query, and embedding if the index has them): rank, scores and quote.

    Score: 0.7 of the share of tokens that stand in the page, 0.3 of the cosine; pages where both are 0 are left out.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    vectors = index.vectors and "embedding" in queries.columns
    none = lambda kind: F.array().cast(f"array<{kind}>")
    q = queries.select("query_id", query_tokens(F.col("query")).alias("tokens"), (F.coalesce(F.col("embedding").cast("array<double>"), none("double")) if vectors else none("double")).alias("embedding"))
    n = max(1, -(-q.count() // QUERIES))
    folder = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}"
    q.withColumn("number", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")).write.parquet(folder)
    q = spark.read.parquet(folder)
    members = q.groupBy("part").agg(F.collect_list(F.struct("number", "tokens", "embedding")).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("known"))
    held = index.table(spark, "words").crossJoin(members.select("part", "known")).mapInArrow(_held, "run string, part int, tokens array<int>")
    posted = index.table(spark, "postings").join(held, "run").select("block", "part", F.lit(POSTED).alias("kind"), "places", "tokens")
    blocks = index.table(spark, "pages").groupBy("block").agg((F.max("place") + 1).alias("size"))
    # a row for each block of pages and block of queries
    asked = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(members, "part").select("block", "part", F.lit(ASKED).alias("kind"), "size", "members", "known")
    rows = posted.unionByName(asked, allowMissingColumns=True)
    every_part = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if filters is not None:
        kept = filters.apply(index.table(spark, "pages")).select("block", "place")
        allowed = blocks.join(kept.groupBy("block").agg(F.collect_list("place").alias("places")), "block", "left").select("block", F.lit(ALLOWED).alias("kind"), F.coalesce("places", none("int")).alias("places"))
        rows = rows.unionByName(every_part(allowed), allowMissingColumns=True)
    if vectors:
        embedded = index.table(spark, "vectors").select("block", F.lit(EMBEDDED).alias("kind"), "embedded")
        rows = rows.unionByName(every_part(embedded), allowMissingColumns=True)
    else:
        rows = rows.withColumn("embedded", F.lit(None).cast("array<struct<place:int,embedding:array<double>>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def ready() -> pa.RecordBatch:
            places, asked, keyword, vector = block.best()
            return pa.record_batch([pa.array(now[0] + np.array(places, np.int64)), pa.array([block.members[k]["number"] for k in asked], pa.int64()), pa.array(keyword), pa.array(vector)], ["page", "number", "_k", "_v"])

        for batch in batches:
            at, part, kind = (batch.column(c).to_numpy() for c in range(3))
            # rows of one block and kind, which lie together
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for i, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if i == end:
                    continue
                if (at[i], part[i]) != now:
                    if block is not None:
                        yield ready()
                    now, block = (at[i], part[i]), Block(batch.column(6)[i].as_py(), batch.column(8)[i].as_py(), batch.column(5)[i].as_py(), top_k)
                if kind[i] == ALLOWED:
                    block.allow(batch.column(3)[i].as_py())
                elif kind[i] == EMBEDDED:
                    block.embed(batch.column(7)[i].as_py())
                elif kind[i] == POSTED:
                    for low in range(i, end, POSTED_AT_ONCE):
                        own = batch.slice(low, min(POSTED_AT_ONCE, end - low))
                        block.post(own.column(3), own.column(4))
        if block is not None:
            yield ready()

    # Spark fills the null lists of a batch's column anew for each row that it adds, so lists are empty where a row has none
    lists = [F.coalesce(c, none(dict(rows.dtypes)[c].removeprefix("array<").removesuffix(">"))).alias(c) for c in ("places", "tokens", "members", "embedded", "known")]
    met = dealt(rows.select("block", "part", "kind", *lists[:2], "size", *lists[2:]), "block", "part").sortWithinPartitions("block", "part", "kind")
    scored = met.mapInArrow(run, "page long, number long, _k double, _v double")
    scored = scored.withColumns({"score": F.round(KEYWORD * F.col("_k") + VECTOR * F.col("_v"), 8), "keyword_score": F.round("_k", 8), "vector_score": F.round("_v", 8)})
    best = Window.partitionBy("number").orderBy(*(getattr(F, way)(c) for way, c in ORDER[:3]), "page")
    hits = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).join(q.select("number", "query_id", "tokens"), "number").join(index.table(spark, "pages").select("page", "title", "paper_path", "page_no", "text"), "page")
    return hits.select("query_id", "rank", "title", "paper_path", "page_no", "score", "keyword_score", "vector_score", quote(F.col("text"), F.col("tokens")).alias("quote"))
