"""Evidence retrieval: chunks, filters, keyword and vector scores, ranked hits with quotes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustmill.sources.folders import shared_folder

#: Weights of both scores, length of a quote, size of a chunk, caps of an index.
KEYWORD, VECTOR = 0.7, 0.3
QUOTE = 240
CHUNK = 280
CHUNKS_OF_PAPER = 20
CHUNKS = 5000


@dataclass(frozen=True)
class EvidenceFilter:
    company: str | None = None
    industry: str | None = None
    published_on: str | None = None
    published_from: str | None = None
    published_to: str | None = None
    page_no: int | None = None

    def __post_init__(self) -> None:
        for x in (self.published_on, self.published_from, self.published_to):
            if x is not None:
                date.fromisoformat(x)
        if self.published_from and self.published_to and self.published_from > self.published_to:
            raise ValueError("published_from is after published_to")
        if self.page_no is not None and self.page_no < 1:
            raise ValueError("page_no must be positive")

    def apply(self, pages: DataFrame) -> DataFrame:
        """A missing date fails a date filter."""
        for name, value in (("company", self.company), ("industry", self.industry), ("page_no", self.page_no)):
            if value is not None:
                pages = pages.filter(F.col(name) == value)
        on = F.col("published_at")
        for value, keep in ((self.published_on, lambda d: on == d), (self.published_from, lambda d: on >= d), (self.published_to, lambda d: on <= d)):
            if value is not None:
                pages = pages.filter(keep(F.lit(value).cast("date")))
        return pages


def chunks(text: Column, size: int = CHUNK) -> Column:
    """Sentences packed greedily into chunks of at most so many characters."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"(?U)\s+", " "), "[。！？；]"), F.trim), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc.open == "", s).otherwise(F.concat(acc.open, F.lit("。"), s))
        fits = F.length(joined) <= size
        return F.struct(F.when(fits | (acc.open == ""), acc.done).otherwise(F.array_append(acc.done, acc.open)).alias("done"), F.when(fits, joined).otherwise(s).alias("open"))

    return F.aggregate(parts, start, add, lambda acc: F.when(acc.open == "", acc.done).otherwise(F.array_append(acc.done, acc.open)))


def capped_index(pages: DataFrame, of_paper: int = CHUNKS_OF_PAPER, total: int = CHUNKS) -> DataFrame:
    """The first chunks of each paper, papers by path: an index of bounded size, as a feature."""
    own = Window.partitionBy("paper_path").orderBy("page_no", "chunk_no")
    return pages.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= of_paper).orderBy("paper_path", "page_no", "chunk_no").limit(total).drop("_n")


def keyword_score(tokens: Column, query: Column, lowered: Column) -> Column:
    """Share of tokens that stand in the text as substrings, 0.15 more for the whole query; at most 1."""
    hits = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.when(F.contains(lowered, t), 1.0).otherwise(0.0))
    phrase = F.when(F.contains(lowered, F.lower(F.trim(query))), 0.15).otherwise(0.0)
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(hits, F.size(tokens)) + phrase))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 for other lengths or zero vectors, never below 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1) | (norm == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(dot(a, b), norm)))


def quote(text: Column, tokens: Column, length: int = QUOTE) -> Column:
    """From up to a third of its length before the first token, in query order, that the text holds."""
    lowered = F.lower(text)
    found = F.filter(F.transform(tokens, lambda t: F.instr(lowered, t)), lambda p: p > 0)
    return F.substring(text, F.greatest(F.lit(1), F.coalesce(F.get(found, 0), F.lit(1)) - length // 3), F.lit(length))


#: Order of hits: the best first, then by place.
ORDER = (("desc", "score"), ("desc", "keyword_score"), ("desc", "vector_score"), ("asc", "paper_path"), ("asc", "page_no"), ("asc", "title"))


def search(pages: DataFrame, queries: DataFrame, top_k: int = 3, filters: EvidenceFilter | None = None) -> DataFrame:
    """The best pages for every query, by an index of these pages alone; store one with `search_index.build` for more than one search."""
    from trustmill.operators import search_index

    if top_k < 1:
        raise ValueError("top_k must be positive")
    spark = pages.sparkSession
    return search_index.search(spark, search_index.build(pages, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"), queries, top_k, filters)


def verified(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations with `holds`: the page exists and has the quote."""
    found = citations.join(pages.select("paper_path", "page_no", F.col("text").alias("_text")), ["paper_path", "page_no"], "left")
    return found.withColumn("holds", F.coalesce(F.contains("_text", F.col("quote")), F.lit(False))).drop("_text")


def inferred_filters(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(query_id, company, industry): the company a question names, and the longest industry name that stands in it."""
    from trustmill.operators.companies import resolve_companies

    industries = companies.select("industry").distinct().agg(F.array_sort(F.collect_list("industry")).alias("all"))
    named = resolve_companies(questions, companies, "query").withColumn("_all", industries.scalar())
    held = F.filter("_all", lambda i: F.contains(F.col("query"), i))
    longest = F.get(F.array_sort(F.transform(held, lambda i: F.struct((-F.length(i)).alias("n"), i.alias("i")))), 0)["i"]
    return named.select("query_id", F.col("stock_code").alias("company"), longest.alias("industry"))
