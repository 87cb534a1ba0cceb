"""SimHash fingerprints with DataFrame functions alone.

A term is a shingle of five words; its two hashes vote for each of 128 bits with the weight of its occurrences. Votes are
summed two bits to a long: of each hash, bit j in the low half, bit j + 32 in the high half. A fingerprint is two longs.

Defined results: a null or empty text has no term and the fingerprint 0; fewer words than a shingle count as one shingle; a
tie of votes gives 0; equal texts have equal fingerprints; repeated rows are neighbours like others, in order of their
text; a null doc_id counts as smaller than all others and doesn't search; an empty table gives an empty result; extra columns
are ignored; of very long texts all terms vote.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ascii_lower, materialize

SHINGLE = 5
BITS = 128
#: Bits that fingerprints found by a search may differ in, and which rows search: those whose doc_id this divides.
RADIUS = 3
QUERY_EVERY = 50
#: Documents of a neighbourhood, on average, and the most neighbourhoods: their bounds go to all executors.
BUCKET_ROWS = 256
MAX_BUCKETS = 1 << 16
_LANES = range(32)
_BOTH = (1 << 32) + 1


def terms(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all shingles, repeated ones as often as they occur."""
    words = F.filter(F.split(F.regexp_replace(ascii_lower(text), r"[\t\n\x0b\x0c\r]", " "), " "), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.trim(text) == "", F.array().cast("array<bigint>")).otherwise(_shingled(hashes, shingle))


def _shingled(hashes: Column, shingle: int) -> Column:
    # the word hashes are bound once, as the variable of an outer lambda
    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - shingle), lambda k: F.xxhash64(*(F.get(h, k + j) for j in range(shingle))))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64(h))).otherwise(many)

    return F.transform(F.array(hashes), of)[0]


def votes(term: Column, name: str) -> list[Column]:
    return [F.sum(F.shiftright(term, j).bitwiseAND(F.lit(_BOTH))).alias(f"{name}{j}") for j in _LANES]


def fingerprint(total: Column, name: str) -> Column:
    """64 bits as a long from the sums of one hash and the number of terms."""
    low = lambda j: F.col(f"{name}{j}").bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda j: F.shiftrightunsigned(F.col(f"{name}{j}"), 32)
    bit = lambda count, j: F.when(2 * count > total, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
    bits = [bit(low(j), j) for j in _LANES] + [bit(high(j), j + 32) for j in _LANES]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def distance(a: Column, b: Column) -> Column:
    """Bits that differ."""
    return F.bit_count(a["lo"].bitwiseXOR(b["lo"])) + F.bit_count(a["hi"].bitwiseXOR(b["hi"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def as_text(fp: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(fp[half])), 16, "0") for half in ("hi", "lo")))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and `fp` (struct of lo and hi); a key's rows must be one text. The sums are made before any exchange, one row for each key."""
    term = texts.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    second = F.when(F.col("term").isNotNull(), F.xxhash64(F.lit(1), "term"))
    summed = term.withColumn("term2", second).groupBy(*keys).agg(F.count("term").alias("n"), *votes(F.col("term"), "v"), *votes(F.col("term2"), "u"))
    half = lambda name: F.coalesce(fingerprint(F.col("n"), name), F.lit(0).cast("long"))
    return summed.select(*keys, F.struct(half("v").alias("lo"), half("u").alias("hi")).alias("fp"))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the value, by halving steps."""
    array = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    steps = [1 << k for k in range(len(bounds).bit_length(), -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) <= value), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row's `bucket`, `place`, text, and `next_text`, the text of the next row in descending order of doc_id; after the last row comes the first.

    Rows are dealt to neighbourhoods of doc_ids. The largest row of each also goes to the next one, marked `guest`, where
    it is what follows the smallest; the largest of all goes to the first one.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = own.select("id")
    n = ids.count()
    wanted = min(MAX_BUCKETS, -(-n // BUCKET_ROWS))
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [k / wanted for k in range(1, wanted)], 0.1 / wanted)}) if wanted > 1 else []
    bucketed = own.withColumn("bucket", _bucket(F.col("id"), bounds))
    # at most a row for each neighbourhood
    tops = ids.withColumn("bucket", _bucket(F.col("id"), bounds)).groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()
    to = {r.id: tops[(k + 1) % len(tops)].bucket for k, r in enumerate(tops)}
    spark = docs.sparkSession
    guests = spark.createDataFrame(list(to.items()) or [], "id long, guest_of int")
    copies = bucketed.join(F.broadcast(guests), "id").select("id", "doc_id", "text", F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))
    rows = bucketed.withColumn("guest", F.lit(False)).unionByName(copies)
    by = Window.partitionBy("bucket").orderBy(F.desc("guest"), "id", "text")
    return rows.select("bucket", F.row_number().over(by).alias("place"), "doc_id", "guest", "text", F.lag("text").over(by).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the first of the other text."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(docs: DataFrame, radius: int = RADIUS, every: int = QUERY_EVERY) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within for each row.

    n_within is a search in the block tables: for rows whose doc_id is divisible by `every`, how many other fingerprints of
    all rows lie within the radius; null for other rows. All steps after the exchange by neighbourhood keep its
    partitioning: texts move once.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keyed = rows.select("bucket", "place", "doc_id", "guest", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))).alias("x"))
    each = fingerprints(keyed.select("bucket", "place", "doc_id", "guest", "n_chars", "edited_sha256", "x.kind", "x.t"), ["bucket", "place", "kind", "doc_id", "guest", "n_chars", "edited_sha256"], "t")
    both = each.groupBy("bucket", "place").agg(*(F.max(c).alias(c) for c in ("doc_id", "guest", "n_chars")), F.max(F.when(F.col("kind") == 1, F.col("edited_sha256"))).alias("edited_sha256"), F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("fp_edited"))
    with_lag = both.withColumn("fp_next", F.lag("fp").over(Window.partitionBy("bucket").orderBy("place")))
    own = with_lag.filter(~F.col("guest"))
    made = materialize(own.select("doc_id", "n_chars", "edited_sha256", "fp", as_text(F.col("fp_edited")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp"), F.col("fp_next")).alias("near_next")), "fingerprints")
    asks = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    asking = made.filter(asks)
    found = within_radius(asking, made, radius).filter("distance > 0").groupBy(F.col("query_fp.lo").alias("lo"), F.col("query_fp.hi").alias("hi")).agg(F.count("*").alias("n_within"))
    answered = asking.withColumns({"lo": F.col("fp.lo"), "hi": F.col("fp.hi")}).join(found, ["lo", "hi"], "left").select(*made.columns, F.coalesce("n_within", F.lit(0)).alias("n_within"))
    out = made.filter(~asks).withColumn("n_within", F.lit(None).cast("long")).unionByName(answered)
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "n_within")


# ---------------------------------------------------------------- search by permuted block tables


def block_masks(radius: int, chosen: int = 1) -> list[tuple[int, int]]:
    """The bits of the low and of the high half that a table is keyed by: a table for each choice of `chosen` of radius + chosen blocks."""
    blocks = radius + chosen
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    whole = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in some) for some in combinations(range(blocks), chosen)]
    return [(signed(x & ((1 << 64) - 1)), signed(x >> 64)) for x in whole]


def _in_tables(df: DataFrame, fp: str, masks: list[tuple[int, int]]) -> DataFrame:
    """A row for each table, with its number and key."""
    key = lambda k, lo, hi: F.struct(F.lit(k).alias("table"), F.col(fp)["lo"].bitwiseAND(F.lit(lo)).alias("key_lo"), F.col(fp)["hi"].bitwiseAND(F.lit(hi)).alias("key_hi"))
    return df.withColumn("x", F.explode(F.array(*(key(k, lo, hi) for k, (lo, hi) in enumerate(masks))))).select(fp, "x.*")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, chosen: int = 1) -> DataFrame:
    """Exactly the pairs (query_fp, fp, distance) of distinct fingerprints at most radius bits apart, itself included.

    Fingerprints at most radius bits apart agree in `chosen` of radius + chosen blocks, so they share a key of some table; a
    pair comes from the first such table alone. queries and index have a column `fp`; equal fingerprints count as one, so
    copies make no pairs.
    """
    masks = block_masks(radius, chosen)
    q = _in_tables(queries.select(F.col("fp").alias("query_fp")).distinct(), "query_fp", masks)
    i = _in_tables(index.select("fp").distinct(), "fp", masks)
    apart = distance(F.col("query_fp"), F.col("fp"))
    low, high = (F.col("query_fp")[half].bitwiseXOR(F.col("fp")[half]) for half in ("lo", "hi"))
    agree = [(low.bitwiseAND(F.lit(lo)) == 0) & (high.bitwiseAND(F.lit(hi)) == 0) for lo, hi in masks]
    earlier = reduce(lambda a, b: a | b, ((F.col("table") > k) & x for k, x in enumerate(agree)))
    return q.join(i, ["table", "key_lo", "key_hi"]).filter((apart <= radius) & ~earlier).select("query_fp", "fp", apart.alias("distance"))
