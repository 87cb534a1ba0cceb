"""Benchmark decontamination with suffix arrays of training shards.

A shard is a slice of a partition's documents. Its words become numbers of the benchmark's vocabulary; a suffix array of all
its positions is built by doubling. Each benchmark suffix that holds a whole window is binary-searched for the range of
shard suffixes that start with that window; neighbouring hits on one diagonal join to the longest verbatim matches.

Defined results: null or empty texts have no words and no hits; a benchmark item without words never matches; items with
one id count once and their windows add up; a null item_id reads as the empty string; repeated document rows are judged
separately; extra columns pass through `carry`; an empty benchmark leaves every document clean; a very long text is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import slices
from .shared import materialize, with_plain_names

#: Word characters: ASCII letters and digits, and all others than ASCII. A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MATCHES = "array<struct<item_id:string,doc_start:int,item_start:int,length:int>>"
#: Benchmark text sent to the executors at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 24 << 20
#: Text of a training shard, which gets a suffix array of its own.
SHARD_BYTES = 8_000_000
#: Benchmark suffixes that are searched together.
KEYS_AT_ONCE = 1 << 16


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """All positions in the order of their suffixes, compared over `depth` words at least: by doubling, and only where suffixes are still equal."""
    n = len(words)
    order = np.argsort(words, kind="stable").astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    known = 1
    while known < depth and len(at):
        own = order[at]
        after = own.astype(np.int64) + known
        key = rank[own] * np.int64(n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        known *= 2
    return order


def bounds(words: np.ndarray, order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key (a row of words) the range of the suffix array whose suffixes start with it, by binary search."""
    n, size = len(order), keys.shape[1]
    padded = np.concatenate([words, np.full(size, -1, words.dtype)])
    found = []
    for right in (False, True):
        ends = []
        for begin in range(0, len(keys), KEYS_AT_ONCE):
            some = keys[begin : begin + KEYS_AT_ONCE]
            low, high = np.zeros(len(some), np.int64), np.full(len(some), n, np.int64)
            for _ in range(n.bit_length()):
                middle = (low + high) >> 1
                here = padded[order[np.minimum(middle, n - 1)].astype(np.int64)[:, None] + np.arange(size)]
                differs = here != some
                first = differs.argmax(1)[:, None]
                a, b = np.take_along_axis(here, first, 1)[:, 0], np.take_along_axis(some, first, 1)[:, 0]
                up = (low < high) & ((a <= b) if right else (a < b))
                low, high = np.where(up, middle + 1, low), np.where(up, high, np.maximum(np.minimum(middle, high), low))
            ends.append(low)
        found.append(np.concatenate(ends))
    return found[0], found[1]


class Windows:
    """The different windows of one length, where they occur in the benchmark, and the sets of texts that hold them."""

    def __init__(self, size: int, texts: list[tuple[int, np.ndarray]], begins: np.ndarray, sets: dict[bytes, int]) -> None:
        keys = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, size) for _, x in texts])
        place = np.concatenate([begins[k] + np.arange(len(x) - size + 1) for k, x in texts])
        _, first, which = np.unique(np.ascontiguousarray(keys).view(np.dtype((np.void, 8 * size)))[:, 0], return_index=True, return_inverse=True)
        by = np.lexsort((place, which))
        self.size, self.keys, self.places = size, keys[first], place[by]
        self.ends = np.searchsorted(which[by], np.arange(len(first) + 1))
        count = np.diff(self.ends)
        #: The only place of a window, or -1.
        self.only = np.where(count == 1, self.places[self.ends[:-1]], -1)
        text = np.searchsorted(begins, self.places, "right") - 1
        self.set_of = text[self.ends[:-1]]  # sets of one text have its number
        for k in np.flatnonzero(count > 1).tolist():
            own = np.unique(text[self.ends[k] : self.ends[k + 1]])
            self.set_of[k] = own[0] if len(own) == 1 else sets.setdefault(own.tobytes(), len(begins) + len(sets))

    def join(self, position: np.ndarray, window: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, length, place) of the matches that hits, by rising position, make up."""
        at, only, out, i, n = position.tolist(), self.only[window].tolist(), [], 0, len(position)
        of = lambda k: self.places[self.ends[window[k]] : self.ends[window[k] + 1]]
        while i < n:
            here, j = only[i] if only[i] >= 0 else of(i), i + 1
            while j < n and at[j] == at[j - 1] + 1:
                if isinstance(here, int) and only[j] >= 0:
                    if here + 1 != only[j]:
                        break
                    here += 1
                else:
                    both = np.intersect1d(np.atleast_1d(here) + 1, of(j), assume_unique=True)
                    if not len(both):
                        break
                    here = int(both[0]) if len(both) == 1 else both
                j += 1
            last = here if isinstance(here, int) else int(here[0])
            out.append((at[i], self.size + j - 1 - i, last - (j - 1 - i)))
            i = j
        return out


class Probe:
    """The suffixes of one block of the benchmark that hold a whole window, by the window's number of words.

    Items of the same words are one text. A place is a word's number in all texts, one apart from each other.
    """

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        named: dict[bytes, tuple[np.ndarray, set[str]]] = {}
        for item_id, text in items:
            coded = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
            if len(coded):
                named.setdefault(coded.tobytes(), (coded, set()))[1].add(item_id)
        texts = [x for x, _ in named.values()]
        self.items = [sorted(ids) for _, ids in named.values()]
        self.begins = np.cumsum([0, *(len(x) + 1 for x in texts)], dtype=np.int64)[:-1]
        self.depth = max([window, *map(len, texts)])
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, x in enumerate(texts):
            by_length.setdefault(min(window, len(x)), []).append((k, x))
        sets: dict[bytes, int] = {}
        self.windows = [Windows(size, some, self.begins, sets) for size, some in by_length.items()]
        self.sets = [np.frombuffer(x, np.int64) for x in sets]

    def items_of(self, sets: tuple[int, ...]) -> list[str]:
        texts = [np.array([k]) if k < len(self.begins) else self.sets[k - len(self.begins)] for k in sets]
        return sorted({i for k in np.unique(np.concatenate(texts)).tolist() for i in self.items[k]})

    def search(self, coded: np.ndarray) -> tuple[np.ndarray, ...]:
        """Positions, lengths and places of all matches in a shard by rising position, and positions with the set of each hit; words that no item has are 0."""
        none = np.zeros(0, np.int64)
        if not coded.any() or not self.windows:
            return none, none, none, none, none
        # each word that no item has is one of its own: no match runs over it
        shard = np.where(coded > 0, coded, len(self.vocabulary) + 1 + np.arange(len(coded)))
        order = suffix_array(shard, self.depth)
        matches, hits = [], []
        for windows in self.windows:
            a, b = bounds(shard, order, windows.keys)
            hit = np.flatnonzero(b > a)
            count = (b - a)[hit]
            window = np.repeat(hit, count)
            position = order[np.repeat(a[hit] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))].astype(np.int64)
            by = np.argsort(position, kind="stable")
            position, window = position[by], window[by]
            matches += windows.join(position, window)
            hits.append((position, windows.set_of[window]))
        return (*(np.array(x, np.int64) for x in (zip(*sorted(matches)) if matches else [()] * 3)), *(np.concatenate(x) for x in zip(*hits)))


def _search_pass(docs: DataFrame, probe: Broadcast, out_columns: list[str], first: bool) -> DataFrame:
    """Adds a block's matches to `_tm_matches`."""
    types = dict(docs.dtypes)
    columns = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Probe = probe.value
        code = block.vocabulary.get
        for batch in batches:
            for own, texts in slices(batch, columns.index("_tm_text"), SHARD_BYTES):
                parts, counts = [], np.zeros(len(texts), np.int64)
                for k, text in enumerate(texts):
                    found = words(text)
                    counts[k] = len(found)
                    parts.append(np.array([code(w, 0) for w in found], np.int32))
                    parts.append(np.zeros(1, np.int32))
                begins = np.cumsum(counts + 1) - counts - 1
                position, size, place, hit, held = block.search(np.concatenate(parts))
                doc = np.searchsorted(begins, position, "right") - 1
                text = np.searchsorted(block.begins, place, "right") - 1
                ranges = np.searchsorted(doc, np.arange(len(texts) + 1))
                # the different sets of each document
                pairs = np.unique((np.searchsorted(begins, hit, "right") - 1) * np.int64(1 << 32) + held)
                owners = np.searchsorted(pairs, np.arange(len(texts) + 1) << 32)
                known: dict[tuple[int, ...], list[str]] = {(): []}
                old = None if first else [own.column(columns.index(c)).to_pylist() for c in ("_tm_matches", "_tm_items")]
                rows, names = [], []
                for k in range(len(texts)):
                    at = slice(ranges[k], ranges[k + 1])
                    new = [{"item_id": block.items[t][0], "doc_start": p, "item_start": q, "length": n} for t, p, q, n in zip(text[at].tolist(), (position[at] - begins[k]).tolist(), (place[at] - block.begins[text[at]]).tolist(), size[at].tolist())]
                    sets = tuple((pairs[owners[k] : owners[k + 1]] & 0xFFFFFFFF).tolist())
                    if sets not in known:
                        known[sets] = block.items_of(sets)
                    rows.append(new if first else old[0][k] + new)
                    names.append(known[sets] if first else sorted({*old[1][k], *known[sets]}))
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
                made = {"_tm_words": pa.array(counts), "_tm_matches": pa.array(rows, kind), "_tm_items": pa.array(names, pa.list_(pa.string()))}
                yield pa.record_batch([made[c] if c in made else own.column(columns.index(c)) for c in out_columns], out_columns)

    made = {"_tm_words": "long", "_tm_matches": MATCHES, "_tm_items": "array<string>"}
    return docs.mapInArrow(run, ", ".join(f"`{c}` {made.get(c) or types[c]}" for c in out_columns))


def find_matches(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = 10) -> DataFrame:
    """The carried columns of docs, `_tm_words` (number of words), `_tm_matches` (longest verbatim matches, each with one item) and `_tm_items` (all items).

    No carried column may have a name that starts with `_tm_`, or a dot in it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    df = docs.select(*carry, F.col("text").cast("string").alias("_tm_text"))
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        probe = spark.sparkContext.broadcast(Probe(sorted((r.item_id, r.text) for r in block.toLocalIterator()), window))
        last = k + 1 == blocks
        df = _search_pass(df, probe, [*carry, *(["_tm_text"] if not last else []), "_tm_words", "_tm_matches", "_tm_items"], k == 0)
        if not last:  # one block's tables in a worker at a time
            df = materialize(df, f"matches{k}")
    return df


def covered(matches: Column) -> Column:
    """Words inside any match: the length of the union of the matches."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m.doc_start.alias("a"), (m.doc_start + m.length).alias("b"))))
    step = lambda acc, m: F.struct(F.greatest(acc.end, m.b).alias("end"), (acc.n + F.greatest(F.lit(0), m.b - F.greatest(m.a, acc.end))).alias("n"))
    return F.aggregate(spans, zero, step, lambda acc: acc.n.cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings), matches, contaminated: a row for each document."""
    found = find_matches(docs, benchmark, ["doc_id"], window)
    ids = F.array_sort("_tm_items")
    return found.select("doc_id", F.col("_tm_words").alias("n_words"), covered(F.col("_tm_matches")).alias("n_hit"), ids.alias("item_ids"), F.col("_tm_matches").alias("matches"), (F.size("_tm_matches") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns, that hold no window of the benchmark."""
    plain, names = with_plain_names(docs)
    own = list(names.values())
    found = find_matches(plain.withColumn("text", F.col(names["text"])), benchmark, own, window)
    return found.filter(F.size("_tm_matches") == 0).select(*own).toDF(*docs.columns)
