"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences of their own. The others are dealt by
hash to shards of bounded size; several islands evolve packings of one shard. A crossover injects whole well-filled
sequences of one parent into another, drops the sequences that then hold a document twice, and best-fits the
documents so displaced. Between epochs every island's best packing also goes to the next island. Afterwards the
sequences filled worst give up their documents, which are dealt again to fewer shards, until one shard is left.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed separately; an
empty table gives an empty result; extra columns of the input are ignored; ties are settled by the piece number.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoding
from .shared import materialize

PIECES = "piece_id long, doc_id long, piece int, start long, length long, ids binary"

#: Bytes of text that are encoded at once.
ENCODED_BYTES = 8_000_000
#: Documents of a shard, on average: bounds what one task evolves.
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 4
#: A sequence is well filled from this share of the capacity on.
WELL_FILLED = 0.995
#: Share of a shard's sequences, worst first, that give up their documents to the next level.
DISPLACED = 0.08


# ---------------------------------------------------------------- pieces


def cut_ids(n: int, capacity: int) -> list[int]:
    """Where pieces of a document with n ids start: the first piece takes what does not fill a whole one."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Encodes whole texts; a row for each piece, ids as little-endian unsigned 32-bit integers."""
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(tokenizer)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        for batch in batches:
            for own in encoding.cut_batch(batch, 1, ENCODED_BYTES):
                ids, sizes = encoder.encode_column(own.column(1), end)
                rows = []
                for doc_id, n in zip(own.column(0).to_pylist(), sizes.tolist()):
                    starts = cut_ids(n, capacity)
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], n])):
                        rows.append((number, doc_id, k, s, e - s))
                        number += 1
                names = ["piece_id", "doc_id", "piece", "start", "length", "ids"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
                # pieces lie one behind the other, as the ids do
                bounds = pa.array(4 * np.r_[0, np.cumsum(columns[4].to_numpy())], pa.int32())
                columns.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, bounds.buffers()[1], pa.py_buffer(ids)]))
                yield pa.record_batch(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


# ---------------------------------------------------------------- one island


class Filling:
    """Open sequences by free space: the fullest that still takes a document is found by one shift and one mask."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask = capacity, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def open(self, bin_no: int, space: int) -> None:
        if space:
            self.by_space[space].append(bin_no)
            self.mask |= 1 << space

    def take(self, length: int) -> tuple[int, int] | None:
        """The best-fitting sequence, taken out, and its free space."""
        above = self.mask >> length
        if not above:
            return None
        space = length + (above & -above).bit_length() - 1
        stack = self.by_space[space]
        found = stack.pop()
        if not stack:
            self.mask ^= 1 << space
        return found, space


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Puts the documents in order into bins (their numbers in free, by free space), opening new ones."""
    filling = Filling(capacity)
    for k, space in enumerate(free):
        filling.open(k, space)
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        got = filling.take(length)
        if got is None:
            got = len(free), capacity
            free.append(capacity)
        k, space = got
        bins[item] = k
        free[k] = space - length
        filling.open(k, space - length)


def renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fills(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then unevenly filled ones, which leave more room for later."""
    f = fills(bins, lengths) / capacity
    return -len(f), float((f * f).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Injects well-filled sequences of b into a."""
    full = np.flatnonzero(fills(b, lengths) >= WELL_FILLED * capacity)
    if not len(full):
        full = np.array([int(np.argmax(fills(b, lengths)))])
    chosen = np.zeros(b.max() + 1, bool)
    chosen[full[rng.random(len(full)) < rng.uniform(0.2, 0.8)]] = True
    injected = chosen[b]
    broken = np.zeros(a.max() + 1, bool)
    broken[a[injected]] = True
    displaced = broken[a] & ~injected
    child = np.where(injected, b + a.max() + 1, a)
    return refill(child, displaced, lengths, capacity, rng)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties the worst-filled sequences and some others."""
    f = fills(a, lengths)
    out = rng.random(len(f)) < 0.02
    out[np.argsort(f, kind="stable")[: max(2, len(f) // 20)]] = True
    return refill(a, out[a], lengths, capacity, rng)


def refill(bins: np.ndarray, displaced: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Best-fits the displaced documents, long ones first with a little noise, into what the others leave."""
    out = np.empty(len(bins), np.int32)
    out[~displaced] = renumbered(bins[~displaced])
    free = (capacity - fills(out[~displaced], lengths[~displaced])).astype(int).tolist() if not displaced.all() else []
    items = np.flatnonzero(displaced)
    noisy = lengths[items] * rng.uniform(0.9, 1.0, len(items))
    best_fit(items[np.argsort(-noisy, kind="stable")], lengths, out, free, capacity)
    return renumbered(out)


def evolve(population: list[np.ndarray], lengths: np.ndarray, capacity: int, seed: int) -> np.ndarray:
    """The best packing after some generations; lengths come sorted, long ones first."""
    rng = np.random.default_rng(seed)
    n = len(lengths)
    least = -(-int(lengths.sum()) // capacity)
    population = list(population)
    while len(population) < POPULATION:
        bins = np.zeros(n, np.int32)
        noise = rng.uniform(1 - 0.05 * len(population), 1.0, n)
        best_fit(np.argsort(-lengths * noise, kind="stable"), lengths, bins, [], capacity)
        population.append(renumbered(bins))
    scored = sorted(((fitness(x, lengths, capacity), k, x) for k, x in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
    for g in range(GENERATIONS):
        if -scored[0][0][0] <= least:
            break
        for k in range(2):
            a, b = rng.choice(len(scored), 2, replace=False)
            child = mutate(crossover(scored[a][2], scored[b][2], lengths, capacity, rng), lengths, capacity, rng)
            scored.append((fitness(child, lengths, capacity), POPULATION + 2 * g + k, child))
        scored = sorted(scored, key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
    return scored[0][2]


# ---------------------------------------------------------------- islands on Spark

STATE = "shard long, island int, piece_id long, length int, bin int, role int"


def _islands(state: DataFrame, capacity: int, epoch: int, level: int) -> DataFrame:
    """One epoch: each island evolves its shard from the packings that came to it."""

    def epoch_of_island(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "piece_id", "role"], ascending=[False, True, True], kind="stable")
        own = pdf[pdf.role == pdf.role.min()]
        lengths = own["length"].to_numpy(np.int64)
        population = [renumbered(x["bin"].to_numpy()) for _, x in pdf.groupby("role") if (x["bin"] >= 0).all()]
        shard, island = int(own.shard.iloc[0]), int(own.island.iloc[0])
        best = evolve(population, lengths, capacity, random.Random(f"{level} {epoch} {shard} {island}").getrandbits(63))
        return pd.DataFrame({"shard": own.shard, "island": own.island, "piece_id": own.piece_id, "length": own["length"], "bin": best, "role": np.int32(0)})

    return state.groupBy("shard", "island").applyInPandas(epoch_of_island, STATE)


def _settle(state: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """The islands of a shard meet: the best packing of all, with the worst sequences given up unless this is the last level."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "piece_id", "island"], ascending=[False, True, True], kind="stable")
        packings = [(k, x) for k, x in pdf.groupby("island")]
        lengths = packings[0][1]["length"].to_numpy(np.int64)
        shard = int(pdf.shard.iloc[0])
        best = evolve([x["bin"].to_numpy() for _, x in packings], lengths, capacity, random.Random(f"{level} {shard}").getrandbits(63))
        f = fills(best, lengths)
        given_up = np.zeros(len(f), bool)
        if not last:
            worst = np.argsort(f, kind="stable")[: max(2, int(len(f) * DISPLACED))]
            given_up[worst] = f[worst] < capacity
        own = packings[0][1]
        sequence = (np.int64(level) << 56) + (np.int64(shard) << 16) + best
        by = np.lexsort((own.piece_id, best))
        placed = np.cumsum(lengths[by])
        first = np.r_[True, best[by][1:] != best[by][:-1]]
        before = placed - lengths[by]
        offset = np.empty(len(by), np.int64)
        offset[by] = before - np.maximum.accumulate(np.where(first, before, 0))
        return pd.DataFrame({"piece_id": own.piece_id.to_numpy(), "length": own["length"].to_numpy(), "sequence_id": sequence, "offset": offset, "given_up": given_up[best]})

    return state.groupBy("shard").applyInPandas(settle, "piece_id long, length int, sequence_id long, offset long, given_up boolean")


def place(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Packs items (piece_id, length below the capacity): piece_id, sequence_id, offset."""
    spark = items.sparkSession
    waiting = items.select("piece_id", F.col("length").cast("int").alias("length"))
    placed: DataFrame | None = None
    level = 0
    while True:
        n = waiting.count()
        shards = max(1, -(-n // SHARD))
        last = shards == 1
        # a shard number depends on the level, so documents meet others than before
        state = waiting.select(F.pmod(F.xxhash64("piece_id", F.lit(level)), F.lit(shards)).alias("shard"), F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "piece_id", "length", F.lit(-1).alias("bin"), F.lit(0).alias("role"))
        for epoch in range(EPOCHS):
            state = _islands(state, capacity, epoch, level)
            if epoch + 1 < EPOCHS:  # every island's best also goes to the next island
                state = state.select("shard", F.explode(F.array(F.struct("island", F.lit(0).alias("role")), F.struct(((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(1).alias("role")))).alias("to"), "piece_id", "length", "bin").select("shard", "to.island", "piece_id", "length", "bin", "to.role")
        settled = materialize(_settle(state, capacity, level, last), f"level{level}")
        kept = settled.filter(~F.col("given_up")).select("piece_id", "sequence_id", "offset")
        placed = kept if placed is None else placed.unionByName(kept)
        if last:
            return placed
        waiting = settled.filter("given_up").select("piece_id", "length")
        level += 1


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, payload: dict[str, Column] | None = None) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, sequence_id, offset and the payload: columns made from `ids` before any rows
    move, by default the ids themselves.
    """
    pieces = materialize(token_pieces(docs, tokenizer or encoding.default_tokenizer(), capacity, end_id), "pieces")
    payload = {"ids": F.col("ids")} if payload is None else payload
    columns = ["doc_id", "piece", "start", "length"]
    full = pieces.filter(F.col("length") == capacity).select(*columns, *(c.alias(n) for n, c in payload.items()), (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.filter(F.col("length") < capacity)
    placed = place(part, capacity)
    part = part.select("piece_id", *columns, *(c.alias(n) for n, c in payload.items())).join(placed, "piece_id").drop("piece_id")
    return full.unionByName(part).select(*columns, *payload, "sequence_id", "offset")
