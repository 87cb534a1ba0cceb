"""Hard negatives by exact integer scores: Four-Russians tables of the anchors, indexed with packed bit planes of all rows.

Components become integers. A block of rows holds their bits: for each of the planes of two's complement and each group of
eight dimensions a byte a row. A block of anchors holds, for each group, the sums of its components over all 256 subsets of
the eight dimensions. A plane's share of all scores is then a sum of table rows, and shifting and adding the planes gives
the full exact inner products. Each block of anchors meets each block of rows in one task; only the best few of each anchor
leave it. A first pass finds the positives, a second one the negatives, whose scores the positives bound.

Defined results: a row with a null id, label or vector or with a null or non-finite component takes no part; a vector that is
shorter than another is filled with zeros, so an empty one scores zero; a row with an anchor's id is never its positive;
repeated rows count separately, as anchors too; ties go by id; an empty table or one without anchors gives an empty result;
extra columns are ignored. Scores must stay below 2**49 in size (64 components below some 5,000), else the job fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import give_back, materialize

#: Rows of a block, at most 2**RANK_BITS, and anchors of one on average.
BLOCK, RANK_BITS, ANCHORS = 4096, 13, 256
GROUP = 8
MAX_SCORE = 1 << 49
#: Shares of shuffle partitions that the pairs of blocks are dealt to at least.
SPREAD = 2
NONE = np.iinfo(np.int64).min


def pack_planes(vectors: np.ndarray) -> np.ndarray:
    """(rows, dimensions) of integers to (planes, groups, rows) of bytes; the last plane is that of the sign."""
    rows, width = vectors.shape
    groups = max(1, -(-width // GROUP))
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :width] = vectors
    planes = 1 + int(max(padded.max(initial=0), -1 - padded.min(initial=0))).bit_length()
    bits = np.empty((planes, groups, rows), np.uint8)
    for b in range(planes):
        bits[b] = np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").T
    return bits


def unpack_planes(bits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The integers of some rows again."""
    weights = [1 << b for b in range(len(bits) - 1)] + [-(1 << len(bits) - 1)]
    return sum(w * np.unpackbits(p[:, wanted].T, axis=1, bitorder="little").astype(np.int64) for w, p in zip(weights, bits))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(anchors, dimensions) of integers to tables (groups, 256, anchors)."""
    n, width = anchors.shape
    tables = np.zeros((width // GROUP, 1 << GROUP, n), np.int64)
    for g in range(len(tables)):
        for i in range(GROUP):
            tables[g, 1 << i : 2 << i] = tables[g, : 1 << i] + anchors[:, g * GROUP + i]
    return tables


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors): table rows picked by the bytes of a plane, added, and shifted in from the highest plane."""
    groups, high = min(len(tables), bits.shape[1]), len(bits) - 1
    bound = int(np.abs(tables[:groups]).max(axis=1).sum(axis=0).max(initial=0)) << high
    if bound >= MAX_SCORE:
        raise ValueError("scores reach 2**49: scale the vectors down")
    tables = tables[:groups].astype(np.int32 if bound < 1 << 29 else np.int64)
    out = np.empty((bits.shape[2], tables.shape[2]), np.int64)
    for low in range(0, len(out), 512):  # as many as a processor's cache holds
        own, total = bits[:, :, low : low + 512], None
        for b in range(high, -1, -1):
            part = tables[0][own[b, 0]]
            for g in range(1, groups):
                part += tables[g][own[b, g]]
            if total is None:
                total = -part
            else:
                total <<= 1
                total += part
        out[low : low + 512] = total
    return out


def _best(score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first entries of the last axis, by falling score, then by id."""
    order = np.lexsort((ids, -score), axis=-1)[..., :most]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


class _Rows:
    """A block of rows, by label and id."""

    def __init__(self, x: dict) -> None:
        self.ids, self.labels = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
        self.bits = np.frombuffer(x["bits"], np.uint8).reshape(x["planes"], -1, len(self.ids))

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())


class _Anchors:
    """A block of anchors with their tables."""

    def __init__(self, x: dict) -> None:
        members = sorted(x["members"], key=lambda m: m["row"])
        self.ids, self.labels = (np.array([m[c] for m in members], np.int64) for c in ("id", "label"))
        vectors = [np.frombuffer(m["vector"], np.int64) for m in members]
        full = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
        for row, v in zip(full, vectors):
            row[: len(v)] = v
        self.tables = subset_sums(full)


def _positives(anchors: _Anchors, rows: _Rows, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (anchors, most) of the best rows of the same label."""
    score, found = np.full((len(anchors.ids), most), NONE + 1), np.zeros((len(anchors.ids), most), np.int64)
    for label in np.unique(anchors.labels).tolist():
        own = rows.of_label(label)
        n = own.stop - own.start
        if not n:
            continue
        at = np.flatnonzero(anchors.labels == label)
        ids = rows.ids[own]
        part = scores(anchors.tables[:, :, at], rows.bits[:, :, own]).T
        keys = (part << RANK_BITS) + (n - 1 - np.arange(n))  # one number for score and id
        keys[ids[None, :] == anchors.ids[at][:, None]] = NONE
        take = min(n, most)
        keys = -np.sort(-np.partition(keys, n - take, axis=1)[:, n - take :], axis=1)
        score[at, :take] = np.where(keys == NONE, NONE + 1, keys >> RANK_BITS)
        found[at, :take] = ids[n - 1 - (keys & (1 << RANK_BITS) - 1)] if n > 1 else ids[0]
    return score, found


def _negatives(anchors: _Anchors, positive: np.ndarray, rows: _Rows, most: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (anchors, positives, most) of the best rows of other labels between the bounds; positive: scores or NONE + 1."""
    by_id = np.argsort(rows.ids, kind="stable")
    rank = np.empty_like(by_id)
    n = len(rank)
    rank[by_id] = np.arange(n)
    keys = (scores(anchors.tables, rows.bits).T << RANK_BITS) + (n - 1 - rank)
    for label in np.unique(anchors.labels).tolist():
        keys[np.flatnonzero(anchors.labels == label)[:, None], np.arange(n)[rows.of_label(label)][None, :]] = NONE
    keys.sort(axis=1)
    there = positive > NONE + 1
    p = np.where(there, positive, -1)
    top, least = high * p // 100, -(-low * p // 100)
    ends = np.stack([np.searchsorted(row, t) for row, t in zip(keys, top + 1 << RANK_BITS)])
    at = ends[:, :, None] - 1 - np.arange(most)
    got = np.take_along_axis(keys[:, None, :], np.maximum(at, 0), 2)
    valid = (at >= 0) & (got != NONE) & (got >> RANK_BITS >= least[:, :, None]) & there[:, :, None]
    return np.where(valid, got >> RANK_BITS, NONE + 1), rows.ids[by_id[np.where(valid, n - 1 - (got & (1 << RANK_BITS) - 1), 0)]]


def _blocks(vectors: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """block, ids, labels, marks (of anchors), planes, bits: all rows that take part, by label and id."""
    names = ["block", "ids", "labels", "marks", "planes", "bits"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                x = batch.slice(begin, BLOCK)
                lengths = x.column(3).value_lengths().to_numpy()
                values = x.column(3).flatten().to_numpy()
                if np.abs(values, dtype=np.float64).max(initial=0) >= 1 << 24:
                    raise ValueError("components reach 2**24: scale the vectors down")
                full = np.zeros((x.num_rows, int(lengths.max())), np.int64)
                full[np.arange(full.shape[1]) < lengths[:, None]] = values
                bits = pack_planes(full)
                own = [x.column(k).to_numpy().astype(np.int64).tobytes() for k in (0, 1)]
                yield pa.record_batch([[number], [own[0]], [own[1]], [x.column(2).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.array([len(bits)], pa.int32()), [bits.tobytes()]], names)
                number += 1
        give_back()

    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(usable).withColumn("v", F.transform("v", lambda c: F.floor(c * scale)))
    return x.repartitionByRange("label", "id").sortWithinPartitions("label", "id").mapInArrow(pack, "block long, ids binary, labels binary, marks binary, planes int, bits binary")


def _members(blocks: DataFrame) -> DataFrame:
    """row (a number of its own), id, label and vector of each anchor."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(x["marks"], np.uint8))
                rows = _Rows(x)
                vectors = unpack_planes(rows.bits, at)
                yield pa.record_batch([pa.array((x["block"] << 16) + at), pa.array(rows.ids[at]), pa.array(rows.labels[at]), pa.array([v.tobytes() for v in vectors], pa.binary())], ["row", "id", "label", "vector"])

    return blocks.mapInArrow(unpack, "row long, id long, label long, vector binary")


def mine(vectors: DataFrame, anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (and anchor_row, which tells repeated anchors apart).

    Anchors are the rows for which `anchor` holds. Its positives are its first `positives` other rows of the same label; the
    negatives of a positive are the first `negatives` rows of other labels with a score from `low` to `high` percent of its own.
    """
    spark = vectors.sparkSession
    blocks = materialize(_blocks(vectors, anchor, id_col, label_col, vector_col, scale), "blocks")
    members = materialize(_members(blocks), "members")
    groups = max(1, -(-members.count() // ANCHORS))
    salts = max(1, -(-SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    anchors = members.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("k")).agg(F.collect_list(F.struct("row", "id", "label", "vector")).alias("members"))

    def meet(anchors: DataFrame) -> DataFrame:
        """Each block of anchors beside each block of rows: both are dealt to (k, salt)."""
        left = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        right = blocks.drop("marks").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return left.hint("merge").join(right, ["k", "salt"]).select("k", "salt", *(c for c in left.columns if c not in ("k", "salt")), "planes", "ids", "labels", "bits")

    def passes(best: int, names: list[str]):
        """Runs one pass over rows of (k, salt): what is best so far stays until the next key, and leaves as rows (k, row, at, score, id)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = own = rows = positive = None
            so_far: tuple[np.ndarray, np.ndarray] | None = None

            def leave() -> pa.RecordBatch:
                score, found = so_far
                where = np.nonzero(score > NONE + 1)
                return pa.record_batch([pa.array(np.full(len(where[0]), key[0])), pa.array(rows[where[0]]), pa.array(where[1].astype(np.int32)), pa.array(score[where]), pa.array(found[where])], names)

            for batch in batches:
                for i in range(batch.num_rows):
                    x = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                    at = (x["k"].as_py(), x["salt"].as_py())
                    if at != key:
                        if so_far is not None:
                            yield leave()
                        key, so_far = at, None
                        members = x["members"].as_py()
                        own, rows = _Anchors({"members": members}), np.array(sorted(m["row"] for m in members), np.int64)
                        if "positives" in x:
                            positive = np.full((len(rows), positives), NONE + 1)
                            for p in x["positives"].as_py() or ():
                                positive[np.searchsorted(rows, p["row"]), p["rank"] - 1] = p["score"]
                    block = _Rows({c: x[c].as_py() for c in ("ids", "labels", "bits", "planes")})
                    new = _positives(own, block, best) if positive is None else _negatives(own, positive, block, best, low, high)
                    so_far = new if so_far is None else _best(*(np.concatenate(z, axis=-1) for z in zip(so_far, new)), best)
            if so_far is not None:
                yield leave()
            give_back()

        return run

    schema = "k long, row long, at int, score long, id long"
    names = ["k", "row", "at", "score", "id"]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    near = meet(anchors).mapInArrow(passes(positives, names), schema).drop("at").withColumn("rank", first("row")).filter(F.col("rank") <= positives)
    near = materialize(near, "positives")
    of_block = near.groupBy("k").agg(F.collect_list(F.struct("row", "rank", "score")).alias("positives"))
    far = meet(anchors.join(of_block, "k")).mapInArrow(passes(negatives, names), schema).withColumn("rank", first("row", "at")).filter(F.col("rank") <= negatives)
    found = far.select("row", (F.col("at") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = near.select("row", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = members.select("row", F.col("id").alias("anchor_id")).join(of, "row")
    return wanted.join(found, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("row").alias("anchor_row"))
