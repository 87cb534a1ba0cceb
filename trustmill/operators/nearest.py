"""Nearest vectors by cosine, exactly: cells around centroids, of which the triangle inequality leaves out those too far off.

The angle between a query and a vector is at least that between the query and the vector's centroid, less the vector's own
angle to the centroid. So a block of a cell whose widest vector can't come up to a query's k-th best isn't compared with it.
A first pass searches the cells next to each query and gives the k-th best, a second one what is left. Rows and queries meet
in blocks through joins; the centroids, a bounded sample of the rows, are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustmill.sources.folders import stored

#: Centroids at most; they are as many as the root of the number of rows, chosen by a hash of the id.
CENTROIDS = 1024
#: Rows of a block, queries of one, and cells that the first pass searches.
BLOCK, QUERIES, FIRST_CELLS = 2048, 256, 2
#: What a bound may be off by, as angles and cosines are rounded.
SLACK = 1e-9


class Centroids:
    """Unit vectors by length; cell k is around the k-th, and cell -n holds vectors of a length n that has no centroid."""

    def __init__(self, vectors: list[list[float]]) -> None:
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(v) for v in vectors}:
            own = [k for k, v in enumerate(vectors) if len(v) == n]
            x = np.array([vectors[k] for k in own], float)
            self.of_length[n] = np.array(own), x / np.sqrt((x * x).sum(1))[:, None]

    def angles(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, angles) of vectors of one length to all its centroids."""
        if x.shape[1] not in self.of_length:
            return np.array([-x.shape[1]]), np.zeros((len(x), 1))
        cells, c = self.of_length[x.shape[1]]
        return cells, np.arccos(np.clip((x / np.sqrt((x * x).sum(1))[:, None]) @ c.T, -1, 1))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, flat[ends[at][:, None] + np.arange(n)]


def _usable(df: DataFrame, key: str) -> DataFrame:
    """(key, embedding) in doubles; null, empty, zero and unfinished vectors have no cosine."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(key, v.alias("embedding")).filter(F.col("embedding").isNotNull()).filter(fine)


def nearest(index: DataFrame, queries: DataFrame, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits, work): (query_id, rank, id, score) of the rows (id, embedding) with the highest cosine above 0, ties by id.

    Scores are rounded to 8 places before they are ranked. work: compared and all pairs of rows and queries.
    """
    spark = index.sparkSession
    rows, asked = _usable(index, "id"), stored(_usable(queries, "query_id").withColumn("number", F.monotonically_increasing_id()), "asked")
    n, nq = rows.count(), asked.count()
    sample = rows.select("id", "embedding", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max(1, min(CENTROIDS, int(n**0.5))))
    around = spark.sparkContext.broadcast(Centroids([r.embedding for r in sample.collect()]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, x in _by_length(batch.column(1)):
                cells, angles = around.value.angles(x)
                best = angles.argmin(1)
                cell[at], angle[at] = cells[best], angles[np.arange(len(at)), best]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    kind = dict(rows.dtypes)["id"]
    placed = stored(rows.mapInArrow(assign, f"id {kind}, embedding array<double>, cell long, angle double"), "placed")
    of_cell = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = placed.join(of_cell, "cell").groupBy("cell", F.pmod(F.xxhash64("id"), "parts").alias("part")).agg(F.max("angle").alias("radius"), F.count("*").alias("n"), F.collect_list(F.struct("id", "embedding")).alias("rows"))
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    # where each query stands to each cell of its length: at most CENTROIDS rows a query
    radii = spark.sparkContext.broadcast([tuple(r) for r in blocks.groupBy("cell").agg(F.max("radius"), F.sum("n")).toLocalIterator()])

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest, counts = {c: r for c, r, _ in radii.value}, {c: k for c, _, k in radii.value}
        for batch in batches:
            for at, x in _by_length(batch.column(1)):
                cells, angles = around.value.angles(x)
                there = [k for k, c in enumerate(cells.tolist()) if c in counts]
                if not there:
                    continue
                cells, angles = cells[there], angles[:, there]
                radius, size = np.array([widest[c] for c in cells.tolist()]), np.array([counts[c] for c in cells.tolist()])
                order = np.argsort(angles, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(angles.shape, bool)
                np.put_along_axis(first, order, (np.arange(len(cells)) < FIRST_CELLS) | (before < top_k), axis=1)
                upper = np.where(cells < 0, 1.0, np.cos(np.maximum(0, angles - radius)))
                q = batch.column(0).take(pa.array(np.repeat(at, len(cells))))
                yield pa.record_batch([q, pa.array(np.tile(cells, len(at))), pa.array(angles.ravel()), pa.array(upper.ravel()), pa.array(first.ravel())], ["number", "cell", "off", "upper", "first"])

    standing = stored(asked.select("number", "embedding").mapInArrow(stand, "number long, cell long, off double, upper double, first boolean"), "standing")
    groups = max(1, -(-nq // QUERIES))

    def compared(pairs: DataFrame) -> DataFrame:
        """The best of each block for its queries, from (block, number)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own, wanted = batch.column(0)[k].values, batch.column(1)[k].values
                    p, q = (np.array(x.field("embedding").to_pylist(), float) for x in (own, wanted))
                    cosine = (p @ q.T) / (np.sqrt((p * p).sum(1))[:, None] * np.sqrt((q * q).sum(1)))
                    rounded, ids = np.round(cosine, 8), own.field("id")
                    at, of = [], []
                    for j in range(cosine.shape[1]):
                        some = np.flatnonzero(cosine[:, j] > 0)
                        if len(some) > top_k:  # rounding may differ by a unit: the engine's order decides
                            some = some[rounded[some, j] >= np.partition(rounded[some, j], -top_k)[-top_k] - 2e-8]
                        at += some.tolist()
                        of += [j] * len(some)
                    yield pa.record_batch([wanted.field("number").take(pa.array(of, pa.int64())), ids.take(pa.array(at, pa.int64())), pa.array(cosine[at, of], pa.float64())], ["number", "id", "cosine"])

        met = pairs.join(asked.select("number", "embedding"), "number").groupBy("block", F.pmod(F.xxhash64("number"), F.lit(groups))).agg(F.collect_list(F.struct("number", "embedding")).alias("wanted"))
        found = met.join(blocks.select("block", "rows"), "block").select("rows", "wanted").mapInArrow(run, f"number long, id {kind}, cosine double")
        return found.withColumn("score", F.round("cosine", 8))

    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= top_k)
    near = blocks.select("block", "cell", "radius", "n")
    first = stored(standing.filter("first").join(near, "cell").select("block", "number", "n"), "first")
    head = stored(best(compared(first)), "head")
    kth = asked.select("number").join(head.groupBy("number").agg(F.count("*").alias("m"), F.min("score").alias("least")), "number", "left").select("number", F.when(F.col("m") >= top_k, F.col("least")).otherwise(0.0).alias("kth"))
    # a block's own radius is at most its cell's
    upper = F.when(F.col("cell") < 0, 1.0).otherwise(F.cos(F.greatest(F.lit(0.0), F.col("off") - F.col("radius"))))
    rest = standing.filter("NOT first").join(kth, "number").filter(F.col("upper") + SLACK + 1e-8 >= F.col("kth")).join(near, "cell").filter(upper + SLACK + 1e-8 >= F.col("kth"))
    rest = stored(rest.select("block", "number", "n"), "rest")
    hits = best(head.drop("rank").unionByName(compared(rest))).join(asked.select("number", "query_id"), "number").select("query_id", "rank", "id", "score")
    work = first.unionByName(rest).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).withColumn("all", F.lit(n * nq))
    return hits, work
