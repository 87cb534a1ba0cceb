"""Incremental ingestion: files that are new or have changed, merged into a versioned table by micro-batches.

The number of the last micro-batch stands in the table's log entry, which the commit makes in one step. A batch that runs
again, as the checkpoint didn't learn of its commit, finds its number and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.sources import versions

#: What tells whether a file is the one that was ingested.
SIGNATURE = ("size", "mtime", "sha256", "context", "extractor_version")
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def merge_files(state: DataFrame | None, seen: DataFrame) -> DataFrame:
    """path, signature, seq, changes, skipped: the last sighting of each file, and how often it was ingested or found as it was.

    seen: path, the signature's columns and seq (the order of sightings, unique). A sighting is ingested if its signature isn't
    that of the sighting before it. Several sightings of a file in one batch count in their order; those that come after later
    ones are left out. A file's sightings are folded in one array, as its state needs their order.
    """
    row = F.struct("seq", *SIGNATURE)
    new = seen.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    if state is None:
        types = dict(seen.dtypes)
        state = seen.sparkSession.createDataFrame([], ", ".join(f"{c} {types[c]}" for c in ("path", "seq", *SIGNATURE)) + ", changes long, skipped long")
    both = state.withColumn("_old", F.struct("seq", *SIGNATURE)).join(new, "path", "full_outer")
    start = F.struct(F.col("_old").alias("last"), F.coalesce("changes", F.lit(0).cast("long")).alias("changes"), F.coalesce("skipped", F.lit(0).cast("long")).alias("skipped"))

    def step(acc, x):
        late = F.coalesce(x.seq <= acc.last.seq, F.lit(False))
        same = F.coalesce(F.struct(*(acc.last[c] for c in SIGNATURE)) == F.struct(*(x[c] for c in SIGNATURE)), F.lit(False))
        return F.struct(F.when(late, acc.last).otherwise(x).alias("last"), (acc.changes + (~late & ~same).cast("long")).alias("changes"), (acc.skipped + (~late & same).cast("long")).alias("skipped"))

    kind = new.schema["_rows"].dataType.simpleString()
    done = both.withColumn("_done", F.aggregate(F.coalesce("_rows", F.array().cast(kind)), start, step))
    return done.select("path", "_done.last.*", "_done.changes", "_done.skipped")


def run(stream: DataFrame, root: str, name: str, checkpoint: str, merge: Merge = merge_files, after: Callable[[int], None] | None = None) -> None:
    """Works off all the stream has. name: of the stream, the same for every run with one checkpoint. after: is told each batch's number."""
    spark: SparkSession = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            versions.update(spark, root, lambda old: (merge(old, batch), {}), batch=(name, number))
        finally:
            batch.unpersist()
        if after is not None:
            after(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table_stream(spark: SparkSession, path: str, schema, files_at_once: int = 16) -> DataFrame:
    """A table that is one Parquet file or a folder of them, as a stream of its files, without a copy."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent().toString()))
