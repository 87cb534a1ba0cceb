"""Token ids as Parquet list columns: dictionary or delta encoded, small row groups, page indexes.

Rows lie in ascending doc_id order over the files, so the statistics of files, row groups and pages select documents,
and a reader of `n_tokens` or `source` never touches `ids`.

Defined results: a null or empty text holds the end id alone; repeated rows are written separately, equal doc_ids by
text; a null doc_id comes first; an empty table gives an empty table; clashing extra columns are ignored unless asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encoding
from .shared import materialize

#: Encodings of the id column. The dictionary of a 50k vocabulary fits in its page, so ids take 16 bits or less.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def encode_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and metadata columns, in ascending doc_id order over the partitions."""
    path = tokenizer or encoding.default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(path)
        for batch in batches:
            for own in encoding.cut_batch(batch, 1):
                data, sizes = encoder.encode_column(own.column(1), end)
                ids = pa.Array.from_buffers(pa.int32(), len(data), [None, pa.py_buffer(data)])
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                columns = [own.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, ids), *own.columns[2:]]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", *metadata])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *metadata)
    kinds = dict(wanted.dtypes)
    schema = "doc_id long, n_tokens long, ids array<int>" + "".join(f", `{c}` {kinds[c]}" for c in metadata)
    return wanted.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, schema)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, metadata: tuple[str, ...] = (), id_encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the table; rows are ordered by one range exchange, of texts, which are smaller than their ids."""
    options = {"compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.write-checksum.enabled": "true", **ENCODINGS[id_encoding]}
    encode_table(docs, tokenizer, end_id, metadata).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Only the columns asked for; filters on doc_id prune files, row groups and pages."""
    return spark.read.parquet(path).select(*columns)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """For each row of the files: doc_id, file, row, start (the ids in all rows before it), n_tokens and ids_crc32.

    The files are read once. A task adds up the ids of each run of rows of one file that it reads; the runs' totals, a row
    for each split of a file, are then added up in the order of the files' part numbers, and rows get what is before their run.
    ids_crc32 is of the ids as little-endian unsigned 32-bit integers.
    """
    names = ["file", "run", "row", "doc_id", "before", "n_tokens", "ids_crc32"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, run, after, before = -1, 0, -1, 0
        for batch in batches:
            ids, files, rows = batch.column(3), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, offsets = np.ascontiguousarray(ids.values.to_numpy(), "<u4"), ids.offsets.to_numpy()
            sizes = np.diff(offsets).astype(np.int64)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            cut = np.flatnonzero((np.diff(files) != 0) | (np.diff(rows) != 1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if (files[a], rows[a]) != (file, after):
                    file, run, before = int(files[a]), int(rows[a]), 0
                total = np.cumsum(sizes[a:b])
                after, n = int(rows[b - 1]) + 1, b - a
                columns = [batch.column(0).slice(a, n), pa.array(np.full(n, run)), batch.column(1).slice(a, n), batch.column(2).slice(a, n), pa.array(before + total - sizes[a:b]), pa.array(sizes[a:b]), pa.array(crc[a:b], pa.int64())]
                before += int(total[-1])
                yield pa.record_batch(columns, names)

    rows = spark.read.parquet(path).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "ids")
    found = materialize(rows.mapInArrow(digest, "file long, run long, row long, doc_id long, before long, n_tokens long, ids_crc32 long"), "digests")
    # a row for each split of a file; sums run within blocks of 1024 files and over the blocks
    runs = found.groupBy("file", "run").agg(F.sum("n_tokens").alias("total")).withColumn("block", F.floor(F.col("file") / 1024))
    ahead = lambda by, *order: F.coalesce(F.sum("total").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = runs.groupBy("block").agg(F.sum("total").alias("total")).select("block", ahead(Window, "block").alias("block_start"))
    runs = materialize(runs.withColumn("in_block", ahead(Window.partitionBy("block"), "file", "run")).join(blocks, "block").select("file", "run", (F.col("block_start") + F.col("in_block")).alias("run_start")), "runs")
    return found.join(runs, ["file", "run"]).select("doc_id", "file", "row", (F.col("run_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
