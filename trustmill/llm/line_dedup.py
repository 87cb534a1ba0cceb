"""Line dedup: hashes of line keys, range-partitioned and sorted by document and position, streamed for first occurrences.

Ranges are cut on (hash, document), so a line that a third of all rows hold is spread over many tasks; where a run of one
hash goes on from the partition before, the last hashes of the partitions settle it. What returns to the documents is a
compressed bitmap of the lines to keep; texts are never shuffled while the bitmaps are small.

Defined results: a null or empty text is one empty line and stays; a null doc_id counts as smaller than all others; rows
with one doc_id are one document when holders are compared, and each keeps its own lines; an empty table gives an empty
result; extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, hash128, materialize, with_plain_names

BLANKS = " \t\n\x0b\x0c\r"
MIN_KEY = 10
#: Bitmaps go to all executors up to this many bytes; beyond that documents and bitmaps are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identity(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document a row belongs to, and what tells its rows apart."""
    return docs.withColumns({"_tm_doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "_tm_text": F.xxhash64(F.col(text).cast("string"))})


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h1, h2, doc, text, n_lines, pos) to lines that are no first occurrence, and what may go on over partitions.

    kind 0: a line to drop; 1: a line that is first unless its hash began in an earlier partition; 2: the last hash.
    """
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    last: tuple[int, int, int] | None = None  # hash and first document of the run that is open
    opening: tuple[int, int] | None = None
    names = ["kind", "part", "h1", "h2", "doc", "text", "n_lines", "pos"]
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, text, n, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        runs = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
        first = doc[runs]
        if last and (h1[0], h2[0]) == last[:2]:
            first[runs == 0] = last[2]
        if opening is None:
            opening = (h1[0], h2[0])
        drop = doc != first
        maybe = ~drop & (h1 == opening[0]) & (h2 == opening[1])
        at = np.flatnonzero(drop | maybe)
        if len(at):
            yield pa.record_batch([pa.array(np.where(maybe[at], 1, 0).astype(np.int32)), pa.array(np.full(len(at), part, np.int32)), *(pa.array(x[at]) for x in (h1, h2, doc, text, n, pos))], names)
        last = (h1[-1], h2[-1], first[-1])
    if last:
        yield pa.record_batch([pa.array([x], t) for x, t in zip((2, part, last[0], last[1], 0, 0, 0, 0), [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32()])], names)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, text, n_lines, dropped = (batch.column(k) for k in range(4))
        out, counts = [], []
        for n, positions in zip(n_lines.to_pylist(), dropped):
            keep = np.ones(n, bool)
            keep[positions.values.to_numpy()] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
            counts.append(int(n - keep.sum()))
        yield pa.record_batch([doc, text, n_lines, pa.array(counts, pa.int32()), pa.array(out, pa.binary())], ["_tm_doc", "_tm_text", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """For each document that loses lines: _tm_doc, _tm_text, n_lines, n_dropped, keep (zlib of packed bits, first line first)."""
    own = _identity(docs.select("doc_id", "text")).withColumn("lines", lines_of(F.col("text")))
    lines = own.select("_tm_doc", "_tm_text", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("_tm_doc", "_tm_text", "n_lines", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    h1, h2 = hash128(F.col("key"))
    hashed = keys.select(h1.alias("h1"), h2.alias("h2"), "_tm_doc", "_tm_text", "n_lines", "pos")
    order = ["h1", "h2", "_tm_doc", "_tm_text", "pos"]
    hashed = materialize(hashed, "hashes")  # the ranges are cut on a sample of them, which would split all texts once more
    ranged = hashed.repartitionByRange("h1", "h2", "_tm_doc").sortWithinPartitions(*order)
    found = materialize(ranged.mapInArrow(_stream, "kind int, part int, h1 long, h2 long, doc long, text long, n_lines int, pos int"), "lines")
    ends = found.filter("kind = 2").groupBy("h1", "h2").agg(F.min("part").alias("began"))
    maybe = found.filter("kind = 1").join(F.broadcast(ends), ["h1", "h2"]).filter(F.col("began") < F.col("part"))  # a row for each partition at most
    columns = ["doc", "text", "n_lines", "pos"]
    dropped = found.filter("kind = 0").select(*columns).unionByName(maybe.select(*columns))
    grouped = dropped.groupBy(F.col("doc").alias("_tm_doc"), F.col("text").alias("_tm_text")).agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return grouped.mapInArrow(_bitmaps, "_tm_doc long, _tm_text long, n_lines int, n_dropped int, keep binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8))[:n].astype(bool) for n, x in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(rows, pa.list_(pa.bool_()))], ["_tm_doc", "_tm_text", "_tm_dropped", "_tm_keep"])


def _applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs by plain names with the kept text, and behind them the numbers of lines and of dropped ones."""
    bitmaps = materialize(bitmaps, "bitmaps")
    size = bitmaps.agg(F.sum(F.octet_length("keep") + F.col("n_lines") + 64)).first()[0] or 0
    keep = bitmaps.mapInArrow(_unpacked, "_tm_doc long, _tm_text long, _tm_dropped int, _tm_keep array<boolean>")
    plain, names = with_plain_names(docs)
    text = names["text"]
    found = _identity(plain, names["doc_id"], text).join(F.broadcast(keep) if size <= BROADCAST_BYTES else keep, ["_tm_doc", "_tm_text"], "left")
    lines = lines_of(F.col(text))
    kept = F.array_join(F.filter(lines, lambda line, k: F.get(F.col("_tm_keep"), k)), "\n")
    columns = [F.when(F.col("_tm_keep").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in names.values()]
    return found.select(*columns, F.size(lines).alias("n_lines"), F.coalesce("_tm_dropped", F.lit(0)).alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of docs with the kept text, and `_tm_lines`, `_tm_dropped` behind them."""
    return _applied(docs, bitmaps).toDF(*docs.columns, "_tm_lines", "_tm_dropped")


def dedup_lines(docs: DataFrame, min_key: int = MIN_KEY, drop_emptied: bool = False) -> DataFrame:
    """The documents, all columns, without repeated lines; n_chars follows the text where there is such a column.

    drop_emptied: documents go that lost lines and of which only blanks are left.
    """
    names = with_plain_names(docs)[1]
    length = F.length(names["text"]).cast(dict(docs.dtypes).get("n_chars", "long"))
    out = _applied(docs, keep_bitmaps(docs, min_key))
    if drop_emptied:
        out = out.filter((F.col("n_dropped") == 0) | (F.btrim(names["text"], F.lit(BLANKS)) != ""))
    return out.select(*(length if name == "n_chars" else F.col(c) for name, c in names.items())).toDF(*docs.columns)
