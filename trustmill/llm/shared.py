"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session (tests) may do with a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trustmill-")
        spark.sparkContext.setCheckpointDir(found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trustmill/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, made: list[str] | None = None, **options: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again; made gets its path.

    Unlike a checkpoint the table is columnar and compressed, so later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, made: list[str]) -> None:
    """Deletes materialized tables that nothing lazy refers to any more, and empties the list."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for x in made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x).getParent()
        path.getFileSystem(conf).delete(path, True)
    made.clear()


def with_plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., and the new name of each column: no name, with dots or like an operator's own, can clash.

    `toDF(*docs.columns)` brings the names back.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5DEECE66D), *cols)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_sha256(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ","), 256)


def looked_up(rows: DataFrame, keys: list[str], found: DataFrame, spread: Column, salts: int = 64) -> DataFrame:
    """rows left-joined with found, which has each key once, where a key may hold a large part of the rows.

    Rows are dealt to salts by `spread`; a row of found is copied only to the salts in which its key occurs, which is counted
    before the join and combined where rows are read, so a hot key is in `salts` tasks and a rare one costs nothing.
    """
    salted = rows.withColumn("_tm_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    places = salted.select(*keys, "_tm_salt").distinct().join(found, keys)
    return salted.join(places, [*keys, "_tm_salt"], "left").drop("_tm_salt")


def give_back() -> None:
    """Freed memory goes back to the system: Python workers stay for later tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
