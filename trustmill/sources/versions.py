"""Versioned tables: a folder for each version, and a numbered log entry for each commit, which only one writer can make.

A commit writes its folder, checks it, and then makes the entry behind the one it has read. If another writer has made that
entry meanwhile, the commit fails as a whole with `Conflict`, so no update is lost; `update` then starts again from what the
other one has left. Entries appear at once with their content: by a hard link on a local disk, elsewhere by a rename that
doesn't replace, which Hadoop file systems do in one step. A version never changes, so a reader that has begun stays with it.

A version may be bucketed: its entry tells the layout, and a reader's session gets an external table with it, so that tables of
one layout are joined on their bucket columns without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

LOG = "_log"
DIGITS = 12


class Buckets(NamedTuple):
    """How many files a version has in each partition, by the hash of which columns, and the order of rows in them."""

    number: int
    by: tuple[str, ...]
    sort: tuple[str, ...] = ()


class Conflict(RuntimeError):
    """Another writer has committed behind the version that this one has read."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def current(spark: SparkSession, root: str, number: int | None = None) -> dict[str, Any] | None:
    """The last log entry, or that of a number: number, version (a folder) and streams; None if there is none."""
    fs, p, _ = _fs(spark, f"{root}/{LOG}")
    if not fs.exists(p):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    numbers = [int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit()]
    number = max(numbers, default=None) if number is None else number
    if number not in numbers:
        return None
    stream = fs.open(_fs(spark, f"{root}/{LOG}/{number:0{DIGITS}d}.json")[1])
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text) | {"number": number}


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table as of its last version, or of an earlier one."""
    found = current(spark, root, number)
    if found is None:
        raise FileNotFoundError(f"{root} has no valid version")
    return _opened(spark, root, found)


def _table_name(path: str) -> str:
    return f"trustmill_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _opened(spark: SparkSession, root: str, entry: dict[str, Any]) -> DataFrame:
    path, layout = f"{root}/{entry['version']}", entry.get("layout")
    if not layout:
        return spark.read.parquet(path)
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        quoted = lambda columns: ", ".join(f"`{c}`" for c in columns)
        partitions = f"PARTITIONED BY ({quoted(layout['partition_by'])}) " if layout["partition_by"] else ""
        order = f"SORTED BY ({quoted(layout['sort'])}) " if layout["sort"] else ""
        spark.sql(f"CREATE TABLE {name} ({layout['schema']}) USING parquet {partitions}CLUSTERED BY ({quoted(layout['by'])}) {order}INTO {layout['number']} BUCKETS LOCATION '{path}'")
        if layout["partition_by"]:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


def _claimed(spark: SparkSession, root: str, number: int, entry: dict[str, Any]) -> bool:
    """Makes a log entry unless it is there."""
    fs, target, jvm = _fs(spark, f"{root}/{LOG}/{number:0{DIGITS}d}.json")
    fs.mkdirs(target.getParent())
    temporary = jvm.org.apache.hadoop.fs.Path(f"{root}/{LOG}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.hsync()
    out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(temporary))
        else:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            files.rename(temporary, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(temporary, False)
    return True


Violations = dict[str, DataFrame] | Callable[[DataFrame], dict[str, DataFrame]]


def commit(df: DataFrame, root: str, violations: Violations | None = None, partition_by: tuple[str, ...] = (), base: dict[str, Any] | None | str = "last", batch: tuple[str, int] | None = None, buckets: Buckets | None = None, dealt: bool = False) -> int:
    """Writes a version, checks it, and makes the log entry behind base: what `current` said when the work began, or the last one now.

    A failed check or a `Conflict` leaves nothing behind. batch: the stream and number of a micro-batch, kept in the entry.
    violations: queries that must be empty, or a function that makes them of the written version, so that df isn't computed again
    for them. dealt: df has a task for each bucket already.
    """
    spark = df.sparkSession
    last = current(spark, root)
    if base == "last":
        base = last
    elif last and (base is None or base["number"] < last["number"]):  # nothing is written in vain
        raise Conflict(f"{root} has a version {last['number']} by now")
    version = f"v-{uuid.uuid4().hex}"
    entry: dict[str, Any] = {"version": version}
    writer = (df if buckets is None or dealt else df.repartition(buckets.number, *buckets.by)).write.option("compression", "zstd")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if buckets is None:
        writer.parquet(f"{root}/{version}")
    else:  # a task holds one bucket, so a partition gets one file for each bucket at most
        writer = writer.bucketBy(buckets.number, *buckets.by)
        writer = writer.sortBy(*buckets.sort) if buckets.sort else writer
        writer.format("parquet").option("path", f"{root}/{version}").saveAsTable(_table_name(f"{root}/{version}"))
        entry["layout"] = buckets._asdict() | {"partition_by": partition_by, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
    try:
        if callable(violations):
            violations = violations(spark.read.schema(df.schema).parquet(f"{root}/{version}"))
        for name, bad in (violations or {}).items():
            if not bad.isEmpty():
                raise ValueError(f"violation: {name}")
        streams = dict((base or {}).get("streams", {})) | ({batch[0]: batch[1]} if batch else {})
        number = base["number"] + 1 if base else 0
        if not _claimed(spark, root, number, entry | {"streams": streams}):
            raise Conflict(f"{root} has a version {number} by now")
    except Exception:
        if buckets is not None:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(f'{root}/{version}')}")
        fs, p, _ = _fs(spark, f"{root}/{version}")
        fs.delete(p, True)
        raise
    return number


Build = Callable[[DataFrame | None], tuple[DataFrame, Violations]]


def update(spark: SparkSession, root: str, build: Build, partition_by: tuple[str, ...] = (), batch: tuple[str, int] | None = None, attempts: int = 10, buckets: Buckets | None = None) -> int | None:
    """Commits what build makes of the table (None if there is none yet) with its violations; again, from the newer version, after a `Conflict`.

    With a batch that the table already has, nothing is done and None returned: a micro-batch that is repeated counts once.
    """
    for _ in range(attempts):
        base = current(spark, root)
        if batch and base and base["streams"].get(batch[0], -1) >= batch[1]:
            return None
        df, violations = build(None if base is None else _opened(spark, root, base))
        try:
            return commit(df, root, violations, partition_by, base, batch, buckets)
        except Conflict:
            continue
    raise Conflict(f"{root}: {attempts} attempts were overtaken")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small result as one file: json, csv or parquet."""
    df.coalesce(1).write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)
