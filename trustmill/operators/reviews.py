"""Reviews of facts as a fold of their log, cell by cell: what one fact's review may do depends on the cell's other facts.

A cell is a company's metric of one period, scope and kind; it may hold several facts, of which one at most is to be
validated. Facts and events of a cell stream by once, in the order of arrival, and the facts leave as the events have made them,
so that none is joined to its result; only the cell's facts are held. Corrections make new facts, which later events can name by
the key that the correction gives them.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustmill.functions.text import key_of
from trustmill.sources.folders import stored

CELL = ["stock_code", "period", "statement_scope", "period_type", "metric"]
#: Why an event has no effect, in the order in which it is told.
REASONS = ("unknown fact", "source is not current", "another version", "page is not in the document", "the cell has another validated fact", "unknown action")

#: Facts for an event from which on the fold leaves out the facts that no event touches.
FEW = 4
#: Facts and events for a task of the fold, which sorts them in memory.
TASK_ROWS = 1 << 20


def corrected_key(fact_key: Column, seq: Column) -> Column:
    """The key of the fact that a correction makes."""
    return key_of(fact_key, F.lit("correction"), seq)


def short(key: Column) -> Column:
    """A key as bytes: 64 hexadecimal digits as the 32 bytes that they tell, in the same order, and no other key as 32 bytes."""
    told, plain = F.unhex(key), key.cast("binary")
    return F.when((F.octet_length(key) == 64) & (F.lower(key) == key) & told.isNotNull(), told).when(F.octet_length(key) == 32, F.concat(plain, F.unhex(F.lit("FF")))).otherwise(plain)


def plain(key: Column) -> Column:
    """The key that `short` made the bytes of; no text ends in the byte FF."""
    marked = (F.octet_length(key) == 33) & (F.substring(key, 33, 1) == F.unhex(F.lit("FF")))
    return F.when(F.octet_length(key) == 32, F.lower(F.hex(key))).when(marked, F.substring(key, 1, 32).cast("string")).otherwise(key.cast("string"))


def _corrected(key: bytes, mark: Any) -> bytes:
    """`corrected_key`, from a short key to a short one."""
    text = key.hex().encode() if len(key) == 32 else key.removesuffix(b"\xff")
    return hashlib.sha256(b"\x1f".join((text, b"correction", b"" if mark is None else str(mark).encode()))).digest()


class Fact:
    """A fact's status, version, whether its source is current and the page is there, and the numbers of its rows; of a made one, those of the first fact."""

    __slots__ = ("on_page", "open", "rows", "status", "touched", "value", "version")

    def __init__(self, status: str, version: int, open_: bool, on_page: bool, rows: list[int], value: Any = None) -> None:
        self.status, self.version, self.open, self.on_page, self.rows, self.value, self.touched = status, version, open_, on_page, rows, value, False


class Cell:
    """The facts of a cell, those that corrections made among them, and how many with a current source are validated."""

    def __init__(self) -> None:
        self.facts: dict[bytes, Fact] = {}
        self.made: dict[bytes, Fact] = {}
        self.validated = 0

    def add(self, key: bytes, fact: Fact) -> None:
        old = self.facts.get(key)
        if old is not None:
            self.validated -= old.open and old.status == "VALIDATED"
        self.validated += fact.open and fact.status == "VALIDATED"
        self.facts[key] = fact

    def take(self, key: bytes, expected: int, action: str) -> str | None:
        """Applies an event; why not, if not."""
        fact = self.facts.get(key)
        if fact is None or key is None:
            return REASONS[0]
        if not fact.open:
            return REASONS[1]
        if expected is None or fact.version != expected:
            return REASONS[2]
        if action not in ("VALIDATE", "REJECT", "CORRECT"):
            return REASONS[5]
        own = fact.status == "VALIDATED"
        if action != "REJECT":
            if not fact.on_page:
                return REASONS[3]
            if self.validated > own:
                return REASONS[4]
        fact.status = "VALIDATED" if action == "VALIDATE" else "REJECTED"
        fact.version, fact.touched = expected + 1, True
        self.validated += (action == "VALIDATE") - own
        return None

    def correct(self, key: bytes, new_key: bytes, value: Any) -> None:
        """Adds the fact that a correction makes."""
        fact = self.facts[key]
        self.made[new_key] = made = Fact("VALIDATED", 1, fact.open, fact.on_page, fact.rows[:1], value)
        self.add(new_key, made)


def _bytes(array: pa.Array) -> list[bytes | None]:
    if array.null_count or array.type != pa.binary() or not len(array):
        return array.to_pylist()
    ends, data = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].tolist(), array.buffers()[2]
    begin = ends[0]
    held = data.slice(begin, ends[-1] - begin).to_pybytes() if data else b""
    return [held[a - begin : b - begin] for a, b in itertools.pairwise(ends)]


def _few(array: pa.Array) -> list[str | None]:
    """Texts of which there are few different ones."""
    coded = array.dictionary_encode(null_encoding="encode")
    texts = coded.dictionary.to_pylist()
    return [texts[k] for k in coded.indices.to_numpy().tolist()]


def _whole(array: pa.Array) -> list[int | None]:
    return array.to_pylist() if array.null_count else array.to_numpy().tolist()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
    """The runs of a cell's rows: cell, begin, begin of its events, end."""
    n, cells = batch.num_rows, _bytes(batch.column("cell"))
    asked = np.concatenate([[0], np.cumsum(batch.column("event").is_valid().to_numpy(zero_copy_only=False))]).tolist()
    begins = [i for i in range(n) if not i or cells[i] != cells[i - 1]]
    for a, b in itertools.pairwise([*begins, n]):
        yield cells[a], a, b - (asked[b] - asked[a]), b


def _folded(rows: DataFrame, tasks: int) -> DataFrame:
    """Facts as events have made them, made ones, and events without effect and why, from (cell, key, event, ...): facts have no event.

    With a column `row`, all facts and made ones leave with the (first) fact's row; with `said`, the events without effect.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    mark, extra = "mark" if "mark" in kinds else "seq", [n for n in ("row", "said") if n in kinds]
    schema = T.StructType.fromDDL("what string, event long, reason string, key binary, status string, version long")
    for name in ("value", *extra):
        schema.add(name, kinds[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: bytes | None = None
        cell = Cell()
        # facts that haven't left yet, from the number `first` on; `begun` is that of the cell's first one
        first = begun = 0
        keys, statuses, versions, held, made = [], [], [], [], []

        def leave() -> None:
            for key, fact in cell.facts.items():
                if fact.touched and key not in cell.made:
                    for at in fact.rows:
                        statuses[at - first], versions[at - first] = fact.status, fact.version
            if cell.made:
                made.extend((f.rows[0] - first, k, f.status, f.version, f.value) for k, f in cell.made.items())

        def ready(n: int, types: dict[str, pa.DataType], **columns: pa.Array | list) -> pa.RecordBatch:
            arrays = [columns.get(name, pa.nulls(n, types[name])) for name in schema.names]
            return pa.record_batch([a if isinstance(a, pa.Array) else pa.array(a, types[name]) for a, name in zip(arrays, schema.names, strict=True)], schema.names)

        def facts(end: int, types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
            """The facts below a number, and what was made of them."""
            nonlocal first
            n = end - first
            if n and "row" in extra:
                table = pa.concat_arrays(held)
                held[:] = [table.slice(n)]
                yield ready(n, types, what=["fact"] * n, key=keys[:n], status=statuses[:n], version=versions[:n], row=table.slice(0, n))
                if made:
                    at, key, status, version, value = map(list, zip(*made, strict=True))
                    yield ready(len(made), types, what=["made"] * len(made), key=key, status=status, version=version, value=value, row=table.take(pa.array(at, pa.int64())))
            made.clear()
            for kept in (keys, statuses, versions):
                del kept[:n]
            first = end

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = {n: batch.schema.field(n).type for n in schema.names if n in batch.schema.names} | {"what": pa.string(), "reason": pa.string()}
            event, values, marks = batch.column("event"), batch.column("value"), batch.column(mark)
            if "row" in extra:
                held.append(batch.column("row").filter(event.is_null()))
            refused, reasons = [], []
            key, status, version = _bytes(batch.column("key")), _few(batch.column("status")), _whole(batch.column("version"))
            open_, on_page = (batch.column(n).fill_null(False).to_numpy(zero_copy_only=False).tolist() for n in ("open", "on_page"))
            for at, start, middle, end in _runs(batch):
                if at != now:
                    leave()
                    now, cell, begun = at, Cell(), first + len(keys)
                for i in range(start, middle):
                    fact, twin = Fact(status[i], version[i], open_[i], on_page[i], [first + len(keys)]), cell.facts.get(key[i])
                    if twin is not None:
                        twin.rows += fact.rows
                        fact.rows = twin.rows
                    cell.add(key[i], fact)
                    keys.append(key[i])
                    statuses.append(status[i])
                    versions.append(version[i])
                for i in range(middle, end):
                    reason = cell.take(key[i], version[i], status[i])
                    if reason is not None:
                        refused.append(i)
                        reasons.append(reason)
                    elif status[i] == "CORRECT":
                        cell.correct(key[i], _corrected(key[i], marks[i].as_py()), values[i].as_py())
            if refused and "said" in extra:
                some = batch.take(pa.array(refused, pa.int64()))
                yield ready(len(refused), types, what=["event"] * len(refused), event=some.column("event"), reason=reasons, key=some.column("key"), said=some.column("said"))
            yield from facts(begun, types)
        leave()
        yield from facts(first + len(keys), types)

    ordered = rows.repartition(tasks, "cell").sortWithinPartitions("cell", F.col("event").isNotNull(), "seq", "key", "version", "status", "value", "event")
    return ordered.mapInArrow(run, schema)


def _cell(columns: list[str]) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)), 1, 16)


def _placed(log: DataFrame, states: DataFrame) -> DataFrame:
    """The log (key, seq, action, ...) with an event number and cell, which is null for unknown facts; states: the facts' key and cell.

    An event of a fact of the table has that fact's cell. The others may name what a chain of corrections in the log made: only
    they go back along it, as many rounds as the longest chain has, until an event of a fact of the table is met.
    """
    states = states.groupBy("key").agg(F.min("cell").alias("cell"))  # a key of several rows multiplies no event
    log = stored(log.join(states, "key", "left").withColumn("event", F.monotonically_increasing_id()), "placed")
    parts, open_ = [log.filter("cell IS NOT NULL")], log.filter("cell IS NULL").drop("cell").withColumn("root", F.col("key"))
    # a made key tells the fact and its cell, so any of its events will do
    made = log.filter("action = 'CORRECT'").groupBy(short(corrected_key(plain(F.col("key")), F.col("seq"))).alias("root")).agg(F.min("key").alias("_parent"), F.min("cell").alias("cell"))
    while not open_.isEmpty():
        back = stored(open_.join(made, "root", "left").withColumn("root", F.col("_parent")).drop("_parent"), "rooted")
        parts.append(back.filter("cell IS NOT NULL OR root IS NULL").select(*log.columns))
        open_ = back.filter("cell IS NULL AND root IS NOT NULL").drop("cell")
    return functools.reduce(DataFrame.unionByName, parts)


def fold_reviews(facts: DataFrame, events: DataFrame, current: DataFrame | None = None, documents: DataFrame | None = None, source: tuple[str, ...] = ("source_key",), keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, conflicts) after a log of reviews (fact_key, expected_version, seq, action, new_value), in the order of seq.

    An event counts if it expects the version that the fact has when it arrives. VALIDATE and CORRECT don't count while another
    fact of the cell is validated; CORRECT rejects the fact and adds a corrected, validated one of version 1. With `current`
    (the columns of `source`), events of facts of other sources conflict, and their facts block no others; with `documents`
    (source_key, page_count), so do VALIDATE and CORRECT of a fact whose page the document lacks. conflicts: the events without
    effect, with a reason. Facts without the columns of a cell are each one of their own.

    A log may tell the cells of its facts by their columns: then it is neither joined with the facts nor stored, and both results
    are made when they are read. keep: the columns of facts to return; no others move.
    """
    columns = [c for c in CELL if c in facts.columns] or ["fact_key"]
    named = columns != ["fact_key"] and set(columns) <= set(events.columns)
    types, keep = dict(facts.dtypes), facts.columns if keep is None else keep
    known, is_open, on_page = facts, F.lit(True), F.lit(True)
    if current is not None:
        known = known.join(current.select(*source, F.lit(True).alias("_current")).distinct(), list(source), "left")
        is_open = F.col("_current").isNotNull()
    if documents is not None:
        known = known.join(documents.select("source_key", F.col("page_count").alias("_pages")), "source_key", "left")
        on_page = F.coalesce(F.col("page_no") <= F.col("_pages"), F.lit(True))
    own = [c for c in keep if c not in ("fact_key", "validation_status", "review_version")] or ["normalized_value"]
    states = known.select(_cell(columns).alias("cell"), short(F.col("fact_key")).alias("key"), F.col("validation_status").alias("status"), F.col("review_version").cast("long").alias("version"), is_open.alias("open"), on_page.alias("on_page"), F.struct(*own).alias("row"))

    log = events.select(*([_cell(columns).alias("cell")] if named else []), short(F.col("fact_key")).alias("key"), "expected_version", "seq", "action", "new_value")
    placed = log.withColumn("event", F.lit(0).cast("long")) if named else _placed(log, facts.select(short(F.col("fact_key")).alias("key"), _cell(columns).alias("cell")))
    corrects, same = F.col("action") == "CORRECT", dict(events.dtypes)["new_value"] == types["normalized_value"]
    value = F.col("new_value") if same else F.col("new_value").cast("string").cast(types["normalized_value"])
    said = F.struct("expected_version", "seq", "action", "new_value").alias("said")
    # a correction's seq as key_of reads it; whole numbers read the same in Python
    marks = [] if dict(events.dtypes)["seq"] in ("tinyint", "smallint", "int", "bigint") else [F.when(corrects, F.col("seq").cast("string")).alias("mark")]
    asked = (placed if named else placed.filter("cell IS NOT NULL")).select("cell", "key", "event", "seq", *marks, F.col("action").alias("status"), F.col("expected_version").cast("long").alias("version"), F.when(corrects, value).alias("value"), said)

    # of a short log, only the facts of cells that events touch are folded; beside a long one, to find them moves more than it saves
    asked_rows, known_rows, others = placed.count(), facts.count(), None
    if asked_rows * FEW < known_rows:
        touched = asked.select("cell").distinct()
        others, states, known_rows = states.join(touched, "cell", "left_anti"), states.join(touched, "cell", "left_semi"), asked_rows
    tasks = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(asked_rows + known_rows) // TASK_ROWS))

    def folded(*without: str) -> DataFrame:
        return _folded(states.unionByName(asked, allowMissingColumns=True).drop(*without), tasks)

    both = None if named else stored(folded(), "folded")
    after = (folded("said") if named else both).filter("what <> 'event'")
    refused = (folded("row") if named else both).filter("what = 'event'")
    if others is not None:
        after = after.select("what", "key", "status", "version", "value", "row").unionByName(others.select(F.lit("fact").alias("what"), "key", "status", "version", F.lit(None).cast(types["normalized_value"]).alias("value"), "row"))
    made = {"fact_key": plain(F.col("key")), "validation_status": F.col("status"), "review_version": F.col("version").cast(types["review_version"]), "normalized_value": F.when(F.col("what") == "made", F.col("value")).otherwise(F.col("row.normalized_value")) if "normalized_value" in own else None}
    conflicts = refused.select("key", "said", "reason")
    if not named:
        conflicts = conflicts.unionByName(placed.filter("cell IS NULL").select("key", said, F.lit(REASONS[0]).alias("reason")))
    return after.select(*(made.get(c, F.col("row").getField(c)).alias(c) for c in keep)), conflicts.select(plain(F.col("key")).alias("fact_key"), "said.*", "reason")
