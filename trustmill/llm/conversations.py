"""Conversation structure repair: the cheapest edits that make roles read `(s?(ua)+)?`, by divide and conquer.

Turns lead through four states: nothing yet, after a system, a user, an assistant turn. Keep costs 0, Rerole (to user or
assistant) 2, Delete 3 (required for blank and repeated turns), Insert 2; a truncated turn that stays adds 1. Of equally
cheap edits the least in ASCII order count. As in Hirschberg's method, a forward and a backward vector of four costs meet in
the middle of a run of turns; of the optimal crossings the one with the least edits before it is taken, and both halves
follow, so that no table of all turns and states is kept. To find that crossing, the forward vector also ranks the least
edits up to each state: all of them treat the same turns and end with the last one's own edit, so none begins another.

A conversation is cut into segments of at most `SEGMENT` turns. Those of longer ones become 4 x 4 matrices of costs and
ranks, which are composed by partition and then `FAN` at a time up to one for the conversation; the states at the borders
come down the same way, and each segment is then solved alone. So no conversation, however long, is ever in one task.

Defined results: turns go by number, nulls first, equal ones by the SHA-256 of role:text; a null text is blank, a role that is
null, empty or starts with another letter can't be kept; repeated rows are repeated turns; rows with a null conv_id make one
conversation; very long texts are only hashed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import materialize

SEGMENT, FAN = 4096, 256
#: Characters that a blank turn is made of.
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NO_WAY = 1 << 60
#: Code of a turn: the place of its initial (3: another one), and these.
MUST_GO, CUT = 4, 8
#: State after an inserted or re-roled turn, and after a kept one of an initial.
NEXT = (2, 2, 3, 2)
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})


def _steps(code: int) -> list[tuple[int, int, int, str]]:
    """(state before, after, cost, letters) of one turn, inserts before it included: the cheapest, then the least letters."""
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def put(p: int, q: int, cost: int, letters: str) -> None:
        found[p, q] = min(found.get((p, q), (NO_WAY, "")), (cost, letters))

    for p in range(4):
        at, cost, letters = p, 0, ""
        for _ in range(3):
            put(p, at, cost + DELETE, letters + "D")
            if not code & MUST_GO:
                stays = cost + (TRUNCATED if code & CUT else 0)
                if at in KEPT[code & 3]:
                    put(p, KEPT[code & 3][at], stays, letters + "K")
                put(p, NEXT[at], stays + REROLE, letters + "R")
            at, cost, letters = NEXT[at], cost + INSERT, letters + "I"
    return [(p, q, *x) for (p, q), x in sorted(found.items())]


STEPS = [_steps(code) for code in range(16)]
STEP = [{(p, q): (cost, letters) for p, q, cost, letters in steps} for steps in STEPS]
#: Cost and letters of what follows the last turn.
FINAL = ((0, ""), (4, "II"), (2, "I"), (0, ""))

Vector = list[tuple[int, int]]


def _ranked(best: list[tuple[int, int, object]]) -> Vector:
    order = {x: k for k, x in enumerate(sorted({b[1:] for b in best}))}
    return [(b[0], order[b[1:]]) for b in best]


def forward(codes: bytes, start: int) -> Vector:
    """For each state: the least cost from start, and the rank of the least edits of that cost."""
    now: Vector = [(NO_WAY, 0)] * 4
    now[start] = (0, 0)
    for code in codes:
        best = [(NO_WAY, 0, "")] * 4
        for p, q, cost, letters in STEPS[code]:
            c, rank = now[p]
            if c < NO_WAY:
                x = (c + cost, rank, letters)
                if x < best[q]:
                    best[q] = x
        now = _ranked(best)
    return now


def backward(codes: bytes, end: list[int]) -> list[int]:
    """For each state: the least cost from there to the end, given the costs of the states there."""
    for code in reversed(codes):
        now = [NO_WAY] * 4
        for p, q, cost, _ in STEPS[code]:
            now[p] = min(now[p], cost + end[q])
        end = now
    return end


def solve(codes: bytes, start: int, end: int) -> list[tuple[int, str]]:
    """(state before, letters) of each turn on the least of the cheapest ways from start to end."""
    if len(codes) == 1:
        return [(start, STEP[codes[0]][start, end][1])]
    middle = len(codes) // 2
    before, after = forward(codes[:middle], start), backward(codes[middle:], [0 if q == end else NO_WAY for q in range(4)])
    crossing = min(range(4), key=lambda q: (before[q][0] + after[q], before[q][1]))
    return solve(codes[:middle], start, crossing) + solve(codes[middle:], crossing, end)


def last_state(reached: Vector) -> int:
    """Where a conversation best ends."""
    return min(range(4), key=lambda q: (reached[q][0] + FINAL[q][0], reached[q][1]))


def made_roles(state: int, letters: str) -> tuple[str, int]:
    """For each letter the role that it makes: u, a, = (kept as it is) or - (none); and the cost without that of truncation."""
    out, cost = "", 0
    for x in letters:
        if x in "IR":
            out += "sua"[NEXT[state] - 1]
            state, cost = NEXT[state], cost + (INSERT if x == "I" else REROLE)
        else:
            out += "=" if x == "K" else "-"
            cost += DELETE if x == "D" else 0
    return out, cost


def matrix(codes: bytes) -> list[int]:
    """Costs and ranks from each state to each: 32 numbers."""
    return [x for p in range(4) for pair in forward(codes, p) for x in pair]


def compose(one: list[int], two: list[int]) -> list[int]:
    """The matrix of two runs of turns, one behind the other."""
    out = []
    for p in range(4):
        best = [min((one[8 * p + 2 * m] + two[8 * m + 2 * q], one[8 * p + 2 * m + 1], two[8 * m + 2 * q + 1]) for m in range(4)) for q in range(4)]
        out += [x for c, rank in _ranked(best) for x in (min(c, NO_WAY), rank)]
    return out


def crossings(matrices: list[list[int]], start: int, end: int) -> list[int]:
    """States before each of a row of runs, and behind the last, on the least of the cheapest ways."""
    behind = [[0 if q == end else NO_WAY for q in range(4)]]
    for m in reversed(matrices[1:]):
        behind.append([min(m[8 * p + 2 * q] + behind[-1][q] for q in range(4)) for p in range(4)])
    states = [start]
    for m, after in zip(matrices, reversed(behind)):
        p = states[-1]
        states.append(min(range(4), key=lambda q: (m[8 * p + 2 * q] + after[q], m[8 * p + 2 * q + 1])))
    return states


# ---------------------------------------------------------------- Spark


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns with pos (a number that rises with conversation, turn and tie), key (never null) and what repair looks at."""
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    kept, one = F.rtrim(text, F.lit(WHITE)), F.substring("role", 1, 1)
    x = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    x = x.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "*",
        F.sha2(F.concat(F.coalesce(role, F.lit("")), F.lit(":"), text), 256).alias("tie"),
        (kept == "").alias("blank"), (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(one == "s", 0).when(one == "u", 1).when(one == "a", 2).otherwise(3).alias("initial"),
    )
    x = x.withColumn("copy", F.monotonically_increasing_id())  # so that even equal rows can be dealt to several tasks
    x = x.repartitionByRange("key", "turn", "tie", "copy").sortWithinPartitions("key", "turn", "tie", "copy").drop("copy")
    return materialize(x.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _segments(turns: DataFrame) -> DataFrame:
    """Segments in order of (part, at): key, conv_id, codes and positions of the turns, and what is counted in them."""
    names = ["key", "part", "at", "positions", "codes", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high"]
    schema = "key string, part long, at long, positions array<long>, codes binary, blank long, duplicate long, truncated long, illegal long, first int, last int, turns long, low long, high long"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal number
            blank = sum(r[3] for r in rows)
            duplicate = sum(not r[3] and not r[6] for r in rows)
            truncated = sum(bool(r[4] and not r[3] and r[6]) for r in rows)
            codes = bytes(r[5] | (MUST_GO if r[3] or not r[6] else 0) | (CUT if r[4] else 0) for r in rows)
            illegal = sum((a[5], b[5]) not in LEGAL for a, b in zip(rows, rows[1:]))
            own = [r[2] for r in rows if r[2] is not None]
            out.append((rows[0][1], part, number, [r[0] for r in rows], codes, blank, duplicate, truncated, illegal, rows[0][5], rows[-1][5], len(set(own)), min(own, default=None), max(own, default=None)))
            number += 1
            rows.clear()

        def ready() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (rows[0][1] != row[1] or len(rows) >= SEGMENT):
                    close()
                rows.append(row)
            if out:
                yield ready()
        if rows:
            close()
            yield ready()

    first = turns.filter(~F.col("blank")).groupBy("key", "role", "tie").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    slim = turns.select("pos", "key", "turn", "blank", "cut", "initial").join(first, "pos", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    return materialize(slim.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(cut, schema), "segments")


LEGAL = {(0, 1), (1, 2), (2, 1)}


def _borders(segments: DataFrame) -> DataFrame:
    """key, part, at, start, end, final: the states around each segment of the conversations that have several."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [matrix(c) for c in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], ["key", "part", "at", "m"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for children in batch.column(2).to_pylist():
                m = children[0]["m"]
                for c in children[1:]:
                    m = compose(m, c["m"])
                made.append(m)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int64()))], ["key", "node", "m"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, node, start, end, final, children in zip(*(c.to_pylist() for c in batch.columns)):
                states = crossings([c["m"] for c in children], start, end)
                out += [(key, node, c["child"], states[k], states[k + 1], final and k + 1 == len(children)) for k, c in enumerate(children)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["key", "node", "child", "start", "end", "final"])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [last_state(list(zip(m[0:8:2], m[1:8:2]))) for m in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ends, pa.int32())], ["key", "end"])

    several = segments.groupBy("key").count().filter("count > 1").select("key")
    runs = segments.select("key", "part", "at", "codes").join(several, "key", "left_semi").mapInArrow(summed, "key string, part long, at long, m array<long>")
    nodes = materialize(runs.select("key", F.col("part").alias("node"), F.col("at").alias("child"), "m"), "runs")
    widest, families = nodes.agg(F.max("node")).first()[0] or 0, []
    while True:  # once by partition, then FAN partitions at a time: as many rounds as the number of partitions has digits to that base
        family = materialize(nodes.groupBy("key", "node").agg(F.array_sort(F.collect_list(F.struct("child", "m"))).alias("children")), "families")
        families.append(family)
        nodes = family.mapInArrow(composed, "key string, node long, m array<long>")
        if not widest:
            break
        nodes = nodes.select("key", F.floor(F.col("node") / FAN).alias("node"), F.col("node").alias("child"), "m")
        widest //= FAN
    states = nodes.select("key", "m").mapInArrow(ended, "key string, end int").select("key", F.lit(0).cast("long").alias("node"), F.lit(0).alias("start"), "end", F.lit(True).alias("final"))
    for k, family in enumerate(reversed(families)):
        found = states.join(family, ["key", "node"]).select("key", "node", "start", "end", "final", "children").mapInArrow(parted, "key string, node long, child long, start int, end int, final boolean")
        states = materialize(found if k + 1 == len(families) else found.select("key", F.col("child").alias("node"), "start", "end", "final"), "borders")
    return states.select("key", F.col("node").alias("part"), F.col("child").alias("at"), "start", "end", "final")


def _solved(segments: DataFrame) -> DataFrame:
    """Segments with edits (letters and roles of each turn), audit (all letters) and cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for codes, start, end, final in zip(*(batch.column(c).to_pylist() for c in ("codes", "start", "end", "final"))):
                start, final = start or 0, final is not False
                way = solve(codes, start, last_state(forward(codes, start)) if end is None else end)
                if final:
                    at = way[-1][0]
                    for x in way[-1][1]:
                        at = NEXT[at] if x in "IR" else at if x == "D" else KEPT[codes[-1] & 3][at]
                    way[-1] = (way[-1][0], way[-1][1] + FINAL[at][1])
                edits, cost = [], 0
                for (state, letters), code in zip(way, codes):
                    own = next(x for x in letters if x != "I")
                    head, tail = letters.split(own, 1)
                    roles, c = made_roles(state, head)
                    at = state
                    for _ in head:
                        at = NEXT[at]
                    mid, d = made_roles(at, own)
                    at = NEXT[at] if own == "R" else KEPT[code & 3][at] if own == "K" else at
                    rest, e = made_roles(at, tail)
                    edits.append({"letters": letters, "roles": roles + mid + rest})
                    cost += c + d + e + (TRUNCATED if code & CUT and own != "D" else 0)
                rows.append((edits, "".join(x["letters"] for x in edits), cost))
            kinds = [pa.list_(pa.struct([("letters", pa.string()), ("roles", pa.string())])), pa.string(), pa.int64()]
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [*kept, "edits", "audit", "cost"])

    kept = [c for c in segments.columns if c != "codes"]
    schema = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in kept) + ", edits array<struct<letters:string,roles:string>>, audit string, cost long"
    return materialize(segments.join(_borders(segments), ["key", "part", "at"], "left").mapInArrow(run, schema), "solved")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits and a report for each conversation.

    Edits: conv_id, pos, nth, edit (D, I, K or R), turn, role, text, in the order of (pos, nth); all but D make up the repaired
    conversation. Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; a conversation's first fault counts.
    """
    turns = _ordered(conversations)
    solved = _solved(_segments(turns))
    each = solved.select(F.explode(F.arrays_zip("positions", "edits")).alias("e")).select(F.col("e.positions").alias("pos"), F.col("e.edits.letters").alias("letters"), F.col("e.edits.roles").alias("roles"))
    one = turns.select("conv_id", "key", "pos", "turn", "role", "text").join(each, "pos").withColumn("nth", F.explode(F.sequence(F.lit(1), F.length("letters"))))
    letter = F.substring(F.col("letters"), F.col("nth"), F.lit(1))
    made = F.substring(F.col("roles"), F.col("nth"), F.lit(1))
    edits = one.select("conv_id", "pos", "nth", letter.alias("edit"), F.when(letter != "I", F.col("turn")).alias("turn"), F.when(made == "u", "user").when(made == "a", "assistant").otherwise(F.col("role")).alias("role"), F.when(letter == "I", "").otherwise(F.col("text")).alias("text"), "key")

    counts = ("blank", "duplicate", "truncated", "cost")
    parts = solved.groupBy("key").agg(*(F.sum(c).alias(c) for c in counts), F.array_sort(F.collect_list(F.struct("part", "at", "audit", "illegal", "first", "last", "turns", "low", "high"))).alias("parts"))
    legal = lambda a, b: F.array_contains(F.lit([10 * p + q for p, q in sorted(LEGAL)]), 10 * a.last + b.first)
    pairs = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.expr("slice(parts, 2, size(parts))"), lambda a, b: F.struct((~legal(a, b)).cast("long").alias("illegal"), F.coalesce((a.high == b.low).cast("long"), F.lit(0)).alias("same")))
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + f(x))
    span = F.array_max(F.transform("parts", lambda x: x.high)) - F.array_min(F.transform("parts", lambda x: x.low)) + 1
    report = parts.withColumn("pairs", pairs).select(
        "key", F.coalesce(span - total(F.col("parts"), lambda x: x.turns) + total(F.col("pairs"), lambda x: x.same), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
        (total(F.col("parts"), lambda x: x.illegal) + total(F.col("pairs"), lambda x: x.illegal)).alias("illegal"), "cost", F.array_join(F.transform("parts", lambda x: x.audit), "").alias("audit"),
    )
    ids = conversations.select("conv_id").distinct().withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    return edits, ids.join(report, "key")


def text_hashes(rows: DataFrame, key: Column, order: list[str], piece: Column) -> DataFrame:
    """key, sha256 of the pieces of each key, newline-joined in order.

    A hash of one long text is one sequence: a key's pieces stream through one task, of which none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(x.as_py().encode())
            yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["key", "sha256"])
        if state is not None:
            yield pa.record_batch([[now], [state.hexdigest()]], ["key", "sha256"])

    x = rows.select(key.alias("key"), *order, piece.alias("piece")).repartition("key").sortWithinPartitions("key", *order)
    return x.select("key", "piece").mapInArrow(run, "key string, sha256 string")
