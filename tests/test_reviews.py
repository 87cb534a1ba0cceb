"""Reviews: versions, cells with several facts, chains of corrections."""

import hashlib
import random
from decimal import Decimal

from pyspark.sql import functions as F

from trustmill.operators import reviews as rv


def test_reviews_fold(spark):
    facts = spark.createDataFrame([("a", Decimal(5), "NEEDS_REVIEW", 1), ("b", Decimal(6), "NEEDS_REVIEW", 1), ("c", Decimal(7), "NEEDS_REVIEW", 1)], "fact_key string, normalized_value decimal(24,4), validation_status string, review_version int")
    log = spark.createDataFrame([("a", 1, 1, "VALIDATE", None), ("a", 2, 2, "REJECT", None), ("b", 1, 3, "CORRECT", Decimal(60)), ("b", 1, 4, "REJECT", None), ("c", 9, 5, "VALIDATE", None)], "fact_key string, expected_version int, seq long, action string, new_value decimal(24,4)")
    folded, conflicts = rv.fold_reviews(facts, log)
    got = sorted((r.normalized_value, r.validation_status, r.review_version) for r in folded.collect())
    assert got == [(5, "REJECTED", 3), (6, "REJECTED", 2), (7, "NEEDS_REVIEW", 1), (60, "VALIDATED", 1)]
    assert sorted(r.seq for r in conflicts.collect()) == [4, 5]


def test_reviews_count_by_the_version_at_their_arrival(spark):
    facts = spark.createDataFrame([(k, source, page, Decimal(5), "NEEDS_REVIEW", v) for k, source, page, v in (("stale", "s", 1, 3), ("early", "s", 1, 1), ("old", "gone", 1, 1), ("page", "s", 9, 1))], "fact_key string, source_key string, page_no int, normalized_value decimal(24,4), validation_status string, review_version int")
    log = [("stale", 2, 1, "REJECT"), ("stale", 3, 2, "VALIDATE"), ("early", 2, 1, "REJECT"), ("early", 1, 2, "VALIDATE"), ("old", 1, 1, "VALIDATE"), ("page", 1, 1, "VALIDATE"), ("page", 1, 2, "REJECT"), ("unknown", 1, 1, "REJECT")]
    events = spark.createDataFrame([(*x, None) for x in log], "fact_key string, expected_version int, seq long, action string, new_value decimal(24,4)")
    current = spark.createDataFrame([("s",)], "source_key string")
    documents = spark.createDataFrame([("s", 4)], "source_key string, page_count int")
    folded, conflicts = rv.fold_reviews(facts, events, current, documents)
    assert {r.fact_key: (r.validation_status, r.review_version) for r in folded.collect()} == {"stale": ("VALIDATED", 4), "early": ("VALIDATED", 2), "old": ("NEEDS_REVIEW", 1), "page": ("REJECTED", 2)}
    assert sorted((r.fact_key, r.seq) for r in conflicts.collect()) == [("early", 1), ("old", 1), ("page", 1), ("stale", 1), ("unknown", 1)]


FACTS = "fact_key string, stock_code string, period string, statement_scope string, period_type string, metric string, source_key string, page_no int, normalized_value decimal(24,4), validation_status string, review_version int"
EVENTS = "fact_key string, expected_version int, seq long, action string, new_value decimal(24,4)"


def key(parent, seq):
    return hashlib.sha256("\x1f".join((parent, "correction", str(seq))).encode()).hexdigest()


def fact(k, cell, status="NEEDS_REVIEW", source="s", value=5, version=1):
    return (k, "600080", "2024FY", "consolidated", "duration", cell, source, 1, Decimal(value), status, version)


def fold(spark, facts, events):
    folded, conflicts = rv.fold_reviews(spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS), spark.createDataFrame([("s",), ("t",)], "source_key string"))
    return {r.fact_key: (r.validation_status, r.review_version, int(r.normalized_value)) for r in folded.collect()}, sorted((r.seq, r.reason) for r in conflicts.collect())


def test_one_validated_fact_for_a_cell(spark):
    facts = [fact("a", "m"), fact("b", "m", source="t"), fact("old", "m", "VALIDATED", "gone"), fact("other", "n", "VALIDATED")]
    events = [("a", 1, 1, "VALIDATE", None), ("b", 1, 2, "VALIDATE", None), ("b", 1, 3, "CORRECT", Decimal(9)), ("a", 2, 4, "REJECT", None), ("b", 1, 5, "VALIDATE", None), ("old", 1, 6, "REJECT", None)]
    got, conflicts = fold(spark, facts, events)
    assert got == {"a": ("REJECTED", 3, 5), "b": ("VALIDATED", 2, 5), "old": ("VALIDATED", 1, 5), "other": ("VALIDATED", 1, 5)}
    assert conflicts == [(2, rv.REASONS[4]), (3, rv.REASONS[4]), (6, rv.REASONS[1])]


def test_corrections_of_corrections(spark):
    one, two = key("a", 1), key(key("a", 1), 3)
    events = [("a", 1, 1, "CORRECT", Decimal(10)), ("a", 2, 2, "VALIDATE", None), (one, 1, 3, "CORRECT", Decimal(20)), (two, 1, 4, "REJECT", None), (two, 2, 5, "VALIDATE", None), (one, 1, 6, "REJECT", None), (key("a", 9), 1, 7, "REJECT", None)]
    got, conflicts = fold(spark, [fact("a", "m")], events)
    assert got == {"a": ("REJECTED", 2, 5), one: ("REJECTED", 2, 10), two: ("VALIDATED", 3, 20)}
    assert conflicts == [(2, rv.REASONS[4]), (6, rv.REASONS[2]), (7, rv.REASONS[0])]


def test_random_logs_against_plain_python(spark):
    r = random.Random(12)
    facts = [fact(f"f{k}", f"m{k % 6}", r.choice(["NEEDS_REVIEW", "VALIDATED", "REJECTED"]), r.choice(["s", "s", "t", "gone"]), k) for k in range(20)]
    keys = [f[0] for f in facts]
    events = []
    for seq in range(150):
        k = r.choice(keys)
        action = r.choice(["VALIDATE", "REJECT", "CORRECT", "DROP"] if seq % 9 == 0 else ["VALIDATE", "REJECT", "CORRECT"])
        events.append((k, r.choice([1, 1, 2, 3]), seq, action, Decimal(seq)))
        if action == "CORRECT":
            keys.append(key(k, seq))
    state = {f[0]: [f[9], f[10], int(f[8]), f[5], f[6] != "gone"] for f in facts}
    refused = []
    for k, expected, seq, action, value in events:
        f = state.get(k)
        others = f and any(g[0] == "VALIDATED" and g[3] == f[3] and g[4] for j, g in state.items() if j != k)
        if f is None or not f[4] or f[1] != expected or action == "DROP" or action != "REJECT" and others:
            refused.append(seq)
            continue
        f[:2] = ["VALIDATED" if action == "VALIDATE" else "REJECTED", expected + 1]
        if action == "CORRECT":
            state[key(k, seq)] = ["VALIDATED", 1, int(value), f[3], True]
    got, conflicts = fold(spark, facts, events)
    assert got == {k: (f[0], f[1], f[2]) for k, f in state.items()}
    assert [seq for seq, _ in conflicts] == refused


def test_no_events(spark):
    facts = spark.createDataFrame([fact("a", "m")], FACTS)
    folded, conflicts = rv.fold_reviews(facts, spark.createDataFrame([], EVENTS))
    assert folded.collect() == facts.collect() and conflicts.count() == 0


def test_log_is_stored_lean(spark, monkeypatch):
    """Events without effect leave the fold, others don't; only events of facts that corrections made go back along the log."""
    made = []
    monkeypatch.setattr(rv, "stored", lambda df, name: made.append((name, kept := spark.createDataFrame(df.collect(), df.schema))) or kept)
    key = lambda k, seq: hashlib.sha256("\x1f".join((k, "correction", str(seq))).encode()).hexdigest()
    facts = spark.createDataFrame([(f"f{k}", "NEEDS_REVIEW", 1, 1.0) for k in range(4)], "fact_key string, validation_status string, review_version int, normalized_value double")
    rows = [("f0", 1, 1, "VALIDATE", None), ("f1", 1, 1, "CORRECT", 2.0), (key("f1", 1), 1, 2, "CORRECT", 3.0), (key(key("f1", 1), 2), 1, 3, "REJECT", None), ("f2", 9, 1, "REJECT", None), ("none", 1, 1, "REJECT", None), (key("none", 1), 1, 2, "REJECT", None)]
    log = spark.createDataFrame(rows, "fact_key string, expected_version int, seq int, action string, new_value double")
    after, conflicts = rv.fold_reviews(facts, log)
    assert {r.fact_key: (r.validation_status, r.review_version) for r in after.collect()} == {"f0": ("VALIDATED", 2), "f1": ("REJECTED", 2), "f2": ("NEEDS_REVIEW", 1), "f3": ("NEEDS_REVIEW", 1), key("f1", 1): ("REJECTED", 2), key(key("f1", 1), 2): ("REJECTED", 2)}
    assert {(r.fact_key, r.reason) for r in conflicts.collect()} == {("f2", "another version"), ("none", "unknown fact"), (key("none", 1), "unknown fact")}
    assert [df.count() for name, df in made if name == "rooted"] == [4, 1]
    assert [(r.event is None, r.reason is None) for name, df in made if name == "folded" for r in df.filter("what = 'event'").collect()] == [(False, False)]


def test_a_log_that_tells_cells_moves_once(spark, monkeypatch):
    """Nothing is stored and nothing joined with the log; the results are those of the same log without cells, in batches of any size."""
    r = random.Random(5)
    names = [f"f{k}" for k in range(20)] + ["x" * 32, "y" * 32, "ab" * 32, "AB" * 32, "zz" * 32, ""]
    facts = [fact(n, f"m{k % 6}", r.choice(["NEEDS_REVIEW", "VALIDATED", "REJECTED"]), r.choice(["s", "s", "t", "gone"]), k) for k, n in enumerate(names)]
    keys, events = [(f[0], f[5]) for f in facts], []
    for at in range(400):
        k, metric = r.choice(keys)
        action = r.choice(["VALIDATE", "REJECT", "CORRECT", "DROP"] if at % 9 == 0 else ["VALIDATE", "REJECT", "CORRECT"])
        events.append((k, r.choice([1, 1, 2, 3]), at // 3, action, Decimal(at), metric))
        if action == "CORRECT":
            keys.append((key(k, at // 3), metric))
    events.append(("none", 1, 1, "REJECT", None, "m0"))
    table, log = spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS + ", metric string")
    log = log.selectExpr("*", "'600080' AS stock_code", "'2024FY' AS period", "'consolidated' AS statement_scope", "'duration' AS period_type")
    current = spark.createDataFrame([("s",), ("t",)], "source_key string")
    rows = lambda dfs: [sorted(map(repr, df.collect())) for df in dfs]
    want = rows(rv.fold_reviews(table, log.drop(*rv.CELL), current))
    monkeypatch.setattr(rv, "stored", None)
    for size in ("10000", "7", "1"):
        monkeypatch.setattr(rv, "TASK_ROWS", int(size))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = rv.fold_reviews(table, log, current)
            assert rows(got) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1  # the join with current alone
    lean = rv.fold_reviews(table, log, current, keep=["fact_key", "validation_status"])[0]
    assert lean.columns == ["fact_key", "validation_status"] and lean.count() == len(want[0])


def test_events_of_one_seq_come_in_the_order_of_keys(spark):
    a, b = "00" * 31 + "0a", "00" * 31 + "0b"
    got, conflicts = fold(spark, [fact(b, "m"), fact(a, "m", source="t")], [(b, 1, 1, "VALIDATE", None), (a, 1, 1, "VALIDATE", None)])
    assert got == {a: ("VALIDATED", 2, 5), b: ("NEEDS_REVIEW", 1, 5)} and conflicts == [(1, rv.REASONS[4])]


def test_short_keys_tell_keys_apart(spark):
    keys = ["", "a", "x" * 32, "x" * 33, "ab" * 32, "AB" * 32, "g" * 64, "ab" * 16, "é" * 16, "\x00" * 32, key("a", 1), None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", rv.short(F.col("k")).alias("s")).select("k", "s", rv.plain(F.col("s")).alias("p")).collect()
    assert all(r.k == r.p for r in rows) and len({bytes(r.s) for r in rows if r.s is not None}) == len(keys) - 1
    assert len(next(r.s for r in rows if r.k == "ab" * 32)) == 32


def test_rows_of_one_key_multiply_no_events(spark, monkeypatch):
    made = []
    monkeypatch.setattr(rv, "stored", lambda df, name: made.append((name, kept := spark.createDataFrame(df.collect(), df.schema))) or kept)
    facts, events = spark.createDataFrame([fact("a", "m")] * 30, FACTS), spark.createDataFrame([("a", 1, k, "REJECT", None) for k in range(30)], EVENTS)
    after, conflicts = rv.fold_reviews(facts, events)
    assert [(r.validation_status, r.review_version) for r in after.collect()] == [("REJECTED", 2)] * 30 and conflicts.count() == 29
    assert [df.count() for name, df in made if name == "placed"] == [30]


def test_a_short_log_leaves_other_facts_out(spark):
    facts = [fact(f"f{k}", f"m{k}") for k in range(40)]
    got, conflicts = fold(spark, facts, [("f3", 1, 1, "CORRECT", Decimal(9)), ("f4", 1, 2, "VALIDATE", None), ("f4", 1, 3, "REJECT", None)])
    want = {f[0]: ("NEEDS_REVIEW", 1, 5) for f in facts} | {"f3": ("REJECTED", 2, 5), key("f3", 1): ("VALIDATED", 1, 9), "f4": ("VALIDATED", 2, 5)}
    assert got == want and conflicts == [(3, rv.REASONS[2])]
