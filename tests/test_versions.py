"""Versioned tables with several writers, promotion between them, incremental ingestion that is killed and started again."""

import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trustmill.model import AMOUNT
from trustmill.plans.compiler import trusted_facts
from trustmill.sources import promotion, testdata, versions
from trustmill.streaming import ingest

FACT = f"fact_key string, stock_code string, period string, statement_scope string, period_type string, metric string, table_name string, normalized_value {AMOUNT.simpleString()}, source_key string, page_no int, row_label string, column_label string, confidence double, validation_status string, review_version int"


def fact(key, value, status, metric="net_profit", source="s"):
    return (key, "600080", "2024FY", "consolidated", "duration", metric, "income_sheet", Decimal(value), source, 1, "r", "c", 0.5, status, 1)


def test_an_older_base_conflicts_and_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, 1)], "k int, v int")
    assert versions.commit(df, root) == 0
    base = versions.current(spark, root)
    assert versions.commit(df.selectExpr("k", "v + 1 AS v"), root) == 1
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    with pytest.raises(versions.Conflict):
        versions.commit(df.selectExpr("k", "v + 9 AS v"), root, base=base)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before
    assert versions.read(spark, root).first().v == 2 and versions.read(spark, root, 0).first().v == 1
    assert not [p for p in (tmp_path / "t" / "_log").iterdir() if p.suffix == ".tmp"]


def test_writers_at_once_lose_no_update(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    versions.commit(spark.createDataFrame([(0,)], "v int"), root)
    errors = []

    def add(k):
        try:
            versions.update(spark, root, lambda old: (old.union(spark.createDataFrame([(k,)], "v int")).coalesce(1), {}), attempts=20)
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=add, args=(k,)) for k in range(1, 6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    assert sorted(r.v for r in versions.read(spark, root).collect()) == list(range(6))
    assert versions.current(spark, root)["number"] == 5


def test_two_promotions_from_one_base(spark, tmp_path):
    """The second one meets the first one's facts when it checks again, and is refused where they conflict."""
    root = f"file://{tmp_path}"
    sources = spark.createDataFrame([("s", "CURRENT", "600080", "2024FY", "CURRENT", "s.pdf")], "source_key string, authority_status string, stock_code string, period string, current_slot string, source_file string")
    versions.commit(sources, f"{root}/sources")
    versions.commit(spark.createDataFrame([fact("a", 1, "VALIDATED")], FACT), f"{root}/facts")
    versions.commit(spark.createDataFrame([fact("b", 2, "NEEDS_REVIEW", "total_profit")], FACT), f"{root}/one")
    tries = []

    class Rival:
        """Another promotion that gets in after the first attempt's checks."""

        def __init__(self, real):
            self.real = real

        def __call__(self, *args):
            tries.append(args[2])
            if len(tries) == 1:
                self.real(spark, f"{root}/facts", args[2], {"version": rival_version(), "streams": {}})
            return self.real(*args)

    def rival_version():
        versions.read(spark, f"{root}/facts").unionByName(spark.createDataFrame([fact("c", 3, "NEEDS_REVIEW", "asset_inventory")], FACT)).write.parquet(f"{root}/facts/v-rival")
        return "v-rival"

    real = versions._claimed
    versions._claimed = Rival(real)
    try:
        assert promotion.promote(spark, f"{root}/facts", f"{root}/one", f"{root}/sources") == 2
    finally:
        versions._claimed = real
    assert tries == [1, 2]
    assert sorted(r.fact_key for r in versions.read(spark, f"{root}/facts").collect()) == ["a", "b", "c"]
    # the source is superseded meanwhile: what was staged for it is refused at the authority's end
    versions.commit(sources.filter("false"), f"{root}/sources")
    with pytest.raises(ValueError, match="unknown_source"):
        promotion.promote(spark, f"{root}/facts", f"{root}/one", f"{root}/sources")
    with pytest.raises(ValueError, match="schema differs"):
        promotion.read_staging(spark, f"{root}/sources", spark.createDataFrame([], FACT))
    staged, number = promotion.read_staging(spark, f"{root}/one", spark.createDataFrame([], FACT))
    versions.commit(spark.createDataFrame([fact("z", 9, "NEEDS_REVIEW")], FACT), f"{root}/one")
    assert number == 0 and [r.fact_key for r in staged.collect()] == ["b"]


def sightings(spark):
    rows = [(k, f"f{k * k % 7}", "abc"[k * k % 5 % 3]) for k in range(60)]
    return spark.createDataFrame([(p, k, 1, 0, s, "c", 4) for k, p, s in rows], "path string, seq long, size int, mtime int, sha256 string, context string, extractor_version int")


def expected(df):
    state = {}
    for r in df.orderBy("seq").collect():
        sign = tuple(r[c] for c in ingest.SIGNATURE)
        old = state.get(r.path)
        same = old is not None and old[1] == sign
        state[r.path] = (r.seq, sign, (old[2] if old else 0) + (not same), (old[3] if old else 0) + same)
    return sorted((p, s[0], s[1][2], s[2], s[3]) for p, s in state.items())


def rows_of(df):
    return sorted((r.path, r.seq, r.sha256, r.changes, r.skipped) for r in df.collect())


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    """Batches of one file; the run dies behind a commit that its checkpoint hasn't seen, and starts again."""
    seen = sightings(spark)
    for k in range(6):
        seen.filter(F.col("seq") % 60 >= k * 10).filter(F.col("seq") < (k + 1) * 10).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    root = f"file://{tmp_path}/state"
    source = lambda: ingest.table_stream(spark, f"file://{tmp_path}/in", seen.schema, files_at_once=1)

    def die(number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ingest.run(source(), root, "in", f"file://{tmp_path}/cp", after=die)
    assert versions.current(spark, root)["streams"] == {"in": 2}
    ingest.run(source(), root, "in", f"file://{tmp_path}/cp")
    assert versions.current(spark, root)["streams"] == {"in": 5} and versions.current(spark, root)["number"] == 5
    assert rows_of(versions.read(spark, root)) == expected(seen)
    # without its checkpoint the stream begins anew: all its batches are there already
    ingest.run(source(), root, "in", f"file://{tmp_path}/cp2")
    assert versions.current(spark, root)["number"] == 5
    # another stream into the same table, with later and with late sightings
    more = spark.createDataFrame([("f0", 100, 1, 0, "z", "c", 4), ("f0", -1, 1, 0, "y", "c", 4), ("new", 101, 1, 0, None, "c", 4), ("new", 102, 1, 0, None, "c", 4)], seen.schema)
    more.write.parquet(f"file://{tmp_path}/more")
    ingest.run(ingest.table_stream(spark, f"file://{tmp_path}/more", seen.schema), root, "more", f"file://{tmp_path}/cp3")
    got = {r.path: (r.seq, r.sha256, r.changes, r.skipped) for r in versions.read(spark, root).collect()}
    assert got["f0"][:2] == (100, "z") and got["new"] == (102, None, 1, 1)
    assert versions.current(spark, root)["streams"] == {"in": 5, "more": 0}


def test_bucketed_facts_join_their_sources_without_a_shuffle(spark, tmp_path):
    """Facts of one year are several files; the trust join reads facts and sources bucket by bucket, in a new session too."""
    n, keys = 4, testdata.TRUST_KEY
    code = F.lpad((F.col("id") % 50).cast("string"), 6, "0")
    facts = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("source_key"), code.alias("stock_code"), F.lit("1999FY").alias("period"), F.when(F.col("id") % 50 == 0, 2000).otherwise(1999).alias("report_year"), F.concat(F.lit("m"), F.col("id") % 8).alias("metric"), F.lit("VALIDATED").alias("validation_status"), F.lit("consolidated").alias("statement_scope"), F.lit("duration").alias("period_type"), F.lit("income_sheet").alias("table_name"))
    sources = facts.select(*keys).withColumn("authority_status", F.when(F.expr("substring(source_key, 2) % 3 = 0"), "CURRENT").otherwise("OLD"))
    root = f"file://{tmp_path}"
    versions.commit(facts, f"{root}/f", partition_by=("report_year",), buckets=versions.Buckets(n, keys, ("metric",)))
    versions.commit(sources, f"{root}/s", buckets=versions.Buckets(n, keys))
    assert len(list(tmp_path.glob("f/v-*/report_year=1999/*.parquet"))) == n
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for session in (spark, spark.newSession()):
            session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            if session is not spark:  # as if another application had written them
                for x in ("f", "s"):
                    session.sql(f"DROP TABLE {versions._table_name(root + '/' + x + '/' + versions.current(session, root + '/' + x)['version'])}")
            trusted = trusted_facts(versions.read(session, f"{root}/f"), versions.read(session, f"{root}/s"))
            assert trusted.count() == 6667
            plan = trusted._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="odd"):
        versions.commit(facts, f"{root}/f", {"odd": facts}, buckets=versions.Buckets(n, keys))
    assert len(list(tmp_path.glob("f/v-*"))) == 1


def test_checks_read_what_is_written(spark, tmp_path):
    """A function of violations sees the written version, not the rows' recipe; what it finds leaves nothing behind."""
    seen = []

    def checks(written):
        seen.append(written.inputFiles())
        return {"too_large": written.filter("id > 5")}

    root = str(tmp_path / "t")
    assert versions.commit(spark.range(3), root, checks) == 0
    with pytest.raises(ValueError, match="too_large"):
        versions.commit(spark.range(9), root, checks)
    assert versions.read(spark, root).count() == 3 and all(root in f for files in seen for f in files) and seen[0]
