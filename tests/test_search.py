"""Search by the stored index and nearest vectors by cells, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.operators import nearest as ne
from trustmill.operators import retrieval as rt
from trustmill.operators import search_index as si


def tokens_of(text):
    out = []
    for run in re.findall("[一-鿿]{2,}|[A-Za-z]{2,}|[0-9]{2,}", text or ""):
        out += [run] + ([run[k : k + 2] for k in range(len(run) - 1)] if len(run) >= 3 and re.fullmatch("[一-鿿]+", run) else [])
    return list(dict.fromkeys(t.lower() for t in out))


def brute(pages, query, embedding=None, top_k=3):
    out = []
    tokens = tokens_of(query)
    for title, path, number, text, vector in pages:
        if number is None:
            continue
        lowered = (text or "").lower()
        kw = min(1.0, sum(t in lowered for t in tokens) / len(tokens) + 0.15 * (query.strip().lower() in lowered)) if tokens else 0.0
        vec = 0.0
        if embedding and vector and len(embedding) == len(vector):
            norm = np.linalg.norm(embedding) * np.linalg.norm(vector)
            vec = max(0.0, float(np.dot(embedding, vector)) / norm) if norm else 0.0
        if kw > 0 or vec > 0:
            out.append((-round(0.7 * kw + 0.3 * vec, 8), -round(kw, 8), -round(vec, 8), path, number, title))
    return [(k + 1, x[3], x[4], x[5], -x[0]) for k, x in enumerate(sorted(out)[:top_k])]


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["利润", "增长", "净利润", "营收", "Alpha", "alphabet", "BETA", "2024", "20", "é", "x", "公司 ", "İstanbul"]
    text = lambda: "".join(r.choice(words) + r.choice(["", " ", "，"]) for _ in range(r.randint(0, 9)))
    vector = lambda: r.choice([None, [], [0.0, 0.0, 0.0], [1.0, 2.0], [r.gauss(0, 1) for _ in range(3)]])
    pages = [(f"t{k % 3}", f"/p{k % 40:02d}", None if k % 17 == 0 else k // 40 + 1, r.choice([text(), text(), None]), vector()) for k in range(n)]
    return pages, [(k, text() or "净利润增长", vector()) for k in range(25)] + [(90, "？", None), (91, "  利润 ", [0.5, -0.1, 0.2])]


@pytest.mark.parametrize(("block", "queries"), [(1024, 256), (8, 4)])
def test_index_equals_brute_force(spark, tmp_path, monkeypatch, block, queries):
    monkeypatch.setattr(si, "QUERIES", queries)
    pages, asked = corpus(block)
    df = spark.createDataFrame(pages, "title string, paper_path string, page_no int, text string, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id long, query string, embedding array<double>")
    plain = si.build(df.drop("embedding"), f"file://{tmp_path}/plain", block)
    for index, ask, use in ((plain, q.drop("embedding"), False), (si.build(df, f"file://{tmp_path}/both", block), q, True)):
        got = {}
        for x in si.search(spark, index, ask, 4).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.paper_path, x.page_no, x.title, x.score))
        want = {k: found for k, text, e in asked if (found := brute(pages, text, e if use else None, 4))}
        assert got.keys() == want.keys()
        for k, found in want.items():
            assert [x[:4] for x in sorted(got[k])] == [x[:4] for x in found]
            assert [x[4] for x in sorted(got[k])] == pytest.approx([x[4] for x in found], abs=2e-8)


def test_index_with_filters(spark, tmp_path):
    rows = [(f"t{k}", f"/{k:02d}", 1, "利润 增长" if k % 2 else "利润", "a" if k % 3 else "b") for k in range(30)]
    pages = spark.createDataFrame(rows, "title string, paper_path string, page_no int, text string, company string")
    index = si.build(pages, f"file://{tmp_path}/i", 4)
    asked = spark.createDataFrame([(1, "利润增长")], "query_id long, query string")
    got = [x.paper_path for x in si.search(spark, index, asked, 3, rt.EvidenceFilter(company="b")).orderBy("rank").collect()]
    assert got == ["/03", "/09", "/15"]
    assert si.search(spark, index, asked, 3, rt.EvidenceFilter(company="none")).count() == 0
    assert si.search(spark, index, asked.limit(0), 3).count() == 0
    assert si.search(spark, si.build(pages.limit(0), f"file://{tmp_path}/e"), asked, 3).count() == 0


def test_queries_are_one_scan_of_the_index(spark, tmp_path):
    """However many blocks of queries there are, postings are read once, and no query is collected."""
    pages = spark.createDataFrame([("t", f"/{k}", 1, f"word{'abc'[k % 3]} x{k}") for k in range(50)], "title string, paper_path string, page_no int, text string")
    index = si.build(pages, f"file://{tmp_path}/i", 8)
    asked = spark.range(3000).select(F.col("id").alias("query_id"), F.concat(F.lit("word"), F.substring(F.lit("abcabc"), (F.col("id") % 3 + 1).cast("int"), F.lit(1))).alias("query"))
    found = si.search(spark, index, asked, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("places#" in line and "FileScan" in line for line in plan.split("\n")) == 1
    assert found.count() == 6000


def test_rows_that_meet_have_no_null_lists(spark, tmp_path, monkeypatch):
    """For each row of a batch Spark fills the null lists of its column again, so a block's time grew with the square of its rows."""
    met, dealt = [], si.dealt
    monkeypatch.setattr(si, "dealt", lambda df, *keys: met.append(df) or dealt(df, *keys))
    pages, asked = corpus(3, 30)
    index = si.build(spark.createDataFrame(pages, "title string, paper_path string, page_no int, text string, embedding array<double>"), f"file://{tmp_path}/i", 8)
    si.search(spark, index, spark.createDataFrame(asked, "query_id long, query string, embedding array<double>"), 2)
    assert met and not [x.name for x in met[0].schema if x.dataType.typeName() == "array" and x.nullable]
    assert not met[0].filter("exists(members, m -> m.embedding IS NULL OR m.tokens IS NULL)").count()


@pytest.mark.parametrize("cut", [1, 5])
def test_blocks_and_packs_that_are_cut(spark, tmp_path, monkeypatch, cut):
    """A run that comes again in a block, and in another pack than its neighbours, is still found once for each page."""
    rows = [(k, "  ".join(["利润增长", "alphabet", "beta", "2024"][: k % 5])) for k in range(40)]
    batches = [si.pa.record_batch([si.pa.array([0] * 40), si.pa.array([k for k, _ in rows], si.pa.int32()), si.pa.array([t for _, t in rows])], ["block", "place", "text"])]
    monkeypatch.setattr(si, "INVERTED_AT_ONCE", cut)
    got = sorted((run, place) for b in si._inverted(batches) for run, places in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) for place in places)
    assert got == sorted((run, k) for k, t in rows for run in t.split())
    runs, tokens = ["alphabet", "beta", "gamma", "利润增长"], ["al", "be", "bet", "eta", "增长", "长", "zz", "a"]
    packs = [si.pa.record_batch([si.pa.array([runs[k : k + cut] for k in range(0, 4, cut)]), si.pa.array([7] * -(-4 // cut), si.pa.int32()), si.pa.array([tokens] * -(-4 // cut))], ["runs", "part", "known"])]
    held = {run: [tokens[n] for n in ns] for b in si._held(packs) for run, ns in zip(b.column(0).to_pylist(), b.column(2).to_pylist())}
    assert held == {run: [t for t in tokens if t in run] for run in runs}


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_nearest_equals_the_full_comparison(spark, monkeypatch, kind):
    monkeypatch.setattr(ne, "BLOCK", 64)
    r = np.random.default_rng(5)
    centers = r.normal(0, 1, (12, 16))
    x = centers[r.integers(0, 12, 900)] + r.normal(0, 0.05, (900, 16)) if kind == "clustered" else r.normal(0, 1, (900, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[0].tolist()) for k in range(4)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, 1.0]), (2004, [float("nan")] * 16)]
    asked = [(k, x[k * 7].tolist()) for k in range(40)] + [(90, [2.0, 0.1]), (91, None), (92, [3.0] * 5), (93, (-x[3]).tolist())]
    hits, work = ne.nearest(spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5)
    got = {}
    for h in hits.collect():
        got.setdefault(h.query_id, []).append((h.rank, h.id, h.score))
    for q, e in asked:
        want = []
        for i, v in rows:
            if e and v and len(e) == len(v) and np.any(v) and not np.isnan(v).any():
                c = float(np.dot(e, v) / np.linalg.norm(e) / np.linalg.norm(v))
                want += [(-round(c, 8), i)] if c > 0 else []
        want = sorted(want)[:5]
        assert [(i, s) for _, i, s in sorted(got.get(q, []))] == [(i, pytest.approx(-s, abs=2e-8)) for s, i in want], q
    compared, every = work.first()
    assert compared <= every and (kind == "random" or compared < 0.6 * every)


def test_nearest_of_empty_tables(spark):
    schema = "embedding array<double>"
    none, one = spark.createDataFrame([], "id long, " + schema), spark.createDataFrame([(1, [1.0, 2.0])], "id long, " + schema)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, " + schema)
    assert ne.nearest(none, asked)[0].count() == 0
    assert ne.nearest(one, asked.limit(0))[0].count() == 0
    assert [tuple(x) for x in ne.nearest(one, asked)[0].collect()] == [(1, 1, 1, 1.0)]
