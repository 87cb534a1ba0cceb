"""Layout, evidence, guard, golden sets and promotion."""

import hashlib
import json
from decimal import Decimal

import pytest

from trustmill.model import SpecError
from trustmill.operators import evidence as ed
from trustmill.plans import guard
from trustmill.sources import golden, promotion, versions


def test_reading_order(spark):
    boxes = [("d", 1, 0.5, 0.10, 0.6, 0.14, "b", 0.9), ("d", 1, 0.1, 0.11, 0.2, 0.15, "a", 0.9), ("d", 1, 0.1, 0.30, 0.2, 0.34, "c", 0.9), ("d", 1, 0.3, 0.3, 0.2, 0.34, "bad", 0.9), ("d", 1, 0.1, 0.5, 0.2, 0.6, "x", 1.5)]
    tokens = ed.reading_order(spark.createDataFrame(boxes, "doc string, page_no int, left double, top double, right double, bottom double, text string, confidence double"))
    assert [(r.row_no, r.token_no, r.text) for r in tokens.orderBy("token_no").collect()] == [(0, 1, "a"), (0, 2, "b"), (1, 3, "c")]
    assert ed.page_texts(tokens).first().text == "a b\nc"


def test_json_leaves(spark):
    text = json.dumps({"b": [1, {"a/x": None}], "a~": {}, "c": []})
    got = ed.json_leaves(spark.createDataFrame([(1, text), (2, None)], "k long, j string"), "j").select("pointer", "leaf").collect()
    assert [tuple(r) for r in got] == [("/a~0", "{}"), ("/b/0", "1"), ("/b/1/a~1x", "null"), ("/c", "[]")]


def test_open_evidence(spark):
    regions = spark.createDataFrame([("d", "r1", "净利润 1,200", 3)], "document_id string, region_id string, text string, page_no int")
    facts = [("ok", "d", "r1", "1,200", "净利润 1,200", 3), ("e", "d", "r1", "1,200", "净利润", 3), ("r", "d", "r9", "1,200", "1,200", 3), ("t", "d", "r1", "7", "7", 3), ("p", "d", "r1", "1,200", "1,200", 4)]
    got = ed.open_evidence(spark.createDataFrame(facts, "id string, document_id string, region_id string, raw_value string, evidence_text string, page_no int"), regions)
    assert {r.id: r.fault for r in got.collect()} == {"e": "value_not_in_evidence", "r": "unknown_region", "t": "value_not_in_region", "p": "other_page"}


def test_recomputed_plans(spark):
    c = spark.createDataFrame([("a", "(1,234.5)", "元", "万元", True), ("b", "5", "元", "万元", False), ("c", "5", "元", "吨", False), ("d", "5", "%", "%", False), ("e", "x", "%", "%", False)], "candidate_id string, raw_value string, source_unit string, target_unit string, negative boolean")
    p = spark.createDataFrame([("a", "CNY_YUAN_TO_WANYUAN_V1", "0.0001", "-1234.5"), ("b", "IDENTITY_CNY_YUAN_V1", "1", "5"), ("c", "x", "1", "5"), ("d", "IDENTITY_PERCENT_V1", "1", "6"), ("e", "IDENTITY_PERCENT_V1", "1", "6")], "candidate_id string, rule_id string, factor string, proposal string")
    got = {r.candidate_id: (r.normalized_value, r.fault) for r in ed.recomputed(c, p).collect()}
    assert got == {"a": (Decimal("-0.12345"), None), "b": (None, "other_rule"), "c": (None, "unknown_conversion"), "d": (None, "other_value"), "e": (None, "unreadable")}


@pytest.mark.parametrize("bad", ["SELECT * FROM f", "SELECT a FROM f; SELECT a FROM f", "SELECT a FROM f -- x", "SELECT a FROM g", "DROP TABLE f", "SELECT a FROM f WHERE a = 1", "SELECT a FROM (SELECT a FROM f) t", "WITH t AS (SELECT a FROM f) SELECT a FROM t", "SELECT a FROM f WHERE a IN (SELECT a FROM f)", "SELECT upper(a) FROM f", "INSERT INTO f VALUES (1)", "SELECT a FROM f UNION SELECT a FROM f"])
def test_guard_refuses(spark, bad):
    with pytest.raises(SpecError):
        guard.check(spark, bad, {"f"})


def test_guard_lets_plain_selects_through(spark):
    f = spark.createDataFrame([(1, "x"), (5, "y"), (7, "y")], "a long, b string")
    got = guard.run(spark, "SELECT b, sum(a) AS s FROM f WHERE a > :least GROUP BY b", {"f": f}, {"least": 2})
    assert [tuple(r) for r in got.collect()] == [("y", 12)]
    assert guard.audit_record("q", "OK", 1) == {"query_id": "q", "status": "OK", "row_count": 1, "error": None}


def test_golden_files(spark, tmp_path):
    place = {"source_file": "a.pdf", "page_no": 1}
    rows = [{"record_type": "financial_fact", "record_id": "g", "company_id": "c", "normalized_value": "1.50", "source": place}, {"record_type": "question_answer", "record_id": "q", "answer_type": "text", "expected_answer": "x"}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, rows)))
    path = f"file://{tmp_path}/g.jsonl"
    assert golden.golden_facts(spark, path).first().normalized_value == Decimal("1.5")
    assert golden.answers(spark, path).first().expected_answer == "x"
    assert golden.predicted_facts(spark, path).count() == 0
    base = {"schema_version": "1.1", "dataset_kind": "synthetic", "annotation_files": [], "tolerance": {}}
    assert golden.manifest(json.dumps(base)) == base
    for bad in ({**base, "dataset_kind": "real", "provenance": {"reviewers": ["a"], "status": "approved"}}, {"schema_version": 1}):
        with pytest.raises(ValueError):
            golden.manifest(json.dumps(bad))
    want = spark.createDataFrame([("g.jsonl", hashlib.sha256((tmp_path / "g.jsonl").read_bytes()).hexdigest()), ("x", "0")], "path string, sha256 string")
    assert [tuple(r) for r in golden.provenance_faults(spark, f"file://{tmp_path}", want).collect()] == [("x", "missing")]


def test_promotion(spark, tmp_path):
    root = f"file://{tmp_path}/facts"
    schema = "fact_key string, stock_code string, period string, statement_scope string, period_type string, metric string, table_name string, normalized_value decimal(24,4), source_key string, page_no int, row_label string, column_label string, confidence double, validation_status string"
    row = lambda key, value, status: (key, "1", "2024FY", "consolidated", "duration", key, "income_sheet", Decimal(value), "s", 1, "r", "c", 0.5, status)
    versions.commit(spark.createDataFrame([row("a", 1, "VALIDATED")], schema), root)
    sources = spark.createDataFrame([("s", "f", "1", "2024FY", "CURRENT", "CURRENT")], "source_key string, source_file string, stock_code string, period string, authority_status string, current_slot string")
    promotion.promote(spark, root, spark.createDataFrame([row("a", 2, "NEEDS_REVIEW"), row("b", 3, "NEEDS_REVIEW")], schema), sources)
    got = {r.fact_key: (int(r.normalized_value), r.validation_status) for r in versions.read(spark, root).collect()}
    assert got == {"a": (2, "VALIDATED"), "b": (3, "NEEDS_REVIEW")}
    with pytest.raises(ValueError, match="staged_without_review"):
        promotion.promote(spark, root, spark.createDataFrame([row("c", 2, "VALIDATED")], schema), sources)
    with pytest.raises(ValueError, match="schema"):
        promotion.promote(spark, root, spark.createDataFrame([row("c", 2, "VALIDATED")], schema).drop("page_no"), sources)
    assert versions.read(spark, root).count() == 2
