"""The dataset audit: missing inputs, unreadable texts, odd names."""

from trustmill.operators import audit


def rows_of(df):
    return {(r.item, r.key): r.n for r in df.collect()}


def test_inventory(spark):
    files = spark.createDataFrame([("a/x.PDF", 5), ("b/x.pdf", 7), ("a/~$x.xlsx", 1), ("x.xlsx", 2), (".hidden", 3), ("a.b/readme", 4)], "path string, length long")
    got = rows_of(audit.inventory(files, "a", "b"))
    assert (got["total_files", ""], got["usable_files", ""], got["temporary_files", ""], got["total_bytes", ""], got["usable_bytes", ""]) == (6, 4, 2, 22, 18)
    assert {k: n for (item, k), n in got.items() if item == "category"} == {"financial_report_pdf": 1, "research_report_pdf": 1, "excel_workbook": 1, "other": 1}
    assert {k: n for (item, k), n in got.items() if item == "extension"} == {".pdf": 2, ".xlsx": 2, "<none>": 2}


def test_questions_are_counted_as_far_as_they_read(spark):
    texts = ['[{"Q":"a"},{"Q":"b"}]', '[{"Q":" "},{"Q":5},{"A":1},"x",null,{"Q":"c"}]', "no json", '{"Q":"a"}', "[]", None, ' [{"Q":"d","Q2":1}] ']
    got = rows_of(audit.question_set(spark.createDataFrame(list(enumerate(texts)), "id int, questions string")))
    assert {k: n for (k, _), n in got.items()} == {"case_count": 7, "question_count": 4, "no_json": 2, "no_list": 1, "no_question": 5}


def test_missing_inputs(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    assert rows_of(audit.inventory(empty("path string, length long"), "a", "b"))["total_bytes", ""] == 0
    assert rows_of(audit.company_master(empty("stock_code string, stock_abbr string")))["status", "missing"] == 1
    assert rows_of(audit.database_schema(spark.createDataFrame([("balance_sheet", "f")], "table_name string, field_name string"))) == {**{("field_count", t): int(t == "balance_sheet") for t in audit.TABLES}, ("status", "incomplete"): 1}
    manifests = "path string, json string"
    assert set(rows_of(audit.gold_readiness(empty(manifests)))) == {("blocker", "missing_manifest")}
    assert set(rows_of(audit.gold_readiness(spark.createDataFrame([("a", "{}"), ("b", "{}")], manifests)))) == {("blocker", "multiple_manifests")}
    assert set(rows_of(audit.gold_readiness(spark.createDataFrame([("a", "[1]")], manifests)))) == {("blocker", "invalid_manifest")}
    assert set(rows_of(audit.gold_readiness(spark.createDataFrame([("a", '{"annotation_files":["x"]}')], manifests)))) == {("blocker", "manifest_requires_evaluation_loader_verification")}
