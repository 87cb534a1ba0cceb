"""Registered queries on rows that hold what their contracts speak of."""

import hashlib
import re
import uuid

import pytest
from pyspark.sql import types as T
from trustmill.llm import queries


@pytest.fixture
def folder(spark, tmp_path):
    def make(**tables):
        root = tmp_path / uuid.uuid4().hex
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return make


def test_secrets_are_counted_by_kind(spark, folder):
    """The kind of a span is looked at, not its place in the list."""
    key, name, value = "0123456789abcdef" * 2, "AKIA" + "Q7" * 10, "password = hunter22"
    texts = [None, "", value, name, key, f"{value} {name} {key}", f"{key} {key} {name} {value} {value} {value}", f"{name}\n{name} é {key}", "token: abc, secret=abcdef"]
    schema = T.StructType.fromDDL("doc_id long, text string")
    got = {r["doc_id"]: r for r in queries.op5_secrets(spark, folder(documents=(list(enumerate(texts)), schema))).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        assign = [m for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        access = [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        hexes = [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == (len(assign), len(access), len(hexes)), text
        spans = sorted((m.start(), n, m.end()) for n, found in enumerate((assign, access, hexes)) for m in found)
        want = ",".join(f"{queries.secrets.KINDS[n]}:{a}:{b}" for a, n, b in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text


def test_written_rules_have_the_words_of_the_contract(spark, folder):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {rule: word for word, rule in queries.URL_RULES} == contract
    urls = [
        ("https://a.com/en/x", "com/en/"), ("HTTP://www.Example.COM/en/7?q", "example.com/en/7"), ("https://b.net/de/", "net/de/"), ("https://example.net/de/8", "example.net/de/8"),
        ("ftp://x.example.net/de/81/y#z", "example.net/de/8"), ("https://example.net/de/7", "net/de/"), ("https://c.org/es/1", "org/es/"), ("https://c.org/en/1", None), ("no url", None), (None, None),
    ]
    pages = ([(k, u) for k, (u, _) in enumerate(urls)], T.StructType.fromDDL("page_id long, url string"))
    root = folder(pages=pages, labels=([(0, 0)], T.StructType.fromDDL("doc_id long, toxic int")))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op10_url_rules(spark, root).collect()}
    assert got == {k: (rule, contract.get(rule, "allow")) for k, (_, rule) in enumerate(urls)}
