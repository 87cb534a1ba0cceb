"""Issue lists: a round trip, and every fault of a text."""

import json

from pyspark.sql import functions as F

from trustmill.functions import issues as iss


def test_round_trip(spark):
    lists = [[("a", None, "b")], [("a", "f", 'q"ü'), ("c", None, "d\n")], [], None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], f"k int, x {iss.ISSUES}")
    got = {r.k: (r.t, r.back, r.fault) for r in df.withColumn("t", iss.write(F.col("x"))).withColumns({"back": iss.read(F.col("t")), "fault": iss.fault(F.col("t"))}).collect()}
    for k, x in enumerate(lists):
        text, back, fault = got[k]
        assert fault is None and [tuple(i) for i in back] == (x or [])
        assert text == json.dumps([dict(zip(("code", "field", "message"), i)) for i in x or []], ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_faults(spark):
    texts = {
        "[": 0, "": 0, '{"code":"a"}': 1, '"x"': 1, "[1]": 2, "[null]": 2, "[[]]": 2, '[{"code":"a","message":"b","x":1}]': 3, '[{"code":"a"}]': 4, '[{"code":" ","message":"b"}]': 4, '[{"code":1,"message":"b"}]': 4, '[{"code":"a","message":null}]': 4,
        '[{"code":"a","message":"b","field":" "}]': 5, '[{"code":"a","message":"b","field":7}]': 5, '[{"code":"a","message":"b"},{}]': 4, '[{"code":"a","message":"b","field":null}]': None, " [] ": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.f, r.x) for r in df.select("t", iss.fault(F.col("t")).alias("f"), iss.read(F.col("t")).alias("x")).collect()}
    for t, k in texts.items():
        assert got[t][0] == (None if k is None else iss.FAULTS[k]), t
        assert (got[t][1] is None) == (k is not None), t
    assert df.limit(1).select(iss.fault(F.lit(None).cast("string")).alias("f")).first().f == iss.FAULTS[0]
