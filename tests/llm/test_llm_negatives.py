"""Hard negatives: packing and tables against plain sums, and the operator against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.llm import negatives


def brute(rows, is_anchor, positives, most, low, high, scale=256):
    """rows: (id, label, vector) that take part."""
    width = max((len(v) for _, _, v in rows), default=0)
    q = np.zeros((len(rows), width), np.int64)
    for row, (_, _, v) in zip(q, rows):
        row[: len(v)] = np.floor(np.array(v, float) * scale)
    out = []
    for k, (anchor, label, _) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        ranked = sorted((-int(q[k] @ q[j]), rows[j][0], rows[j][1]) for j in range(len(rows)))
        for s, i, _ in [x for x in ranked if x[2] == label and x[1] != anchor][:positives]:
            fit = [x for x in ranked if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:most]
            out += [(anchor, i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def test_planes_and_tables_give_exact_products():
    r = np.random.default_rng(4)
    for width, most in ((64, 160), (5, 3), (17, 1 << 20), (8, 1)):
        rows, anchors = r.integers(-most, most, (700, width)), r.integers(-most, most, (30, width))
        bits = negatives.pack_planes(rows)
        padded = np.zeros((30, bits.shape[1] * 8), np.int64)
        padded[:, :width] = anchors
        assert (negatives.scores(negatives.subset_sums(padded), bits) == rows @ anchors.T).all()
        assert (negatives.unpack_planes(bits, np.arange(700))[:, :width] == rows).all()


@pytest.mark.parametrize("block", [4096, 16])
def test_mining_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    r = np.random.default_rng(8)
    rows = [(k, int(r.integers(0, 3)) if k % 3 else 1, [float(x) for x in r.normal(0, 0.2, 12).round(1)]) for k in range(300)]
    rows += [(k, 0, [0.5] * 12) for k in range(400, 430)] + [(600, 9, [1.0] * 12), (601, 2, []), (602, 2, [1.0])]  # ties, a label of its own, shorter vectors
    odd = [(None, 1, [1.0] * 12), (1000, None, [1.0] * 12), (1010, 1, None), (1020, 1, [1.0, None]), (1030, 1, [float("nan")]), (1040, 1, [float("-inf")])]
    df = spark.createDataFrame([(*x, "r", 3) for x in rows + odd], "id long, label int, embedding array<float>, row string, k int")
    got = negatives.mine(df, F.col("id") % 10 == 0, positives=4, negatives=6)
    assert sorted(tuple(x)[:6] for x in got.collect()) == brute([(i, l, np.float32(v).tolist()) for i, l, v in rows], lambda i: i % 10 == 0, 4, 6, 30, 90)


def test_repeated_rows_count_separately(spark):
    rows = [(0, 1, [1.0, 0.0])] * 3 + [(1, 1, [1.0, 0.5])] * 2 + [(2, 2, [0.5, 0.1])] * 2
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    got = [tuple(x)[:6] for x in negatives.mine(df, F.col("id") == 0).collect()]
    assert sorted(got) == brute(rows, lambda i: i == 0, 5, 10, 30, 90)
    assert len(got) == 3 * 2 * 2


def test_tables_without_rows_or_anchors(spark):
    schema = "id long, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("id") == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0])], schema), F.col("id") == 0).count() == 0


def test_too_large_components_fail(spark):
    df = spark.createDataFrame([(0, 1, [1e30])], "id long, label int, embedding array<float>")
    with pytest.raises(Exception, match="scale the vectors down"):
        negatives.mine(df, F.col("id") == 0).count()
