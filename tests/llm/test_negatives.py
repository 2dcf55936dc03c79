import math
import random

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import negatives

SCHEMA = "vec_id long, label long, embedding array<float>, row string, score double"


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, positives=5, k=5):
    """Rows by score descending, id (null last), order of arrival; as the operator's docstring says."""
    taken = [(n, i, lab, whole(v)) for n, (i, lab, v, *_) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, a, la, va in taken:
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i is None, i or 0, m, i, lab) for m, i, lab, v in taken if m != n), key=lambda x: x[:4])
        for p in [x for x in scored if x[5] == la][:positives]:
            near = [x for x in scored if x[5] != la and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:k]
            out += [(a, p[4], r + 1, x[4], -p[0], -x[0]) for r, x in enumerate(near)]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect()), key=str)


def some(rng, n, width=20):
    rows = []
    for i in range(n):
        v = [rng.gauss(0.05, 0.2) for _ in range(width)]
        rows.append((i * 10, rng.choice([0, 0, 1, 2]), v, "r", 1.0))
    return rows


def test_kernel_is_the_inner_product():
    rng = np.random.default_rng(1)
    for low, high, kind in ((-160, 160, np.int32), (0, 2, np.int32), (-(2**40), 2**40, np.int64), (-1, 1, np.int32)):
        q, a = rng.integers(low, high, (37, 24)), rng.integers(-50, 50, (5, 24))
        bits, index = negatives.planes(q)
        assert index.shape == (bits, 3, 37)
        assert (negatives.scores(index, negatives.subset_sums(a.astype(kind))) == q @ a.T).all()


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = random.Random(4)
    rows = some(rng, 260)
    rows += [rows[10], rows[10], (200, 1, rows[20][2], "r", 1.0)]  # repeated rows, an anchor among them
    rows += [(i, 2, rows[30][2], "r", 1.0) for i in (7, 5, 3)]  # ties
    rows += [(None, 0, rows[40][2], "r", 1.0), (301, None, rows[40][2], "r", 1.0), (500, 1, None, "r", 1.0), (600, 1, [0.1, None], "r", 1.0)]
    rows += [(700, 1, [0.1, float("nan")], "r", 1.0), (800, 1, [float("inf")], "r", 1.0), (900, 1, [], "r", 1.0), (1100, 0, [0.5] * 9, "r", 1.0)]
    rows += [(1200, 9, [0.3] * 20, "r", 1.0)]  # alone with its label
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = brute(rows)
    assert mined(df) == want and len(want) > 100


def test_empty_and_without_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 0, [1.0], "r", 1.0)], SCHEMA)) == []


def test_wide_components(spark):
    """Components whose planes and sums need 64 bits."""
    rng = random.Random(2)
    rows = [(i * 50, i % 2, [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 18) for _ in range(8)], "r", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert mined(df) == brute(rows)
