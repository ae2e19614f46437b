import math
import struct

import numpy as np

from heliograph.llm import knn


def brute(rows, k):
    """rows: (vec_id, components)."""
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = min((v for i, v in good if i == q), key=lambda v: struct.pack(f"<{len(v)}d", *v))
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in good if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def search(spark, rows, k=5, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "'x' as vec")
    data = knn.quantise(frame)
    return sorted(tuple(r) for r in knn.top_k(data, data.where("vec_id % 50 = 0"), k, **more).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector, very often
    rows += [(50, [0.0] * 12), (401, None), (402, [None] * 12), (403, [float("nan")] * 12), (None, [1.0] * 12), (404, [float("inf")] + [0.0] * 11), (405, [])]
    assert search(spark, rows) == brute(rows, 5)


def test_clustered_data_with_few_rows_sent(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 20
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=16) * 0.1]) for i in range(600)]
    assert search(spark, rows, 3, pivots=12) == brute(rows, 3)


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, 0.5]), (3, [-1.0, 0.0])]
    assert search(spark, rows) == brute(rows, 5)
    assert search(spark, []) == [] and search(spark, [(1, [1.0])]) == []


def test_scores_beyond_float_precision(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e3, 1.0]), (2, [2e3, 2.0])]
    assert search(spark, rows) == brute(rows, 5)


def test_repeated_query_id_still_gets_its_answers(spark):
    rng = np.random.default_rng(5)
    rows = [(50, [9.0, 0.0, 0.0, 0.0])] * 6 + [(50, [9.0, 0.5, 0.0, 0.0])] * 3
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(51, 90)]
    assert search(spark, rows) == brute(rows, 5)
