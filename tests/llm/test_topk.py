import math

import numpy as np

from episcope.llm import exact_topk


def by_hand(rows, k, every, scale=64.0):
    good = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        vector = max(v for i, v in good if i == q)
        scores = sorted((-sum(a * b for a, b in zip(vector, v, strict=True)), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")
    return sorted(tuple(r) for r in exact_topk.exact_topk(docs, **options).collect())


def as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_small_blocks_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 4])).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(3, rows[7][1]), (4, [0.0] * 6), (None, rows[0][1])]
    rows += [(300, None), (301, [None] + [1.0] * 5), (302, [math.nan] + [1.0] * 5), (303, [math.inf] + [1.0] * 5)]
    rows = as_float32(rows)
    got = run(spark, rows, k=7, every=3, bucket=16, group_buckets=2, query_block=8)
    assert got == by_hand(rows, 7, 3)


def test_aligned_vectors_use_coordinates(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (np.eye(8)[i % 8] * rng.uniform(1, 9) + rng.normal(size=8) * 0.05).tolist()) for i in range(400)]
    rows = as_float32(rows)
    got = run(spark, rows, k=5, every=4, bucket=32, group_buckets=3, query_block=16)
    assert got == by_hand(rows, 5, 4)


def test_fewer_than_k_and_empty(spark):
    rows = as_float32([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [3.0, -1.0])])
    assert run(spark, rows, k=20, every=20) == by_hand(rows, 20, 20)
    assert run(spark, [], k=20, every=20) == []
    assert run(spark, [(0, [])], k=20, every=20) == []


def test_finite_components_of_any_size(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, (rng.normal(size=5) * 10.0**p).tolist()) for i, p in enumerate((6, 7, 8, 12, 12, 17, 30, 150, 300))]
    rows += [(120, [2e6] + [0.0] * 4), (140, [2e12] + [0.0] * 4), (160, [1e300] * 5), (180, [-1e300] * 5), (200, [1e300] * 5)]
    made = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in exact_topk.exact_topk(made, k=9, every=20, bucket=16, query_block=8).collect())
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert got == [(q, r, i, clip(s)) for q, r, i, s in by_hand(rows, 9, 20)]
    assert any(abs(s) == 2**63 - 1 for *_, s in got) and any(2**53 < abs(s) < 2**63 - 1 for *_, s in got)


def test_only_huge_vectors(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0]), (20, [3e12, -1.0])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in exact_topk.exact_topk(made, k=5, every=20).collect())
    assert got == [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in by_hand(rows, 5, 20)]
