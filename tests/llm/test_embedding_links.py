import math

import numpy as np
import pytest

from episcope.llm import embedding_links as el
from episcope.llm import queries

SCHEMA = "vec_id long, embedding array<double>, kept string, node int"


def links_by_hand(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of every row from all pairs."""
    units = []
    for i, v in rows:
        good = i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        big = max(map(abs, v)) if good else 1
        w = np.array(v) / big if good else None
        units.append(w / np.sqrt(w @ w) if good else None)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    degree = [0] * len(rows)
    for i, u in enumerate(units):
        for j in range(i):
            w = units[j]
            if u is not None and w is not None and len(u) == len(w) and u @ w >= threshold:
                degree[i] += 1
                degree[j] += 1
                label[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    found = [(name, degree[i], None if name is None else least[root(i)]) for i, (name, _) in enumerate(rows)]
    return sorted(((*f, f[0] == f[2]) for f in found), key=repr)


def run(spark, rows, **options):
    made = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in el.vector_links(made, **options).collect()), key=repr)


def clusters(rng, dim, count, sizes, noise):
    rows = [rng.normal(size=dim) for _ in range(count)]
    for size in sizes:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            away = rng.normal(size=dim)
            rows.append((centre + noise * rng.uniform() * away / np.linalg.norm(away)) * rng.uniform(0.1, 9))
    return [(1000 - i, v.tolist()) for i, v in enumerate(rows)]


def test_hadamard_keeps_lengths_and_angles():
    a = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(el.hadamard(a) @ el.hadamard(a).T, a @ a.T)
    assert np.allclose(el.hadamard(el.hadamard(a)), a)


@pytest.mark.parametrize("dim", [1, 2, 3, 17, 64])
def test_links_equal_all_pairs(spark, dim):
    rows = clusters(np.random.default_rng(dim), dim, 150, (2, 3, 9, 40), 0.25)
    assert run(spark, rows) == links_by_hand(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(el, "_BLOCK", 16)
    rows = clusters(np.random.default_rng(1), 24, 40, (150,), 0.35)
    rows += [(2000 + i, rows[60][1]) for i in range(50)]  # equal vectors
    expected = links_by_hand(rows)
    assert max(r[1] for r in expected) > 100
    assert run(spark, rows) == expected


def test_chain_of_links(spark):
    steps = [(i, [math.cos(0.3 * i), math.sin(0.3 * i), 0.0, 0.0]) for i in range(9)]
    assert run(spark, steps) == links_by_hand(steps)
    assert {r[2] for r in run(spark, steps)} == {0}


def test_odd_vectors_and_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]),
        (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (None, [1.0, 0.0]), (8, [1e300, 1e298]), (9, [1e-310, 0.0]), (10, [2.0, 0.0, 0.0]),
    ]
    # rows that share an id are rows of their own: (1, [0, 1]) links with nothing, but has the least id of itself
    assert run(spark, rows) == links_by_hand(rows)
    assert run(spark, []) == []
    assert run(spark, [(5, None)]) == [(5, 0, 5, True)]


def test_recall_at_the_threshold(spark):
    """Pairs of exactly the threshold's cosine (and a bit) among many vectors."""
    rng = np.random.default_rng(4)
    a = el.unit(rng.normal(size=(600, 64)))
    away = rng.normal(size=a.shape)
    away = el.unit(away - (away * a).sum(1, keepdims=True) * a)
    b = 0.9501 * a + math.sqrt(1 - 0.9501**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = run(spark, rows)
    assert sum(r[1] for r in got) >= 0.99 * 1200
    assert all(r[2] in (r[0], r[0] - 600) for r in got)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in queries.op11_embedding_links(spark, sf_dir).collect()), key=repr)
    assert got == links_by_hand(rows)
