import random
import re

import numpy as np

from episcope.llm import components as c
from episcope.llm import near_duplicates as n

SCHEMA = "doc_id long, text string, class_id string"


def slow_similarity(a, b):
    a, b = (dict(zip(*map(list, x), strict=True)) for x in (a, b))
    both = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in both) for i in a.keys() & b.keys())


def prose(rng, size):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.randint(0, 60)}" for _ in range(size))


def changed(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_similarity_and_signatures():
    rng = random.Random(4)
    sets = []
    for size in (3, 8, 60, 60, 400, 400):
        a = prose(rng, size)
        for share in (0.0, 0.01, 0.05):
            sets += [n.weighted_set(a + " " + a[: len(a) // 2]), n.weighted_set(changed(rng, a, share) if share else a)]
    made = n.signatures(
        np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]),
        np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets]), len(sets), 4096,
    )
    for i in range(0, len(sets), 2):
        exact = n.probability_jaccard(sets[i], sets[i + 1])
        assert abs(exact - slow_similarity(sets[i], sets[i + 1])) < 1e-9
        assert abs((made[i] == made[i + 1]).mean() - exact) < 0.05


def classes_by_hand(rows, threshold=0.8):
    sets = [n.weighted_set(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if n.probability_jaccard(sets[i], sets[j]) >= threshold - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for i, (name, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(name)
    smallest = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((name, smallest[root(i)]) for i, (name, _) in enumerate(rows)), key=str)


def planted():
    rng = random.Random(11)
    rows, number = [], 0
    for copies in [1] * 40 + [2, 2, 3, 5, 9]:
        base = prose(rng, rng.choice([4, 30, 120, 300]))
        for k in range(copies):
            rows.append((number, base if k % 3 == 0 else changed(rng, base, 0.01)))
            number += 1
    base = prose(rng, 150)
    rows += [(number + k, changed(rng, base, 0.03)) for k in range(60)]  # a group around the threshold
    number += 60
    rows += [(number + k, base.upper() if k % 2 else base + "!") for k in range(30)]
    rows += [(5000, None), (5001, ""), (5002, "..."), (5003, "one two"), (5004, "One, two"), (None, base), (None, None)]
    rows += [(0, rows[0][1]), (5005, "word " * 30000), (5006, "word " * 30001)]
    rng.shuffle(rows)
    return rows


def test_classes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 16)
    rows = planted()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], SCHEMA)
    got = n.near_duplicate_classes(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == classes_by_hand(rows)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {c for _, c in classes_by_hand(rows)}
    left = n.keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} - {None} == kept - {None}


def test_ids_that_stand_for_two_texts(spark):
    rng = random.Random(2)
    a, b = prose(rng, 80), prose(rng, 80)
    docs = spark.createDataFrame([(1, a, ""), (1, b, ""), (2, changed(rng, b, 0.01), ""), (3, changed(rng, a, 0.01), "")], SCHEMA)
    got = sorted((r["doc_id"], r["class_id"]) for r in n.near_duplicate_classes(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(i, 7) for i in range(8, 20)] + [(50, 51)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["label"] for r in c.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 20)} | {50: 50, 51: 50}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["class_id"]) for r in n.near_duplicate_classes(docs).collect()), key=str)
    assert got == classes_by_hand(rows)
    assert len({x for _, x in got}) < len(got) and re.search(r"\w", rows[0][1])
    assert n.near_duplicate_classes(docs.limit(0)).count() == 0
