import random
import re
import zlib
from collections import Counter

import pytest

from episcope.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_by_hand(words):
    """Partners one edit apart, by leaving out letters."""
    near, cut = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            cut.setdefault((i, rest), []).append(w)
            if rest in near:
                near[w].add(rest)
                near[rest].add(w)
    for group in cut.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def variants_by_hand(counts, ratio=5):
    near, form = near_by_hand(counts), {}
    for w in counts:
        best = min(((-counts[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, **options):
    made = spark.createDataFrame([(w, n, "c") for w, n in rows], "word string, n long, form string")
    return sorted(tuple(r) for r in spelling.spelling_variants(made, **options).collect())


def test_whole_vocabulary_against_plain_version(spark, sf_dir):
    counts = Counter()
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for u in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = u.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = sorted(tuple(r) for r in queries.op13_spelling_variants(spark, sf_dir).collect())
    assert got == variants_by_hand(counts)
    assert sum(r[1] is not None for r in got) > 100


@pytest.mark.parametrize("slice_size", [3, 4096])
def test_slices_scripts_and_short_words(spark, slice_size):
    rng = random.Random(8)
    words = {"".join(rng.choice("abéñßψ字\U0001f600") for _ in range(rng.randint(0, 5))) for _ in range(500)}
    words |= {"x" * 5000, "x" * 5001, "x" * 2500 + "y" + "x" * 2500, "", "z"}
    counts = {w: rng.choice([1, 2, 5, 6, 11, 30, 60, 300]) for w in words}
    assert run(spark, counts.items(), slice_size=slice_size) == variants_by_hand(counts)


def test_ties_chains_repeats_and_nulls(spark):
    counts = {"kitten": 5, "mitten": 25, "bitten": 25, "bittern": 125, "bitterns": 625, "zzzzzz": 9}
    rows = [(w, n) for w, n in counts.items() if w != "zzzzzz"] + [("zzzzzz", 4), ("zzzzzz", 5), (None, 7), ("empty", None)]
    assert run(spark, rows) == variants_by_hand(counts | {"empty": 0})
    got = {r[0]: r for r in run(spark, rows)}
    assert got["kitten"][1:3] == ("bitten", "bitterns")
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, rows, ratio=1)


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "Straße STRASSE ÀÉÿ×÷abc " * 5), (None, "abcdef " * 6), (4, "q" * 100_000)]
    got = {tuple(r) for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {("straße", 5), ("strasse", 5), ("ÀÉÿ×÷abc", 5), ("abcdef", 6)}
