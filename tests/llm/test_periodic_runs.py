import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from episcope.llm import periodic_runs as pr
from episcope.llm import queries


def slow_runs(words, exponent=4, least=6):
    """All runs, by comparing the words with themselves at every distance."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = {}
    for q in range(1, len(ids) // exponent + 1):
        same = np.concatenate([[0], ids[q:] == ids[:-q], [0]]).astype(np.int8)
        turns = np.diff(same)
        for start, end in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) + q, strict=True):
            if end - start >= max(least, exponent * q):
                found.setdefault((int(start), int(end)), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_small_alphabets_against_all_distances():
    rng = random.Random(3)
    texts = []
    for _ in range(1500):
        letters = rng.randint(1, 4)
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            q = rng.randint(1, 20)
            base = [rng.randrange(letters) for _ in range(q)]
            if q > 3 and rng.random() < 0.5:
                base = [0] * (q - 1) + [1]
            elif q > 6 and rng.random() < 0.4:
                base = ([0, 1] * q)[: q - 1] + [2]
            at = rng.randint(0, len(words))
            words[at:at] = (base * 8)[: q * rng.randint(2, 7) + rng.randrange(q)]
        texts.append([str(w).encode() for w in words])
    found = pr.runs_of(texts)
    assert sum(len(f) for f in found) > 1000
    for words, runs in zip(texts, found, strict=True):
        assert sorted(map(tuple, runs.tolist())) == slow_runs(words)


def test_long_periods_and_other_exponents():
    rng = random.Random(5)
    base = [rng.randrange(50) for _ in range(700)]
    words = [str(w).encode() for w in [1, 2, 3] + base * 5 + base[:13] + [7, 7, 7, 7]]
    for exponent, least in ((3, 3), (4, 6), (5, 20)):
        assert sorted(map(tuple, pr.runs_of([words], exponent, least)[0].tolist())) == slow_runs(words, exponent, least)


SCHEMA = "doc_id long, text string, runs string, n_words long"


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [
        (1, None, "x", 5), (1, None, "x", 5), (2, "", "x", 5), (None, "a a a a a a a", "x", 5), (3, " \t\n\x0b", "x", 5),
        (4, "a a a a a", "x", 5), (5, "x " + "a b c " * 4 + "a q", "x", 5), (6, "wörter eins " * 9, "x", 5),
        (7, "\x1c\x1c " * 8, "x", 5), (8, "w" * 300_000 + " b" * 90_000, "x", 5),
    ]
    out = pr.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for (doc_id, text, *_), row in zip(rows, out, strict=True):
        words = words_of(text)
        expected = slow_runs(words) if len(words) < 1000 else [(1, 90_001, 1)]
        assert (row.doc_id, row.n_words) == (doc_id, len(words))
        assert [(r.start, r.start + r.length, r.period) for r in row.runs] == expected
        assert row.collapsed == collapsed(words, expected)
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for doc_id, text in docs:
        words = words_of(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = slow_runs(words)
        best = min(((s - e, s, q) for s, e, q in runs), default=None)
        row = got[doc_id]
        assert row.n_runs == len(runs)
        head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (row.start, row.length, row.period, row.exponent_milli) == head
        assert row.runs_sha256 == sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs))
        assert row.collapsed_sha256 == sha(collapsed(words, runs))
    assert planted > 5 and sum(r.n_runs for r in got.values()) > 5


def test_planted_text_of_odd_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(None, "a b"), (ids[0], None), (ids[1], " \n"), (ids[2], "one")]
    out = {r.doc_id: r.text for r in queries.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {None: "a b", ids[0]: None, ids[1]: " \n", ids[2]: "one"}


@pytest.mark.parametrize("rows", [[], [("", "")]])
def test_no_runs(rows):
    assert pr.runs_of([list(r) for r in rows]) == [] or all(len(r) == 0 for r in pr.runs_of([[b"a"], []]))
