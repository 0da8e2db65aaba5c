import math
import zlib
from collections import Counter

import pytest

from episcope.llm import language_models as lm

TEXTS = [
    (0, "the cat sat on the mat ."), (1, "The dog sat on the log!"), (2, "buy buy cheap cheap now now"), (3, None),
    (4, ""), (5, "cat and dog , dog and cat"), (6, "cheap cat now"), (7, "the the the the"), (7, "the the the the"),
    (None, "cat"), (8, "dog " * 20000),
]


def by_hand(rows, labels, prior):
    words = [(i, lm.tokens(t or "")) for i, t in rows]
    kinds = {t for _, x in words for t in x} | {""}
    wanted = {i for i, q in labels if i is not None and q == 1 and zlib.crc32(str(i).encode()) % 5}

    def model(keep):
        pairs = Counter(p for i, x in words if keep(i) for p in zip(["", *x], [*x, ""], strict=True))
        single = {w: sum(n for (_, b), n in pairs.items() if b == w) for w in kinds}
        total = sum(single.values()) + len(kinds)
        return lambda a, b: math.log((pairs[a, b] + prior * (single[b] + 1) / total) / (single[a] + prior))

    target, background = model(lambda i: i in wanted), model(lambda i: True)
    out = []
    for i, x in words:
        pairs = list(zip(["", *x], [*x, ""], strict=True))
        out.append((i, len(x), *(-sum(m(*p) for p in pairs) / len(pairs) for m in (target, background))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("prior", "chunk", "reach"), [(100.0, 1 << 20, 1 << 21), (2.5, 12, 4), (2.5, 1, 1 << 21)])
def test_scores_against_plain_models(spark, monkeypatch, prior, chunk, reach):
    monkeypatch.setattr(lm, "RANGE_PLACES", reach)
    monkeypatch.setattr(lm.as_chunks, "__defaults__", (chunk,))
    labels = [(i, int(i % 2 == 0)) for i in range(9)] + [(1, 1), (None, 1), (3, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, target string").repartition(3)
    frame = lm.cross_entropy_difference(docs, spark.createDataFrame(labels, "doc_id long, quality int"), prior=prior)
    got = sorted(((r["doc_id"], r["n_tokens"], r["target"], r["background"]) for r in frame.collect()), key=str)
    for a, b in zip(got, by_hand(TEXTS, labels, prior), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_many_kinds_of_tokens(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(70_000))), (2, "w1 w2")]
    frame = lm.cross_entropy_difference(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    )
    got = {r["doc_id"]: r for r in frame.collect()}
    kinds, every = 70_001, 70_002 + 2
    p = lambda n, total: (n + 1) / (total + kinds)
    steps = [(1 + 100 * p(2, every)) / 102, (2 + 100 * p(2, every)) / 102, (1 + 100 * p(2, every)) / 102]
    assert got[1]["n_tokens"] == 70_000 and got[2]["background"] == pytest.approx(-sum(map(math.log, steps)) / 3, abs=1e-9)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = lm.cross_entropy_difference(docs, none).collect()
    assert len(rows) == len(TEXTS) and all(math.isfinite(r["difference"]) for r in rows)
    assert lm.cross_entropy_difference(docs.limit(0), none).count() == 0


def test_wanted_documents_score_lower_on_held_out_rows(spark):
    from episcope.llm import queries

    folder = "/root/testdata/sf0.1"
    got = queries.op9_language_models(spark, folder).filter("held_out")
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("quality is not null").collect()
    good = sorted(r["difference"] for r in rows if r["quality"] == 1)
    bad = sorted(r["difference"] for r in rows if r["quality"] == 0)
    ranked = sum(a < b for a in good for b in bad) / (len(good) * len(bad))
    assert ranked > 0.8
