import math
import zlib

import pytest

from episcope.llm import toxicity as t


def test_folding():
    assert t.folded_words("1D10T ｉｄｉｏｔ іdіоt ídïot id!ot 1234 a-b") == ["idiot"] * 4 + ["idiot", "1234", "a", "b"]
    assert t.folded_words("") == []


def folded_at_once(text):
    """The words of a text folded as a whole."""
    text = text.lower()
    if not text.isascii():
        text = t.unicodedata.normalize("NFKD", text).translate(t._FOLD)
    return [w if w.isalpha() or w.isdigit() else w.translate(t._SIGNS) for w in t._WORD.findall(text)]


def test_folding_by_runs(monkeypatch):
    import random
    import sys

    draw = random.Random(3)
    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()] + list("-.,'\x00\u200b\u00ad—„")
    letters = list("aAzZ019@$!|+_ıİıßſKÅΣσςéïаеіԛ²٣") + ["e\u0301", "\u0323\u0307", "\u0345", "½", "ﬁ", "ｉ", "Ⅷ", "각", "…", "é" * 80]
    texts = ["".join(draw.choice(spaces if draw.random() < 0.25 else letters) for _ in range(60)) for _ in range(3000)]
    texts += [chr(c) + "a" + chr(c) + " \u0301" + chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    monkeypatch.setattr(t, "REMEMBERED", 50)
    t._FOLDED.clear()
    for text in texts:
        assert t.folded_words(text) == folded_at_once(text), ascii(text)
        assert len(t._FOLDED) <= 50
    t._FOLDED.clear()


def test_only_what_needs_it_is_folded_and_matched(monkeypatch):
    signed, normal = [], []
    signs = t._signed
    monkeypatch.setattr(t, "_signed", lambda run: signed.append(run) or signs(run))
    t._FOLDED.clear()
    text = "the 1diot, and the Ídiot-grüße; " * 50
    want = folded_at_once(text)
    normalize = t.unicodedata.normalize

    class Counted:
        @staticmethod
        def normalize(form, run):
            normal.append(run)
            return normalize(form, run)

    monkeypatch.setattr(t, "unicodedata", Counted)
    assert t.folded_words(text) == want and set(signed) == {"1diot"} and sorted(normal) == ["í", "üß"]
    t._FOLDED.clear()


def test_terms_found_are_those_of_the_words():
    words = ["idiot", "the", "thesis", "ab", "idiots", "the"]
    for among in (set(), {" idi", " the ", " thes", " idiot ", " idiots", " zzz"}, t.terms_of(set(words))):
        assert t.term_finder(among)(words) == t.terms_of(set(words)) & among
    assert t.term_finder({" abc"})([]) == set()


def test_exceptions_and_length():
    lexicon = t.Lexicon({" scum": 3.0, " idiot ": 2.0}, {" scum river "}, slope=40.0, intercept=-4.0)
    a = lexicon.automaton()
    assert lexicon.hits("you scummy idiot idiots".split(), a) == {4: 3.0, 11: 2.0}
    assert lexicon.hits("the scum river".split(), a) == {}
    short, long = (lexicon.score(lexicon.density(("scum " + "word " * n).split(), a)) for n in (5, 2000))
    assert short > 0.5 > long
    assert t.Lexicon().score(0.3) == 0.0 and t.Lexicon().hits(["scum"], t.Lexicon().automaton()) == {}


def planted(spark, n=600):
    bad = ["zarg", "vorpel", "m0rk"]
    docs, labels = [], []
    for i in range(n):
        words = [f"w{(i * 7 + j * 13) % 90}x" for j in range(30)]
        toxic = i % 5 == 1
        if toxic:
            words[3] = bad[i % 3] + ["", "ish", "ed"][i % 2]
        if i % 40 == 0:
            words[6:8] = ["zarg", "valley"]
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(toxic)))
    docs += [(1, docs[1][1], "c"), (9001, None, "c"), (9002, "", "c"), (None, "zarg", "c"), (9003, "word " * 40000 + "zarg", "c")]
    labels += [(1, 0), (None, 1), (5, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_learned_lexicon_on_held_out_rows(spark):
    docs, labels = planted(spark)
    got = t.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {i: int(i % 5 == 1) for i in range(600)}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == truth[r["doc_id"]], r
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9001]["score"] == by_id[9002]["score"] < 0.5 and not by_id[None]["held_out"]
    assert by_id[9003]["predicted"] == 0
    lexicon = t.fit_lexicon(docs.select("doc_id", "text"), labels)
    assert " zarg valley " in lexicon.exceptions
    kept = t.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_no_labels_and_empty_tables(spark):
    docs, labels = planted(spark, 40)
    assert {r["score"] for r in t.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert t.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_accuracy_on_documents(spark):
    from episcope.llm import queries

    folder = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, folder).filter("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null")
    rows = got.join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.93 * len(rows)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def plain_scores(text, lexicon):
    """Every word against every term and every phrase of the lexicon, one by one."""
    words = t.folded_words(text or "")
    lifted = set()
    for phrase in (p.split() for p in lexicon.exceptions):
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                lifted |= set(range(i, i + len(phrase)))
    heaviest = {}
    for i, w in enumerate(words):
        whole = [v for term, v in lexicon.weights.items() if term == f" {w} "]
        stems = [v for term, v in lexicon.weights.items() if term[-1] != " " and w.startswith(term[1:])]
        if i not in lifted and whole + stems:
            heaviest[i] = max(whole + stems)
    density = sum(heaviest.values()) / (len(words) + lexicon.prior_words)
    return 1 / (1 + math.exp(-(lexicon.slope * density + lexicon.intercept))), len(heaviest), len(words)


def test_scores_of_all_documents_against_plain_scorer(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    planted_docs, planted_labels = planted(spark)
    for frame, marks in ((docs, labels), (planted_docs, planted_labels)):
        lexicon = t.fit_lexicon(frame.select("doc_id", "text"), marks)
        assert lexicon.weights
        texts = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        want = sorted(((i, *plain_scores(x, lexicon)) for i, x in texts), key=str)
        rows = t.toxicity_scores(frame, lexicon).collect()
        got = sorted(((r["doc_id"], r["score"], r["n_hits"], r["n_words"]) for r in rows), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a[0] == b[0] and a[2:] == b[2:] and a[1] == pytest.approx(b[1], abs=1e-9)
