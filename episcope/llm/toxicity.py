"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms, accents, look-alike letters of other scripts, and digits
or signs that stand for letters inside a word. An Aho-Corasick automaton then finds lexicon terms at
word starts (whole words or stems) in one pass. A word counts with its heaviest term, a word inside an
exception phrase does not count. The sum is normalised by length and turned into a score by a
calibrated logistic curve.

Lexicon, exceptions and curve come from labelled rows outside the held-out fold. At most ``max_labels``
of them (a documented bound, drawn by a hash of the id) are used, so that what the driver gathers is
bounded. Terms are weighted by log odds and picked greedily, each for the toxic documents that no term
before it explains; so the words of one much copied document do not become terms.

Defined results: a null or empty text scores as a text without terms; a null id is not held out;
repeated rows are scored as rows; several labels of an id count as the largest; without usable labels
of both kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import id_and_text
from episcope.session import ship_package

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKES = dict(
    zip("авгеёзіїјкмнопрсттухыԁԛԝѕһβεικνορτυχωıɡɑ", "abreeziijkmhonpcttyxbdqwshbeikvoptuxwiga", strict=True)
)
#: Signs that stand for letters inside a word (fixed values).
STAND_INS = dict(zip("013456789@$!|+", "oieasgtbgasilt", strict=True))

_FOLD = str.maketrans(LOOK_ALIKES | {chr(c): None for c in range(0x300, 0x370)})
_SIGNS = str.maketrans(STAND_INS)
_WORD = re.compile(r"[@$]?\w(?:[\w@$!|+]*\w)?")
STEM_LENGTHS = (3, 4, 5, 6, 7)


_OTHER = re.compile(r"[^\x00-\x7f]+")
_NO_WORD = re.compile(r"[^\w\x00-\x7f]")
#: Bytes of UTF-8 text; ASCII that cannot be in a word becomes a blank.
_BLANKED = bytes(b if b >= 0x80 or re.match(r"[\w@$!|+]", chr(b)) else 0x20 for b in range(256))
#: Folded runs of letters beyond ASCII; a worker remembers so many short ones.
_FOLDED: dict[str, str] = {}
REMEMBERED, SHORT = 1 << 14, 16


def _folded(run: re.Match) -> str:
    """A run of letters beyond ASCII, folded; what is left of it beyond ASCII is letters and digits."""
    text = run[0]
    folded = _FOLDED.get(text)
    if folded is None:
        folded = _NO_WORD.sub(" ", unicodedata.normalize("NFKD", text).translate(_FOLD))
        if len(text) <= SHORT:
            if len(_FOLDED) >= REMEMBERED:
                _FOLDED.clear()
            _FOLDED[text] = folded
    return folded


def _signed(run: str) -> list[str]:
    return [w if w.isalpha() or w.isdigit() else w.translate(_SIGNS) for w in _WORD.findall(run)]


def folded_words(text: str) -> list[str]:
    """Words of a text, lower case, with look-alikes and stand-ins replaced.

    Folding does not reach from one run beyond ASCII to the next, so only these runs are folded. Then
    what cannot be in a word is blanked, and only runs that are not plain letters are matched by pattern.
    """
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(_folded, text)
    runs = text.encode().translate(_BLANKED).decode().split()
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ((run,) if run.isalpha() else _signed(run))]


def terms_of(words: set[str]) -> set[str]:
    """Lexicon terms a set of words can hold: stems `` stem`` and whole words `` word ``."""
    found = {f" {w} " for w in words if len(w) >= STEM_LENGTHS[0]}
    for n in STEM_LENGTHS:
        found |= {f" {w[:n]}" for w in words if len(w) >= n}
    return found


def term_finder(among: set[str]) -> Callable[[list[str]], set[str]]:
    """A function that gives the terms of ``among`` that words hold, in one pass over them."""
    if not among:
        return lambda words: set()
    automaton = ahocorasick.Automaton()
    for term in among:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return lambda words: {term for _, term in automaton.iter(f" {' '.join(words)} ")}


@dataclass
class Lexicon:
    """Weights of terms, phrases that lift a word's weight, and the curve from density to score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    slope: float = 0.0
    intercept: float = -math.inf
    prior_words: float = 20.0

    def automaton(self):
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, words: list[str], automaton) -> dict[int, float]:
        """Weight by place of the words that count."""
        if not len(automaton):
            return {}
        text = f" {' '.join(words)} "
        heaviest: dict[int, float] = {}
        lifted: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(text):
            start = end - length + 1
            if weight is None:
                lifted.append((start, end))
            else:
                heaviest[start] = max(weight, heaviest.get(start, 0.0))
        for a, b in lifted:
            for start in [s for s in heaviest if a <= s < b]:
                del heaviest[start]
        return heaviest

    def density(self, words: list[str], automaton) -> float:
        return sum(self.hits(words, automaton).values()) / (len(words) + self.prior_words)

    def score(self, density: float) -> float:
        if self.intercept == -math.inf:
            return 0.0
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * density + self.intercept))))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for ids whose checksum falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, max_labels: int) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    known = known.filter(~held_out(F.col("doc_id"), folds))
    share = min(1.0, max_labels / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    one = drawn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    return docs.join(F.broadcast(one), "doc_id").select("text", "label")  # about max_labels rows at most


def _term_counts(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """Documents per term; per task first, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        find = term_finder(only) if only is not None else lambda words: terms_of(set(words))
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(find(folded_words(text)))
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())}
        )

    return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _largest(support: dict[str, int]) -> str:
    """The longest of the terms whose support is within three percent of the largest."""
    most = max(support.values())
    return max((t for t, n in support.items() if n >= 0.97 * most), key=lambda t: (len(t), t))


def _pick(toxic: list[set[str]], clean: list[set[str]], weights: dict[str, float], least: int) -> dict[str, float]:
    """Choose terms: first those common among toxic and all but absent among clean documents, then greedily
    the one that explains most toxic documents not yet explained. Of related terms one is taken."""
    against = Counter(t for terms in clean for t in terms)
    holders: dict[str, set[int]] = {}
    for i, terms in enumerate(toxic):
        for t in terms:
            holders.setdefault(t, set()).add(i)
    chosen: dict[str, float] = {}
    explained: set[int] = set()

    def choose(support: dict[str, int]) -> None:
        best = _largest(support)
        chosen[best] = weights[best]
        explained.update(holders[best])
        for t in [t for t in holders if t.startswith(best.rstrip()) or best.startswith(t)]:
            del holders[t]

    common = max(least, math.ceil(0.02 * len(toxic)))
    while support := {t: len(h) for t, h in holders.items() if len(h) >= max(common, 100 * against[t])}:
        choose(support)
    while support := {t: n for t, h in holders.items() if (n := len(h - explained) - 10 * against[t]) >= least}:
        choose(support)
    return chosen


def _curve(density: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps, with a small ridge."""
    scale = max(float(density.std()), 1e-9)
    x = np.column_stack([density / scale, np.ones_like(density)])
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, max_labels: int = 200_000,
    exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learn a lexicon from labelled rows outside fold 0; ``exceptions`` adds known harmless phrases."""
    rows = _training(docs, labels, label_col, folds, max_labels)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    lexicon = Lexicon(exceptions={f" {' '.join(folded_words(p))} " for p in exceptions})
    if not n_toxic or not n_clean:
        return lexicon
    least = max(3, math.ceil(0.003 * n_toxic))
    # a term must be in a fixed share of the toxic documents, so their number does not grow with the corpus
    common = {
        r["term"]: r["n"] for r in _term_counts(rows.filter("label = 1"), None).filter(F.col("n") >= least).collect()
    }
    clean = {r["term"]: r["n"] for r in _term_counts(rows.filter("label = 0"), set(common)).collect()}
    weights = {
        t: min(6.0, math.log((k + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1)))
        for t, k in common.items()
    }
    strong = {t: w for t, w in weights.items() if w >= 2.0}
    lexicon.exceptions |= _exceptions(rows, set(strong), least)
    seen = _strong_terms(rows, set(strong), lexicon.exceptions).filter(F.size("terms") > 0).collect()  # max_labels rows
    by_label = {v: [set(r["terms"]) for r in seen if r["label"] == v] for v in (0, 1)}
    lexicon.weights = _pick(by_label[1], by_label[0], strong, least)
    automaton = lexicon.automaton()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.density(folded_words(t), automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.float64()), "label": batch.column("label").cast(pa.int32())})

    measured = rows.mapInArrow(measure, "x double, label int").toArrow()  # at most max_labels rows
    lexicon.slope, lexicon.intercept = _curve(measured["x"].to_numpy(), measured["label"].to_numpy().astype(float))
    return lexicon


def _exceptions(rows: DataFrame, strong: set[str], least: int) -> set[str]:
    """Pairs of words around a strong term that clean documents use and toxic ones do not."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = term_finder(strong)
        for batch in batches:
            around = []
            for text in batch.column("text"):
                words = folded_words(text.as_py())
                held = tuple(find(words))
                known = {w for w in set(words) if f" {w} ".startswith(held)} if held else ()
                pairs = zip(words, words[1:], strict=False) if known else ()
                around.append(sorted({f" {a} {b} " for a, b in pairs if a in known or b in known}))
            label = batch.column("label").cast(pa.int32())
            yield pa.RecordBatch.from_pydict({"label": label, "pairs": pa.array(around, pa.list_(pa.string()))})

    counts = (
        rows.mapInArrow(look, "label int, pairs array<string>").select("label", F.explode("pairs").alias("pair"))
        .groupBy("pair")
        .agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic"))
        .filter((F.col("clean") >= least) & (F.col("toxic") * 20 <= F.col("clean")))
    )
    return {r["pair"] for r in counts.collect()}


def _strong_terms(rows: DataFrame, strong: set[str], exceptions: set[str]) -> DataFrame:
    """label and the strong terms of each row, without words inside an exception phrase."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = term_finder(strong)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                words = folded_words(text.as_py())
                if exceptions:
                    lifted = [f" {a} {b} " in exceptions for a, b in zip(words, words[1:], strict=False)]
                    near = zip(words, [False, *lifted], [*lifted, False], strict=False)
                    words = [w for w, before, after in near if not before and not after]
                found.append(sorted(find(words)))
            label = batch.column("label").cast(pa.int32())
            yield pa.RecordBatch.from_pydict({"label": label, "terms": pa.array(found, pa.list_(pa.string()))})

    return rows.mapInArrow(look, "label int, terms array<string>")


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), n_hits, n_words of every row; texts are read whole."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            score, hits, size = [], [], []
            for value in batch.column("text"):
                words = folded_words(value.as_py())
                found = lexicon.hits(words, automaton)
                score.append(lexicon.score(sum(found.values()) / (len(words) + lexicon.prior_words)))
                hits.append(len(found))
                size.append(len(words))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()),
                 "n_hits": pa.array(hits, pa.int64()), "n_words": pa.array(size, pa.int64())}
            )

    schema = "doc_id long, score double, n_hits long, n_words long"
    return id_and_text(docs, id_col, text_col).mapInArrow(measure, schema)


def without_toxic(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``limit``; columns stay as they are."""
    ship_package(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            words = (folded_words(t.as_py() or "") for t in batch.column(text_col))
            keep = [lexicon.score(lexicon.density(w, automaton)) < limit for w in words]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, max_labels: int = 200_000) -> DataFrame:
    """Fit on the labelled rows outside fold 0 and score every row: doc_id, held_out, score, predicted."""
    lexicon = fit_lexicon(id_and_text(docs), labels, folds=folds, max_labels=max_labels)
    scored = toxicity_scores(docs, lexicon)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_words",
    )
