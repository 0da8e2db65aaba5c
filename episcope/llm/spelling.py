"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Letters are put into groups, and a word is arranged by its length and then by how many letters of each group
it has, group after group. An edit of one code point changes these counts by a surplus of one (the other
word has a letter more of some group), a deficit of one, or both. A depth-first search over the trie
therefore carries a budget of one surplus and one deficit, and leaves a branch when either is overdrawn.
Words that are reached are verified letter by letter.

The trie is cut below its first levels (length and three groups): each subtree is a key of a shuffle. A word
goes as a question to the few subtrees that its budget reaches, 17 at most, whose words are as long as itself
or one longer, so a pair is found once. A subtree of more than ``slice_size`` words is dealt into slices, and its
questions into parts of about that number, which bounds a task's rows and memory; words of one subtree never
meet as pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import saved
from episcope.llm.keyed import parts
from episcope.session import ship_package

#: Letter groups in the order of the trie's levels; all other characters form one more group.
GROUPS = ("ek", "nq", "iv", "ryü", "sbé", "tw", "apö", "dgä", "hfx", "lcj", "ouz", "mß")
_TOP = 3
_OTHER = len(GROUPS)
#: Nodes with fewer words times questions are compared directly; letters compared at once.
_SMALL = 4096
_CELLS = 4_000_000


def _group_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.int8)
    for number, letters in enumerate(GROUPS):
        for letter in letters:
            table[ord(letter)] = number
    return table


def group_counts(words: list[str], table: np.ndarray) -> np.ndarray:
    """How many letters of each group every word has; one row a word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    cells = np.repeat(np.arange(len(words)), sizes) * (_OTHER + 1) + table[points]
    return np.bincount(cells, minlength=len(words) * (_OTHER + 1)).reshape(len(words), _OTHER + 1).astype(np.int32)


def letters_of(words: list[str], size: int) -> np.ndarray:
    """Code points of words that all have ``size`` of them, one row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Per row, whether one edit turns ``short`` into ``long``, which is as long and greater, or one longer."""
    size = short.shape[1]
    if not size:
        return np.full(len(short), long.shape[1] == 1)
    differs = short != long[:, :size]
    first = np.where(differs.any(1), differs.argmax(1), size)
    if long.shape[1] == size:
        at = np.minimum(first, size - 1)[:, None]
        greater = np.take_along_axis(long, at, 1)[:, 0] > np.take_along_axis(short, at, 1)[:, 0]
        return (differs.sum(1) == 1) & greater
    late = short != long[:, 1:]
    last = np.where(late.any(1), size - 1 - late[:, ::-1].argmax(1), -1)
    return last < first  # equal before the inserted letter, and after it


class Trie:
    """Words in the order of their group counts; a node is a range of words that agree so far."""

    def __init__(self, words: list[str], table: np.ndarray):
        counts = group_counts(words, table)
        order = np.lexsort(counts.T[::-1]) if len(words) else np.empty(0, np.int64)
        self.words = [words[i] for i in order]
        self.counts = counts[order]

    def search(self, asked: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question, word) numbers whose counts differ within the budgets of the questions."""
        nodes = [(0, len(self.words), 0, np.arange(len(asked)), surplus, deficit)]
        while nodes:  # depth first
            low, high, level, who, more, less = nodes.pop()
            if not len(who) or low == high:
                continue
            if level == self.counts.shape[1] or (high - low) * len(who) <= _SMALL:
                apart = self.counts[None, low:high, level:] - asked[who, None, level:]
                fits = np.maximum(apart, 0).sum(2) <= more[:, None]
                fits &= np.maximum(-apart, 0).sum(2) <= less[:, None]
                question, word = np.nonzero(fits)
                yield who[question], word + low
                continue
            column = self.counts[low:high, level]
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                apart = column[start] - asked[who, level]
                rest_more, rest_less = more - np.maximum(apart, 0), less - np.maximum(-apart, 0)
                go = (rest_more >= 0) & (rest_less >= 0)
                if go.any():
                    nodes.append((low + start, low + stop, level + 1, who[go], rest_more[go], rest_less[go]))

    def near(self, words: list[str], table: np.ndarray) -> Iterator[tuple[str, str]]:
        """(question, word) that are one edit apart. All words of a subtree are equally long; a question has that
        length, and is then the smaller one, or one letter less."""
        size = len(self.words[0]) if self.words else 0
        for short in (size - 1, size):
            asked = [w for w in words if len(w) == short]
            if not asked or not size:
                continue
            own, stored = letters_of(asked, short), letters_of(self.words, size)
            budget = np.ones(len(asked), np.int32)
            step = max(1, _CELLS // size)
            for who, found in self.search(group_counts(asked, table), budget, budget * (short == size)):
                for start in range(0, len(who), step):
                    i, j = who[start : start + step], found[start : start + step]
                    good = one_edit(own[i], stored[j])
                    yield from ((asked[x], self.words[y]) for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True))


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each (subtree, slice, part of the questions); its own words come first, then the questions."""
    table = _group_table()
    place, stored, trie = None, [], None
    left: list[str] = []
    right: list[str] = []
    for (*here, asks), piece in parts(batches, ["subtree", "slice", "part", "asks"]):
        if here != place:
            place, stored, trie = here, [], None
        if not asks:
            stored += piece.column("word").to_pylist()
            continue
        trie = trie or Trie(stored, table)
        for start in range(0, piece.num_rows, 1024):
            for a, b in trie.near(piece.column("word").slice(start, 1024).to_pylist(), table):
                left.append(a)
                right.append(b)
        if len(left) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])
            left, right = [], []
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])


def _top_counts(word: Column) -> list[Column]:
    return [F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS[:_TOP]]


def _subtree(length: Column, counts: list[Column]) -> Column:
    return F.concat_ws(",", length, *counts)


def near_words(words: DataFrame, slice_size: int = 4096) -> DataFrame:
    """a, b: every pair of the distinct ``word`` values that are one edit apart, once (a no longer than b)."""
    ship_package(words.sparkSession)
    word, length = F.col("word"), F.length("word")
    top = words.select("word", length.alias("size"), *[c.alias(f"c{i}") for i, c in enumerate(_top_counts(word))])
    own = [F.col(f"c{i}") for i in range(_TOP)]
    stored = top.select("word", _subtree(F.col("size"), own).alias("subtree"))
    sizes = stored.groupBy("subtree").agg(F.ceil(F.count("*") / slice_size).cast("int").alias("slices"))

    def moved(step: dict[int, int]) -> list[Column]:
        return [c + step.get(i, 0) for i, c in enumerate(own)]

    levels = range(_TOP)
    steps = [{}] + [{i: d} for i in levels for d in (1, -1)] + [{i: 1, j: -1} for i in levels for j in levels if i != j]
    reached = [_subtree(F.col("size"), moved(s)) for s in steps]
    reached += [_subtree(F.col("size") + 1, moved(s)) for s in ({}, *({i: 1} for i in levels))]
    asked = top.select("word", F.explode(F.array(*reached)).alias("subtree")).join(sizes, "subtree")
    # Questions of a subtree are dealt into parts as well; each part meets every slice once.
    parts_of = asked.groupBy("subtree").agg(F.ceil(F.count("*") / slice_size).cast("int").alias("parts"))
    own_part = lambda: F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(parts_of, "subtree").select(
        "subtree", every("slices").alias("slice"), own_part().alias("part"), F.lit(True).alias("asks"), "word"
    )
    kept = stored.join(sizes, "subtree").join(parts_of, "subtree").select(
        "subtree", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int").alias("slice"), every("parts").alias("part"),
        F.lit(False).alias("asks"), "word",
    )
    keys = ("subtree", "slice", "part")
    dealt = kept.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asks")
    return dealt.mapInArrow(_near_pairs, "a string, b string")


def _followed(forms: DataFrame) -> DataFrame:
    """word, root: the last word along ``form``. Steps double per round, so rounds are few."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(over, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = saved(moved, "roots")
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_variants(counted: DataFrame, ratio: int = 5, slice_size: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n for words with their numbers of occurrences (columns word, n).

    A word's ``form`` is its near word of largest n (ties: the first in code-point order), if that n is at
    least ``ratio`` times its own; ``root`` follows forms to the last one. With ``ratio`` >= 2 forms never
    run in a circle.

    Rows that share a word are added up; null words are left out, a null n counts nothing. The empty word is
    near to all words of one letter. An empty table gives none. Other columns are left behind.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2, or forms could run in a circle")
    words = counted.filter(F.col("word").isNotNull()).groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    words = saved(words, "words")
    pairs = near_words(words.select("word"), slice_size)
    pairs = saved(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*"), "pairs")
    others = words.select(F.col("word").alias("b"), F.col("n").alias("other_n"))
    best = pairs.join(others, "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("low"), F.col("b").alias("form"))).alias("best")
    )
    near = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    found = (-F.col("best.low")) >= ratio * F.col("n")
    near = saved(
        near.select(
            "word", "n", "n_near", F.when(found, F.col("best.form")).alias("form"), F.when(found, -F.col("best.low")).alias("form_n")
        ),
        "near-words",
    )
    roots = _followed(near.filter("form is not null"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def word_counts(docs: DataFrame, alter=None, shortest: int = 6, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of letters (A to Z and Latin-1 letters' range) with ``shortest`` code points and ``least`` occurrences.

    Only A to Z are lower-cased. ``alter(doc_id, word)`` gives a column that replaces each occurrence before
    it is measured and counted. Null texts have no words.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run"))
    found = found.select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    word = F.col("run") if alter is None else alter(F.col("doc_id"), F.col("run"))
    found = found.select(word.alias("word")).filter(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
