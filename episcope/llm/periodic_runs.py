"""Runs: stretches of words that repeat with a period, found from synchronising positions.

A word stretch is periodic when words a fixed distance apart are equal. For every scale t = 1, 2, 4, ...
a set of positions is selected by hash: position i is taken if, among the fingerprints of the t-word
windows that begin in [i, i + t], the smallest one begins at i or at i + t. Whether i is taken depends on the
2t words from i alone, so equal surroundings are taken alike, and a run whose period is about t holds a
taken position in every period. Two neighbouring taken positions with equal context (2t or 3t words) propose
their distance as a period.

Windows inside a region whose period is at most a third of t would flood the selection, so they are left
out; such regions are known by then from finer scales (a period of one word from equal neighbours), and it is
they that supply the omitted small periods. Every proposal is then extended word by word as far as its
period holds, by fingerprints of dyadic windows.

Equality of windows is equality of 64-bit fingerprints, mixed from exact word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from episcope.llm.common import id_and_text, mixed, text_groups

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(left * _STEP + right)


def _dyadic(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Fingerprints of all windows of 1, 2, 4, ... words, up to ``longest``."""
    found = [mixed(words.astype(np.uint64))]
    while 2 ** len(found) <= min(longest, len(words)):
        last, half = found[-1], 2 ** (len(found) - 1)
        found.append(_joined(last[:-half], last[half:]))
    return found


def _extended(prints: list[np.ndarray], at: np.ndarray, period: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretch around ``at`` in which words ``period`` apart are equal."""
    left, right = at.copy(), at.copy()
    for level in range(len(prints) - 1, -1, -1):
        width, names = 1 << level, prints[level]
        inside = np.flatnonzero(right + period + width <= size)
        go = inside[names[right[inside]] == names[right[inside] + period[inside]]]
        right[go] += width
        inside = np.flatnonzero(left >= width)
        back = left[inside] - width
        go = inside[names[back] == names[back + period[inside]]]
        left[go] -= width
    return left, right + period


def _proposals(names: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances, from ``low`` to ``high``, of neighbours with equal context.

    Of a chain of equal distances, which lies in one run, only the first is given.
    """
    order = np.argsort(names, kind="stable")
    names, at = names[order], at[order]
    apart = np.diff(at)
    fits = (names[1:] == names[:-1]) & (apart >= low) & (apart <= high)
    first = fits.copy()
    first[1:] &= ~(fits[:-1] & (apart[1:] == apart[:-1]))
    return at[:-1][first], apart[first]


def _selected(prints: list[np.ndarray], level: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising positions of the scale, in ascending order."""
    scale = 1 << level
    own = prints[level].copy()
    own[periodic[: len(own)]] = _NONE
    if len(own) <= scale:
        return np.empty(0, np.int64)
    least = own
    for step in range(level):
        least = np.minimum(least[: -(1 << step)], least[1 << step :])
    least = np.minimum(least[: len(own) - scale], own[scale:])
    taken = (least != _NONE) & ((own[: len(least)] == least) | (own[scale:] == least))
    return np.flatnonzero(taken)


def find_runs(words: np.ndarray, longest: int, exponent: int = 4, least: int = 6) -> np.ndarray:
    """(start, end, period) of the runs with at least ``exponent`` >= 3 periods and ``least`` words.

    ``words`` are numbers; texts are parted by numbers that occur once. ``longest`` bounds the words of a
    text. Rows are ordered by start, then period. A period is the smallest of its stretch.
    """
    size = len(words)
    found = np.empty((0, 3), np.int64)
    if size < 3:
        return found
    prints = _dyadic(words, longest)
    level = 0
    while (9 * (1 << level) - 3) // 2 <= longest and level < len(prints):
        scale = 1 << level
        known = found[(3 * found[:, 2] <= scale) & (found[:, 1] - found[:, 0] >= scale)]
        marks = np.zeros(size + 1, np.int32)
        np.add.at(marks, known[:, 0], 1)
        np.add.at(marks, known[:, 1] - scale + 1, -1)
        at = _selected(prints, level, np.cumsum(marks) > 0)
        proposed = []
        if level + 1 < len(prints):
            double = prints[level + 1]
            two = at[at < len(double)]
            proposed.append(_proposals(double[two], two, 1, 2 * scale))
            three = two[two + 3 * scale <= size]
            context = _joined(double[three], prints[level][three + 2 * scale])
            proposed.append(_proposals(context, three, 2 * scale + 1, 3 * scale - 1))
        for at, period in proposed:
            start, end = _extended(prints, at, period, size)
            long = end - start >= 3 * period
            found = np.concatenate([found, np.stack([start[long], end[long], period[long]], 1)])
        if len(found):
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            same = (found[1:, 0] == found[:-1, 0]) & (found[1:, 1] == found[:-1, 1])
            found = found[np.concatenate([[True], ~same])]  # the smallest period of a stretch
        level += 1
    length = found[:, 1] - found[:, 0]
    found = found[(length >= exponent * found[:, 2]) & (length >= least)]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _by_size(texts: list[list[bytes]]) -> Iterator[list[int]]:
    """Text numbers, together with those of like length, so that short texts skip the large scales."""
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(texts):
        classes.setdefault(len(words).bit_length(), []).append(i)
    yield from classes.values()


def runs_of(texts: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[np.ndarray]:
    """The runs of every text, as rows (start, end, period)."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    for group in _by_size(texts):
        longest = max(len(texts[i]) for i in group)
        if longest < least:
            continue
        number: dict[bytes, int] = {}
        words, starts = [], []
        for turn, i in enumerate(group):
            starts.append(len(words))
            words.extend([number.setdefault(w, len(number)) for w in texts[i]])
            words.append(-1 - turn)
        found = find_runs(np.array(words, np.int64), longest, exponent, least)
        owner = np.searchsorted(starts, found[:, 0], side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(group) + 1))
        for turn in np.flatnonzero(np.diff(cuts)):
            rows = found[cuts[turn] : cuts[turn + 1]].copy()
            rows[:, :2] -= starts[turn]
            out[group[turn]] = rows
    return out


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words outside the repeats: of each run only the first period stays, unless another run drops it."""
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed: the text without its repeats.

    Words are what ASCII white space separates; ``collapsed`` joins the kept ones by single blanks. Texts are
    read whole, one task per partition, without a shuffle: memory grows with the longest text only.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows that repeat, also with one
    id, and rows without an id are answered each. An empty table gives none. Other columns are left behind.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in text_groups(batch):
                texts = [t.encode("utf-8", "surrogatepass").split() for t in group]
                found = runs_of(texts, exponent, least)
                sizes = np.array([len(r) for r in found])
                rows = np.concatenate(found)
                values = pa.StructArray.from_arrays(
                    [pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(RUN)
                )
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
                collapsed = [
                    b" ".join(_kept(w, r) if len(r) else w).decode("utf-8", "surrogatepass")
                    for w, r in zip(texts, found, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(group)),
                        pa.array([len(w) for w in texts], pa.int64()),
                        runs,
                        pa.array(collapsed, pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return id_and_text(docs, id_col, text_col).mapInArrow(answer, kind)
