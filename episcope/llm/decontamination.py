"""Benchmark passages in documents, with up to k edits.

A test item of m characters may differ by k = m * ``error_rate`` edits. Cut into k + 1 pieces, at least
one piece of it is untouched in any such occurrence (pigeonhole). All pieces of all items go into one
Aho-Corasick automaton, which finds exact piece hits in one pass over a document. A hit is verified
from the piece upwards: pieces form a binary tree, a node over c pieces may hold c - 1 edits, and an
occurrence must have a piece all of whose ancestors keep to that (again pigeonhole). Distances are
Myers' bit-parallel ones, a column per character in a few integer operations. So most chance hits end
at a few characters, and nothing within the budget is lost.

Texts and items are compared as lower-case words between single blanks. Items are sent to the workers in
blocks of at most ``block_chars`` characters, and each block goes over all documents.

Defined results: null or empty texts and items match nothing; items whose words are equal match alike,
under each id; a repeated document row is a row; of several places of an item in a text the one with
the fewest edits (then the first) is given; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import id_and_text
from episcope.session import ship_package

_WORD = re.compile(r"\w+")


def plain(text: str | None) -> str:
    """Words in lower case between single blanks, with a blank at both ends; empty if there is no word."""
    words = _WORD.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


class Pattern:
    """Myers' bit vectors of a string: the distance to substrings of a text."""

    def __init__(self, string: str):
        self.length = len(string)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(string):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << self.length) - 1, 1 << (self.length - 1)

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the substring nearest to the string, the first such; None if over ``most``."""
        up, down, distance, found = self.full, 0, self.length, None
        masks, full, top = self.masks, self.full, self.top
        for at, c in enumerate(text):
            match = masks.get(c, 0)
            diagonal = ((((match & up) + up) ^ up) | match | down) & full
            rise, fall = (down | ~(diagonal | up)) & full, up & diagonal
            if rise & top:
                distance += 1
            elif fall & top:
                distance -= 1
            rise, fall = rise << 1, fall << 1
            up = (fall | ~(diagonal | rise)) & full
            down = rise & diagonal & full
            if distance <= most and (found is None or distance < found[0]):
                found = (distance, at + 1)
        return found


class Item:
    """One test item: its pieces, and the tree over them."""

    def __init__(self, string: str, error_rate: float):
        self.string, self.edits = string, int(len(string) * error_rate)
        count = self.edits + 1
        self.cuts = [len(string) * i // count for i in range(count + 1)]
        self.patterns: dict[tuple[int, int], Pattern] = {}

    def pieces(self) -> list[tuple[int, str]]:
        return [(i, self.string[a:b]) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]

    def _above(self, piece: int) -> list[tuple[int, int]]:
        """Ranges of pieces from just above ``piece`` to the whole item."""
        path, lo, hi = [], 0, len(self.cuts) - 1
        while hi - lo > 1:
            path.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return path[::-1]

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int] | None:
        """(distance, end) of the item in ``text`` if ``piece`` at ``at`` belongs to an occurrence."""
        best = (0, at + self.cuts[piece + 1] - self.cuts[piece])
        for lo, hi in self._above(piece):
            budget = hi - lo - 1
            start = at - (self.cuts[piece] - self.cuts[lo]) - budget
            end = at + (self.cuts[hi] - self.cuts[piece]) + budget
            start = max(0, start)
            pattern = self.patterns.get((lo, hi))
            if pattern is None:
                pattern = self.patterns[lo, hi] = Pattern(self.string[self.cuts[lo] : self.cuts[hi]])
            found = pattern.best(text[start:end], budget)
            if found is None:
                return None
            best = (found[0], start + found[1])
        return best


class Matcher:
    """All items of a block; finds (item number, distance, start of the window's best end) in texts."""

    def __init__(self, strings: list[str], error_rate: float):
        self.items = [Item(s, error_rate) for s in strings]
        where: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.items):
            for piece, string in item.pieces():
                where.setdefault(string, []).append((number, piece))
        self.automaton = ahocorasick.Automaton()
        for string, places in where.items():
            self.automaton.add_word(string, (len(string), places))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Per item number the fewest edits and where the place ends."""
        found: dict[int, tuple[int, int]] = {}
        if not len(self.automaton) or not text:
            return found
        seen: dict[int, int] = {}  # item -> last place where an occurrence without edits began
        for last, (length, places) in self.automaton.iter(text):
            at = last - length + 1
            for number, piece in places:
                item = self.items[number]
                begins = at - item.cuts[piece]
                if seen.get(number) == begins or found.get(number, (1,))[0] == 0:
                    continue
                hit = item.verify(text, piece, at)
                if hit is not None:
                    found[number] = min(found.get(number, hit), hit)
                    seen[number] = begins
        return found


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items as (id, plain text), in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    rows = items.select(F.col(item_id).cast("long"), item_text).filter(F.col(item_text).isNotNull())
    for name, text in rows.orderBy(item_id, item_text).toLocalIterator():
        string = plain(text)
        if string:
            block.append((name, string))
            size += len(string)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_matches(
    docs: DataFrame, items: DataFrame, error_rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_chars: int = 2_000_000,
) -> DataFrame:
    """doc_id, item_id, distance (edits), item_chars for every item that occurs in a document."""
    schema = "doc_id long, item_id long, distance int, item_chars int"
    texts = id_and_text(docs, id_col, text_col)
    out = None
    for block in item_blocks(items, item_id, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, strings = zip(*sent.value, strict=True)
            matcher = Matcher(list(strings), error_rate)
            for batch in batches:
                rows = [
                    (doc, names[number], distance, len(strings[number]) - 2)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    for number, (distance, _) in sorted(matcher.find(plain(text.as_py())).items())
                ]
                a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(a, pa.int64()), "item_id": pa.array(b, pa.int64()),
                     "distance": pa.array(c, pa.int32()), "item_chars": pa.array(d, pa.int32())}
                )

        found = texts.mapInArrow(match, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_benchmark(
    docs: DataFrame, items: DataFrame, error_rate: float = 0.1, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_chars: int = 2_000_000,
) -> DataFrame:
    """Rows of ``docs`` in which no test item occurs; columns stay as they are."""
    ship_package(docs.sparkSession)
    for block in item_blocks(items, item_id, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast([s for _, s in block])

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                keep = [not matcher.find(plain(t.as_py())) for t in batch.column(text_col)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


__all__ = ["Matcher", "benchmark_matches", "without_benchmark", "plain"]
