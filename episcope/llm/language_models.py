"""Cross-entropy difference between a target and a background model.

Both are bigram models over one vocabulary: every token of every document, and a sign for a text's ends.
The background counts all documents; the target counts those labelled as wanted. Pair counts have a
Dirichlet prior of weight ``prior`` around the token's own probability, which has one added to each count:

    P(b | a) = (n(ab) + prior * P(b)) / (n(a) + prior),   P(b) = (n(b) + 1) / (all + kinds)

A document's score is its cross-entropy per token under the target less that under the background: lower
is more like the target.

No model is gathered anywhere. Texts become chunks of token numbers, each with its own small table of
tokens. A chunk asks once for each of its n-grams (keys of 56 bits, sent as sorted steps); the questions
of a range of keys meet in one group, where counts are summed and go back to the chunks that asked, if
they differ from what a chunk counted itself. So a rare n-gram, which is most of them, costs one question
and no answer, and a common one costs a question per chunk. The ranges grow in number with the tokens of
the corpus, so a group keeps its size.

Defined results: a null or empty text is an end sign only; repeated rows count and score as rows; an
id with several labels is wanted if one says so; with no wanted document the target knows the shared
vocabulary only (all tokens alike); an empty table gives no rows. Two n-grams whose keys are equal
count as one (among 10^9 kinds this is expected for seven pairs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import id_and_text, mixed, saved, text_groups
from episcope.session import ship_package

#: A chunk is closed behind the text with which it has so many places.
CHUNK_PLACES = 1 << 20
#: Places of the corpus per range of keys.
RANGE_PLACES = 1 << 21
KEY_BITS = 56
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CHUNK = "chunk long, places long, doc_ids array<long>, lengths binary, tokens binary, words binary"
_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, as planes of bytes: those that are nearly always zero cost next to nothing."""
    planes = values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return _ZSTD.compress(np.ascontiguousarray(planes).tobytes())


def spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNZSTD.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def steps(rising: np.ndarray) -> bytes:
    """Rising numbers by what each adds to the one before."""
    return squeezed(np.diff(rising, prepend=np.uint64(0)))


def rising(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data), dtype=np.uint64)


def _width(kinds: int) -> type:
    return np.uint16 if kinds <= 1 << 16 else np.uint32


def _words_as_numbers(seen: dict[str, int], words: list[int]) -> tuple[bytes, bytes]:
    """A chunk's tokens as rising hashes, and its words as places among these (the sign for ends is the empty token)."""
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in seen], np.uint64)
    order = np.argsort(hashes)
    place = np.empty(len(order), _width(len(order)))
    place[order] = np.arange(len(order))
    return steps(hashes[order]), _ZSTD.compress(place[np.array(words)].tobytes())


def as_chunks(texts: DataFrame, places: int = CHUNK_PLACES) -> DataFrame:
    """Rows of many texts: ids, tokens per text, hashes of the chunk's tokens, and its words as their numbers.

    The words of all texts stand in one row of numbers, with the sign for ends before, between and behind them.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made = 0
        numbers: dict[str, int] = {"": 0}
        ids, lengths, words = [], [], [0]

        def out() -> pa.RecordBatch:
            kinds, numbered = _words_as_numbers(numbers, words)
            row = {"chunk": [first + made], "places": [len(words)], "doc_ids": pa.array([ids], pa.list_(pa.int64()))}
            row |= {"lengths": [squeezed(np.array(lengths))], "tokens": [kinds], "words": [numbered]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for at, group in text_groups(batch):
                for doc, text in zip(batch.column("doc_id")[at : at + len(group)].to_pylist(), group, strict=True):
                    found = [numbers.setdefault(t, len(numbers)) for t in tokens(text)]
                    ids.append(doc)
                    lengths.append(len(found))
                    words += found
                    words.append(0)
                    if len(words) > places:
                        yield out()
                        made += 1
                        numbers = {"": 0}
                        ids, lengths, words = [], [], [0]
        if ids:
            yield out()

    return texts.mapInArrow(number, _CHUNK)


class Grams:
    """The n-grams of a chunk: first its tokens, then its pairs, each kind once."""

    def __init__(self, tokens: bytes, words: bytes, lengths: bytes):
        hashes = rising(tokens)
        row = np.frombuffer(_UNZSTD.decompress(words), _width(len(hashes))).astype(np.int64)
        self.lengths = spread(lengths).astype(np.int64)
        self.second, self.kinds = row[1:], len(hashes)
        pairs, self.places = np.unique(row[:-1] * self.kinds + self.second, return_inverse=True)
        self.a, self.b = pairs // self.kinds, pairs % self.kinds
        # the last bit of a key tells pairs from tokens
        two = mixed(mixed(hashes)[self.a] + hashes[self.b])
        keys = np.concatenate([hashes, two]) >> np.uint64(64 - KEY_BITS)
        keys[: self.kinds] &= ~np.uint64(1)
        keys[self.kinds :] |= np.uint64(1)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """How often each n-gram occurs, in the order of keys; only in ``wanted`` texts if they are given."""
        inside = slice(None) if wanted is None else np.repeat(wanted, self.lengths + 1)
        single = np.bincount(self.second[inside], minlength=self.kinds)
        return np.concatenate([single, np.bincount(self.places[inside], minlength=len(self.a))])[self.order]

    def sections(self, bits: int) -> np.ndarray:
        """Where each range of keys begins, and the end."""
        inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits) if bits else np.empty(0, np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, inner), [len(self.keys)]])


def questions(chunks: DataFrame, bits: int) -> DataFrame:
    """part, chunk, keys, background, target: a chunk's n-grams of one range of keys, with its own counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                grams = Grams(at("tokens"), at("words"), at("lengths"))
                wanted = np.zeros(len(grams.lengths), bool)
                wanted[np.array(at("wanted") or [], np.int64)] = True
                counts = {"background": grams.counts(), "target": grams.counts(wanted)}
                ends = grams.sections(bits)
                used = np.flatnonzero(np.diff(ends))
                cut = lambda v, how: [how(v[ends[i] : ends[i + 1]]) for i in used]  # noqa: B023, E731
                named = {"part": used, "chunk": [at("chunk")] * len(used), "keys": cut(grams.keys, steps)}
                yield pa.RecordBatch.from_pydict(named | {c: cut(v, squeezed) for c, v in counts.items()})

    wanted = chunks.select("chunk", "tokens", "words", "lengths", "wanted")
    return wanted.mapInArrow(ask, "part long, chunk long, keys binary, background binary, target binary")


def _answers(asked: pa.Table) -> pa.Table:
    """Answers of one range of keys, by chunk: bits of the n-grams that have one, and the sums for these.

    Its first row also has the range's kinds of tokens and their sums.
    """
    read = lambda c, how: [how(x.as_py()) for x in asked.column(c)]
    keys = read("keys", rising)
    ends = np.cumsum([0, *map(len, keys)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    own = {c: np.concatenate(read(c, spread)).astype(np.int64) for c in ("background", "target")}
    # sums of whole numbers below 2**53 are exact
    sums = {c: np.bincount(place, weights=v).astype(np.int64) for c, v in own.items()}
    background, target = sums["background"][place], sums["target"][place]
    differ = (background != own["background"]) | (target != 0)
    out: dict[str, list] = {"chunk": asked.column("chunk").to_pylist(), "part": asked.column("part").to_pylist()}
    spans = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out["answered"] = [np.packbits(differ[s]).tobytes() for s in spans]
    for name, values in (("background", background), ("target", target)):
        out[name] = [squeezed(values[s][differ[s]]) for s in spans]
    single = (distinct & np.uint64(1)) == 0
    totals = {"kinds": int(single.sum()), "all_background": int(sums["background"][single].sum()), "all_target": int(sums["target"][single].sum())}
    for name, value in totals.items():
        out[name] = [value] + [0] * (len(spans) - 1)
    return pa.table(out)


def answers(asked: DataFrame) -> DataFrame:
    schema = "chunk long, part long, answered binary, background binary, target binary, kinds long, all_background long, all_target long"
    return asked.groupBy("part").applyInArrow(_answers, schema)


def _log_probabilities(grams: Grams, counts: np.ndarray, kinds: int, total: int, prior: float) -> np.ndarray:
    """Of each kind of pair of a chunk, from counts in the order of keys."""
    n = np.empty(len(counts), np.float64)
    n[grams.order] = counts
    single, pair = n[: grams.kinds], n[grams.kinds :]
    return np.log((pair + prior * (single[grams.b] + 1.0) / (total + kinds)) / (single[grams.a] + prior))


def cross_entropy_difference(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", wanted_value: int = 1, folds: int = 5,
    prior: float = 100.0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, target, background (nats per token), difference, for every row.

    Labels of fold 0 (checksum of the id modulo ``folds``) are not learned from.
    """
    ship_package(docs.sparkSession)
    held = lambda c: F.coalesce(F.crc32(c.cast("string")) % folds == 0, F.lit(False))
    wanted = (
        labels.filter((F.col(label_col) == wanted_value) & ~held(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    )
    chunks = saved(as_chunks(id_and_text(docs, id_col, text_col)), "models-chunks")
    # labels meet ids and places only; texts and their numbers do not move for them
    places = chunks.select("chunk", F.posexplode("doc_ids").alias("place", "doc_id")).filter("doc_id is not null")
    marks = places.join(wanted, "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("wanted"))
    marks = saved(marks, "models-marks")  # a few bytes a wanted text: while that is small, chunks need not move
    size = chunks.agg(F.sum("places").alias("n")).first()["n"] or 0
    bits = (size // RANGE_PLACES).bit_length()
    found = saved(answers(questions(chunks.join(marks, "chunk", "left"), bits)), "models-answers")
    totals = found.agg(*(F.sum(c).alias(c) for c in ("kinds", "all_background", "all_target"))).first()
    kinds, all_background, all_target = (int(x or 0) for x in totals)

    def score(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        at = lambda c: chunk.column(c)[0].as_py()
        grams = Grams(at("tokens"), at("words"), at("lengths"))
        ends = grams.sections(bits)
        background, target = grams.counts(), np.zeros(len(grams.keys), np.int64)
        for row in answered.select(["part", "answered", "background", "target"]).to_pylist():
            first, end = ends[row["part"]], ends[row["part"] + 1]
            told = first + np.flatnonzero(np.unpackbits(np.frombuffer(row["answered"], np.uint8), count=int(end - first)))
            background[told] = spread(row["background"])
            target[told] = spread(row["target"])
        starts = np.concatenate([[0], np.cumsum(grams.lengths + 1)[:-1]])
        out = {"doc_id": chunk.column("doc_ids").combine_chunks().flatten(), "n_tokens": pa.array(grams.lengths, pa.int64())}
        for name, counts, total in (("target", target, all_target), ("background", background, all_background)):
            logs = _log_probabilities(grams, counts, kinds, total, prior)[grams.places]
            out[name] = pa.array(-np.add.reduceat(logs, starts) / (grams.lengths + 1), pa.float64())
        return pa.table(out)

    sides = chunks.drop("places").groupBy("chunk").cogroup(found.drop("kinds", "all_background", "all_target").groupBy("chunk"))
    scored = sides.applyInArrow(score, "doc_id long, n_tokens long, target double, background double")
    return scored.select(
        "doc_id", held(F.col("doc_id")).alias("held_out"), "n_tokens", "target", "background",
        (F.col("target") - F.col("background")).alias("difference"),
    )
