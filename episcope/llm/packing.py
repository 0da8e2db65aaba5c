"""Best-fit packing planned on the histogram of lengths.

The plan needs only how many pieces have each length (at most ``capacity`` numbers). Best fit
decreasing runs over counts: all pieces of a length go to open sequences in one step per group of
equal sequences, and a group is split at most once per length. The plan is a list of segments: so
many slots for length L, from rank r on, in these sequences at this offset. Pieces take the slot of
their rank among the pieces of their length.

Ranks need no ordered task per length: each task numbers its own pieces of every length, and the
counts per task and length, summed over tasks, give where a task's numbers start.

Defined results: a null or empty text is one piece with the closing id only; repeated rows are packed
as rows of their own; only documents longer than ``capacity`` are cut; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episcope.llm.common import id_and_text, saved, text_groups
from episcope.llm.encoders import encoder

SEGMENT_FIELDS = ("length", "first_rank", "per_sequence", "first_sequence", "offset")


def plan_slots(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit decreasing over counts; rows are SEGMENT_FIELDS, sorted by length and first rank."""
    spaces: dict[int, list[tuple[int, tuple | None]]] = {}  # free space -> (sequences, what is in them)
    full: list[tuple[int, tuple | None]] = []

    def keep(sequences: int, space: int, inside: tuple | None) -> None:
        if sequences:
            (spaces.setdefault(space, []) if space else full).append((sequences, inside))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = min((s for s in spaces if s >= length), default=capacity)
            groups = spaces.get(space)
            each = space // length
            if groups:
                sequences, inside = groups.pop()
                if not groups:
                    del spaces[space]
            else:
                sequences, inside = -(-left // each), None
            whole = min(sequences, left // each)
            keep(whole, space - each * length, (inside, length, each))
            left -= whole * each
            if left and whole < sequences:
                keep(1, space - left * length, (inside, length, left))
                whole, left = whole + 1, 0
            keep(sequences - whole, space, inside)

    segments, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for sequences, inside in full + [g for groups in spaces.values() for g in groups]:
        steps = []
        while inside:
            inside, length, each = inside
            steps.append((length, each))
        offset = 0
        for length, each in reversed(steps):
            segments.append((length, rank[length], each, sequence, offset))
            rank[length] += each * sequences
            offset += each * length
        sequence += sequences
    return np.asarray(sorted(segments), dtype=np.int64).reshape(-1, len(SEGMENT_FIELDS))


def pieces_of(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number within its task and length."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    fields = ("doc_id", "piece", "start", "length", "ids_crc32", "number")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at, texts in text_groups(batch):
                rows = []
                names = batch.column("doc_id")[at : at + len(texts)].to_pylist()
                for name, ids in zip(names, encoder(tokenizer).encode(texts), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        length = len(part) // 4
                        rows.append((name, piece, start // 4, length, zlib.crc32(part), seen[length]))
                        seen[length] += 1
                made = {f: pa.array(v, pa.int64()) for f, v in zip(fields, zip(*rows, strict=True), strict=True)}
                made["piece"] = made["piece"].cast(pa.int32())
                yield pa.RecordBatch.from_pydict(made | {"task": pa.array([task] * len(rows), pa.int32())})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, task int"
    return id_and_text(docs, id_col, text_col).mapInArrow(cut, schema)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row per piece.

    The pieces are written once, so that the numbers that tasks give stay as they are.
    """
    pieces = saved(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = plan_slots(histogram, capacity)
    from_row = np.searchsorted(plan[:, 0], np.arange(capacity + 2))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.empty(len(length), dtype=np.int64)
            for value in np.unique(length):
                own = length == value
                lo, hi = from_row[value], from_row[value + 1]
                row[own] = lo + np.searchsorted(plan[lo:hi, 1], rank[own], side="right") - 1
            place = rank - plan[row, 1]
            each = plan[row, 2]
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            out["sequence_id"] = pa.array(plan[row, 3] + place // each)
            out["offset"] = pa.array(plan[row, 4] + place % each * length)
            yield pa.RecordBatch.from_pydict(out)

    ranked = pieces.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("rank")
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(take, schema)
