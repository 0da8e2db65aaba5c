"""Walks over rows that lie sorted by a key inside a partition, one key at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def edges(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Row numbers at which a run of equal keys begins, and the number of rows. Keys hold no nulls."""
    rows = batch.num_rows
    changed = np.zeros(max(rows - 1, 0), bool)
    for name in keys:
        column = batch.column(name)
        changed |= np.asarray(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), bool)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), rows] if rows else []


def parts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for every stretch of equal keys in a batch; a key may come in several stretches."""
    for batch in batches:
        cuts = edges(batch, keys)
        for start, stop in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(start, stop - start)
            yield tuple(piece.column(k)[0].as_py() for k in keys), piece


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, all its rows). Only for keys whose rows are bounded by how they were dealt."""
    held, pieces = None, []
    for key, piece in parts(batches, keys):
        if pieces and key != held:
            yield held, pa.Table.from_batches(pieces)
            pieces = []
        held = key
        pieces.append(piece)
    if pieces:
        yield held, pa.Table.from_batches(pieces)
