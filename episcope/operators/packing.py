"""Greedy packing of ordered items into files under a size cap, as distributed jobs.

Whether an item opens a file depends on where the file before it began, so the file starts form a
chain. With running sizes known, each item's successor in that chain is a lookup. Blocks of items
then shorten the chain (each item learns where the chain leaves its block), a doubling join finds
the entry item of every block, and one more pass over the blocks marks the starts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.operators.ordered import Dealt, deal, ordered_scan, running
from episcope.session import written

BLOCK_ITEMS = 500_000
CHUNK_FILES = 1_000  # fixed value: files per chunk folder


def _table(df: DataFrame, what: str) -> DataFrame:
    return written(df, f"packing-{what}-{uuid.uuid4().hex}")


def _successors(items: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """``_next``: the first later item at which the size counted from this item reaches the cap."""
    probes = items.select(*keys, (F.col("_p") - F.col("_size") + cap).alias("_v"), F.lit(0).alias("_side"), "_k")
    marks = items.select(*keys, F.col("_p").alias("_v"), F.lit(1).alias("_side"), "_k")
    found = ordered_scan(
        probes.unionByName(marks), keys, ["_v", "_side", "_k"],
        backfills={"_hit": F.when(F.col("_side") == 1, F.col("_k"))},
    )
    last = items.groupBy(*keys).agg(F.max("_k").alias("_last"))
    own = found.where(F.col("_side") == 0).join(last, list(keys))
    # An item that alone reaches the cap is followed by its direct neighbour, if there is one.
    nxt = F.greatest(F.col("_hit"), F.col("_k") + 1)
    return own.select(
        *keys, "_k", F.when(F.col("_hit").isNotNull() & (nxt <= F.col("_last")), nxt).otherwise(-1).alias("_next")
    )


def _leave_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each item first leaves the block (-1: it ends)."""
    pdf = pdf.sort_values("_k")
    base, n = int(pdf["_k"].iloc[0]), len(pdf)
    out = pdf["_next"].to_numpy().copy()
    while True:
        inside = (out >= 0) & (out < base + n)
        if not inside.any():
            break
        out[inside] = out[out[inside] - base]
    return pdf.assign(_exit=out)


def _walk_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mark the chain items of a block from its entry."""
    pdf = pdf.sort_values("_k")
    base, n = int(pdf["_k"].iloc[0]), len(pdf)
    nxt = pdf["_next"].to_numpy()
    marks = np.zeros(n, dtype=bool)
    entries = np.flatnonzero(pdf["_entry"].to_numpy())
    at = int(entries[0]) if len(entries) else -1
    while 0 <= at < n:
        marks[at] = True
        at = int(nxt[at]) - base if nxt[at] >= 0 else -1
    return pdf[[c for c in pdf.columns if c not in ("_next", "_entry")]].assign(_start=marks)


def _mark_chain(items: DataFrame, keys: Sequence[str], cap: int, first: DataFrame, block_items: int) -> DataFrame:
    """Add ``_start``: the item lies on the chain that begins at ``first`` (keys, _k)."""
    keys = list(keys)
    block = F.floor((F.col("_k") - 1) / block_items)
    chain = _successors(items, keys, cap).withColumn("_b", block)
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*keys).schema)
    entries = first.select(*keys, "_k")
    blocks = int((items.agg(F.max("_k")).first()[0] or 1) - 1) // block_items + 1
    if blocks > 1:
        chain = _table(chain, "chain")
        # Blocks hold at most block_items rows, whatever the key.
        jumps = chain.groupBy(*keys, "_b").applyInPandas(
            _leave_block, f"{key_types}, _k long, _next long, _b long, _exit long"
        ).select(*keys, "_k", "_exit").where(F.col("_exit") >= 0)
        jumps = _table(jumps, "jumps")
        rounds = math.ceil(math.log2(blocks))
        for i in range(rounds):
            hop = entries.join(jumps, [*keys, "_k"]).select(*keys, F.col("_exit").alias("_k"))
            entries = _table(entries.unionByName(hop).distinct(), f"entries{i}")
            if i + 1 < rounds:
                onward = jumps.select(*keys, F.col("_k").alias("_exit"), F.col("_exit").alias("_far"))
                jumps = _table(
                    jumps.join(onward, [*keys, "_exit"]).select(*keys, "_k", F.col("_far").alias("_exit")), f"jumps{i}"
                )
    flagged = chain.join(entries.withColumn("_entry", F.lit(True)), [*keys, "_k"], "left").withColumn(
        "_entry", F.coalesce("_entry", F.lit(False))
    )
    marks = flagged.groupBy(*keys, "_b").applyInPandas(
        _walk_block, f"{key_types}, _k long, _b long, _start boolean"
    )
    return _table(items.join(marks.drop("_b", "_block"), [*keys, "_k"]), "marked")


def _numbered(items: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> Dealt:
    """Items with ``_k`` and the running size ``_p``; all later scans go on with this deal."""
    base = items.withColumn("_size", F.col(size).cast("long"))
    run = running(deal(base, keys, order), number="_k", sums={"_p": "_size"})
    return run.over(_table(run.rows, "items"))


def _file_columns(file: str, chunk_files: int) -> dict:
    return {
        "chunk_index": F.floor(F.col(file) / chunk_files),
        "file_index": (F.col(file) % chunk_files).cast("long"),
    }


def pack_data_files(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, length: str, cap: int,
    chunk_files: int = CHUNK_FILES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Assign items to data files and carry global row offsets.

    The item that reaches the cap keeps the current file number, and its size opens the next file.
    Adds ``chunk_index, file_index, dataset_from_index, dataset_to_index`` and, as
    ``faulty_from_index``, the start that a counter reset at each file change would give.
    """
    numbered = _numbered(items, keys, order, size)
    first = numbered.rows.where(F.col("_p") >= cap).groupBy(*keys).agg(F.min("_k").alias("_k"))
    marked = numbered.over(_mark_chain(numbered.rows, keys, cap, first, block_items))
    run = running(
        marked,
        sums={"_closings": F.col("_start").cast("long"), "dataset_to_index": length},
        lags={"_closed_before": "_start", "_previous_length": length},
    )
    rows = run.rows.withColumns(
        {
            "_file": F.col("_closings") - F.col("_start").cast("long"),
            "dataset_from_index": F.col("dataset_to_index") - F.col(length),
        }
    )
    # After a file change the faulty counter holds the length of the closing item only.
    previous_from = F.col("dataset_from_index") - F.col("_previous_length")
    based = running(run.over(rows), fills={"_base": F.when(F.col("_closed_before"), previous_from)})
    out = based.rows.withColumn(
        "faulty_from_index", F.col("dataset_from_index") - F.coalesce("_base", F.lit(0))
    ).withColumns(_file_columns("_file", chunk_files))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def pack_segments(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, cap: int, units_per_second: float,
    chunk_files: int = CHUNK_FILES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Assign media items to files; a file closes before the item that would reach the cap.

    Adds ``chunk_index, file_index`` and ``from_timestamp, to_timestamp``, which restart per file.
    """
    numbered = _numbered(items, keys, order, size)
    first = numbered.rows.groupBy(*keys).agg(F.min("_k").alias("_k"))
    marked = numbered.over(_mark_chain(numbered.rows, keys, cap, first, block_items))
    run = running(
        marked, sums={"_starts": F.col("_start").cast("long")},
        fills={"_origin": F.when(F.col("_start"), F.col("_p") - F.col("_size"))},
    ).rows.withColumn("_file", F.col("_starts") - 1)
    rate = F.lit(float(units_per_second))
    out = run.withColumns(
        {
            **_file_columns("_file", chunk_files),
            "from_timestamp": (F.col("_p") - F.col("_size") - F.col("_origin")) / rate,
            "to_timestamp": (F.col("_p") - F.col("_origin")) / rate,
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])
