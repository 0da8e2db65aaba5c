"""Packing against a plain loop, in one block and in many."""

import numpy as np
import pandas as pd
import pytest

from episcope.operators import packing as Q

CAP = 100


def items():
    rng = np.random.default_rng(11)
    parts = []
    for name, n in (("a", 900), ("b", 7), ("c", 1), ("d", 350)):
        size = rng.integers(0, 60, n)
        size[rng.random(n) < 0.05] = 250  # alone above the cap
        size[rng.random(n) < 0.1] = 0
        parts.append(pd.DataFrame({"source": name, "id": np.arange(n) * 3, "size": size, "len": rng.integers(1, 9, n)}))
    return pd.concat(parts, ignore_index=True)


def loop_data(df):
    out = []
    for source, g in df.groupby("source"):
        acc, file, rows, faulty = 0, 0, 0, 0
        for r in g.itertuples():
            out.append((source, r.id, file, rows, rows + r.len, faulty))
            acc, rows, faulty = acc + r.size, rows + r.len, faulty + r.len
            if acc >= CAP:
                acc, file, faulty = r.size, file + 1, r.len
    return out


def loop_segments(df):
    out = []
    for source, g in df.groupby("source"):
        acc, file, held = 0, 0, 0
        for r in g.itertuples():
            if held and acc + r.size >= CAP:
                acc, file, held = 0, file + 1, 0
            out.append((source, r.id, file, acc / 2.0, (acc + r.size) / 2.0))
            acc, held = acc + r.size, held + 1
    return out


@pytest.mark.parametrize("block", [10_000, 64])
def test_data_files(spark, block):
    df = items()
    got = Q.pack_data_files(spark.createDataFrame(df), ["source"], ["id"], "size", "len", CAP, chunk_files=5, block_items=block).toPandas()
    rows = sorted(
        (r.source, r.id, r.chunk_index * 5 + r.file_index, r.dataset_from_index, r.dataset_to_index, r.faulty_from_index)
        for r in got.itertuples()
    )
    assert rows == sorted(loop_data(df))


@pytest.mark.parametrize("block", [10_000, 64])
def test_segments(spark, block):
    df = items()
    got = Q.pack_segments(spark.createDataFrame(df), ["source"], ["id"], "size", CAP, 2.0, chunk_files=5, block_items=block).toPandas()
    rows = sorted((r.source, r.id, r.chunk_index * 5 + r.file_index, r.from_timestamp, r.to_timestamp) for r in got.itertuples())
    assert rows == sorted(loop_segments(df))


def test_segments_when_split(spark, split_small):
    test_segments(spark, 64)
