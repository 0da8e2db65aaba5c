"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.session import ship_package, written

#: Texts are handed to vectorised code in groups of about this many characters.
GROUP_CHARS = 1_000_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a new table in the shared folder and read it back (cuts the lineage)."""
    return written(df, f"llm-{name}-{uuid.uuid4().hex}")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, as ``doc_id`` and ``text``; a null text is empty.

    Other columns, also ones named like an operator's results, are left behind here. An id that is no whole
    number becomes null where the session casts so (with ANSI casts it is an error).
    """
    ship_package(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def text_groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch as (first row, texts), cut so that each group has about GROUP_CHARS characters."""
    values = batch.column(column)
    first, group, chars = 0, [], 0
    for i in range(len(values)):
        text = values[i].as_py() or ""
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield first, group
            first, group, chars = i + 1, [], 0
    if group:
        yield first, group


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over unsigned integers, elementwise."""
    with np.errstate(over="ignore"):
        v = values + np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores added until no column has them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
