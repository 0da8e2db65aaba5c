"""Scalar helpers: closeness, missing values, length-one cells, text prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tolerance rule of the data contracts.
ABSOLUTE_TOLERANCE = 1e-5
RELATIVE_TOLERANCE = 1e-7
TIME_TOLERANCE = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c).cast("double")
    return F.coalesce(
        ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)
    )


def close(a: Column, b: Column, absolute: float = ABSOLUTE_TOLERANCE) -> Column:
    """``|a-b| <= max(absolute, 1e-7 * max(|a|,|b|))``; a null or NaN side is never close."""
    a, b = a.cast("double"), b.cast("double")
    bound = F.greatest(F.lit(absolute), F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= bound), F.lit(False))


def clip(c: Column, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; NaN stays NaN (``least`` alone would turn it into ``high``)."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def nan_to_null(c: Column | str) -> Column:
    """Expectations treat NaN as missing."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def scalar_cell(c: Column | str) -> Column:
    """The value of a length-one array as a double, null for any other length."""
    c = col(c)
    return F.when(F.size(c) == 1, F.get(c, F.lit(0)).cast("double"))


def scalar_cell_bad(c: Column | str) -> Column:
    return F.coalesce(F.size(col(c)) != 1, F.lit(True))


def source_prefix(episode_id: Column | str) -> Column:
    """Text before the first slash; ``<empty>`` if there is no text."""
    c = col(episode_id)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("<empty>")).otherwise(
        F.split_part(c, F.lit("/"), F.lit(1))
    )


def task_text(tasks: Column | str) -> Column:
    """The only task of an episode, or an empty text."""
    c = col(tasks)
    return F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.lit(""))


def joined_tasks(tasks: Column | str) -> Column:
    return F.array_join(col(tasks), "|")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round for reports; adding zero turns a negative zero into a plain one."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def count_true(c: Column) -> Column:
    """Number of rows where ``c`` holds, zero for no rows."""
    return F.count_if(c)


def uniform_std(length: Column | str) -> Column:
    """Population standard deviation of a run of ``length`` consecutive integers."""
    n = col(length).cast("double")
    return F.when(n > 1, F.sqrt((n * n - 1) / 12)).otherwise(F.lit(0.0))


def image_sample_count(length: Column | str) -> Column:
    """How many frames of an episode go into its image statistics."""
    n = col(length)
    grown = F.floor(F.pow(n.cast("double"), F.lit(0.75))).cast("long")
    return F.greatest(F.least(n, F.lit(100)), F.least(grown, F.lit(10_000)))
