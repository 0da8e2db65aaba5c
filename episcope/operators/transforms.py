"""Structure and value transforms for vectors and their tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.functions.columns import col

STD_FLOOR = 1e-6  # fixed value of the normalisation rule


# ---- names and structure ------------------------------------------------------------------------


def safe_names(df: DataFrame) -> DataFrame:
    """Slash names to flat names (``a/b`` becomes ``a__b``)."""
    return df.withColumnsRenamed({c: c.replace("/", "__") for c in df.columns if "/" in c})


def slash_names(df: DataFrame) -> DataFrame:
    """The inverse of ``safe_names``."""
    return df.withColumnsRenamed({c: c.replace("__", "/") for c in df.columns if "__" in c})


def repack(df: DataFrame, structure: Mapping[str, object], keep: Sequence[str] = ()) -> DataFrame:
    """Build a new structure from column paths; a nested mapping becomes a struct."""

    def build(node) -> Column:
        if isinstance(node, Mapping):
            return F.struct(*[build(v).alias(k) for k, v in node.items()])
        return F.col(node if "/" not in node else f"`{node}`")

    return df.select(*keep, *[build(v).alias(k) for k, v in structure.items()])


def renamed_by_pattern(names: Sequence[str], patterns: Mapping[str, str | None]) -> dict[str, str | None]:
    """Old to new names: a rule that fits a whole name renames it, ``None`` drops it; earlier rules win.

    The new names must form a tree of columns, with every leaf named once.
    """
    table: dict[str, str | None] = {old: old for old in names}
    for pattern, template in reversed(patterns.items()):  # the first rule is laid on last
        fits = {old: m for old in names if (m := re.fullmatch(pattern, old))}
        table |= {old: None if template is None else m.expand(template) for old, m in fits.items()}
    leaves = Counter(n for n in table.values() if n is not None)
    inner = {leaf[:at] for leaf in leaves for at, c in enumerate(leaf) if c == "/"}
    wrong = sorted(n for n, columns in leaves.items() if columns > 1 or n in inner)
    if wrong:
        raise ValueError(f"new names that several columns take or that hold other columns: {wrong}")
    return table


def rename_by_pattern(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    names = renamed_by_pattern(df.columns, patterns)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items() if new is not None])


def drop_string_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, T.StringType)])


def prompt_from_task(frames: DataFrame, tasks: DataFrame, default: str | None = None) -> DataFrame:
    """Join the task text as the prompt. A missing text takes ``default``, or fails the job."""
    names = tasks.select("task_index", F.col("task").alias("_prompt"))
    joined = frames.join(names, "task_index", "left")
    if default is None:
        checked = F.when(
            F.assert_true(F.col("_prompt").isNotNull(), F.lit("task index without text")).isNull(),
            F.col("_prompt"),
        )
        return joined.withColumn("prompt", checked).drop("_prompt")
    return joined.withColumn("prompt", F.coalesce("_prompt", F.lit(default))).drop("_prompt")


# ---- values -------------------------------------------------------------------------------------


def wide_stats(stats: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = ("mean", "std", "q01", "q99")) -> DataFrame:
    """Component rows to one row of metric arrays per key; the group size is the vector width."""
    packed = stats.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("component_index", *metrics))).alias("_c")
    )
    return packed.select(*keys, *[F.col(f"_c.{m}").alias(m) for m in metrics])


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the one row of statistics arrays to every row; more than one row fails the job, none gives nulls."""
    row = stats.select(F.struct(*stats.columns).alias("_row")).scalar()
    return df.withColumn("_stats", row).select(*[f"`{c}`" for c in df.columns], *[F.col("_stats")[c].alias(c) for c in stats.columns])


def _zip3(x: Column, a: Column, b: Column, rule) -> Column:
    return F.transform(x, lambda v, i: rule(v.cast("double"), F.get(a, i), F.get(b, i)))


def normalize(x: Column | str, mean: Column | str, std: Column | str) -> Column:
    return _zip3(col(x), col(mean), col(std), lambda v, m, s: (v - m) / (s + STD_FLOOR))


def unnormalize(x: Column | str, mean: Column | str, std: Column | str) -> Column:
    return _zip3(col(x), col(mean), col(std), lambda v, m, s: v * (s + STD_FLOOR) + m)


def normalize_quantile(x: Column | str, q01: Column | str, q99: Column | str) -> Column:
    return _zip3(col(x), col(q01), col(q99), lambda v, a, b: (v - a) / (b - a + STD_FLOOR) * 2.0 - 1.0)


def unnormalize_quantile(x: Column | str, q01: Column | str, q99: Column | str) -> Column:
    return _zip3(col(x), col(q01), col(q99), lambda v, a, b: (v + 1.0) / 2.0 * (b - a + STD_FLOOR) + a)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inverse transforms need every key that has statistics."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"statistics without a column: {missing}")
    return df


def run_length_mask(*dims: int) -> list[bool]:
    """``(2, -3)`` means two dimensions in, then three out."""
    return [d > 0 for d in dims for _ in range(abs(d))]


def _masked(actions: Column, state: Column, mask: Sequence[bool], sign: int) -> Column:
    flags = F.array(*[F.lit(float(sign) if m else 0.0) for m in mask])
    return F.transform(
        actions,
        lambda a, i: a.cast("double")
        + F.when(i < len(mask), F.get(flags, i) * F.get(state, i).cast("double")).otherwise(0.0),
    )


def delta_actions(actions: Column | str, state: Column | str, mask: Sequence[bool]) -> Column:
    """Subtract the state from the masked action dimensions."""
    return _masked(col(actions), col(state), mask, -1)


def absolute_actions(actions: Column | str, state: Column | str, mask: Sequence[bool]) -> Column:
    """Add the state back; the inverse of ``delta_actions``."""
    return _masked(col(actions), col(state), mask, 1)


def subsample(x: Column | str, stride: int) -> Column:
    return F.filter(col(x), lambda _, i: i % stride == 0)


def pad_to_dim(x: Column | str, dim: int) -> Column:
    c = col(x)
    filler = F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(c), F.lit(0)))
    return F.concat(F.transform(c, lambda v: v.cast("double")), filler)
