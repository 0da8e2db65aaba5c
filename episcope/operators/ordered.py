"""Running values over ordered groups, without ever putting a large group into one task.

``ordered_scan`` gives row numbers, running totals, previous/next values and fills inside
``keys`` in the order of ``order``. The rows are dealt by range of (keys, order) and written once to
the shared folder, with the number of their range as ``_block``. (The range shuffle draws a sample first, so
what stands before it in the plan runs twice; a costly input is best written before.) Windows then run per key
and block, and one small table carries totals and edge values from block to block for the keys that lie in
more than one. There is one path for every size, and what it returns does not depend on where the ranges end.

Several scans over the same order share one deal: ``deal`` gives the dealt rows, ``running`` adds
columns to them and keeps them dealt, ``Dealt.done`` takes the rows out.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.functions.columns import col
from episcope.session import written

_ALL = "_all"
_BLOCK = "_block"
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)

Values = Mapping[str, "Column | str"]


@dataclass(frozen=True)
class Dealt:
    """Rows with ``_block``, ranges of (keys, order), and the keys that lie in more than one block."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    spanning: DataFrame | None
    unkeyed: bool = False

    def done(self) -> DataFrame:
        return self.rows.drop(_BLOCK, _ALL) if self.unkeyed else self.rows.drop(_BLOCK)

    def over(self, rows: DataFrame) -> Dealt:
        """The same deal for rows made from these, row by row, with their keys, order and block."""
        return replace(self, rows=rows)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` as a written table, dealt by range of (keys, order), with ``_block``, the number of the range."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return written(ranged.withColumn(_BLOCK, F.spark_partition_id()), f"ordered-{uuid.uuid4().hex}")


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Dealt:
    """Deal ``df`` for scans in ``order`` inside ``keys``; all its columns are written, so hand in narrow rows."""
    unkeyed = not keys
    if unkeyed:
        df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
    rows = dealt(df, keys, order)
    return Dealt(rows, tuple(keys), tuple(order), _spanning(rows, keys), unkeyed)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], **wanted) -> DataFrame:
    """Deal ``df`` and add the running columns that ``running`` names; ``order`` must be unique inside ``keys``."""
    return running(deal(df, keys, order), **wanted).done()


def running(
    source: Dealt,
    *,
    number: str | None = None,
    sums: Values | None = None,
    totals: Values | None = None,
    lags: Values | None = None,
    leads: Values | None = None,
    fills: Values | None = None,
    backfills: Values | None = None,
) -> Dealt:
    """Add running columns to dealt rows.

    ``number``: ordinal from 1. ``sums``: running total up to and with the row (null counts as 0).
    ``totals``: total over the key. ``lags`` / ``leads``: value of the previous / next row. ``fills`` /
    ``backfills``: nearest non-null value at or before / at or after the row. Sums and totals take whole
    numbers and decimals only, since floating sums depend on where blocks end.
    """
    keys, order = source.keys, source.order
    groups = [dict(g or {}) for g in (sums, totals, lags, leads, fills, backfills)]
    named = {out: f"_v_{out}" for g in groups for out in g}
    work = source.rows.withColumns({named[out]: col(c) for g in groups for out, c in g.items()})
    sums_, totals_, lags_, leads_, fills_, backfills_ = groups
    summed = {o: named[o] for o in (*sums_, *totals_)}
    inexact = [o for o, c in summed.items() if not isinstance(work.schema[c].dataType, _EXACT)]
    if inexact:
        raise ValueError(f"running sums take whole numbers or decimals: {inexact}")
    if summed:
        work = work.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in summed.values()})
    window = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    to_here = window.rowsBetween(Window.unboundedPreceding, 0)
    # In backward order, since a frame that ends with the group is evaluated anew for every row of it.
    backward = Window.partitionBy(*keys, _BLOCK).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    from_here = backward.rowsBetween(Window.unboundedPreceding, 0)

    local: dict[str, Column] = {}
    if number:
        local[number] = F.row_number().over(window).cast("long")
    for o in sums_:
        local[o] = F.sum(named[o]).over(to_here)
    for o in totals_:
        local[o] = F.sum(named[o]).over(Window.partitionBy(*keys, _BLOCK))
    for o in lags_:
        local[o] = F.lag(named[o]).over(window)
    for o in leads_:
        local[o] = F.lead(named[o]).over(window)
    for o in fills_:
        local[o] = F.last(named[o], ignorenulls=True).over(to_here)
    for o in backfills_:
        local[o] = F.last(named[o], ignorenulls=True).over(from_here)
    if lags_:
        local["_first"] = F.lag(F.lit(1)).over(window).isNull()
    if leads_:
        local["_last"] = F.lead(F.lit(1)).over(window).isNull()
    replaced = [n for n in local if n in work.columns and n not in (*keys, *order)]
    out = work.select("*", *[c.alias(f"_o_{n}") for n, c in local.items()]).drop(*replaced)
    out = out.withColumnsRenamed({f"_o_{n}": n for n in local})
    if source.spanning is not None:
        out = _carry_over_blocks(work, out, source, named, number, groups)
    return source.over(out.drop(*named.values(), "_first", "_last"))


def _spanning(rows: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys that lie in more than one block, or None; each block can add one at most, where it ends.

    Such a key is the smallest or the largest of every block it is in. One row per block reaches the driver.
    """
    ends = rows.groupBy(_BLOCK).agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
    at_end = ends.select(_BLOCK, F.explode(F.array("lo", "hi")).alias("k"))
    wide = at_end.groupBy("k").agg(F.min(_BLOCK).alias("a"), F.max(_BLOCK).alias("b")).where("a < b").select("k.*")
    found = wide.collect()
    return _renamed(rows.sparkSession.createDataFrame(found, wide.schema), keys) if found else None


def _carry_over_blocks(work, out, source: Dealt, named, number, groups) -> DataFrame:
    keys, order, spanning = source.keys, source.order, source.spanning
    sums, totals, lags, leads, fills, backfills = groups
    at = F.struct(*order)
    edges: dict[str, Column] = {"_n": F.count(F.lit(1))}
    for o in (*sums, *totals):
        edges[f"_e_{o}"] = F.sum(named[o])
    for o in lags:
        edges[f"_e_{o}"] = F.max_by(named[o], at)
    for o in leads:
        edges[f"_e_{o}"] = F.min_by(named[o], at)
    for o in fills:
        edges[f"_e_{o}"] = F.max_by(named[o], F.when(F.col(named[o]).isNotNull(), at))
    for o in backfills:
        edges[f"_e_{o}"] = F.min_by(named[o], F.when(F.col(named[o]).isNotNull(), at))
    inside = work
    if not source.unkeyed:  # Bounded: fewer keys than blocks span two.
        inside = work.join(F.broadcast(spanning), _same_keys(work, spanning, keys), "left_semi")
    blocks = inside.groupBy(*keys, _BLOCK).agg(*[c.alias(n) for n, c in edges.items()])
    # One row per block of a spanning key, so this window is small.
    window = Window.partitionBy(*keys).orderBy(_BLOCK)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    after = window.rowsBetween(1, Window.unboundedFollowing)
    carried: dict[str, Column] = {"_c_n": F.sum("_n").over(before)}
    for o in sums:
        carried[f"_c_{o}"] = F.sum(f"_e_{o}").over(before)
    for o in totals:
        carried[f"_c_{o}"] = F.sum(f"_e_{o}").over(Window.partitionBy(*keys))
    for o in lags:
        carried[f"_c_{o}"] = F.lag(f"_e_{o}").over(window)
    for o in leads:
        carried[f"_c_{o}"] = F.lead(f"_e_{o}").over(window)
    for o in fills:
        carried[f"_c_{o}"] = F.last(f"_e_{o}", ignorenulls=True).over(before)
    for o in backfills:
        carried[f"_c_{o}"] = F.first(f"_e_{o}", ignorenulls=True).over(after)
    joint = [*keys, _BLOCK]
    carry = _renamed(blocks.select(*joint, *[c.alias(n) for n, c in carried.items()]), joint)
    # Bounded: at most two rows per block.
    merged = out.join(F.broadcast(carry), _same_keys(out, carry, joint), "left")
    final: dict[str, Column] = {}
    if number:
        final[number] = F.col(number) + F.coalesce("_c_n", F.lit(0))
    for o in sums:
        final[o] = F.col(o) + F.coalesce(f"_c_{o}", F.lit(0))
    for o in totals:
        final[o] = F.coalesce(f"_c_{o}", o)
    for o in lags:
        final[o] = F.when(F.col("_first"), F.col(f"_c_{o}")).otherwise(F.col(o))
    for o in leads:
        final[o] = F.when(F.col("_last"), F.col(f"_c_{o}")).otherwise(F.col(o))
    for o in [*fills, *backfills]:
        final[o] = F.coalesce(o, f"_c_{o}")
    return merged.withColumns(final).drop(*carried, *[f"_r_{k}" for k in joint])


#: Ranks that the first pass of ``exact_quantiles`` may be off by, as a share of the values.
_RANK_SHARE = 1 / 5_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column | str, wanted: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per key; null and NaN values are left out.

    A first pass takes mergeable quantile summaries, whose ranks are off by a known share at most. That gives
    bounds around each quantile. A second pass counts what lies below and above them and keeps the values
    between them, counted per distinct value; their running counts show the two ranks around the quantile.
    """
    keys, named = list(keys), list(wanted)
    # Missing values become null, which aggregates do not see. A filter here would be pushed below the
    # projection and repeat a long value expression at every level.
    rows = df.select(*keys, col(value).cast("double").alias("_v")).select(
        *keys, F.when(~F.isnan("_v"), F.col("_v")).alias("_x")
    )
    near = [min(1.0, max(0.0, q + side * 2 * _RANK_SHARE)) for q in wanted.values() for side in (-1, 1)]
    bounds = rows.groupBy(*keys).agg(
        F.count("_x").alias("_total"), F.percentile_approx("_x", [float(q) for q in near], int(1 / _RANK_SHARE)).alias("_near")
    )
    spans = [
        F.struct(
            F.lit(n).alias("name"), F.get("_near", F.lit(2 * i)).alias("low"), F.get("_near", F.lit(2 * i + 1)).alias("high"),
            ((F.col("_total") - 1) * F.lit(float(q))).alias("place"),
        )
        for i, (n, q) in enumerate(wanted.items())
    ]
    bounds = written(bounds.select(*keys, F.array(*spans).alias("_spans")), f"bounds-{uuid.uuid4().hex}")
    if keys:
        right = _renamed(bounds, keys)
        met = rows.join(right, _same_keys(rows, right, keys)).drop(*[f"_r_{k}" for k in keys])
    else:
        met = rows.crossJoin(F.broadcast(bounds))  # one row
    met = met.select(*keys, "_x", F.explode("_spans").alias("_s"))
    # Of the values below the bounds only the number and the largest matter, of those above only the smallest.
    # Missing values make a group that counts nothing.
    side = F.when(F.col("_x") < F.col("_s.low"), -1).when(F.col("_x") > F.col("_s.high"), 1).otherwise(0)
    inside = F.when(side == 0, F.col("_x"))
    counted = met.groupBy(*keys, F.col("_s.name").alias("_name"), F.col("_s.place").alias("_place"), side.alias("_side"), inside.alias("_at")).agg(
        F.count("_x").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most")
    )
    by = [*keys, "_name"]
    ranked = ordered_scan(counted, by, ["_side", "_at"], sums={"_upto": "_n"})
    start, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    off = F.raise_error(F.lit("a quantile lies outside its bounds")).cast("double")
    picks = []
    for name, rank in (("lo", F.floor("_place")), ("hi", F.ceil("_place"))):
        seen = (
            F.when(F.col("_side") == 0, F.col("_at"))
            .when((F.col("_side") < 0) & (rank == last), F.col("_most"))
            .when((F.col("_side") > 0) & (rank == start), F.col("_least"))
            .otherwise(off)
        )
        picks.append(F.max(F.when((rank >= start) & (rank <= last), seen)).alias(f"_{name}"))
    found = ranked.groupBy(*by).agg(*picks, F.max("_place").alias("_place"))
    lo, hi, part = F.col("_lo"), F.col("_hi"), F.col("_place") - F.floor("_place")
    between = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * part)
    found = found.select(*keys, "_name", between.alias("_q"))
    taken = [F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in named]
    found = found.groupBy(*keys).agg(*taken)
    if not keys:
        return found
    # Keys without any value have null quantiles.
    every, right = bounds.select(*keys), _renamed(found, keys)
    return every.join(right, _same_keys(every, right, keys), "left").select(*keys, *named)
