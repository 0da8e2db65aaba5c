"""Moments, quantiles and error analysis of vector components."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions.columns import close, count_true, finite, scalar_cell, uniform_std
from episcope.operators.ordered import exact_quantiles, ordered_scan
from episcope.session import ship_package, written

# Fixed values of the study design.
MOMENT_TOLERANCE = 1e-5
QUANTILE_FLOOR = 1e-3
HISTOGRAM_BINS = 5_000
EDGE_MARGIN = 1e-10
STD_FLOOR = 1e-6
COMPONENT = ("feature_group", "component_index")


# ---- shape ---------------------------------------------------------------------------------------


def vector_guard(df: DataFrame, vector: str, width: int) -> DataFrame:
    """One row of counters: wrong width, null elements, elements that are not finite."""
    v = F.col(vector)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_true(v.isNull()).alias("null_vectors"),
        count_true(F.size(v) != width).alias("wrong_width"),
        count_true(F.exists(v, lambda x: x.isNull())).alias("null_elements"),
        count_true(F.exists(v, lambda x: x.isNotNull() & ~finite(x))).alias("nonfinite_elements"),
        F.lit(dict(df.dtypes)[vector]).alias("vector_type"),
    )


def long_components(df: DataFrame, features: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Vectors to rows ``(keep, feature_group, component_index, x)`` in double precision."""
    groups = F.array(
        *[F.struct(F.lit(n).alias("feature_group"), F.col(c).alias("v")) for n, c in features.items()]
    )
    exploded = df.select(*keep, F.explode(groups).alias("_g")).select(
        *keep, "_g.feature_group", F.posexplode("_g.v").alias("component_index", "x")
    )
    return exploded.withColumns(
        {"component_index": F.col("component_index").cast("long"), "x": F.col("x").cast("double")}
    )


# ---- moments -------------------------------------------------------------------------------------


def vector_moments(long: DataFrame, keys: Sequence[str] = COMPONENT) -> DataFrame:
    """Count, mean, population std, and exact q01 / q99 per component."""
    moments = long.groupBy(*keys).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
    )
    return moments.join(exact_quantiles(long, keys, "x", {"q01": 0.01, "q99": 0.99}), list(keys))


def _std_of_squares(mean: Column, squares: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean))


def moments_by_squares(long: DataFrame, keys: Sequence[str] = COMPONENT, single_squares: bool = False) -> DataFrame:
    """Std as the root of mean square minus squared mean, clamped at zero.

    ``single_squares`` squares in single precision first, which puts a floor under the error.
    """
    square = F.col("x") * F.col("x")
    if single_squares:
        single = F.col("x").cast("float")
        square = (single * single).cast("double")
    sums = long.groupBy(*keys).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.avg(square).alias("_squares")
    )
    return sums.withColumn("std", _std_of_squares(F.col("mean"), F.col("_squares"))).drop("_squares")


def moments_merge(long: DataFrame, batch: str, keys: Sequence[str] = COMPONENT) -> DataFrame:
    """Moments per batch, then merged: within-batch spread plus spread of the batch means."""
    parts = long.groupBy(*keys, batch).agg(
        F.count("x").alias("_n"), F.avg("x").alias("_m"), F.var_pop("x").alias("_v")
    )
    overall = parts.groupBy(*keys).agg(
        F.sum("_n").alias("count"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("mean")
    )
    gap = F.col("_m") - F.col("mean")
    merged = parts.join(overall, list(keys)).groupBy(*keys, "count", "mean").agg(
        F.sum(F.col("_n") * (F.col("_v") + gap * gap)).alias("_m2")
    )
    return merged.withColumn("std", F.sqrt(F.col("_m2") / F.col("count"))).drop("_m2")


def merge_feature_stats(stats: DataFrame, keys: Sequence[str] = COMPONENT) -> DataFrame:
    """Data set statistics from per-episode ``count, mean, std, min, max``."""
    n = F.col("count")
    overall = stats.groupBy(*keys).agg(
        F.sum(n).alias("_total"), (F.sum(n * F.col("mean")) / F.sum(n)).alias("_mean"),
        F.min("min").alias("_min"), F.max("max").alias("_max"),
    )
    gap = F.col("mean") - F.col("_mean")
    pooled = stats.join(overall, list(keys)).groupBy(*keys, "_total", "_mean", "_min", "_max").agg(
        F.sum(n * (F.col("std") * F.col("std") + gap * gap)).alias("_m2")
    )
    return pooled.select(
        *keys, F.col("_total").alias("count"), F.col("_mean").alias("mean"),
        F.sqrt(F.col("_m2") / F.col("_total")).alias("std"), F.col("_min").alias("min"), F.col("_max").alias("max"),
    )


def histogram_quantile(long: DataFrame, wanted: Mapping[str, float], keys: Sequence[str] = COMPONENT,
                       bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Quantiles as the lower edge of the first of ``bins`` equal bins that reaches the rank."""
    spans = long.groupBy(*keys).agg(
        (F.min("x") - EDGE_MARGIN).alias("_lo"), (F.max("x") + EDGE_MARGIN).alias("_hi"), F.count("x").alias("_total")
    )
    # Written, so that the planner knows its size: one row per component and group, broadcast while that is small.
    spans = written(spans, f"spans-{uuid.uuid4().hex}")
    place = F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    binned = long.join(spans, list(keys)).groupBy(*keys, "_lo", "_hi", "_total", F.least(place, F.lit(bins - 1)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # At most `bins` rows per component.
    run = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = binned.withColumn("_upto", F.sum("_n").over(run))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return summed.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("_upto") >= F.lit(q) * F.col("_total"), F.col("_lo") + F.col("_bin") * width)).alias(n)
            for n, q in wanted.items()
        ],
        F.max(width).alias("bin_width"),
    )


# ---- replay orders and batches ------------------------------------------------------------------


def episode_orders(vectors: DataFrame, shifts: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Natural order plus permutations ``(a * k + b) mod n`` of the episodes, ``a`` coprime to ``n``."""
    episodes = vectors.select("episode_index").distinct()
    size = episodes.agg((F.max("episode_index") + 1).alias("_n"))
    n = F.col("_n")
    factor = F.lit(1)
    for prime in (13, 11, 7, 3):
        factor = F.when(n % prime != 0, prime).otherwise(factor)
    natural = F.struct(F.lit("natural").alias("order_name"), F.col("episode_index").alias("position"))
    moved = [
        F.struct(
            F.lit(f"shift{b}").alias("order_name"), ((factor * F.col("episode_index") + b) % n).alias("position")
        )
        for b in shifts
    ]
    return episodes.crossJoin(size).select(  # size is one row
        "episode_index", F.explode(F.array(natural, *moved)).alias("_o")
    ).select("_o.order_name", "episode_index", "_o.position")


def order_replay(vectors: DataFrame, orders: DataFrame, keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """Re-sequence episodes; frames keep their order inside an episode. ``ordinal`` counts from 0.

    Only numbers take part: ``order_name, episode_index, frame_index, ordinal`` and the ``keep`` columns.
    ``with_vectors`` joins the wide columns to the rows that are left in the end.
    """
    ranks = ordered_scan(
        vectors.select("episode_index", "frame_index", *keep), ["episode_index"], ["frame_index"], number="_rank"
    )
    lengths = ranks.groupBy("episode_index").agg(F.count(F.lit(1)).alias("_frames"))
    placed = ordered_scan(orders.join(lengths, "episode_index"), ["order_name"], ["position"], sums={"_stop": "_frames"})
    before = placed.select("order_name", "episode_index", (F.col("_stop") - F.col("_frames")).alias("_before"))
    ordered = ranks.join(before, "episode_index")
    return ordered.withColumn("ordinal", F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank")


def with_vectors(replayed: DataFrame, vectors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wide ``columns`` of the replayed rows, by episode and frame number."""
    return replayed.join(vectors.select("episode_index", "frame_index", *columns), ["episode_index", "frame_index"])


def with_batches(replayed: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """One copy of each (narrow) row per batch size, with its batch number and whether it leads the batch."""
    spread = replayed.withColumn("batch_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    return spread.withColumns(
        {
            "batch_ordinal": F.floor(F.col("ordinal") / F.col("batch_size")),
            "leads_batch": F.col("ordinal") % F.col("batch_size") == 0,
        }
    )


def first_of_batch(replayed: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The known fault: only the first row of each batch is consumed. Rows that lead no batch are not copied."""
    led = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: F.col("ordinal") % s == 0)
    spread = replayed.withColumn("batch_size", F.explode(led))
    return spread.withColumn("batch_ordinal", F.floor(F.col("ordinal") / F.col("batch_size")))


def coverage_count(replayed: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Vectors consumed by the faulty and the repaired reducer against the population."""
    return (
        with_batches(replayed, sizes)
        .groupBy("order_name", "batch_size")
        .agg(F.count(F.lit(1)).alias("population"), count_true(F.col("leads_batch")).alias("consumed_faulty"))
        .withColumn(
            "faulty_as_predicted",
            F.col("consumed_faulty") == F.ceil(F.col("population") / F.col("batch_size")),
        )
        .withColumn("full_coverage", F.col("consumed_faulty") == F.col("population"))
    )


CONDITION = ("arm", "order_name", "batch_size")
ARMS = ("first_row", "all_rows", "all_rows_single_squares", "all_rows_stable")
#: Rows that one task takes in at a time when batches are reduced (a multiple of every batch size).
STRETCH = 1024

_PARTIAL = (
    "order_name string, batch_size int, leading boolean, feature_group string, component_index long, "
    "n long, mean double, m2 double, squares double, single_squares double"
)


def _batch_moments(rows: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """n, mean, sum of squared deviations, mean square, and mean square of singles, per batch and component."""
    starts = np.arange(0, len(rows), size)
    n = np.diff(np.append(starts, len(rows)))[:, None].astype(float)
    wide = rows.astype(np.float64)
    mean = np.add.reduceat(wide, starts, axis=0) / n
    m2 = np.add.reduceat((wide - np.repeat(mean, n[:, 0].astype(int), axis=0)) ** 2, starts, axis=0)
    single = (rows.astype(np.float32) ** 2).astype(np.float64)
    return n, mean, m2, np.add.reduceat(wide * wide, starts, axis=0) / n, np.add.reduceat(single, starts, axis=0) / n


def _merged(n: np.ndarray, mean: np.ndarray, m2: np.ndarray, squares: np.ndarray, single: np.ndarray) -> tuple:
    """Batches of a stretch put together: spread inside the batches plus spread of their means."""
    total = n.sum()
    middle = (n * mean).sum(0) / total
    spread = m2.sum(0) + (n * (mean - middle) ** 2).sum(0)
    return int(total), middle, spread, (n * squares).sum(0) / total, (n * single).sum(0) / total


def _stretch_reducer(sizes: Sequence[int], features: Mapping[str, str]):
    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        order = table.column("order_name")[0].as_py()
        first = table.column("ordinal")[0].as_py()
        parts = []
        for name, column in features.items():
            values = table.column(column).combine_chunks()
            rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            for size in sizes:
                leads = rows[(-first) % size :: size]
                for leading, part, step in ((False, rows, size), (True, leads, 1)):
                    if len(part):
                        n, *found = _merged(*_batch_moments(part, step))
                        width = part.shape[1]
                        parts.append(pa.table({
                            "order_name": [order] * width, "batch_size": pa.array([size] * width, pa.int32()),
                            "leading": [leading] * width, "feature_group": [name] * width, "component_index": np.arange(width),
                            "n": pa.array([n] * width, pa.int64()),
                            **dict(zip(("mean", "m2", "squares", "single_squares"), found, strict=True)),
                        }))
        return pa.concat_tables(parts)

    return reduce


def condition_stats(replayed: DataFrame, vectors: DataFrame, sizes: Sequence[int], features: Mapping[str, str]) -> DataFrame:
    """Moments per arm, order, batch size and component, each from its own batches.

    The rows of an order are dealt to stretches of ``STRETCH`` ordinals, which hold whole batches of every size.
    A stretch gives moments that can be merged (n, mean, M2, mean squares), and stretches are merged by the
    same rule: arms differ in what the std is made of. ``first_row`` sees the leading row of each batch;
    ``all_rows`` differences mean squares, ``all_rows_single_squares`` squares in single precision first,
    ``all_rows_stable`` merges squared deviations.
    """
    if any(STRETCH % s for s in sizes):
        raise ValueError(f"batch sizes divide {STRETCH}")
    ship_package(vectors.sparkSession)
    wide = with_vectors(replayed, vectors, list(features.values()))
    stretch = F.floor(F.col("ordinal") / STRETCH).alias("_stretch")
    wide = wide.select("order_name", stretch, "ordinal", *features.values())
    keys = ["order_name", "batch_size", "leading", *COMPONENT]
    parts = wide.groupBy("order_name", "_stretch").applyInArrow(_stretch_reducer(sizes, features), _PARTIAL)
    parts = written(parts, f"stretches-{uuid.uuid4().hex}")  # read twice: for the means, and for the spread around them
    n = F.col("n")

    def weighted(name: str) -> Column:
        return (F.sum(n * F.col(name)) / F.sum(n)).alias(name)

    whole = parts.groupBy(*keys).agg(F.sum(n).alias("count"), *[weighted(c) for c in ("mean", "squares", "single_squares")])
    gap = F.col("mean") - F.col("_mean")
    spread = parts.join(whole.select(*keys, F.col("mean").alias("_mean")), keys).groupBy(*keys).agg(
        F.sum(F.col("m2") + n * gap * gap).alias("m2")
    )
    by_squares = _std_of_squares(F.col("mean"), F.col("squares"))
    arms = F.when(F.col("leading"), F.array(F.struct(F.lit("first_row").alias("arm"), by_squares.alias("std")))).otherwise(
        F.array(
            F.struct(F.lit("all_rows").alias("arm"), by_squares.alias("std")),
            F.struct(F.lit("all_rows_single_squares").alias("arm"), _std_of_squares(F.col("mean"), F.col("single_squares")).alias("std")),
            F.struct(F.lit("all_rows_stable").alias("arm"), F.sqrt(F.col("m2") / F.col("count")).alias("std")),
        )
    )
    out = whole.join(spread, keys).withColumn("_a", F.explode(arms))
    return out.select("_a.arm", "order_name", "batch_size", *COMPONENT, "count", "mean", "_a.std")


def condition_errors(stats: DataFrame, reference: DataFrame) -> DataFrame:
    """Component errors of mean and std against the float64 reference."""
    ref = reference.select(*COMPONENT, F.col("mean").alias("_rm"), F.col("std").alias("_rs"))
    return stats.join(ref, list(COMPONENT)).select(
        *CONDITION, *COMPONENT, F.abs(F.col("mean") - F.col("_rm")).alias("mean_error"),
        F.abs(F.col("std") - F.col("_rs")).alias("std_error"),
    )


def condition_cells(errors: DataFrame, tolerance: float = MOMENT_TOLERANCE) -> DataFrame:
    """Worst errors per condition and feature, and whether both are within the tolerance."""
    cells = errors.groupBy(*CONDITION, "feature_group").agg(
        F.max("mean_error").alias("max_mean_error"), F.max("std_error").alias("max_std_error")
    )
    return cells.withColumn(
        "within", (F.col("max_mean_error") <= tolerance) & (F.col("max_std_error") <= tolerance)
    )


def stats_error(stats: DataFrame, reference: DataFrame, keys: Sequence[str], by: Sequence[str],
                tolerance: float = MOMENT_TOLERANCE) -> DataFrame:
    """Worst errors of mean, std, q01, q99 per group, with the moment and the quantile verdicts."""
    names = ("mean", "std", "q01", "q99")
    ref = reference.select(*keys, *[F.col(n).alias(f"_r_{n}") for n in names])
    joined = stats.join(ref, list(keys))
    err = {n: F.abs(F.col(n) - F.col(f"_r_{n}")) for n in names}
    bound = F.greatest(F.lit(QUANTILE_FLOOR), 2.0 * F.col("bin_width"))
    return joined.groupBy(*by).agg(
        *[F.max(err[n]).alias(f"max_{n}_error") for n in names],
        F.bool_and((err["mean"] <= tolerance) & (err["std"] <= tolerance)).alias("moments_within"),
        F.bool_and((err["q01"] <= bound) & (err["q99"] <= bound)).alias("quantiles_within"),
        F.max(bound).alias("max_quantile_tolerance"),
    )


def published_crosscheck(recomputed: DataFrame, published: DataFrame, keys: Sequence[str], by: Sequence[str],
                         tolerance: float) -> DataFrame:
    """Recomputed statistics against the published companion table; missing rows fail."""
    pub = published.select(*keys, F.col("mean").alias("_pm"), F.col("std").alias("_ps"))
    joined = recomputed.join(pub, list(keys), "full_outer")
    err = F.greatest(F.abs(F.col("mean") - F.col("_pm")), F.abs(F.col("std") - F.col("_ps")))
    bad = F.col("mean").isNull() | F.col("_pm").isNull()
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("components"),
        F.max(err).alias("max_error"),
        count_true(bad).alias("unmatched"),
        F.bool_and(F.coalesce(err <= tolerance, F.lit(False)) & ~bad).alias("agrees"),
    )


def normalization_effect(vectors: DataFrame, vector: str, faulty: DataFrame, repaired: DataFrame,
                         keys: Sequence[str], component_threshold: float, l2_threshold: float) -> DataFrame:
    """How far z-scores move between two sets of statistics arrays ``(keys, mean, std)``."""
    a = faulty.select(*keys, F.col("mean").alias("_am"), F.col("std").alias("_as"))
    b = repaired.select(*keys, F.col("mean").alias("_bm"), F.col("std").alias("_bs"))
    rows = vectors.join(a, list(keys)).join(b, list(keys))

    def z(x: Column, i: Column, mean: str, std: str) -> Column:
        return (x.cast("double") - F.get(mean, i)) / (F.get(std, i) + STD_FLOOR)

    deltas = F.transform(F.col(vector), lambda x, i: z(x, i, "_am", "_as") - z(x, i, "_bm", "_bs"))
    moved = rows.select(
        *keys,
        F.array_max(F.transform(deltas, lambda d: F.abs(d))).alias("_worst"),
        F.sqrt(F.aggregate(deltas, F.lit(0.0), lambda s, d: s + d * d)).alias("_l2"),
    )
    totals = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max("_worst").alias("max_component_delta"))
    marks = exact_quantiles(moved, keys, "_l2", {"median_l2": 0.5, "p95_l2": 0.95})
    return totals.join(marks, list(keys)).withColumn(
        "material",
        (F.col("max_component_delta") >= component_threshold) & (F.col("median_l2") >= l2_threshold),
    )


# ---- roll-ups of condition errors ---------------------------------------------------------------


def _worst(c: str = "") -> Column:
    return F.greatest(F.max("max_mean_error"), F.max("max_std_error"))


def condition_matrix(cells: DataFrame, sizes: Sequence[int], tolerance: float = MOMENT_TOLERANCE) -> DataFrame:
    """Arms and orders by batch sizes: the worst error and PASS or FAIL, one row per arm and order."""
    out = cells.groupBy("arm", "order_name").pivot("batch_size", [int(s) for s in sizes]).agg(_worst().alias("worst"))
    return out.select(
        "arm",
        "order_name",
        *[F.col(str(s)).alias(f"worst_{s}") for s in sizes],
        *[F.when(F.col(str(s)) <= tolerance, "PASS").otherwise("FAIL").alias(f"verdict_{s}") for s in sizes],
    )


def failure_drivers(cells: DataFrame, tolerance: float = MOMENT_TOLERANCE) -> DataFrame:
    """How many conditions fail on each (feature, statistic) pair."""
    pairs = F.array(
        F.struct(F.lit("mean").alias("statistic"), F.col("max_mean_error").alias("error")),
        F.struct(F.lit("std").alias("statistic"), F.col("max_std_error").alias("error")),
    )
    long = cells.select(*CONDITION, "feature_group", F.explode(pairs).alias("p")).select("*", "p.*").drop("p")
    return long.groupBy("arm", F.concat_ws(".", "feature_group", "statistic").alias("driver")).agg(
        F.count(F.lit(1)).alias("conditions"), count_true(F.col("error") > tolerance).alias("failing")
    )


def failure_kinds(cells: DataFrame, tolerance: float = MOMENT_TOLERANCE) -> DataFrame:
    """Failing conditions per arm: with std involved, with mean involved, on the mean only."""
    per = cells.groupBy(*CONDITION).agg(
        F.max("max_mean_error").alias("m"), F.max("max_std_error").alias("s")
    )
    mean_bad, std_bad = F.col("m") > tolerance, F.col("s") > tolerance
    return per.groupBy("arm").agg(
        count_true(std_bad).alias("std_involved"),
        count_true(mean_bad).alias("mean_involved"),
        count_true(mean_bad & ~std_bad).alias("mean_only"),
    )


def worst_cell(errors: DataFrame, digits: int = 9) -> DataFrame:
    """The largest error with its coordinates; ties go to the first coordinates in order."""
    pairs = F.array(
        F.struct(F.lit("mean").alias("statistic"), F.col("mean_error").alias("error")),
        F.struct(F.lit("std").alias("statistic"), F.col("std_error").alias("error")),
    )
    long = errors.select(*CONDITION, *COMPONENT, F.explode(pairs).alias("p"))
    key = F.struct(
        (-F.round("p.error", digits)).alias("e"), F.col("arm"), F.col("order_name"), F.col("batch_size"),
        F.col("feature_group"), F.col("p.statistic").alias("statistic"), F.col("component_index"),
    )
    best = long.agg(F.min(key).alias("k"))
    return best.select((-F.col("k.e")).alias("error"), *[f"k.{c}" for c in (*CONDITION, "feature_group", "statistic", "component_index")])


def arm_rollup(cells: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Conditions within and above the tolerance, and the largest errors."""
    per = cells.groupBy(*CONDITION).agg(
        F.max("max_mean_error").alias("m"), F.max("max_std_error").alias("s"), F.bool_and("within").alias("ok")
    )
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("conditions"),
        count_true(F.col("ok")).alias("within"),
        count_true(~F.col("ok")).alias("above"),
        F.max("m").alias("max_mean_error"),
        F.max("s").alias("max_std_error"),
    )


def sensitivity_span(stats: DataFrame, fixed: str) -> DataFrame:
    """Largest max-minus-min of a component when ``fixed`` is held and the other axis varies."""
    spans = stats.groupBy("arm", fixed, *COMPONENT).agg(
        (F.max("mean") - F.min("mean")).alias("m"), (F.max("std") - F.min("std")).alias("s")
    )
    return spans.groupBy("arm", fixed, "feature_group").agg(
        F.max("m").alias("mean_span"), F.max("s").alias("std_span")
    )


# ---- statistics arrays of one feature -----------------------------------------------------------

ORDERED_METRICS = ("min", "q01", "q10", "q50", "q90", "q99", "max")
ARRAY_METRICS = (*ORDERED_METRICS, "mean", "std")


def stat_findings(arrays: DataFrame, is_image: Column, length: str = "length") -> DataFrame:
    """Add the shape, finiteness, order, range, sign and sample-count findings of statistics arrays."""
    from episcope.functions.columns import image_sample_count

    width = F.size("min")
    shape = (width == 0) | (F.size("count") != 1)
    for m in ARRAY_METRICS[1:]:
        shape = shape | (F.size(m) != width)
    nonfinite = F.lit(False)
    for m in (*ARRAY_METRICS, "count"):
        nonfinite = nonfinite | F.exists(m, lambda x: ~finite(x))

    def broken(a: str, b: str, rule) -> Column:
        """Some component pair breaks the rule; NaN and missing partners break nothing here."""
        return F.exists(
            F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")),
            lambda p: finite(p["a"]) & finite(p["b"]) & F.coalesce(rule(p["a"], p["b"]), F.lit(False)),
        )

    order = F.lit(False)
    for a, b in zip(ORDERED_METRICS, ORDERED_METRICS[1:]):
        order = order | broken(a, b, lambda x, y: x > y + 1e-9)
    outside = broken("mean", "min", lambda m, lo: m < lo - 1e-5) | broken("mean", "max", lambda m, hi: m > hi + 1e-5)
    negative = F.exists("std", lambda x: F.coalesce(~F.isnan(x) & (x < -1e-12), F.lit(False)))
    expected = F.when(is_image, image_sample_count(length)).otherwise(F.col(length))
    count = (F.size("count") != 1) | (F.get("count", F.lit(0)).cast("long") != expected)
    return arrays.withColumns(
        {
            "shape_bad": shape,
            "nonfinite": nonfinite,
            "quantile_order_bad": order,
            "mean_outside": outside,
            "negative_std": negative,
            "sample_count_bad": F.coalesce(count, F.lit(True)),
        }
    )


STAT_FINDINGS = (
    "shape_bad", "nonfinite", "quantile_order_bad", "mean_outside", "negative_std", "sample_count_bad",
)


def stat_features(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Features of stored episode statistics (``stats/<feature>/<metric>``): those with every metric, and the others."""
    found: dict[str, set[str]] = {}
    for name in columns:
        if name.startswith("stats/") and name.count("/") >= 2:
            feature, metric = name.removeprefix("stats/").rsplit("/", 1)
            found.setdefault(feature, set()).add(metric)
    whole = sorted(f for f, metrics in found.items() if metrics >= {*ARRAY_METRICS, "count"})
    return whole, sorted(set(found) - set(whole))


def contract_statistics(meta: DataFrame, fps: float | None = None) -> DataFrame:
    """Every counter of the statistics contract over all features that the columns show, in one pass.

    Features that lack a metric are counted and not looked into. Each row is spread to its complete features
    for the findings on arrays; the closed forms of frame index and time (with ``fps``) and the constant task are
    looked at once a row.
    """
    from episcope.operators.lineage import counter_rows, every

    whole, partial = stat_features(meta.columns)
    metrics = (*ARRAY_METRICS, "count")

    def cell(feature: str, metric: str) -> Column:
        return scalar_cell(F.col(f"`stats/{feature}/{metric}`"))

    n = F.col("length")
    std = uniform_std("length")
    last = (n - 1).cast("double")
    closed = {"frame_index": 1.0} | ({} if fps is None else {"timestamp": float(fps)})
    flags = {}
    for feature, rate in closed.items():
        wanted = {"min": F.lit(0.0), "max": last / rate, "mean": last / (2 * rate), "std": std / rate}
        if feature in whole:
            flags[f"{feature}_closed_form"] = ~every(close(cell(feature, m), w) for m, w in wanted.items())
    if "task_index" in whole:
        flags["task_not_constant"] = ~(close(cell("task_index", "min"), cell("task_index", "max")) & close(cell("task_index", "std"), F.lit(0.0)))
    names = ("frame_index_closed_form", "timestamp_closed_form", "task_not_constant")
    per_row = [F.coalesce(flags[f], F.lit(True)).alias(f) if f in flags else F.lit(False).alias(f) for f in names]
    items = [F.struct(F.lit(f).alias("feature"), *[F.col(f"`stats/{f}/{m}`").alias(m) for m in metrics]) for f in whole]
    # A row without complete features is still a row.
    items = items or [F.struct(F.lit(None).cast("string").alias("feature"), *[F.lit(None).cast("array<double>").alias(m) for m in metrics])]
    spread = meta.select("length", *per_row, F.posexplode(F.array(*items)).alias("_at", "_f")).select("length", *names, "_at", "_f.*")
    image = F.col("feature").contains(".image.") | F.col("feature").startswith("observation.image")
    there, first = F.col("feature").isNotNull(), F.col("_at") == 0
    found = stat_findings(spread, image)
    counts = found.agg(
        F.lit(len(partial)).alias("features_without_metrics"),
        *[count_true(there & F.col(f)).alias(f) for f in STAT_FINDINGS],
        *[count_true(first & F.col(f)).alias(f) for f in names],
    )
    return counter_rows(counts)


def feature_coverage(used: DataFrame, declared: DataFrame, published: DataFrame, name: str = "feature") -> DataFrame:
    """Features with episode statistics that the declared list or the global statistics lack."""
    seen = used.select(name).distinct()
    lacking = [
        seen.join(other.select(name).distinct(), name, "left_anti").withColumn("missing_from", F.lit(where))
        for other, where in ((declared, "declared"), (published, "published"))
    ]
    return lacking[0].unionByName(lacking[1])


def contract_companions(used: DataFrame, declared: DataFrame, published: DataFrame, tasks: DataFrame) -> DataFrame:
    """Companion coverage counters: both kinds of missing features and an empty task table."""
    from episcope.operators.lineage import counter_rows

    missing = feature_coverage(used, declared, published).agg(
        count_true(F.col("missing_from") == "declared").alias("features_missing_from_declared"),
        count_true(F.col("missing_from") == "published").alias("features_missing_from_published"),
    )
    empty = tasks.agg((F.count(F.lit(1)) == 0).cast("int").alias("empty_task_table"))
    return counter_rows(missing.crossJoin(empty))  # one row by one row
