"""Coverage of a quaternion convention change over a set of stored fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions import geometry as G
from episcope.functions.columns import count_true
from episcope.operators.ordered import exact_quantiles

# Where quaternions start inside an embedded object vector, and the match tolerance.
OBJECT_STARTS = (3, 10, 17)
MATCH_TOLERANCE = 1e-7
RELATIVE_TOLERANCE = 1e-5


def convert_pose_columns(df: DataFrame, pose: str, version: str, target: int) -> DataFrame:
    """Rewrite 7-wide poses to xyzw and raise the format version; converted sets are rejected."""
    fresh = F.assert_true(F.col(version) < target, F.lit("data set is already converted")).isNull()
    return df.withColumns(
        {
            pose: F.when(fresh & (F.size(pose) == 7), G.convert_pose_array(F.col(pose))).otherwise(F.col(pose)),
            version: F.lit(target),
        }
    )


def field_family(path: Column, width: Column) -> Column:
    """Which family of quaternion fields a stored field belongs to, null for none."""
    return (
        F.when((F.substring_index(path, "/", -1) == "root_pose") & (width == 7), "root_pose")
        .when(path.endswith("/obs/eef_quat") & (width == 4), "eef_quat")
        .when(path.endswith("/obs/cube_orientations") & (width % 4 == 0), "cube_orientations")
        .when(path.endswith("/obs/object") & (width >= 21), "object_embedded")
    )


def conversion_inventory(fields: DataFrame) -> DataFrame:
    """Fields ``(path, row, source, target)`` to one row per quaternion instance."""
    family = field_family(F.col("path"), F.size("source"))
    starts = (
        F.when(family == "root_pose", F.array(F.lit(3)))
        .when(family == "eef_quat", F.array(F.lit(0)))
        .when(family == "cube_orientations", F.sequence(F.lit(0), F.size("source") - 4, F.lit(4)))
        .when(family == "object_embedded", F.array(*[F.lit(s) for s in OBJECT_STARTS]))
    )
    rows = fields.withColumns({"family": family, "_starts": starts}).where(F.col("family").isNotNull())
    rows = rows.withColumn("start", F.explode("_starts"))
    return rows.select(
        "family", "path", "row", "start",
        F.slice("source", F.col("start") + 1, F.lit(4)).alias("source_wxyz"),
        F.slice("target", F.col("start") + 1, F.lit(4)).alias("target_xyzw"),
    )


def with_conversion_state(instances: DataFrame) -> DataFrame:
    """Add ``converted`` and the orientation error in degrees of each instance."""
    raw_s = [F.get("source_wxyz", F.lit(i)).cast("double") for i in range(4)]
    raw_t = [F.get("target_xyzw", F.lit(i)).cast("double") for i in range(4)]
    converted = F.lit(True)
    for got, want in zip(raw_t, [*raw_s[1:], raw_s[0]]):
        converted = converted & (F.abs(got - want) <= MATCH_TOLERANCE + RELATIVE_TOLERANCE * F.abs(want))
    staged = G.with_unit(instances.withColumn("converted", converted), "_s", raw_s)
    staged = G.with_unit(staged, "_t", raw_t)
    s, t = ([F.col(f"{n}{i}") for i in range(4)] for n in ("_s", "_t"))
    error = F.degrees(G.geodesic_trace(s, "wxyz", t, "xyzw"))
    return staged.withColumn("error_deg", error).drop(*[f"{n}{i}" for n in ("_s", "_t") for i in range(4)])


def migration_undone(source: Column, target: Column) -> Column:
    """Whether the inverse migration (scalar part back to the front) of ``target`` gives ``source``."""
    back = F.concat(F.slice(target, 4, 1), F.slice(target, 1, 3))
    close = F.zip_with(back, source, lambda b, s: F.abs(b - s) <= MATCH_TOLERANCE + RELATIVE_TOLERANCE * F.abs(s))
    return (F.size(target) == 4) & F.forall(close, lambda ok: F.coalesce(ok, F.lit(False)))


def conversion_coverage(states: DataFrame) -> DataFrame:
    """Converted and total instances per family and path, with the mean error of the missed ones."""
    return states.groupBy("family", "path").agg(
        F.count(F.lit(1)).alias("instances"),
        count_true(F.col("converted")).alias("converted_instances"),
        F.avg(F.when(~F.col("converted"), F.col("error_deg"))).alias("missed_mean_error_deg"),
    )


def schema_baseline(source: DataFrame, target: DataFrame, version: str, wanted: int) -> DataFrame:
    """What a check of structure alone says of a conversion, in one row.

    ``source`` and ``target`` are stored fields ``(path, row, value)``, the target with its format ``version``.
    Compares paths, row counts and widths (``shape``), element types and values per path; ``accepted`` if
    paths, shapes and types are the same and the version is the ``wanted`` one, whatever the values mean.
    """

    def shapes(df: DataFrame, side: str) -> DataFrame:
        content = F.hash("row", "value").cast("long")  # order does not matter
        return df.groupBy("path").agg(
            F.struct(
                F.count(F.lit(1)).alias("rows"), F.min(F.size("value")).alias("narrow"), F.max(F.size("value")).alias("wide")
            ).alias(f"_shape_{side}"),
            F.sum(content).alias(f"_sum_{side}"),
        )

    same_type = dict(source.dtypes)["value"] == dict(target.dtypes)["value"]
    both = shapes(source, "s").join(shapes(target, "t"), "path", "full_outer")
    has_s, has_t = F.col("_shape_s").isNotNull(), F.col("_shape_t").isNotNull()
    same_shape = F.coalesce(F.col("_shape_s") == F.col("_shape_t"), F.lit(False))
    counts = both.agg(
        count_true(has_s).alias("source_fields"), count_true(has_t).alias("target_fields"),
        F.bool_and(has_s & has_t).alias("same_paths"), count_true(same_shape).alias("same_shape"),
        count_true(has_s & has_t & F.lit(same_type)).alias("same_type"),
        count_true(same_shape & (F.col("_sum_s") == F.col("_sum_t"))).alias("unchanged"),
    )
    versions = target.agg(F.min(version).alias("lowest_version"), F.max(version).alias("highest_version"))
    out = counts.crossJoin(versions)  # one row by one row
    every = F.col("source_fields")
    good = F.col("same_paths") & (F.col("same_shape") == every) & (F.col("same_type") == every)
    return out.withColumn("accepted", good & (F.col("lowest_version") == wanted) & (F.col("highest_version") == wanted))


def error_summary(df: DataFrame, error: str) -> DataFrame:
    """Count, nonzero, over 90 degrees, mean, median, p95 and maximum of an error column."""
    totals = df.agg(
        F.count(error).alias("evaluated"),
        count_true(F.col(error) > 1e-6).alias("nonzero"),
        count_true(F.col(error) > 90.0).alias("over_90"),
        F.avg(error).alias("mean_error"),
        F.max(error).alias("max_error"),
    )
    marks = exact_quantiles(df, [], error, {"median_error": 0.5, "p95_error": 0.95})
    return totals.crossJoin(marks)  # one row by one row
