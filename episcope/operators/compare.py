"""Comparisons between two versions of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.columns import count_true
from episcope.operators.expectations import Expectation, with_verdict


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    b = right.select(*keys, F.lit(True).alias("_r"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    return a.join(b, list(keys), "full_outer")


def paired_compare(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Align two branches by key; one null-safe equality per field and where the key was present."""
    joined = _joined(left, right, keys, fields)
    presence = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return joined.select(
        *keys, *[F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")).alias(f"same_{f}") for f in fields],
        presence.alias("presence"),
    )


def compare_to_golden(fresh: DataFrame, golden: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per listed field that differs, with both values as text."""
    joined = _joined(fresh, golden, keys, fields)
    differing = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")),
                    F.struct(
                        F.lit(f).alias("field"), F.col(f"_l_{f}").cast("string").alias("fresh"),
                        F.col(f"_r_{f}").cast("string").alias("golden"),
                    ),
                )
                for f in fields
            ]
        )
    )
    return joined.select(*keys, F.explode(differing).alias("d")).select(*keys, "d.*")


@dataclass(frozen=True)
class Evidence:
    """What can be asked of the rows of a case: columns that are true for a row.

    ``round_trip`` is whether an inverse operation, run on the row, restores what it was made from; it is null
    on rows without an inverse. None stands for "not applicable".
    """

    rows: DataFrame
    rule: Expectation
    structure_bad: Column
    equal_raw: Column | None = None
    round_trip: Column | None = None


def information_matrix(cases: Mapping[str, Evidence]) -> DataFrame:
    """Per case and branch, in one aggregate each: what structure, raw equality, the inverse operation and
    the reference rule say.

    ``equal_raw`` and ``round_trip_bad`` are null where the question does not apply; ``round_trip_rows``
    counts the rows on which an inverse ran.
    """
    out = None
    for name, case in cases.items():
        none = F.lit(None).cast("long")
        back = case.round_trip
        rows = with_verdict(case.rows, case.rule, ["branch"], "_broken")
        part = rows.groupBy("branch").agg(
            F.count(F.lit(1)).alias("rows"),
            count_true(F.col("_broken")).alias("reference_violations"),
            count_true(case.structure_bad).alias("structure_bad"),
            (none if case.equal_raw is None else count_true(case.equal_raw)).alias("equal_raw"),
            (F.lit(0).cast("long") if back is None else count_true(back.isNotNull())).alias("round_trip_rows"),
            (none if back is None else F.when(count_true(back.isNotNull()) > 0, count_true(~back))).alias("round_trip_bad"),
        )
        part = part.select(F.lit(name).alias("case"), "*")
        out = part if out is None else out.unionByName(part)
    return out
