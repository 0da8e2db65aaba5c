"""Writing artifacts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.operators.digests import group_digest


def write_artifact(df: DataFrame, path: str, name: str, order: Sequence[str], digest_values: Sequence) -> DataFrame:
    """Write a Parquet table and return its manifest row: rows, columns, types, content digest."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    digest = group_digest(stored, [], order, digest_values)
    counted = stored.agg(F.count(F.lit(1)).alias("rows"))
    return counted.crossJoin(digest).select(  # one row by one row
        F.lit(name).alias("name"), "rows", F.lit(",".join(stored.columns)).alias("columns"),
        F.lit(",".join(t for _, t in stored.dtypes)).alias("dtypes"), "digest",
    )


def _in_order(report: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows dealt by range, so that the part files follow one another in order."""
    return report.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)


def write_report_csv(report: DataFrame, path: str, order: Sequence[str]) -> None:
    """An ordered report as CSV part files; a small one is a single file."""
    _in_order(report, order).write.mode("overwrite").csv(path, header=True)


def write_report_json(report: DataFrame, path: str, order: Sequence[str]) -> None:
    _in_order(report, order).write.mode("overwrite").json(path)
