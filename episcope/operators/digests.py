"""Content digests of groups, event ledgers and array inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.columns import col, count_true
from episcope.operators.ordered import ordered_scan

FAN = 4_096
LEVELS = 3


def _text(values: Sequence[Column | str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(v).cast("string"), F.lit("~")) for v in values])


def group_digest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[Column | str],
    fan: int = FAN, levels: int = LEVELS, out: str = "digest",
) -> DataFrame:
    """SHA-256 tree over the ordered values of each group.

    Rows are hashed in runs of ``fan``, the run digests again in runs of ``fan``, and so on; the
    last level joins the rest. No task sees more than ``fan`` rows of a group until the last level,
    which holds ``rows / fan ** (levels - 1)`` digests.
    """
    keys = list(keys)
    rows = ordered_scan(df.withColumn("_text", _text(values)), keys, order, number="_n")
    level = rows.select(*keys, (F.col("_n") - 1).alias("_at"), "_text")
    for depth in range(levels):
        run = F.lit(0).cast("long") if depth == levels - 1 else F.floor(F.col("_at") / fan)
        lists = level.groupBy(*keys, run.alias("_run")).agg(
            F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_l")
        )
        joined = F.array_join(F.col("_l._text"), "\n")
        level = lists.select(*keys, F.col("_run").alias("_at"), F.sha2(joined, 256).alias("_text"))
    return level.select(*keys, F.col("_text").alias(out))


def verify_digests(objects: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Objects ``(key, content)`` against a manifest ``(key, size, sha256)``: one row per problem."""
    actual = objects.select(
        key, F.length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha")
    )
    joined = manifest.join(actual, key, "left")
    problem = (
        F.when(F.col("_sha").isNull(), "missing")
        .when(F.col("_size") != F.col("size"), "size changed")
        .when(F.col("_sha") != F.col("sha256"), "content changed")
    )
    return joined.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def ledger_verify(
    ledger: DataFrame, hashed: Sequence[str], *, key: str = "ledger", zero: str = "0" * 64,
    terminal: str = "RUN_COMPLETE",
) -> DataFrame:
    """Per ledger: sequence, predecessor, digest, binding and terminal findings.

    ``ledger`` has ``sequence, previous, claimed, binding, event``; ``hashed`` names the columns
    whose ``|``-joined text the claimed digest covers.
    """
    run = ordered_scan(
        ledger, [key], ["sequence"], number="_n", lags={"_before": "claimed"}
    )
    digest = F.sha2(_text(hashed), 256)
    is_end = F.col("event") == terminal
    return run.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        count_true(F.col("sequence") != F.col("_n")).alias("sequence_breaks"),
        count_true(F.col("previous") != F.coalesce("_before", F.lit(zero))).alias("predecessor_breaks"),
        count_true(F.col("claimed") != digest).alias("digest_mismatches"),
        F.count_distinct("binding").alias("bindings"),
        count_true(is_end).alias("terminals"),
        F.max_by(is_end, "sequence").alias("terminal_is_last"),
    )


def ledger_accepted() -> Column:
    clean = (F.col("sequence_breaks") == 0) & (F.col("predecessor_breaks") == 0) & (F.col("digest_mismatches") == 0)
    return clean & (F.col("bindings") == 1) & (F.col("terminals") == 1) & F.col("terminal_is_last")


def array_inventory(df: DataFrame, keys: Sequence[str], order: Sequence[str], arrays: Sequence[str],
                    scale: float = 1e6) -> DataFrame:
    """Per key and array column: element type, rows, width and a digest of the scaled values."""
    types = dict(df.dtypes)
    parts = None
    for name in arrays:
        shape = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.size(name)).cast("long").alias("width")
        )
        text = F.array_join(F.transform(name, lambda x: F.rint(x.cast("double") * scale).cast("long").cast("string")), ",")
        digest = group_digest(df, keys, order, [text])
        part = shape.join(digest, list(keys)).select(
            *keys, F.lit(name).alias("array_name"), F.lit(types[name]).alias("dtype"), "rows", "width", "digest"
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def inventory_reconcile(fresh: DataFrame, frozen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inventory rows that are missing, unexpected or changed."""
    by = [*keys, "array_name"]
    fields = ("dtype", "rows", "width", "digest")
    a = fresh.select(*by, F.struct(*fields).alias("_a"))
    b = frozen.select(*by, F.struct(*fields).alias("_b"))
    joined = a.join(b, by, "full_outer")
    problem = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected")
        .when(F.col("_a") != F.col("_b"), "changed")
    )
    return joined.select(*by, problem.alias("problem")).where(F.col("problem").isNotNull())
