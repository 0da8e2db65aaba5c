"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the number of local cores. The first entry is
the time to derive the shared views from the raw tables; each query then runs to completion once.
``BENCH_COPIES=n`` adds timings of the metadata and frame contracts on n shifted copies of the views.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from episcope.operators import frames as R  # noqa: E402
from episcope.operators import lineage as L  # noqa: E402
from episcope.plans.catalog import QUERIES  # noqa: E402
from episcope.plans.views import Tables  # noqa: E402
from episcope.session import written  # noqa: E402

HEADLINE = (
    "contract_identity",
    "identity_summary_local",
    "prefix_rollup",
    "prefix_sum_offsets",
    "frame_contract_totals",
    "frame_row_identity",
    "line_contracts",
    "window_query",
    "action_chunks",
    "vector_moments",
    "histogram_quantile",
    "condition_matrix",
    "asof_latest_at_or_before",
    "retrieval_metrics",
    "conversion_coverage",
    "paired_verdict",
    "pack_data_files",
    "group_digest",
    "ledger_verify",
)


def timed(frame) -> float:
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def on_copies(tables: Tables, copies: int) -> dict:
    """Contracts on ``copies`` shifted copies, for a size near the published runs."""
    spark = tables.spark
    episodes, frames = tables.episodes.count(), tables.frames.count()
    c = spark.range(copies).withColumnRenamed("id", "c")
    shift_e, shift_f = F.col("c") * episodes, F.col("c") * frames
    name = F.concat_ws("_", "source_prefix", F.col("c").cast("string"))
    many = written(
        tables.frames.crossJoin(F.broadcast(c)).select(
            "split", (F.col("episode_index") + shift_e).alias("episode_index"), "frame_index",
            (F.col("index") + shift_f).alias("index"), "task_index",
        ),
        "bench-frames",
    )
    declared = written(
        tables.episodes.crossJoin(F.broadcast(c)).select(
            "split", (F.col("episode_index") + shift_e).alias("episode_index"), name.alias("source_prefix"), "length",
            "task", (F.col("dataset_from_index") + shift_f).alias("dataset_from_index"),
            (F.col("dataset_to_index") + shift_f).alias("dataset_to_index"),
        ),
        "bench-episodes",
    )
    moved = tables.episode_meta.crossJoin(F.broadcast(c))
    meta = written(
        moved.withColumns(
            {
                "episode_index": F.col("episode_index") + shift_e,
                "episode_id": F.concat(F.split_part("episode_id", F.lit("/"), F.lit(1)), F.lit("_"),
                                       F.col("c").cast("string"), F.lit("/"), F.col("episode_index").cast("string")),
                "dataset_from_index": F.col("dataset_from_index") + shift_f,
                "dataset_to_index": F.col("dataset_to_index") + shift_f,
            }
        ).drop("c"),
        "bench-meta",
    )
    return {
        "frames": many.count(),
        "episodes": meta.count(),
        "frame_contract_totals": timed(R.contract_totals(R.frame_contracts(many, declared, tables.tasks))),
        "frame_row_identity": timed(R.row_identity_totals(many, declared)),
        "contract_identity": timed(L.contract_identity(meta)),
        "prefix_rollup": timed(L.prefix_rollup(L.summary_findings(meta, tables.tasks))),
    }


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("episcope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).selectExpr("sum(id)").collect()  # start the executor threads

    tables = Tables(spark, folder)
    times: dict[str, float] = {}
    began = time.perf_counter()
    for view in ("tasks", "episodes", "episode_meta", "frames", "stats", "stats_first_rows"):
        getattr(tables, view)
    times["build_views"] = round(time.perf_counter() - began, 3)
    rows: dict[str, int] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        timed(QUERIES[name].run(Tables(spark, folder)))
        times[name] = round(time.perf_counter() - began, 3)
    rows["frames"] = tables.frames.count()
    rows["episodes"] = tables.episodes.count()
    rows["lineitem"] = tables.table("lineitem").count()
    copies = int(os.environ.get("BENCH_COPIES", "0"))
    scaled = {"copies": on_copies(tables, copies)} if copies else {}
    print(
        json.dumps(
            {
                **scaled,
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
