"""A stored set of episodes that grows by appends.

A store is a folder of commits. ``commit=<name>`` under ``episodes`` holds the rows of one append, and a row
under ``commits`` makes them visible: it is written last and names where the next append goes on. An append
that is run again finds its commit and adds nothing; one that died before its commit is written over by
the next try. There is one writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.operators.ordered import ordered_scan

_COMMIT = "commit string, number long, next_episode long, next_index long, next_file long, episodes long"


def _folder(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a store, one row each; none for a store that is not there yet."""
    try:
        return spark.read.schema(_COMMIT).parquet(_folder(path, "commits"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All committed episodes; rows of an append that has not committed are not read."""
    names = [r["commit"] for r in commits(spark, path).select("commit").collect()]  # one row per append
    if not names:
        raise ValueError("the store has no commit")
    folders = [_folder(path, "episodes", f"commit={n}") for n in names]
    return spark.read.parquet(*folders)


def append_episodes(path: str, episodes: DataFrame, order: Sequence[str], commit: str, *, per_file: int = 10) -> bool:
    """Append ``episodes`` (with ``length``) in ``order`` after the last stored row; False if already committed.

    Episode numbers and row offsets go on where the last commit ended. An append begins a new data file, since
    a file that has been read is closed, and a file takes ``per_file`` episodes. Adds ``episode_index,
    dataset_from_index, dataset_to_index, file_index``.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", commit):
        raise ValueError("a commit name holds letters, digits, dots, dashes and underscores")
    spark = episodes.sparkSession
    known = commits(spark, path)
    if known.where(F.col("commit") == commit).limit(1).count():
        return False
    last = known.agg(F.max_by(F.struct("number", "next_episode", "next_index", "next_file"), "number").alias("s")).first()["s"]
    number, episode, index, file = (last["number"] + 1, *last[1:]) if last else (0, 0, 0, 0)
    made = ("episode_index", "dataset_from_index", "dataset_to_index", "file_index")
    rows = ordered_scan(episodes.drop(*made), [], order, number="_n", sums={"_upto": "length"})
    stop = F.col("_upto") + index
    rows = rows.select(
        *[c for c in rows.columns if c not in ("_n", "_upto")],
        (F.col("_n") - 1 + episode).alias("episode_index"),
        (stop - F.col("length")).alias("dataset_from_index"),
        stop.alias("dataset_to_index"),
        (F.floor((F.col("_n") - 1) / per_file) + file).alias("file_index"),
    )
    place = _folder(path, "episodes", f"commit={commit}")
    rows.write.mode("overwrite").parquet(place)  # what an earlier try left is replaced
    written = spark.read.parquet(place).agg(
        F.count(F.lit(1)).alias("n"), F.max("dataset_to_index").alias("stop"), F.max("file_index").alias("file")
    )
    done = written.select(
        F.lit(commit).alias("commit"), F.lit(number).cast("long").alias("number"), (F.col("n") + episode).alias("next_episode"),
        F.coalesce("stop", F.lit(index)).alias("next_index"), (F.coalesce(F.col("file") + 1, F.lit(file))).alias("next_file"), F.col("n").alias("episodes"),
    )
    done.coalesce(1).write.mode("append").parquet(_folder(path, "commits"))  # one row
    return True
