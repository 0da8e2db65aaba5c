"""Streaming checks: late rows, and rules that cannot run on a stream."""

import datetime as dt

import pytest

from episcope.operators import expectations as E
from episcope.streaming import checks as K


DAY = dt.datetime(2024, 1, 1)
SCHEMA = "episode_index long, frame_index long, ts timestamp"


def arrive(spark, path, files):
    for hours in files:
        rows = [(1, h, DAY + dt.timedelta(hours=h)) for h in hours]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return K.read_table_stream(spark, path)


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    stream = arrive(spark, str(tmp_path / "frames"), ((0, 1, 2), (100, 101), (102,), (3,)))
    out = K.stream_chain(stream, ["episode_index"], "frame_index", "ts", "1 hour", 10**9, block=64)
    done = K.chain_status(K.run_to_end(out, "append", into_memory=False, idle_batches=False), ["episode_index"]).first()
    assert (done["rows"], done["duplicates"], done["late"]) == (7, 0, 1)
    assert done["gaps"] == 103 - 7


def test_a_block_that_expired_comes_back(spark, tmp_path):
    stream = arrive(spark, str(tmp_path / "frames"), ((0, 1, 2), (70,), (71,), (2, 3, 5), (72,), (1, 6)))
    out = K.stream_chain(stream, ["episode_index"], "frame_index", "ts", "1 hour", 1, block=64)
    statuses = K.run_to_end(out, "append", into_memory=False, idle_batches=False)
    assert statuses.where("block = 0").select("generation").distinct().count() == 3
    done = K.chain_status(statuses, ["episode_index"]).first()
    assert (done["rows"], done["duplicates"]) == (11, 2)
    assert done["gaps"] == 73 - 9


@pytest.mark.parametrize("expiry_ms", [1, 10**9])
def test_neighbours_that_share_a_state_keep_their_own_status(spark, tmp_path, expiry_ms):
    path = str(tmp_path / "frames")
    files = [[(e, f) for e in (-5, -1, 0, 3, 4) for f in (0, 1, 66 + e)], [(9, 5)], [(-1, 1), (3, 2), (3, 200)], [(9, 6)], [(0, 1), (9, 0), (3, 2)]]
    for rows in files:
        df = spark.createDataFrame([(e, f, DAY + dt.timedelta(hours=f)) for e, f in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)
    out = K.stream_chain(K.read_table_stream(spark, path), ["episode_index"], "frame_index", "ts", "1 hour", expiry_ms, block=64, together=4)
    statuses = K.run_to_end(out, "append", into_memory=False, idle_batches=False)
    come = [(b, e, f // 64) for b, rows in enumerate(files) for e, f in rows]
    assert statuses.count() == len(set(come))  # one status a batch and touched block of an episode
    frames = {e: [f for rows in files for x, f in rows if x == e] for _, e, _ in come}
    got = {r.episode_index: (r.rows, r.gaps, r.duplicates) for r in K.chain_status(statuses, ["episode_index"]).collect()}
    assert got == {e: (len(f), max(f) + 1 - len(set(f)), len(f) - len(set(f))) for e, f in frames.items()}
    again = statuses.where("episode_index = 3 and block = 0").select("generation").distinct().count()
    assert again == (3 if expiry_ms == 1 else 1)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    stream = arrive(spark, str(tmp_path / "frames"), ((0, 1, 30), (60, 61), (100,), (2,)))
    out = K.stream_expectations(stream, [E.between("frame_index", 0, 60)], "ts", "1 day", "12 hours")
    rows = K.run_to_end(out, "append", into_memory=False).collect()
    found = {(r["window_start"] - DAY).days: (r["unexpected_count"], r["element_count"]) for r in rows}
    assert len(rows) == len(found) and found == {0: (0, 2), 1: (0, 1), 2: (1, 2)}


def test_ordered_rules_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "x long, ts timestamp").write.parquet(path)
    stream = K.read_table_stream(spark, path)
    with pytest.raises(ValueError):
        K.stream_expectations(stream, [E.unique("x")], "ts", "1 day", "1 day")


def test_a_batch_that_runs_again_leaves_one_result(spark, tmp_path):
    path = str(tmp_path / "results")
    write = K.suite_per_batch([E.between("x", 0, 5), E.unique("x")], path)
    first = spark.createDataFrame([(1,), (1,), (9,)], "x long")
    write(first, 0)
    write(spark.createDataFrame([(2,)], "x long"), 1)
    write(first, 0)  # as Spark does after a failure between the write and the commit of the batch
    rows = {(r["batch_id"], r["type"]): (r["success"], r["unexpected_count"], r["observed"]) for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == len(rows) == 4
    assert rows[0, "between"] == (False, 1, "9") and rows[0, "unique"] == (False, 2, "1")
    assert rows[1, "between"] == (True, 0, None) and rows[1, "unique"] == (True, 0, None)


def test_each_slice_is_one_batch_of_many_files(spark):
    slices = [spark.range(100 * i, 100 * i + 100, numPartitions=4).toDF("x") for i in range(3)]
    done = K.run_in_slices(slices, lambda s: s, "append", lambda path: K.suite_per_batch([E.row_count_equal(100)], path))
    assert sorted((r["batch_id"], r["success"]) for r in done.collect()) == [(0, True), (1, True), (2, True)]
