"""Moments on a bad case for differencing, and replay orders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episcope.operators import statistics as M

def test_merge_is_stable_where_differencing_is_not(spark):
    x = 1e9 + np.arange(64) % 4
    df = spark.createDataFrame(pd.DataFrame({"feature_group": "f", "component_index": 0, "x": x, "batch": np.arange(64) // 8}))
    merged = M.moments_merge(df, "batch").first()
    assert merged["std"] == pytest.approx(x.std(), rel=1e-6)
    assert M.moments_by_squares(df).first()["std"] != pytest.approx(x.std(), rel=1e-3)


def test_single_squares_put_a_floor_under_the_error(spark):
    df = spark.createDataFrame(pd.DataFrame({"feature_group": "f", "component_index": 0, "x": np.float32(100000.1) + np.zeros(10)}))
    single = M.moments_by_squares(df, single_squares=True).first()["std"]
    assert abs(single - M.moments_by_squares(df).first()["std"]) > 0


def test_episode_orders_are_permutations(spark):
    for n in (6, 7, 10, 21):
        vectors = spark.range(n).withColumnRenamed("id", "episode_index")
        orders = M.episode_orders(vectors).toPandas()
        for _, part in orders.groupby("order_name"):
            assert sorted(part.position) == list(range(n))


def test_each_cell_of_the_replay_study_comes_from_its_own_batches(spark):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(2500, 3)) + 3000).astype(np.float32)
    data = pd.DataFrame({"vec_id": range(2500), "episode_index": np.arange(2500) // 40, "frame_index": np.arange(2500) % 40, "v": list(rows.tolist())})
    vectors = spark.createDataFrame(data, "vec_id long, episode_index long, frame_index long, v array<float>")
    replayed = M.order_replay(vectors, M.episode_orders(vectors, range(1, 3)))
    order = {k: g.sort_values("ordinal").vec_id.to_numpy() for k, g in replayed.toPandas().groupby("order_name")}
    assert set(order) == {"natural", "shift1", "shift2"}
    found = M.condition_stats(replayed, vectors, (1, 8, 128), {"f": "v"}).toPandas()
    assert len(found) == len(M.ARMS) * 3 * 3 * 3
    std = {}
    for (arm, name, size), part in found.groupby(["arm", "order_name", "batch_size"]):
        x = rows[order[name]].astype(float)
        seen = x[::size] if arm == "first_row" else x
        part = part.sort_values("component_index")
        assert set(part["count"]) == {len(seen)}
        assert np.allclose(part["mean"], seen.mean(0), atol=1e-9)
        assert np.allclose(part["std"], seen.std(0), atol={"all_rows_stable": 1e-9, "all_rows_single_squares": 1.0}.get(arm, 1e-3))
        std[arm, name, size] = part["std"].to_numpy()
    exact = rows.astype(float).std(0)
    worst = {a: max(np.abs(v - exact).max() for (b, *_), v in std.items() if b == a) for a in M.ARMS[1:]}
    # Squaring singles costs most, differencing some, merging deviations next to nothing.
    assert worst["all_rows_single_squares"] > 10 * worst["all_rows"] > 10 * worst["all_rows_stable"]


def test_only_leading_rows_are_copied(spark):
    replayed = spark.range(300).select(F.lit("natural").alias("order_name"), F.col("id").alias("ordinal"))
    led = M.first_of_batch(replayed, (1, 8, 32, 128))
    assert led.count() == 300 + 38 + 10 + 3
    assert led.where("ordinal % batch_size <> 0").count() == 0
