"""The ordered scan and the exact quantiles against pandas, with a key that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episcope.operators.ordered import dealt, exact_quantiles, ordered_scan

N = 6_000


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    key = np.where(rng.random(N) < 1 / 3, "hot", rng.integers(0, 400, N).astype(str))
    t = rng.integers(0, 900, N)
    t[key == "hot"] //= 300  # nearly all of the hot key at three times
    x = rng.integers(-50, 50, N).astype(float)
    return pd.DataFrame({"key": key, "t": t, "id": rng.permutation(N), "x": np.where(rng.random(N) < 0.3, np.nan, x)})


def spark_frame(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.mark.parametrize("keys", [["key"], []])
def test_scan_equals_pandas_when_split(spark, split_small, frame, keys):
    df = spark_frame(spark, frame)
    out = ordered_scan(
        df, keys, ["t", "id"], number="n", sums={"s": F.col("x").cast("decimal(12,2)")}, lags={"before": "id"}, leads={"after": "id"},
        fills={"last_x": "x"}, backfills={"next_x": "x"},
    ).toPandas().sort_values("id").reset_index(drop=True)
    want = frame.sort_values(["t", "id"]).reset_index(drop=True)
    g = want.groupby(keys) if keys else want.assign(a=0).groupby("a")
    want["n"] = g.cumcount() + 1
    want["s"] = want.assign(x=want.x.fillna(0), a=0).groupby(keys or "a").x.cumsum()
    want["before"], want["after"] = g["id"].shift(1), g["id"].shift(-1)
    want["last_x"], want["next_x"] = g["x"].ffill(), g["x"].bfill()
    want = want.sort_values("id").reset_index(drop=True)
    for c in ("n", "s", "before", "after", "last_x", "next_x"):
        np.testing.assert_allclose(out[c].astype(float), want[c].astype(float), err_msg=c)


def test_hot_key_is_cut(spark, split_small, frame):
    df = dealt(spark_frame(spark, frame), ["key"], ["t", "id"])
    sizes = df.groupBy("key", "_block").count().toPandas()
    hot = sizes[sizes.key == "hot"]
    assert len(hot) >= 4 and hot["count"].max() < N / 5
    assert sizes.groupby("key").size().gt(1).sum() <= sizes._block.nunique()
    assert sizes["count"].sum() == N


def test_results_do_not_depend_on_blocks(spark, frame, request):
    rows = [("k", 1.0), ("k", float("inf")), ("k", float("inf")), ("m", float("nan")), ("n", None), (None, 0.1), (None, 0.3)]
    wild = spark.createDataFrame(rows, "key string, x double")
    wanted = {"a": 0.25, "b": 0.75, "c": 0.9}

    def both():
        scan = ordered_scan(spark_frame(spark, frame), ["key"], ["t", "id"], number="n", sums={"s": "t"}, totals={"all": "t"})
        quantiles = exact_quantiles(spark_frame(spark, frame), ["key"], F.col("x") / 7, wanted)
        return [sorted(map(str, d.collect())) for d in (scan, quantiles, exact_quantiles(wild, ["key"], "x", wanted))]

    whole = both()
    request.getfixturevalue("split_small")
    assert both() == whole
    assert "inf" in next(r for r in whole[2] if "'k'" in r) and "nan" not in str(whole[2])


def test_floating_sums_are_refused(spark, frame):
    with pytest.raises(ValueError):
        ordered_scan(spark_frame(spark, frame), [], ["id"], sums={"s": "x"})


@pytest.mark.parametrize("forced", [False, True])
def test_quantiles(spark, frame, forced, request):
    if forced:
        request.getfixturevalue("split_small")
    df = spark_frame(spark, frame).withColumn("x", F.coalesce("x", F.lit(float("nan"))))
    wanted = {"q0": 0.0, "q1": 0.01, "q5": 0.5, "q95": 0.95, "q1_0": 1.0}
    got = exact_quantiles(df, ["key"], "x", wanted).toPandas().set_index("key").sort_index()
    want = frame.groupby("key").x.quantile(list(wanted.values())).unstack()
    for name, q in wanted.items():
        a = got[name].dropna()
        np.testing.assert_allclose(a.astype(float), want[q].dropna().loc[a.index])
        assert len(a) == want[q].notna().sum()
    whole = exact_quantiles(df, [], "x", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(frame.x.median())


def test_output_name_may_replace_a_column(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id long, before long")
    rows = ordered_scan(df, [], ["id"], lags={"before": "before"}).orderBy("id").collect()
    assert [r.before for r in rows] == [None, 10]
