"""Orientation properties on random rotations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episcope.functions import calibration as K
from episcope.functions import geometry as G


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(17)
    n = 2_000
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    axis = rng.normal(size=(n, 3))
    angle = np.where(np.arange(n) % 4 == 0, 10.0 ** rng.uniform(-9, -3, n), rng.uniform(0, np.pi, n))
    cols = {f"q{i}": q[:, i] for i in range(4)} | {f"a{i}": axis[:, i] for i in range(3)} | {"angle": angle}
    return spark.createDataFrame(pd.DataFrame(cols))


def test_known_angle_is_recovered(pairs):
    q = [F.col(f"q{i}") for i in range(4)]
    turn = G.axis_angle([F.col(f"a{i}") for i in range(3)], F.col("angle"))
    staged = pairs.withColumns({f"p{i}": c for i, c in enumerate(G.quaternion_product(q, turn))})
    p = [F.col(f"p{i}") for i in range(4)]
    p_xyzw = [p[1], p[2], p[3], p[0]]
    out = staged.select(
        "angle",
        G.geodesic_atan2(q, "wxyz", p_xyzw, "xyzw").alias("stable"),
        G.geodesic_atan2(q, "wxyz", [-c for c in p_xyzw], "xyzw").alias("negated"),
        G.geodesic_acos(q, p).alias("acos"),
        G.geodesic_trace(q, "wxyz", p, "wxyz").alias("trace"),
        G.geodesic_atan2(q, "wxyz", q, "wxyz").alias("self"),
    ).toPandas()
    np.testing.assert_allclose(out.stable, out.angle, atol=1e-14, rtol=1e-9)
    np.testing.assert_allclose(out.negated, out.stable, atol=1e-15)
    np.testing.assert_allclose(out.acos, out.angle, atol=1e-7)
    np.testing.assert_allclose(out.trace, out.angle, atol=1e-7)
    # Only the stable form stays far below the decision boundary for equal rotations.
    assert np.degrees(out.self.max()) < 1e-12
    small = out[out.angle < 1e-8]
    assert len(small) and (small.trace - small.angle).abs().max() > 1e-9


def test_displacement_rule_boundary(spark):
    matrix = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    df = spark.createDataFrame([(0.5e-9,), (2e-9,)], "off double")
    v = [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    ok = G.displacement_ok(matrix, v, [v[0] + F.col("off"), v[1], v[2]])
    assert [r[0] for r in df.orderBy("off").select(ok).collect()] == [True, False]


def test_undecodable_orientation_is_reported(spark):
    df = G.with_unit(spark.range(1), "s", [F.lit(0.0)] * 4)
    s = [F.col(f"s{i}") for i in range(4)]
    issues = G.orientation_issues(s, "wxyz", s, "wxyz", F.lit(True))
    assert df.select(issues.alias("i")).first()["i"] == ["orientation cannot be decoded"]


def test_calibration_bounds_and_round_trip(spark):
    with pytest.raises(ValueError):
        K.rescale(F.lit(1.0), (2.0, 2.0))
    row = spark.range(1).select(
        K.rescale(K.encoder_to_radian(F.lit(2405)), K.REPAIRED_BOUNDS).alias("closed"),
        K.rescale(K.encoder_to_radian(F.lit(3110)), K.REPAIRED_BOUNDS).alias("open"),
        K.round_trip_error(F.lit(1.25), K.FAULTY_BOUNDS).alias("trip"),
    ).first()
    assert abs(row["closed"]) < 1e-3 and abs(row["open"] - 1) < 1e-3 and row["trip"] < 1e-12
