"""Keys of frames against declared keys."""

import pytest

from episcope.operators import frames as R

SEEN = [("a", 1), ("a", 1), ("a", -1), ("a", 64), ("b", 2**63 - 1), (None, 5), ("a", None), ("c", -(2**63)), ("a", 0)]
DECLARED = [("a", 1), ("a", 65), ("b", 1), ("c", -(2**63)), (None, 5), ("a", None), ("a", -64), ("a", 0)]
UNKNOWN = [("a", -1), ("a", 64), ("b", 2**63 - 1), (None, 5), ("a", None)]
MISSING = [("a", 65), ("b", 1), (None, 5), ("a", None), ("a", -64)]


@pytest.mark.parametrize("keys", [["split", "k"], ["k", "split"]])
def test_unknown_and_missing_keys(spark, keys):
    seen, declared = (spark.createDataFrame(rows, "split string, k long") for rows in (SEEN, DECLARED))
    got = [(r.split, r.k, r.finding) for r in R.unknown_and_missing(seen, declared, keys).collect()]
    want = [(*k, "unknown") for k in UNKNOWN] + [(*k, "missing") for k in MISSING]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_dense_keys_meet_as_bitmaps(spark):
    """What is shuffled and held is a small share of the keys."""
    seen, declared = spark.range(200_000).repartition(4), spark.range(100, 200_100)
    out = R.unknown_and_missing(seen, declared, ["id"])
    assert {tuple(r) for r in out.groupBy("finding").count().collect()} == {("unknown", 100), ("missing", 100)}
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan and "bit_or" in plan
