"""Shape of the physical plans."""

import contextlib
import io
import threading

import pytest
from pyspark.sql import functions as F

from episcope.operators import frames as R
from episcope.operators.ordered import ordered_scan
from episcope.plans import cases as P
from episcope.plans.catalog import QUERIES
from episcope.plans.views import Tables


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    text = plan(QUERIES["line_contracts"].run(Tables(spark, sf_dir)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") > 10)
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,10)]" in plan(events.select("event_id"))


def test_split_scan_has_no_unpartitioned_window_and_bounded_broadcasts(spark, sf_dir, split_small):
    frames = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = plan(ordered_scan(frames, [], ["event_id"], sums={"s": "user_id"}))
    windows = [line for line in text.splitlines() if "windowspecdefinition" in line]
    assert windows and all("_block" in w or "_all" in w for w in windows)
    assert "CartesianProduct" not in text


def test_backfills_need_no_frame_that_ends_with_the_group(spark, sf_dir):
    """Spark evaluates such a frame anew for every row, which is quadratic in the rows of a group."""
    frames = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = plan(ordered_scan(frames, ["event_type"], ["event_id"], fills={"before": "value"}, backfills={"after": "value"}))
    frames_of_windows = [line for line in text.splitlines() if "windowspecdefinition" in line]
    assert frames_of_windows and not any("unboundedfollowing" in w.lower() for w in frames_of_windows)


def test_first_rows_per_group_are_cut_before_the_shuffle(spark, sf_dir):
    frames = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert "WindowGroupLimit" in plan(R.examples(frames, ["user_id"], ["event_id"], 3))


@pytest.mark.parametrize("name", ["asof_latest_at_or_before", "window_query", "frame_contract_totals", "prefix_rollup"])
def test_no_cartesian_product(spark, sf_dir, name):
    text = plan(QUERIES[name].run(Tables(spark, sf_dir)))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_cases_are_built_side_by_side(monkeypatch):
    meet = threading.Barrier(2, timeout=20)  # breaks if one case waits for another
    monkeypatch.setattr(P, "CASES", {name: lambda t, n=name: (meet.wait(), t + n)[1] for name in ("a", "b")})
    assert P.made("x") == {"a": "xa", "b": "xb"}
