"""Queries that drive a stream over the tables and return its final result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.operators import expectations as E
from episcope.plans.registry import query
from episcope.plans.views import Tables
from episcope.session import written
from episcope.streaming import checks as K


def _stream(t: Tables, name: str, build, files: int = 4) -> DataFrame:
    """A view written in several files, read back as a stream of one file per batch."""
    t._once(name, lambda: build().repartition(files))
    return K.read_table_stream(t.spark, t.path(name))


def _by_time(t: Tables, rows: DataFrame, name: str, slices: int = 4) -> list[DataFrame]:
    """Rows parted by time into slices, each as wide as the plan."""
    rows = written(rows, f"{name}-rows-{uuid.uuid4().hex}")
    at = F.unix_micros("ts")
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - lo) * slices / max(1, hi - lo)), F.lit(slices - 1))
    return [rows.where(part == i) for i in range(slices)]


@query("T1", "v_comp", "select feature_group, component_index, count(*) as count, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) + 0.0 as std from v_comp group by all")
def stream_moments(t: Tables) -> DataFrame:
    stream = _stream(t, "vector_stream", lambda: t.vectors.select("state", "actions"))
    moments = K.stream_moments(stream, {"state": "state", "actions": "actions"})
    # One row per vector component.
    return K.rounded_moments(K.run_to_end(moments, "complete", into_memory=True))


@query("T2", "v_frames", """select window_start, type, success, unexpected_count, element_count from (
select cast(date_trunc('day', ts) as timestamp) as window_start, 'between' as type, count_if(value < 1 or value > 100) = 0 as success,
count_if(value < 1 or value > 100) as unexpected_count, count(*) as element_count from v_frames group by all
union all select cast(date_trunc('day', ts) as timestamp), 'not_null', true, 0, count(*) from v_frames group by all)
where window_start + interval 1 day <= (select max(ts) from v_frames) - interval 2 day""")
def stream_expectations(t: Tables) -> DataFrame:
    """Windows of a day that the watermark, two days behind, has passed."""
    rows = t.frames.withColumn("ts", F.col("ts").cast("timestamp"))
    suite = [E.between("value", 1.0, 100.0), E.not_null("index")]
    done = K.run_in_slices(
        _by_time(t, rows, "frames"), lambda stream: K.stream_expectations(stream, suite, "ts", "1 day", "2 days"), "append"
    )
    return done.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "type", "success", "unexpected_count", "element_count"
    )


_SLICE = """(select *, least(3, floor((epoch_us(ts) - (select min(epoch_us(ts)) from v_frames)) * 4
  / (select greatest(1, max(epoch_us(ts)) - min(epoch_us(ts))) from v_frames)))::bigint as batch_id from v_frames)"""


@query("T2 batches", "v_frames", f"""select batch_id, 0 as ordinal, 'between' as type, count_if(value < 1 or value > 100) = 0 as success, count_if(value < 1 or value > 100) as unexpected_count,
count(*) as element_count, round(min(value) filter (where value < 1 or value > 100), 6) as smallest from {_SLICE} group by batch_id
union all select batch_id, 1, 'unique', bool_and(n = 1), cast(coalesce(sum(n) filter (where n > 1), 0) as bigint), cast(sum(n) as bigint), cast(min(task_index) filter (where n > 1) as double)
from (select batch_id, task_index, count(*) as n from {_SLICE} group by all) group by batch_id""")
def stream_suite_batches(t: Tables) -> DataFrame:
    """A suite on every micro-batch, one of its rules over other rows of the batch; rows carry the batch."""
    suite = [E.between("value", 1.0, 100.0), E.unique("task_index")]
    rows = t.frames.withColumn("ts", F.col("ts").cast("timestamp"))
    done = K.run_in_slices(
        _by_time(t, rows, "batches"), lambda stream: stream, "append", lambda path: K.suite_per_batch(suite, path)
    )
    return done.select(
        F.col("batch_id").cast("long").alias("batch_id"), "ordinal", "type", "success", "unexpected_count", "element_count",
        F.round(F.col("observed").cast("double"), 6).alias("smallest"),
    )


@query("T3", "v_frames", """select split, episode_index, count(*) + count_if(frame_index % 10 = 7) as rows,
max(frame_index) + 1 - count(*) as gaps, count_if(frame_index % 10 = 7) as duplicates,
count_if(frame_index % 10 = 7 and ts < (select max(ts) from v_frames where frame_index % 10 <> 4) - interval 1 day) as late
from v_frames where frame_index % 10 <> 4 group by split, episode_index""")
def stream_chain(t: Tables) -> DataFrame:
    """Every tenth frame is dropped; another tenth comes again at the end, most of it behind the watermark."""
    kept = t.frames.where(F.col("frame_index") % 10 != 4).withColumn("ts", F.col("ts").cast("timestamp"))
    slices = [kept, kept.where(F.col("frame_index") % 10 == 7)]
    keys = ["split", "episode_index"]
    statuses = K.run_in_slices(
        slices, lambda stream: K.stream_chain(stream, keys, "frame_index", "ts", "1 day", 86_400_000, block=128, together=32),
        "append", idle_batches=False,
    )
    return K.chain_status(statuses, keys)
