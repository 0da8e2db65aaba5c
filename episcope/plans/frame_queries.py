"""Queries over frame tables, lines and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions.columns import rounded
from episcope.operators import frames as R
from episcope.operators import lineage as L
from episcope.plans.registry import query
from episcope.plans.views import Tables

OFFSETS = (-3, -1, 0, 2, 5)


def _bent(t: Tables) -> DataFrame:
    """Frames with planted faults: a shifted index, a repeated frame index, another task."""
    e, i = F.col("episode_index"), F.col("frame_index")
    return t.frames.withColumns({
        "index": F.when((e % 17 == 3) & (i % 5 == 0), F.col("index") + 1).otherwise(F.col("index")),
        "frame_index": F.when((e % 17 == 5) & (i == 2), F.lit(1)).otherwise(i),
        "task_index": F.when((e % 17 == 7) & (i == 3), F.col("task_index") + 1).otherwise(F.col("task_index")),
    })


_BENT = """bent as (select split, episode_index, source_prefix, event_id, ts, value,
case when episode_index % 17 = 3 and frame_index % 5 = 0 then index + 1 else index end as index,
case when episode_index % 17 = 5 and frame_index = 2 then 1 else frame_index end as frame_index,
case when episode_index % 17 = 7 and frame_index = 3 then task_index + 1 else task_index end as task_index from v_frames)"""


@query("B4", "v_frames", """select split, episode_index, index, row_number() over (order by index) - 1 as relative_index
from v_frames where split = 'failure'""")
def select_episodes(t: Tables) -> DataFrame:
    chosen = t.episodes.where("split = 'failure'")
    return R.select_episodes(t.frames, chosen).select("split", "episode_index", "index", "relative_index")


@query("C2", "v_frames v_episodes", """select f.split, f.episode_index, f.frame_index, f.index, e.dataset_from_index, e.dataset_to_index
from v_frames f left join v_episodes e on e.split = f.split and e.episode_index = f.episode_index""")
def frames_with_bounds(t: Tables) -> DataFrame:
    return R.frames_with_bounds(t.frames, t.episodes).select(
        "split", "episode_index", "frame_index", "index", "dataset_from_index", "dataset_to_index"
    )


@query("C3", "", """select k as orderkey, 'unknown' as finding from (select distinct k from lk) where k not in (select o_orderkey from orders)
union all select o_orderkey, 'missing' from orders where o_orderkey not in (select k from lk)""",
       extra="lk as (select case when l_linenumber = 7 then -1 - l_orderkey else l_orderkey end as k from lineitem)")
def unknown_and_missing(t: Tables) -> DataFrame:
    """Orders without lines are in the data; lines of unknown orders come from rewritten keys."""
    key = F.when(F.col("l_linenumber") == 7, -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    lines = t.table("lineitem").select(key.alias("orderkey"))
    orders = t.table("orders").select(F.col("o_orderkey").alias("orderkey"))
    return R.unknown_and_missing(lines, orders, ["orderkey"])


@query("D6", "v_frames", """select split, episode_index, count(*) as frames, min(index) as index_min, max(index) as index_max,
round(avg(index), 6) + 0.0 as index_mean, count(distinct index) as index_distinct, count(distinct frame_index) as frame_distinct,
min(task_index) = max(task_index) as constant_task, min_by(task_index, frame_index) as first_task from v_frames group by all""")
def frame_summary(t: Tables) -> DataFrame:
    return R.frame_summary(t.frames).select(
        "split", "episode_index", "frames", "index_min", "index_max", rounded("index_mean").alias("index_mean"),
        "index_distinct", "frame_distinct", (F.col("task_min") == F.col("task_max")).alias("constant_task"), "first_task",
    )


_CONTRACTS = _BENT + """,
obs as (select split, episode_index, count(*) as n, min(index) as lo, max(index) as hi, count(distinct index) as d,
  min(frame_index) as fl, max(frame_index) as fh, count(distinct frame_index) as fd, min(task_index) as ta, max(task_index) as tb
  from bent group by all),
con as (select e.split, e.episode_index, e.length, n as frames, n = e.length as length_ok,
  n = e.length and d = e.length and lo = dataset_from_index and hi = dataset_from_index + e.length - 1 as interval_ok,
  n = e.length and fd = e.length and fl = 0 and fh = e.length - 1 as order_ok, ta = tb and coalesce(t.task = e.task, false) as task_ok
  from v_episodes e join obs o on o.split = e.split and o.episode_index = e.episode_index left join v_tasks t on t.task_index = o.ta)"""


def _contracts(t: Tables) -> DataFrame:
    return R.frame_contracts(_bent(t), t.episodes, t.tasks)


@query("K12", "v_frames v_episodes v_tasks", "select episode_index, length, frames, length_ok from con", extra=_CONTRACTS)
def frame_length(t: Tables) -> DataFrame:
    return _contracts(t).select("episode_index", "length", "frames", "length_ok")


@query("K13", "v_frames v_episodes v_tasks", "select episode_index, interval_ok from con", extra=_CONTRACTS)
def frame_interval(t: Tables) -> DataFrame:
    return _contracts(t).select("episode_index", "interval_ok")


@query("K14", "v_frames v_episodes v_tasks", "select episode_index, order_ok from con", extra=_CONTRACTS)
def frame_order(t: Tables) -> DataFrame:
    return _contracts(t).select("episode_index", "order_ok")


@query("K15", "v_frames v_episodes v_tasks", "select episode_index, task_ok from con", extra=_CONTRACTS)
def frame_task(t: Tables) -> DataFrame:
    return _contracts(t).select("episode_index", "task_ok")


@query("K12-K15", "v_frames v_episodes v_tasks", """select split, count(*) as episodes, cast(sum(frames) as bigint) as frames, count_if(length_ok) as length_ok,
count_if(interval_ok) as interval_ok, count_if(order_ok) as order_ok, count_if(task_ok) as task_ok,
count_if(length_ok and interval_ok and order_ok and task_ok) as consistent_episodes from con group by split""", extra=_CONTRACTS)
def frame_contract_totals(t: Tables) -> DataFrame:
    return R.contract_totals(_contracts(t))


@query("K12-K16 on a large join", "", """select o_orderpriority as split, count(*) as orders, cast(sum(n) as bigint) as lines,
count_if(n = declared) as length_ok, count_if(n > 0 and lo = 1 and hi = n and d = n) as order_ok, cast(sum(bad) as bigint) as violating_lines
from (select o_orderpriority, o_orderkey, o_orderkey % 7 + 1 as declared, count(l_linenumber) as n, min(l_linenumber) as lo,
        max(l_linenumber) as hi, count(distinct l_linenumber) as d, count_if(l_linenumber > o_orderkey % 7 + 1) as bad
      from orders left join lineitem on l_orderkey = o_orderkey group by all) group by o_orderpriority""")
def line_contracts(t: Tables) -> DataFrame:
    """Lines as frames of orders: naturally faulty, and the large join of the bench."""
    orders = t.table("orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("split"), (F.col("o_orderkey") % 7 + 1).alias("declared")
    )
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber")
    limit = F.col("l_orderkey") % 7 + 1
    # Aggregating before the join keeps the wide side of the join at one row per order.
    seen = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"),
        F.count_distinct("l_linenumber").alias("d"), F.count_if(F.col("l_linenumber") > limit).alias("bad"),
    )
    joined = orders.join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["n", "bad"])
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"),
        F.count_if(F.col("n") == F.col("declared")).alias("length_ok"),
        F.count_if((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("order_ok"),
        F.sum("bad").alias("violating_lines"),
    )


@query("K14 control", "", """select conv_id, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as order_ok
from conversations group by conv_id""")
def turn_order(t: Tables) -> DataFrame:
    turns = t.table("conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("d")
    )
    ok = R.run_of(F.col("n"), F.col("lo"), F.col("hi"), F.col("d"), F.lit(0), F.col("n"))
    return turns.select("conv_id", ok.alias("order_ok"))


_GATE = _BENT + """,
gate as (select f.split, f.episode_index, any_value(e.length) as length, count(*) as n, count_if(f.index <> dataset_from_index + frame_index) as bad,
  count_if(f.index is null or f.frame_index is null) as nulls, count_if(e.length is null) as unknown
  from lost f left join v_episodes e on e.split = f.split and e.episode_index = f.episode_index group by all)"""
_LOST = _GATE.replace("\ngate as", """
lost as (select * replace (case when episode_index % 23 = 4 and frame_index = 1 then null else index end as index) from bent where not (episode_index % 29 = 6 and frame_index = 0)),
gate as""")


def _lost(t: Tables) -> DataFrame:
    """Bent frames, some of which are missing or have lost their index."""
    e, i = F.col("episode_index"), F.col("frame_index")
    kept = _bent(t).where(~((e % 29 == 6) & (i == 0)))
    return kept.withColumn("index", F.when(~((e % 23 == 4) & (i == 1)), F.col("index")))


@query("K16", "v_frames v_episodes", """select split, cast(sum(n) as bigint) as rows, count(*) as episodes, cast(sum(bad) as bigint) as violating_rows,
count_if(bad > 0) as violating_episodes, cast(sum(nulls) as bigint) as null_rows, count_if(n <> length) as length_errors from gate group by split""", extra=_LOST)
def frame_row_identity(t: Tables) -> DataFrame:
    return R.row_identity_totals(_lost(t), t.episodes)


@query("W15", "v_frames v_episodes", """select episode_index, event_id, index, frame_index from (
select f.*, row_number() over (partition by f.episode_index order by event_id) as r from bent f
join v_episodes e on e.split = f.split and e.episode_index = f.episode_index where f.index <> dataset_from_index + frame_index) where r <= 3""", extra=_BENT)
def violation_examples(t: Tables) -> DataFrame:
    bad = R.row_identity(_bent(t), t.episodes)
    return R.examples(bad, ["episode_index"], ["event_id"], 3).select("episode_index", "event_id", "index", "frame_index")


def _published(t: Tables) -> DataFrame:
    return t.episode_meta.select(
        "split", "episode_index",
        *[L.cell("episode_index", m).alias(f"ep_{m}") for m in ("min", "max", "mean", "count")],
        *[L.cell("task_index", m).alias(f"task_{m}") for m in ("min", "max", "mean")],
    )


@query("K17", "v_frames v_episodes", """select e.split, count_if(sum_episode = e.episode_index) as episode_matches, count_if(sum_episode <> e.episode_index) as episode_differs,
count_if(sum_task = ta and sum_task = tb) as task_matches, count_if(not (sum_task = ta and sum_task = tb)) as task_differs,
count_if(e.length = n) as count_matches, count_if(e.length <> n) as count_differs
from v_episodes e join (select split, episode_index, count(*) as n, min(task_index) as ta, max(task_index) as tb from bent group by all) o
on o.split = e.split and o.episode_index = e.episode_index group by e.split""", extra=_BENT)
def summary_vs_frames(t: Tables) -> DataFrame:
    return R.summary_vs_frames(_published(t), _bent(t))


@query("K17 rows", "v_frames v_episodes", """select split, episode_index, field, published, observed from (
select e.split, e.episode_index, unnest(['episode_index/min', 'episode_index/max', 'episode_index/mean', 'task_index/min', 'task_index/max', 'task_index/mean', 'episode_index/count']) as field,
 unnest([cast(sum_episode as double), sum_episode, sum_episode, sum_task, sum_task, sum_task, e.length]) as published,
 unnest([cast(e.episode_index as double), e.episode_index, e.episode_index, ta, tb, round(tm, 6) + 0.0, n]) as observed
from v_episodes e join (select split, episode_index, count(*) as n, min(task_index) as ta, max(task_index) as tb, avg(task_index) as tm from bent group by all) o
on o.split = e.split and o.episode_index = e.episode_index) where abs(published - observed) > case when field = 'task_index/mean' then 1e-6 else 0 end""", extra=_BENT)
def summary_mismatches(t: Tables) -> DataFrame:
    return R.summary_mismatches(_published(t), _bent(t)).withColumn("observed", rounded("observed"))


@query("K18", "v_frames v_episodes", """select rows, episodes, violating_rows, integrity_errors,
case when rows <> er or episodes <> ee or integrity_errors > 0 then 'INCOMPLETE' when violating_rows > 0 then 'CHECK_FAILED' else 'PASS' end as status
from (select cast(sum(n) as bigint) as rows, count(*) as episodes, cast(sum(bad) as bigint) as violating_rows,
  cast(sum(nulls) + count_if(n <> length) + count_if(unknown > 0) as bigint)
  + (select count(*) from v_episodes e where not exists (select 1 from lost f where f.split = e.split and f.episode_index = e.episode_index)) as integrity_errors from gate),
 (select cast(sum(length) as bigint) as er, count(*) as ee from v_episodes)""", extra=_LOST)
def coverage_gate(t: Tables) -> DataFrame:
    lost = _lost(t)
    totals = R.row_identity_totals(lost, t.episodes)
    return R.coverage_gate(totals, R.unknown_and_missing(lost, t.episodes), t.episodes)


@query("K18 whole", "v_frames v_episodes", """select rows, episodes, violating_rows, 0::bigint as integrity_errors, case when violating_rows > 0 then 'CHECK_FAILED' else 'PASS' end as status
from (select count(*) as rows, count(distinct f.episode_index) as episodes, count_if(f.index <> dataset_from_index + frame_index) as violating_rows
from bent f join v_episodes e on e.split = f.split and e.episode_index = f.episode_index)""", extra=_BENT)
def coverage_gate_whole(t: Tables) -> DataFrame:
    """The same gate over frames that are all there."""
    bent = _bent(t)
    totals = R.row_identity_totals(bent, t.episodes)
    return R.coverage_gate(totals, R.unknown_and_missing(bent, t.episodes), t.episodes)


@query("W1", "v_frames v_episodes", """select q.episode_index, q.index, q.delta_index, q.selected_index, q.is_pad, v.value as selected_value from (
select f.episode_index, f.index, d as delta_index, greatest(dataset_from_index, least(dataset_to_index - 1, f.index + d)) as selected_index,
       f.index + d < dataset_from_index or f.index + d >= dataset_to_index as is_pad
from v_frames f join v_episodes e on e.episode_index = f.episode_index cross join (select unnest([-3, -1, 0, 2, 5]) as d)) q
join v_frames v on v.index = q.selected_index""")
def window_query(t: Tables) -> DataFrame:
    rows = R.frames_with_bounds(t.frames, t.episodes)
    return R.window_query(rows, OFFSETS, lookup=t.frames).select(
        "episode_index", "index", "delta_index", "selected_index", "is_pad", "selected_value"
    )


@query("W2", "v_frames v_episodes", """select f.episode_index, f.index, rel + d as requested, d as delta_index,
greatest(dataset_from_index, least(dataset_to_index - 1, rel + d)) as selected_index,
rel + d < dataset_from_index or rel + d >= dataset_to_index as is_pad
from (select *, row_number() over (order by index) - 1 as rel from v_frames where split = 'failure') f
join v_episodes e on e.episode_index = f.episode_index cross join (select unnest([-3, -1, 0, 2, 5]) as d)""")
def relative_index_bug(t: Tables) -> DataFrame:
    kept = R.select_episodes(t.frames, t.episodes.where("split = 'failure'"))
    rows = R.frames_with_bounds(kept, t.episodes)
    return R.window_query(rows, OFFSETS, base="relative_index", value=None).select(
        "episode_index", "index", (F.col("relative_index") + F.col("delta_index")).alias("requested"),
        "delta_index", "selected_index", "is_pad",
    )


@query("W3", "v_frames", """select event_id, cast(round_even(value * 20.0, 0) as bigint) as frame_offset,
abs(round_even(value * 20.0, 0) / 20.0 - value) > 1e-4 as off_grid from v_frames""")
def offsets_from_seconds(t: Tables) -> DataFrame:
    offset, off_grid = R.offsets_from_seconds(F.col("value"), 20.0)
    return t.frames.select("event_id", offset.alias("frame_offset"), off_grid.alias("off_grid"))


@query("W13", "v_frames", """select episode_index, count(*) as rows, count_if(value < p) as decreases, count_if(value <= p) as not_increasing
from (select *, lag(value) over (partition by episode_index order by frame_index) as p from v_frames) group by episode_index""")
def monotone_within(t: Tables) -> DataFrame:
    return R.monotone_within(t.frames, ["episode_index"], ["frame_index"], "value")


@query("K22", "", """select user_id, event_id, frame_index, round(frame_index / 30.0, 6) + 0.0 as timestamp, start + frame_index as index, task_index from (
select e.*, row_number() over (partition by e.user_id order by ts, event_id) - 1 as frame_index, s.start, t.task_index
from events e join (select user_id, cast(sum(count(*)) over (order by user_id) - count(*) as bigint) as start from events group by user_id) s on s.user_id = e.user_id
left join (select event_type, row_number() over (order by event_type) - 1 as task_index from (select distinct event_type from events)) t on t.event_type = e.event_type)""")
def assign_frame_fields(t: Tables) -> DataFrame:
    rows = t.table("events").select("user_id", "event_id", "ts", F.col("event_type").alias("task"))
    out = R.assign_frame_fields(rows, t.tasks, ["user_id"], ["ts", "event_id"], 30.0)
    return out.select("user_id", "event_id", "frame_index", rounded("timestamp").alias("timestamp"), "index", "task_index")


@query("F8", "v_frames v_tasks", """select f.event_id, case when f.task_index % 2 = 0 then t.task else 'do the task' end as prompt
from v_frames f join v_tasks t on t.task_index = f.task_index""")
def prompt_from_task(t: Tables) -> DataFrame:
    from episcope.operators.transforms import prompt_from_task as prompts

    known = t.tasks.where(F.col("task_index") % 2 == 0)
    return prompts(t.frames, known, default="do the task").select("event_id", "prompt")


_WIN = "over (partition by f.episode_index order by f.frame_index rows between current row and 3 following)"


@query("F9", "v_frames v_episodes", """select event_id, array_to_string(list_transform([0, 1, 2, 3], lambda k: xs[least(k, length - 1 - frame_index) + 1]), ',') as chunk,
array_to_string(list_transform([0, 1, 2, 3], lambda k: case when frame_index + k > length - 1 then 'p' else '-' end), '') as pads
from (select f.event_id, f.frame_index, e.length, list(f.event_id) """ + _WIN + """ as xs
from v_frames f join v_episodes e on e.episode_index = f.episode_index)""")
def action_chunks(t: Tables) -> DataFrame:
    rows = t.frames.join(t.episodes.select("split", "episode_index", "length"), ["split", "episode_index"])
    out = R.action_chunks(rows, 4, value="event_id", block_rows=16)
    return out.select(
        "event_id", F.array_join(F.transform("chunk", lambda x: x.cast("string")), ",").alias("chunk"),
        F.array_join(F.transform("chunk_is_pad", lambda x: F.when(x, "p").otherwise("-")), "").alias("pads"),
    )


@query("F10", "v_frames", """select dataset_index, episode_index, frame_index, value from (
select 0::bigint as dataset_index, episode_index, frame_index, value from v_frames where split = 'success'
union all select 1, episode_index, frame_index, value from v_frames where split = 'failure')""")
def common_features_union(t: Tables) -> DataFrame:
    good = t.frames.where("split = 'success'").select("episode_index", "frame_index", "value", "ts")
    bad = t.frames.where("split = 'failure'").select("frame_index", "episode_index", "value", "task_index")
    union, _disabled = R.common_features_union({"good": good, "bad": bad})
    return union
