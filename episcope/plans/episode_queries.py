"""Queries over episode tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions.columns import count_true, joined_tasks, source_prefix, task_text
from episcope.operators import lineage as L
from episcope.plans.registry import query
from episcope.plans.views import UNITS_PER_SECOND, Tables


def near(a: str, b: str) -> str:
    """SQL text of the closeness rule."""
    return f"(abs({a} - {b}) <= greatest(1e-5, 1e-7 * greatest(abs({a}), abs({b}))))"


# The published summaries of an episode as scalars, and the findings on them.
_F0 = """
p as (select *, cast(sum_episode as double) as pe, cast(sum_index_min as double) as pl,
             cast(sum_index_min + length - 1 as double) as ph, (2.0 * sum_index_min + length - 1) / 2 as pm,
             row_number() over (partition by source_prefix order by episode_index) - 1 as le,
             cast(sum(length) over (partition by source_prefix order by episode_index) - length as bigint) as ls
      from v_episodes)"""
_GE = near("pe", "episode_index")
_GL = near("pl", "dataset_from_index")
_GH = near("ph", "(dataset_to_index - 1)")
_GM = near("pm", "((dataset_from_index + dataset_to_index - 1) / 2.0)")
_LE = near("pe", "le")
_LL = near("pl", "ls")
_LH = near("ph", "(ls + length - 1)")
_LM = near("pm", "((2.0 * ls + length - 1) / 2.0)")
FINDINGS_SQL = _F0 + f""",
fnd as (select *, identity_bad and task_bad as both_bad, identity_bad and not task_bad as identity_only,
             not identity_bad and task_bad as task_only, not identity_bad and not task_bad as neither_bad
      from (select p.*, not ({_GE} and {_GL} and {_GH} and {_GM}) as identity_bad,
                   {_LE} and {_LL} and {_LH} and {_LM} as local_matches,
                   {_LE} and {_LL} as local_start_matches,
                   episode_index = le and dataset_from_index = ls as coincides,
                   t.task is null or t.task <> p.task as task_bad
            from p left join v_tasks t on t.task_index = cast(round_even(p.sum_task, 0) as bigint)))"""
_ROLL = """
count(*) as episodes, cast(sum(length) as bigint) as frames,
count_if(identity_bad) as identity_bad, count_if(task_bad) as task_bad, count_if(both_bad) as both_bad,
count_if(identity_only) as identity_only, count_if(task_only) as task_only, count_if(neither_bad) as neither_bad,
count_if(local_matches) as local_matches, count_if(coincides) as coincident_rows,
100.0::double * count_if(identity_bad) / count(*) as identity_bad_percent,
min(episode_index - le) as episode_offset_min, max(episode_index - le) as episode_offset_max,
min(dataset_from_index - ls) as frame_offset_min, max(dataset_from_index - ls) as frame_offset_max"""


def findings(t: Tables) -> DataFrame:
    return L.summary_findings(t.episode_meta, t.tasks)


def counters_sql(pairs: dict[str, str], source: str) -> str:
    """SQL for rows (counter, violations, status) from named conditions."""
    parts = [
        f"select '{n}' as counter, cast(coalesce(sum(case when {c} then 1 else 0 end), 0) as bigint) as violations from {source}"
        for n, c in pairs.items()
    ]
    return (
        "select counter, violations, case when violations = 0 then 'pass' else 'violations' end as status from ("
        + " union all ".join(parts)
        + ")"
    )


# ---- projections and predicates -----------------------------------------------------------------


@query("B1", "v_episodes", "select episode_index, case when episode_id = '' then '<empty>' else split_part(episode_id, '/', 1) end as prefix from v_episodes")
def source_prefix_of(t: Tables) -> DataFrame:
    return t.episode_meta.select("episode_index", source_prefix("episode_id").alias("prefix"))


@query("B2", "v_episodes", """select episode_index, task as only_task, case when length > 60 then '' else task end as strict_text,
case when length > 60 then concat(task, '|', split) else task end as joined from v_episodes""")
def task_texts(t: Tables) -> DataFrame:
    many = F.when(F.col("length") > 60, F.concat("tasks", F.array("split"))).otherwise(F.col("tasks"))
    return t.episode_meta.withColumn("many", many).select(
        "episode_index", task_text("tasks").alias("only_task"), task_text("many").alias("strict_text"),
        joined_tasks("many").alias("joined"),
    )


@query("B11", "v_episodes", "select task, split, count(*) as rows from v_episodes group by all having count(*) > 1")
def duplicate_episode_keys(t: Tables) -> DataFrame:
    return L.duplicate_keys(L.guard_unique(t.episodes, ["episode_index"]), ["task", "split"])


@query("B10", "v_episodes", f"""select episode_index, {near('pe', 'episode_index')} as episode_close,
{near('pl', 'dataset_from_index')} as start_close from p""", extra=_F0)
def tolerance_predicate(t: Tables) -> DataFrame:
    fields = L.global_identity()
    return t.episode_meta.select(
        "episode_index", fields["episode_index_min"].alias("episode_close"), fields["index_min"].alias("start_close")
    )


# ---- joins ---------------------------------------------------------------------------------------


@query("C1", "v_episodes v_tasks", """select e.episode_index, cast(round_even(e.sum_task, 0) as bigint) as lookup_index,
t.task as resolved_text, coalesce(t.task <> e.task, true) as task_bad
from v_episodes e left join v_tasks t on t.task_index = cast(round_even(e.sum_task, 0) as bigint)""")
def resolve_reference(t: Tables) -> DataFrame:
    out = L.resolve_reference(L.with_source(t.episode_meta), t.tasks, L.cell("task_index", "min"))
    bad = ~F.coalesce(F.col("resolved_text") == F.col("task_text"), F.lit(False))
    return out.select("episode_index", "lookup_index", "resolved_text", bad.alias("task_bad"))


# ---- aggregations --------------------------------------------------------------------------------


@query("D1", "v_episodes", counters_sql({
    "nonpositive_lengths": "length <= 0", "short_episodes": "length < 60",
    "interval_length_mismatches": "dataset_to_index - dataset_from_index <> length",
    "summary_episode_wrong": "sum_episode <> episode_index"}, "v_episodes"))
def violation_counts(t: Tables) -> DataFrame:
    return L.violation_counts(t.episodes, {
        "nonpositive_lengths": F.col("length") <= 0,
        "short_episodes": F.col("length") < 60,
        "interval_length_mismatches": F.col("dataset_to_index") - F.col("dataset_from_index") != F.col("length"),
        "summary_episode_wrong": F.col("sum_episode") != F.col("episode_index"),
    })


@query("D2", "v_episodes", """select counter, violations, case when violations = 0 then 'pass' else 'violations' end as status from (
select 'duplicate_episode_index' as counter, count(*) - count(distinct episode_index) as violations from v_episodes
union all select 'duplicate_length', count(*) - count(distinct length) from v_episodes
union all select 'duplicate_task', count(*) - count(distinct task) from v_episodes)""")
def duplicates(t: Tables) -> DataFrame:
    return L.duplicates(t.episodes, ["episode_index", "length", "task"])


@query("D3", "v_episodes v_tasks", f"select split, source_prefix, {_ROLL} from fnd group by split, source_prefix", extra=FINDINGS_SQL)
def prefix_rollup(t: Tables) -> DataFrame:
    return L.prefix_rollup(findings(t))


@query("D4", "v_episodes v_tasks", f"""select split, source_prefix, cast(grouping_id(split, source_prefix) as bigint) as level, {_ROLL}
from fnd group by grouping sets ((split, source_prefix), (source_prefix), ())""", extra=FINDINGS_SQL)
def prefix_rollup_combined(t: Tables) -> DataFrame:
    return L.prefix_rollup_combined(findings(t))


@query("D5", "v_episodes v_tasks", """select split, identity_bad, task_bad, count(*) as episodes, cast(sum(length) as bigint) as frames
from fnd group by all""", extra=FINDINGS_SQL)
def joint_outcomes(t: Tables) -> DataFrame:
    return L.joint_outcomes(findings(t))


@query("D25", "v_episodes v_tasks", """select name, declared, observed, declared = observed as matches from (
select 'total_episodes' as name, cast(150 as bigint) as declared, (select count(*) from v_episodes) as observed
union all select 'total_frames', 9999, (select max(dataset_to_index) from v_episodes)
union all select 'total_tasks', 5, (select count(*) from v_tasks))""")
def declared_totals(t: Tables) -> DataFrame:
    return L.declared_totals(t.episode_meta, t.tasks, {"total_episodes": 150, "total_frames": 9999, "total_tasks": 5})


@query("D26", "v_episodes", """select contract, counter, cast(sum(v) as bigint) as violations, count(*) as shards from (
select 'identity' as contract, 'summary_episode_wrong' as counter, episode_index // 10 as shard, count_if(sum_episode <> episode_index) as v from v_episodes group by episode_index // 10
union all select 'identity', 'summary_start_wrong', episode_index // 10, count_if(sum_index_min <> dataset_from_index) from v_episodes group by episode_index // 10
union all select 'length', 'short_episodes', episode_index // 10, count_if(length < 60) from v_episodes group by episode_index // 10)
group by contract, counter""")
def shard_rollup(t: Tables) -> DataFrame:
    shards = t.episodes.groupBy(F.floor(F.col("episode_index") / 10).alias("shard")).agg(
        count_true(F.col("sum_episode") != F.col("episode_index")).alias("a"),
        count_true(F.col("sum_index_min") != F.col("dataset_from_index")).alias("b"),
        count_true(F.col("length") < 60).alias("c"),
    )
    named = F.array(*[
        F.struct(F.lit(k).alias("contract"), F.lit(n).alias("counter"), F.col(c).alias("violations"))
        for k, n, c in (("identity", "summary_episode_wrong", "a"), ("identity", "summary_start_wrong", "b"), ("length", "short_episodes", "c"))
    ])
    return L.shard_rollup(shards.select("shard", F.explode(named).alias("x")).select("shard", "x.*"))


# ---- ordered checks ------------------------------------------------------------------------------


@query("W4", "v_episodes", """select episode_index, previous_index, coalesce(episode_index <> previous_index + 1, false) as is_gap
from (select episode_index, lag(episode_index) over (order by episode_index) as previous_index
      from (select episode_index + episode_index // 11 as episode_index from v_episodes))""")
def index_gaps(t: Tables) -> DataFrame:
    """The numbering jumps by one after every eleventh episode."""
    jumped = F.col("episode_index") + F.floor(F.col("episode_index") / 11)
    return L.index_gaps(t.episodes.select(jumped.alias("episode_index"))).select("episode_index", "previous_index", "is_gap")


@query("W5", "v_episodes", """select episode_index, dataset_from_index <> coalesce(prev, 0) as is_break
from (select *, lag(dataset_to_index) over (order by episode_index) as prev from (
  select episode_index, dataset_to_index, case when episode_index % 13 = 5 then 0 else dataset_from_index end as dataset_from_index from v_episodes))""")
def chain_breaks(t: Tables) -> DataFrame:
    reset = t.episodes.withColumn(
        "dataset_from_index", F.when(F.col("episode_index") % 13 == 5, 0).otherwise(F.col("dataset_from_index"))
    )
    return L.chain_breaks(reset).select("episode_index", "is_break")


@query("W6", "v_episodes", """select episode_index, expected_to_index - length as expected_from_index, expected_to_index,
dataset_from_index = expected_to_index - length and dataset_to_index = expected_to_index as chain_ok
from (select *, cast(sum(length) over (order by episode_index) as bigint) as expected_to_index from v_episodes)""")
def prefix_sum_offsets(t: Tables) -> DataFrame:
    return L.prefix_sum_offsets(t.episodes).select(
        "episode_index", "expected_from_index", "expected_to_index", "chain_ok"
    )


@query("W7", "v_episodes", "select source_prefix, episode_index, le as local_episode, ls as local_start from p", extra=_F0)
def local_numbering(t: Tables) -> DataFrame:
    return L.local_numbering(L.with_source(t.episode_meta)).select(
        "source_prefix", "episode_index", "local_episode", "local_start"
    )


@query("W8", "v_vocab v_episodes", """select e.source_prefix, e.episode_index, e.task as task_text, v.code as local_code,
(select count(*) from v_vocab w where w.source_prefix = e.source_prefix) as vocabulary_size
from v_episodes e join v_vocab v on v.source_prefix = e.source_prefix and v.task = e.task""")
def local_vocabulary(t: Tables) -> DataFrame:
    rows = L.with_source(t.episode_meta).select("source_prefix", "task_text", "episode_index")
    codes = L.local_vocabulary(rows)
    sizes = codes.groupBy("source_prefix").agg(F.count(F.lit(1)).alias("vocabulary_size"))
    return rows.join(codes, ["source_prefix", "task_text"]).join(sizes, "source_prefix").select(
        "source_prefix", "episode_index", "task_text", "local_code", "vocabulary_size"
    )


@query("W9", "v_episodes", """select source_prefix, min(episode_index - le) as episode_offset_min, max(episode_index - le) as episode_offset_max,
min(dataset_from_index - ls) as frame_offset_min, max(dataset_from_index - ls) as frame_offset_max,
count_if(episode_index = le and dataset_from_index = ls) as coincident_rows from p group by source_prefix""", extra=_F0)
def numbering_offsets(t: Tables) -> DataFrame:
    return L.numbering_offsets(L.with_source(t.episode_meta))


@query("W16", "v_episodes v_tasks", """select split, min(case when identity_bad then episode_index end) as first_affected,
min(case when not identity_bad then episode_index end) as first_control from fnd group by split""", extra=FINDINGS_SQL)
def first_affected_and_control(t: Tables) -> DataFrame:
    return L.first_affected_and_control(findings(t))


# ---- named contracts -----------------------------------------------------------------------------


@query("K0", "v_episodes", """select counter, violations, case when violations = 0 then 'pass' else 'violations' end as status, 'robot_type' as detail
from (select 'missing_required_columns' as counter, cast(1 as bigint) as violations
union all select 'row_count_mismatch', cast((select count(*) from v_episodes) <> 151 as bigint)
union all select 'column_count_mismatch', cast(0 as bigint))""")
def contract_schema(t: Tables) -> DataFrame:
    meta = t.episode_meta
    return L.contract_schema(meta, [*L.REQUIRED_COLUMNS, "robot_type"], known_columns=len(meta.columns), known_rows=151)


_K1 = {
    "empty_episode_ids": "episode_id = ''", "empty_tasks": "task is null", "nonpositive_lengths": "length <= 0",
    "negative_episode_indices": "episode_index < 0",
    "episode_index_gaps": "episode_index <> pi + 1", "interval_length_mismatches": "dataset_to_index - dataset_from_index <> length",
    "interval_chain_breaks": "dataset_from_index <> ps", "first_start_not_zero": "ps is null and dataset_from_index <> 0",
    "negative_file_indices": "episode_index // 10 < 0",
    "episode_summary_mismatches": f"not {_GE}", "index_location_mismatches": f"not ({_GL} and {_GH} and {_GM})",
    "index_std_mismatches": "false", "index_any_mismatches": f"not ({_GL} and {_GH} and {_GM})",
    "identity_mismatches": f"not ({_GE} and {_GL} and {_GH} and {_GM})",
    "identity_mismatches_local_pattern": f"not ({_GE} and {_GL} and {_GH} and {_GM}) and {_LE} and {_LL}",
    "duplicate_episode_indices": "episode_index = pi", "duplicate_episode_ids": "id_nr > 1",
    "missing_identity_values": "episode_index is null or length is null or dataset_from_index is null or dataset_to_index is null",
}


@query("K1", "v_episodes", counters_sql(_K1, "q"), extra=_F0 + """,
q as (select *, row_number() over (partition by episode_id order by episode_index) as id_nr, lag(episode_index) over (order by episode_index) as pi, lag(dataset_to_index) over (order by episode_index) as ps from p)""")
def contract_identity(t: Tables) -> DataFrame:
    return L.contract_identity(t.episode_meta)


@query("K2", "v_episodes", counters_sql({
    "episode_index_min": f"not {_GE}", "episode_index_max": f"not {_GE}", "episode_index_mean": f"not {_GE}",
    "episode_index_std": "false", "index_min": f"not {_GL}", "index_max": f"not {_GH}", "index_mean": f"not {_GM}"}, "p"), extra=_F0)
def identity_summary(t: Tables) -> DataFrame:
    return L.identity_summary(t.episode_meta)


@query("K3", "v_episodes", f"""select source_prefix, count(*) as episodes, count_if({_LE} and {_LL} and {_LH} and {_LM}) as local_matches,
count_if({_GE} and {_GL} and {_GH} and {_GM}) as global_matches,
bool_and(({_GE} and {_GL} and {_GH} and {_GM}) = (episode_index = le and dataset_from_index = ls)) as coherent_iff_coincident
from p group by source_prefix""", extra=_F0)
def identity_summary_local(t: Tables) -> DataFrame:
    return L.identity_summary_local(t.episode_meta)


def _near(a: str, b: str) -> str:
    return f"abs(({a}) - ({b})) <= greatest(1e-5, 1e-7 * greatest(abs({a}), abs({b})))"


_RUN_STD = "(case when length > 1 then sqrt((length * length - 1) / 12.0) else 0 end)"
#: Stored times are frame numbers over 15; the check expects them over 30.
_OFF_TIME = " and ".join(_near(f"{x} / 15.0", f"{x} / 30.0") for x in ("(length - 1)", "((length - 1) / 2.0)", _RUN_STD))


@query("K4", "v_episodes", counters_sql({
    "index_std_mismatches": f"not ({_near(_RUN_STD, 'sqrt(greatest(length * length - 1, 0) / 12.0)')})",
    "frame_index_mismatches": f"not ({_near('length - 1', 'dataset_to_index - dataset_from_index - 1')} and {_near(_RUN_STD, 'sqrt(greatest(length * length - 1, 0) / 12.0)')})",
    "timestamp_mismatches": f"not ({_OFF_TIME})"}, "v_episodes"))
def uniform_std_check(t: Tables) -> DataFrame:
    """The stored times use another frame rate than the declared one, so every time summary fails."""
    return L.uniform_std_check(t.episode_meta, fps=2 * UNITS_PER_SECOND)


@query("K9", "v_episodes", counters_sql({
    "nonconstant_task": f"not ({_near('low', 'high')} and {_near('std', '0')})",
    "nonintegral_task": f"not ({_near('low', 'round(low)')})"}, "bent"),
    extra="""bent as (select sum_task + case when episode_index % 7 = 4 then 0.25 else 0 end as low, sum_task + case when episode_index % 7 = 4 then 0.25 else 0 end as high,
  case when episode_index % 7 = 2 then 0.5 else 0 end as std from v_episodes)""")
def stat_constant_task(t: Tables) -> DataFrame:
    k = F.col("episode_index") % 7
    planted = t.episode_meta.withColumns({
        "stats/task_index/std": F.when(k == 2, F.array(F.lit(0.5))).otherwise(F.col("`stats/task_index/std`")),
        **{f"stats/task_index/{m}": F.when(k == 4, F.transform(F.col(f"`stats/task_index/{m}`"), lambda x: x + 0.25))
           .otherwise(F.col(f"`stats/task_index/{m}`")) for m in ("min", "max")},
    })
    return L.constant_task_check(planted)


@query("K19", "v_episodes", """select episode_index, cast(episode_index as double) as fixed_min, cast(episode_index as double) as fixed_mean,
0.0::double as kept_std, cast(1 as integer) as width from v_episodes""")
def correct_summary(t: Tables) -> DataFrame:
    fixed = L.correct_summary(t.episode_meta)
    return fixed.select(
        "episode_index", L.cell("episode_index", "min").alias("fixed_min"), L.cell("episode_index", "mean").alias("fixed_mean"),
        L.cell("episode_index", "std").alias("kept_std"), F.size("`stats/episode_index/max`").alias("width"),
    )


def _unified(t: Tables) -> DataFrame:
    """A larger vocabulary in another order, as a merge target has."""
    return t.tasks.select("task", (F.lit(100) - F.col("task_index")).alias("task_index"))


@query("K20", "v_episodes v_tasks", """select e.episode_index + 1000 as episode_index, e.dataset_from_index + 500000 as dataset_from_index,
e.dataset_to_index + 500000 as dataset_to_index, cast(e.sum_episode + 1000 as double) as summary_min,
cast(e.sum_index_min + 500000 as double) as index_min, t.task as own_task, 100 - t.task_index as unified_task_index
from v_episodes e left join v_tasks t on t.task_index = e.sum_task""")
def merge_offset(t: Tables) -> DataFrame:
    out = L.merge_offset(t.episode_meta, 1000, 500_000, t.tasks, _unified(t))
    return out.select(
        "episode_index", "dataset_from_index", "dataset_to_index", L.cell("episode_index", "min").alias("summary_min"),
        L.cell("index", "min").alias("index_min"), "own_task", "unified_task_index",
    )


@query("K21", "v_episodes v_tasks", f"""select condition, kind, count(*) as records, count_if(w > 0) as violating_records, cast(sum(w) as bigint) as violating_fields from (
select 'original' as condition, case when identity_bad then 'affected' else 'control' end as kind,
       case when {near('(pe + 1000)', '(episode_index + 1000)')} then 0 else 3 end as w from fnd
union all select 'corrected', case when identity_bad then 'affected' else 'control' end, 0 from fnd) group by condition, kind""", extra=FINDINGS_SQL)
def merge_exposure(t: Tables) -> DataFrame:
    merged = {
        "original": L.merge_offset(t.episode_meta, 1000, 500_000, t.tasks, _unified(t)),
        "corrected": L.merge_offset(L.correct_summary(t.episode_meta), 1000, 500_000, t.tasks, _unified(t)),
    }
    return L.merge_exposure(findings(t), merged, 1000)


@query("K23", "v_tasks", """select task, task_index from known
union all select task, 1 + row_number() over (order by arrival, task) from (
  select e.event_type as task, min(event_id) as arrival from events e
  where e.event_type not in (select task from known) group by 1)""", extra="""
known as (select * from v_tasks v where (select count(distinct event_type) from events e where e.event_type < v.task) < 2)""")
def extend_vocabulary(t: Tables) -> DataFrame:
    known = t.tasks.where(F.col("task_index") < 2)
    arriving = t.table("events").select(F.col("event_type").alias("task"), F.col("event_id").alias("arrival"))
    return L.extend_vocabulary(known, arriving)


