"""Queries on vector statistics and their error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions.columns import rounded, scalar_cell, scalar_cell_bad
from episcope.operators import lineage as L
from episcope.operators import statistics as M
from episcope.operators import transforms as X
from episcope.plans.registry import query
from episcope.plans.views import UNITS_PER_SECOND, Tables

SIZES = (1, 8, 32, 128)
FEATURES = {"state": "state", "actions": "actions"}
CONDITION_SQL = "arm, order_name, batch_size"


def _long(t: Tables) -> DataFrame:
    return M.long_components(t.vectors, FEATURES)


def _replayed(t: Tables) -> DataFrame:
    """Eleven orders of the vectors' numbers, written once for the queries of the study."""
    return t._once("replayed", lambda: M.order_replay(t.vectors, M.episode_orders(t.vectors, range(1, 11))))


def _reference(t: Tables) -> DataFrame:
    return t._once("reference_moments", lambda: M.vector_moments(_long(t)))


def _conditions(t: Tables) -> DataFrame:
    return t._once("conditions", lambda: M.condition_stats(_replayed(t), t.vectors, SIZES, FEATURES))


def _errors(t: Tables) -> DataFrame:
    return M.condition_errors(_conditions(t), _reference(t))


def _cells(t: Tables) -> DataFrame:
    return M.condition_cells(_errors(t))


def _round(df: DataFrame, names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names.split()})


_ORD = """nn as (select max(episode_index) + 1 as n from v_vec),
fa as (select n, case when n % 3 <> 0 then 3 when n % 7 <> 0 then 7 when n % 11 <> 0 then 11 when n % 13 <> 0 then 13 else 1 end as a from nn),
ords as (select 'natural' as order_name, episode_index, episode_index as position from (select distinct episode_index from v_vec)
 union all select 'shift' || b, episode_index, (a * episode_index + b) % n from (select distinct episode_index from v_vec), fa, (select unnest(range(1, 11)) as b)),
rep as (select o.order_name, v.*, row_number() over (partition by o.order_name order by o.position, v.frame_index) - 1 as ordinal
  from v_vec v join ords o on o.episode_index = v.episode_index)"""
_COND = _ORD + """,
bat as (select * from rep cross join (select unnest([1, 8, 32, 128]) as batch_size)),
bl as (select order_name, batch_size, ordinal, 'state' as feature_group, unnest(range(64)) as component_index, unnest(state) as x from bat
 union all select order_name, batch_size, ordinal, 'actions', unnest(range(64)), unnest(actions) from bat),
bc as (select order_name, batch_size, ordinal // batch_size as b, feature_group, component_index, count(*) as n, avg(x::double) as m, avg(x::double * x::double) as q,
  avg((x::float * x::float)::double) as q1, var_pop(x::double) * count(*) as m2, min_by(x::double, ordinal) as first_x from bl group by all),
bm as (select order_name, batch_size, feature_group, component_index, cast(sum(n) as bigint) as count, sum(n * m) / sum(n) as mean, sum(n * q) / sum(n) as sq, sum(n * q1) / sum(n) as sq1,
  count(*) as batches, avg(first_x) as fm, avg(first_x * first_x) as fq from bc group by all),
bs as (select bm.*, (select sum(bc.m2 + bc.n * (bc.m - bm.mean) * (bc.m - bm.mean)) from bc where bc.order_name = bm.order_name and bc.batch_size = bm.batch_size
  and bc.feature_group = bm.feature_group and bc.component_index = bm.component_index) as m2 from bm),
cs as (select 'first_row' as arm, order_name, batch_size, feature_group, component_index, batches as count, fm as mean, sqrt(greatest(0, fq - fm * fm)) as std from bs
 union all select 'all_rows', order_name, batch_size, feature_group, component_index, count, mean, sqrt(greatest(0, sq - mean * mean)) from bs
 union all select 'all_rows_single_squares', order_name, batch_size, feature_group, component_index, count, mean, sqrt(greatest(0, sq1 - mean * mean)) from bs
 union all select 'all_rows_stable', order_name, batch_size, feature_group, component_index, count, mean, sqrt(m2 / count) from bs),
ref as (select feature_group, component_index, avg(x) as mean, stddev_pop(x) as std from v_comp group by all),
er as (select cs.arm, cs.order_name, cs.batch_size, cs.feature_group, cs.component_index, abs(cs.mean - ref.mean) as mean_error, abs(cs.std - ref.std) as std_error
  from cs join ref on ref.feature_group = cs.feature_group and ref.component_index = cs.component_index),
ce as (select arm, order_name, batch_size, feature_group, max(mean_error) as m, max(std_error) as s from er group by all)"""


@query("A4", "v_vec", """select count(*) as rows, count_if(s is null) as null_vectors, count_if(len(s) <> 64) as wrong_width, count_if(len(list_filter(s, lambda x: x is null)) > 0) as null_elements,
count_if(len(list_filter(s, lambda x: x is not null and not isfinite(x))) > 0) as nonfinite_elements, 'array<float>' as vector_type from (
select case vec_id % 10 when 1 then state[1:63] when 2 then list_transform(state, lambda x, i: case when i <> 6 then x end)
  when 3 then list_transform(state, lambda x, i: case when i = 8 then 'inf'::float else x end) else state end as s from v_vec)""")
def vector_guard(t: Tables) -> DataFrame:
    """A tenth each is too short, holds a null, or holds an infinity."""
    k = F.col("vec_id") % 10
    inf = F.lit(float("inf")).cast("float")
    bent = t.vectors.withColumn("state", F.when(k == 1, F.slice("state", 1, 63))
        .when(k == 2, F.transform("state", lambda x, i: F.when(i != 5, x)))
        .when(k == 3, F.transform("state", lambda x, i: F.when(i == 7, inf).otherwise(x))).otherwise(F.col("state")))
    return M.vector_guard(bent, "state", 64)


@query("A5", "v_episodes", """select episode_index, case when episode_index % 9 <> 4 then cast(sum_index_min as double) end as index_min, episode_index % 9 = 4 as bad_cell from v_episodes""")
def unwrap_scalar(t: Tables) -> DataFrame:
    c = F.col("`stats/index/min`")
    bent = t.episode_meta.withColumn("c", F.when(F.col("episode_index") % 9 == 4, F.concat(c, c)).otherwise(c))
    return bent.select("episode_index", scalar_cell("c").alias("index_min"), scalar_cell_bad("c").alias("bad_cell"))


@query("D7", "v_comp", """select feature_group, component_index, count(*) as count, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) + 0.0 as std,
round(quantile_cont(x, 0.01), 6) + 0.0 as q01, round(quantile_cont(x, 0.99), 6) + 0.0 as q99 from v_comp group by all""")
def vector_moments(t: Tables) -> DataFrame:
    return _round(M.vector_moments(_long(t)), "mean std q01 q99")


@query("D8", "v_comp", """select feature_group, component_index, count(*) as count, round(avg(x), 6) + 0.0 as mean,
round(sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))), 6) + 0.0 as std from v_comp group by all""")
def moments_by_squares(t: Tables) -> DataFrame:
    return _round(M.moments_by_squares(_long(t)), "mean std")


@query("D9", "v_comp", "select feature_group, component_index, count(*) as count, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) + 0.0 as std from v_comp group by all")
def moments_merge(t: Tables) -> DataFrame:
    long = M.long_components(t.vectors.withColumn("batch", F.floor(F.col("vec_id") / 32)), FEATURES, ["batch"])
    return _round(M.moments_merge(long, "batch"), "mean std").withColumn("count", F.col("count").cast("long"))


@query("D11", "v_vec v_comp", """select order_name, batch_size, feature_group, component_index, count, round(mean, 6) + 0.0 as mean, round(std, 6) + 0.0 as std
from cs where arm = 'first_row'""", extra=_COND)
def first_of_batch_moments(t: Tables) -> DataFrame:
    led = M.with_vectors(M.first_of_batch(_replayed(t), SIZES), t.vectors, list(FEATURES.values()))
    long = M.long_components(led, FEATURES, ["order_name", "batch_size"])
    return _round(M.moments_by_squares(long, ["order_name", "batch_size", *M.COMPONENT]), "mean std")


@query("D12", "v_comp", """select feature_group, component_index, round(min(case when upto >= 0.01 * n then lo + b * (hi - lo) / 5000 end), 6) + 0.0 as q01,
round(min(case when upto >= 0.99 * n then lo + b * (hi - lo) / 5000 end), 6) + 0.0 as q99, round(max((hi - lo) / 5000), 9) + 0.0 as bin_width from (
select *, sum(k) over (partition by feature_group, component_index order by b) as upto from (
select feature_group, component_index, lo, hi, n, least(4999, floor((x - lo) / (hi - lo) * 5000)) as b, count(*) as k
from v_comp join (select feature_group as fg, component_index as ci, min(x) - 1e-10 as lo, max(x) + 1e-10 as hi, count(*) as n from v_comp group by all)
on fg = feature_group and ci = component_index group by all)) group by all""")
def histogram_quantile(t: Tables) -> DataFrame:
    out = M.histogram_quantile(_long(t), {"q01": 0.01, "q99": 0.99})
    return _round(_round(out, "q01 q99"), "bin_width", 9)


@query("D13", "v_vec", """select order_name, batch_size, count(*) as population, count_if(ordinal % batch_size = 0) as consumed_faulty,
count_if(ordinal % batch_size = 0) = ceil(count(*) / batch_size) as faulty_as_predicted, count_if(ordinal % batch_size = 0) = count(*) as full_coverage
from rep cross join (select unnest([1, 8, 32, 128]) as batch_size) group by order_name, batch_size""", extra=_ORD)
def coverage_count(t: Tables) -> DataFrame:
    return M.coverage_count(_replayed(t), SIZES)


@query("D14 E19", "v_stats v_stats_first", """select f.label, f.feature_group, round(max(abs(f.mean - r.mean)), 6) + 0.0 as max_mean_error, round(max(abs(f.std - r.std)), 6) + 0.0 as max_std_error,
round(max(abs(f.q01 - r.q01)), 6) + 0.0 as max_q01_error, round(max(abs(f.q99 - r.q99)), 6) + 0.0 as max_q99_error,
bool_and(abs(f.mean - r.mean) <= 1e-5 and abs(f.std - r.std) <= 1e-5) as moments_within,
bool_and(abs(f.q01 - r.q01) <= greatest(1e-3, 2 * (f.max - f.min) / 5000) and abs(f.q99 - r.q99) <= greatest(1e-3, 2 * (f.max - f.min) / 5000)) as quantiles_within,
round(max(greatest(1e-3, 2 * (f.max - f.min) / 5000)), 6) + 0.0 as max_quantile_tolerance
from v_stats_first f join v_stats r on r.label = f.label and r.feature_group = f.feature_group and r.component_index = f.component_index group by f.label, f.feature_group""")
def stats_error(t: Tables) -> DataFrame:
    faulty = t.stats_first_rows.withColumn("bin_width", (F.col("max") - F.col("min")) / M.HISTOGRAM_BINS)
    out = M.stats_error(faulty, t.stats, ["label", *M.COMPONENT], ["label", "feature_group"])
    return _round(out, "max_mean_error max_std_error max_q01_error max_q99_error max_quantile_tolerance")


@query("D15", "v_stats", """select coalesce(s.label, p.label) as label, coalesce(s.feature_group, p.feature_group) as feature_group, count(*) as components, count_if(s.mean is null or p.mean is null) as unmatched,
bool_and(coalesce(greatest(abs(s.mean - p.mean), abs(s.std - p.std)) <= 1e-5, false)) as agrees from v_stats s
full join pub p on p.label = s.label and p.feature_group = s.feature_group and p.component_index = s.component_index group by all""",
       extra="""pub as (select label, feature_group, component_index, mean + case when label % 4 = 1 and component_index = 2 then 0.01 else 0 end as mean, std from v_stats
where not (component_index = 63 and label % 3 = 0))""")
def published_crosscheck(t: Tables) -> DataFrame:
    """The published table lacks a component of some labels and is off in one of others."""
    off = F.when((F.col("label") % 4 == 1) & (F.col("component_index") == 2), 0.01).otherwise(0.0)
    published = t.stats.withColumn("mean", F.col("mean") + off).where(
        ~((F.col("component_index") == 63) & (F.col("label") % 3 == 0)))
    out = M.published_crosscheck(t.stats, published, ["label", *M.COMPONENT], ["label", "feature_group"], 1e-5)
    return out.select("label", "feature_group", "components", "unmatched", "agrees")


@query("D16", "v_vec v_stats v_stats_first", """select label, count(*) as rows, round(max(worst), 4) + 0.0 as max_component_delta, round(quantile_cont(l2, 0.5), 4) + 0.0 as median_l2,
round(quantile_cont(l2, 0.95), 4) + 0.0 as p95_l2, max(worst) >= 0.5 and quantile_cont(l2, 0.5) >= 0.5 as material from (
select label, vec_id, max(abs(d)) as worst, sqrt(sum(d * d)) as l2 from (
select v.label, v.vec_id, (v.x - f.mean) / (f.std + 1e-6) - (v.x - r.mean) / (r.std + 1e-6) as d from v_comp v
join v_stats_first f on f.label = v.label and f.feature_group = v.feature_group and f.component_index = v.component_index
join v_stats r on r.label = v.label and r.feature_group = v.feature_group and r.component_index = v.component_index
where v.feature_group = 'actions') group by label, vec_id) group by label""")
def normalization_effect(t: Tables) -> DataFrame:
    def arrays(stats: DataFrame) -> DataFrame:
        return X.wide_stats(stats.where("feature_group = 'actions'"), ["label"], ("mean", "std"))

    out = M.normalization_effect(t.vectors, "actions", arrays(t.stats_first_rows), arrays(t.stats), ["label"], 0.5, 0.5)
    return _round(out, "max_component_delta median_l2 p95_l2", 4)


@query("D17", "v_vec v_comp", "select arm, order_name, " + ", ".join(f"round(max(greatest(m, s)) filter (where batch_size = {b}), 6) + 0.0 as worst_{b}" for b in SIZES)
       + ", " + ", ".join(f"case when max(greatest(m, s)) filter (where batch_size = {b}) <= 1e-5 then 'PASS' else 'FAIL' end as verdict_{b}" for b in SIZES)
       + " from ce group by arm, order_name", extra=_COND)
def condition_matrix(t: Tables) -> DataFrame:
    out = M.condition_matrix(_cells(t), SIZES)
    return _round(out, " ".join(f"worst_{b}" for b in SIZES))


@query("D18", "v_vec v_comp", """select arm, driver, count(*) as conditions, count_if(e > 1e-5) as failing from (
select arm, feature_group || '.mean' as driver, m as e from ce union all select arm, feature_group || '.std', s from ce) group by arm, driver""", extra=_COND)
def failure_drivers(t: Tables) -> DataFrame:
    return M.failure_drivers(_cells(t))


@query("D18", "v_vec v_comp", """select arm, count_if(s > 1e-5) as std_involved, count_if(m > 1e-5) as mean_involved, count_if(m > 1e-5 and s <= 1e-5) as mean_only from (
select arm, order_name, batch_size, max(m) as m, max(s) as s from ce group by all) group by arm""", extra=_COND)
def failure_kinds(t: Tables) -> DataFrame:
    return M.failure_kinds(_cells(t))


@query("D19", "v_vec v_comp", """select round(e, 6) + 0.0 as error, arm, order_name, batch_size, feature_group, statistic, component_index from (
select arm, order_name, batch_size, feature_group, component_index, 'mean' as statistic, round(mean_error, 9) as e from er
union all select arm, order_name, batch_size, feature_group, component_index, 'std', round(std_error, 9) from er)
order by e desc, arm, order_name, batch_size, feature_group, statistic, component_index limit 1""", extra=_COND)
def worst_cell(t: Tables) -> DataFrame:
    return _round(M.worst_cell(_errors(t)), "error")


@query("D20", "v_vec v_comp", """select arm, batch_size, count(*) as conditions, count_if(ok) as within, count_if(not ok) as above, round(max(m), 6) + 0.0 as max_mean_error, round(max(s), 6) + 0.0 as max_std_error
from (select arm, order_name, batch_size, max(m) as m, max(s) as s, bool_and(m <= 1e-5 and s <= 1e-5) as ok from ce group by all) group by grouping sets ((arm, batch_size), (arm))""", extra=_COND)
def arm_rollup(t: Tables) -> DataFrame:
    cells = _cells(t)
    per_arm = M.arm_rollup(cells).withColumn("batch_size", F.lit(None).cast("int"))
    both = M.arm_rollup(cells, ["arm", "batch_size"]).unionByName(per_arm)
    return _round(both, "max_mean_error max_std_error")


@query("D21", "v_vec v_comp", """select arm, 'order' as varied, cast(batch_size as varchar) as held, feature_group, round(max(m), 6) + 0.0 as mean_span, round(max(s), 6) + 0.0 as std_span from (
select arm, batch_size, feature_group, component_index, max(mean) - min(mean) as m, max(std) - min(std) as s from cs group by all) group by arm, batch_size, feature_group
union all select arm, 'batch', order_name, feature_group, round(max(m), 6) + 0.0, round(max(s), 6) + 0.0 from (
select arm, order_name, feature_group, component_index, max(mean) - min(mean) as m, max(std) - min(std) as s from cs group by all) group by arm, order_name, feature_group""", extra=_COND)
def sensitivity_span(t: Tables) -> DataFrame:
    parts = [
        M.sensitivity_span(_conditions(t), fixed).select(
            "arm", F.lit(varied).alias("varied"), F.col(fixed).cast("string").alias("held"), "feature_group", "mean_span", "std_span")
        for varied, fixed in (("order", "batch_size"), ("batch", "order_name"))
    ]
    return _round(parts[0].unionByName(parts[1]), "mean_span std_span")


@query("D24", "v_comp", """select feature_group, component_index, count(*) as count, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) + 0.0 as std,
round(min(x), 6) + 0.0 as min, round(max(x), 6) + 0.0 as max from v_comp group by all""")
def merge_feature_stats(t: Tables) -> DataFrame:
    return _round(M.merge_feature_stats(t.stats), "mean std min max")


@query("W14", "v_vec", "select order_name, vec_id, batch_size, ordinal // batch_size as batch_ordinal, ordinal % batch_size = 0 as leads_batch from rep cross join (select unnest([1, 8, 32, 128]) as batch_size)", extra=_ORD)
def batch_ordinal(t: Tables) -> DataFrame:
    return M.with_batches(_replayed(t), SIZES).select("order_name", "vec_id", "batch_size", "batch_ordinal", "leads_batch")


@query("C11", "v_vec", "select order_name, vec_id, ordinal from rep", extra=_ORD)
def order_replay(t: Tables) -> DataFrame:
    return _replayed(t).select("order_name", "vec_id", "ordinal")


# ---- statistics arrays ---------------------------------------------------------------------------


def _findings(t: Tables) -> DataFrame:
    return M.stat_findings(t.stat_arrays, F.col("feature_group") == "actions")


_IMG = "greatest(least(length, 100), least(floor(pow(length, 0.75)), 10000))"


@query("K6", "v_stat_arrays", "select label, feature_group, len(q99) <> len(min) or len(count) <> 1 as shape_bad from v_stat_arrays")
def stat_shape(t: Tables) -> DataFrame:
    return _findings(t).select("label", "feature_group", "shape_bad")


def _pairs(a: str, b: str, broken: str) -> str:
    """Whether some pair of finite components of two arrays is ``broken`` (over p.x and p.y)."""
    zipped = f"list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {{'x': {a}[i], 'y': {b}[i]}})"
    return f"len(list_filter({zipped}, lambda p: isfinite(p.x) and isfinite(p.y) and {broken})) > 0"


_ALL_METRICS = (*M.ARRAY_METRICS, "count")
_STAT_SQL = {
    "shape_bad": " or ".join(["len(min) = 0", "len(count) <> 1", *[f"len({m}) <> len(min)" for m in M.ARRAY_METRICS]]),
    "nonfinite": " or ".join(f"len(list_filter({m}, lambda x: not isfinite(x))) > 0" for m in _ALL_METRICS),
    "quantile_order_bad": " or ".join(_pairs(a, b, "p.x > p.y + 1e-9") for a, b in zip(M.ORDERED_METRICS, M.ORDERED_METRICS[1:])),
    "mean_outside": _pairs("mean", "min", "p.x < p.y - 1e-5") + " or " + _pairs("mean", "max", "p.x > p.y + 1e-5"),
    "negative_std": "len(list_filter(std, lambda x: not isnan(x) and x < -1e-12)) > 0",
}


@query("K7", "v_stat_arrays", "select label, feature_group, " + ", ".join(f"{_STAT_SQL[f]} as {f}" for f in ("nonfinite", "quantile_order_bad", "mean_outside", "negative_std")) + " from v_stat_arrays")
def stat_values(t: Tables) -> DataFrame:
    return _findings(t).select("label", "feature_group", "nonfinite", "quantile_order_bad", "mean_outside", "negative_std")


@query("K8", "v_stat_arrays", f"""select label, feature_group, cast(count[1] as bigint) <> case when feature_group = 'actions' then {_IMG} else length end as sample_count_bad from v_stat_arrays""")
def stat_sample_count(t: Tables) -> DataFrame:
    return _findings(t).select("label", "feature_group", "sample_count_bad")


@query("K10", "v_stat_arrays", "select counter, violations, case when violations = 0 then 'pass' else 'violations' end as status from (" + " union all ".join(
    f"select '{name}' as counter, count_if({bad}) as violations from v_stat_arrays" for name, bad in {
        **_STAT_SQL, "sample_count_bad": f"cast(count[1] as bigint) <> case when feature_group = 'actions' then {_IMG} else length end", "feature_rows": "true"}.items()) + ")")
def contract_stats(t: Tables) -> DataFrame:
    named = {f: F.col(f) for f in M.STAT_FINDINGS}
    return L.violation_counts(_findings(t), {**named, "feature_rows": F.lit(True)})


_QUANTILES = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}
_WIDE_COUNTERS = {
    "shape_bad": "len(q99) <> len(min)", "nonfinite": "len(list_filter(q50, lambda x: not isfinite(x))) > 0",
    "quantile_order_bad": _STAT_SQL["quantile_order_bad"], "mean_outside": _STAT_SQL["mean_outside"], "negative_std": _STAT_SQL["negative_std"],
    "sample_count_bad": "count[1]::bigint <> length",
}


def _near(a: str, b: str) -> str:
    return f"abs({a} - ({b})) <= greatest(1e-5, 1e-7 * greatest(abs({a}), abs({b})))"


def _closed(rate: float) -> str:
    wanted = {"min": "0", "max": f"(length - 1) / {rate}", "mean": f"(length - 1) / {2 * rate}",
              "std": f"case when length > 1 then sqrt((length * length - 1) / 12.0) else 0 end / {rate}"}
    return "not (" + " and ".join(_near(f"{m}[1]", w) for m, w in wanted.items()) + ")"


_WIDE = """wide as (select *, top / r as hi, ln / r as sd from (select episode_index, length, episode_index % 11 as k, feature, r,
  (length - 1)::double as top, case when length > 1 then sqrt((length * length - 1) / 12.0) else 0 end as ln, sum_task::double as code
  from v_episodes, (select 'frame_index' as feature, 1.0::double as r union all select 'task_index', 1.0 union all select 'timestamp', 15.0))),
st as (select episode_index, length, feature, k, case when feature = 'task_index' then [code] else [0.0] end as min,
  case when feature = 'task_index' then [code] else [hi] end as max,
  case when feature = 'task_index' then [code + case when k = 2 then 10 else 0 end] else [hi / 2 + case when k = 2 then 10000 else 0 end] end as mean,
  case when feature = 'task_index' then [case when k = 8 then 0.5 else 0.0 end * case when k = 3 then -1 else 1 end] else [sd * case when k = 3 then -1 else 1 end] end as std,
  case when feature = 'task_index' then [code] when k = 4 then [hi * 0.99, 0.0] else [hi * 0.99] end as q99, case when feature = 'task_index' then [code] else [hi * case when k = 1 then 0.9 else 0.1 end] end as q10,
  case when feature = 'task_index' then [code] when k = 5 then ['nan'::double] else [hi * 0.5] end as q50, case when feature = 'task_index' then [code] else [hi * case when k = 1 then 0.1 else 0.9 end] end as q90,
  case when feature = 'task_index' then [code] else [hi * 0.01] end as q01, [(length + case when k = 6 then 1 else 0 end)::double] as count from wide)"""


@query("K10 features", "v_episodes", "select counter, violations, case when violations = 0 then 'pass' else 'violations' end as status from ("
       + " union all ".join(f"select '{name}' as counter, count_if({bad}) as violations from st" for name, bad in _WIDE_COUNTERS.items())
       + f" union all select 'frame_index_closed_form', count_if({_closed(1.0)}) from st where feature = 'frame_index'"
       + f" union all select 'timestamp_closed_form', count_if({_closed(15.0)}) from st where feature = 'timestamp'"
       + f" union all select 'task_not_constant', count_if(not ({_near('min[1]', 'max[1]')} and {_near('std[1]', '0')})) from st where feature = 'task_index'"
       + " union all select 'features_without_metrics', 2)", extra=_WIDE)
def contract_statistics(t: Tables) -> DataFrame:
    """Stored episode statistics as wide columns: three whole features, two without quantiles, faults of each kind."""
    meta, k = t.episode_meta, F.col("episode_index") % 11
    rates = {"frame_index": 1.0, "timestamp": UNITS_PER_SECOND}
    columns = {}
    for feature, rate in rates.items():
        hi = (F.col("length") - 1) / rate
        swap = {"q10": 0.9, "q90": 0.1}
        for q, share in _QUANTILES.items():
            bent = F.when(k == 1, hi * swap[q]).otherwise(hi * share) if q in swap else hi * share
            columns[f"stats/{feature}/{q}"] = F.array(bent)
        columns[f"stats/{feature}/q99"] = F.when(k == 4, F.array(hi * 0.99, F.lit(0.0))).otherwise(F.array(hi * 0.99))
        columns[f"stats/{feature}/q50"] = F.array(F.when(k == 5, F.lit(float("nan"))).otherwise(hi * 0.5))
        columns[f"stats/{feature}/mean"] = F.array(hi / 2 + F.when(k == 2, 10000.0).otherwise(0.0))
    code = L.cell("task_index", "min")
    columns |= {f"stats/task_index/{q}": F.array(code) for q in _QUANTILES}
    columns["stats/task_index/mean"] = F.array(code + F.when(k == 2, 10.0).otherwise(0.0))
    columns["stats/task_index/std"] = F.array(F.when(k == 8, 0.5).otherwise(0.0))
    meta = meta.withColumns(columns)
    flip = {f"stats/{f}/std": F.transform(F.col(f"`stats/{f}/std`"), lambda x: F.when(k == 3, -x).otherwise(x)) for f in (*rates, "task_index")}
    more = {f"stats/{f}/count": F.transform(F.col(f"`stats/{f}/count`"), lambda x: x + F.when(k == 6, 1.0).otherwise(0.0)) for f in (*rates, "task_index")}
    return M.contract_statistics(meta.withColumns(flip | more), UNITS_PER_SECOND)


def _features(df: DataFrame) -> DataFrame:
    return df.select(F.concat("feature_group", F.lit("."), F.col("label").cast("string")).alias("feature"))


_COV = """used as (select distinct feature_group || '.' || label as feature from v_stats),
declared as (select distinct feature_group || '.' || label as feature from v_stats where label % 4 <> 1),
published as (select distinct feature_group || '.' || label as feature from v_stats where not (label % 5 = 2 and feature_group = 'state'))"""


@query("C9", "v_stats", """select feature, 'declared' as missing_from from used where feature not in (select feature from declared)
union all select feature, 'published' from used where feature not in (select feature from published)""", extra=_COV)
def feature_coverage(t: Tables) -> DataFrame:
    declared = t.stats.where(F.col("label") % 4 != 1)
    published = t.stats.where(~((F.col("label") % 5 == 2) & (F.col("feature_group") == "state")))
    return M.feature_coverage(_features(t.stats), _features(declared), _features(published))


@query("K11", "v_stats v_tasks", """select counter, violations, case when violations = 0 then 'pass' else 'violations' end as status from (
select 'features_missing_from_declared' as counter, (select count(*) from used where feature not in (select feature from declared)) as violations
union all select 'features_missing_from_published', (select count(*) from used where feature not in (select feature from published))
union all select 'empty_task_table', (select cast(count(*) = 0 as bigint) from v_tasks))""", extra=_COV)
def contract_companions(t: Tables) -> DataFrame:
    declared = t.stats.where(F.col("label") % 4 != 1)
    published = t.stats.where(~((F.col("label") % 5 == 2) & (F.col("feature_group") == "state")))
    return M.contract_companions(_features(t.stats), _features(declared), _features(published), t.tasks)
