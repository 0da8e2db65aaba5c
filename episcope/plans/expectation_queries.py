"""Queries that run expectations and suites on the paired case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions import calibration as K
from episcope.functions import geometry as G
from episcope.functions.columns import finite, rounded
from episcope.operators import compare as C
from episcope.operators import conversion as V
from episcope.operators import expectations as E
from episcope.plans import cases as P
from episcope.plans.registry import query
from episcope.plans.views import Tables

_V, _X = P.CASE_VIEWS, P.CASE_SQL


def _run(df: DataFrame, suite: list[E.Expectation]) -> DataFrame:
    out = E.run_suite(df, suite, by=["branch"])
    return out.select("branch", "ordinal", "type", "status", "success", "unexpected_count", "element_count")


def _sql(parts: list[tuple[str, str, str, str]]) -> str:
    """SQL rows from (case table, type, unexpected condition or '', table verdict or element condition)."""
    out = []
    for i, (table, type_, bad, other) in enumerate(parts):
        if bad:
            body = (f"count_if({bad}) = 0 as success, count_if({bad}) as unexpected_count, count_if({other}) as element_count")
        else:
            body = f"{other} as success, null::bigint as unexpected_count, null::bigint as element_count"
        out.append(f"select branch, {i} as ordinal, '{type_}' as type, 'EXECUTED' as status, {body} from {table} group by branch")
    return " union all ".join(out)


@query("E1", _V, _sql([("c_chain", "columns_match_set", "", "true"), ("c_chain", "columns_match_set", "", "false")]), extra=_X)
def columns_match_set(t: Tables) -> DataFrame:
    case = P.chain_case(t)
    return _run(case.public_rows, [
        E.columns_match_set(list(case.public), ignore=["branch"]), E.columns_match_set([*case.public, "robot_type"], ignore=["branch"])])


@query("E2", _V, _sql([("c_gripper", "not_null", "row_kind <> 'anchor'", "true"), ("c_gripper", "not_null", "false", "true")]), extra=_X)
def not_null(t: Tables) -> DataFrame:
    """The expected value is NaN on data rows, which counts as missing."""
    return _run(P.gripper_case(t).rows, [E.not_null("expected_norm"), E.not_null("gripper_norm")])


@query("E3", _V, _sql([("c_pose", "of_type", "", "true"), ("c_pose", "of_type", "", "false")]), extra=_X)
def of_type(t: Tables) -> DataFrame:
    return _run(P.pose_case(t).public_rows, [E.of_type("qx", "double"), E.of_type("instance_index", "double")])


@query("E4", _V, _sql([("c_displacement", "between", "world_delta_x < -0.05 or world_delta_x > 0.05", "true"),
    ("c_gripper", "between", "row_kind = 'anchor' and expected_norm < 0.5", "row_kind = 'anchor'")]).replace("1 as ordinal", "0 as ordinal"), extra=_X)
def between(t: Tables) -> DataFrame:
    """Inclusive bounds, an open side, missing values ignored."""
    a = _run(P.displacement_case(t).rows, [E.between("world_delta_x", -0.05, 0.05)])
    return a.unionByName(_run(P.gripper_case(t).rows, [E.between("expected_norm", 0.5)]))


@query("E5", _V, _sql([("c_chain", "row_count_equal", "", "count(*) = 150"), ("c_chain", "row_count_equal", "", "count(*) = 7")]), extra=_X)
def row_count_equal(t: Tables) -> DataFrame:
    return _run(P.chain_case(t).rows, [E.row_count_equal(150), E.row_count_equal(7)])


@query("E6", _V, """select branch, 0 as ordinal, 'unique' as type, 'EXECUTED' as status, sum(case when n > 1 then n else 0 end) = 0 as success,
cast(sum(case when n > 1 then n else 0 end) as bigint) as unexpected_count, cast(sum(n) as bigint) as element_count from (select branch, dataset_from_index, count(*) as n from c_chain group by all) group by branch""", extra=_X)
def unique(t: Tables) -> DataFrame:
    return _run(P.chain_case(t).rows, [E.unique("dataset_from_index")])


@query("E7", _V, """select branch, 0 as ordinal, 'increasing' as type, 'EXECUTED' as status, count_if(dataset_from_index <= p) = 0 as success,
count_if(dataset_from_index <= p) as unexpected_count, count(*) as element_count
from (select *, lag(dataset_from_index) over (partition by branch order by episode_index) as p from c_chain) group by branch""", extra=_X)
def increasing(t: Tables) -> DataFrame:
    return _run(P.chain_case(t).rows, [E.increasing("dataset_from_index", ["episode_index"])])


@query("E8", _V, _sql([("c_statistics", "pair_greater", "not (q99 > q01)", "true"), ("c_statistics", "pair_greater", "not (q99 >= q01)", "true")]), extra=_X)
def pair_greater(t: Tables) -> DataFrame:
    return _run(P.statistics_case(t).rows, [E.pair_greater("q99", "q01"), E.pair_greater("q99", "q01", or_equal=True)])


@query("E9", _V, _sql([("c_gripper", "distinct_in_set", "row_kind not in ('anchor', 'data')", "true"), ("c_gripper", "distinct_in_set", "side not in ('right_gripper', 'left_gripper')", "true")]), extra=_X)
def distinct_in_set(t: Tables) -> DataFrame:
    return _run(P.gripper_case(t).rows, [
        E.distinct_in_set("row_kind", ["anchor", "data"]), E.distinct_in_set("side", ["right_gripper", "left_gripper"])])


@query("E10", _V, _sql([("c_frame_time", "values_in_set", "returned_channels <> 3", "true"), ("c_frame_time", "values_in_set", """ "group" not in ('g0', 'g2')""", "true")]), extra=_X)
def values_in_set(t: Tables) -> DataFrame:
    return _run(P.frame_time_case(t).rows, [E.values_in_set("returned_channels", [3]), E.values_in_set("group", ["g0", "g2"])])


@query("E11", _V, _sql([("c_frame_time", "length_equal", "length(returned_digest) <> 64", "returned_digest is not null"), ("c_frame_time", "length_equal", """length("group") <> 3""", "true")]), extra=_X)
def length_equal(t: Tables) -> DataFrame:
    return _run(P.frame_time_case(t).rows, [E.length_equal("returned_digest", 64), E.length_equal("group", 3)])


# Unexpected-row conditions of the semantic rules, for the SQL side.
_POSE_BAD = "degrees(2 * acos(least(1.0, abs(s0*qw + s1*qx + s2*qy + s3*qz)))) > 1e-3"
_BAD = {
    "window": ("window_selection", "selected_index <> greatest(episode_start, least(episode_end - 1, absolute_index)) or is_pad <> (absolute_index < episode_start or absolute_index >= episode_end)"),
    "chain": ("interval_chain", "dataset_from_index <> cs - length or dataset_to_index <> cs"),
    "pose": ("quaternion_convention", _POSE_BAD),
    "displacement": ("displacement", "not (sqrt(pow(world_delta_x + 0.05 * action_y, 2) + pow(world_delta_y + 0.05 * action_z, 2) + pow(world_delta_z - 0.05 * action_x, 2)) <= 1e-9)"),
    "gripper": ("anchor", "row_kind = 'anchor' and abs(gripper_norm - expected_norm) > 1e-3"),
    "frame_time": ("frame_correspondence", "not (within_half and digest_ok)"),
    "statistics": ("reference_statistic", "not (abs(mean - reference_mean) <= 1e-5 and abs(std - reference_std) <= 1e-5)"),
}
_FROM = {"chain": "(select *, cast(sum(length) over (partition by branch order by episode_index) as bigint) as cs from c_chain)"}


def _informed_sql(case: str) -> str:
    type_, bad = _BAD[case]
    return _sql([(_FROM.get(case, f"c_{case}"), type_, bad, "true")])


def _informed(case: str):
    return lambda t: _run((c := P.CASES[case](t)).rows, c.informed)


for _case, _id in (("window", "E12"), ("chain", "E13"), ("pose", "E15"), ("displacement", "E16"),
                   ("gripper", "E17"), ("frame_time", "E18"), ("statistics", "E19")):
    query(_id, _V, _informed_sql(_case), extra=_X, name=f"{_BAD[_case][0]}_rule")(_informed(_case))


@query("E14", _V, _sql([("c_chain", "interval_length", "dataset_to_index - dataset_from_index <> length", "true")]), extra=_X)
def interval_length_rule(t: Tables) -> DataFrame:
    return _run(P.chain_case(t).rows, [E.interval_length()])


_CHAIN_ROW = "concat('{\"episode_index\":', episode_index, ',\"length\":', length, ',\"dataset_from_index\":', dataset_from_index, ',\"dataset_to_index\":', dataset_to_index, '}')"


@query("E20", _V, f"""select branch, 0 as ordinal, 'between' as type, 'EXECUTED' as status, count_if(length < 40) = 0 as success, count_if(length < 40) as unexpected_count,
  count(*) as element_count, cast(min(length) filter (where length < 40) as varchar) as observed from base group by branch
union all select branch, 1, 'interval_length', 'EXECUTED', count_if(dataset_to_index - dataset_from_index <> length) = 0, count_if(dataset_to_index - dataset_from_index <> length), count(*), null from base group by branch
union all select branch, 2, 'interval_chain', 'EXECUTED', bool_and(ok), count_if(not ok), count(*), min_by({_CHAIN_ROW}, episode_index) filter (where not ok) from base group by branch
union all select branch, 3, 'unique', 'EXECUTED', count(*) filter (where n > 1) = 0, cast(coalesce(sum(n) filter (where n > 1), 0) as bigint), cast(sum(n) as bigint), cast(min(dataset_from_index) filter (where n > 1) as varchar)
  from (select branch, dataset_from_index, count(*) as n from c_chain group by all) group by branch
union all select branch, 4, 'row_count_equal', 'EXECUTED', count(*) = 7, null, null, cast(count(*) as varchar) from c_chain group by branch
union all select branch, 5, 'of_type', 'EXECUTED', false, null, null, 'bigint' from c_chain group by branch
union all select branch, 6, 'columns_match_set', 'EXECUTED', false, null, null, 'branch,dataset_from_index,dataset_to_index,episode_index,length' from c_chain group by branch
union all select branch, 7, 'not_null', 'NOT_EXECUTED', null, null, null, null from c_chain group by branch""", extra=f"""{_X}, base as (select *, not ({_BAD["chain"][1]}) as ok from {_FROM["chain"]})""")
def run_suite(t: Tables) -> DataFrame:
    """Rules of every form in one pass, one that cannot be evaluated, and what each of them saw."""
    suite = [
        E.between("length", 40), E.interval_length(), E.interval_chain(), E.unique("dataset_from_index"), E.row_count_equal(7),
        E.of_type("length", "double"), E.columns_match_set(["episode_index"]), E.not_null("robot_type"),
    ]
    out = E.run_suite(P.chain_case(t).rows, suite, by=["branch"], observed=True)
    return out.select("branch", "ordinal", "type", "status", "success", "unexpected_count", "element_count", "observed")


_FIT_COLS = ("episode_index", "length", "dataset_from_index", "dataset_to_index")


@query("E21 W17", _V, "select type, col, low, high from ("
    + " union all ".join(
        [f"select 'not_null' as type, '{c}' as col, null::double as low, null::double as high union all select 'of_type', '{c}', null, null "
         f"union all select 'between', '{c}', min({c})::double, max({c})::double from c_chain where branch = 'reference' and episode_index <= (select max(episode_index) // 2 from v_episodes)" for c in _FIT_COLS])
    + ")", extra=_X)
def fit_suite(t: Tables) -> DataFrame:
    """Parameters fitted on the first half of the reference episodes."""
    case = P.chain_case(t)
    rows = [
        (e.type, e.kwargs["column"], e.kwargs.get("min"), e.kwargs.get("max"))
        for e in case.fitted if e.type != "columns_match_set"
    ]
    return t.spark.createDataFrame(rows, "type string, col string, low double, high double")


@query("W17", _V, """select branch, count_if(absolute_index <= (select max(dataset_to_index) // 2 from v_episodes)) as fit_rows,
count_if(absolute_index > (select max(dataset_to_index) // 2 from v_episodes)) as validate_rows from c_window group by branch""", extra=_X)
def disjoint_split(t: Tables) -> DataFrame:
    case = P.window_case(t)
    fit, rest = E.disjoint_split(case.rows, case.fit)
    a = fit.groupBy("branch").agg(F.count(F.lit(1)).alias("fit_rows"))
    b = rest.groupBy("branch").agg(F.count(F.lit(1)).alias("validate_rows"))
    return a.join(b, "branch", "full_outer").fillna(0)


# ---- verdicts ------------------------------------------------------------------------------------

_PUBLIC_NUM = {
    "window": ("absolute_index", "delta_index", "selected_index"), "chain": _FIT_COLS,
    "pose": ("instance_index", "qx", "qy", "qz", "qw", "norm"),
    "displacement": ("demo_number", "step", "action_x", "action_y", "action_z", "world_delta_x", "world_delta_y", "world_delta_z", "world_delta_norm"),
    "gripper": ("source_index", "gripper_raw", "gripper_norm"),
    "frame_time": ("video_index", "query_index", "requested_seconds", "returned_seconds", "returned_channels"),
    "statistics": ("label", "component_index", "mean", "std", "q01", "q99"),
}
_PUBLIC_TEXT = {
    "window": ("is_pad",), "chain": (), "pose": ("field_kind", "field_path"), "displacement": ("demo_id",),
    "gripper": ("row_kind", "side"), "frame_time": ('"group"', "returned_dtype", "returned_digest"), "statistics": ("feature_group",),
}
_FIT_RULE = {
    "window": "absolute_index <= (select max(dataset_to_index) // 2 from v_episodes)",
    "chain": "episode_index <= (select max(episode_index) // 2 from v_episodes)",
    "pose": "instance_index < (select max(vec_id) // 2 from v_poses)",
    "displacement": "demo_number <= (select max(label) // 2 from v_poses)",
    "gripper": "row_kind = 'data' and source_index <= (select max(vec_id) // 2 from v_vec)",
    "frame_time": "video_index <= (select max(video) // 2 from v_requests)",
    "statistics": "false",
}
_DECLARED_BAD = {
    "window": "selected_index < 0 or selected_index > (select max(dataset_to_index) - 1 from v_episodes)",
    "chain": "length < 1 or dataset_from_index < 0 or dataset_to_index <= dataset_from_index or dataset_to_index - dataset_from_index <> length",
    "pose": "abs(norm - 1) > 1e-6 or abs(qx) > 1 or abs(qy) > 1 or abs(qz) > 1 or abs(qw) > 1",
    "displacement": "abs(world_delta_x) > 0.05 or abs(world_delta_y) > 0.05 or abs(world_delta_z) > 0.05",
    "gripper": "gripper_norm < 0 or gripper_norm > 1 or abs(gripper_raw) > 2 * pi()",
    "frame_time": "returned_seconds is null or returned_seconds < 0 or length(returned_digest) <> 64",
    "statistics": "std < 0 or q99 < q01",
}


def _success_sql(case: str) -> str:
    """Success of the three arms per branch, written on the case tables."""
    table = f"c_{case}"
    declared = f"select '{case}' as \"case\", 'declared' as arm, branch, count_if({_DECLARED_BAD[case]}) = 0"
    if case == "statistics":
        declared += " and count(*) = (select count(*) from v_stats)"
    if case == "window":
        declared += " and count(*) = (select count(*) from c_window where branch = 'reference')"
    declared += f" as success from {table} group by branch"
    fixture = f"(select * from {table} where branch = 'reference' and ({_FIT_RULE[case]}))" if case != "statistics" else "v_stats"
    bad = [f"{c} < (select min({c}) from {fixture}) or {c} > (select max({c}) from {fixture})" for c in _PUBLIC_NUM[case]]
    bad += [f"((select count(distinct {c}) from {fixture}) <= 20 and {c} not in (select {c} from {fixture}))" for c in _PUBLIC_TEXT[case]]
    fitted = (f"select '{case}', 'fitted', branch, count_if({' or '.join(bad)}) = 0 from {table} where not coalesce({_FIT_RULE[case]}, false) group by branch")
    informed = f"select '{case}', 'informed', branch, count_if({_BAD[case][1]}) = 0 from {_FROM.get(case, table)} group by branch"
    return " union all ".join((declared, fitted, informed))


_OUTCOMES = _X + ",\noc as (" + " union all ".join(_success_sql(c) for c in P.CASES) + """),
pv as (select "case", arm, case when f is null or r is null then 'NOT_EXECUTED' when not f and r then 'DETECTED' when not f and not r then 'ALWAYS_FAIL'
  when f and r then 'MISSED' else 'REFERENCE_FALSE_POSITIVE_ONLY' end as verdict from (
  select "case", arm, bool_or(success) filter (where branch = 'faulty') as f, bool_or(success) filter (where branch = 'reference') as r from oc group by all))"""


@query("E20 outcome", _V, 'select "case", arm, branch, success from oc', extra=_OUTCOMES)
def suite_outcomes(t: Tables) -> DataFrame:
    return P.all_outcomes(t).select("case", "arm", "branch", "success")


@query("E22", _V, 'select "case", arm, verdict from pv', extra=_OUTCOMES)
def paired_verdict(t: Tables) -> DataFrame:
    return E.paired_verdict(P.all_outcomes(t))


@query("E23", _V, "select arm, " + ", ".join(f"count_if(verdict = '{v}') as {v.lower()}" for v in E.VERDICTS) + " from pv group by arm", extra=_OUTCOMES)
def verdict_tally(t: Tables) -> DataFrame:
    return E.tally(E.paired_verdict(P.all_outcomes(t)))


@query("E23 matrix", _V, 'select "case", ' + ", ".join(f"max(verdict) filter (where arm = '{a}') as {a}" for a in P.ARMS) + ' from pv group by "case"', extra=_OUTCOMES)
def case_matrix(t: Tables) -> DataFrame:
    return E.case_matrix(E.paired_verdict(P.all_outcomes(t)), P.ARMS)


@query("E24", _V, 'select "case", arm, branch, count(*) as runs from oc group by all', extra=_OUTCOMES)
def coverage_matrix(t: Tables) -> DataFrame:
    return E.coverage_matrix(P.all_outcomes(t), list(P.CASES), list(P.ARMS))


# ---- what each kind of evidence says ---------------------------------------------------------------

_CONVERSION_SQL = _X + """,
c_conversion as (select branch, s0, s1, s2, s3, case when branch = 'faulty' and not moved then s0 else s1 end as t0,
  case when branch = 'faulty' and not moved then s1 else s2 end as t1, case when branch = 'faulty' and not moved then s2 else s3 end as t2,
  case when branch = 'faulty' and not moved then s3 else s0 end as t3
  from v_poses, (select unnest([true, false, true, false, true, true, false]) as moved), (select unnest(['faulty', 'reference']) as branch)),
q_conversion as (select *, abs(t0 - s1) <= 1e-7 + 1e-5 * abs(s1) and abs(t1 - s2) <= 1e-7 + 1e-5 * abs(s2)
  and abs(t2 - s3) <= 1e-7 + 1e-5 * abs(s3) and abs(t3 - s0) <= 1e-7 + 1e-5 * abs(s0) as right_order from c_conversion)"""


def _evidence_sql(case: str, structure: str, equal: str = "null", inverse: str = "null", table: str = "", bad: str = "") -> str:
    """``inverse`` is a condition that is null on rows without an inverse."""
    return (
        f"""select '{case}' as "case", branch, count(*) as rows, count_if({bad or _BAD[case][1]}) as reference_violations,
count_if({structure}) as structure_bad, cast({equal} as bigint) as equal_raw, count_if(({inverse}) is not null) as round_trip_rows,
case when count_if(({inverse}) is not null) > 0 then count_if(not ({inverse})) end as round_trip_bad from {table or _FROM.get(case, "c_" + case)} group by branch"""
    )


_EVIDENCE = " union all ".join((
    _evidence_sql("window", "selected_index < episode_start or selected_index >= episode_end", "count_if(selected_index = absolute_index)"),
    _evidence_sql("chain", "length < 0 or dataset_from_index < 0 or dataset_to_index - dataset_from_index <> length"),
    _evidence_sql("pose", "abs(norm - 1) > 1e-6", "count_if(qx = s0 and qy = s1 and qz = s2 and qw = s3)", "qw = s0 and qx = s1 and qy = s2 and qz = s3"),
    _evidence_sql("conversion", "not isfinite(t0 + t1 + t2 + t3)", "count_if(t0 = s0 and t1 = s1 and t2 = s2 and t3 = s3)",
                  "abs(t3 - s0) <= 1e-7 + 1e-5 * abs(s0) and abs(t0 - s1) <= 1e-7 + 1e-5 * abs(s1) and abs(t1 - s2) <= 1e-7 + 1e-5 * abs(s2) and abs(t2 - s3) <= 1e-7 + 1e-5 * abs(s3)",
                  table="q_conversion", bad="not right_order"),
    _evidence_sql("displacement", "abs(action_x) > 1 or abs(action_y) > 1 or abs(action_z) > 1",
                  inverse="abs(world_delta_z - 0.05 * action_x) <= 1e-9 and abs(-world_delta_x - 0.05 * action_y) <= 1e-9 and abs(-world_delta_y - 0.05 * action_z) <= 1e-9"),
    _evidence_sql("gripper", "not isfinite(gripper_norm)",
                  inverse="case when branch = 'faulty' and row_kind = 'anchor' then abs(gripper_norm * 1.1 + 0.4 - gripper_raw) <= 1e-9 end"),
    _evidence_sql("frame_time", "returned_seconds is null or returned_channels <> 3 or length(returned_digest) <> 64"),
    _evidence_sql("statistics", "std < 0 or not isfinite(mean) or not isfinite(std)"),
))


@query("E25", _V, _EVIDENCE, extra=_CONVERSION_SQL)
def information_matrix(t: Tables) -> DataFrame:
    """Eight cases, both branches: structure, raw equality, the inverse operation run on the data, reference rule.

    Inverses: reordering back (pose), inverse migration (conversion), inverse rotation of the base frame
    (displacement), inverse bounds (gripper anchors of the faulty branch; the repaired transforms are
    one-way). Selections, running totals, as-of answers and statistics have none.
    """
    col = F.col
    made = P.made(t)
    back = G.rotate([[F.lit(v) for v in column] for column in zip(*P.BASE_ROTATION, strict=True)], [col(f"world_delta_{n}") for n in "xyz"])
    restored = F.lit(True)
    for got, n in zip(back, "xyz", strict=True):
        restored = restored & (F.abs(got - col(f"delta_{n}")) <= 1e-9)
    anchors = (col("branch") == "faulty") & (col("row_kind") == "anchor")
    undone = F.abs(K.unscale(col("gripper_norm"), K.FAULTY_BOUNDS) - col("gripper_raw")) <= 1e-9
    names = ("qw", "qx", "qy", "qz")
    in_order = (col("qx") == col("source_qw")) & (col("qy") == col("source_qx")) & (col("qz") == col("source_qy")) & (col("qw") == col("source_qz"))
    reordered = F.lit(True)
    for n in names:
        reordered = reordered & (col(n) == col(f"source_{n}"))
    parts = {
        "window": C.Evidence(made["window"].rows, made["window"].informed[0],
                             (col("selected_index") < col("episode_start")) | (col("selected_index") >= col("episode_end")),
                             col("selected_index") == col("absolute_index")),
        "chain": C.Evidence(made["chain"].rows, made["chain"].informed[0],
                            (col("length") < 0) | (col("dataset_from_index") < 0) | (col("dataset_to_index") - col("dataset_from_index") != col("length"))),
        "pose": C.Evidence(made["pose"].rows, made["pose"].informed[0], F.abs(col("norm") - 1) > 1e-6, in_order, reordered),
        "conversion": C.Evidence(P.conversion_rows(t), E.instance_converted(), ~F.forall("target_xyzw", finite) | (F.size("target_xyzw") != 4),
                                 col("target_xyzw") == col("source_wxyz"), V.migration_undone(col("source_wxyz"), col("target_xyzw"))),
        "displacement": C.Evidence(made["displacement"].rows, made["displacement"].informed[0],
                                   F.greatest(*[F.abs(f"action_{n}") for n in "xyz"]) > 1, round_trip=restored),
        "gripper": C.Evidence(made["gripper"].rows, made["gripper"].informed[0], ~finite(col("gripper_norm")), round_trip=F.when(anchors, undone)),
        "frame_time": C.Evidence(made["frame_time"].rows, made["frame_time"].informed[0],
                                 col("returned_seconds").isNull() | (col("returned_channels") != 3) | (F.length("returned_digest") != 64)),
        "statistics": C.Evidence(made["statistics"].rows, made["statistics"].informed[0], (col("std") < 0) | ~finite(col("mean")) | ~finite(col("std"))),
    }
    return C.information_matrix(parts)


_TEXT_OK = "coalesce(abs(got - expected) <= 0.5 * interval and list_contains(wanted, digest), false)"


@query("E18 text", _V, f"""select branch, kind, 0 as ordinal, 'frame_correspondence_text' as type, 'EXECUTED' as status,
bool_and({_TEXT_OK}) as success, count_if(not {_TEXT_OK}) as unexpected_count, count(*) as element_count
from (select branch, kind, a.returned_t as expected, g.interval, case when kind = 'other frame' then sha256(sc.request_id::varchar) else sc.returned_digest end as digest,
  case when kind = 'late' then sc.returned_t + g.interval else sc.returned_t end as got, f.wanted
  from sc join ans a on a.request_id = sc.request_id join gp g on g.video = a.video and g.t = a.returned_t and g.interval is not null
  join (select video, t, list(digest) as wanted from v_media group by video, t) f on f.video = a.video and f.t = a.returned_t,
  (select unnest(['as returned', 'late', 'other frame']) as kind))
group by branch, kind""", extra=_X)
def frame_correspondence_text_rule(t: Tables) -> DataFrame:
    """The rule on ``|``-joined digests: answers as they are, with a late time, and with the digest of no frame."""
    rows = P.frame_text_rows(t)
    out = E.run_suite(rows, [E.frame_correspondence_text()], by=["branch", "kind"])
    return out.select("branch", "kind", "ordinal", "type", "status", "success", "unexpected_count", "element_count")


_SUMS = {
    "window": "cast(sum(selected_index) as double)", "chain": "cast(sum(dataset_from_index) as double)", "pose": "sum(qx)",
    "displacement": "sum(world_delta_z)", "gripper": "sum(gripper_norm)", "frame_time": "sum(returned_seconds)", "statistics": "sum(std)",
}


@query("E26", _V, " union all ".join(
    f"""select '{c}' as "case", branch, count(*) as rows, round({s}, {1 if c == 'frame_time' else 4}) + 0.0 as checksum from c_{c} group by branch""" for c, s in _SUMS.items()), extra=_X)
def build_pairs(t: Tables) -> DataFrame:
    """Row counts and a checksum of every case table and branch."""
    columns = {
        "window": "selected_index", "chain": "dataset_from_index", "pose": "qx", "displacement": "world_delta_z",
        "gripper": "gripper_norm", "frame_time": "returned_seconds", "statistics": "std",
    }
    out = None
    for name, case in P.made(t).items():
        digits = 1 if name == "frame_time" else 4
        part = case.rows.groupBy("branch").agg(
            F.count(F.lit(1)).alias("rows"), rounded(F.sum(columns[name]), digits).alias("checksum")
        ).select(F.lit(name).alias("case"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ---- comparisons ---------------------------------------------------------------------------------


@query("C7", _V, """select episode_index, f.dataset_from_index = r.dataset_from_index as same_dataset_from_index, f.length = r.length as same_length, 'both' as presence
from (select * from c_chain where branch = 'faulty') f join (select * from c_chain where branch = 'reference') r using (episode_index)""", extra=_X)
def paired_compare(t: Tables) -> DataFrame:
    rows = P.chain_case(t).rows
    return C.paired_compare(rows.where("branch = 'faulty'"), rows.where("branch = 'reference'"), ["episode_index"], ["dataset_from_index", "length"])


@query("C8", _V, """select episode_index, 'dataset_from_index' as field, cast(f.dataset_from_index as varchar) as fresh, cast(r.dataset_from_index as varchar) as golden
from (select * from c_chain where branch = 'faulty') f join (select * from c_chain where branch = 'reference') r using (episode_index) where f.dataset_from_index <> r.dataset_from_index
union all select episode_index, 'dataset_to_index', cast(f.dataset_to_index as varchar), cast(r.dataset_to_index as varchar)
from (select * from c_chain where branch = 'faulty') f join (select * from c_chain where branch = 'reference') r using (episode_index) where f.dataset_to_index <> r.dataset_to_index""", extra=_X)
def compare_to_golden(t: Tables) -> DataFrame:
    rows = P.chain_case(t).rows
    return C.compare_to_golden(
        rows.where("branch = 'faulty'"), rows.where("branch = 'reference'"), ["episode_index"],
        ["length", "dataset_from_index", "dataset_to_index"])


