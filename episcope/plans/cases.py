"""Paired case tables: a faulty and a reference branch of the same artifact, in one DataFrame.

Each case has public columns, which every consumer sees, and enriched columns with reference
information. The SQL twins are written separately at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions import calibration as K
from episcope.functions import geometry as G
from episcope.operators import conversion as V
from episcope.operators import expectations as E
from episcope.operators import frames as R
from episcope.plans.temporal_queries import _SCORED, scored
from episcope.plans.views import Tables
from episcope.session import written

BRANCHES = ("faulty", "reference")
ARMS = ("declared", "fitted", "informed")
# Rotation (row by row) and origin of the base used by the displacement case.
BASE_ROTATION = ((0.0, -1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0))
BASE_ORIGIN = (0.25, -0.5, 0.75)
OUTPUT_RANGE = (-0.05, 0.05)
EPISODES_PER_FILE = 10


def both_branches(df: DataFrame, columns: dict[str, tuple[Column, Column]], shared: list) -> DataFrame:
    """One pass over ``df``: each row gives a faulty and a reference row."""
    pair = F.array(
        *[
            F.struct(F.lit(b).alias("branch"), *[c[i].alias(n) for n, c in columns.items()])
            for i, b in enumerate(BRANCHES)
        ]
    )
    return df.withColumn("_pair", F.explode(pair)).select("_pair.*", *shared)


@dataclass
class Case:
    """Builders and suites of one case; ``public`` maps public columns to their types."""

    name: str
    public: dict[str, str]
    rows: DataFrame
    declared: list[E.Expectation]
    informed: list[E.Expectation]
    fit: Column | None = None
    fixture: DataFrame | None = None
    #: One row of limits that declared rules refer to as columns.
    limits: DataFrame | None = None

    @property
    def public_rows(self) -> DataFrame:
        return self.rows.select("branch", *self.public)

    @property
    def enriched(self) -> list[str]:
        """What the table holds besides the public columns."""
        return [c for c in self.rows.columns if c not in self.public]

    def scaffold(self, added: list[str]) -> list[E.Expectation]:
        out = [E.columns_match_set(list(self.public), ignore=[*self.enriched, *added])]
        for name, type_ in self.public.items():
            out += [E.not_null(name), E.of_type(name, type_)]
        return out

    @property
    def fit_source(self) -> DataFrame:
        """The rows that parameters are fitted on."""
        if self.fixture is not None:
            return self.fixture.select(*self.public)
        source, _ = E.disjoint_split(self.rows.where(F.col("branch") == "reference"), self.fit)
        return source.select(*self.public)

    @cached_property
    def fitted(self) -> list[E.Expectation]:
        """The fitted suite with its numbers, which reads the fixture."""
        suite = E.fit_suite(self.fit_source)
        return [E.columns_match_set(list(self.public), ignore=self.enriched), *suite[1:]]

    def results(self) -> DataFrame:
        """All arms and both branches in one pass over the case table; nothing runs before the result.

        The fitted arm takes its parameters from a one-row table, and looks only at rows that were not used
        for fitting.
        """
        row, fitted = E.fit_parameters(self.fit_source)
        row = row.crossJoin(F.broadcast(self.limits)) if self.limits is not None else row  # one row each
        names = E.columns_match_set(list(self.public), ignore=[*self.enriched, *row.columns])
        rest = F.lit(True) if self.fit is None else ~F.coalesce(self.fit, F.lit(False))
        suite = [replace(e, tag="declared") for e in self.scaffold(row.columns) + self.declared]
        suite += [replace(e, tag="fitted", scope=rest if e.scope is None else rest & e.scope) for e in [names, *fitted[1:]]]
        suite += [replace(e, tag="informed") for e in self.informed]
        out = E.run_suite(self.rows.crossJoin(F.broadcast(row)), suite, by=["branch"])
        return out.withColumnRenamed("tag", "arm").select(F.lit(self.name).alias("case"), "*")


def _half(df: DataFrame, key: str) -> Column:
    """Half of the largest key: the split threshold, a scalar subquery."""
    return F.floor(df.agg(F.max(key)).scalar() / 2)


def window_case(t: Tables) -> Case:
    kept = R.select_episodes(t.frames, t.episodes.where("split = 'failure'"))
    rows = R.frames_with_bounds(kept, t.episodes)
    start, stop = F.col("dataset_from_index"), F.col("dataset_to_index")
    wrong, right = F.col("relative_index"), F.col("index")
    table = t._once(
        "case_window",
        lambda: both_branches(
            rows,
            {
                "selected_index": (R.clamp(wrong, start, stop), R.clamp(right, start, stop)),
                "is_pad": (R.outside(wrong, start, stop), R.outside(right, start, stop)),
            },
            [
                F.col("index").alias("absolute_index"), F.lit(0).cast("long").alias("delta_index"),
                start.alias("episode_start"), stop.alias("episode_end"),
            ],
        ),
    )
    # The limits of the declared rules: the last row, and how many rows a branch has.
    limits = t.episodes.agg((F.max("dataset_to_index") - 1).alias("_last")).crossJoin(
        F.broadcast(table.where("branch = 'reference'").agg(F.count(F.lit(1)).alias("_count")))
    )
    last = F.col("_last")
    public = {"absolute_index": "bigint", "delta_index": "bigint", "selected_index": "bigint", "is_pad": "boolean"}
    return Case(
        "window", public, table,
        [E.between("absolute_index", 0, last), E.between("selected_index", 0, last), E.row_count_equal(F.max("_count"))],
        [E.window_selection()], fit=F.col("absolute_index") <= _half(t.episodes, "dataset_to_index"), limits=limits,
    )


def chain_case(t: Tables) -> Case:
    file = F.floor(F.col("episode_index") / EPISODES_PER_FILE)
    starts = t.episodes.groupBy(file.alias("file")).agg(F.min("dataset_from_index").alias("file_start"))
    rows = t.episodes.withColumn("file", file).join(starts, "file")
    a, b, s = F.col("dataset_from_index"), F.col("dataset_to_index"), F.col("file_start")
    table = t._once(
        "case_chain",
        lambda: both_branches(
            rows, {"dataset_from_index": (a - s, a), "dataset_to_index": (b - s, b)}, ["episode_index", "length"]
        ),
    )
    public = {c: "bigint" for c in ("episode_index", "length", "dataset_from_index", "dataset_to_index")}
    return Case(
        "chain", public, table,
        [
            E.unique("episode_index"), E.increasing("episode_index", ["episode_index"]), E.between("length", 1),
            E.between("dataset_from_index", 0), E.between("dataset_to_index", 0),
            E.pair_greater("dataset_to_index", "dataset_from_index"), E.interval_length(),
        ],
        [E.interval_chain()], fit=F.col("episode_index") <= _half(t.episodes, "episode_index"),
    )


def pose_case(t: Tables) -> Case:
    s, g = [F.col(f"s{i}") for i in range(4)], [F.col(f"t{i}") for i in range(4)]
    names = ("qx", "qy", "qz", "qw")
    columns = {n: (g[i], s[(i + 1) % 4]) for i, n in enumerate(names)}
    rows = both_branches(
        t.poses, columns,
        [
            F.lit("root_pose").alias("field_kind"), F.concat(F.lit("demo_"), F.col("label").cast("string")).alias("field_path"),
            F.col("vec_id").alias("instance_index"), *[c.alias(f"source_{n}") for c, n in zip(s, ("qw", "qx", "qy", "qz"))],
        ],
    )
    table = t._once("case_pose", lambda: rows.withColumn("norm", G.norm([F.col(n) for n in names])))
    public = {"field_kind": "string", "field_path": "string", "instance_index": "bigint", **{n: "double" for n in (*names, "norm")}}
    return Case(
        "pose", public, table,
        [*[E.between(n, -1.0, 1.0) for n in names], E.between("norm", 1 - 1e-6, 1 + 1e-6)],
        [E.quaternion_convention()], fit=F.col("instance_index") < _half(t.poses, "vec_id"),
    )


def displacement_case(t: Tables) -> Case:
    moved = t.poses.withColumns({f"delta_{n}": K.decode_action(F.col(f"d{n}"), (-1.0, 1.0), OUTPUT_RANGE) for n in "xyz"})
    d = [F.col(f"delta_{n}") for n in "xyz"]
    matrix = [[F.lit(v) for v in row] for row in BASE_ROTATION]
    good = G.rotate_displacement(matrix, d)
    bad = G.rotate_displacement_as_point(matrix, [F.lit(v) for v in BASE_ORIGIN], d)
    rows = both_branches(
        moved, {f"world_delta_{n}": (bad[i], good[i]) for i, n in enumerate("xyz")},
        [
            F.concat(F.lit("demo_"), F.col("label").cast("string")).alias("demo_id"), F.col("label").alias("demo_number"),
            F.col("vec_id").alias("step"), *[F.col(f"d{n}").alias(f"action_{n}") for n in "xyz"], *[f"delta_{n}" for n in "xyz"],
        ],
    )
    table = t._once(
        "case_displacement",
        lambda: rows.withColumn("world_delta_norm", G.norm([F.col(f"world_delta_{n}") for n in "xyz"])),
    )
    public = {
        "demo_id": "string", "demo_number": "bigint", "step": "bigint", **{f"action_{n}": "double" for n in "xyz"},
        **{f"world_delta_{n}": "double" for n in "xyz"}, "world_delta_norm": "double",
    }
    return Case(
        "displacement", public, table,
        [
            *[E.between(f"action_{n}", -1.0, 1.0) for n in "xyz"],
            *[E.between(f"world_delta_{n}", *OUTPUT_RANGE) for n in "xyz"],
            E.between("world_delta_norm", 0.0, OUTPUT_RANGE[1] * 3**0.5), E.between("step", 0),
        ],
        [E.displacement(BASE_ROTATION)], fit=F.col("demo_number") <= _half(t.poses, "label"),
    )


def gripper_case(t: Tables) -> Case:
    sides = F.array(*[
        F.struct(F.lit(n).alias("side"), F.abs(F.get("state", F.lit(i)).cast("double")).alias("gripper_raw"))
        for n, i in (("right_gripper", 6), ("left_gripper", 13))
    ])
    nan = F.lit(float("nan"))
    data = t.vectors.select(F.col("vec_id").alias("source_index"), F.explode(sides).alias("s")).select(
        F.lit("data").alias("row_kind"), "s.side", "source_index", "s.gripper_raw", nan.alias("expected_norm"),
        nan.alias("anchor_counts"),
    )
    data = both_branches(
        data,
        {"gripper_norm": tuple(K.gripper_to_angular(F.col("gripper_raw"), b) for b in (K.FAULTY_BOUNDS, K.REPAIRED_BOUNDS))},
        data.columns,
    )
    spec = [(-1 - i, float(c), e) for i, (c, e) in enumerate(zip(K.ENCODER_COUNTS, K.ANCHOR_OUTPUTS))]
    anchors = t.spark.createDataFrame(spec, "source_index bigint, anchor_counts double, expected_norm double").select(
        F.lit("anchor").alias("row_kind"), F.lit("calibration").alias("side"), "source_index",
        K.encoder_to_radian(F.col("anchor_counts")).alias("gripper_raw"), "expected_norm", "anchor_counts",
    )
    anchors = both_branches(
        anchors,
        {"gripper_norm": tuple(K.rescale(F.col("gripper_raw"), b) for b in (K.FAULTY_BOUNDS, K.REPAIRED_BOUNDS))},
        anchors.columns,
    )
    table = t._once("case_gripper", lambda: data.unionByName(anchors))
    public = {"row_kind": "string", "side": "string", "source_index": "bigint", "gripper_raw": "double", "gripper_norm": "double"}
    half = _half(t.vectors, "vec_id")
    two_pi = 6.283185307179586
    return Case(
        "gripper", public, table,
        [
            E.distinct_in_set("row_kind", ["anchor", "data"]), E.between("gripper_norm", 0.0, 1.0),
            E.between("gripper_raw", -two_pi, two_pi),
        ],
        [E.anchor()], fit=(F.col("row_kind") == "data") & (F.col("source_index") <= half),
    )


def frame_time_case(t: Tables) -> Case:
    rows = scored(t)
    branch = F.when(F.col("branch") == "repaired", "reference").otherwise("faulty")
    # The scored requests are a written table; the case only renames them.
    table = rows.select(
        branch.alias("branch"), F.col("video").alias("video_index"), "group", F.col("request_id").alias("query_index"),
        (F.col("t") / 1e6).alias("requested_seconds"), (F.col("returned_t") / 1e6).alias("returned_seconds"),
        F.lit(3).cast("long").alias("returned_channels"), F.lit("uint8").alias("returned_dtype"), "returned_digest",
        (F.col("expected_t") / 1e6).alias("expected_seconds"), (F.col("interval") / 1e6).alias("local_interval_seconds"), "digest_ok",
    )
    public = {
        "video_index": "bigint", "group": "string", "query_index": "bigint", "requested_seconds": "double",
        "returned_seconds": "double", "returned_channels": "bigint", "returned_dtype": "string", "returned_digest": "string",
    }
    return Case(
        "frame_time", public, table,
        [
            E.values_in_set("returned_channels", [3]), E.distinct_in_set("returned_dtype", ["uint8"]),
            E.between("requested_seconds", 0.0), E.between("returned_seconds", 0.0), E.length_equal("returned_digest", 64),
        ],
        [E.frame_correspondence()], fit=F.col("video_index") <= _half(t.requests, "video"),
    )


def statistics_case(t: Tables) -> Case:
    keys = ["label", "feature_group", "component_index"]
    truth = t.stats.select(*keys, F.col("mean").alias("reference_mean"), F.col("std").alias("reference_std"))
    parts = [
        df.select(*keys, "mean", "std", "q01", "q99").withColumn("branch", F.lit(b))
        for df, b in ((t.stats_first_rows, "faulty"), (t.stats, "reference"))
    ]
    table = t._once(
        "case_statistics",
        lambda: parts[0].unionByName(parts[1]).join(truth, keys).withColumn("absolute_tolerance", F.lit(1e-5)),
    )
    public = {
        "label": "bigint", "feature_group": "string", "component_index": "bigint",
        **{n: "double" for n in ("mean", "std", "q01", "q99")},
    }
    return Case(
        "statistics", public, table,
        [
            E.between("std", 0.0), E.pair_greater("q99", "q01", or_equal=True), E.row_count_equal(F.max("_count")),
            E.distinct_in_set("feature_group", ["actions", "state"]),
        ],
        [E.reference_statistic()], fixture=t.stats, limits=t.stats.agg(F.count(F.lit(1)).alias("_count")),
    )


def conversion_rows(t: Tables) -> DataFrame:
    """Every stored quaternion, as migrated by the faulty and by the whole conversion."""
    from episcope.plans.pose_queries import stored_fields

    instances = V.conversion_inventory(stored_fields(t))
    moved = F.concat(F.slice("source_wxyz", 2, 3), F.slice("source_wxyz", 1, 1))
    return both_branches(instances, {"target_xyzw": (F.col("target_xyzw"), moved)}, ["family", "path", "row", "start", "source_wxyz"])


def frame_text_rows(t: Tables) -> DataFrame:
    """Answers with the digests that their expected time allows as one text, in three versions.

    The versions part the two halves of the rule: a late time with the right digest, and the digest of a
    request, which no frame has, at the right time.
    """
    s = scored(t)
    # A right answer has the digest of a frame at its time; where other frames share the time, theirs are looked
    # up. They are few; the stored form of the rule joins their digests in one text.
    right = s.where("branch = 'repaired' and interval is not null")
    at = ["video", F.col("expected_t").alias("t")]
    shared = written(right.where("equivalents > 1").select(*at).distinct(), f"shared-times-{uuid.uuid4().hex}")
    alone = right.where("equivalents = 1").select(*at, F.col("returned_digest").alias("digest"))
    several = t.media_frames.join(shared, ["video", "t"], "left_semi").select("video", "t", "digest")
    allowed = alone.unionByName(several).groupBy("video", F.col("t").alias("expected_t")).agg(
        F.array_join(F.array_sort(F.collect_set("digest")), "|").alias("expected_digests")
    )
    second, late = F.col("returned_t") / 1e6, (F.col("returned_t") + F.col("interval")) / 1e6
    absent = F.sha2(F.col("request_id").cast("string"), 256)
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), at.alias("returned_seconds"), digest.alias("returned_digest"))
        for k, at, digest in (("as returned", second, F.col("returned_digest")), ("late", late, F.col("returned_digest")), ("other frame", second, absent))
    ])
    rows = s.where("interval is not null").join(allowed, ["video", "expected_t"]).withColumn("k", F.explode(kinds))
    return rows.select(
        F.when(F.col("branch") == "repaired", "repaired").otherwise("faulty").alias("branch"), "request_id", "k.*", "expected_digests",
        (F.col("expected_t") / 1e6).alias("expected_seconds"), (F.col("interval") / 1e6).alias("local_interval_seconds"),
    )


CASES: dict[str, Callable[[Tables], Case]] = {
    "window": window_case,
    "chain": chain_case,
    "pose": pose_case,
    "displacement": displacement_case,
    "gripper": gripper_case,
    "frame_time": frame_time_case,
    "statistics": statistics_case,
}


def made(t: Tables) -> dict[str, Case]:
    """Every case by name. Their tables are independent jobs, so they are handed to Spark side by side."""
    with ThreadPoolExecutor(len(CASES)) as pool:
        return dict(zip(CASES, pool.map(lambda make: make(t), CASES.values()), strict=True))


def all_results(t: Tables) -> DataFrame:
    """Every case, arm and branch: one row per expectation.

    Cases are independent jobs, so they are handed to Spark side by side; each writes its few result rows.
    """
    def one(name: str) -> DataFrame:
        return t._once(f"suite_results_{name}", lambda: CASES[name](t).results())

    with ThreadPoolExecutor(len(CASES)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, CASES))


def all_outcomes(t: Tables) -> DataFrame:
    return E.suite_outcome(all_results(t), ["case", "arm", "branch"])


# ---- SQL twins -----------------------------------------------------------------------------------

_BR = "(select unnest(['faulty', 'reference']) as branch)"

CASE_VIEWS = "v_frames v_poses v_vec v_media v_requests v_stats v_stats_first"
CASE_SQL = _SCORED + f""",
c_window as (select branch, f.index as absolute_index, 0::bigint as delta_index, dataset_from_index as episode_start, dataset_to_index as episode_end,
  greatest(dataset_from_index, least(dataset_to_index - 1, case when branch = 'faulty' then rel else f.index end)) as selected_index,
  case when branch = 'faulty' then rel < dataset_from_index or rel >= dataset_to_index else false end as is_pad
  from (select *, row_number() over (order by index) - 1 as rel from v_frames where split = 'failure') f
  join v_episodes e on e.episode_index = f.episode_index, {_BR}),
c_chain as (select branch, episode_index, length, dataset_from_index - case when branch = 'faulty' then fs else 0 end as dataset_from_index,
  dataset_to_index - case when branch = 'faulty' then fs else 0 end as dataset_to_index
  from (select *, min(dataset_from_index) over (partition by episode_index // 10) as fs from v_episodes), {_BR}),
c_pose as (select branch, 'root_pose' as field_kind, concat('demo_', label) as field_path, vec_id as instance_index,
  case when branch = 'faulty' then t0 else s1 end as qx, case when branch = 'faulty' then t1 else s2 end as qy,
  case when branch = 'faulty' then t2 else s3 end as qz, case when branch = 'faulty' then t3 else s0 end as qw,
  sqrt(s0*s0 + s1*s1 + s2*s2 + s3*s3) as norm, s0, s1, s2, s3, t0, t1, t2, t3 from v_poses, {_BR}),
c_displacement as (select *, sqrt(world_delta_x*world_delta_x + world_delta_y*world_delta_y + world_delta_z*world_delta_z) as world_delta_norm from (
  select branch, concat('demo_', label) as demo_id, label as demo_number, vec_id as step, dx as action_x, dy as action_y, dz as action_z,
  -0.05 * dy + case when branch = 'faulty' then 0.25 else 0 end as world_delta_x, -0.05 * dz - case when branch = 'faulty' then 0.5 else 0 end as world_delta_y,
  0.05 * dx + case when branch = 'faulty' then 0.75 else 0 end as world_delta_z from v_poses, {_BR})),
g0 as (select branch, 'data' as row_kind, side, vec_id as source_index, abs(state[i]::double) as gripper_raw, 0.0::double as expected_norm,
  abs(state[i]::double) * (0.058 - 0.01844) + 0.01844 as lin
  from v_vec, (select 'right_gripper' as side, 7 as i union all select 'left_gripper', 14), {_BR}),
c_gripper as (select branch, row_kind, side, source_index, gripper_raw, (asin(greatest(-1.0, least(1.0, (0.022*0.022 + lin*lin - 0.036*0.036) / (2*0.022*lin))))
   - case when branch = 'faulty' then 0.4 else 0.5476 end) / case when branch = 'faulty' then 1.1 else 1.6296 - 0.5476 end as gripper_norm, expected_norm from g0
  union all select branch, 'anchor', 'calibration', -1 - k, (2405 + 705 * k - 2048) * 2 * pi() / 4096,
   ((2405 + 705 * k - 2048) * 2 * pi() / 4096 - case when branch = 'faulty' then 0.4 else 0.5476 end) / case when branch = 'faulty' then 1.1 else 1.6296 - 0.5476 end, k::double
  from (select unnest([0, 1]) as k), {_BR}),
c_frame_time as (select case when branch = 'repaired' then 'reference' else 'faulty' end as branch, video as video_index, "group", sc.request_id as query_index,
  q.t / 1e6 as requested_seconds, returned_t / 1e6 as returned_seconds, 3::bigint as returned_channels, 'uint8' as returned_dtype, returned_digest, correct, within_half,
  coalesce(exists (select 1 from v_media m join ans a on a.request_id = sc.request_id and m.video = a.video and m.t = a.returned_t where m.digest = sc.returned_digest), false) as digest_ok
  from sc join (select request_id, t from v_requests) q on q.request_id = sc.request_id),
c_statistics as (select b.*, r.mean as reference_mean, r.std as reference_std from (
  select 'faulty' as branch, label, feature_group, component_index, mean, std, q01, q99 from v_stats_first
  union all select 'reference', label, feature_group, component_index, mean, std, q01, q99 from v_stats) b
  join v_stats r on r.label = b.label and r.feature_group = b.feature_group and r.component_index = b.component_index)"""
