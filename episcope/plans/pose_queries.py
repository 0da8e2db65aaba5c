"""Queries on orientations, displacements, calibration and vector transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions import calibration as K
from episcope.functions import geometry as G
from episcope.functions.columns import rounded
from episcope.operators import conversion as V
from episcope.operators import transforms as X
from episcope.plans.registry import query
from episcope.plans.views import Tables

# A fixed base pose. Its rotation sends (x, y, z) to (-y, -z, x), which the SQL side uses directly.
BASE_Q = (0.5, 0.5, -0.5, 0.5)
BASE_P = (0.25, -0.5, 0.75)


def S() -> list[Column]:
    return [F.col(f"s{i}") for i in range(4)]


def T() -> list[Column]:
    return [F.col(f"t{i}") for i in range(4)]


def D() -> list[Column]:
    return [F.col(c) for c in ("dx", "dy", "dz")]


def base_q() -> list[Column]:
    return [F.lit(v) for v in BASE_Q]


def base_p() -> list[Column]:
    return [F.lit(v) for v in BASE_P]


def _r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


def _vector(c: Column) -> Column:
    """A whole vector as text with four decimals."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.4f", F.round(x.cast("double"), 4) + F.lit(0.0))), ",")


def _sql_vector(rule, n: int = 64) -> str:
    """The same text; ``rule`` gives the SQL of the element at place ``i``, from 1."""
    return f"array_to_string(list_transform(range(1, {n} + 1), lambda i: printf('%.4f', round(({rule})::double, 4) + 0.0)), ',')"


# Angle between source (wxyz) and target (xyzw): the dot product in one order.
_DOT = "(s0 * t3 + s1 * t0 + s2 * t1 + s3 * t2)"
_ANGLE = f"degrees(2 * acos(least(1.0, abs({_DOT}))))"


def _mat(w: str, x: str, y: str, z: str) -> list[list[str]]:
    return [
        [f"(1-2*({y}*{y}+{z}*{z}))", f"(2*({x}*{y}-{z}*{w}))", f"(2*({x}*{z}+{y}*{w}))"],
        [f"(2*({x}*{y}+{z}*{w}))", f"(1-2*({x}*{x}+{z}*{z}))", f"(2*({y}*{z}-{x}*{w}))"],
        [f"(2*({x}*{z}-{y}*{w}))", f"(2*({y}*{z}+{x}*{w}))", f"(1-2*({x}*{x}+{y}*{y}))"],
    ]


_MS = _mat("s0", "s1", "s2", "s3")
_MT = _mat("t3", "t0", "t1", "t2")
_ROT = ["(-dy)", "(-dz)", "dx"]


@query("G1", "v_poses", f"select vec_id, {_r('s1')} as x, {_r('s2')} as y, {_r('s3')} as z, {_r('s0')} as w from v_poses")
def reorder_quaternion(t: Tables) -> DataFrame:
    x, y, z, w = G.reorder(S(), "wxyz", "xyzw")
    return t.poses.select("vec_id", *[rounded(c).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"), (w, "w"))])


@query("G2", "v_poses0", """select vec_id, abs(sqrt(a0*a0+a1*a1+a2*a2+a3*a3) * f - 1) <= 1e-6 and vec_id % 10 < 8 as valid
from (select *, case when vec_id % 10 < 5 then 1 / sqrt(a0*a0+a1*a1+a2*a2+a3*a3) else 1 end as f from v_poses0)""")
def quaternion_valid(t: Tables) -> DataFrame:
    k = F.col("vec_id") % 10
    raw = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    q = F.when(k < 5, F.transform(raw, lambda x: x / size)).when(k < 8, raw).when(
        k == 8, F.slice(raw, 1, 3)).otherwise(F.transform(raw, lambda x: x * F.lit(float("nan"))))
    return t.table("embeddings").select("vec_id", G.quaternion_valid(q).alias("valid"))


@query("G3", "v_poses", f"select vec_id, {_r(_ANGLE, 4)} as angle_deg from v_poses")
def geodesic_acos(t: Tables) -> DataFrame:
    angle = G.geodesic_acos(G.reorder(S(), "wxyz", "xyzw"), G.reorder(T(), "xyzw", "xyzw"))
    return t.poses.select("vec_id", rounded(F.degrees(angle), 4).alias("angle_deg"))


@query("G4", "v_poses", f"select vec_id, {_r(_ANGLE, 4)} as angle_deg, {_r(_ANGLE, 4)} as angle_of_negated from v_poses")
def geodesic_atan2(t: Tables) -> DataFrame:
    """Also with the target negated: the angle must not change."""
    angle = G.geodesic_atan2(S(), "wxyz", T(), "xyzw")
    flipped = G.geodesic_atan2(S(), "wxyz", [-c for c in T()], "xyzw")
    return t.poses.select(
        "vec_id", rounded(F.degrees(angle), 4).alias("angle_deg"), rounded(F.degrees(flipped), 4).alias("angle_of_negated")
    )


@query("G5", "v_poses", f"select vec_id, {_r(_ANGLE, 4)} as angle_deg from v_poses")
def geodesic_trace(t: Tables) -> DataFrame:
    return t.poses.select("vec_id", rounded(F.degrees(G.geodesic_trace(S(), "wxyz", T(), "xyzw")), 4).alias("angle_deg"))


@query("G6", "v_poses", "select vec_id, " + ", ".join(f"{_r(_MS[i][j])} as r{i}{j}" for i in range(3) for j in range(3))
       + "".join(f", {_r(_MT[i][j])} as target_r{i}{j}" for i in range(3) for j in range(3)) + " from v_poses")
def rotation_matrix(t: Tables) -> DataFrame:
    m, n = G.rotation_matrix(S(), "wxyz"), G.rotation_matrix(T(), "xyzw")
    cells = [rounded(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    target = [rounded(n[i][j]).alias(f"target_r{i}{j}") for i in range(3) for j in range(3)]
    return t.poses.select("vec_id", *cells, *target)


_COLS = [" + ".join(f"({_MS[r][c]}-{_MT[r][c]})*({_MS[r][c]}-{_MT[r][c]})" for r in range(3)) for c in range(3)]


@query("G7", "v_poses", f"select vec_id, {_r('sqrt(greatest(' + ', '.join(_COLS) + '))', 5)} as displacement from v_poses")
def max_basis_displacement(t: Tables) -> DataFrame:
    return t.poses.select("vec_id", rounded(G.max_basis_displacement(S(), "wxyz", T(), "xyzw"), 5).alias("displacement"))


@query("G8", "v_poses", f"""select vec_id, concat_ws('; ', case when vec_id % 4 = 1 then 'order change is not declared' end,
case when {_ANGLE} > 1e-4 then 'orientations differ' end) as issues, vec_id % 4 <> 1 and {_ANGLE} <= 1e-4 as accepted from v_poses""")
def orientation_transfer(t: Tables) -> DataFrame:
    issues = G.orientation_issues(S(), "wxyz", T(), "xyzw", F.col("vec_id") % 4 != 1)
    return t.poses.select("vec_id", F.array_join(issues, "; ").alias("issues"), (F.size(issues) == 0).alias("accepted"))


@query("G9", "v_poses", f"""select vec_id, {_r('0.5*s0-0.5*s1+0.5*s2-0.5*s3')} as w, {_r('0.5*s1+0.5*s0-0.5*s3-0.5*s2')} as x,
{_r('0.5*s2-0.5*s0+0.5*s1-0.5*s3')} as y, {_r('0.5*s3+0.5*s0+0.5*s2+0.5*s1')} as z, {_r('cos(dx/2)')} as turn_w,
{", ".join(_r(f'sin(dx/2)*d{c}/sqrt(dx*dx+dy*dy+dz*dz)') + f" as turn_{c}" for c in "xyz")} from v_poses""")
def quaternion_product(t: Tables) -> DataFrame:
    p = G.quaternion_product(base_q(), S())
    turn = G.axis_angle(D(), F.col("dx"))
    names = ("w", "x", "y", "z")
    return t.poses.select(
        "vec_id", *[rounded(c).alias(n) for c, n in zip(p, names)],
        *[rounded(c).alias(f"turn_{n}") for c, n in zip(turn, names)],
    )


@query("G10", "v_poses", f"select vec_id, {_r(_ROT[0])} as x, {_r(_ROT[1])} as y, {_r(_ROT[2])} as z, {_r('0.25 + ' + _ROT[0])} as bad_x, {_r('-0.5 + ' + _ROT[1])} as bad_y, {_r('0.75 + ' + _ROT[2])} as bad_z from v_poses")
def rotate_displacement(t: Tables) -> DataFrame:
    m = G.rotation_matrix(base_q(), "wxyz")
    good, bad = G.rotate_displacement(m, D()), G.rotate_displacement_as_point(m, base_p(), D())
    names = ("x", "y", "z")
    return t.poses.select(
        "vec_id", *[rounded(c).alias(n) for c, n in zip(good, names)], *[rounded(c).alias(f"bad_{n}") for c, n in zip(bad, names)]
    )


@query("G11", "v_poses", f"""select vec_id, concat_ws('; ', case when sqrt(ex*ex + ey*ey + ez*ez) > 1e-6 then 'translation leak' end,
case when abs(ex - 0.25) <= 1e-6 + 0.25e-5 and abs(ey + 0.5) <= 1e-6 + 0.5e-5 and abs(ez - 0.75) <= 1e-6 + 0.75e-5 then 'error equals the origin' end) as issues
from (select vec_id, {", ".join(f"case vec_id % 3 when 0 then {o} + {r} when 1 then {r} + 0.001 else {r} end - {r} as e{c}"
for c, r, o in zip("xyz", _ROT, ("0.25", "-0.5", "0.75")))} from v_poses)""")
def displacement_check(t: Tables) -> DataFrame:
    m = G.rotation_matrix(base_q(), "wxyz")
    k = F.col("vec_id") % 3
    good, bad = G.rotate_displacement(m, D()), G.rotate_displacement_as_point(m, base_p(), D())
    seen = [F.when(k == 0, b).when(k == 1, g + 0.001).otherwise(g) for g, b in zip(good, bad)]
    issues = G.displacement_issues(m, base_p(), D(), seen)
    return t.poses.select("vec_id", F.array_join(issues, "; ").alias("issues"))


@query("G12", "v_poses", f"""select vec_id, {_r('0.25 + ' + _ROT[0])} as wx, {_r('-0.5 + ' + _ROT[1])} as wy, {_r('0.75 + ' + _ROT[2])} as wz,
{_r('0.5*s0-0.5*s1+0.5*s2-0.5*s3')} as wq0, {_r('0.5*s1+0.5*s0-0.5*s3-0.5*s2')} as wq1, {_r('0.5*s2-0.5*s0+0.5*s1-0.5*s3')} as wq2,
{_r('0.5*s3+0.5*s0+0.5*s2+0.5*s1')} as wq3, {_r('dx')} as back_x, {_r('dy')} as back_y, {_r('dz')} as back_z,
{_r('s0')} as back_q0, {_r('s1')} as back_q1, {_r('s2')} as back_q2, {_r('s3')} as back_q3 from v_poses""")
def transform_pose(t: Tables) -> DataFrame:
    """To the world frame and back again."""
    p, q = G.pose_to_world(base_p(), base_q(), D(), S())
    world = t.poses.select("vec_id", *[c.alias(n) for c, n in zip([*p, *q], ("px", "py", "pz", "q0", "q1", "q2", "q3"))])
    back_p, back_q = G.pose_in_base(
        base_p(), base_q(), [F.col(c) for c in ("px", "py", "pz")], [F.col(f"q{i}") for i in range(4)]
    )
    return world.select(
        "vec_id", rounded("px").alias("wx"), rounded("py").alias("wy"), rounded("pz").alias("wz"),
        *[rounded(f"q{i}").alias(f"wq{i}") for i in range(4)],
        *[rounded(c).alias(f"back_{n}") for c, n in zip(back_p, ("x", "y", "z"))],
        *[rounded(c).alias(f"back_q{i}") for i, c in enumerate(back_q)],
    )


@query("G13", "v_poses", f"select vec_id, {_r('dx - s1')} as to_gripper_x, {_r('dy - s2')} as to_gripper_y, {_r('dz - s3')} as to_gripper_z from v_poses")
def relative_positions(t: Tables) -> DataFrame:
    rel = G.relative_position(D(), S()[1:])
    return t.poses.select("vec_id", *[rounded(c).alias(f"to_gripper_{n}") for c, n in zip(rel, ("x", "y", "z"))])


@query("G14", "v_poses", f"select vec_id, {_r('-0.05 + (greatest(-0.1, least(0.1, dx)) + 0.1) / 0.2 * 0.1')} as x, {_r('-0.05 + (greatest(-0.1, least(0.1, dy)) + 0.1) / 0.2 * 0.1')} as y, {_r('-0.05 + (greatest(-0.1, least(0.1, dz)) + 0.1) / 0.2 * 0.1')} as z from v_poses")
def decode_action(t: Tables) -> DataFrame:
    return t.poses.select(
        "vec_id", *[rounded(K.decode_action(F.col(f"d{n}"), (-0.1, 0.1), (-0.05, 0.05))).alias(n) for n in ("x", "y", "z")]
    )


@query("G15", "v_poses", f"""select vec_id, {_r('round(dx, 3)')} as px, {_r('round(dy, 3)')} as py, {_r('round(dz, 3)')} as pz,
{_r("case when vec_id % 2 = 0 then 1.0 else round(s0, 3) end")} as qw, {_r("case when vec_id % 2 = 0 then 0.0 else round(s1, 3) end")} as qx,
{_r("case when vec_id % 2 = 0 then 0.0 else round(s2, 3) end")} as qy, {_r("case when vec_id % 2 = 0 then 0.0 else round(s3, 3) end")} as qz from v_poses""")
def base_pose_from_xml(t: Tables) -> DataFrame:
    """A model text is built per row; every other body has no quaternion, which then is the identity."""
    position, quat = (F.format_string(" ".join(["%.3f"] * len(c)), *[F.round(x, 3) for x in c]) for c in (("dx", "dy", "dz"), ("s0", "s1", "s2", "s3")))
    rotated = F.when(F.col("vec_id") % 2 == 0, "").otherwise(F.concat(F.lit(" quat='"), quat, F.lit("'")))
    xml = F.concat(F.lit("<model><worldbody><body name='base0' pos='"), position, F.lit("'"), rotated, F.lit("/></worldbody></model>"))
    p, q = G.base_pose_from_xml(xml, "base0")
    return t.poses.select(
        "vec_id", *[rounded(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(("px", "py", "pz"))],
        *[rounded(F.get(q, F.lit(i))).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))],
    )


@query("G16", "", f"select event_id, {_r('(event_id - 2048) * 2 * pi() / 4096')} as radian from events")
def encoder_to_radian(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", rounded(K.encoder_to_radian(F.col("event_id"))).alias("radian"))


@query("G17", "", f"select event_id, {_r('(value - 0.4) / 1.1')} as scaled, {_r('value')} as back from events")
def rescale(t: Tables) -> DataFrame:
    scaled = K.rescale(F.col("value"), K.FAULTY_BOUNDS)
    return t.table("events").select("event_id", rounded(scaled).alias("scaled"), rounded(K.unscale(scaled, K.FAULTY_BOUNDS)).alias("back"))


@query("G18", "", """select branch, count(*) as anchors, round(max(err), 6) + 0.0 as max_abs_error, count_if(err > 1e-3) as violations from (
select branch, abs(((2405 + (event_id % 2) * 705 - 2048) * 2 * pi() / 4096 - lo) / (hi - lo) - event_id % 2) as err
from events cross join (select 'faulty' as branch, 0.4 as lo, 1.5 as hi union all select 'repaired', 0.5476, 1.6296)) group by branch""")
def anchor_mapping(t: Tables) -> DataFrame:
    """Every event is one reading of the closed or the open anchor."""
    low, high = K.ENCODER_COUNTS
    odd = F.col("event_id") % 2
    rows = t.table("events").select(
        (F.lit(low) + odd * (high - low)).alias("count"), F.when(odd == 0, K.ANCHOR_OUTPUTS[0]).otherwise(K.ANCHOR_OUTPUTS[1]).alias("expected")
    )
    radian = K.encoder_to_radian(F.col("count"))
    both = rows.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("branch"), F.abs(K.rescale(radian, b) - F.col("expected")).alias("err"))
        for n, b in (("faulty", K.FAULTY_BOUNDS), ("repaired", K.REPAIRED_BOUNDS))
    ])).alias("x")).select("x.*")
    return both.groupBy("branch").agg(
        F.count(F.lit(1)).alias("anchors"), rounded(F.max("err")).alias("max_abs_error"),
        F.count_if(F.col("err") > K.ANCHOR_TOLERANCE).alias("violations"),
    )


_LIN = "(abs({x}) * (0.058 - 0.01844) + 0.01844)"


def _ang(x: str, lo: float, hi: float) -> str:
    lin = _LIN.format(x=x)
    return f"(asin(greatest(-1.0, least(1.0, (0.022*0.022 + {lin}*{lin} - 0.036*0.036) / (2*0.022*{lin})))) - {lo}) / ({hi} - {lo})"


@query("G19", "v_poses", f"""select vec_id, {_r(_ang('dx', 0.5476, 1.6296), 5)} as repaired, {_r(_ang('dx', 0.4, 1.5), 5)} as faulty,
{_r('(dx + 0.5476 + 0.6213) / (1.4910 + 0.6213)')} as from_angular, {_r('dx')} as back from v_poses""")
def gripper_to_angular(t: Tables) -> DataFrame:
    x = F.abs("dx")
    out = K.gripper_from_angular(F.col("dx"))
    return t.poses.select(
        "vec_id", rounded(K.gripper_to_angular(x), 5).alias("repaired"), rounded(K.gripper_to_angular(x, K.FAULTY_BOUNDS), 5).alias("faulty"),
        rounded(out).alias("from_angular"), rounded(K.gripper_from_angular_inverse(out)).alias("back"),
    )


_SIGNS = "[1,-1,-1,1,1,1,1,1,-1,-1,1,1,1,1]"


_GRIP = "i in (7, 14)"


@query("G20", "v_vec", "select vec_id, " + _sql_vector(f"{_SIGNS}[i] * state[i]", 14) + " as flipped, "
       + _sql_vector(f"case when {_GRIP} then ({_SIGNS}[i] * state[i]::double + 0.5476 + 0.6213) / (1.4910 + 0.6213) else {_SIGNS}[i] * state[i]::double end", 14) + " as sent, "
       + _sql_vector(f"case when {_GRIP} then (({_SIGNS}[i] * state[i]::double + 0.5476 + 0.6213) / (1.4910 + 0.6213)) * (1.4910 + 0.6213) - 0.6213 - 0.5476 else {_SIGNS}[i] * {_SIGNS}[i] * state[i]::double end", 14) + " as back from v_vec")
def joint_sign_flip(t: Tables) -> DataFrame:
    arm = F.transform(F.slice("state", 1, 14), lambda x: x.cast("double"))
    sent = K.encode_actions(arm)
    return t.vectors.select(
        "vec_id", _vector(K.flip_joints(arm)).alias("flipped"), _vector(sent).alias("sent"),
        _vector(K.encode_actions_inverse(sent)).alias("back"),
    )


@query("G21", "", f"select count(*) as readings, {_r('max(abs((((event_id - 2048) * 2 * pi() / 4096 - 0.4) / (1.5 - 0.4)) * (1.5 - 0.4) + 0.4 - (event_id - 2048) * 2 * pi() / 4096))', 9)} as max_error from events")
def round_trip_error(t: Tables) -> DataFrame:
    radian = K.encoder_to_radian(F.col("event_id"))
    return t.table("events").agg(
        F.count(F.lit(1)).alias("readings"), rounded(F.max(K.round_trip_error(radian, K.FAULTY_BOUNDS)), 9).alias("max_error")
    )


# ---- conversion coverage -------------------------------------------------------------------------


def stored_fields(t: Tables) -> DataFrame:
    """Stored fields of four shapes; eef fields stay unconverted, poses are converted."""
    p = t.poses
    s, q = F.array("s0", "s1", "s2", "s3"), F.array("s1", "s2", "s3", "s0")
    d = F.array("dx", "dy", "dz")
    where = F.concat(F.lit("data/demo_"), F.col("label").cast("string"))
    def field(suffix: str, source: Column, target: Column):
        return F.struct(F.concat(where, F.lit(suffix)).alias("path"), source.alias("source"), target.alias("target"))

    kinds = F.array(
        field("/states/root_pose", F.concat(d, s), F.concat(d, q)),
        field("/obs/eef_quat", s, s),
        field("/obs/cube_orientations", F.concat(s, s), F.concat(q, s)),
        field("/obs/object", F.concat(d, s, d, s, d, s), F.concat(d, q, d, q, d, s)),
        field("/obs/joint_pos", F.concat(d, d), F.concat(d, d)),
    )
    return p.select("vec_id", F.explode(kinds).alias("f")).select(F.col("vec_id").alias("row"), "f.*")


_STATES = f"""inst as (
select 'root_pose' as family, concat('data/demo_', label, '/states/root_pose') as path, vec_id as row, 3 as start, true as conv, * from v_poses
union all select 'eef_quat', concat('data/demo_', label, '/obs/eef_quat'), vec_id, 0, false, * from v_poses
union all select 'cube_orientations', concat('data/demo_', label, '/obs/cube_orientations'), vec_id, 0, true, * from v_poses
union all select 'cube_orientations', concat('data/demo_', label, '/obs/cube_orientations'), vec_id, 4, false, * from v_poses
union all select 'object_embedded', concat('data/demo_', label, '/obs/object'), vec_id, 3, true, * from v_poses
union all select 'object_embedded', concat('data/demo_', label, '/obs/object'), vec_id, 10, true, * from v_poses
union all select 'object_embedded', concat('data/demo_', label, '/obs/object'), vec_id, 17, false, * from v_poses),
st as (select family, path, row, start, conv, case when conv then 0.0::double else
  degrees(2 * acos(least(1.0, abs(s0*s3 + s1*s0 + s2*s1 + s3*s2)))) end as err from inst)"""


@query("G22", "v_poses", f"select vec_id, {_r('dx')} as p0, {_r('dy')} as p1, {_r('dz')} as p2, {_r('s1')} as p3, {_r('s2')} as p4, {_r('s3')} as p5, {_r('s0')} as p6, 2 as format_version from v_poses")
def convert_pose_columns(t: Tables) -> DataFrame:
    poses = t.poses.select("vec_id", F.array("dx", "dy", "dz", "s0", "s1", "s2", "s3").alias("pose"), F.lit(1).alias("format_version"))
    out = V.convert_pose_columns(poses, "pose", "format_version", 2)
    return out.select("vec_id", *[rounded(F.get("pose", F.lit(i))).alias(f"p{i}") for i in range(7)], "format_version")


@query("G23", "v_poses", "select family, path, row, start from inst", extra=_STATES)
def conversion_inventory(t: Tables) -> DataFrame:
    return V.conversion_inventory(stored_fields(t)).select("family", "path", "row", "start")


@query("G24 schema", "v_poses", """select count(distinct path) as source_fields, count(distinct path) as target_fields, true as same_paths, count(distinct path) as same_shape,
count(distinct path) as same_type, count(distinct path) filter (where n_changed = 0) as unchanged, 2 as lowest_version, 2 as highest_version, true as accepted from (
select path, count_if(conv and not (s0 = s1 and s1 = s2 and s2 = s3)) as n_changed from (select path, conv, s0, s1, s2, s3 from inst
union all select concat('data/demo_', label, '/obs/joint_pos'), false, s0, s1, s2, s3 from v_poses) group by path)""", extra=_STATES)
def conversion_schema_baseline(t: Tables) -> DataFrame:
    """Structure alone accepts the conversion that left fields out."""
    fields = stored_fields(t)
    source = fields.select("path", "row", F.col("source").alias("value"))
    target = fields.select("path", "row", F.col("target").alias("value"), F.lit(2).alias("format_version"))
    return V.schema_baseline(source, target, "format_version", 2)


@query("G24", "v_poses", """select family, path, count(*) as instances, count_if(conv) as converted_instances,
round(avg(case when not conv then err end), 4) + 0.0 as missed_mean_error_deg from st group by family, path""", extra=_STATES)
def conversion_coverage(t: Tables) -> DataFrame:
    out = V.conversion_coverage(V.with_conversion_state(V.conversion_inventory(stored_fields(t))))
    return out.withColumn("missed_mean_error_deg", rounded("missed_mean_error_deg", 4))


@query("D22", "v_poses", """select count(*) as evaluated, count_if(err > 1e-6) as nonzero, count_if(err > 90) as over_90, round(avg(err), 4) + 0.0 as mean_error,
round(max(err), 4) + 0.0 as max_error, round(quantile_cont(err, 0.5), 4) + 0.0 as median_error, round(quantile_cont(err, 0.95), 4) + 0.0 as p95_error from st where not conv""", extra=_STATES)
def error_summary(t: Tables) -> DataFrame:
    states = V.with_conversion_state(V.conversion_inventory(stored_fields(t))).where(~F.col("converted"))
    out = V.error_summary(states, "error_deg")
    return out.select("evaluated", "nonzero", "over_90", *[rounded(c, 4).alias(c) for c in ("mean_error", "max_error", "median_error", "p95_error")])


# ---- vector transforms ---------------------------------------------------------------------------


def _state_stats(t: Tables) -> DataFrame:
    from episcope.operators.statistics import long_components, vector_moments

    long = long_components(t.vectors, {"state": "state"})
    return X.wide_stats(vector_moments(long, ["component_index"])).withColumnsRenamed(
        {m: f"s_{m}" for m in ("mean", "std", "q01", "q99")}
    )


_W = """w as (select list(m order by i) as mean, list(s order by i) as std, list(a order by i) as q01, list(b order by i) as q99 from (
select component_index as i, avg(x) as m, stddev_pop(x) as s, quantile_cont(x, 0.01) as a, quantile_cont(x, 0.99) as b
from v_comp where feature_group = 'state' group by component_index))"""


@query("F1", "v_comp", "select vec_id, " + _sql_vector("(state[i]::double - mean[i]) / (std[i] + 1e-6)") + " as z from v_vec, w", extra=_W)
def normalize(t: Tables) -> DataFrame:
    rows = X.with_stats(t.vectors, _state_stats(t))
    return rows.select("vec_id", _vector(X.normalize("state", "s_mean", "s_std")).alias("z"))


@query("F2", "v_comp", "select vec_id, " + _sql_vector("(state[i]::double - q01[i]) / (q99[i] - q01[i] + 1e-6) * 2 - 1") + " as z from v_vec, w", extra=_W)
def normalize_quantile(t: Tables) -> DataFrame:
    rows = X.with_stats(t.vectors, _state_stats(t))
    return rows.select("vec_id", _vector(X.normalize_quantile("state", "s_q01", "s_q99")).alias("z"))


@query("F3", "v_comp", "select vec_id, " + _sql_vector("(state[i]::double - mean[i]) / (std[i] + 1e-6) * (std[i] + 1e-6) + mean[i]") + " as back, "
       + _sql_vector("(((state[i]::double - q01[i]) / (q99[i] - q01[i] + 1e-6) * 2 - 1) + 1) / 2 * (q99[i] - q01[i] + 1e-6) + q01[i]") + " as qback from v_vec, w", extra=_W)
def unnormalize(t: Tables) -> DataFrame:
    rows = X.require_columns(X.with_stats(t.vectors, _state_stats(t)), ["state"])
    z, zq = X.normalize("state", "s_mean", "s_std"), X.normalize_quantile("state", "s_q01", "s_q99")
    return rows.select(
        "vec_id", _vector(X.unnormalize(z, "s_mean", "s_std")).alias("back"),
        _vector(X.unnormalize_quantile(zq, "s_q01", "s_q99")).alias("qback"),
    )


_MASK = (6, -1, 6, -1)
_MASKED = "i <= 6 or i between 8 and 13"


@query("F4", "v_vec", "select vec_id, " + _sql_vector(f"actions[i]::double - case when {_MASKED} then state[i]::double else 0 end") + " as d from v_vec")
def delta_actions(t: Tables) -> DataFrame:
    d = X.delta_actions("actions", "state", X.run_length_mask(*_MASK))
    return t.vectors.select("vec_id", _vector(d).alias("d"))


@query("F5", "v_vec", "select vec_id, " + _sql_vector(f"(actions[i]::double - case when {_MASKED} then state[i]::double else 0 end) + case when {_MASKED} then state[i]::double else 0 end") + " as a from v_vec")
def absolute_actions(t: Tables) -> DataFrame:
    mask = X.run_length_mask(*_MASK)
    moved = t.vectors.withColumn("d", X.delta_actions("actions", "state", mask))
    return moved.select("vec_id", _vector(X.absolute_actions("d", "state", mask)).alias("a"))


@query("F6", "v_vec", "select vec_id, cast(len([x for x in range(64) if x % 4 = 0]) as integer) as kept, " + _sql_vector("actions[(i - 1) * 4 + 1]", 16) + " as a from v_vec")
def subsample_actions(t: Tables) -> DataFrame:
    kept = X.subsample("actions", 4)
    return t.vectors.select("vec_id", F.size(kept).alias("kept"), _vector(kept).alias("a"))


@query("F7", "v_vec", "select vec_id, cast(greatest(len(state), 80) as integer) as width, " + _sql_vector("coalesce(state[i], 0)", 80) + " as s from v_vec")
def pad_to_dim(t: Tables) -> DataFrame:
    wide = X.pad_to_dim("state", 80)
    return t.vectors.select("vec_id", F.size(wide).alias("width"), _vector(wide).alias("s"))


# ---- structure -----------------------------------------------------------------------------------


@query("B3", "v_episodes", """select episode_index, cast(sum_index_min as double) as stats__index__min, cast(sum_index_min + length - 1 as double) as stats__index__max,
cast(sum_episode as double) as stats__episode_index__mean, 'stats/index/min,stats/index/max,stats/episode_index/mean' as restored from v_episodes""")
def safe_names(t: Tables) -> DataFrame:
    """Cells under their flat names, and the names that the inverse gives back."""
    flat = X.safe_names(t.episode_meta)
    names = ("stats__index__min", "stats__index__max", "stats__episode_index__mean")
    back = X.slash_names(flat.select(*names)).columns
    return flat.select("episode_index", *[F.get(n, F.lit(0)).alias(n) for n in names], F.lit(",".join(back)).alias("restored"))


@query("B5", "v_vec", "select vec_id, " + _sql_vector("state[i]") + " as cam_high, " + _sql_vector("actions[i]") + " as cam_low, label from v_vec")
def repack(t: Tables) -> DataFrame:
    tree = X.repack(t.vectors, {"images": {"high": "state", "low": "actions"}, "meta": {"label": "label"}}, keep=["vec_id"])
    return tree.select(
        "vec_id", _vector(F.col("images.high")).alias("cam_high"), _vector(F.col("images.low")).alias("cam_low"), "meta.label",
    )


@query("B6", "", 'select l_orderkey as "line/orderkey", l_partkey as "line/partkey", l_suppkey as "line/suppkey", l_linenumber as "line/linenumber", l_quantity as quantity from lineitem')
def rename_by_pattern(t: Tables) -> DataFrame:
    return X.rename_by_pattern(t.table("lineitem"), {
        r"l_quantity": "quantity", r"l_(.*key|linenumber)": r"line/\1", r"l_.*": None,
    })


@query("B7", "", "select n_nationkey, n_regionkey from nation")
def drop_string_columns(t: Tables) -> DataFrame:
    return X.drop_string_columns(t.table("nation"))


