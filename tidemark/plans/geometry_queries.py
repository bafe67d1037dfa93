"""Rotations, frames and projection on the pose fixture.

The SQL side is composed from elementary rotations by plain matrix products, so it shares no formula with the column functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rot
from tidemark.plans.registry import POSES, poses, query, rounded


class X(str):
    """A SQL expression that arithmetic composes."""

    def _op(self, sign: str, other) -> X:
        return X(f"({self} {sign} {other})")

    def __add__(self, other):
        return self._op("+", other)

    def __sub__(self, other):
        return self._op("-", other)

    def __mul__(self, other):
        return self._op("*", other)

    def __truediv__(self, other):
        return self._op("/", other)

    def __neg__(self):
        return X(f"(-{self})")


def f(name: str, *args) -> X:
    return X(f"{name}({', '.join(map(str, args))})")


def n(value: float) -> X:
    return X(f"{float(value)!r}::double")


def axis(k: int, a: X) -> list[X]:
    m = [n(i % 4 == 0) for i in range(9)]
    i, j = [(1, 2), (2, 0), (0, 1)][k]
    m[4 * i], m[4 * j], m[3 * i + j], m[3 * j + i] = f("cos", a), f("cos", a), -f("sin", a), f("sin", a)
    return m


def product(a: list[X], b: list[X]) -> list[X]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def flipped(a: list[X]) -> list[X]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def fixed_axes(roll: X, pitch: X, yaw: X) -> list[X]:
    return product(product(axis(2, yaw), axis(1, pitch)), axis(0, roll))


def angles(m: list[X]) -> list[X]:
    return [f("atan2", m[7], m[8]), f("atan2", -m[6], f("sqrt", f("greatest", m[0] * m[0] + m[3] * m[3], n(1e-6)))), f("atan2", m[3], m[0])]


def named(values, prefix: str) -> list[X]:
    return [X(f"{prefix}{k}") for k in range(len(values))]


def stage(source: str, name: str, **groups) -> str:
    """A CTE that adds groups of columns: prefix=list of expressions."""
    cells = [f"{e} as {p}{k}" for p, values in groups.items() for k, e in enumerate(values)]
    return f"{name} as (select *, {', '.join(cells)} from {source})"


def shown(values, names) -> str:
    return ", ".join(f"round({v}, 6) + 0.0 as {name}" for v, name in zip(values, names, strict=True))


E = [X(f"e{k}") for k in range(17)]
RPY = ["roll", "pitch", "yaw"]
CELLS = [f"r{k}" for k in range(9)]
_R = stage("poses", "m", r=fixed_axes(E[4], E[5], E[6]))
_RS = stage("m", "s", s=fixed_axes(E[7], E[8], E[9]))
R, S = named(range(9), "r"), named(range(9), "s")


def select(values, names):
    return [rounded(v).alias(name) for v, name in zip(values, names, strict=True)]


def cols(*ks) -> list:
    return [F.col(f"e{k}") for k in ks]


@query("op_m1_axis_rotation", f"with {POSES} select vec_id, {shown(axis(2, E[4]), CELLS)} from poses")
def m1(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.about_axis(2, F.col("e4")), CELLS))


@query("op_m2_euler_to_matrix", f"with {POSES}, {_R} select vec_id, {shown(R, CELLS)} from m")
def m2(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.euler_to_matrix(cols(4, 5, 6)), CELLS))


@query("op_m3_matrix_to_euler", f"with {POSES}, {_R} select vec_id, {shown(angles(R), RPY)} from m")
def m3(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.matrix_to_euler(rot.euler_to_matrix(cols(4, 5, 6))), RPY))


def _quaternion_product(a, b):
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def _half(k: int, a: X):
    q = [n(0)] * 3 + [f("cos", a * n(0.5))]
    q[k] = f("sin", a * n(0.5))
    return q


_Q = stage("poses", "q", q=_quaternion_product(_quaternion_product(_half(0, E[4]), _half(1, E[5])), _half(2, E[6])))
QN = named(range(4), "q")


def _turned(q):
    """A rotation matrix by turning the unit vectors: v + 2 u x (u x v + w v), for a unit quaternion."""
    x, y, z, w = q
    out = []
    for k in range(3):
        v = [n(i == k) for i in range(3)]
        t = [y * v[2] - z * v[1] + w * v[0], z * v[0] - x * v[2] + w * v[1], x * v[1] - y * v[0] + w * v[2]]
        out.append([v[0] + n(2) * (y * t[2] - z * t[1]), v[1] + n(2) * (z * t[0] - x * t[2]), v[2] + n(2) * (x * t[1] - y * t[0])])
    return [out[j][i] for i in range(3) for j in range(3)]


@query("op_m4_euler_to_quaternion", f"with {POSES}, {_Q} select vec_id, {shown(QN, ['x', 'y', 'z', 'w'])} from q")
def m4(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.euler_to_quaternion(cols(4, 5, 6)), ["x", "y", "z", "w"]))


@query("op_m5_quaternion_to_euler", f"with {POSES}, {_Q}, {stage('q', 'm', r=_turned(QN))} select vec_id, {shown(angles(R), RPY)} from m")
def m5(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.quaternion_to_euler(rot.euler_to_quaternion(cols(4, 5, 6))), RPY))


@query("op_m6_quaternion_to_matrix", f"with {POSES}, {_Q}, {stage('q', 'm', r=_turned(QN))} select vec_id, {shown(R, CELLS)} from m")
def m6(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.quaternion_to_matrix(rot.euler_to_quaternion(cols(4, 5, 6))), CELLS))


@query("op_m7_matrix_to_quaternion", f"with {POSES}, {_Q} select vec_id, round(q0, 3) + 0.0 as x, round(q1, 3) + 0.0 as y, round(q2, 3) + 0.0 as z, round(q3, 3) + 0.0 as w from q")
def m7(spark, sf):
    rows = poses(spark, sf).withColumn("m", rot.as_array(rot.quaternion_to_matrix(rot.euler_to_quaternion(cols(4, 5, 6)))))
    q = rot.matrix_to_quaternion(rot.unpack(F.col("m"), 0, 9))
    return rows.select("vec_id", *[rounded(v, 3).alias(name) for v, name in zip(q, "xyzw", strict=True)])


@query("op_m8_r6_rows", f"with {POSES}, {_R} select vec_id, {shown([R[0], R[1], R[2], R[3], R[4], R[5]], ['a', 'b', 'c', 'd', 'e', 'f'])}, {shown(R[6:], ['g', 'h', 'i'])} from m")
def m8(spark, sf):
    r6 = rot.matrix_to_r6(rot.euler_to_matrix(cols(4, 5, 6)))
    return poses(spark, sf).select("vec_id", *select(r6, list("abcdef")), *select(rot.r6_to_matrix([2.0 * c for c in r6])[6:], list("ghi")))


@query("op_m9_r6_to_euler", f"with {POSES}, {_R} select vec_id, {shown(angles(R), RPY)} from m")
def m9(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.r6_to_euler(rot.euler_to_r6(cols(4, 5, 6))), RPY))


@query("op_m10_r6_columns", f"with {POSES}, {_R} select vec_id, {shown([R[0], R[3], R[6], R[1], R[4], R[7]], ['a', 'b', 'c', 'd', 'e', 'f'])} from m")
def m10(spark, sf):
    back = rot.r6_to_matrix(rot.euler_to_r6(cols(4, 5, 6), "columns"), "columns")
    return poses(spark, sf).select("vec_id", *select(rot.matrix_to_r6(back, "columns"), list("abcdef")))


_JACO = [n(v) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)]
MOVE = ["x", "y", "z", *RPY]


@query("op_m11_change_axes", f"with {POSES}, {_R}, {stage('m', 's', s=product(product(_JACO, R), flipped(_JACO)))} select vec_id, {shown([-E[2], E[1], E[3], *angles(S)], MOVE)} from s")
def m11(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.change_axes(cols(1, 2, 3, 4, 5, 6), rot.constant(rot.AXES["jaco"])), MOVE))


@query("op_m12_relative_euler", f"with {POSES}, {_R}, {_RS}, {stage('s', 'd', d=product(flipped(R), S))} select vec_id, {shown(angles(named(range(9), 'd')), RPY)} from d")
def m12(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.relative_euler(cols(7, 8, 9), cols(4, 5, 6)), RPY))


@query("op_m13_zxy_to_euler", f"with {POSES}, {stage('poses', 'm', r=product(product(axis(2, E[4]), axis(0, E[5])), axis(1, E[6])))} select vec_id, {shown(angles(R), RPY)} from m")
def m13(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.zxy_to_euler(cols(4, 5, 6)), RPY))


@query("op_m14_pose_matrix", f"with {POSES}, {_R} select vec_id, {shown([E[1], E[2], E[3], *angles(R)], MOVE)} from m")
def m14(spark, sf):
    m = rot.euler_to_matrix(cols(4, 5, 6))
    zero, one = F.lit(0.0), F.lit(1.0)
    stored = F.array(m[0], m[3], m[6], zero, m[1], m[4], m[7], zero, m[2], m[5], m[8], zero, *cols(1, 2, 3), one)
    return poses(spark, sf).withColumn("pose", stored).select("vec_id", *select(rot.pose_matrix_to_euler(F.col("pose")), MOVE))


_ANGLE = f("sqrt", E[4] * E[4] + E[5] * E[5] + E[6] * E[6])
_AXQ = stage("poses", "a", h=[_ANGLE])
_AQ = stage("a", "q", q=[*(e / X("h0") * f("sin", X("h0") / n(2)) for e in E[4:7]), f("cos", X("h0") / n(2))])


@query("op_m15_axis_angle", f"with {POSES}, {_AXQ}, {_AQ}, {stage('q', 'm', r=_turned(QN))} select vec_id, {shown([f('atan2', R[7], R[8]), f('asin', -R[6]), f('atan2', R[3], R[0])], RPY)}, {shown(R[:6], ['a', 'b', 'c', 'd', 'e', 'f'])} from m")
def m15(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.axis_angle_to_euler(cols(4, 5, 6)), RPY), *select(rot.axis_angle_to_r6(cols(4, 5, 6)), list("abcdef")))


@query("op_m16_moving_axes_matrix", f"with {POSES}, {stage('poses', 'm', r=product(product(axis(0, E[4]), axis(1, E[5])), axis(2, E[6])))} select vec_id, {shown(R, CELLS)} from m")
def m16(spark, sf):
    m = rot.matmul(rot.matmul(rot.about_axis(0, F.col("e4")), rot.about_axis(1, F.col("e5"))), rot.about_axis(2, F.col("e6")))
    return poses(spark, sf).select("vec_id", *select(m, CELLS))


@query("op_m17_state_dispatch", f"with {POSES}, {_R}, k as (select *, (['POS_EULER', 'EEF_R6', 'NONE'])[1 + vec_id % 3] as kind from m) select vec_id, kind, case kind when 'POS_EULER' then 6 when 'EEF_R6' then 9 else 0 end::int as width, round(case kind when 'POS_EULER' then e4 when 'EEF_R6' then r0 end, 6) + 0.0 as fourth from k")
def m17(spark, sf):
    kind = F.get(F.array(F.lit("POS_EULER"), F.lit("EEF_R6"), F.lit("NONE")), (F.col("vec_id") % 3).cast("int"))
    euler, r6 = F.array(*cols(1, 2, 3, 4, 5, 6)), F.array(*cols(1, 2, 3), *rot.euler_to_r6(cols(4, 5, 6)))
    state = F.when(F.col("kind") == "POS_EULER", euler).when(F.col("kind") == "EEF_R6", r6).otherwise(F.array().cast("array<double>"))
    return poses(spark, sf).withColumn("kind", kind).withColumn("s", state).select("vec_id", "kind", F.size("s").alias("width"), rounded(F.get("s", F.lit(3))).alias("fourth"))


@query("op_m18_state_type", "select vec_id, case label % 4 when 0 then 'none' when 1 then 'eef_pose' when 2 then 'eef_pose' else 'joint_pos' end as state_type from embeddings")
def m18(spark, sf):
    encoding = F.get(F.array(*[F.lit(x) for x in ("NONE", "POS_EULER", "EEF_R6", "JOINT")]), (F.col("episode_id") % 4).cast("int"))
    name = F.when(encoding == "NONE", "none").when(encoding.isin("POS_EULER", "POS_QUAT", "EEF_R6"), "eef_pose").otherwise("joint_pos")
    return poses(spark, sf).select("vec_id", name.alias("state_type"))


_CLASS = "case when {n} < 1e-9 then 'none' when abs({a}) >= 0.92 * {n} then 'roll' when abs({b}) >= 0.92 * {n} then 'pitch' when abs({c}) >= 0.92 * {n} then 'yaw' else 'mixed' end"


@query("op_m19_axis_class", f"with {POSES} select vec_id, {_CLASS.format(n=_ANGLE, a='e4', b='e5', c='e6')} as axis, {shown([E[4], E[5], E[6]], ['u', 'v', 'w'])} from poses")
def m19(spark, sf):
    back = rot.matrix_to_axis_angle(rot.axis_angle_to_matrix(cols(4, 5, 6)))
    return poses(spark, sf).select("vec_id", rot.axis_class(cols(4, 5, 6)).alias("axis"), *select(back, ["u", "v", "w"]))


_NEXT = ", ".join(f"lead(e{k}) over (partition by episode_id order by t) as n{k}" for k in range(1, 7))
_DELTA = f"x as (select *, {_NEXT} from poses), {stage('x', 'm', r=fixed_axes(E[4], E[5], E[6]))}, {stage('m', 's', s=fixed_axes(X('n4'), X('n5'), X('n6')))}, {stage('s', 'd', d=product(flipped(R), S))}"
_STEP = [X(f"n{k}") - E[k] for k in (1, 2, 3)]


@query("op_m20_pose_delta", f"with {POSES}, {_DELTA} select vec_id, {shown(_STEP, ['wx', 'wy', 'wz'])}, {shown([R[k] * _STEP[0] + R[3 + k] * _STEP[1] + R[6 + k] * _STEP[2] for k in range(3)], ['gx', 'gy', 'gz'])}, {shown(angles(named(range(9), 'd')), RPY)} from d where n1 is not null")
def m20(spark, sf):
    from tidemark.plans.registry import EP

    rows = poses(spark, sf)
    for k in range(1, 7):
        rows = rows.withColumn(f"n{k}", F.lead(f"e{k}").over(EP.ordered))
    step = [F.col(f"n{k}") - F.col(f"e{k}") for k in (1, 2, 3)]
    inverse = rot.transpose(rot.euler_to_matrix(cols(4, 5, 6)))
    turn = rot.relative_euler([F.col(f"n{k}") for k in (4, 5, 6)], cols(4, 5, 6))
    return rows.where("n1 is not null").select("vec_id", *select(step, ["wx", "wy", "wz"]), *select(rot.apply(inverse, step), ["gx", "gy", "gz"]), *select(turn, RPY))


@query("op_m21_gripper_trend", f"with {POSES}, x as (select *, lead(e7) over (partition by episode_id order by t) - e7 as d from poses) select vec_id, case when d is null or abs(d) < 0.1 then 'holding' when d > 0 then 'opening' else 'closing' end as trend from x")
def m21(spark, sf):
    from tidemark.plans.registry import EP

    d = F.lead("e7").over(EP.ordered) - F.col("e7")
    rows = poses(spark, sf).withColumn("d", d)
    return rows.select("vec_id", F.when(F.col("d").isNull() | (F.abs("d") < 0.1), "holding").when(F.col("d") > 0, "opening").otherwise("closing").alias("trend"))


@query("op_m22_tool_frame", f"with {POSES}, {stage('poses', 'm', r=fixed_axes(E[10], E[11], E[12]))}, {stage('m', 's', s=fixed_axes(E[4], E[5], E[6]))}, {stage('s', 'd', d=product(product(flipped(R), S), R))} select vec_id, {shown([*(R[k] * E[1] + R[3 + k] * E[2] + R[6 + k] * E[3] for k in range(3)), *angles(named(range(9), 'd'))], MOVE)} from d")
def m22(spark, sf):
    return poses(spark, sf).select("vec_id", *select(rot.to_tool_frame(cols(1, 2, 3, 4, 5, 6), cols(10, 11, 12)), MOVE))


@query("op_m22_base_frame", f"with {POSES} select vec_id, {shown(E[1:7], MOVE)} from poses")
def m22_base(spark, sf):
    back = rot.to_base_frame(rot.to_tool_frame(cols(1, 2, 3, 4, 5, 6), cols(10, 11, 12)), cols(10, 11, 12))
    return poses(spark, sf).select("vec_id", *select(back, MOVE))


_SEEN = [R[k] * (E[1] - E[7]) + R[3 + k] * (E[2] - E[8]) + R[6 + k] * (E[3] - E[9]) for k in range(3)]


@query("op_m23_projection", f"with {POSES}, {_R}, {stage('m', 'p', p=_SEEN)} select vec_id, round(case when p2 > 0.01 then 112.0::double + 200.0::double * p0 / p2 end, 4) as u, round(case when p2 > 0.01 then 112.0::double + 200.0::double * p1 / p2 end, 4) as v, round(p2, 6) + 0.0 as depth from p")
def m23(spark, sf):
    u, v, depth = rot.project(cols(1, 2, 3), cols(7, 8, 9), cols(4, 5, 6), 200.0, (112.0, 112.0))
    near = depth > 0.01
    return poses(spark, sf).select("vec_id", F.round(F.when(near, u), 4).alias("u"), F.round(F.when(near, v), 4).alias("v"), rounded(depth).alias("depth"))


@query("op_m24_wxyz_to_r6", f"with {POSES}, {_Q}, {stage('q', 'm', r=_turned(QN))} select vec_id, {shown(R[:6], ['a', 'b', 'c', 'd', 'e', 'f'])} from m")
def m24(spark, sf):
    q = rot.euler_to_quaternion(cols(4, 5, 6))
    return poses(spark, sf).select("vec_id", *select(rot.wxyz_to_r6([q[3], *q[:3]]), list("abcdef")))


@query("op_f13_point_in_image", f"with {POSES}, x as (select vec_id, 0.5::double + e1 as u, 0.5::double + e2 as v from poses), y as (select vec_id, u * (224.0::double / 224) as lu, v * (126.0::double / 224) + 49.0::double / 224 as lv from x) select vec_id, lu between 0 and 1 and lv between 49.0::double / 224 and 175.0::double / 224 as inside from y")
def f13(spark, sf):
    from tidemark.functions import boxes

    u, v = F.lit(0.5) + F.col("e1"), F.lit(0.5) + F.col("e2")
    x, y = boxes.letterbox(u, v, F.lit(640.0), F.lit(360.0), 224, 224)
    free = F.col("e1").between(-0.5, 0.5)
    return poses(spark, sf).select("vec_id", (free & x.between(0, 1) & y.between(49.0 / 224, 175.0 / 224)).alias("inside"))
