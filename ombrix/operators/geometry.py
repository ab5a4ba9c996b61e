"""Cameras, rigid motions and rotations as column expressions: flat doubles, so that codegen keeps them in one stage."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


@dataclass(frozen=True)
class Intrinsics:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int

    @classmethod
    def simple(cls, width: int, height: int, fov_deg: float = 55.0) -> Intrinsics:
        f = 0.5 * width / math.tan(math.radians(fov_deg) / 2)
        return cls(f, f, width / 2, height / 2, width, height)

    def scaled(self, k: float) -> Intrinsics:
        return Intrinsics(self.fx * k, self.fy * k, self.cx * k, self.cy * k, int(round(self.width * k)), int(round(self.height * k)))


@dataclass(frozen=True)
class Pose:
    """World to camera: p' = R p + t, R by rows; x right, y down, z forward."""

    r: tuple[float, ...]
    t: tuple[float, float, float]

    @classmethod
    def look_at(cls, eye, target, up=(0.0, 0.0, 1.0)) -> Pose:
        eye = np.asarray(eye, float)
        forward = np.asarray(target, float) - eye
        forward /= np.linalg.norm(forward)
        right = np.cross(forward, up)
        right /= np.linalg.norm(right)
        r = np.stack([right, np.cross(forward, right), forward])
        return cls(tuple(r.ravel().tolist()), tuple((-r @ eye).tolist()))

    @property
    def center(self) -> tuple[float, ...]:
        return tuple((-np.array(self.r).reshape(3, 3).T @ np.array(self.t)).tolist())


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def rotate(r, p) -> Vec:
    return tuple(r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] for i in range(3))


def to_camera(pose: Pose, p: Vec) -> Vec:
    return tuple(v + t for v, t in zip(rotate([F.lit(x) for x in pose.r], p), pose.t, strict=True))


def once(cloud: DataFrame, *names: str) -> DataFrame:
    """``cloud`` with the named columns evaluated once per row.

    The optimiser pastes a column's expression into every filter and formula that reads it; where that expression is dear
    (casts of decimals, say) and read dozens of times, a generator of one row keeps it apart.
    """
    return cloud.select(*[c for c in cloud.columns if c not in names], F.inline(F.array(F.struct(*names))))


def project(cloud: DataFrame, pose: Pose, k: Intrinsics) -> DataFrame:
    """Adds u, v and depth; depth may be negative, the caller filters."""
    x, y, z = to_camera(pose, (F.col("x"), F.col("y"), F.col("z")))
    safe = F.when(F.abs(z) < 1e-9, 1e-9).otherwise(z)
    return cloud.withColumns({"u": k.fx * x / safe + k.cx, "v": k.fy * y / safe + k.cy, "depth": z})


def unproject(pixels: DataFrame, pose: Pose, k: Intrinsics) -> DataFrame:
    """Adds x, y, z of the point seen at (u, v, depth)."""
    cam = ((F.col("u") - k.cx) * F.col("depth") / k.fx - pose.t[0], (F.col("v") - k.cy) * F.col("depth") / k.fy - pose.t[1], F.col("depth") - pose.t[2])
    back = [pose.r[3 * j + i] for i in range(3) for j in range(3)]
    return pixels.withColumns(dict(zip("xyz", rotate([F.lit(v) for v in back], cam), strict=True)))


@dataclass(frozen=True)
class Sim3:
    s: float
    r: tuple[float, ...]
    t: tuple[float, float, float]

    def apply(self, cloud: DataFrame) -> DataFrame:
        moved = rotate([F.lit(self.s * v) for v in self.r], (F.col("x"), F.col("y"), F.col("z")))
        return cloud.withColumns({n: v + t for n, v, t in zip("xyz", moved, self.t, strict=True)})

    def compose(self, other: Sim3) -> Sim3:
        """First ``other``, then this."""
        a, b = np.array(self.r).reshape(3, 3), np.array(other.r).reshape(3, 3)
        return Sim3(self.s * other.s, tuple((a @ b).ravel().tolist()), tuple((self.s * a @ np.array(other.t) + np.array(self.t)).tolist()))

    def inverse(self) -> Sim3:
        a = np.array(self.r).reshape(3, 3).T
        return Sim3(1 / self.s, tuple(a.ravel().tolist()), tuple((-a @ np.array(self.t) / self.s).tolist()))


def moments(pairs: DataFrame) -> DataFrame:
    """One row: means, source variance and cross-covariances of (sx, sy, sz) and (dx, dy, dz)."""
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.avg(f"{p}{a}").alias(f"m_{p}{a}") for p in "sd" for a in "xyz"]
    out += [F.covar_pop(f"d{a}", f"s{b}").alias(f"c_{a}{b}") for a in "xyz" for b in "xyz"]
    out.append((F.var_pop("sx") + F.var_pop("sy") + F.var_pop("sz")).alias("var_s"))
    return pairs.agg(*out)


def umeyama(pairs: DataFrame, with_scale: bool = True) -> Sim3:
    """The least-squares similarity from s to d: one aggregate over the pairs, a 3 x 3 decomposition on the driver."""
    m = moments(pairs).first()
    if m.n < 3:
        raise ValueError("three pairs are needed")
    cov = np.array([[m[f"c_{a}{b}"] for b in "xyz"] for a in "xyz"])
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1.0, 1.0, -1.0 if np.linalg.det(u) * np.linalg.det(vt) < 0 else 1.0])
    r = u @ sign @ vt
    s = float((d * np.diag(sign)).sum() / m.var_s) if with_scale and m.var_s > 0 else 1.0
    t = np.array([m.m_dx, m.m_dy, m.m_dz]) - s * r @ np.array([m.m_sx, m.m_sy, m.m_sz])
    return Sim3(s, tuple(r.ravel().tolist()), tuple(t.tolist()))


def mirror_quaternion(q: tuple[Column, ...]) -> tuple[Column, ...]:
    """The rotation reflected in the plane y = 0."""
    w, x, y, z = q
    return w, -x, y, -z


def face_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """Unit normal; (0, 0, 1) for a degenerate face."""
    n = cross(tuple(q - p for p, q in zip(a, b, strict=True)), tuple(q - p for p, q in zip(a, c, strict=True)))
    size = F.sqrt(dot(n, n))
    flat = size <= 1e-12
    return tuple(F.when(flat, F.lit(0.0 if i < 2 else 1.0)).otherwise(v / size) for i, v in enumerate(n))


def matrix_to_quaternion(m: list[Column]) -> tuple[Column, ...]:
    """(w, x, y, z) of a rotation by rows: by the trace if it is positive, else by the largest diagonal entry."""
    tr = m[0] + m[4] + m[8]
    s = [F.sqrt(tr + 1) * 2, F.sqrt(1 + m[0] - m[4] - m[8]) * 2, F.sqrt(1 + m[4] - m[0] - m[8]) * 2, F.sqrt(1 + m[8] - m[0] - m[4]) * 2]
    yz, zx, xy = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    sxy, sxz, syz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    cases = [
        (s[0] / 4, yz / s[0], zx / s[0], xy / s[0]),
        (yz / s[1], s[1] / 4, sxy / s[1], sxz / s[1]),
        (zx / s[2], sxy / s[2], s[2] / 4, syz / s[2]),
        (xy / s[3], sxz / s[3], syz / s[3], s[3] / 4),
    ]
    by_x, by_y = (m[0] >= m[4]) & (m[0] >= m[8]), m[4] >= m[8]
    return tuple(F.when(tr > 0, a).when(by_x, b).when(by_y, c).otherwise(d) for a, b, c, d in zip(*cases, strict=True))


def angle_between(a: Vec, b: Vec) -> Column:
    size = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-9))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def logit(x: Column, eps: float = 1e-6) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


SH_C0 = 0.28209479177387814


def rgb_to_sh_dc(c: Column) -> Column:
    return (c - 0.5) / SH_C0


def bounds(cloud: DataFrame, *keys: str) -> DataFrame:
    """Centre of the axis-aligned box, its largest horizontal half extent's radius, and the height range."""
    out = cloud.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    return out.select(*keys, *[((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias(f"c{c}") for c in "xyz"], F.sqrt(F.pow(F.col("hi_x") - F.col("lo_x"), 2) + F.pow(F.col("hi_y") - F.col("lo_y"), 2)).alias("extent"), "lo_z", "hi_z")


def candidate_poses(box: DataFrame, azimuths: int, heights: int) -> DataFrame:
    """Eyes on a ring around each box, height by height: (.., pose, azimuth, ex, ey, ez)."""
    lo, hi = F.col("lo_z") + 0.15 * (F.col("hi_z") - F.col("lo_z")), 0.85 * F.col("hi_z")
    radius = F.col("extent") * 1.1 + 0.5
    out = box.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(heights - 1)))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(azimuths - 1))))
    out = out.withColumns({"pose": F.col("h") * azimuths + F.col("a"), "azimuth": F.col("a") * (2 * math.pi / azimuths)})
    rise = F.lit(heights - 1) if heights > 1 else F.lit(1)
    return out.withColumns({"ex": F.col("cx") + radius * F.cos("azimuth"), "ey": F.col("cy") + radius * F.sin("azimuth"), "ez": lo + (hi - lo) * F.col("h") / rise})


def bootstrap_pose(cloud: DataFrame, k: Intrinsics, *keys: str) -> DataFrame:
    """(keys, radius, ex, ey, ez): a three-quarter view from which the whole object fits the frame; two aggregations."""
    mean = cloud.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    gap = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    far = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    own = cloud.select(*keys, "x", "y", "z").join(mean, list(keys)) if keys else cloud.select("x", "y", "z").crossJoin(F.broadcast(mean))
    out = own.groupBy(*keys, "mx", "my", "mz").agg(F.max(far).alias("radius"))
    back = F.col("radius") / (0.5 * k.width / k.fx) * 1.4
    return out.select(*keys, "radius", (F.col("mx") + 0.82 * back).alias("ex"), (F.col("my") - 0.52 * back).alias("ey"), (F.col("mz") + 0.55 * F.col("radius")).alias("ez"))


def align_poses(poses: list[Pose], pairs: DataFrame) -> list[Pose]:
    """Poses of another frame in this one: pairs(sx, sy, sz, dx, dy, dz) of points known in both give the similarity.

    A centre moves as a point does, an orientation by the rotation alone. At least three pairs are needed.
    """
    sim = umeyama(pairs)
    turn = np.array(sim.r).reshape(3, 3)
    out = []
    for p in poses:
        r, t = np.array(p.r).reshape(3, 3), np.array(p.t)
        centre = sim.s * turn @ (-r.T @ t) + np.array(sim.t)
        moved = r @ turn.T
        out.append(Pose(tuple(moved.ravel().tolist()), tuple((-moved @ centre).tolist())))
    return out


def paired(source: DataFrame, target: DataFrame, order: str) -> DataFrame:
    """Pairs by place in order, as far as the shorter of both goes: (sx, sy, sz, dx, dy, dz)."""
    from pyspark.sql import Window as W

    a, b = (df.withColumn("_i", F.row_number().over(W.orderBy(order))).select("_i", *[F.col(c).alias(f"{n}{c}") for c in "xyz"]) for n, df in (("s", source), ("d", target)))
    return a.join(b, "_i").drop("_i")
