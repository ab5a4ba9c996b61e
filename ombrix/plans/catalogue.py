"""The registered queries of the engine, each beside the DuckDB text that gives the same rows on the same tables.

Floats are rounded to six places by one formula, since the engines' own round() treats ties differently: first to nine
places, so that sums which differ in their last bits tie alike, then to six; negative zeros are removed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ombrix.functions import naming
from ombrix.operators import canonical, cloud, consolidate, export, fusion, geometry, identity, pixels, registration, render, sampling
from ombrix.plans.bindings import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    fine = F.floor((F.col(c) if isinstance(c, str) else c) * 1e9 + 0.5) / 1e9
    return (F.floor(fine * 1e6 + 0.5) / 1e6 + F.lit(0.0)).alias(name)


def num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def s6(expr: str, name: str) -> str:
    return f"floor(floor(CAST({expr} AS DOUBLE) * 1e9 + 0.5::DOUBLE) / 1e9 * 1e6 + 0.5::DOUBLE) / 1e6 + 0.0::DOUBLE AS {name}"


def splats(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_splat")


FRAME = geometry.Intrinsics.simple(128, 96)
POSES = render.orbit(4)
P0 = POSES[0]
MATCH_VEHICLES = 5

_STATS = """count(*) AS splats, count(*) FILTER (provenance=1) AS observed, count(*) FILTER (provenance=0) AS prior,
 round(coalesce(avg(CASE WHEN provenance=1 THEN 1.0::DOUBLE ELSE 0 END),0),4) AS observed_fraction, round(coalesce(avg(confidence),0),4) AS mean_confidence"""


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what stands after pruning, per object."""
    return cloud.stats(cloud.prune(splats(spark, sf_dir)), "vehicle_id")


# ---- rows of clouds


@query(f"SELECT {_STATS} FROM v_splat", "v_splat")
def cloud_stats(spark, d):
    return cloud.stats(splats(spark, d))


@query(f"SELECT vehicle_id, {_STATS} FROM v_splat WHERE opacity > 0.05 GROUP BY vehicle_id", "v_splat")
def pruned_stats_by_vehicle(spark, d):
    return entry(spark, d)


@query("SELECT vehicle_id, " + s6("avg(CASE WHEN provenance=1 THEN 1.0::DOUBLE ELSE 0 END)", "fraction") + " FROM v_splat GROUP BY vehicle_id", "v_splat")
def observed_fraction_by_vehicle(spark, d):
    return splats(spark, d).groupBy("vehicle_id").agg(r6(cloud.observed_fraction(), "fraction"))


@query(
    f"""WITH s AS (SELECT vehicle_id, {_STATS} FROM v_splat GROUP BY vehicle_id)
SELECT v.vehicle_id, v.name, v.frames, coalesce(splats,0) AS splats, coalesce(observed,0) AS observed, coalesce(prior,0) AS prior,
 coalesce(observed_fraction,0) AS observed_fraction, coalesce(mean_confidence,0) AS mean_confidence FROM v_vehicle v LEFT JOIN s USING (vehicle_id)""",
    "v_splat",
    "v_vehicle",
)
def asset_rollup(spark, d):
    return cloud.rollup(view(spark, d, "v_vehicle").select("vehicle_id", "name", "frames"), splats(spark, d))


@query("SELECT splat_id, opacity FROM v_splat WHERE opacity > 0.05", "v_splat")
def prune_low_opacity(spark, d):
    return cloud.prune(splats(spark, d)).select("splat_id", "opacity")


@query("SELECT splat_id, vehicle_id, confidence FROM v_splat WHERE provenance = 1", "v_splat")
def select_observed(spark, d):
    return cloud.select_rows(splats(spark, d), F.col("provenance") == cloud.OBSERVED).select("splat_id", "vehicle_id", "confidence")


@query("SELECT splat_id, 0.01::DOUBLE AS scale, 1.0::DOUBLE AS qw, 0.9::DOUBLE AS opacity, 0 AS provenance, 0.1::DOUBLE AS confidence, 0 AS view_count FROM v_splat", "v_splat")
def splat_defaults(spark, d):
    return cloud.create(splats(spark, d).select("splat_id", "x", "y", "z", "r", "g", "b")).select("splat_id", "scale", "qw", "opacity", "provenance", "confidence", "view_count")


@query("SELECT vehicle_id - (vehicle_id + 1) % 2 AS primary_id, splat_id, provenance FROM v_splat WHERE vehicle_id % 2 = 1 OR provenance = 1", "v_splat")
def merge_clouds(spark, d):
    """Every odd vehicle takes in what was observed on the next even one."""
    s = splats(spark, d)
    out = cloud.merge(s.filter("vehicle_id % 2 = 1"), s.filter("vehicle_id % 2 = 0"))
    return out.select((F.col("vehicle_id") - (F.col("vehicle_id") + 1) % 2).alias("primary_id"), "splat_id", "provenance")


@query(
    f"""WITH w AS (SELECT vehicle_id, max_by(weight, (ts, observation_id)) AS weight, max(ts) AS seen FROM (SELECT *, CASE device WHEN 'phone_ar' THEN {num(1.0)} WHEN 'phone' THEN {num(0.85)}
 WHEN 'camera' THEN {num(0.8)} WHEN 'pi' THEN {num(0.6)} ELSE {num(0.3)} END AS weight FROM v_observation) GROUP BY vehicle_id),
u AS (SELECT s.splat_id, least(1, greatest(0, s.confidence + {num(0.35)} * w.weight)) AS c, s.view_count + 1 AS n, s.provenance AS p FROM v_splat s JOIN w USING (vehicle_id))
SELECT s.splat_id, {s6("coalesce(u.c, s.confidence)", "confidence")}, coalesce(u.n, s.view_count) AS view_count,
 CASE WHEN u.c >= 0.25 THEN 1 ELSE s.provenance END AS provenance FROM v_splat s LEFT JOIN u USING (splat_id)""",
    "v_splat",
    "v_observation",
)
def keyed_update_confirm(spark, d):
    """Splats of every vehicle with observations are confirmed by its last one's evidence."""
    s, o = splats(spark, d), view(spark, d, "v_observation")
    last = o.groupBy("vehicle_id").agg(F.max_by(registration.evidence_weight(F.col("device")), F.struct("ts", "observation_id")).alias("weight"))
    out = fusion.confirm_all(s.join(last, "vehicle_id", "left"), F.col("weight"), F.col("last_seen_ts"), fusion.FusionConfig())
    return out.select("splat_id", r6("confidence", "confidence"), "view_count", "provenance")


# ---- arbitration


@query(f"SELECT splat_id, confidence FROM v_splat WHERE provenance = 0 OR {num(0.6)} > confidence * (1 - {num(0.25)})", "v_splat")
def resist_filter(spark, d):
    return splats(spark, d).filter(~fusion.resists(0.6)).select("splat_id", "confidence")


@query(
    "WITH m AS (SELECT *, CASE WHEN provenance=0 THEN 1.0::DOUBLE ELSE "
    + num(0.6 * 0.85)
    + " END AS lr FROM v_splat) SELECT splat_id, "
    + ", ".join(s6(f"least(1, greatest(0, (1-lr)*{c} + lr*{t}))", c) for c, t in (("r", "b"), ("g", "r"), ("b", "g")))
    + ", 1 AS provenance FROM m",
    "v_splat",
)
def recolor_blend(spark, d):
    s = splats(spark, d).withColumns({"t_r": F.col("b"), "t_g": F.col("r"), "t_b": F.col("g")})
    out = fusion.recolour(s, 0.85)
    return out.select("splat_id", *[r6(c, c) for c in "rgb"], "provenance")


@query(f"SELECT observation_id, device, CASE device WHEN 'phone_ar' THEN {num(1.0)} WHEN 'phone' THEN {num(0.85)} WHEN 'camera' THEN {num(0.8)} WHEN 'pi' THEN {num(0.6)} WHEN 'cctv' THEN {num(0.3)} ELSE {num(0.5)} END AS weight FROM v_observation", "v_observation")
def evidence_weight(spark, d):
    return view(spark, d, "v_observation").select("observation_id", "device", registration.evidence_weight(F.col("device")).alias("weight"))


_CONF = "CASE WHEN inliers < 6 OR reproj_error IS NULL THEN 0 ELSE greatest(0, least(1, 0.4::DOUBLE*least(inliers/60.0::DOUBLE,1) + 0.3::DOUBLE*inliers/greatest(total_matches,1) + 0.3::DOUBLE*greatest(0,1-reproj_error/4.0::DOUBLE))) END"


@query(f"SELECT observation_id, {s6(_CONF, 'confidence')} FROM v_observation", "v_observation")
def registration_confidence(spark, d):
    c = registration.confidence(F.col("inliers"), F.col("total_matches"), F.col("reproj_error"))
    return view(spark, d, "v_observation").select("observation_id", r6(c, "confidence"))


@query(
    f"""WITH t AS (SELECT vehicle_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, observation_id) AS ord, inliers >= 6 AS has_pose, round({_CONF}, 9) AS confidence FROM v_observation),
a AS (SELECT vehicle_id, min(ord) FILTER (has_pose AND confidence >= 0.35) AS good, max(confidence) FILTER (confidence > 0) AS top FROM t GROUP BY vehicle_id)
SELECT a.vehicle_id, good IS NOT NULL AS accepted, CAST(coalesce(good, (SELECT min(ord) FROM t WHERE t.vehicle_id = a.vehicle_id AND t.confidence = a.top)) AS INT) AS chosen FROM a""",
    "v_observation",
)
def fallback_pick(spark, d):
    """Of a vehicle's observations in order of time, taken as registrars' tries: the one that is accepted."""
    c = F.round(registration.confidence(F.col("inliers"), F.col("total_matches"), F.col("reproj_error")), 9)
    ord_ = F.row_number().over(W.partitionBy("vehicle_id").orderBy("ts", "observation_id"))
    tries = view(spark, d, "v_observation").select("vehicle_id", ord_.alias("ord"), (F.col("inliers") >= 6).alias("has_pose"), c.alias("confidence"))
    return registration.fallback_pick(tries, "vehicle_id").select("vehicle_id", "accepted", "chosen")


@query("SELECT s.vehicle_id, count(*) FILTER (device = 'cctv') AS weak, count(*) AS observations FROM v_observation s GROUP BY s.vehicle_id", "v_observation")
def observations_by_vehicle(spark, d):
    return view(spark, d, "v_observation").groupBy("vehicle_id").agg(F.count_if(F.col("device") == "cctv").alias("weak"), F.count(F.lit(1)).alias("observations"))


# ---- geometry


def _camera_sql(p: geometry.Pose) -> str:
    rows = [f"{num(p.r[3 * i])}*x + {num(p.r[3 * i + 1])}*y + {num(p.r[3 * i + 2])}*z + {num(p.t[i])}" for i in range(3)]
    return f"SELECT *, {rows[0]} AS xc, {rows[1]} AS yc, {rows[2]} AS depth FROM v_splat"


def _projected_sql(p: geometry.Pose) -> str:
    return f"SELECT *, {num(FRAME.fx)}*xc/CASE WHEN abs(depth)<1e-9 THEN 1e-9 ELSE depth END + {num(FRAME.cx)} AS u, {num(FRAME.fy)}*yc/CASE WHEN abs(depth)<1e-9 THEN 1e-9 ELSE depth END + {num(FRAME.cy)} AS v FROM ({_camera_sql(p)})"


@query(f"SELECT splat_id, {s6('u', 'u')}, {s6('v', 'v')}, {s6('depth', 'depth')} FROM ({_projected_sql(P0)})", "v_splat")
def project_points(spark, d):
    return geometry.project(splats(spark, d), P0, FRAME).select("splat_id", *[r6(c, c) for c in ("u", "v", "depth")])


@query(f"SELECT splat_id, {s6('x', 'x')}, {s6('y', 'y')}, {s6('z', 'z')} FROM v_splat", "v_splat")
def unproject_inverts_projection(spark, d):
    """Projecting and lifting back gives the points themselves."""
    p = geometry.project(splats(spark, d), P0, FRAME).drop("x", "y", "z")
    return geometry.unproject(p, P0, FRAME).select("splat_id", *[r6(c, c) for c in "xyz"])


SIM = geometry.Sim3(1.5, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0.1, -0.2, 0.3))


@query(f"SELECT splat_id, {s6('-1.5::DOUBLE*y+0.1::DOUBLE', 'x')}, {s6('1.5::DOUBLE*x-0.2::DOUBLE', 'y')}, {s6('1.5::DOUBLE*z+0.3::DOUBLE', 'z')} FROM v_splat", "v_splat")
def sim3_apply(spark, d):
    return SIM.apply(splats(spark, d)).select("splat_id", *[r6(c, c) for c in "xyz"])


@query(f"SELECT splat_id, {s6('r', 'qw')}, {s6('-g', 'qx')}, {s6('b', 'qy')}, {s6('-opacity', 'qz')} FROM v_splat", "v_splat")
def mirror_quaternion(spark, d):
    q = geometry.mirror_quaternion(tuple(F.col(c) for c in ("r", "g", "b", "opacity")))
    return splats(spark, d).select("splat_id", *[r6(v, n) for v, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)])


_NA, _NB = "greatest(sqrt(x*x+y*y+z*z),1e-9::DOUBLE)", "greatest(sqrt(r*r+g*g+b*b),1e-9::DOUBLE)"


@query(f"SELECT splat_id, {s6(f'acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (x*r+y*g+z*b)/({_NA}*{_NB}))))', 'angle')} FROM v_splat", "v_splat")
def angle_between(spark, d):
    return splats(spark, d).select("splat_id", r6(geometry.angle_between(tuple(map(F.col, "xyz")), tuple(map(F.col, "rgb"))), "angle"))


@query(f"SELECT splat_id, {s6('ln(greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, opacity))/(1-greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, opacity))))', 'logit')}, {s6(f'(r-0.5::DOUBLE)/{num(geometry.SH_C0)}', 'dc')} FROM v_splat", "v_splat")
def splat_activations(spark, d):
    return splats(spark, d).select("splat_id", r6(geometry.logit(F.col("opacity")), "logit"), r6(geometry.rgb_to_sh_dc(F.col("r")), "dc"))


@query(
    "SELECT count(*) AS n, "
    + ", ".join([s6(f"avg({c})", f"m_s{c}") for c in "xyz"] + [s6(f"avg({c})", f"m_d{a}") for a, c in zip("xyz", "rgb", strict=True)] + [s6(f"covar_pop({p}, {q})", f"c_{a}{b}") for a, p in zip("xyz", "rgb", strict=True) for b, q in zip("xyz", "xyz", strict=True)])
    + ", "
    + s6("var_pop(x)+var_pop(y)+var_pop(z)", "var_s")
    + " FROM v_splat",
    "v_splat",
)
def umeyama_moments(spark, d):
    pairs = splats(spark, d).select(*[F.col(c).alias(f"s{c}") for c in "xyz"], *[F.col(c).alias(f"d{a}") for a, c in zip("xyz", "rgb", strict=True)])
    m = geometry.moments(pairs)
    return m.select("n", *[r6(c, c) for c in m.columns if c != "n"])


@query(
    "SELECT vehicle_id, count(*) AS n, " + ", ".join([s6(f"avg({c})", f"m{c}") for c in "xyz"] + [s6(f"covar_samp({a},{b})", f"c{a}{b}") for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))]) + " FROM v_splat GROUP BY vehicle_id",
    "v_splat",
)
def pca_covariance(spark, d):
    m = canonical.covariance(splats(spark, d), "vehicle_id")
    return m.select("vehicle_id", "n", *[r6(c, c) for c in m.columns[2:]])


_BOX = "SELECT vehicle_id, (min(x)+max(x))/2 AS cx, (min(y)+max(y))/2 AS cy, (min(z)+max(z))/2 AS cz, sqrt((max(x)-min(x))^2+(max(y)-min(y))^2) AS extent, min(z) AS lo_z, max(z) AS hi_z FROM v_splat GROUP BY vehicle_id"


@query("SELECT vehicle_id, " + ", ".join(s6(c, c) for c in ("cx", "cy", "cz", "extent", "lo_z", "hi_z")) + f" FROM ({_BOX})", "v_splat")
def cloud_bounds(spark, d):
    b = geometry.bounds(splats(spark, d), "vehicle_id")
    return b.select("vehicle_id", *[r6(c, c) for c in b.columns[1:]])


@query(
    f"""SELECT vehicle_id, CAST(h*12+a AS INT) AS pose, {s6(f"cx+(extent*1.1::DOUBLE+0.5::DOUBLE)*cos(a*{num(2 * math.pi / 12)})", "ex")}, {s6(f"cy+(extent*1.1::DOUBLE+0.5::DOUBLE)*sin(a*{num(2 * math.pi / 12)})", "ey")},
 {s6("lo_z+0.15::DOUBLE*(hi_z-lo_z) + (0.85::DOUBLE*hi_z-(lo_z+0.15::DOUBLE*(hi_z-lo_z)))*h/2", "ez")} FROM ({_BOX}), (SELECT unnest(generate_series(0,2)) AS h), (SELECT unnest(generate_series(0,11)) AS a)""",
    "v_splat",
)
def candidate_pose_grid(spark, d):
    out = geometry.candidate_poses(geometry.bounds(splats(spark, d), "vehicle_id"), 12, 3)
    return out.select("vehicle_id", "pose", *[r6(c, c) for c in ("ex", "ey", "ez")])


_TAN = math.tan(math.atan(0.5 * FRAME.width / FRAME.fx))


@query(
    f"""WITH m AS (SELECT vehicle_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v_splat GROUP BY vehicle_id),
rad AS (SELECT vehicle_id, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, max(sqrt((x-mx)^2+(y-my)^2+(z-mz)^2)) AS radius FROM v_splat JOIN m USING (vehicle_id) GROUP BY vehicle_id)
SELECT vehicle_id, {s6("radius", "radius")}, {s6(f"mx+0.82::DOUBLE*radius/{num(_TAN)}*1.4::DOUBLE", "ex")}, {s6(f"my-0.52::DOUBLE*radius/{num(_TAN)}*1.4::DOUBLE", "ey")}, {s6("mz+0.55::DOUBLE*radius", "ez")} FROM rad""",
    "v_splat",
)
def bootstrap_pose(spark, d):
    return geometry.bootstrap_pose(splats(spark, d), FRAME, "vehicle_id").select("vehicle_id", *[r6(c, c) for c in ("radius", "ex", "ey", "ez")])


# the low percentile is interpolated as (higher - place) * lower value + (place - lower) * higher value
_BINS = """SELECT vehicle_id, bin, n, centre, CASE WHEN zs[l+1] = zs[h+1] THEN zs[l+1] ELSE (h-place)*zs[l+1] + (place-l)*zs[h+1] END AS floor FROM (
 SELECT *, (n-1)*0.02::DOUBLE AS place, CAST(floor((n-1)*0.02::DOUBLE) AS BIGINT) AS l, CAST(ceil((n-1)*0.02::DOUBLE) AS BIGINT) AS h FROM (
 SELECT vehicle_id, bin, count(*) AS n, list(z ORDER BY z) AS zs, any_value(x0)+(bin+0.5::DOUBLE)*(any_value(x1)-any_value(x0))/20 AS centre FROM (
 SELECT s.*, x0, x1, CAST(least(floor((x-x0)/(x1-x0)*20), 19) AS BIGINT) AS bin FROM v_splat s JOIN (SELECT vehicle_id, min(x) AS x0, max(x) AS x1 FROM v_splat GROUP BY vehicle_id) USING (vehicle_id) WHERE x1 > x0)
 GROUP BY vehicle_id, bin HAVING count(*) >= 20))"""


@query(f"SELECT vehicle_id, bin, n, {s6('floor', 'floor')}, {s6('centre', 'centre')} FROM ({_BINS})", "v_splat")
def ground_bins(spark, d):
    return canonical.ground_bins(splats(spark, d), "vehicle_id").select("vehicle_id", "bin", "n", r6("floor", "floor"), r6("centre", "centre"))


@query(f"SELECT vehicle_id, count(*) AS bins, {s6("CASE WHEN count(*) >= 3 THEN regr_slope(floor, centre) END", "slope")} FROM ({_BINS}) GROUP BY vehicle_id", "v_splat")
def ground_slope(spark, d):
    g = canonical.ground_slope(canonical.ground_bins(splats(spark, d), "vehicle_id"), "vehicle_id")
    return g.select("vehicle_id", "bins", r6("slope", "slope"))


@query(
    f"""WITH m AS (SELECT vehicle_id, avg(x) AS mx, avg(y) AS my, min(z) AS z0, 2.0::DOUBLE/greatest(max(x)-min(x),1e-6::DOUBLE) AS f FROM v_splat GROUP BY vehicle_id)
SELECT splat_id, {s6("(x-mx)*f", "x")}, {s6("(y-my)*f", "y")}, {s6("(z-z0)*f", "z")}, {s6("f", "factor")} FROM v_splat JOIN m USING (vehicle_id)""",
    "v_splat",
)
def normalize_canonical(spark, d):
    return canonical.normalize(splats(spark, d), "vehicle_id").select("splat_id", *[r6(c, c) for c in ("x", "y", "z", "factor")])


# ---- rendering and pixels


def _zbuffer_sql(p: geometry.Pose = P0) -> str:
    return f"""SELECT vehicle_id, px, py, min(row(depth, splat_id, r, g, b)) AS m FROM (
 SELECT *, unnest(generate_series(CAST(greatest(iv-reach,0) AS BIGINT), CAST(least(iv+reach,{FRAME.height - 1}) AS BIGINT))) AS py FROM (
 SELECT *, unnest(generate_series(CAST(greatest(iu-reach,0) AS BIGINT), CAST(least(iu+reach,{FRAME.width - 1}) AS BIGINT))) AS px FROM (
 SELECT *, greatest(ceil(radius),1) AS reach, round_even(u,0) AS iu, round_even(v,0) AS iv FROM (
 SELECT *, greatest({num(0.6)}, least({num(12.0)}, {num(FRAME.fx)}*scale/greatest(depth,1e-6::DOUBLE))) AS radius FROM ({_projected_sql(p)}) WHERE depth > 1e-6::DOUBLE AND opacity > 0.05::DOUBLE)
 WHERE u >= -radius AND u < {FRAME.width}+radius AND v >= -radius AND v < {FRAME.height}+radius)))
 WHERE (px-u)^2+(py-v)^2 <= radius*radius GROUP BY vehicle_id, px, py"""


def _image_sql() -> str:
    return f"SELECT vehicle_id, px, py, m[1] AS depth, m[2] AS splat_id, m[3] AS r, m[4] AS g, m[5] AS b FROM ({_zbuffer_sql()})"


#: A photo that needs no table: channels by place, so that both engines know it.
_PHOTO = {"o_r": "px*7+py*13+vehicle_id", "o_g": "px*11+py*5+vehicle_id*3", "o_b": "px*3+py*17+vehicle_id*7"}


def photo_of(image: DataFrame) -> DataFrame:
    return image.withColumns({k: F.expr(f"CAST(({e}) % 256 AS DOUBLE)/255") for k, e in _PHOTO.items()})


_PAIRS_SQL = f"SELECT *, {', '.join(f'CAST(({e}) % 256 AS DOUBLE)/255 AS {k}' for k, e in _PHOTO.items())} FROM ({_image_sql()})"


def image_of(spark, d) -> DataFrame:
    return render.zbuffer(splats(spark, d), P0, FRAME, "vehicle_id")


def pairs_of(spark, d) -> DataFrame:
    return photo_of(image_of(spark, d))


@query(f"SELECT vehicle_id, CAST(px AS INT) AS px, CAST(py AS INT) AS py, splat_id, {s6('depth', 'depth')} FROM ({_image_sql()})", "v_splat")
def zbuffer_render(spark, d):
    return image_of(spark, d).select("vehicle_id", "px", "py", "splat_id", r6("depth", "depth"))


_SEEN = " UNION ALL ".join(f"SELECT DISTINCT {i} AS pose, vehicle_id, m[2] AS splat_id FROM ({_zbuffer_sql(p)})" for i, p in enumerate(POSES))


@query(f"SELECT vehicle_id, count(DISTINCT splat_id) AS visible FROM ({_SEEN}) GROUP BY vehicle_id", "v_splat")
def visible_splats(spark, d):
    return render.seen_by(splats(spark, d), POSES, FRAME, "vehicle_id").groupBy("vehicle_id").agg(F.count_distinct("splat_id").alias("visible"))


@query(f"WITH n AS (SELECT splat_id, count(*) AS seen FROM ({_SEEN}) GROUP BY splat_id) SELECT vehicle_id, s.splat_id, coalesce(seen, 0) AS seen FROM v_splat s LEFT JOIN n USING (splat_id)", "v_splat")
def visibility_counts(spark, d):
    return render.visibility_counts(splats(spark, d), POSES, FRAME, "vehicle_id")


@query(f"SELECT vehicle_id, count(*) AS pixels, count(DISTINCT i.splat_id) AS splats FROM ({_image_sql()}) i JOIN (SELECT splat_id FROM v_splat WHERE provenance = 1 AND confidence >= 0.75::DOUBLE) t USING (splat_id) GROUP BY vehicle_id", "v_splat")
def trusted_pixels(spark, d):
    return fusion.trusted(image_of(spark, d), splats(spark, d)).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("splat_id").alias("splats"))


@query(f"SELECT splat_id, {s6('avg(o_r)', 't_r')}, {s6('avg(o_g)', 't_g')}, {s6('avg(o_b)', 't_b')} FROM ({_PAIRS_SQL}) GROUP BY splat_id", "v_splat")
def mean_observed_color(spark, d):
    return fusion.mean_colour(pairs_of(spark, d)).select("splat_id", *[r6(f"t_{c}", f"t_{c}") for c in "rgb"])


_OFFSETS = "(VALUES " + ", ".join(f"({a},{b})" for a, b in pixels.ellipse(3)) + ") AS o(dx,dy)"
_CORE = f"SELECT * FROM ({_PAIRS_SQL}) WHERE (abs(o_r-r)+abs(o_g-g)+abs(o_b-b))/3 > 0.45::DOUBLE"
_RING = f"SELECT DISTINCT vehicle_id, px+dx AS px, py+dy AS py FROM ({_CORE}), {_OFFSETS} WHERE px+dx BETWEEN 0 AND {FRAME.width - 1} AND py+dy BETWEEN 0 AND {FRAME.height - 1}"


def core_of(spark, d) -> DataFrame:
    diff = (F.abs(F.col("o_r") - F.col("r")) + F.abs(F.col("o_g") - F.col("g")) + F.abs(F.col("o_b") - F.col("b"))) / 3
    return pairs_of(spark, d).filter(diff > 0.45)


@query(f"SELECT vehicle_id, CAST(px AS INT) AS px, CAST(py AS INT) AS py FROM ({_RING})", "v_splat")
def dilate_ring(spark, d):
    return pixels.dilate(core_of(spark, d), 3, FRAME.width, FRAME.height, "vehicle_id")


@query(
    f"""WITH pairs AS MATERIALIZED ({_PAIRS_SQL}), img AS (SELECT *, (abs(o_r-r)+abs(o_g-g)+abs(o_b-b))/3 AS residual FROM pairs),
ring AS (SELECT DISTINCT vehicle_id, px+dx AS px, py+dy AS py FROM img, {_OFFSETS} WHERE residual > 0.45::DOUBLE AND px+dx BETWEEN 0 AND {FRAME.width - 1} AND py+dy BETWEEN 0 AND {FRAME.height - 1})
SELECT i.vehicle_id, count(DISTINCT i.splat_id) FILTER (r.px IS NOT NULL) AS disputed, count(DISTINCT i.splat_id) FILTER (r.px IS NULL) AS agreeing
FROM img i LEFT JOIN ring r ON i.vehicle_id = r.vehicle_id AND i.px = r.px AND i.py = r.py GROUP BY i.vehicle_id""",
    "v_splat",
)
def partition_visible(spark, d):
    pairs = pairs_of(spark, d)
    image = pairs.withColumn("residual", (F.abs(F.col("o_r") - F.col("r")) + F.abs(F.col("o_g") - F.col("g")) + F.abs(F.col("o_b") - F.col("b"))) / 3)
    disputed, agreeing = fusion.partition_visible(image, FRAME.width, FRAME.height, fusion.FusionConfig(residual=0.45), "vehicle_id")
    both = disputed.select("vehicle_id", F.col("splat_id").alias("d")).unionByName(agreeing.select("vehicle_id", F.col("splat_id").alias("a")), allowMissingColumns=True)
    return both.groupBy("vehicle_id").agg(F.count_distinct("d").alias("disputed"), F.count_distinct("a").alias("agreeing"))


def _fit_sql() -> str:
    q = ", ".join(f"quantile_cont({s}, {p}) AS {s}{k}" for s in ("o_r", "o_g", "o_b", "r", "g", "b") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
    out = []
    for c in "rgb":
        gain = f"CASE WHEN o_{c}3-o_{c}1 < 1e-3::DOUBLE OR {c}3-{c}1 < 1e-3::DOUBLE THEN 1.0::DOUBLE ELSE greatest({num(1 / 3)}, least(3.0::DOUBLE, ({c}3-{c}1)/(o_{c}3-o_{c}1))) END"
        out += [s6(f"CASE WHEN n < 64 THEN 1.0::DOUBLE ELSE {gain} END", f"gain_{c}"), s6(f"CASE WHEN n < 64 THEN 0.0::DOUBLE ELSE {c}2 - ({gain})*o_{c}2 END", f"bias_{c}")]
    return f"SELECT vehicle_id, n, {', '.join(out)} FROM (SELECT vehicle_id, count(*) AS n, {q} FROM ({_PAIRS_SQL}) GROUP BY vehicle_id)"


@query(_fit_sql(), "v_splat")
def exposure_fit(spark, d):
    fit = pixels.exposure_fit(pairs_of(spark, d).withColumnsRenamed({c: f"f_{c}" for c in "rgb"}), "vehicle_id", least=64)
    return fit.select("vehicle_id", "n", *[r6(c, c) for c in fit.columns[2:]])


_REACH = "(VALUES " + ", ".join(f"({a},{b})" for a, b in pixels.ellipse(2)) + ") AS o(dx,dy)"


@query(f"SELECT vehicle_id, CAST(px+dx AS INT) AS px, CAST(py+dy AS INT) AS py, {s6('min(depth)', 'depth')} FROM ({_image_sql()}), {_REACH} GROUP BY vehicle_id, px+dx, py+dy", "v_splat")
def min_depth_context(spark, d):
    return pixels.nearest_depth(image_of(spark, d), 2, "vehicle_id").select("vehicle_id", "px", "py", r6("depth", "depth"))


_REACH8 = "(VALUES " + ", ".join(f"({a},{b})" for a, b in pixels.ellipse(8)) + ") AS o(dx,dy)"


@query(
    f"""WITH img AS MATERIALIZED ({_image_sql()}),
grid AS (SELECT vehicle_id, px, py FROM (SELECT DISTINCT vehicle_id FROM img), (SELECT unnest(generate_series(0,{FRAME.width - 1},6)) AS px), (SELECT unnest(generate_series(0,{FRAME.height - 1},6)) AS py)),
free AS (SELECT g.* FROM grid g ANTI JOIN img i ON g.vehicle_id=i.vehicle_id AND g.px=i.px AND g.py=i.py),
around AS (SELECT vehicle_id, px, py, px+dx AS nx, py+dy AS ny FROM free, {_REACH8})
SELECT a.vehicle_id, CAST(a.px AS INT) AS px, CAST(a.py AS INT) AS py, {s6("min(i.depth)", "depth")} FROM around a JOIN img i ON a.vehicle_id=i.vehicle_id AND a.nx=i.px AND a.ny=i.py GROUP BY a.vehicle_id, a.px, a.py""",
    "v_splat",
)
def densify_spawn(spark, d):
    img = image_of(spark, d)
    grid = img.select("vehicle_id").distinct().withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(FRAME.width - 1), F.lit(6)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(FRAME.height - 1), F.lit(6))))
    return fusion.spawn(grid, img, fusion.FusionConfig(), None, "vehicle_id").select("vehicle_id", "px", "py", r6("depth", "depth"))


@query(f"SELECT vehicle_id, {s6('mse', 'mse')}, {s6('CASE WHEN mse < 1e-10 THEN 99.0::DOUBLE ELSE 10*log10(1/mse) END', 'psnr')} FROM (SELECT vehicle_id, avg(((o_r-r)^2+(o_g-g)^2+(o_b-b)^2)/3) AS mse FROM ({_PAIRS_SQL}) GROUP BY vehicle_id)", "v_splat")
def psnr(spark, d):
    out = pixels.psnr(pairs_of(spark, d).withColumnsRenamed({c: f"f_{c}" for c in "rgb"}), "vehicle_id")
    return out.select("vehicle_id", r6("mse", "mse"), r6("psnr", "psnr"))


@query("SELECT vehicle_id, count(*) FILTER (least(r,g,b) >= 0.3::DOUBLE) AS background, count(*) AS n FROM v_splat GROUP BY vehicle_id", "v_splat")
def background_mask(spark, d):
    return splats(spark, d).groupBy("vehicle_id").agg(F.count_if(pixels.is_background(0.3)).alias("background"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH h AS (SELECT vehicle_id, greatest(r,g,b) AS hi, least(r,g,b) AS lo, r, g, b FROM v_splat),
c AS (SELECT vehicle_id, hi, hi-lo AS dd, CASE WHEN hi=lo THEN 0.0::DOUBLE WHEN hi=r THEN (g-b)/(hi-lo) WHEN hi=g THEN 2+(b-r)/(hi-lo) ELSE 4+(r-g)/(hi-lo) END * 30 AS hue FROM h),
k AS (SELECT vehicle_id, CAST(least(floor((CASE WHEN hue<0 THEN hue+180 ELSE hue END)/7.5::DOUBLE), 23) AS BIGINT) AS h, CAST(least(floor((CASE WHEN hi=0 THEN 0.0::DOUBLE ELSE dd/hi*255 END)/32.0::DOUBLE), 7) AS BIGINT) AS s FROM c)
SELECT vehicle_id, h, s, {s6("count(*)/CAST(sum(count(*)) OVER (PARTITION BY vehicle_id) AS DOUBLE)", "share")} FROM k GROUP BY vehicle_id, h, s""",
    "v_splat",
)
def hsv_histogram(spark, d):
    return pixels.histogram(splats(spark, d), "vehicle_id").withColumn("share", r6("share", "share"))


@query(
    """WITH s AS (SELECT vehicle_id, splat_id AS source_id, x AS sx, -y AS sy, z AS sz FROM v_splat WHERE provenance = 1),
n AS (SELECT s.source_id, min(row(sqrt((t.x-sx)^2+(t.y-sy)^2+(t.z-sz)^2), t.splat_id)) AS m FROM s JOIN v_splat t ON s.vehicle_id=t.vehicle_id WHERE sqrt((t.x-sx)^2+(t.y-sy)^2+(t.z-sz)^2) <= 0.05::DOUBLE GROUP BY s.source_id)
SELECT n.m[2] AS splat_id, n.source_id, floor(floor(n.m[1] * 1e9 + 0.5::DOUBLE) / 1e9 * 1e6 + 0.5::DOUBLE) / 1e6 + 0.0::DOUBLE AS distance FROM n JOIN v_splat t ON t.splat_id = n.m[2] WHERE t.provenance = 0""",
    "v_splat",
)
def mirror_nearest(spark, d):
    return fusion.mirror_targets(splats(spark, d)).select("splat_id", "source_id", r6("distance", "distance"))


@query(
    f"""WITH e AS (SELECT vehicle_id, min(z) AS z0, max(z) AS z1 FROM v_splat GROUP BY vehicle_id),
o AS (SELECT * FROM (SELECT s.*, CASE WHEN (z-z0)/(z1-z0) >= 0.55::DOUBLE AND (z-z0)/(z1-z0) < 0.9::DOUBLE THEN 0 WHEN (z-z0)/(z1-z0) >= 0.05::DOUBLE AND (z-z0)/(z1-z0) < 0.55::DOUBLE THEN 1 END AS band FROM v_splat s JOIN e USING (vehicle_id) WHERE z1 > z0) WHERE band IS NOT NULL),
big AS (SELECT vehicle_id, band FROM o GROUP BY vehicle_id, band HAVING count(*) >= 13),
nn AS (SELECT a.vehicle_id, a.band, a.splat_id, b.r, b.g, b.b, b.opacity, row_number() OVER (PARTITION BY a.vehicle_id, a.band, a.splat_id ORDER BY (b.x-a.x)^2+(b.y-a.y)^2+(b.z-a.z)^2, b.splat_id) AS rn FROM o a JOIN big USING (vehicle_id, band) JOIN o b ON a.vehicle_id=b.vehicle_id AND a.band=b.band),
md AS (SELECT vehicle_id, band, splat_id, median(r) AS m_r, median(g) AS m_g, median(b) AS m_b, median(opacity) AS m_opacity FROM nn WHERE rn <= 13 GROUP BY vehicle_id, band, splat_id)
SELECT md.vehicle_id, md.band, md.splat_id, {s6("m_r", "m_r")}, {s6("m_g", "m_g")}, {s6("m_b", "m_b")}, {s6("m_opacity", "m_opacity")} FROM md JOIN v_splat s USING (splat_id)
WHERE s.provenance = 0 AND sqrt((s.r-m_r)^2+(s.g-m_g)^2+(s.b-m_b)^2) > 0.15::DOUBLE""",
    "v_splat",
)
def band_knn_median(spark, d):
    out = fusion.band_medians(splats(spark, d))
    return out.select("vehicle_id", "band", "splat_id", *[r6(c, c) for c in out.columns[3:]])


# ---- matching

_BITS = "list_sum(list_transform(generate_series(1,32), lambda i: CASE WHEN embedding[i+{0}] > 0 THEN 1::BIGINT << CAST(i-1 AS INT) ELSE 0 END))"


def _descriptors(spark, d) -> DataFrame:
    # the signs of all 64 components, in two halves, so that no bit is a sign of the number itself
    half = lambda at: F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0).cast("long"), lambda a, i: a + F.when(F.element_at("embedding", i + at) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long")))
    return view(spark, d, "v_embedding").select("vehicle_id", F.col("observation_id").alias("id"), F.array(half(0), half(32)).alias("descriptor"))


def _frames(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each label's vectors are a frame's descriptors; frame 2 k meets frame 2 k + 1."""
    desc = _descriptors(spark, d).withColumn("pair", F.floor(F.col("vehicle_id") / 2))
    return desc.filter("vehicle_id % 2 = 0"), desc.filter("vehicle_id % 2 = 1")


def _ratio_sql(left: int) -> str:
    return f"""SELECT pair, a, b, d, 1 - d/greatest(CAST(second AS DOUBLE),1e-6::DOUBLE)*0.95::DOUBLE AS confidence FROM (
 SELECT l.pair, l.id AS a, r.id AS b, (bit_count(xor(l.d0, r.d0)) + bit_count(xor(l.d1, r.d1))) AS d, row_number() OVER w AS rn, lead((bit_count(xor(l.d0, r.d0)) + bit_count(xor(l.d1, r.d1)))) OVER w AS second
 FROM fr l JOIN fr r ON l.pair = r.pair AND l.side = {left} AND r.side = {1 - left} WINDOW w AS (PARTITION BY l.pair, l.id ORDER BY (bit_count(xor(l.d0, r.d0)) + bit_count(xor(l.d1, r.d1))), r.id))
 WHERE rn = 1 AND second IS NOT NULL AND d < 0.95::DOUBLE*second"""


_FR = f"WITH fr AS (SELECT CAST(floor(vehicle_id/2) AS BIGINT) AS pair, vehicle_id%2 AS side, observation_id AS id, CAST({_BITS.format(0)} AS BIGINT) AS d0, CAST({_BITS.format(32)} AS BIGINT) AS d1 FROM v_embedding) "


@query(_FR + f"SELECT pair, a, b, CAST(d AS INT) AS d, {s6('confidence', 'confidence')} FROM ({_ratio_sql(0)})", "v_embedding")
def hamming_ratio_match(spark, d):
    a, b = _frames(spark, d)
    return registration.ratio_matches(a, b, "pair", 0.95).withColumn("confidence", r6("confidence", "confidence"))


@query(_FR + f"SELECT f.pair, f.a, f.b FROM ({_ratio_sql(0)}) f JOIN ({_ratio_sql(1)}) k ON f.pair=k.pair AND f.a=k.b AND f.b=k.a", "v_embedding")
def cross_check(spark, d):
    a, b = _frames(spark, d)
    return registration.cross_checked(registration.ratio_matches(a, b, "pair", 0.95), registration.ratio_matches(b, a, "pair", 0.95), "pair").select("pair", "a", "b")


@query(_FR + f"SELECT pair, a, b FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(confidence, 9) DESC, a, b) AS rn FROM ({_ratio_sql(0)})) WHERE rn <= {MATCH_VEHICLES}", "v_embedding")
def match_topk(spark, d):
    a, b = _frames(spark, d)
    m = registration.ratio_matches(a, b, "pair", 0.95).withColumn("confidence", F.round("confidence", 9))
    return registration.top_k(m, MATCH_VEHICLES, "pair").select("pair", "a", "b")


@query(
    f"""WITH p AS ({_projected_sql(P0)}), q AS (SELECT vehicle_id, splat_id AS query_id, u, v FROM p WHERE provenance = 1), l AS (SELECT vehicle_id, splat_id AS landmark_id, u, v FROM p WHERE provenance = 0)
SELECT vehicle_id, query_id, m[2] AS landmark_id, {s6("m[1]", "distance")} FROM (SELECT q.vehicle_id, query_id, min(row(sqrt((l.u-q.u)^2+(l.v-q.v)^2), landmark_id)) AS m FROM q JOIN l ON q.vehicle_id=l.vehicle_id WHERE sqrt((l.u-q.u)^2+(l.v-q.v)^2) <= 6 GROUP BY q.vehicle_id, query_id)""",
    "v_splat",
)
def landmark_radius_join(spark, d):
    p = geometry.project(splats(spark, d), P0, FRAME)
    q, marks = p.filter("provenance = 1").withColumnRenamed("splat_id", "query_id"), p.filter("provenance = 0").withColumnRenamed("splat_id", "landmark_id")
    return registration.nearest_landmarks(q, marks, 6.0, "vehicle_id").withColumn("distance", r6("distance", "distance"))


_SCORES = "SELECT vehicle_id, CAST(observation_id AS BIGINT) AS pose, CAST((observation_id*37)%360 AS DOUBLE) AS azimuth, round(motion/1000, 9) AS score FROM v_observation"


@query(
    f"""WITH s AS ({_SCORES}), b AS (SELECT vehicle_id, max(row(score, -pose, azimuth)) AS t FROM s GROUP BY vehicle_id)
SELECT s.vehicle_id, -any_value(t[2]) AS pose, any_value(t[1]) AS score, coalesce(any_value(t[1]) - max(s.score) FILTER (abs((((azimuth - t[3] + 180) % 360) + 360) % 360 - 180) >= 60) < 0.05::DOUBLE, false) AS ambiguous FROM s JOIN b USING (vehicle_id) GROUP BY s.vehicle_id""",
    "v_observation",
)
def verifier_ambiguity(spark, d):
    s = view(spark, d, "v_observation").select("vehicle_id", F.col("observation_id").alias("pose"), ((F.col("observation_id") * 37) % 360).cast("double").alias("azimuth"), F.round(F.col("motion") / 1000, 9).alias("score"))
    return registration.ambiguous(s, "vehicle_id")


# ---- identity and the event log

_MEAN = """SELECT vehicle_id, pos, m/sqrt(sum(m*m) OVER (PARTITION BY vehicle_id)) AS v FROM (SELECT vehicle_id, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM v_embedding, (SELECT unnest(generate_series(1,64)) AS pos) GROUP BY vehicle_id, pos)"""


@query(f"SELECT vehicle_id, CAST(pos-1 AS INT) AS pos, {s6('v', 'v')} FROM ({_MEAN})", "v_embedding")
def mean_embedding(spark, d):
    return identity.mean_embedding(view(spark, d, "v_embedding")).select("vehicle_id", F.posexplode("mean").alias("pos", "v")).withColumn("v", r6("v", "v"))


_PAIR = f"SELECT x.vehicle_id AS a, y.vehicle_id AS b, greatest(0, least(1, (sum(x.v*y.v)+1)/2)) AS score FROM ({_MEAN}) x JOIN ({_MEAN}) y ON x.pos=y.pos AND x.vehicle_id < y.vehicle_id GROUP BY 1, 2"


@query(f"SELECT a, b, {s6('score', 'score')} FROM ({_PAIR})", "v_embedding")
def similarity_pairs(spark, d):
    return identity.similar_pairs(identity.mean_embedding(view(spark, d, "v_embedding")), 0.0).withColumn("score", r6("score", "score"))


@query(f"SELECT a, b, {s6('score', 'score')} FROM ({_PAIR}) WHERE score >= 0.55", "v_embedding")
def find_duplicates(spark, d):
    return identity.similar_pairs(identity.mean_embedding(view(spark, d, "v_embedding")), 0.55).withColumn("score", r6("score", "score"))


_NEXT = "SELECT vehicle_id AS a, vehicle_id+1 AS b FROM v_vehicle WHERE vehicle_id % 2 = 1 AND vehicle_id+1 IN (SELECT vehicle_id FROM v_vehicle)"


def _neighbours(spark, d) -> tuple[DataFrame, DataFrame]:
    v = view(spark, d, "v_vehicle")
    p = v.filter("vehicle_id % 2 = 1").select(F.col("vehicle_id").alias("a"), (F.col("vehicle_id") + 1).alias("b"))
    return p.join(v.select(F.col("vehicle_id").alias("b")), "b", "left_semi").select("a", "b"), v


@query(f"SELECT a, b, CASE WHEN y.created_ts < x.created_ts THEN b ELSE a END AS primary_id, CASE WHEN y.created_ts < x.created_ts THEN a ELSE b END AS duplicate_id FROM ({_NEXT}) p JOIN v_vehicle x ON x.vehicle_id=a JOIN v_vehicle y ON y.vehicle_id=b", "v_vehicle")
def pick_primary(spark, d):
    p, v = _neighbours(spark, d)
    return identity.pick_primary(p, v)


@query(
    f"""WITH c AS (SELECT CASE WHEN y.created_ts < x.created_ts THEN b ELSE a END AS primary_id, CASE WHEN y.created_ts < x.created_ts THEN a ELSE b END AS duplicate_id FROM ({_NEXT}) p JOIN v_vehicle x ON x.vehicle_id=a JOIN v_vehicle y ON y.vehicle_id=b)
SELECT primary_id, duplicate_id, CASE WHEN x.alias = y.alias THEN x.alias || '|' || y.name ELSE x.alias || '|' || y.name || '|' || y.alias END AS aliases, greatest(x.updated_ts, y.updated_ts) AS updated_ts FROM c JOIN v_vehicle x ON x.vehicle_id=primary_id JOIN v_vehicle y ON y.vehicle_id=duplicate_id""",
    "v_vehicle",
)
def merge_assets_aliases(spark, d):
    p, v = _neighbours(spark, d)
    out = identity.merge_aliases(identity.pick_primary(p, v).select("primary_id", "duplicate_id"), v.withColumn("aliases", F.array("alias")))
    return out.withColumn("aliases", F.concat_ws("|", "aliases"))


@query("SELECT event_id, vehicle_id, score FROM v_event_log a WHERE kind = 'merge_pending' AND NOT EXISTS (SELECT 1 FROM v_event_log b WHERE b.kind IN ('merge','merge_rejected') AND b.pending_key = a.pending_key AND b.ts > a.ts)", "v_event_log")
def pending_merges(spark, d):
    return identity.pending_merges(view(spark, d, "v_event_log")).select("event_id", "vehicle_id", "score")


@query("SELECT event_id, kind FROM v_event_log ORDER BY ts DESC, event_id DESC LIMIT 50", "v_event_log")
def events_newest(spark, d):
    return identity.newest(view(spark, d, "v_event_log"), 50).select("event_id", "kind")


@query(
    """SELECT e.event_id, CASE WHEN kind <> 'merge_pending' THEN 404 WHEN EXISTS (SELECT 1 FROM v_event_log b WHERE b.kind IN ('merge','merge_rejected') AND b.pending_key = e.pending_key AND b.ts > e.ts) THEN 409 ELSE 200 END AS status FROM v_event_log e""",
    "v_event_log",
)
def event_status(spark, d):
    log = view(spark, d, "v_event_log")
    return identity.event_status(log, log.select("event_id"))


@query("SELECT q.query, min(v.vehicle_id) AS vehicle_id FROM (SELECT DISTINCT lower(alias) AS query FROM v_vehicle UNION SELECT upper(name) FROM v_vehicle UNION SELECT 'nobody') q LEFT JOIN v_vehicle v ON lower(q.query) IN (lower(v.name), lower(v.alias)) GROUP BY q.query", "v_vehicle")
def resolve_name(spark, d):
    v = view(spark, d, "v_vehicle")
    wanted = v.select(F.lower("alias").alias("query")).unionByName(v.select(F.upper("name").alias("query"))).unionByName(spark.sql("SELECT 'nobody' AS query")).distinct()
    return identity.resolve(wanted, v.withColumns({"folder": F.format_string("vehicle-%09d", "vehicle_id"), "aliases": F.array("alias")}))


# ---- names

_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '^\\s+|\\s+$', '', 'g')), '''', '', 'g'), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')"
_RES = ", ".join(f"'{r}'" for r in naming.RESERVED)
_SAFE = f"left(CASE WHEN s = '' THEN 'vehicle' WHEN s IN ({_RES}) THEN 'vehicle-' || s ELSE s END, 64)"


@query(f"SELECT page_id, {_SAFE} AS slug FROM (SELECT page_id, {_SLUG} AS s FROM pages)")
def sanitize_name(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", naming.sanitize(F.col("url")).alias("slug"))


@query(
    f"""WITH a AS (SELECT page_id, {_SAFE} AS t FROM (SELECT page_id, {_SLUG} AS s FROM pages)),
b AS (SELECT page_id, {_SAFE} AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(t, '[0-9]+', '', 'g'), '^[-._]+|[-._]+$', '', 'g') AS s FROM a))
SELECT page_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS folder FROM (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM b)"""
)
def unique_folder(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace(naming.sanitize(F.col("url")), "[0-9]+", "").alias("url"))
    return naming.unique_folders(p, "url", "page_id").select("page_id", "folder")


# ---- sampling and consolidation


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, CAST(value AS DOUBLE) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, event_id, 0.0::DOUBLE AS acc, 0 AS gap, 1 AS n, true AS take, 0.0::DOUBLE AS motion, true AS open FROM o WHERE rn = 1
 UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN f.acc+o.m >= 120 AND f.gap+1 >= 2 THEN 0 ELSE f.acc+o.m END, CASE WHEN f.acc+o.m >= 120 AND f.gap+1 >= 2 THEN 0 ELSE f.gap+1 END,
 f.n + CASE WHEN f.open AND f.acc+o.m >= 120 AND f.gap+1 >= 2 THEN 1 ELSE 0 END, f.open AND f.acc+o.m >= 120 AND f.gap+1 >= 2, f.acc+o.m,
 f.open AND NOT (f.acc+o.m >= 120 AND f.gap+1 >= 2 AND f.n + 1 >= 60) FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id AS vehicle_id, event_id AS observation_id, {s6("motion", "motion")} FROM f WHERE take"""
)
def frame_sampler(spark, d):
    out = sampling.sample_frames(view(spark, d, "v_observation"), "vehicle_id", ["ts", "observation_id"], "motion", threshold=120.0)
    return out.select("vehicle_id", "observation_id", r6("motion", "motion"))


@query(
    """SELECT observation_id, vehicle_id, n > 1 AND rn <= least(greatest(1, n // 5), n - 1) AS held_out FROM (SELECT observation_id, vehicle_id, count(*) OVER (PARTITION BY vehicle_id) AS n, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, observation_id DESC) AS rn FROM v_observation)""",
    "v_observation",
)
def holdout_split(spark, d):
    return sampling.split_holdout(view(spark, d, "v_observation"), "vehicle_id", ["ts", "observation_id"]).select("observation_id", "vehicle_id", "held_out")


@query("SELECT it, CAST((it*4 + i) % 25 AS BIGINT) AS frame FROM (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS it FROM nation), (SELECT unnest(generate_series(0,3)) AS i)")
def round_robin_batches(spark, d):
    return sampling.round_robin(25, 4, spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("it")).distinct())


@query("SELECT CAST(n_nationkey AS BIGINT) AS it, CAST(least(CAST(trunc(CAST(n_nationkey AS DOUBLE)/25*4) AS INT), 3) AS INT) AS degree FROM nation")
def sh_schedule(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("it")).withColumn("degree", sampling.sh_degree(F.col("it"), 25))


@query(f"WITH n AS (SELECT splat_id, count(*) AS seen FROM ({_SEEN}) GROUP BY splat_id) SELECT splat_id, CASE WHEN coalesce(seen,0) >= 2 AND provenance = 0 THEN 1 ELSE provenance END AS provenance, coalesce(seen,0) >= 2 AND provenance = 0 AS promoted FROM v_splat LEFT JOIN n USING (splat_id)", "v_splat")
def promote_provenance(spark, d):
    s = splats(spark, d)
    return consolidate.promote(s, render.visibility_counts(s, POSES, FRAME, "vehicle_id").select("splat_id", "seen")).select("splat_id", "provenance", "promoted")


@query("SELECT vehicle_id, frames >= 24 AND frames > frames // 2 * 2 AS due, CASE WHEN frames // 2 * 2 > 0 THEN 'ready' ELSE 'none' END AS state FROM v_vehicle", "v_vehicle")
def autoconsolidate_gate(spark, d):
    v = view(spark, d, "v_vehicle").withColumns({"consolidated": F.expr("frames div 2 * 2"), "running": F.lit(False)})
    return v.select("vehicle_id", consolidate.due(F.col("frames"), F.col("consolidated")).alias("due"), consolidate.ui_state(F.col("running"), F.col("consolidated")).alias("state"))


# ---- export columns


@query(f"SELECT splat_id, {s6('opacity*scale*scale*scale', 'significance')}, CAST(row_number() OVER (ORDER BY opacity*scale*scale*scale DESC, splat_id) AS BIGINT) AS ord FROM v_splat", "v_splat")
def splat_significance_order(spark, d):
    """The order of the compact file, for all splats."""
    return export.significance_order(splats(spark, d)).select("splat_id", r6("significance", "significance"), "ord")


_OP = "greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, opacity))"


@query(f"SELECT splat_id, {s6(f'ln({_OP}/(1-{_OP}))', 'opacity')}, {s6('ln(greatest(scale,1e-9::DOUBLE))', 'scale_0')}, " + ", ".join(s6(f"({c}-0.5::DOUBLE)/{num(geometry.SH_C0)}", f"f_dc_{i}") for i, c in enumerate("rgb")) + " FROM v_splat", "v_splat")
def ply_columns(spark, d):
    out = export.ply_columns(splats(spark, d))
    return out.select("splat_id", *[r6(c, c) for c in ("opacity", "scale_0", "f_dc_0", "f_dc_1", "f_dc_2")])


@query("SELECT splat_id, " + ", ".join(s6(f"CASE WHEN provenance=1 THEN {num(a)} ELSE {num(b)} END * (0.35::DOUBLE+0.65::DOUBLE*greatest(0,least(1,confidence)))", c) for c, a, b in (("r", 0.25, 0.95), ("g", 0.80, 0.35), ("b", 0.40, 0.25))) + " FROM v_splat", "v_splat")
def provenance_tint(spark, d):
    return export.provenance_tint(splats(spark, d)).select("splat_id", *[r6(c, c) for c in "rgb"])
