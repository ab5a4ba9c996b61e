"""More registered queries, on meshes, photos, tracking and the life of assets, beside their DuckDB text."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ombrix.operators import consolidate, fusion, geometry, identity, lifecycle, mesh, pixels, registration, render, tracking, views
from ombrix.plans.bindings import view
from ombrix.plans.catalogue import _CONF, _MEAN, _NEXT, _PAIR, _PAIRS_SQL, FRAME, ORACLE_SQL, P0, POSES, QUERIES, _image_sql, _neighbours, _projected_sql, _zbuffer_sql, image_of, num, pairs_of, query, r6, s6, splats

WIDTH, HEIGHT = FRAME.width, FRAME.height
__all__ = ["ORACLE_SQL", "QUERIES"]


# ---- meshes

_N = "SELECT splat_id, x/s AS n0, y/s AS n1, z/s AS n2 FROM (SELECT *, greatest(sqrt(x*x+y*y+z*z), 1e-9::DOUBLE) AS s FROM v_splat)"
_SIDE = "SELECT *, CASE WHEN abs(n2) >= 0.9::DOUBLE THEN 0.0::DOUBLE ELSE -n1 END AS a0, CASE WHEN abs(n2) >= 0.9::DOUBLE THEN -n2 ELSE n0 END AS a1, CASE WHEN abs(n2) >= 0.9::DOUBLE THEN n1 ELSE 0.0::DOUBLE END AS a2 FROM (" + _N + ")"
_FRAME = "SELECT *, a0/s AS t0, a1/s AS t1, a2/s AS t2 FROM (SELECT *, greatest(sqrt(a0*a0+a1*a1+a2*a2), 1e-12::DOUBLE) AS s FROM (" + _SIDE + "))"


@query(f"SELECT splat_id, {s6('t0', 'ax')}, {s6('t1', 'ay')}, {s6('t2', 'az')}, {s6('n1*t2-n2*t1', 'bx')}, {s6('n2*t0-n0*t2', 'b_y')}, {s6('n0*t1-n1*t0', 'bz')} FROM ({_FRAME})", "v_splat")
def tangent_frames(spark, d):
    size = F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), F.lit(1e-9))
    f = mesh.tangent_frame(tuple(F.col(c) / size for c in "xyz"))
    return splats(spark, d).select("splat_id", *[r6(f[i], n) for i, n in ((0, "ax"), (3, "ay"), (6, "az"), (1, "bx"), (4, "b_y"), (7, "bz"))])


_E1, _E2 = ("(r-x)", "(g-y)", "(b-z)"), ("(y-x)", "(z-y)", "(x-z)")
_CROSS = [f"{_E1[(i + 1) % 3]}*{_E2[(i + 2) % 3]} - {_E1[(i + 2) % 3]}*{_E2[(i + 1) % 3]}" for i in range(3)]


@query(
    f"""WITH c AS (SELECT splat_id, {', '.join(f'{e} AS c{i}' for i, e in enumerate(_CROSS))} FROM v_splat), s AS (SELECT *, sqrt(c0*c0+c1*c1+c2*c2) AS size FROM c)
SELECT splat_id, {', '.join(s6(f'CASE WHEN size <= 1e-12::DOUBLE THEN {1.0 if i == 2 else 0.0}::DOUBLE ELSE c{i}/size END', f'n{i}') for i in range(3))} FROM s""",
    "v_splat",
)
def face_normals(spark, d):
    n = geometry.face_normal(tuple(map(F.col, "xyz")), tuple(map(F.col, "rgb")), tuple(map(F.col, "yzx")))
    return splats(spark, d).select("splat_id", *[r6(v, f"n{i}") for i, v in enumerate(n)])


_TW, _TH = 16, 12
_TEXEL = {"r": "(tx*7 + ty*3) % 11", "g": "(tx*5 + ty*2) % 13", "b": "(tx + ty*9) % 17"}
_TEXTURE = f"SELECT tx, ty, {', '.join(f'CAST({e} AS DOUBLE)/20 AS {c}' for c, e in _TEXEL.items())} FROM (SELECT unnest(generate_series(0,{_TW - 1})) AS tx), (SELECT unnest(generate_series(0,{_TH - 1})) AS ty)"


@query(
    f"""WITH t AS ({_TEXTURE}), p AS (SELECT splat_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x))*{_TW - 1} AS x, (1-greatest(0.0::DOUBLE, least(1.0::DOUBLE, y+0.5::DOUBLE)))*{_TH - 1} AS y FROM v_splat),
q AS (SELECT splat_id, x-floor(x) AS fx, y-floor(y) AS fy, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0, CAST(least(floor(x)+1,{_TW - 1}) AS BIGINT) AS x1, CAST(least(floor(y)+1,{_TH - 1}) AS BIGINT) AS y1 FROM p)
SELECT splat_id, {', '.join(s6(f'a.{c}*(1-fx)*(1-fy) + e.{c}*fx*(1-fy) + f.{c}*(1-fx)*fy + h.{c}*fx*fy', c) for c in 'rgb')} FROM q JOIN t a ON a.tx=x0 AND a.ty=y0 JOIN t e ON e.tx=x1 AND e.ty=y0 JOIN t f ON f.tx=x0 AND f.ty=y1 JOIN t h ON h.tx=x1 AND h.ty=y1""",
    "v_splat",
)
def texture_sample(spark, d):
    """A made texture read at every splat's place."""
    texels = spark.range(_TW * _TH).select((F.col("id") % _TW).alias("tx"), F.expr(f"id div {_TW}").alias("ty")).select("tx", "ty", *[F.expr(f"CAST({e} AS DOUBLE)/20").alias(c) for c, e in _TEXEL.items()])
    points = splats(spark, d).select(F.col("splat_id").alias("point"), F.col("x").alias("u"), (F.col("y") + 0.5).alias("v"))
    return mesh.sample_texture(points, texels, _TW, _TH).select(F.col("point").alias("splat_id"), *[r6(c, c) for c in "rgb"])


@query(f"SELECT splat_id, {s6('x', 'x')}, {s6('z', 'y')}, {s6('-y', 'z')} FROM v_splat", "v_splat")
def viewer_axes(spark, d):
    return mesh.viewer_axes(splats(spark, d)).select("splat_id", *[r6(c, c) for c in "xyz"])


@query(f"SELECT vehicle_id, {', '.join(s6(f'coalesce(greatest(0.05::DOUBLE, least(0.95::DOUBLE, avg({c}) FILTER (opacity > 0.98::DOUBLE))), {num(v)})', f'paint_{c}') for c, v in zip('rgb', (0.55, 0.58, 0.62), strict=True))} FROM v_splat GROUP BY vehicle_id", "v_splat")
def masked_paint(spark, d):
    out = mesh.paint_of(splats(spark, d).withColumn("mask", F.col("opacity") > 0.98), "mask", "vehicle_id")
    return out.select("vehicle_id", *[r6(f"paint_{c}", f"paint_{c}") for c in "rgb"])


# ---- frames


@query(f"SELECT v.vehicle_id, count(*) FILTER (i.px IS NOT NULL) AS hit, count(*) FILTER (i.px IS NULL) AS missed FROM (SELECT * FROM (SELECT DISTINCT vehicle_id FROM v_splat), (SELECT unnest(generate_series(0,{WIDTH - 1})) AS px), (SELECT unnest(generate_series(0,{HEIGHT - 1})) AS py)) v LEFT JOIN ({_image_sql()}) i ON i.vehicle_id=v.vehicle_id AND i.px=v.px AND i.py=v.py GROUP BY v.vehicle_id", "v_splat")
def hit_mask(spark, d):
    hit = views.hit_mask(image_of(spark, d), splats(spark, d).select("vehicle_id"), WIDTH, HEIGHT, "vehicle_id")
    return hit.groupBy("vehicle_id").agg(F.count_if("hit").alias("hit"), F.count_if(~F.col("hit")).alias("missed"))


@query(f"SELECT vehicle_id, CAST(px AS INT) AS px, CAST(py AS INT) AS py, {', '.join(f'CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}*{num(0.7)}))*255) AS INT) AS o_{c}' for c in 'rgb')} FROM ({_image_sql()})", "v_splat")
def dim_photo(spark, d):
    return views.render_photo(image_of(spark, d), 0.7).select("vehicle_id", "px", "py", "o_r", "o_g", "o_b")


def _walk_sql() -> str:
    eye = [f"3.2::DOUBLE*cos({num(2 * math.pi)}*i/12)", f"3.2::DOUBLE*sin({num(2 * math.pi)}*i/12)", "1.25::DOUBLE"]
    return f"SELECT CAST(i AS INT) AS frame, {s6('i/12.0::DOUBLE', 'ts')}, {s6(eye[0], 'ex')}, {s6(eye[1], 'ey')}, {s6(eye[2], 'ez')}, {s6('-1.0::DOUBLE*(' + eye[0] + ')/sqrt(3.2::DOUBLE*3.2::DOUBLE+0.75::DOUBLE*0.75::DOUBLE)', 'fx')}, {s6('-0.75::DOUBLE/sqrt(3.2::DOUBLE*3.2::DOUBLE+0.75::DOUBLE*0.75::DOUBLE)', 'fz')} FROM (SELECT unnest(generate_series(0,11)) AS i)"


@query(_walk_sql())
def walkaround_poses(spark, d):
    """Twelve poses around the object: time, centre, and the viewing direction's x and z, from formulas of their own."""
    rows = [(i, t, *map(float, p.center), float(p.r[6]), float(p.r[8])) for i, t, p in views.walkaround(12)]
    out = spark.createDataFrame(rows, "frame int, ts double, ex double, ey double, ez double, fx double, fz double")
    return out.select("frame", *[r6(c, c) for c in ("ts", "ex", "ey", "ez", "fx", "fz")])


@query(f"SELECT vehicle_id, count(*) FILTER (px BETWEEN 12 AND {WIDTH - 13} AND py BETWEEN 9 AND {HEIGHT - 10}) AS inside, count(*) AS pixels FROM ({_image_sql()}) GROUP BY vehicle_id", "v_splat")
def centre_mask(spark, d):
    return image_of(spark, d).groupBy("vehicle_id").agg(F.count_if(views.centre_mask(WIDTH, HEIGHT)).alias("inside"), F.count(F.lit(1)).alias("pixels"))


def _grey_sql(src: str) -> str:
    return f"SELECT vehicle_id, CAST(floor(px*16/{WIDTH}) AS BIGINT) AS sx, CAST(floor(py*16/{HEIGHT}) AS BIGINT) AS sy, avg({num(0.299)}*r+{num(0.587)}*g+{num(0.114)}*b) AS grey FROM ({src}) GROUP BY 1, 2, 3"


@query(f"SELECT vehicle_id, sx, sy, {s6('grey', 'grey')} FROM ({_grey_sql(_image_sql())})", "v_splat")
def small_grey(spark, d):
    return views.small_grey(image_of(spark, d), WIDTH, HEIGHT, "vehicle_id").select("vehicle_id", "sx", "sy", r6("grey", "grey"))


def _img_sql(pose) -> str:
    return f"SELECT vehicle_id, px, py, m[1] AS depth, m[2] AS splat_id, m[3] AS r, m[4] AS g, m[5] AS b FROM ({_zbuffer_sql(pose)})"


@query(
    f"""WITH a AS MATERIALIZED ({_grey_sql(_img_sql(POSES[0]))}), b AS MATERIALIZED ({_grey_sql(_img_sql(POSES[1]))}),
w AS (SELECT vehicle_id, sx // 4 AS bx, sy // 4 AS bye, count(*) AS whole FROM a GROUP BY 1, 2, 3),
c AS (SELECT a.vehicle_id, a.sx // 4 AS bx, a.sy // 4 AS bye, dx, dy, count(*) AS n, avg(abs(a.grey-b.grey)) AS cost FROM a, (SELECT unnest(generate_series(-3,3)) AS dx), (SELECT unnest(generate_series(-3,3)) AS dy) JOIN b ON b.vehicle_id=a.vehicle_id AND b.sx=a.sx+dx AND b.sy=a.sy+dy GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT c.vehicle_id, c.bx, c.bye, min(row(floor(cost*1e9+0.5::DOUBLE), dx*dx+dy*dy, dx, dy)) AS t FROM c JOIN w ON c.vehicle_id=w.vehicle_id AND c.bx=w.bx AND c.bye=w.bye WHERE n*2 > whole GROUP BY 1, 2, 3)
SELECT vehicle_id, {s6('avg(sqrt(CAST(t[2] AS DOUBLE)))*8', 'motion')} FROM m GROUP BY vehicle_id""",
    "v_splat",
)
def frame_motion(spark, d):
    """Between the renders from the first two poses of a walk around."""
    a, b = (views.small_grey(render.zbuffer(splats(spark, d), p, FRAME, "vehicle_id"), WIDTH, HEIGHT, "vehicle_id") for p in POSES[:2])
    return views.block_motion(a, b, "vehicle_id").select("vehicle_id", r6("motion", "motion"))


def _embed_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, pos, v/sqrt(sum(v*v) OVER (PARTITION BY {keys})) AS v FROM (
 SELECT {keys}, pos, CASE WHEN pos < 192 THEN count(*)/CAST(any_value(n) AS DOUBLE) ELSE sum(val)/{WIDTH * HEIGHT // 16} END AS v FROM (
 SELECT {keys}, hi AS val, n, unnest([least(floor((CASE WHEN hue<0 THEN hue+180 ELSE hue END)/7.5::DOUBLE), 23)*8 + least(floor((CASE WHEN hi=0 THEN 0.0::DOUBLE ELSE dd/hi*255 END)/32.0::DOUBLE), 7), 192 + floor(py*4/{HEIGHT})*4 + floor(px*4/{WIDTH})]) AS pos FROM (
 SELECT {keys}, px, py, greatest(r,g,b) AS hi, greatest(r,g,b)-least(r,g,b) AS dd, count(*) OVER (PARTITION BY {keys}) AS n,
  CASE WHEN greatest(r,g,b)=least(r,g,b) THEN 0.0::DOUBLE WHEN greatest(r,g,b)=r THEN (g-b)/(greatest(r,g,b)-least(r,g,b)) WHEN greatest(r,g,b)=g THEN 2+(b-r)/(greatest(r,g,b)-least(r,g,b)) ELSE 4+(r-g)/(greatest(r,g,b)-least(r,g,b)) END * 30 AS hue FROM ({src}))) GROUP BY {keys}, pos)"""


@query(f"SELECT vehicle_id, CAST(pos AS BIGINT) AS pos, {s6('v', 'v')} FROM ({_embed_sql(_image_sql(), 'vehicle_id')})", "v_splat")
def look_embedding(spark, d):
    return views.embedding(image_of(spark, d), WIDTH, HEIGHT, "vehicle_id").select("vehicle_id", "pos", r6("v", "v"))


_SCENES = " UNION ALL ".join(f"SELECT vehicle_id, {i} AS pose, px, py, splat_id, r, g, b FROM ({_img_sql(p)})" for i, p in enumerate(POSES))


@query(
    f"""WITH seen AS MATERIALIZED (SELECT i.* FROM ({_SCENES}) i JOIN v_splat s ON s.splat_id = i.splat_id WHERE s.provenance = 1),
photo AS (SELECT vehicle_id, px, py, r, g, b FROM seen WHERE pose = 1), n AS (SELECT vehicle_id, pose, count(*) AS observed FROM seen GROUP BY 1, 2),
e AS ({_embed_sql('SELECT * FROM seen', 'vehicle_id, pose')}), f AS ({_embed_sql('SELECT * FROM photo', 'vehicle_id')}),
s AS (SELECT e.vehicle_id, e.pose, floor(sum(e.v*f.v)*1e9+0.5::DOUBLE)/1e9 AS score FROM e JOIN f ON e.vehicle_id=f.vehicle_id AND e.pos=f.pos GROUP BY 1, 2)
SELECT s.vehicle_id, s.pose, observed, {s6('score', 'score')}, CAST(row_number() OVER (PARTITION BY s.vehicle_id ORDER BY score DESC, s.pose) AS INT) AS place FROM s JOIN n ON s.vehicle_id=n.vehicle_id AND s.pose=n.pose WHERE observed >= 60""",
    "v_splat",
)
def verifier_scores(spark, d):
    """Renders of what was observed, from four poses, against one of them as the photo."""
    s, scenes = splats(spark, d), None
    for i, p in enumerate(POSES):
        one = tracking.observed_pixels(render.zbuffer(s, p, FRAME, "vehicle_id"), s).withColumn("pose", F.lit(i))
        scenes = one if scenes is None else scenes.unionByName(one)
    photo = scenes.filter("pose = 1")
    n = scenes.groupBy("vehicle_id", "pose").agg(F.count(F.lit(1)).alias("observed"))
    like = views.likeness(views.embedding(photo, WIDTH, HEIGHT, "vehicle_id"), views.embedding(scenes, WIDTH, HEIGHT, "vehicle_id", "pose"), "vehicle_id", "pose")
    like = like.withColumn("score", F.floor(F.col("score") * 1e9 + 0.5) / 1e9)
    return tracking.pose_scores(like.join(n, ["vehicle_id", "pose"]), "vehicle_id").select("vehicle_id", "pose", "observed", r6("score", "score"), "place")


_KERNEL = "(VALUES " + ", ".join(f"({i - 5}, {num(w)})" for i, w in enumerate(views.window_kernel())) + ")"


def _ssim_sql(c: str) -> str:
    a, b = f"a{c}", f"b{c}"
    return f"((2*{a}*{b}+{num(0.01**2)})*(2*(m{c}-{a}*{b})+{num(0.03**2)}))/(({a}*{a}+{b}*{b}+{num(0.01**2)})*((p{c}-{a}*{a})+(q{c}-{b}*{b})+{num(0.03**2)}))"


_MOMENTS = [f"{n}{c}" for c in "rgb" for n in "abpqm"]


@query(
    f"""WITH src AS MATERIALIZED ({_PAIRS_SQL}), own AS (SELECT vehicle_id, px, py, {', '.join(f'{c} AS a{c}, o_{c} AS b{c}, {c}*{c} AS p{c}, o_{c}*o_{c} AS q{c}, {c}*o_{c} AS m{c}' for c in 'rgb')} FROM src),
h AS (SELECT vehicle_id, px+k.d AS px, py, {', '.join(f'sum({n}*k.w) AS {n}' for n in _MOMENTS)} FROM own, {_KERNEL} AS k(d, w) GROUP BY vehicle_id, px+k.d, py),
v AS (SELECT vehicle_id, px, py+k.d AS py, {', '.join(f'sum({n}*k.w) AS {n}' for n in _MOMENTS)} FROM h, {_KERNEL} AS k(d, w) GROUP BY vehicle_id, px, py+k.d),
t AS (SELECT s.vehicle_id, sum(abs(r-o_r)+abs(g-o_g)+abs(b-o_b))/(count(*)*3) AS l1, sum({_ssim_sql('r')} + {_ssim_sql('g')} + {_ssim_sql('b')})/(count(*)*3) AS ssim FROM src s JOIN v ON s.vehicle_id=v.vehicle_id AND s.px=v.px AND s.py=v.py GROUP BY s.vehicle_id)
SELECT vehicle_id, {s6('l1', 'l1')}, {s6('ssim', 'ssim')}, {s6('0.8::DOUBLE*l1 + 0.2::DOUBLE*(1-ssim)', 'loss')} FROM t""",
    "v_splat",
)
def frame_dssim(spark, d):
    out = views.weighted_l1_dssim(pairs_of(spark, d).withColumn("weight", F.lit(1.0)), "vehicle_id")
    return out.select("vehicle_id", *[r6(c, c) for c in ("l1", "ssim", "loss")])


@query(
    f"""WITH img AS MATERIALIZED (SELECT px, py, max((abs(o_r-r)+abs(o_g-g)+abs(o_b-b))/3) AS residual FROM ({_PAIRS_SQL}) GROUP BY px, py),
ring AS (SELECT DISTINCT px+dx AS px, py+dy AS py FROM img, (VALUES {', '.join(f'({a},{b})' for a, b in pixels.ellipse(3))}) AS o(dx,dy) WHERE residual > 0.65::DOUBLE)
SELECT CAST(img.px AS INT) AS px, CAST(img.py AS INT) AS py, CASE WHEN residual > 0.65::DOUBLE THEN 1.0::DOUBLE WHEN ring.px IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM img LEFT JOIN ring ON img.px=ring.px AND img.py=ring.py""",
    "v_splat",
)
def refine_weights(spark, d):
    """One frame: the largest difference of any object at a pixel."""
    diff = (F.abs(F.col("o_r") - F.col("r")) + F.abs(F.col("o_g") - F.col("g")) + F.abs(F.col("o_b") - F.col("b"))) / 3
    img = pairs_of(spark, d).groupBy("px", "py").agg(F.max(diff).alias("residual"))
    core = img.filter("residual > 0.65")
    return fusion.pixel_weights(img, core, pixels.dilate(core, 3, WIDTH, HEIGHT)).select("px", "py", "weight")


@query(f"SELECT splat_id, {s6('least(ln(greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, opacity))/(1-greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, opacity)))), ln(0.05::DOUBLE/0.95::DOUBLE))', 'logit')} FROM v_splat", "v_splat")
def opacity_reset(spark, d):
    return splats(spark, d).select("splat_id", r6(consolidate.reset_opacity(), "logit"))


# ---- landmarks, registrars, tracking

_MOST = 200


@query(
    f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY py, px) - 1 AS k, count(*) OVER (PARTITION BY vehicle_id) AS n FROM ({_image_sql()}))
SELECT i.vehicle_id, CAST(px AS DOUBLE) AS u, CAST(py AS DOUBLE) AS v, {s6('s.x', 'x')}, {s6('s.y', 'y')}, {s6('s.z', 'z')} FROM i JOIN v_splat s ON s.splat_id = i.splat_id WHERE k % greatest(n // {_MOST}, 1) = 0""",
    "v_splat",
)
def record_landmarks(spark, d):
    s = splats(spark, d)
    return tracking.record_landmarks(image_of(spark, d), s, "vehicle_id", most=_MOST).select("vehicle_id", "u", "v", *[r6(c, c) for c in "xyz"])


@query(
    f"""WITH p AS ({_projected_sql(P0)}), q AS (SELECT vehicle_id, splat_id AS query_id, u, v FROM p WHERE provenance = 1 AND confidence >= 0.5::DOUBLE), l AS (SELECT vehicle_id, splat_id AS landmark_id, u, v, x, y, z FROM p WHERE provenance = 0),
c AS (SELECT q.vehicle_id, query_id, min(row(sqrt((l.u-q.u)*(l.u-q.u)+(l.v-q.v)*(l.v-q.v)), landmark_id)) AS m FROM q JOIN l ON q.vehicle_id=l.vehicle_id WHERE sqrt((l.u-q.u)*(l.u-q.u)+(l.v-q.v)*(l.v-q.v)) <= 6 GROUP BY 1, 2),
t AS (SELECT vehicle_id, count(*) AS total FROM q GROUP BY 1), f AS (SELECT c.vehicle_id, count(*) AS lifted, avg(x) AS mx, avg(z) AS mz FROM c JOIN l ON l.landmark_id = c.m[2] GROUP BY 1)
SELECT t.vehicle_id, total, coalesce(lifted, 0) AS lifted, {s6('mx', 'mx')}, {s6('mz', 'mz')}, CASE WHEN coalesce(lifted, 0) < 80 THEN 'only ' || coalesce(lifted, 0) || ' correspondences' END AS reason FROM t LEFT JOIN f USING (vehicle_id)""",
    "v_splat",
)
def gather_correspondences(spark, d):
    """Observed splats as a stored view's matches, guesses as landmarks: what is lifted, and whether it would do."""
    p = geometry.project(splats(spark, d), P0, FRAME)
    matches = p.filter("provenance = 1 and confidence >= 0.5").select("vehicle_id", F.col("splat_id").alias("query_id"), "u", "v", F.col("u").alias("pu"), F.col("v").alias("pv"))
    lifted, n = tracking.correspondences(matches, p.filter("provenance = 0").withColumnRenamed("splat_id", "landmark_id"), "vehicle_id")
    mean = lifted.groupBy("vehicle_id").agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"))
    reason = tracking.pnp_outcome(F.col("total"), F.col("lifted"), F.lit(True), 80)
    return n.join(mean, "vehicle_id", "left").select("vehicle_id", "total", "lifted", r6("mx", "mx"), r6("mz", "mz"), reason.alias("reason"))


@query(f"SELECT observation_id, CASE WHEN inliers = 0 THEN 'no landmarks' WHEN total_matches < 20 THEN 'only ' || total_matches || ' correspondences' WHEN inliers < 6 THEN 'pose not found' END AS reason, inliers >= 6 AND floor({_CONF}*1e9+0.5::DOUBLE)/1e9 >= 0.35::DOUBLE AS accepted, CASE WHEN inliers < 6 THEN 'no pose' WHEN total_matches % 5 = 0 THEN 'ambiguous' WHEN motion/100 < 0.55::DOUBLE THEN 'too unlike' END AS refused FROM v_observation", "v_observation")
def registration_outcomes(spark, d):
    o = view(spark, d, "v_observation")
    c = F.floor(registration.confidence(F.col("inliers"), F.col("total_matches"), F.col("reproj_error")) * 1e9 + 0.5) / 1e9
    solved = F.col("inliers") >= 6
    return o.select("observation_id", tracking.pnp_outcome(F.col("inliers"), F.col("total_matches"), solved, 20).alias("reason"), tracking.accepted(c, solved).alias("accepted"), tracking.reid_outcome(solved, F.col("total_matches") % 5 == 0, F.col("motion") / 100).alias("refused"))


@query(f"SELECT vehicle_id, count(*) AS pixels, count(DISTINCT i.splat_id) AS splats FROM ({_image_sql()}) i JOIN (SELECT splat_id FROM v_splat WHERE provenance = 1) s USING (splat_id) GROUP BY vehicle_id", "v_splat")
def observed_pixels(spark, d):
    return tracking.observed_pixels(image_of(spark, d), splats(spark, d)).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("splat_id").alias("splats"))


@query(
    """WITH s AS (SELECT splat_id, vehicle_id, provenance, count(*) FILTER (provenance = 1) OVER (PARTITION BY vehicle_id) AS seen,
 row_number() OVER (PARTITION BY vehicle_id, provenance ORDER BY ((splat_id % 1000003) * 7919) % 1000003, splat_id) AS i FROM v_splat) SELECT splat_id, provenance FROM s WHERE provenance = 1 OR i <= 400 - seen""",
    "v_splat",
)
def search_cloud(spark, d):
    return tracking.search_cloud(splats(spark, d), 400, "vehicle_id").select("splat_id", "provenance")


@query(
    """WITH o AS (SELECT vehicle_id, observation_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY observation_id) - 1 AS k, inliers, reproj_error FROM v_observation)
SELECT observation_id, CASE WHEN k < 20 THEN CAST(k % 4 AS INT) END AS pose, CASE WHEN inliers % 7 = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM o""",
    "v_observation",
)
def known_poses(spark, d):
    """A stub that knows four poses and fails after twenty calls; every seventh photo brings its own pose."""
    out = tracking.known_poses(view(spark, d, "v_observation"), "observation_id", 4, 20, "vehicle_id")
    _, sure = tracking.known_or_found(F.when(F.col("inliers") % 7 == 0, F.lit(0)), F.col("pose"), F.lit(0.9))
    return out.select("observation_id", F.col("pose").cast("int").alias("pose"), sure.alias("confidence"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id AS v, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CAST(event_id*37 % 100 AS DOUBLE)/100 AS c, CAST(event_id*61 % 100 AS DOUBLE)/100 AS g FROM events),
f AS (SELECT v, id, rn, 'registered' AS mode, g AS confidence, g >= 0.35::DOUBLE AS accepted, g >= 0.35::DOUBLE AS has, 0 AS since FROM o WHERE rn = 1
 UNION ALL SELECT o.v, o.id, o.rn, CASE WHEN f.has AND f.since < 3 AND o.c >= 0.35::DOUBLE THEN 'chained' ELSE 'registered' END, CASE WHEN f.has AND f.since < 3 AND o.c >= 0.35::DOUBLE THEN o.c ELSE o.g END,
 (f.has AND f.since < 3 AND o.c >= 0.35::DOUBLE) OR o.g >= 0.35::DOUBLE, f.has OR o.g >= 0.35::DOUBLE, CASE WHEN f.has AND f.since < 3 AND o.c >= 0.35::DOUBLE THEN f.since + 1 WHEN o.g >= 0.35::DOUBLE THEN 0 ELSE f.since END
 FROM f JOIN o ON o.v = f.v AND o.rn = f.rn + 1)
SELECT v AS vehicle_id, id AS observation_id, mode, confidence, accepted FROM f"""
)
def video_tracker(spark, d):
    o = view(spark, d, "v_observation").withColumns({"c": (F.col("observation_id") * 37 % 100).cast("double") / 100, "g": (F.col("observation_id") * 61 % 100).cast("double") / 100})
    return tracking.track(o, "vehicle_id", ["ts", "observation_id"], "c", "g", every=3).select("vehicle_id", "observation_id", "mode", "confidence", "accepted")


# ---- the life of assets


@query("SELECT vehicle_id, observation_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY observation_id % 2, CASE WHEN observation_id % 2 = 1 THEN ts END, observation_id) - 1 AS seq FROM v_observation", "v_observation")
def append_observations(spark, d):
    """Half of the observations as history, in order of id; the others follow in order of time."""
    o = view(spark, d, "v_observation").select("vehicle_id", "observation_id", "ts")
    old = o.filter("observation_id % 2 = 0").withColumn("seq", (F.row_number().over(W.partitionBy("vehicle_id").orderBy("observation_id")) - 1).cast("long"))
    return lifecycle.add_observations(old, o.filter("observation_id % 2 = 1")).select("vehicle_id", "observation_id", "seq")


@query("WITH l AS (SELECT vehicle_id, max_by(CAST(total_matches AS DOUBLE) + inliers, observation_id) AS t FROM v_observation GROUP BY 1) SELECT splat_id, coalesce(l.t, CAST(view_count AS DOUBLE)) AS seen FROM v_splat LEFT JOIN l USING (vehicle_id)", "v_splat", "v_observation")
def event_time(spark, d):
    """Times are numbers here, so that a later frame may carry an earlier one."""
    frames = view(spark, d, "v_observation").select("vehicle_id", "observation_id", F.col("total_matches").cast("double").alias("base_ts"), F.col("inliers").cast("double").alias("frame_ts"))
    cloud = splats(spark, d).withColumn("last_seen_ts", F.col("view_count").cast("double"))
    return lifecycle.seen_at(cloud, frames, ["observation_id"]).select("splat_id", F.col("last_seen_ts").alias("seen"))


_AGE = "SELECT vehicle_id, created_ts FROM v_vehicle"
_CAND = f"SELECT a AS folder, b AS other, floor(score*1e6+0.5::DOUBLE)/1e6 AS score FROM ({_PAIR}) WHERE score >= 0.5 UNION ALL SELECT b, a, floor(score*1e6+0.5::DOUBLE)/1e6 FROM ({_PAIR}) WHERE score >= 0.5"
_SCAN = f"""WITH c AS MATERIALIZED ({_CAND}), p AS (SELECT c.*, coalesce(y.created_ts < x.created_ts, false) AS second, row_number() OVER (PARTITION BY folder ORDER BY score DESC, other) AS ord FROM c JOIN ({_AGE}) x ON x.vehicle_id = folder JOIN ({_AGE}) y ON y.vehicle_id = other)
SELECT folder, CAST(ord AS INT) AS ord, CASE WHEN second THEN other ELSE folder END AS primary_id, CASE WHEN second THEN folder ELSE other END AS duplicate_id, score"""


def _candidates(spark, d):
    near = identity.similar_pairs(identity.mean_embedding(view(spark, d, "v_embedding")), 0.5).select("a", "b", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))
    both = near.select(F.col("a").alias("folder"), F.col("b").alias("other"), "score").unionByName(near.select(F.col("b").alias("folder"), F.col("a").alias("other"), "score"))
    return both, view(spark, d, "v_vehicle")


@query(_SCAN + " FROM p", "v_embedding", "v_vehicle")
def scan_flag(spark, d):
    """Every object scanned for its likes; each is proposed."""
    c, v = _candidates(spark, d)
    return lifecycle.scan(c, v, auto=False).select("folder", "ord", "primary_id", "duplicate_id", "score")


@query(_SCAN + " FROM p WHERE ord <= coalesce((SELECT min(ord) FROM p q WHERE q.folder = p.folder AND q.second), 1000000)", "v_embedding", "v_vehicle")
def scan_merge(spark, d):
    """As scan_flag, merging as it goes."""
    c, v = _candidates(spark, d)
    return lifecycle.scan(c, v, auto=True).select("folder", "ord", "primary_id", "duplicate_id", "score")


@query(
    f"""WITH n AS (SELECT vehicle_id, count(*) AS n, count(*) FILTER (provenance = 1) AS o FROM v_splat GROUP BY 1), p AS ({_NEXT})
SELECT a AS primary_id, b AS duplicate_id, coalesce(x.n, 0) AS splats_before, coalesce(x.n, 0) + coalesce(y.o, 0) AS splats_after, '' AS pending_id FROM p LEFT JOIN n x ON x.vehicle_id = a LEFT JOIN n y ON y.vehicle_id = b""",
    "v_splat",
    "v_vehicle",
)
def apply_merges(spark, d):
    p, _ = _neighbours(spark, d)
    out = lifecycle.merge_events(p.select(F.col("a").alias("primary_id"), F.col("b").alias("duplicate_id"), F.lit(1.0).alias("score")), splats(spark, d))
    return out.select("primary_id", "duplicate_id", "splats_before", "splats_after", "pending_id")


@query("SELECT 'merge_rejected' AS kind, vehicle_id AS primary_id, pending_key AS duplicate_id, event_id AS pending_id FROM v_event_log WHERE kind = 'merge_pending'", "v_event_log")
def reject_merges(spark, d):
    return lifecycle.reject_events(view(spark, d, "v_event_log").filter("kind = 'merge_pending'").select(F.col("event_id").alias("pending_id"), F.col("vehicle_id").alias("primary_id"), F.col("pending_key").alias("duplicate_id")))


@query(f"WITH p AS ({_NEXT}) SELECT coalesce(p.a, o.vehicle_id) AS vehicle_id, count(*) AS observations, min(observation_id) AS first, max(observation_id) AS last FROM v_observation o LEFT JOIN p ON p.b = o.vehicle_id GROUP BY 1", "v_observation", "v_vehicle")
def merged_histories(spark, d):
    p, _ = _neighbours(spark, d)
    out = lifecycle.merged_rows(p.select(F.col("a").alias("primary_id"), F.col("b").alias("duplicate_id")), view(spark, d, "v_observation"))
    return out.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("observations"), F.min("observation_id").alias("first"), F.max("observation_id").alias("last"))


@query(
    """SELECT 'v' || vehicle_id AS folder, 'v' || vehicle_id || CASE WHEN vehicle_id % 3 <> 0 THEN '' WHEN vehicle_id % 2 <> 0 THEN '-2' WHEN vehicle_id % 4 <> 0 THEN '-3' ELSE '-4' END AS archive FROM v_vehicle""",
    "v_vehicle",
)
def retire_folders(spark, d):
    """Every third folder was archived before; of those the even ones twice, every fourth thrice, and all have a later number too."""
    v = view(spark, d, "v_vehicle").select("vehicle_id", F.concat(F.lit("v"), F.col("vehicle_id").cast("string")).alias("folder"))
    old = v.filter("vehicle_id % 3 = 0")
    taken = old.select(F.col("folder").alias("archive"))
    for n, rule in ((2, "vehicle_id % 2 = 0"), (3, "vehicle_id % 4 = 0"), (9, "true")):
        taken = taken.unionByName(old.filter(rule).select(F.concat_ws("-", "folder", F.lit(str(n))).alias("archive")))
    return lifecycle.retire(v.select("folder"), taken).select("folder", "archive")


@query("SELECT vehicle_id, name, alias, CAST(frames AS INT) AS frames FROM v_vehicle", "v_vehicle")
def manifest_round_trip(spark, d):
    """Objects written to JSON and read back."""
    v = view(spark, d, "v_vehicle").select(F.col("vehicle_id").cast("string").alias("vehicle_id"), "name", F.array("alias").alias("aliases"), F.lit(1.5).alias("created_ts"), F.lit(2.5).alias("updated_ts"), F.col("frames").cast("int").alias("consolidated_frames"))
    out = lifecycle.to_manifest(v).select(lifecycle.from_manifest(F.col("manifest")).alias("m"))
    return out.select(F.col("m.vehicle_id").cast("long").alias("vehicle_id"), F.col("m.name").alias("name"), F.col("m.aliases")[0].alias("alias"), F.col("m.consolidated_frames").alias("frames"))


@query("""SELECT vehicle_id, '{"dirty":' || d || ',"touched":' || t || CASE WHEN m > 0 THEN ',"mirrored":' || m ELSE '' END || '}' AS report FROM (SELECT vehicle_id, count(*) FILTER (confidence > 0.5::DOUBLE) AS d, count(*) AS t, count(*) FILTER (view_count > 5 AND vehicle_id % 2 = 0) AS m FROM v_splat GROUP BY vehicle_id)""", "v_splat")
def fusion_reports(spark, d):
    n = splats(spark, d).groupBy("vehicle_id").agg(F.count_if(F.col("confidence") > 0.5).alias("d"), F.count(F.lit(1)).alias("t"), F.count_if((F.col("view_count") > 5) & (F.col("vehicle_id") % 2 == 0)).alias("m"))
    return n.select("vehicle_id", lifecycle.report({"dirty": F.col("d"), "touched": F.col("t")}, {"mirrored": F.col("m")}).alias("report"))


@query(
    f"""WITH f AS (SELECT vehicle_id, count(*) AS frames_sampled, count(*) FILTER (inliers >= 6 AND floor({_CONF}*1e9+0.5::DOUBLE)/1e9 >= 0.35::DOUBLE) AS frames_fused FROM v_observation GROUP BY 1), s AS (SELECT vehicle_id, count(*) AS splats, count(*) FILTER (provenance = 1) AS observed FROM v_splat GROUP BY 1)
SELECT f.vehicle_id, frames_sampled, frames_fused, frames_sampled - frames_fused AS frames_rejected, splats, observed FROM f LEFT JOIN s USING (vehicle_id)""",
    "v_observation",
    "v_splat",
)
def ingest_summary(spark, d):
    o = view(spark, d, "v_observation")
    c = F.floor(registration.confidence(F.col("inliers"), F.col("total_matches"), F.col("reproj_error")) * 1e9 + 0.5) / 1e9
    out = lifecycle.ingest_summary(o.withColumn("accepted", tracking.accepted(c, F.col("inliers") >= 6)), splats(spark, d))
    return out.select("vehicle_id", "frames_sampled", "frames_fused", "frames_rejected", "splats", "observed")
