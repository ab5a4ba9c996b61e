import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ombrix.operators import consolidate, geometry, lifecycle, mesh, prior, render, tracking, views


def test_splats_lie_flat_on_the_mesh(spark):
    vertices, faces = prior.sedan(spark)
    s = mesh.mesh_to_splats(vertices, faces, 600).toPandas()
    assert len(s) == 600 and s.splat_id.nunique() == 600 and (s.provenance == 0).all() and (s.confidence == 0.15).all()
    assert np.allclose(s.sz, 0.1 * s.sx) and (s.sx == s.sy).all() and s.sx.nunique() == 1
    q = s[["qw", "qx", "qy", "qz"]].to_numpy()
    assert np.allclose((q**2).sum(1), 1)
    w, x, y, z = q.T
    normal = np.stack([2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)], 1)
    at = {r.id: np.array([r.x, r.y, r.z]) for r in vertices.collect()}
    tri = np.array([[at[r.i], at[r.j], at[r.k]] for r in faces.collect()])
    n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    area = np.linalg.norm(n, axis=1) / 2
    n /= 2 * area[:, None]
    assert np.allclose(s.sx, 1.6 * math.sqrt(area.sum() / 600 / math.pi))
    p = s[["x", "y", "z"]].to_numpy()
    off = np.abs(((p[:, None] - tri[None, :, 0]) * n[None]).sum(2))
    facing = (normal[:, None] * n[None]).sum(2)
    assert ((off < 1e-9) & (facing > 1 - 1e-6)).any(1).all()
    with pytest.raises(ValueError, match="area"):
        mesh.mesh_to_splats(vertices.withColumns({c: F.lit(0.0) for c in "xyz"}), faces, 10)


def test_textured_mesh(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 1.0, 0.0, 0.0, 1.0)], "id int, x double, y double, z double, u double, v double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "id int, i int, j int, k int")
    texels = spark.createDataFrame([(x, y, x / 4, (3 - y) / 3, 0.5) for x in range(5) for y in range(4)], "tx int, ty int, r double, g double, b double")
    s = mesh.mesh_to_splats(vertices, faces, 50, texels=texels, texture_size=(5, 4)).toPandas()
    assert np.allclose(s.r, s.x) and np.allclose(s.g, s.y) and np.allclose(s.b, 0.5)


def test_prior_look(spark):
    base = spark.range(4000).withColumnRenamed("id", "splat_id").withColumns({c: F.lit(0.1) for c in "rgb"})
    got = mesh.prior_look(base, (0.5, 0.5, 0.5)).agg(F.avg("r"), F.stddev("r"), F.corr("r", "g")).first()
    assert abs(got[0] - 0.5) < 0.002 and abs(got[1] - 0.02) < 0.002 and abs(got[2]) < 0.06
    assert mesh.prior_look(base).exceptAll(mesh.prior_look(base.repartition(3))).count() == 0


def test_poses_come_into_the_canonical_frame(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(20, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    other = (points - [1, 2, 3]) @ turn / 2.5  # x = 2.5 turn o + (1, 2, 3)
    source = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(other)], "i int, x double, y double, z double")
    target = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points[:15])], "i int, x double, y double, z double")
    want = geometry.Pose.look_at((3.0, 1.0, 1.0), (0.0, 0.0, 0.5))
    r, t = np.array(want.r).reshape(3, 3), np.array(want.t)
    old_r = r @ turn
    old = geometry.Pose(tuple(old_r.ravel()), tuple(-old_r @ (turn.T @ (-r.T @ t - [1, 2, 3]) / 2.5)))
    pairs = geometry.paired(source, target, "i")
    assert pairs.count() == 15
    got = geometry.align_poses([old], pairs)[0]
    assert np.allclose(got.r, want.r) and np.allclose(got.t, want.t)
    with pytest.raises(ValueError, match="three"):
        geometry.align_poses([old], pairs.limit(2))


def test_refinement_replaces_equals(spark):
    coarse = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.7), (2, 0, 0.9)], "k int, pose int, score double")
    fine = spark.createDataFrame([(1, 10, 0.7), (1, 11, 0.6)], "k int, pose int, score double")
    assert sorted(map(tuple, tracking.refine(coarse, fine, "k").collect())) == [(1, 10, 0.7), (2, 0, 0.9)]
    assert sorted(map(tuple, tracking.refine(coarse, fine.filter("pose = 11"), "k").collect())) == [(1, 1, 0.7), (2, 0, 0.9)]


def test_equal_frames_have_no_loss_and_no_motion(spark):
    rng = np.random.default_rng(3)
    rows = [(1, x, y, *map(float, rng.uniform(size=3))) for x in range(64) for y in range(32)]
    image = spark.createDataFrame(rows, "k int, px int, py int, r double, g double, b double")
    both = image.withColumns({**{f"o_{c}": F.col(c) for c in "rgb"}, "weight": F.lit(1.0)})
    r = views.weighted_l1_dssim(both, "k").first()
    assert r.l1 == 0 and abs(r.ssim - 1) < 1e-9 and abs(r.loss) < 1e-9
    grey = views.small_grey(image, 64, 32, "k")
    assert views.block_motion(grey, grey, "k").first().motion == 0
    moved = grey.withColumn("sx", F.col("sx") + 2)
    assert abs(views.block_motion(grey, moved, "k").first().motion - 16) < 4


def test_photo_noise_is_the_same_on_every_run(spark):
    image = spark.createDataFrame([(1, x, y, 0.5, 0.5, 0.5) for x in range(40) for y in range(40)], "k int, px int, py int, r double, g double, b double")
    a, b = (views.render_photo(image.repartition(n), 1.0, 0.01, 7) for n in (1, 3))
    assert a.exceptAll(b).count() == 0
    got = a.agg(F.avg("o_r"), F.stddev("o_r")).first()
    assert abs(got[0] - 127) < 1 and 2 < got[1] < 3.2


def test_event_time_may_move_back(spark):
    cloud = spark.createDataFrame([(1, 1, 0.0), (2, 2, 9.0)], "splat_id int, vehicle_id int, last_seen_ts double")
    frames = spark.createDataFrame([(1, 1, 100.0, 5.0), (1, 2, 50.0, 1.0)], "vehicle_id int, n int, base_ts double, frame_ts double")
    assert {r.splat_id: r.last_seen_ts for r in lifecycle.seen_at(cloud, frames, ["n"]).collect()} == {1: 51.0, 2: 9.0}


def test_opacity_reset(spark):
    df = spark.createDataFrame([(0.01,), (0.9,)], "opacity double")
    got = [r[0] for r in df.select(consolidate.reset_opacity().alias("x")).collect()]
    assert got[0] == pytest.approx(math.log(0.01 / 0.99)) and got[1] == pytest.approx(math.log(0.05 / 0.95))


def test_landmarks_keep_every_nth_pixel(spark):
    image = spark.createDataFrame([(1, i % 10, i // 10, i) for i in range(70)], "k int, px int, py int, splat_id int")
    cloud = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(70)], "k int, splat_id int, x double, y double, z double")
    got = tracking.record_landmarks(image, cloud, "k", most=30).toPandas()
    assert sorted(got.x.tolist()) == [float(i) for i in range(0, 70, 2)]
    assert ((got.v * 10 + got.u) == got.x).all()


def test_visible_truth(spark):
    vertices, faces = prior.sedan(spark)
    cloud = mesh.mesh_to_splats(vertices, faces, 400).withColumn("vehicle_id", F.lit(1)).checkpoint()
    seen = render.seen_by(cloud, render.orbit(4), geometry.Intrinsics.simple(128, 96), "vehicle_id").select("splat_id").distinct()
    kept = cloud.join(seen, "splat_id", "left_semi").count()
    assert 100 < kept <= 400
