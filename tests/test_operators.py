import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ombrix.functions import naming
from ombrix.operators import canonical, cloud, consolidate, export, fusion, geometry, identity, pixels, prior, registration, render, sampling, spatial
from ombrix.sources import assets

K = geometry.Intrinsics.simple(128, 96)


def points(spark, rows, more=()):
    """rows: (splat_id, x, y, z); the rest by default or by ``more``."""
    df = spark.createDataFrame(rows, "splat_id long, x double, y double, z double")
    return cloud.create(df.withColumn("vehicle_id", F.lit(1).cast("long")), r=F.lit(0.5), g=F.lit(0.5), b=F.lit(0.5), **dict(more))


def random_cloud(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(float, rng.uniform(-1, 1, 3))) for i in range(n)]
    return points(spark, rows, {"provenance": (F.col("splat_id") % 3 == 0).cast("int"), "opacity": (F.col("splat_id") % 20) / 20.0, "confidence": F.lit(0.5)})


def test_empty_cloud_has_a_row_of_zeros(spark):
    r = cloud.stats(points(spark, [])).first()
    assert (r.splats, r.observed, r.prior, r.observed_fraction, r.mean_confidence) == (0, 0, 0, 0.0, 0.0)


def test_updates_are_keyed_and_the_last_wins(spark):
    c = points(spark, [(1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)])
    u = spark.createDataFrame([(1, 0.3, 1), (1, 0.4, 2)], "splat_id long, confidence double, ord int")
    got = {r.splat_id: r.confidence for r in cloud.with_updates(c, u, "ord").collect()}
    assert got == {1: 0.4, 2: 0.1}
    with pytest.raises(ValueError, match="nothing"):
        cloud.with_updates(c, u.select("splat_id", F.lit(1).alias("nothing")))


def test_prune_is_strict_and_merge_takes_observed_only(spark):
    c = points(spark, [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], {"opacity": F.when(F.col("splat_id") == 1, 0.05).otherwise(0.051)})
    assert [r.splat_id for r in cloud.prune(c).collect()] == [2]
    other = random_cloud(spark, 30)
    assert cloud.merge(c, other).count() == 2 + other.filter("provenance = 1").count()


def test_projection_inverts(spark):
    c = random_cloud(spark)
    pose = render.orbit(8)[3]
    back = geometry.unproject(geometry.project(c, pose, K).withColumnsRenamed({"x": "x0", "y": "y0", "z": "z0"}), pose, K)
    far = back.agg(F.max(F.abs(F.col("x") - F.col("x0")) + F.abs(F.col("y") - F.col("y0")) + F.abs(F.col("z") - F.col("z0")))).first()[0]
    assert far < 1e-9
    centre = geometry.Pose.look_at((3, 0, 1), (0, 0, 0))
    assert np.allclose(centre.center, (3, 0, 1))


def test_umeyama_recovers_a_similarity(spark):
    c, s = random_cloud(spark), math.sqrt(0.5)
    sim = geometry.Sim3(1.7, (s, -s, 0.0, s, s, 0.0, 0.0, 0.0, 1.0), (1.0, -2.0, 0.5))
    moved = sim.apply(c).select("splat_id", *[F.col(a).alias(f"d{a}") for a in "xyz"])
    got = geometry.umeyama(c.select("splat_id", *[F.col(a).alias(f"s{a}") for a in "xyz"]).join(moved, "splat_id"))
    assert got.s == pytest.approx(1.7, abs=1e-9) and np.allclose(got.r, sim.r, atol=1e-9) and np.allclose(got.t, sim.t, atol=1e-9)
    one = sim.compose(sim.inverse())
    assert one.s == pytest.approx(1) and np.allclose(one.t, 0)


def test_quaternions_of_rotations(spark):
    for axis, q in (((1, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, 0, 0)), ((1, 0, 0, 0, -1, 0, 0, 0, -1), (0, 1, 0, 0)), ((-1, 0, 0, 0, 1, 0, 0, 0, -1), (0, 0, 1, 0)), ((-1, 0, 0, 0, -1, 0, 0, 0, 1), (0, 0, 0, 1))):
        got = spark.range(1).select(*[c.alias(n) for n, c in zip("wxyz", geometry.matrix_to_quaternion([F.lit(float(v)) for v in axis]), strict=True)]).first()
        assert tuple(map(float, got)) == q


def test_canonical_length_and_ground(spark):
    n = canonical.normalize(random_cloud(spark), "vehicle_id").agg(F.max("x") - F.min("x"), F.min("z")).first()
    assert n[0] == pytest.approx(2.0) and n[1] == 0.0
    tilted = random_cloud(spark, 4000).withColumn("z", F.when(F.col("splat_id") % 4 == 0, 0.1 * F.col("x")).otherwise(1 + F.col("z") / 10))
    flat = canonical.ground_slope(canonical.ground_bins(canonical.level_ground_contact(tilted, "vehicle_id"), "vehicle_id"), "vehicle_id").first().slope
    assert abs(flat) < 0.02
    turned = canonical.canonicalize_orientation(random_cloud(spark).withColumn("y", F.col("y") * 4))
    assert turned.agg(F.var_pop("x") > F.var_pop("y")).first()[0]


def test_zbuffer_equals_a_loop(spark):
    c, pose = random_cloud(spark, 200).withColumn("scale", F.lit(0.05)), render.orbit(4)[1]
    got = {(r.px, r.py): r.splat_id for r in render.zbuffer(c, pose, K).collect()}
    best = {}
    for r in render.visible(c, pose, K).collect():
        reach = max(math.ceil(r.radius), 1)
        cu, cv = round(r.u), round(r.v)
        for px in range(max(0, cu - reach), min(K.width - 1, cu + reach) + 1):
            for py in range(max(0, cv - reach), min(K.height - 1, cv + reach) + 1):
                if (px - r.u) ** 2 + (py - r.v) ** 2 <= r.radius**2:
                    best[px, py] = min(best.get((px, py), (math.inf, 0)), (r.depth, r.splat_id))
    assert got == {k: v[1] for k, v in best.items()}


def test_blur_keeps_a_constant_and_ellipse_is_symmetric(spark):
    img = spark.range(12 * 9).select((F.col("id") % 12).cast("int").alias("px"), F.floor(F.col("id") / 12).cast("int").alias("py"), *[F.lit(0.25).alias(c) for c in "rgb"])
    out = pixels.blur(img, 12, 9)
    assert out.count() == 108 and out.agg(F.max(F.abs(F.col("r") - 0.25))).first()[0] < 1e-12
    for r in (1, 2, 3, 8):
        e = set(pixels.ellipse(r))
        assert e == {(-a, -b) for a, b in e} and (0, r) in e and (r, 0) in e


def test_spatial_joins_equal_brute_force(spark):
    c = random_cloud(spark, 250)
    rows = c.select("splat_id", "x", "y", "z").collect()
    got = {r.source_id: r.splat_id for r in spatial.nearest_within(c.withColumnRenamed("splat_id", "source_id").withColumn("y", -F.col("y")), c, 0.2, ["vehicle_id"], "source_id", "splat_id").collect()}
    want = {}
    for s in rows:
        near = min(((math.dist((s.x, -s.y, s.z), (t.x, t.y, t.z)), t.splat_id) for t in rows))
        if near[0] <= 0.2:
            want[s.splat_id] = near[1]
    assert got == want


class TestFusion:
    def scene(self, spark):
        v, f = prior.sedan(spark)
        s = sampling.sample_surface(prior.corners(v, f), 1500)
        guess = cloud.create(s.select(F.col("point").alias("splat_id"), "x", "y", "z"), r=F.lit(0.7), g=F.lit(0.7), b=F.lit(0.7), scale=F.lit(0.04), confidence=F.lit(0.15)).withColumn("vehicle_id", F.lit(1).cast("long")).checkpoint()
        pose = render.orbit(8)[1]
        truth = render.zbuffer(guess.withColumns({"r": F.lit(0.72), "g": F.lit(0.11), "b": F.lit(0.10)}), pose, K)
        photo = truth.select("px", "py", "r", "g", "b").withColumn("vehicle", F.lit(True))
        return guess, photo, pose

    def test_guesses_are_replaced_whole_and_the_unseen_stays(self, spark):
        guess, photo, pose = self.scene(spark)
        out, report = fusion.fuse_frame(guess, photo, pose, K, 0.9, 1.0, 5.0)
        out = out.checkpoint()
        assert report["accepted"] and report["dirty"] > 50
        seen = render.seen_by(guess, [pose], K).select("splat_id")
        unseen = out.join(seen, "splat_id", "left_anti").filter(F.col("splat_id") <= 1499)
        assert unseen.agg(F.min("r"), F.max("r"), F.max("view_count"), F.max("provenance")).first()[:] == (0.7, 0.7, 0, 0)
        new = out.filter("provenance = 1 and g < 0.3")
        assert new.count() > 50 and new.agg(F.max(F.abs(F.col("r") - 0.72))).first()[0] < 0.3

    def test_gate_and_resistance(self, spark):
        guess, photo, pose = self.scene(spark)
        same, report = fusion.fuse_frame(guess, photo, pose, K, 0.34, 1.0, 5.0)
        assert same is guess and not report["accepted"]
        sure = guess.withColumns({"provenance": F.lit(1), "confidence": F.lit(0.7)}).checkpoint()
        out, report = fusion.fuse_frame(sure, photo, pose, K, 0.35, 0.3, 5.0)
        assert report["accepted"] and report["dirty"] == 0
        assert out.filter(F.col("splat_id") <= 1499).agg(F.min("r"), F.max("r")).first()[:] == (0.7, 0.7)
        assert not fusion.fuse_frame(guess.limit(0), photo, pose, K, 0.9, 1.0, 5.0)[1]["accepted"]

    def test_mirror_and_bands_touch_guesses_only(self, spark):
        c = random_cloud(spark, 400)
        for out in (fusion.mirror_confirmed(c, 0.3), fusion.smooth_material_bands(c)):
            both = out.filter("provenance = 1").select("splat_id", "x", "r").exceptAll(c.filter("provenance = 1").select("splat_id", "x", "r"))
            assert out.count() == 400 and both.count() == 0


def test_sampler_rules(spark):
    rows = [(1, i, i, float(m)) for i, m in enumerate([9, 50, 1, 60, 60, 0, 0, 130, 130, 1])]
    df = spark.createDataFrame(rows, "vehicle_id long, ts long, observation_id long, motion double")
    got = [(r.observation_id, r.motion) for r in sampling.sample_frames(df, "vehicle_id", ["ts", "observation_id"], "motion", 100.0).orderBy("observation_id").collect()]
    assert got == [(0, 0.0), (3, 111.0), (7, 190.0), (9, 131.0)]
    assert [r.observation_id for r in sampling.sample_frames(df, "vehicle_id", ["ts", "observation_id"], "motion", 100.0, most=1).orderBy("observation_id").collect()] == [0, 3]


def test_sampling_as_a_stream_equals_the_batch(spark, tmp_path):
    from ombrix.streaming.sampler import sample_stream

    rng = np.random.default_rng(2)
    rows = [(i % 4, float(i), i, float(rng.uniform(0, 60))) for i in range(240)]
    schema = "vehicle_id long, ts double, observation_id long, motion double"
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = sample_stream(stream, threshold=100.0).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sampling.sample_frames(spark.createDataFrame(rows, schema), "vehicle_id", ["ts", "observation_id"], "motion", 100.0)
    assert sorted(r.observation_id for r in spark.table("kept").collect()) == sorted(r.observation_id for r in batch.collect())


def test_registration_rules(spark):
    tries = spark.createDataFrame([(1, 1, True, 0.2), (1, 2, True, 0.4), (2, 1, False, 0.0), (3, 1, False, 0.3), (3, 2, True, 0.3)], "k int, ord int, has_pose boolean, confidence double")
    got = {r.k: (r.accepted, r.chosen) for r in registration.fallback_pick(tries, "k").collect()}
    assert got == {1: (True, 2), 2: (False, None), 3: (False, 1)}
    rng, k = np.random.default_rng(0), K
    pose = render.orbit(8)[1]
    p3 = rng.uniform(-0.5, 0.5, (40, 3))
    cam = p3 @ np.array(pose.r).reshape(3, 3).T + pose.t
    uv = np.stack([k.fx * cam[:, 0] / cam[:, 2] + k.cx, k.fy * cam[:, 1] / cam[:, 2] + k.cy], 1)
    uv[:6] += rng.uniform(20, 40, (6, 2))
    r, t, inliers, error = registration.solve_pnp(p3, uv, k)
    assert inliers == 34 and error < 1e-6 and np.allclose(-r.T @ t, pose.center, atol=0.05)
    assert registration.solve_pnp(p3[:5], uv[:5], k) is None


def test_similarity_of_degenerate_vectors(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0], 1.0), (2, [1.0, 0.0], [-1.0, 0.0], 0.0), (3, [0.0, 0.0], [1.0, 0.0], 0.0), (4, None, [1.0], 0.0), (5, [], [], 0.0)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, want double")
    assert all(r.s == r.want for r in df.select("want", identity.similarity(F.col("a"), F.col("b")).alias("s")).collect())


@pytest.mark.parametrize(("name", "want"), [("  My Car's #1 ", "my-cars-1"), ("", "vehicle"), (None, "vehicle"), ("...", "vehicle"), ("CON", "vehicle-con"), ("con.txt", "con.txt"), ("x" * 90, "x" * 64), ("a__b.C", "a__b.c")])
def test_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(naming.sanitize(F.col("n"))).first()[0] == want


def test_unique_folders_go_on_after_taken_ones(spark):
    names = spark.createDataFrame([(1, "Car"), (2, "car"), (3, "van")], "i int, n string")
    taken = spark.createDataFrame([("car",), ("car-4",)], "folder string")
    assert {r.i: r.folder for r in naming.unique_folders(names, "n", "i", taken).collect()} == {1: "car-5", 2: "car-6", 3: "van"}


def test_files(spark, tmp_path):
    c = random_cloud(spark, 50)
    paths = export.export_all(c, tmp_path)
    data = (tmp_path / "cloud.ply").read_bytes()
    head, body = data.split(b"end_header\n", 1)
    assert head.count(b"property float") == 17 and len(body) == 50 * 17 * 4
    first = struct.unpack("<17f", body[:68])
    r = c.orderBy("splat_id").first()
    assert first[0] == pytest.approx(r.x, abs=1e-6) and first[6] * geometry.SH_C0 + 0.5 == pytest.approx(0.5, abs=1e-6)
    assert len((tmp_path / "cloud.splat").read_bytes()) == 50 * 32 and set(paths) == {"ply", "splat", "provenance"}
    banded = c.limit(3).withColumn("sh_rest", F.transform(F.sequence(F.lit(1), F.lit(45)), lambda i: i.cast("double")))
    export.write_ply(banded, tmp_path / "sh.ply")
    row = struct.unpack("<62f", (tmp_path / "sh.ply").read_bytes().split(b"end_header\n", 1)[1][:248])
    assert row[9:12] == (1.0, 4.0, 7.0) and row[24] == 2.0


def test_assets(spark, tmp_path):
    c = random_cloud(spark, 20)
    assets.save_cloud(c, str(tmp_path / "clouds"))
    assets.save_cloud(c.withColumn("vehicle_id", F.lit(2)), str(tmp_path / "clouds"))
    assets.save_cloud(c.limit(5), str(tmp_path / "clouds"))
    got = assets.load_cloud(spark, str(tmp_path / "clouds"))
    assert {r.vehicle_id: r["count"] for r in got.groupBy("vehicle_id").count().collect()} == {1: 5, 2: 20} and "sh_rest" in got.columns
    c.drop("opacity").write.parquet(str(tmp_path / "old"))
    with pytest.raises(KeyError, match="opacity"):
        assets.load_cloud(spark, str(tmp_path / "old"))
    (tmp_path / "log.jsonl").write_text('{"event_id":"a","kind":"k","ts":1.0,"data":{"x":"1"}}\n\n{"event_id":"b","kind":"k","ts":0.5}\nbroken\n')
    events = assets.read_events(spark, str(tmp_path / "log.jsonl"))
    assert [r.event_id for r in assets.newest_events(events).collect()] == ["b", "a"]
    assert [r.event_id for r in assets.newest_events(events, 1).collect()] == ["b"]


def test_appended_events_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for i, text in enumerate(["x", "x" * 400, "x" * 50]):
        rows = [(f"e{i}", "k", text, "v", float(-i), {"a": "b"})]
        assets.append_events(spark.createDataFrame(rows, assets.EVENT_SCHEMA), path)
    events = assets.read_events(spark, path)
    assert [r.event_id for r in assets.newest_events(events).collect()] == ["e2", "e1", "e0"]
    assert sorted(r.seq for r in events.collect()) == [0, 1, 2]


def test_sedan_faces_look_outwards(spark):
    v, f = prior.sedan(spark)
    at = {r.id: np.array([r.x, r.y, r.z]) for r in v.collect()}
    vertices, wheels, volume = len(at), 2 + 2 * prior.SEGMENTS, 0.0
    first = vertices - 4 * wheels
    seen = 0
    for r in f.collect():
        a, b, c = at[r.i], at[r.j], at[r.k]
        volume += float(np.dot(a, np.cross(b, c))) / 6
        if r.i < first:
            continue
        seen += 1
        middle = np.array(prior.WHEELS[(r.i - first) // wheels])
        assert np.dot(np.cross(b - a, c - a), (a + b + c) / 3 - middle) > 0
    assert seen == 4 * 4 * prior.SEGMENTS and volume > 0


def test_mirroring_takes_the_whole_look(spark):
    look = "splat_id long, vehicle_id long, x double, y double, z double, qw double, qx double, qy double, qz double, scale double, opacity double, r double, g double, b double, provenance int, confidence double, sh_rest array<float>"
    rows = [(1, 1, 0.5, 0.2, 0.1, 0.1, 0.2, 0.3, 0.4, 0.03, 0.8, 0.1, 0.2, 0.3, 1, 0.9, [1.0]), (2, 1, 0.51, 0.2, 0.1, 0.5, 0.6, 0.7, 0.8, 0.04, 0.7, 0.4, 0.5, 0.6, 1, 0.9, [2.0]), (3, 1, 0.5, -0.19, 0.1, 1.0, 0.0, 0.0, 0.0, 0.01, 0.9, 0.0, 0.0, 0.0, 0, 0.15, [3.0])]
    c = spark.createDataFrame(rows, look)
    got = {r.splat_id: r for r in fusion.mirror_confirmed(c).collect()}
    assert got[3][2:14] == (0.51, -0.2, 0.1, 0.5, -0.6, 0.7, -0.8, 0.04, 0.7, 0.4, 0.5, 0.6) and got[3].sh_rest is None and got[3].provenance == 0 and got[3].confidence == 0.15
    assert got[1].sh_rest == [1.0] and fusion.mirror_count(fusion.mirror_targets(c)).first().mirrored == 2


def test_updates_without_order_are_the_same_on_every_run(spark):
    c = points(spark, [(1, 0.0, 0.0, 0.0)])
    u = spark.createDataFrame([(1, x / 10) for x in range(8)], "splat_id long, confidence double")
    for n in (1, 5):
        assert cloud.with_updates(c, u.repartition(n)).first().confidence == 0.7


def test_holdout_and_promotion(spark):
    frames = spark.createDataFrame([(1, i) for i in range(11)] + [(2, 0)], "vehicle_id int, index int")
    out = sampling.split_holdout(frames, "vehicle_id", ["index"])
    assert sorted(r["index"] for r in out.filter("held_out").collect()) == [9, 10]
    c = points(spark, [(i, 0.0, 0.0, 0.0) for i in range(3)])
    counts = spark.createDataFrame([(0, 2), (1, 1)], "splat_id long, seen int")
    assert {r.splat_id: r.promoted for r in consolidate.promote(c, counts).collect()} == {0: True, 1: False, 2: False}
