"""Ingestion as a whole: first photos, registered and refused ones, clips, and the outcomes of registrars."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ombrix.operators import cloud, geometry, ingest, prior, render, sampling

K = geometry.Intrinsics.simple(64, 48)


@pytest.fixture(scope="module")
def scene(spark):
    points = sampling.sample_surface(prior.corners(*prior.sedan(spark)), 600).select(F.col("point").alias("splat_id"), "x", "y", "z")
    look = {c: F.lit(v) for c, v in zip("rgb", (0.7, 0.2, 0.2), strict=True)}
    return cloud.create(points, **look, scale=F.lit(0.06), confidence=F.lit(0.15)).checkpoint()


def photo_of(model, pose):
    return render.zbuffer(model.withColumn("g", F.lit(0.5)), pose, K).select("px", "py", "r", "g", "b").withColumn("vehicle", F.lit(True)).checkpoint()


def true_matches(pose):
    """A matcher that knows the truth: each landmark of every view, and where the photo shows it."""

    def match(asset, photo):
        at = geometry.project(asset.landmarks.select("view", "landmark_id", F.col("u").alias("lu"), F.col("v").alias("lv"), "x", "y", "z"), pose, K)
        return at.select("view", (F.col("view") * 1_000_000 + F.col("landmark_id")).alias("query_id"), F.col("lu").alias("u"), F.col("lv").alias("v"), F.col("u").alias("pu"), F.col("v").alias("pv"))

    return match


def nothing(asset, photo):
    return asset.landmarks.limit(0).select("view", F.col("landmark_id").alias("query_id"), "u", "v", F.col("u").alias("pu"), F.col("v").alias("pv"))


def test_photos_make_confirm_and_refuse(spark, scene):
    pose = render.orbit(12)[11]
    how = ingest.Ingestion(ingest.points_registrar(true_matches(pose)), generate=lambda photo, count: scene)
    first, made = how.photo(ingest.Asset.empty(spark, 7), photo_of(scene, pose), K, 1.0)
    assert made["created"] and made["frames_fused"] == 1 and made["observed"] > 0 and first.views == 1
    assert first.frames.count() == 0 and first.landmarks.filter("vehicle_id <> 7 or view <> 0").count() == 0 < first.landmarks.count()
    found = how.registrar(first, photo_of(scene, pose), K)
    assert found.accepted(0.35) and np.allclose(found.pose.center, pose.center, atol=0.02) and found.reason == ""
    second, made = how.photo(first, photo_of(scene, pose), K, 2.0, "pi")
    assert not made["created"] and (made["frames_fused"], made["frames_rejected"]) == (1, 0)
    assert second.frames.select("index", "weight").distinct().collect() == [(0, 0.6)]
    assert second.cloud.agg(F.max("last_seen_ts")).first()[0] == 2.0 and second.landmarks.agg(F.max("view")).first()[0] == 1
    refuses = ingest.Ingestion(ingest.points_registrar(nothing))
    third, made = refuses.photo(second, photo_of(scene, pose), K, 3.0, None)
    assert third.cloud is second.cloud and (made["frames_fused"], made["frames_rejected"]) == (0, 1)
    rows = third.observations.orderBy("seq").collect()
    assert [(r.seq, r.kind, r.ts) for r in rows] == [(0, "photo", 1.0), (1, "photo", 2.0), (2, "photo", 3.0)]
    assert json.loads(rows[0].data)["bootstrap"] and json.loads(rows[1].data)["report"]["accepted"]
    assert json.loads(rows[2].data) == {"rejected": True, "reason": "only 0 correspondences"}
    assert all(abs(sum(v * v for v in r.embedding.values()) - 1) < 1e-9 for r in rows)


def test_a_clip_is_one_observation(spark, scene):
    poses = render.orbit(12)[:3]
    frames = None
    for i, p in enumerate(poses):
        own = photo_of(scene, p).withColumns({"frame": F.lit(i), "ts": F.lit(i / 12)})
        frames = own if frames is None else frames.unionByName(own)
    motion = ingest.clip_motion(frames.withColumn("clip", F.lit(0)), K, "clip").orderBy("frame").collect()
    assert [r.frame for r in motion] == [0, 1, 2] and motion[0].motion == 0
    tried = []

    def refuse(asset, photo, k):
        tried.append("registrar")
        return ingest.Registration(reason="no")

    how = ingest.Ingestion(refuse, generate=lambda photo, count: scene, threshold=0.0, gap=1)
    out, made = how.video(ingest.Asset.empty(spark, 7), frames, K, 100.0, known=poses[1:2])
    assert made["created"] and (made["frames_sampled"], made["frames_fused"], made["frames_rejected"]) == (3, 2, 1)
    assert tried == ["registrar"] and out.frames.count() == 0 and out.views == 2
    assert out.cloud.agg(F.max("last_seen_ts")).first()[0] == 100.0 + 1 / 12
    rows = out.observations.orderBy("seq").collect()
    assert [r.kind for r in rows] == ["photo", "video"] and json.loads(rows[1].data) == {"frames_sampled": 3, "frames_fused": 2, "frames_rejected": 1}
    same, made = how.video(out, frames.limit(0), K, 100.0)
    assert same is out and made["frames_sampled"] == 0


def test_chains_start_from_the_last_accepted_frame_and_registrars_fall_back(spark, scene):
    before, pose = render.orbit(24)[0], render.orbit(24)[1]
    asset = ingest.Asset(7, scene.withColumn("vehicle_id", F.lit(7).cast("long")), *(spark.createDataFrame([], s) for s in (ingest.LANDMARKS, ingest.FRAMES, ingest.OBSERVATIONS)))
    shown = render.zbuffer(scene, before, K).join(scene.select("splat_id", "x", "y", "z"), "splat_id")
    pairs = geometry.project(shown.select("px", "py", "x", "y", "z"), pose, K).select(F.col("px").cast("double").alias("a"), F.col("py").cast("double").alias("b"), F.col("u").alias("pu"), F.col("v").alias("pv")).withColumnsRenamed({"a": "u", "b": "v"}).checkpoint()
    chain = ingest.points_chain(lambda a, b: pairs)
    found = chain(asset, (None, before), None, K)
    assert found.accepted(0.35) and found.reason == "tracked" and np.allclose(found.pose.center, pose.center, atol=0.02)
    assert ingest.points_chain(lambda a, b: pairs.limit(3))(asset, (None, before), None, K).pose is None
    weak, sure, none = (lambda *_, c=c, p=p: ingest.Registration(p, c) for c, p in ((0.2, pose), (0.5, pose), (0.0, None)))
    assert ingest.fallback(weak, sure)(asset, None, K).confidence == 0.5
    assert ingest.fallback(none, weak)(asset, None, K).confidence == 0.2
    assert ingest.fallback(none, none)(asset, None, K).pose is None


def test_outcomes_of_many_photos(spark):
    photos = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "photo int, vehicle_id long")
    marks = spark.createDataFrame([(7, 0, i, float(i * 20), 0.0, float(i), 0.0, 0.0) for i in range(4)], ingest.LANDMARKS)
    matches = spark.createDataFrame([(1, 7, 0, i, i * 20.0, 1.0, 5.0, 5.0) for i in range(4)], "photo int, vehicle_id long, view int, query_id long, u double, v double, pu double, pv double")
    got = {r.photo: r for r in ingest.register_by_points(photos, matches, marks, K).collect()}
    assert {p: r.reason for p, r in got.items()} == {1: "only 4 correspondences", 2: "only 0 correspondences", 3: "no landmarks"}
    assert all(r.r is None and r.confidence == 0 for r in got.values())


def test_outcomes_by_looks(spark):
    rows = [(1, 0, 0.0, 80, 0.9), (1, 1, 180.0, 80, 0.5), (1, 2, 90.0, 10, 0.99), (2, 0, 0.0, 80, 0.9), (2, 1, 180.0, 80, 0.88), (3, 0, 0.0, 80, 0.4), (4, 0, 0.0, 59, 0.9)]
    scores = spark.createDataFrame(rows, "photo int, pose int, azimuth double, observed int, score double")
    photos = spark.createDataFrame([(i,) for i in range(1, 6)], "photo int")
    got = {r.photo: (r.pose, r.confidence, r.inliers, r.reason) for r in ingest.register_by_looks(photos, scores).collect()}
    assert got == {1: (0, 0.9, 80, ""), 2: (None, 0.0, 0, "ambiguous"), 3: (None, 0.0, 0, "too unlike"), 4: (None, 0.0, 0, "no pose"), 5: (None, 0.0, 0, "no pose")}
