"""Photos and clips of one object, run through all parts of ingestion: mask, embedding, prior or registration, fusion, landmarks, history.

The cloud goes from frame to frame, so frames of one object are taken in strict order; objects are independent of each other.
Each accepted frame's cloud is checkpointed: the next one reads a table, not the plans of all before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cloud as clouds
from . import fusion, lifecycle, mesh, prior, sampling, tracking, views
from .geometry import Intrinsics, Pose, bootstrap_pose
from .registration import EVIDENCE, OTHER_EVIDENCE, ambiguous, confidence, solve_pnp
from .render import unproject_pixels, zbuffer

LANDMARKS = "vehicle_id long, view int, landmark_id long, u double, v double, x double, y double, z double"
FRAMES = "vehicle_id long, index int, ts double, weight double, r array<double>, t array<double>, px int, py int, o_r double, o_g double, o_b double, vehicle boolean"
OBSERVATIONS = "vehicle_id long, observation_id string, ts double, kind string, device string, data string, embedding map<long,double>, seq long"
SOLVED = "r array<double>, t array<double>, inliers int, error double"


@dataclass(frozen=True)
class Registration:
    """Where a photo was taken, or why that is not known."""

    pose: Pose | None = None
    confidence: float = 0.0
    inliers: int = 0
    error: float = math.inf
    reason: str = ""

    def accepted(self, least: float) -> bool:
        return self.pose is not None and self.confidence >= least


@dataclass(frozen=True)
class Asset:
    """All that is known of an object. ``cloud`` is None until a first photo."""

    vehicle_id: int
    cloud: DataFrame | None
    landmarks: DataFrame
    frames: DataFrame
    observations: DataFrame
    views: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, vehicle_id: int) -> Asset:
        return cls(vehicle_id, None, *(spark.createDataFrame([], s) for s in (LANDMARKS, FRAMES, OBSERVATIONS)))


Registrar = Callable[[Asset, DataFrame, Intrinsics], Registration]
Chain = Callable[[Asset, tuple[DataFrame, Pose], DataFrame, Intrinsics], Registration]


def solved(lifted: DataFrame, k: Intrinsics, *keys: str, threshold: float = 4.0) -> DataFrame:
    """lifted(keys, x, y, z, pu, pv) to (keys, r, t, inliers, error) of every key whose pose is found; one task a photo, whose points the detector bounds."""

    def run(at, own):
        own = own.sort_values(["pu", "pv", "x", "y", "z"])  # sampling goes by place, so the order must not depend on the shuffle
        found = solve_pnp(own[["x", "y", "z"]].to_numpy(), own[["pu", "pv"]].to_numpy(), k, threshold=threshold)
        if found is None:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in (*keys, "r", "t", "inliers", "error")})
        r, t, inliers, error = found
        return pd.DataFrame({**{c: own[c].iloc[:1].tolist() for c in keys}, "r": [np.ravel(r).tolist()], "t": [np.ravel(t).tolist()], "inliers": [inliers], "error": [error]})

    kinds = dict(lifted.dtypes)
    return lifted.select(*keys, "x", "y", "z", "pu", "pv").groupBy(*keys).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), SOLVED]))


def _registered(photos: DataFrame, reason: Column, sure: Column) -> DataFrame:
    """photos with r, t, inliers, error: those with a reason lose pose and confidence."""
    ok = reason.isNull()
    return photos.select("photo", *[F.when(ok, F.col(c)).alias(c) for c in ("r", "t")], F.when(ok, sure).otherwise(0.0).alias("confidence"), F.coalesce("inliers", F.lit(0)).alias("inliers"), F.when(ok, F.col("error")).alias("error"), F.coalesce(reason, F.lit("")).alias("reason"))


def register_by_points(photos: DataFrame, matches: DataFrame, landmarks: DataFrame, k: Intrinsics, radius: float = 6.0, threshold: float = 4.0, least: int = 6) -> DataFrame:
    """photos(photo, vehicle_id) to (photo, r, t, confidence, inliers, error, reason); any number of photos at once.

    matches(photo, vehicle_id, view, query_id, u, v, pu, pv): places in stored views and in the photo; query_id is a match's own.
    A photo without landmarks, with fewer than ``least`` lifted matches or without a pose that fits has no pose, and a reason.
    """
    keys = ["vehicle_id", "view"]
    lifted, _ = tracking.correspondences(matches, landmarks, *keys, radius=radius)
    lifted = lifted.join(matches.select(*keys, "query_id", "photo"), [*keys, "query_id"])
    known = landmarks.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("landmarks"))
    total, found = (df.groupBy("photo").agg(F.count(F.lit(1)).alias(n)) for df, n in ((matches, "total"), (lifted, "lifted")))
    out = photos.join(known, "vehicle_id", "left").join(total, "photo", "left").join(found, "photo", "left").fillna(0, ["landmarks", "total", "lifted"])
    out = out.join(solved(lifted, k, "photo", threshold=threshold), "photo", "left")
    why = tracking.pnp_outcome(F.col("landmarks"), F.col("lifted"), F.col("r").isNotNull(), least)
    return _registered(out, why, confidence(F.col("inliers"), F.col("total"), F.col("error"), threshold, least))


def register_by_looks(photos: DataFrame, scores: DataFrame, observed: int = 60, least: float = 0.55, margin: float = 0.05, apart: float = 60.0) -> DataFrame:
    """photos(photo) with scores(photo, pose, azimuth, observed, score) of renders to (photo, pose, confidence, inliers, error, reason).

    Poses that show fewer than ``observed`` confirmed pixels do not count. The best is refused if one far away comes
    close to it, or if it is too unlike; the confidence of a taken one is its score, its error what the score lacks.
    """
    fit = tracking.pose_scores(scores, "photo", observed)
    best = ambiguous(fit, "photo", margin, apart).join(fit.select("photo", "pose", "observed"), ["photo", "pose"])
    out = photos.select("photo").join(best, "photo", "left")
    why = tracking.reid_outcome(F.col("pose").isNotNull(), F.col("ambiguous"), F.col("score"), least)
    ok = why.isNull()
    return out.select("photo", F.when(ok, F.col("pose")).alias("pose"), F.when(ok, F.col("score")).otherwise(0.0).alias("confidence"), F.when(ok, F.col("observed")).otherwise(0).alias("inliers"), F.when(ok, 1 - F.col("score")).alias("error"), F.coalesce(why, F.lit("")).alias("reason"))


def outcome(row) -> Registration:
    """A row of :func:`register_by_points` as the loop takes it."""
    pose = None if row.r is None else Pose(tuple(row.r), tuple(row.t))
    return Registration(pose, row.confidence, row.inliers, math.inf if row.error is None else row.error, row.reason)


def points_registrar(match: Callable[[Asset, DataFrame], DataFrame]) -> Registrar:
    """A registrar of match(asset, photo), which gives (view, query_id, u, v, pu, pv)."""

    def register(asset: Asset, photo: DataFrame, k: Intrinsics) -> Registration:
        own = photo.sparkSession.range(1).select(F.lit(0).alias("photo"), F.lit(asset.vehicle_id).cast("long").alias("vehicle_id"))
        found = match(asset, photo).withColumns({"photo": F.lit(0), "vehicle_id": F.lit(asset.vehicle_id).cast("long")})
        return outcome(register_by_points(own, found, asset.landmarks, k).first())

    return register


def points_chain(match: Callable[[DataFrame, DataFrame], DataFrame], threshold: float = 4.0, least: int = 6) -> Chain:
    """Poses from match(before, photo), which gives (u, v, pu, pv): the frame before shows the model, so its pixels have places."""

    def chain(asset: Asset, before: tuple[DataFrame, Pose], photo: DataFrame, k: Intrinsics) -> Registration:
        image = zbuffer(asset.cloud, before[1], k)
        lifted = unproject_pixels(match(before[0], photo), image, asset.cloud, k).filter("valid").withColumn("photo", F.lit(0)).checkpoint()
        n = lifted.count()
        row = solved(lifted, k, "photo", threshold=threshold).first() if n >= least else None
        if row is None:
            return Registration(reason=f"only {n} tracked points on the model" if n < least else "pose not found", inliers=n)
        sure = lifted.sparkSession.range(1).select(confidence(F.lit(row.inliers), F.lit(n), F.lit(row.error), threshold, least)).first()[0]
        return Registration(Pose(tuple(row.r), tuple(row.t)), sure, row.inliers, row.error, "tracked")

    return chain


def fallback(*registrars: Registrar, least: float = 0.35) -> Registrar:
    """The first that is accepted; if none is, the surest of all."""

    def register(asset: Asset, photo: DataFrame, k: Intrinsics) -> Registration:
        best = Registration(reason="no registrar")
        for i, one in enumerate(registrars):
            got = one(asset, photo, k)
            if got.accepted(least):
                return got
            if not i or got.confidence > best.confidence:
                best = got
        return best

    return register


def painted_sedan(photo: DataFrame, count: int) -> DataFrame:
    """The procedural prior in the photo's paint."""
    paint = mesh.paint_of(photo, "vehicle").first()
    return mesh.mesh_to_splats(*prior.sedan(photo.sparkSession, (paint.paint_r, paint.paint_g, paint.paint_b)), count)


def clip_motion(frames: DataFrame, k: Intrinsics, key: str) -> DataFrame:
    """(key, frame, ts, motion) of frames(key, frame, ts, px, py, r, g, b): each frame's motion since the one before it; 0 for the first."""
    from pyspark.sql import Window as W

    order = frames.select(key, "frame", "ts").distinct().withColumn("_last", F.lag("frame").over(W.partitionBy(key).orderBy("frame")))
    grey = views.small_grey(frames, k.width, k.height, key, "frame")
    before = order.select(key, "frame", "_last").join(grey.withColumnRenamed("frame", "_last"), [key, "_last"]).drop("_last")
    moved = views.block_motion(before, grey, key, "frame")
    return order.drop("_last").join(moved, [key, "frame"], "left").withColumn("motion", F.coalesce("motion", F.lit(0.0)))


@dataclass(frozen=True)
class Ingestion:
    """How photos are ingested. ``registrar`` finds a photo's pose, ``generate(photo, count)`` makes a first cloud."""

    registrar: Registrar
    generate: Callable[[DataFrame, int], DataFrame] = painted_sedan
    chain: Chain | None = None
    config: fusion.FusionConfig = field(default_factory=fusion.FusionConfig)
    prior_points: int = 120_000
    every: int = 12
    threshold: float = 12.0
    most: int = 60
    gap: int = 2

    def photo(self, asset: Asset, photo: DataFrame, k: Intrinsics, ts: float, device: str | None = "phone", known: Pose | None = None) -> tuple[Asset, dict]:
        """photo(px, py, r, g, b and, where it is known, vehicle) into the asset: (new asset, summary). Every photo enters the history."""
        photo = self._masked(photo, k)
        if asset.cloud is None:
            return self._first(asset, photo, k, ts, device)
        found = self._known(known) if known else self.registrar(asset, photo, k)
        if found.pose is None:
            asset = self._observed(asset, photo, k, "photo", device, ts, {"rejected": True, "reason": found.reason})
            return asset, self._summary(asset, False, 1, 0)
        asset, report = self._fused(asset, photo, found, k, ts, device, True)
        data = {"registration": {"confidence": found.confidence, "inliers": found.inliers, "reason": found.reason}, "report": report}
        asset = self._observed(asset, photo, k, "photo", device, ts, data)
        return asset, self._summary(asset, False, 1, int(report["accepted"]))

    def video(self, asset: Asset, frames: DataFrame, k: Intrinsics, ts: float, device: str | None = "phone", known: list[Pose] | None = None) -> tuple[Asset, dict]:
        """frames(frame, ts, px, py, r, g, b[, vehicle]) of one clip into the asset: frames of new views in order, one row of history.

        Without a cloud the first frame makes one. known: poses of the frames that are registered, as far as they go.
        A frame is tracked from the last accepted one, registered anew where that fails or after ``every`` tracked frames.
        """
        motion = clip_motion(frames.withColumn("clip", F.lit(0)), k, "clip")
        kept = sampling.sample_frames(motion, "clip", ["frame", "ts"], "motion", self.threshold, self.most, self.gap).orderBy("frame").collect()  # ``most`` rows
        if not kept:
            return asset, self._summary(asset, False, 0, 0)
        pick = lambda f: self._masked(frames.filter(F.col("frame") == f.frame).drop("frame", "ts"), k)
        first, created, fused, rest = pick(kept[0]), asset.cloud is None, 0, kept
        if created:
            asset, made = self._first(asset, first, k, ts, device)
            fused, rest = made["frames_fused"], kept[1:]
        before, since = None, 0
        for i, f in enumerate(rest):
            photo = pick(f)
            if known is not None and i < len(known):
                found = self._known(known[i])
            else:
                least, found = self.config.min_confidence, Registration()
                if self.chain and before and since < self.every:
                    found = self.chain(asset, before, photo, k)
                if found.accepted(least):
                    since += 1
                else:
                    found = self.registrar(asset, photo, k)
                    since = 0 if found.accepted(least) else since
                before = (photo, found.pose) if found.accepted(least) else before
            if found.pose is not None:
                asset, report = self._fused(asset, photo, found, k, ts + f.ts, device, False)
                fused += int(report["accepted"])
        figures = {"frames_sampled": len(kept), "frames_fused": fused, "frames_rejected": len(kept) - fused}
        asset = self._observed(asset, first, k, "video", device, ts, figures)
        return asset, self._summary(asset, created, len(kept), fused)

    def _masked(self, photo: DataFrame, k: Intrinsics) -> DataFrame:
        return photo if "vehicle" in photo.columns else photo.withColumn("vehicle", views.centre_mask(k.width, k.height))

    def _known(self, pose: Pose) -> Registration:
        return Registration(pose, 1.0, 0, 0.0, "pose came with the photo")

    def _first(self, asset: Asset, photo: DataFrame, k: Intrinsics, ts: float, device: str | None) -> tuple[Asset, dict]:
        """A cloud from the first photo, whose pose is given by how the cloud is made. The photo itself is not kept among the frames."""
        cloud = self.generate(photo, self.prior_points).withColumn("vehicle_id", F.lit(asset.vehicle_id).cast("long")).checkpoint()
        at = bootstrap_pose(cloud, k).first()
        mean = cloud.agg(*[F.avg(c).alias(c) for c in "xyz"]).first()
        found = Registration(Pose.look_at((at.ex, at.ey, at.ez), tuple(mean)), 1.0, 0, 0.0, "first photo")
        asset, report = self._fused(replace(asset, cloud=cloud), photo, found, k, ts, device, False)
        asset = self._observed(asset, photo, k, "photo", device, ts, {"bootstrap": True, "report": report})
        return asset, self._summary(asset, True, 1, 1)

    def _fused(self, asset: Asset, photo: DataFrame, found: Registration, k: Intrinsics, ts: float, device: str | None, keep: bool) -> tuple[Asset, dict]:
        weight = EVIDENCE.get((device or "unknown").lower(), OTHER_EVIDENCE)
        cloud, report = fusion.fuse_frame(asset.cloud, photo, found.pose, k, found.confidence, weight, ts, self.config)
        if not report["accepted"]:
            return asset, report
        cloud = cloud.checkpoint()
        shown = zbuffer(cloud, found.pose, k, "vehicle_id").join(photo.filter("vehicle").select("px", "py"), ["px", "py"], "left_semi")
        marks = tracking.record_landmarks(shown, cloud, "vehicle_id").withColumns({"view": F.lit(asset.views), "landmark_id": F.col("v") * k.width + F.col("u")})
        asset = replace(asset, cloud=cloud, landmarks=_appended(asset.landmarks, marks, LANDMARKS), views=asset.views + 1)
        if keep:
            index = asset.frames.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
            pose = {c: F.array(*map(F.lit, v)) for c, v in (("r", found.pose.r), ("t", found.pose.t))}
            own = photo.select("px", "py", *[F.col(c).alias(f"o_{c}") for c in "rgb"], "vehicle")
            own = own.withColumns({"vehicle_id": F.lit(asset.vehicle_id), "index": F.lit(index), "ts": F.lit(ts), "weight": F.lit(weight), **pose})
            asset = replace(asset, frames=_appended(asset.frames, own, FRAMES))
        return asset, report

    def _observed(self, asset: Asset, photo: DataFrame, k: Intrinsics, kind: str, device: str | None, ts: float, data: dict) -> Asset:
        looks = views.embedding(photo.filter("vehicle").withColumn("vehicle_id", F.lit(asset.vehicle_id)), k.width, k.height, "vehicle_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("embedding"))
        values = {"vehicle_id": asset.vehicle_id, "observation_id": f"{kind}-{ts}", "ts": float(ts), "kind": kind, "device": device, "data": json.dumps(data, sort_keys=True)}
        new = looks.withColumns({c: F.lit(v) for c, v in values.items()})
        at = [F.col(c.split()[0]).cast(c.split()[1]) for c in OBSERVATIONS.split(", ")[:-1]]
        return replace(asset, observations=lifecycle.add_observations(asset.observations, new.select(*at)).checkpoint())

    def _summary(self, asset: Asset, created: bool, sampled: int, fused: int) -> dict:
        figures = {} if asset.cloud is None else clouds.stats(asset.cloud).first().asDict()
        return {"created": created, "frames_sampled": sampled, "frames_fused": fused, "frames_rejected": sampled - fused, **figures}


def _appended(table: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    return table.unionByName(new.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in kind.split(", ")])).checkpoint()
