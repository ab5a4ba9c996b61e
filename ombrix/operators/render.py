"""Rendering as aggregation: project, spread every splat over its disc's pixels, keep the nearest per pixel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import Intrinsics, Pose, once, project

LEAST_RADIUS, MOST_RADIUS = 0.6, 12.0
LEAST_OPACITY = 0.05


def visible(cloud: DataFrame, pose: Pose, k: Intrinsics) -> DataFrame:
    """Splats in front of the camera that are opaque enough and whose disc reaches into the frame; adds u, v, depth, radius."""
    out = project(once(cloud, "x", "y", "z"), pose, k).filter((F.col("depth") > 1e-6) & (F.col("opacity") > LEAST_OPACITY))
    radius = F.greatest(F.lit(LEAST_RADIUS), F.least(F.lit(MOST_RADIUS), k.fx * F.col("scale") / F.greatest(F.col("depth"), F.lit(1e-6))))
    out = out.withColumn("radius", radius)
    return out.filter((F.col("u") >= -F.col("radius")) & (F.col("u") < k.width + F.col("radius")) & (F.col("v") >= -F.col("radius")) & (F.col("v") < k.height + F.col("radius")))


def zbuffer(cloud: DataFrame, pose: Pose, k: Intrinsics, *keys: str) -> DataFrame:
    """(keys, px, py, splat_id, depth, r, g, b): the nearest splat of every pixel that any disc covers; ties to the smaller id.

    Discs are cut to the frame before they are spread. With keys the cloud is dealt once, before it is projected;
    without, partial minima are taken before the shuffle.
    """
    if keys:
        cloud = cloud.filter(F.col("opacity") > LEAST_OPACITY).repartition(*keys)
    s = visible(cloud, pose, k).withColumns({"reach": F.greatest(F.ceil("radius"), F.lit(1)), "iu": F.rint("u").cast("int"), "iv": F.rint("v").cast("int")})

    if keys:  # a splat's place in order of (depth, id) is one long, whose minimum needs no sort of all pixels
        s = s.withColumn("_ord", F.row_number().over(W.partitionBy(*keys).orderBy("depth", "splat_id")))
    shown = ["splat_id", "depth", "r", "g", "b"]
    own = s.select(*keys, "u", "v", "radius", "reach", "iu", "iv", *(["_ord"] if keys else []), *shown)
    # one generator for both axes: a disc's box, cut to the frame, counted row by row
    box = {"x0": F.greatest(F.col("iu") - F.col("reach"), F.lit(0)), "x1": F.least(F.col("iu") + F.col("reach"), F.lit(k.width - 1)), "y0": F.greatest(F.col("iv") - F.col("reach"), F.lit(0)), "y1": F.least(F.col("iv") + F.col("reach"), F.lit(k.height - 1))}
    own = own.withColumns(box).filter("x0 <= x1 and y0 <= y1").withColumn("w", F.col("x1") - F.col("x0") + 1)
    own = own.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") * (F.col("y1") - F.col("y0") + 1) - 1)))
    own = own.withColumns({"px": (F.col("x0") + F.col("_i") % F.col("w")).cast("int"), "py": (F.col("y0") + F.floor(F.col("_i") / F.col("w"))).cast("int")})
    du, dv = F.col("px") - F.col("u"), F.col("py") - F.col("v")
    own = own.filter(du * du + dv * dv <= F.col("radius") * F.col("radius"))
    if keys:
        best = own.groupBy(*keys, "px", "py").agg(*[F.min_by(c, "_ord").alias(c) for c in shown])
        return best.select(*keys, "px", "py", *shown)
    best = own.groupBy("px", "py").agg(F.min(F.struct("depth", "splat_id", "r", "g", "b")).alias("m"))
    return best.select("px", "py", F.col("m.splat_id").alias("splat_id"), F.col("m.depth").alias("depth"), *[F.col(f"m.{c}").alias(c) for c in "rgb"])


def unproject_pixels(uv: DataFrame, image: DataFrame, cloud: DataFrame, k: Intrinsics) -> DataFrame:
    """(.., x, y, z, valid): the centre of the splat seen at the nearest pixel; invalid outside the frame or where none is."""
    at = uv.withColumns({"px": F.rint("u").cast("int"), "py": F.rint("v").cast("int")})
    out = at.join(image.select("px", "py", "splat_id"), ["px", "py"], "left").join(cloud.select("splat_id", "x", "y", "z"), "splat_id", "left")
    return out.withColumn("valid", F.col("x").isNotNull() & F.col("px").between(0, k.width - 1) & F.col("py").between(0, k.height - 1))


def orbit(n: int, radius: float = 3.2, height: float = 1.25, target=(0.0, 0.0, 0.5)) -> list[Pose]:
    return [Pose.look_at((radius * math.cos(2 * math.pi * i / n), radius * math.sin(2 * math.pi * i / n), height), target) for i in range(n)]


def seen_by(cloud: DataFrame, poses: list[Pose], k: Intrinsics, *keys: str) -> DataFrame:
    """(keys, pose, splat_id) of every splat that some pixel of some pose shows."""
    out = None
    for i, p in enumerate(poses):
        one = zbuffer(cloud, p, k, *keys).select(*keys, "splat_id").distinct().withColumn("pose", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def visibility_counts(cloud: DataFrame, poses: list[Pose], k: Intrinsics, *keys: str) -> DataFrame:
    """(keys, splat_id, seen): by how many poses a splat is seen, 0 included."""
    n = seen_by(cloud, poses, k, *keys).groupBy(*keys, "splat_id").agg(F.count(F.lit(1)).alias("seen"))
    return cloud.select(*keys, "splat_id").join(n, [*keys, "splat_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))


def sh_colour(cloud: DataFrame) -> DataFrame:
    """``sh``: the constant band in front of the others where there are any, null for matte clouds."""
    from .geometry import rgb_to_sh_dc

    dc = F.array(*[rgb_to_sh_dc(F.col(c)) for c in "rgb"])
    return cloud.withColumn("sh", F.when(F.exists("sh_rest", lambda c: c != 0), F.concat(dc, "sh_rest")))
