"""Meshes to splats: tangent frames, textures, and flat splats laid on the surface."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cloud import PRIOR
from .geometry import Vec, cross, dot, face_normal, matrix_to_quaternion
from .sampling import sample_surface


def tangent_frame(n: Vec) -> list[Column]:
    """A rotation by rows whose third column is the unit normal: local z becomes the normal.

    The first tangent is square to z, or to x where the normal is within some 26 degrees of z.
    """
    steep = F.abs(n[2]) >= 0.9
    seed = (F.when(steep, 1.0).otherwise(0.0), F.lit(0.0), F.when(steep, 0.0).otherwise(1.0))
    side = cross(seed, n)
    size = F.greatest(F.sqrt(dot(side, side)), F.lit(1e-12))
    side = tuple(v / size for v in side)
    up = cross(n, side)
    return [c[i] for i in range(3) for c in (side, up, n)]


def sample_texture(points: DataFrame, texels: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """points(point, u, v, ..) with r, g, b read between texels(keys, tx, ty, r, g, b); v = 0 is the lowest row.

    u and v are held to [0, 1] and the border texels hold beyond it. Each point meets its four texels by an equi-join.
    """
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("u"))) * (width - 1)
    y = (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v")))) * (height - 1)
    at = points.select(*keys, "point", x.alias("_x"), y.alias("_y"))
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    taps = [F.struct(F.least(F.floor("_x") + i, F.lit(width - 1)).alias("tx"), F.least(F.floor("_y") + j, F.lit(height - 1)).alias("ty"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)]
    at = at.select(*keys, "point", F.explode(F.array(*taps)).alias("_t")).select(*keys, "point", "_t.*")
    seen = at.join(texels, [*keys, "tx", "ty"]).groupBy(*keys, "point").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"])
    return points.join(seen, [*keys, "point"])


def mesh_to_splats(vertices: DataFrame, faces: DataFrame, count: int = 20_000, confidence: float = 0.15, spread: float = 1.6, thin: float = 0.1, seed: int = 7, texels: DataFrame | None = None, texture_size: tuple[int, int] | None = None) -> DataFrame:
    """Flat guesses spread over a mesh by area: place, colour, rotation, three scales.

    vertices (id, x, y, z, r, g, b and, for a texture, u, v), faces (id, i, j, k). Colours come from the texture where
    there is one, else from the vertices. A mesh without area is an error.
    """
    carry = ["x", "y", "z", *(["u", "v"] if texels is not None else ["r", "g", "b"])]
    corners = faces
    for name, index in (("a", "i"), ("b", "j"), ("c", "k")):
        corners = corners.join(vertices.select(F.col("id").alias(index), *[F.col(c).alias(f"{name}{c}") for c in carry]), index)
    hit = sample_surface(corners, count, seed)
    own = hit.select("point", "face", "x", "y", "z", "w0", "w1", "w2", "total").join(corners.withColumnRenamed("id", "face"), "face")
    for c in carry[3:]:
        own = own.withColumn(c, F.col("w0") * F.col(f"a{c}") + F.col("w1") * F.col(f"b{c}") + F.col("w2") * F.col(f"c{c}"))
    normal = face_normal(*(tuple(F.col(f"{p}{c}") for c in "xyz") for p in "abc"))
    own = own.withColumns({f"_n{i}": v for i, v in enumerate(normal)})
    turn = matrix_to_quaternion(tangent_frame(tuple(F.col(f"_n{i}") for i in range(3))))
    radius = spread * F.sqrt(F.col("total") / count / math.pi)
    own = own.withColumns({**dict(zip(("qw", "qx", "qy", "qz"), turn, strict=True)), "sx": radius, "sy": radius, "sz": radius * thin})
    if texels is not None:
        own = sample_texture(own, texels, *texture_size)
    clip = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))).alias(c) for c in "rgb"]
    # of a flat splat the scale that rendering uses is that of its disc
    return own.select(F.col("point").alias("splat_id"), "x", "y", "z", "sx", "sy", "sz", F.col("sx").alias("scale"), "qw", "qx", "qy", "qz", *clip, F.lit(0.9).alias("opacity"), F.lit(PRIOR).alias("provenance"), F.lit(confidence).alias("confidence"), F.lit(0).alias("view_count"), F.lit(0.0).alias("last_seen_ts"))


def prior_look(cloud: DataFrame, paint: tuple[float, float, float] = (0.75, 0.75, 0.77), noise: float = 0.02, confidence: float = 0.15, seed: int = 11) -> DataFrame:
    """The same places as guesses of one paint, with hashed Gaussian noise on the colours."""

    def uniform(k: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("splat_id", F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53)

    def normal(k: int) -> Column:
        return F.sqrt(-2 * F.ln(uniform(2 * k))) * F.cos(2 * math.pi * uniform(2 * k + 1))

    colours = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + noise * normal(i))) for i, (c, p) in enumerate(zip("rgb", paint, strict=True))}
    return cloud.withColumns({**colours, "provenance": F.lit(PRIOR), "confidence": F.lit(confidence)})


def paint_of(photo: DataFrame, mask: str, *keys: str, default: tuple[float, float, float] = (0.55, 0.58, 0.62)) -> DataFrame:
    """Mean colour of the masked pixels within [0.05, 0.95]; ``default`` where no pixel is masked."""
    own = photo.groupBy(*keys).agg(*[F.avg(F.when(F.col(mask), F.col(c))).alias(f"_{c}") for c in "rgb"])
    return own.select(*keys, *[F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col(f"_{c}"))), F.lit(d)).alias(f"paint_{c}") for c, d in zip("rgb", default, strict=True)])


def viewer_axes(cloud: DataFrame) -> DataFrame:
    """z up to y up: a quarter turn about x."""
    return cloud.withColumns({"y": F.col("z"), "z": -F.col("y")})
