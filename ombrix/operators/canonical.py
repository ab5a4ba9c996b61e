"""Bringing clouds into the canonical frame: x forward, z up, ground at 0, two units long."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def covariance(cloud: DataFrame, *keys: str) -> DataFrame:
    return cloud.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in _PAIRS])


def canonicalize_orientation(cloud: DataFrame) -> DataFrame:
    """Principal axes by falling variance onto x, y, z; upside down if the top is wider than the bottom.

    One aggregate over the cloud, a 3 x 3 eigenproblem on the driver. An axis' sign is free: its largest component
    is made positive, so that results are the same on every run.
    """
    m = covariance(cloud).first()
    cov = np.zeros((3, 3))
    for a, b in _PAIRS:
        cov["xyz".index(a), "xyz".index(b)] = cov["xyz".index(b), "xyz".index(a)] = m[f"c{a}{b}"]
    _, vec = np.linalg.eigh(cov)
    r = vec[:, ::-1].T
    r = r * np.sign(r[np.arange(3), np.abs(r).argmax(1)])[:, None]
    if np.linalg.det(r) < 0:
        r[2] = -r[2]
    p = [F.col(c) - m[f"m{c}"] for c in "xyz"]
    out = cloud.withColumns({c: sum((float(w) * q for w, q in zip(r[i, 1:], p[1:], strict=True)), float(r[i, 0]) * p[0]) for i, c in enumerate("xyz")})
    lo, hi = out.agg(F.percentile("z", F.array(F.lit(0.1), F.lit(0.9)))).first()[0]
    width = out.agg(*[(F.max(F.when(c, F.col("y"))) - F.min(F.when(c, F.col("y")))) for c in (F.col("z") <= lo, F.col("z") >= hi)]).first()
    return out.withColumns({"y": -F.col("y"), "z": -F.col("z")}) if width[1] > width[0] else out


def ground_bins(cloud: DataFrame, *keys: str, bins: int = 20, share: float = 0.02, least: int = 20) -> DataFrame:
    """Per bin along x: its centre and the floor, a low percentile of z; bins of fewer rows are left out."""
    span = cloud.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    own = (cloud.join(span, list(keys)) if keys else cloud.crossJoin(F.broadcast(span))).withColumn("bin", F.least(F.floor((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")) * bins), F.lit(bins - 1)))
    out = own.filter("x1 > x0").groupBy(*keys, "bin", "x0", "x1").agg(F.count(F.lit(1)).alias("n"), F.percentile("z", F.lit(share)).alias("floor"))
    return out.filter(F.col("n") >= least).select(*keys, "bin", "n", "floor", (F.col("x0") + (F.col("bin") + 0.5) * (F.col("x1") - F.col("x0")) / bins).alias("centre"))


def ground_slope(bins: DataFrame, *keys: str) -> DataFrame:
    """The floor's slope along x, and where the fitted floor meets it; null with fewer than three bins."""
    return bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("bins"), F.avg("centre").alias("at"), F.regr_slope("floor", "centre").alias("slope")).withColumn("slope", F.when(F.col("bins") >= 3, F.col("slope")))


def level_ground_contact(cloud: DataFrame, *keys: str, noise: float = 0.01) -> DataFrame:
    """Takes the floor's slope off z where there is more of it than noise."""
    slope = ground_slope(ground_bins(cloud, *keys), *keys)
    out = cloud.join(slope, list(keys), "left") if keys else cloud.crossJoin(F.broadcast(slope))
    tilt = F.when(F.abs("slope") > noise, F.col("slope") * (F.col("x") - F.col("at"))).otherwise(0.0)
    return out.withColumn("z", F.col("z") - F.coalesce(tilt, F.lit(0.0))).select(*cloud.columns)


def normalize(cloud: DataFrame, *keys: str, length: float = 2.0) -> DataFrame:
    """Centred on the mean, lowest point at 0, ``length`` long along x; adds the factor. One window per object."""
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    factor = length / F.greatest(F.max("x").over(own) - F.min("x").over(own), F.lit(1e-6))
    return cloud.withColumns({"factor": factor, "x": (F.col("x") - F.avg("x").over(own)) * factor, "y": (F.col("y") - F.avg("y").over(own)) * factor, "z": (F.col("z") - F.min("z").over(own)) * factor})
