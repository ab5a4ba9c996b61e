"""Evidence arbitration: guesses are replaced whole, what was observed resists weak evidence, the unseen stays untouched."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import pixels, spatial
from .cloud import OBSERVED, PRIOR, prune, with_updates
from .geometry import Intrinsics, Pose, unproject
from .render import zbuffer


@dataclass(frozen=True)
class FusionConfig:
    """The thresholds of arbitration."""

    min_confidence: float = 0.35
    trusted: float = 0.75
    residual: float = 0.10
    ring: int = 3
    margin: float = 0.25
    rate: float = 0.6
    gain: float = 0.35
    promote: float = 0.25
    mirror_radius: float = 0.05
    depth_reach: int = 8
    spawn_step: int = 6
    max_splats: int = 400_000


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def trusted(image: DataFrame, cloud: DataFrame, least: float = 0.75) -> DataFrame:
    """Pixels that show a confirmed splat of enough confidence."""
    return image.join(cloud.filter((F.col("provenance") == OBSERVED) & (F.col("confidence") >= least)).select("splat_id"), "splat_id", "left_semi")


def partition_visible(image: DataFrame, width: int, height: int, cfg: FusionConfig, *keys: str) -> tuple[DataFrame, DataFrame]:
    """image has residual: (pixels of the disputed region, (keys, splat_id) that agree somewhere). A splat may be in both."""
    core = image.filter(F.col("residual") > cfg.residual)
    ring = pixels.dilate(core, cfg.ring, width, height, *keys)
    disputed = image.join(ring, [*keys, "px", "py"], "left_semi")
    return disputed, image.join(ring, [*keys, "px", "py"], "left_anti").select(*keys, "splat_id").distinct()


def resists(weight: Column | float, margin: float = 0.25) -> Column:
    """Whether a splat keeps its look: it was observed, and the evidence is no stronger than its confidence less the margin."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return (F.col("provenance") != PRIOR) & ~(weight > F.col("confidence") * (1 - margin))


def mean_colour(disputed: DataFrame) -> DataFrame:
    return disputed.groupBy("splat_id").agg(*[F.avg(f"o_{c}").alias(f"t_{c}") for c in "rgb"])


def recolour(dirty: DataFrame, weight: Column | float, rate: float = 0.6) -> DataFrame:
    """dirty has t_r, t_g, t_b: guesses take the seen colour whole, confirmed splats move towards it; all become observed."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    lr = F.when(F.col("provenance") == PRIOR, 1.0).otherwise(clip01(rate * weight))
    return dirty.withColumns({c: clip01((1 - lr) * F.col(c) + lr * F.col(f"t_{c}")) for c in "rgb"}).withColumn("provenance", F.lit(OBSERVED))


def confirm(touched: DataFrame, dirty: DataFrame, weight: Column | float, ts: Column, cfg: FusionConfig) -> DataFrame:
    """Touched splats gain confidence, a view and the time; those that only agreed are promoted once sure enough."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    flagged = touched.join(dirty.select("splat_id").withColumn("_d", F.lit(True)), "splat_id", "left")
    out = flagged.withColumns({"confidence": clip01(F.col("confidence") + cfg.gain * weight), "view_count": F.col("view_count") + 1, "last_seen_ts": ts})
    return out.withColumn("provenance", F.when(F.col("_d").isNull() & (F.col("confidence") >= cfg.promote), OBSERVED).otherwise(F.col("provenance"))).drop("_d")


def confirm_all(cloud: DataFrame, weight: Column, ts: Column, cfg: FusionConfig) -> DataFrame:
    """As :func:`confirm` where nothing was recoloured, over a cloud that holds each row's evidence: null is none."""
    seen, sure = weight.isNotNull(), clip01(F.col("confidence") + cfg.gain * weight)
    new = {"confidence": sure, "view_count": F.col("view_count") + 1, "last_seen_ts": ts, "provenance": F.when(sure >= cfg.promote, OBSERVED).otherwise(F.col("provenance"))}
    return cloud.withColumns({c: F.when(seen, v).otherwise(F.col(c)) for c, v in new.items()})


def pixel_weights(image: DataFrame, core: DataFrame, ring: DataFrame, outer: float = 0.3) -> DataFrame:
    """``weight`` of every pixel for refinement: 1 in the disputed core, ``outer`` in the ring around it, 0 elsewhere."""
    mark = core.select("px", "py").withColumn("_w", F.lit(1.0)).unionByName(ring.select("px", "py").withColumn("_w", F.lit(outer)))
    top = mark.groupBy("px", "py").agg(F.max("_w").alias("weight"))
    return image.join(top, ["px", "py"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def mirror_confirmed(cloud: DataFrame, radius: float = 0.05, keys: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """What was observed also shapes the nearest guess on the other side of y = 0; provenance and confidence stay.

    The guess takes the reflected place and rotation, the scale, opacity and colour; its higher colour bands go. Of several
    sources of one guess the last, by id, counts. ``mirror_count`` counts all.
    """
    hit = mirror_targets(cloud, radius, keys)
    names = [c for c in LOOK if c in cloud.columns]
    new = hit.groupBy("splat_id").agg(F.max_by(F.struct(*[f"n_{c}" for c in names]), F.col("source_id")).alias("m"))
    out = cloud.join(new, "splat_id", "left")
    plain = {"sh_rest": F.when(F.col("m").isNull(), F.col("sh_rest"))} if "sh_rest" in cloud.columns else {}
    return out.select(*[F.coalesce(f"m.n_{c}", c).alias(c) if c in names else plain[c].alias(c) if c in plain else F.col(c) for c in cloud.columns])


#: What a mirrored guess takes over, and which of it changes sign on the other side of y = 0 (fixed values).
LOOK = ("x", "y", "z", "qw", "qx", "qy", "qz", "scale", "opacity", "r", "g", "b")
FLIPPED = ("y", "qx", "qz")


def mirror_count(targets: DataFrame) -> DataFrame:
    """How many sources found a guess to shape: ``mirrored``."""
    return targets.agg(F.count(F.lit(1)).alias("mirrored"))


def mirror_targets(cloud: DataFrame, radius: float = 0.05, keys: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """(splat_id, source_id, distance, n_ and each of LOOK): guesses nearest to a reflected observation, among all splats."""
    src = cloud.filter(F.col("provenance") == OBSERVED).select(*keys, F.col("splat_id").alias("source_id"), "x", (-F.col("y")).alias("y"), "z")
    near = spatial.nearest_within(src, cloud, radius, list(keys), "source_id", "splat_id")
    look = cloud.select(F.col("splat_id").alias("source_id"), *[(-F.col(c) if c in FLIPPED else F.col(c)).alias(f"n_{c}") for c in LOOK if c in cloud.columns])
    guesses = cloud.filter(F.col("provenance") == PRIOR).select("splat_id")
    return near.join(guesses, "splat_id", "left_semi").join(look, "source_id").drop(*keys)


#: Bands of an object by height: the upper and the lower body, as shares of its z range.
BANDS = ((0.55, 0.90), (0.05, 0.55))
_SHOWN = ("r", "g", "b", "opacity")


def band_medians(cloud: DataFrame, keys: tuple[str, ...] = ("vehicle_id",), k: int = 13, apart: float = 0.15) -> DataFrame:
    """(keys, band, splat_id, m_r, m_g, m_b, m_opacity): neighbourhood medians of guesses that stick out of their band.

    The cloud is dealt once, by object, and no pair of points leaves a task: an object's points must fit a worker's memory.
    Ids tell splats of all objects apart.
    """
    rows = cloud.select(*keys, "splat_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *_SHOWN)], F.col("provenance").cast("int").alias("provenance"))
    for c in keys:
        rows = rows.filter(F.col(c).isNotNull())
    own = [f for name in keys for f in cloud.schema if f.name == name]
    schema = StructType([*own, StructField("band", IntegerType()), cloud.schema["splat_id"], *[StructField(f"m_{c}", DoubleType()) for c in _SHOWN]])

    def settle(table: pa.Table) -> pa.Table:
        return _object_medians(table, keys, k, apart)

    return rows.groupBy(*keys).applyInArrow(settle, schema)


def _numbers(table: pa.Table, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns as (n, columns), NaN where null, and which are not null."""
    columns = [table.column(c) for c in names]
    return np.stack([c.fill_null(math.nan).to_numpy() for c in columns], axis=1), np.stack([c.is_valid().to_numpy() for c in columns], axis=1)


@np.errstate(all="ignore")
def _object_medians(table: pa.Table, keys: tuple[str, ...], k: int, apart: float) -> pa.Table:
    """Bands, neighbours and medians of one object, as SQL has them: NaN is the largest number, and null takes no part."""
    table = table.combine_chunks()
    table = table.take(pc.sort_indices(table.column("splat_id")))
    ids = table.column("splat_id")
    place, there = _numbers(table, *"xyz")
    known, z, named = there.all(1), place[:, 2], ids.is_valid().to_numpy()
    heights = z[there[:, 2]]
    low, high = (heights.min(), heights.max()) if len(heights) else (0.0, 0.0)
    share = (z - low) / (high - low) if high > low else np.full(len(z), math.nan)
    shown, shows = _numbers(table, *_SHOWN)
    # rows of one id share a number; there is more than one row only where ids repeat
    number = np.zeros(len(z), dtype=np.int64)
    number[1:] = np.cumsum(pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy())
    guesses = np.flatnonzero(named & (table.column("provenance").fill_null(-1).to_numpy() == PRIOR))
    found, bands, medians, empty = [], [], [], []
    for band, (at, below) in enumerate(BANDS):
        rows = np.flatnonzero((share >= at) & (share < below))
        if len(rows) < k or not len(guesses):
            continue
        n = number[rows]
        first = np.diff(n, prepend=-1) > 0
        asked = np.flatnonzero(first & named[rows] & np.isin(n, number[guesses]))
        if not len(asked):
            continue
        near = spatial.nearest_rows(place[rows], known[rows], asked, k)
        if not first.all():
            ends = np.searchsorted(n, n[asked], side="right")
            for i in np.flatnonzero(ends - asked > 1):
                near[i] = spatial.ranked(place[rows], known[rows], np.arange(asked[i], ends[i]), k)
        m, some = _medians(shown[rows[near]], shows[rows[near]])
        to = np.minimum(np.searchsorted(n[asked], number[guesses]), len(asked) - 1)
        hit = n[asked][to] == number[guesses]
        own, to = guesses[hit], to[hit]
        gap = shown[own, :3] - m[to, :3]
        gap *= gap
        keep = ~(np.sqrt((gap[:, 0] + gap[:, 1]) + gap[:, 2]) <= apart) & shows[own, :3].all(1) & some[to, :3].all(1)
        found.append(own[keep])
        bands.append(np.full(int(keep.sum()), band, dtype=np.int32))
        medians.append(m[to[keep]])
        empty.append(~some[to[keep]])
    names = [*keys, "band", "splat_id", *[f"m_{c}" for c in _SHOWN]]
    if not found:
        made = table.slice(0, 0)
        return pa.table([*[made.column(c) for c in keys], pa.array([], pa.int32()), made.column("splat_id"), *[pa.array([], pa.float64())] * len(_SHOWN)], names=names)
    made, medians, empty = table.take(pa.array(np.concatenate(found))), np.concatenate(medians), np.concatenate(empty)
    values = [pa.array(medians[:, i], mask=empty[:, i]) for i in range(len(_SHOWN))]
    return pa.table([*[made.column(c) for c in keys], pa.array(np.concatenate(bands)), made.column("splat_id"), *values], names=names)


def _medians(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians over the middle axis of what is there, and where anything is."""
    n = there.sum(1)
    order = np.sort(np.where(there, values, math.nan), axis=1)
    lo, hi = (np.take_along_axis(order, np.maximum(i, 0)[:, None, :], axis=1)[:, 0, :] for i in ((n - 1) // 2, n // 2))
    return np.where(n % 2 == 1, lo, (lo + hi) / 2), n > 0


def smooth_material_bands(cloud: DataFrame, keys: tuple[str, ...] = ("vehicle_id",), blend: float = 0.7) -> DataFrame:
    med = band_medians(cloud, keys).groupBy("splat_id").agg(*[F.first(f"m_{c}").alias(f"m_{c}") for c in ("r", "g", "b", "opacity")])
    out = cloud.join(med, "splat_id", "left")
    names = ("r", "g", "b", "opacity")
    return out.select(*[F.coalesce((1 - blend) * F.col(c) + blend * F.col(f"m_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in cloud.columns])


def spawn(photo: DataFrame, image: DataFrame, cfg: FusionConfig, budget: int | None = None, *keys: str) -> DataFrame:
    """Photo pixels of the object that show no splat, on every sixth row and column, with the nearest depth around."""
    from pyspark.sql import Window as W

    empty = photo.join(image.select(*keys, "px", "py"), [*keys, "px", "py"], "left_anti")
    out = empty.filter((F.col("px") % cfg.spawn_step == 0) & (F.col("py") % cfg.spawn_step == 0)).join(pixels.nearest_depth(image, cfg.depth_reach, *keys), [*keys, "px", "py"])
    if budget is not None:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("py", "px") if keys else W.orderBy("py", "px"))).filter(F.col("_n") <= budget).drop("_n")
    return out


def fuse_frame(cloud: DataFrame, photo: DataFrame, pose: Pose, k: Intrinsics, confidence: float, weight: float, ts: float, cfg: FusionConfig | None = None) -> tuple[DataFrame, dict]:
    """One registered photo (px, py, r, g, b, vehicle) into the cloud of one object: (new cloud, report).

    Every step works on the render of the cloud as it came in; only the new splats' size looks at the updated one.
    """
    cfg = cfg or FusionConfig()
    if confidence < cfg.min_confidence:
        return cloud, {"accepted": False, "reason": f"registration confidence {confidence:.2f} under {cfg.min_confidence:.2f}"}
    n = cloud.count()
    if not n:
        return cloud, {"accepted": False, "reason": "the cloud is empty"}
    image = zbuffer(cloud, pose, k)
    seen = photo.withColumnsRenamed({c: f"o_{c}" for c in "rgb"})
    both = image.join(seen, ["px", "py"]).filter("vehicle")
    sure = trusted(both, cloud, cfg.trusted)
    fit = pixels.exposure_fit(sure.withColumnsRenamed({c: f"f_{c}" for c in "rgb"}).select(*[f"{s}_{c}" for s in "of" for c in "rgb"])).first()
    fixed = {c: clip01(F.col(f"o_{c}") * fit[f"gain_{c}"] + fit[f"bias_{c}"]) for c in "rgb"} if fit and fit.n >= 256 else {c: F.col(f"o_{c}") for c in "rgb"}
    seen = seen.withColumns({f"o_{c}": v for c, v in fixed.items()})
    whole = seen.select("px", "py", *[F.col(f"o_{c}").alias(c) for c in "rgb"])
    shown = whole.select("px", "py").join(image.select("px", "py", "r", "g", "b"), ["px", "py"], "left").fillna(1.0, ["r", "g", "b"])
    res = pixels.residual(whole, shown, k.width, k.height)
    marked = image.drop("r", "g", "b").join(res, ["px", "py"]).join(seen, ["px", "py"]).filter("vehicle")
    disputed, agreeing = partition_visible(marked, k.width, k.height, cfg)
    target = mean_colour(disputed)
    dirty = cloud.join(target, "splat_id").filter(~resists(weight, cfg.margin))
    recoloured = recolour(dirty, weight, cfg.rate).select(*cloud.columns)
    touched_ids = agreeing.unionByName(dirty.select("splat_id")).distinct()
    out = with_updates(cloud, recoloured)
    touched = out.join(touched_ids, "splat_id", "left_semi")
    out = with_updates(out, confirm(touched, dirty, weight, F.lit(ts), cfg).select(*out.columns))
    median = out.agg(F.median("scale")).first()[0]
    new = spawn(seen.filter("vehicle"), image, cfg, max(0, cfg.max_splats - n))
    new = unproject(new.withColumns({"u": F.col("px").cast("double"), "v": F.col("py").cast("double")}), pose, k)
    top = cloud.agg(F.max("splat_id")).first()[0]
    values = {"splat_id": F.lit(top) + 1 + F.col("py") * k.width + F.col("px"), "scale": F.lit(median), "opacity": F.lit(0.9), "provenance": F.lit(OBSERVED), "confidence": F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.lit(0.3 * weight))), "view_count": F.lit(1), "last_seen_ts": F.lit(ts), **{c: F.col(f"o_{c}") for c in "rgb"}}
    new = new.withColumns(values)
    extra = [c for c in cloud.columns if c not in new.columns]
    new = new.withColumns({c: F.lit(cloud.select(c).first()[0]) if c == "vehicle_id" else F.lit(None).cast(dict(cloud.dtypes)[c]) for c in extra})
    new = new.select(*[F.col(c).cast(dict(out.dtypes)[c]).alias(c) for c in out.columns])
    out = prune(out.unionByName(new))
    return out, _report(dirty, touched_ids, new)


def _report(dirty: DataFrame, touched: DataFrame, new: DataFrame) -> dict:
    """The counts of a frame, in one job."""
    parts = [df.select(F.lit(n).alias("k")) for n, df in (("dirty", dirty), ("touched", touched), ("spawned", new))]
    counts = {r.k: r["count"] for r in parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k").count().collect()}
    return {"accepted": True, "reason": "", **{n: counts.get(n, 0) for n in ("dirty", "touched", "spawned")}}
