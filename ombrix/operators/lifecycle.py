"""The life of assets: observations, scans for duplicates, merges, retirement, reports and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cloud as clouds
from .identity import pick_primary


def add_observations(history: DataFrame, new: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """A history(key, seq, ..) with the new rows after it, in order of ts and observation_id."""
    top = history.groupBy(key).agg((F.max("seq") + 1).alias("_base"))
    at = F.row_number().over(W.partitionBy(key).orderBy("ts", "observation_id")) - 1
    own = new.join(top, key, "left").withColumn("seq", (F.coalesce("_base", F.lit(0)) + at).cast("long")).drop("_base")
    return history.unionByName(own)


def seen_at(cloud: DataFrame, frames: DataFrame, order: list[str], key: str = "vehicle_id") -> DataFrame:
    """last_seen_ts = base_ts + frame_ts of the last frame in order of updates, which may be earlier than the one before."""
    last = frames.groupBy(key).agg(F.max_by(F.col("base_ts") + F.col("frame_ts"), F.struct(*order)).alias("_ts"))
    return cloud.join(last, key, "left").withColumn("last_seen_ts", F.coalesce("_ts", F.col("last_seen_ts"))).drop("_ts")


def scan(candidates: DataFrame, vehicles: DataFrame, auto: bool, key: str = "vehicle_id") -> DataFrame:
    """candidates(folder, other, score) of scanned objects to events (folder, ord, kind, primary_id, duplicate_id, score), best first.

    Without ``auto`` each candidate is proposed. With it they are merged in turn, until the scanned object itself is
    the duplicate of one and is gone. Each scan sees the assets as they are; two scans are two calls.
    """
    pairs = candidates.select(F.col("folder").alias("a"), F.col("other").alias("b"), "score")
    alive = vehicles.select(key)
    pairs = pairs.join(alive.withColumnRenamed(key, "a"), "a", "left_semi").join(alive.withColumnRenamed(key, "b"), "b", "left_semi")
    w = W.partitionBy("folder").orderBy("ord")
    out = pick_primary(pairs, vehicles, key).withColumnRenamed("a", "folder")
    out = out.withColumn("ord", F.row_number().over(W.partitionBy("folder").orderBy(F.desc("score"), "b")))
    if auto:
        gone = F.max(F.when(F.col("duplicate_id") == F.col("folder"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn("_gone", gone).filter(F.coalesce("_gone", F.lit(0)) == 0).drop("_gone")
    return out.select("folder", "ord", F.lit("merge" if auto else "merge_pending").alias("kind"), "primary_id", "duplicate_id", "score")


def merge_events(pairs: DataFrame, cloud: DataFrame, pending: str | None = None, key: str = "vehicle_id") -> DataFrame:
    """pairs(primary_id, duplicate_id, score) to the merges' events, with the primary's splats before and after."""
    n = cloud.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("provenance") == clouds.OBSERVED).alias("o"))
    out = pairs.join(n.select(F.col(key).alias("primary_id"), F.col("n").alias("_n")), "primary_id", "left").join(n.select(F.col(key).alias("duplicate_id"), F.col("o").alias("_o")), "duplicate_id", "left")
    before = F.coalesce("_n", F.lit(0))
    return out.select(F.lit("merge").alias("kind"), "primary_id", "duplicate_id", "score", before.alias("splats_before"), (before + F.coalesce("_o", F.lit(0))).alias("splats_after"), (F.col(pending) if pending else F.lit("")).alias("pending_id"))


def reject_events(pending: DataFrame) -> DataFrame:
    """pending(pending_id, primary_id, duplicate_id) to the rejections' events."""
    return pending.select(F.lit("merge_rejected").alias("kind"), "primary_id", "duplicate_id", "pending_id")


def merged_rows(pairs: DataFrame, rows: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Histories or embeddings of merged assets: the duplicate's rows become the primary's."""
    moved = pairs.select(F.col("duplicate_id").alias(key), "primary_id")
    return rows.join(moved, key, "left").withColumn(key, F.coalesce("primary_id", key)).drop("primary_id")


def retire(folders: DataFrame, archived: DataFrame) -> DataFrame:
    """folders(folder) to ``archive``: its name there, with -2, -3 .. if that is taken. Nothing is deleted."""
    names = archived.select(F.col("archive").alias("_a"))
    first = folders.join(names, F.col("folder") == F.col("_a"), "left_semi").select("folder")
    free = folders.join(first, "folder", "left_anti").withColumn("archive", F.col("folder"))
    # the smallest number from 2 on that is free: one more than the first gap in the taken ones
    taken = first.join(names, F.expr("_a rlike '-[0-9]{1,9}$' and regexp_replace(_a, '-[0-9]+$', '') = folder")).select("folder", F.expr("try_cast(regexp_extract(_a, '-([0-9]+)$', 1) as int)").alias("k")).filter("k >= 2").distinct()
    run = taken.withColumn("_r", F.col("k") - F.row_number().over(W.partitionBy("folder").orderBy("k"))).filter("_r = 1").groupBy("folder").agg(F.max("k").alias("k"))
    again = first.join(run, "folder", "left").withColumn("archive", F.concat_ws("-", "folder", (F.coalesce("k", F.lit(1)) + 1).cast("string"))).drop("k")
    return free.unionByName(again)


MANIFEST = "name string, vehicle_id string, aliases array<string>, created_ts double, updated_ts double, consolidated_frames int"


def to_manifest(vehicles: DataFrame) -> DataFrame:
    """``manifest``: an object's own data as JSON."""
    return vehicles.withColumn("manifest", F.to_json(F.struct("name", "vehicle_id", "aliases", "created_ts", "updated_ts", "consolidated_frames")))


def from_manifest(column: Column) -> Column:
    return F.from_json(column, MANIFEST)


def report(counts: dict[str, Column], extras: dict[str, Column]) -> Column:
    """A frame's report as JSON: all counts, and of the extras those over 0."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in counts.items()], *[F.when(c > 0, c).alias(n) for n, c in extras.items()]))


def ingest_summary(frames: DataFrame, cloud: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Per object: frames sampled, fused and rejected (frames has ``accepted``), with the cloud's figures."""
    n = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames_sampled"), F.count_if("accepted").alias("frames_fused"), F.count_if(~F.col("accepted")).alias("frames_rejected"))
    return n.join(clouds.stats(cloud, key), key, "left")
