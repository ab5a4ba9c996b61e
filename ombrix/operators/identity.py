"""Identity: mean embeddings, likeness, duplicates, merges and the event log's queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_embedding(embeddings: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """(key, dim, mean vector of length one); a zero mean stays as it is. Explodes by component, so partial sums shuffle."""
    parts = embeddings.select(key, F.posexplode("embedding").alias("pos", "v")).groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    size = norm(F.col("mean"))
    return mean.withColumn("mean", F.when(size > 0, F.transform("mean", lambda v: v / size)).otherwise(F.col("mean")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 within [0, 1]; 0 where either is null, empty or zero."""
    inner = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (inner / size + 1) / 2))).otherwise(0.0)


def similar_pairs(means: DataFrame, threshold: float, key: str = "vehicle_id") -> DataFrame:
    """Pairs (a, b), a < b, of likeness at or over the threshold: every vehicle against every later one.

    ``means`` has a row per vehicle. Where that is many, pre-filter with a random projection index and verify here.
    """
    a, b = means.select(F.col(key).alias("a"), F.col("mean").alias("ma")), means.select(F.col(key).alias("b"), F.col("mean").alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", similarity(F.col("ma"), F.col("mb")).alias("score")).filter(F.col("score") >= threshold)


def pick_primary(pairs: DataFrame, vehicles: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """The older of a pair; ties, and unknown ages, go to the first."""
    age = vehicles.select(F.col(key), "created_ts")
    out = pairs.join(age.withColumnsRenamed({key: "a", "created_ts": "ta"}), "a", "left").join(age.withColumnsRenamed({key: "b", "created_ts": "tb"}), "b", "left")
    second = F.coalesce(F.col("tb") < F.col("ta"), F.lit(False))
    return out.withColumns({"primary_id": F.when(second, F.col("b")).otherwise(F.col("a")), "duplicate_id": F.when(second, F.col("a")).otherwise(F.col("b"))}).drop("ta", "tb")


def merge_aliases(pairs: DataFrame, vehicles: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Per merge the primary's aliases with the duplicate's name and aliases added once each, order kept, and the later update."""
    v = vehicles.select(key, "name", "aliases", "updated_ts")
    p = v.withColumnsRenamed({c: f"p_{c}" for c in v.columns})
    d = v.withColumnsRenamed({c: f"d_{c}" for c in v.columns})
    out = pairs.join(p, F.col("primary_id") == F.col(f"p_{key}")).join(d, F.col("duplicate_id") == F.col(f"d_{key}"))
    named = F.array_distinct(F.concat("p_aliases", F.array("d_name"), "d_aliases"))
    return out.select("primary_id", "duplicate_id", F.filter(named, lambda a: a.isNotNull() & (a != "") & (a != F.col("p_name"))).alias("aliases"), F.greatest("p_updated_ts", "d_updated_ts").alias("updated_ts"))


def pending_merges(log: DataFrame) -> DataFrame:
    """Merges that were proposed and neither done nor rejected later, newest first."""
    asked, done = log.filter("kind = 'merge_pending'"), log.filter("kind in ('merge', 'merge_rejected')")
    done = done.groupBy(F.col("pending_key").alias("k")).agg(F.max("ts").alias("last"))  # the latest answer decides
    return asked.join(done, (F.col("pending_key") == F.col("k")) & (F.col("last") > F.col("ts")), "left_anti").orderBy(F.desc("ts"), F.desc("event_id"))


def newest(log: DataFrame, limit: int = 0) -> DataFrame:
    """Newest first; a limit of 0 means all."""
    out = log.orderBy(F.desc("ts"), F.desc("event_id"))
    return out.limit(limit) if limit else out


def event_status(log: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(event_id) with 404 for what is no proposed merge, 409 for what is settled, 200 for the rest."""
    known = log.filter("kind = 'merge_pending'").select("event_id").withColumn("known", F.lit(True))
    still = pending_merges(log).select("event_id").withColumn("still", F.lit(True))
    out = asked.join(known, "event_id", "left").join(still, "event_id", "left")
    return out.select("event_id", F.when(F.col("known").isNull(), 404).when(F.col("still").isNull(), 409).otherwise(200).alias("status"))


def resolve(wanted: DataFrame, vehicles: DataFrame) -> DataFrame:
    """wanted(query) to the first vehicle by folder: folder itself before name or alias, in any case of letters."""
    by_folder = vehicles.select("folder", "vehicle_id", F.lit(0).alias("priority"), F.col("folder").alias("found"))
    names = vehicles.select("folder", "vehicle_id", F.lit(1).alias("priority"), F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), F.lower))).alias("found"))
    exact = wanted.join(by_folder, F.col("query") == F.col("found"))
    loose = wanted.join(names, F.lower("query") == F.col("found"))
    best = exact.unionByName(loose).groupBy("query").agg(F.min_by("vehicle_id", F.struct("priority", "folder")).alias("vehicle_id"))
    return wanted.join(best, "query", "left")
