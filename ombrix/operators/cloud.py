"""Row-set algebra on splat tables: every function takes and returns a DataFrame and leaves its input alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR, OBSERVED = 0, 1

FIELDS = ("x", "y", "z", "scale", "qw", "qx", "qy", "qz", "opacity", "r", "g", "b", "sh_rest", "provenance", "confidence", "view_count", "last_seen_ts")

#: What a new splat has where its source has no such column.
DEFAULTS = {
    "scale": 0.01,
    "qw": 1.0,
    "qx": 0.0,
    "qy": 0.0,
    "qz": 0.0,
    "opacity": 0.9,
    "provenance": PRIOR,
    "confidence": 0.1,
    "view_count": 0,
    "last_seen_ts": 0.0,
}


def create(points: DataFrame, **columns: Column | float) -> DataFrame:
    """Fills missing columns with DEFAULTS; a given value or column holds for every row."""
    out = points.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()})
    return out.withColumns({k: F.lit(v) for k, v in DEFAULTS.items() if k not in out.columns})


def select_rows(cloud: DataFrame, condition: Column) -> DataFrame:
    return cloud.filter(condition)


def gather(cloud: DataFrame, ids: DataFrame, order: str = "ord") -> DataFrame:
    """Rows by ids(splat_id, ord), in that order and as often as an id is listed."""
    return ids.join(cloud, "splat_id").orderBy(order)


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """A bag union; rows of ``b`` follow (ord_part says so)."""
    return a.withColumn("ord_part", F.lit(0)).unionByName(b.withColumn("ord_part", F.lit(1)), allowMissingColumns=True)


def with_updates(cloud: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Overwrites the columns that ``updates`` has, by splat_id; of several rows for an id the last by ``order`` wins,
    without ``order`` the largest by the updated columns, so that every run gives the same."""
    names = [c for c in updates.columns if c not in ("splat_id", order)]
    if unknown := set(names) - set(cloud.columns):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    new = F.struct(*names)
    last = updates.groupBy("splat_id").agg((F.max_by(new, F.col(order)) if order else F.max(new)).alias("_new"))
    joined = cloud.join(last, "splat_id", "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in cloud.columns])


def observed_fraction() -> Column:
    return F.coalesce(F.avg((F.col("provenance") == OBSERVED).cast("double")), F.lit(0.0))


def stats(cloud: DataFrame, *keys: str) -> DataFrame:
    """Counts by provenance and rounded means; without keys an empty cloud still gives its row of zeros."""
    return (cloud.groupBy(*keys) if keys else cloud).agg(
        F.count(F.lit(1)).alias("splats"),
        F.count_if(F.col("provenance") == OBSERVED).alias("observed"),
        F.count_if(F.col("provenance") == PRIOR).alias("prior"),
        F.round(observed_fraction(), 4).alias("observed_fraction"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("mean_confidence"),
    )


def is_view_dependent(cloud: DataFrame) -> DataFrame:
    return cloud.agg(F.coalesce(F.bool_or(F.exists("sh_rest", lambda c: c != 0)), F.lit(False)).alias("view_dependent"))


def prune(cloud: DataFrame, opacity: float = 0.05) -> DataFrame:
    return cloud.filter(F.col("opacity") > opacity)


def merge(primary: DataFrame, duplicate: DataFrame) -> DataFrame:
    """What was observed on the duplicate joins the primary; guesses on it are worth nothing there."""
    return primary.unionByName(duplicate.filter(F.col("provenance") == OBSERVED))


def rollup(vehicles: DataFrame, cloud: DataFrame) -> DataFrame:
    """One row per vehicle, with zeros where it has no cloud."""
    own = stats(cloud, "vehicle_id")
    out = vehicles.join(own, "vehicle_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in own.dtypes if c != "vehicle_id"})


def mesh_concat(vertices: list[DataFrame], faces: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Meshes in one: vertex ids, and what faces refer to, move up by the vertices before."""
    base, v_out, f_out = 0, [], []
    for v, f in zip(vertices, faces, strict=True):
        v_out.append(v.withColumn("id", F.col("id") + base))
        f_out.append(f.withColumns({c: F.col(c) + base for c in ("i", "j", "k")}))
        base += v.count()
    return reduce(DataFrame.unionByName, v_out), reduce(DataFrame.unionByName, f_out)


def require(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` if it has these columns of these types, else ValueError naming what is wrong."""
    have = dict(df.dtypes)
    if wrong := {c: (t, have.get(c)) for c, t in columns.items() if have.get(c) != t}:
        raise ValueError(f"columns (wanted, found): {wrong}")
    return df
