"""Point-cloud files. Columns are computed in SQL; bytes are written from sorted rows, a batch at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import logit, rgb_to_sh_dc

#: Tints of observed and guessed splats.
TINTS = {"r": (0.25, 0.95), "g": (0.80, 0.35), "b": (0.40, 0.25)}
SH_REST = 45
#: Rows that a range of the significance order holds, about, and sampled rows for each bound between ranges.
RANGE_ROWS, BOUND_ROWS, MOST_RANGES = 1 << 14, 64, 4096


def provenance_tint(cloud: DataFrame) -> DataFrame:
    """Colours by provenance, brighter with confidence."""
    shade = 0.35 + 0.65 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return cloud.withColumns({c: F.when(F.col("provenance") == 1, a).otherwise(b) * shade for c, (a, b) in TINTS.items()})


def by_significance(cloud: DataFrame) -> DataFrame:
    """Adds opacity times volume, by which the compact file is sorted."""
    return cloud.withColumn("significance", F.col("opacity") * F.col("scale") * F.col("scale") * F.col("scale"))


def significance_order(cloud: DataFrame, name: str = "ord") -> DataFrame:
    """Adds significance and ``name``: each splat's place from 1 in the compact file, by (significance descending, splat_id).

    Rows are dealt to ranges of that order, placed inside their range, and the sizes of the ranges before are added.
    A sample gives the ranges' bounds only; every row is placed. Rows without significance come last.
    """
    cloud = by_significance(cloud)
    n = cloud.count()
    ranges = max(64, min(MOST_RANGES, n // RANGE_ROWS))
    sample = cloud.filter(F.col("significance").isNotNull() & F.col("splat_id").isNotNull() & (F.pmod(F.xxhash64("splat_id"), F.lit(max(1, n // (BOUND_ROWS * ranges)))) == 0))
    rows = sample.select("significance", "splat_id").orderBy(F.desc("significance"), "splat_id").collect()
    bounds = [rows[i * len(rows) // ranges] for i in range(1, ranges)] if rows else []
    range_ = F.lit(0)
    if bounds:
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        values, ids = F.lit(np.array([float(r.significance) for r in bounds])), F.lit(np.array([r.splat_id for r in bounds], np.int64))

        def bisect(at, step):  # the bounds that come before a row
            value, own = F.try_element_at(values, at + step), F.try_element_at(ids, at + step)
            after = F.col("significance").isNull() | (value > F.col("significance")) | ((value == F.col("significance")) & (own < F.col("splat_id")))
            return F.when((at + step <= len(bounds)) & after, at + step).otherwise(at)

        range_ = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), bisect)
    cloud = cloud.withColumn("_range", range_)
    sizes = cloud.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    inner = cloud.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(F.desc("significance"), "splat_id")))
    return inner.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")


def _with_defaults(cloud: DataFrame) -> DataFrame:
    extra = {"qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)}
    return cloud.withColumns({k: v for k, v in extra.items() if k not in cloud.columns})


def ply_columns(cloud: DataFrame) -> DataFrame:
    """The values that a splat's row in a .ply holds: logits, logarithms and the constant colour band."""
    log = F.ln(F.greatest(F.col("scale"), F.lit(1e-9)))
    out = _with_defaults(cloud).withColumns({f"f_dc_{i}": rgb_to_sh_dc(F.col(c)) for i, c in enumerate("rgb")})
    return out.withColumns({"opacity": logit(F.col("opacity")), **{f"scale_{i}": log for i in range(3)}, **{f"rot_{i}": F.col(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))}, **{n: F.lit(0.0) for n in ("nx", "ny", "nz")}})


def _fields(rest: bool) -> list[str]:
    return ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", *([f"f_rest_{i}" for i in range(SH_REST)] if rest else []), "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def write_ply(cloud: DataFrame, path: str | Path, sh_rest: bool = True) -> int:
    """A binary little-endian .ply in order of splat_id; the higher bands only if some are not zero. Returns rows.

    One file has one writer: rows are streamed to the driver partition by partition, never held together.
    """
    rest = sh_rest and "sh_rest" in cloud.columns and bool(cloud.filter(F.exists("sh_rest", lambda c: c != 0)).limit(1).count())
    out = ply_columns(cloud)
    if rest:  # coefficients are stored band by band, the file wants channel by channel
        out = out.withColumns({f"f_rest_{c * 15 + k}": F.coalesce(F.element_at("sh_rest", k * 3 + c + 1), F.lit(0.0)) for c in range(3) for k in range(15)})
    names = _fields(rest)
    n = cloud.count()
    pack = struct.Struct(f"<{len(names)}f").pack
    with open(path, "wb") as f:
        f.write(("ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property float {c}\n" for c in names) + "end_header\n").encode())
        for row in _ordered(out.orderBy("splat_id").select(*names)):
            f.write(pack(*row))
    return n


def write_splat(cloud: DataFrame, path: str | Path) -> int:
    """32 bytes a splat, the most significant first: position, scale, colour and opacity, rotation."""
    out = by_significance(_with_defaults(cloud)).orderBy(F.desc("significance"), "splat_id")
    size = F.sqrt(sum((F.col(f"q{c}") * F.col(f"q{c}") for c in "xyz"), F.col("qw") * F.col("qw")))
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))).cast("int")
    out = out.select("x", "y", "z", "scale", *[byte(F.col(c) * 255).alias(c) for c in ("r", "g", "b", "opacity")], *[byte(F.when(size > 0, F.col(f"q{c}") / size).otherwise(F.lit(1.0 if c == "w" else 0.0)) * 128 + 128).alias(f"q{c}") for c in "wxyz"])
    pack, n = struct.Struct("<6f8B").pack, 0
    with open(path, "wb") as f:
        for x, y, z, s, *rest in _ordered(out):
            f.write(pack(x, y, z, s, s, s, *rest))
            n += 1
    return n


def write_provenance_ply(cloud: DataFrame, path: str | Path) -> int:
    return write_ply(provenance_tint(cloud), path, sh_rest=False)


def export_all(cloud: DataFrame, folder: str | Path) -> dict[str, str]:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    paths = {"ply": folder / "cloud.ply", "splat": folder / "cloud.splat", "provenance": folder / "provenance.ply"}
    write_ply(cloud, paths["ply"])
    write_splat(cloud, paths["splat"])
    write_provenance_ply(cloud, paths["provenance"])
    return {k: str(v) for k, v in paths.items()}


def _ordered(df: DataFrame) -> Iterator:
    return df.toLocalIterator(prefetchPartitions=True)
