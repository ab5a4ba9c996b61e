"""What surrounds joint refinement: which splats may move, which guesses are confirmed by it, and when it is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cloud import OBSERVED, PRIOR


def split_optimizable(cloud: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(splats that some frame sees, the rest, which stay as they are)."""
    seen = counts.filter("seen > 0").select("splat_id")
    return cloud.join(seen, "splat_id", "left_semi"), cloud.join(seen, "splat_id", "left_anti")


def promote(cloud: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """Guesses seen by enough frames become observed; adds promoted."""
    out = cloud.join(counts.select("splat_id", "seen"), "splat_id", "left")
    out = out.withColumn("promoted", (F.coalesce("seen", F.lit(0)) >= least) & (F.col("provenance") == PRIOR))
    return out.withColumn("provenance", F.when(F.col("promoted"), OBSERVED).otherwise(F.col("provenance"))).drop("seen")


def assemble(cloud: DataFrame, raw: DataFrame) -> DataFrame:
    """Refined raw parameters (logit opacity, log scale, quaternion, colour) back into the cloud; metadata stays."""
    from .cloud import with_updates

    size = F.sqrt(sum((F.col(f"q{c}") * F.col(f"q{c}") for c in "xyz"), F.col("qw") * F.col("qw")))
    own = raw.withColumns({"opacity": 1 / (1 + F.exp(-F.col("opacity"))), "scale": F.exp("scale"), **{f"q{c}": F.col(f"q{c}") / F.greatest(size, F.lit(1e-12)) for c in "wxyz"}, **{c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in "rgb"}})
    return with_updates(cloud, own.select("splat_id", *[c for c in own.columns if c in cloud.columns and c != "splat_id"]))


def due(frames: Column, consolidated: Column, enabled: bool = True, least: int = 24) -> Column:
    return F.lit(enabled) & (frames >= least) & (frames > consolidated)


def ui_state(running: Column, consolidated: Column) -> Column:
    return F.when(running, "refining").when(consolidated > 0, "ready").otherwise("none")


def reset_opacity(most: float = 0.05) -> Column:
    """Opacities held down after new splats were added, as logits; training brings the needed ones back."""
    from .geometry import logit

    return F.least(logit(F.col("opacity")), logit(F.lit(most)))
