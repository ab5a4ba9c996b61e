"""Folder names from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Device names that no folder may have.
RESERVED = ("con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9")
MOST = 64


def sanitize(name: Column) -> Column:
    """A lower-case slug of letters, digits, dots, underscores and hyphens; ``vehicle`` where nothing is left."""
    low = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")), "'", "")
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    safe = F.when(slug == "", "vehicle").when(slug.isin(*RESERVED), F.concat(F.lit("vehicle-"), slug)).otherwise(slug)
    return F.left(safe, F.lit(MOST))


def unique_folders(names: DataFrame, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds ``folder``: the slug for the first row of each slug, then slug-2, slug-3 and so on.

    taken(folder): names in use already; a slug's rows then go on after the largest number that is taken.
    """
    out = names.withColumn("slug", sanitize(F.col(name)))
    at = F.row_number().over(W.partitionBy("slug").orderBy(order))
    if taken is not None:
        parts = taken.select(F.regexp_extract("folder", r"^(.*?)(?:-(\d+))?$", 1).alias("slug"), F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(folder, '-(\\d+)$', 1), '') as int)"), F.lit(1)).alias("n"))
        out = out.join(parts.groupBy("slug").agg(F.max("n").alias("used")), "slug", "left")
        at = at + F.coalesce("used", F.lit(0))
    return out.withColumn("folder", F.when(at == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", at.cast("string"))))
