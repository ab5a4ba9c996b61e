"""Assets on disk: clouds partitioned by vehicle, manifests, frames, uploads and the event log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ombrix.functions.naming import sanitize

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("vehicle", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    ]
)
MANIFEST_SCHEMA = "name string, vehicle_id string, aliases array<string>, created_ts double, updated_ts double, consolidated_frames int"
REQUIRED = ("splat_id", "x", "y", "z", "r", "g", "b", "scale", "opacity", "provenance", "confidence", "view_count", "last_seen_ts")
#: Suffixes that uploads may have.
IMAGES = (".bmp", ".jpeg", ".jpg", ".png", ".webp")
VIDEOS = (".avi", ".m4v", ".mkv", ".mov", ".mp4", ".webm")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log's lines with ``seq``, the order in which they were appended; blank and broken lines give nothing.

    Lines without ``seq``, as of a file written elsewhere, come first in the order of that file.
    """
    raw = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    out = raw.select(F.from_json("value", T.StructType([*EVENT_SCHEMA.fields, T.StructField("seq", T.LongType())])).alias("e"), "_line").filter("e.event_id is not null").select("e.*", "_line")
    return out.withColumn("seq", F.coalesce("seq", F.col("_line") - (1 << 62))).drop("_line")


def append_events(events: DataFrame, path: str) -> None:
    """Appends after all that the log holds: ``seq`` goes on from its largest, in the order of ts and event_id."""
    from pyspark.sql import Window as W

    spark = events.sparkSession
    try:
        top = read_events(spark, path).agg(F.max("seq")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        top = None
    base = 0 if top is None else max(top, -1) + 1
    at = F.row_number().over(W.orderBy("ts", "event_id")) - 1  # an append is what one request logs
    events.select(*[f.name for f in EVENT_SCHEMA], (F.lit(base) + at).cast("long").alias("seq")).write.mode("append").json(path)


def newest_events(events: DataFrame, limit: int = 0) -> DataFrame:
    out = events.orderBy(F.desc("seq"), F.desc("ts"), F.desc("event_id"))
    return out.limit(limit) if limit else out


def save_cloud(cloud: DataFrame, path: str) -> None:
    """Replaces the partitions of the vehicles in ``cloud`` and leaves all others alone."""
    cloud.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vehicle_id").parquet(path)


def load_cloud(spark: SparkSession, path: str) -> DataFrame:
    """A saved cloud of any age: without sh_rest it is matte; any other missing column is an error."""
    out = spark.read.option("mergeSchema", "true").parquet(path)
    if missing := [c for c in REQUIRED if c not in out.columns]:
        raise KeyError(f"the cloud lacks {missing}")
    return out if "sh_rest" in out.columns else out.withColumn("sh_rest", F.lit(None).cast("array<float>"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(folder, manifest fields) of every live vehicle; what cannot be parsed is null."""
    files = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("folder"), F.from_json("value", MANIFEST_SCHEMA).alias("m"))
    return files.filter(~F.startswith("folder", F.lit("_"))).select("folder", "m.*").orderBy("folder")


def reject_reason(name: Column, suffix: Column, size: Column, most_mb: float = 256.0) -> Column:
    """Why an upload is refused, null if it is taken."""
    known = F.lower(suffix).isin(*IMAGES, *VIDEOS)
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "400 blank name").when(size > most_mb * 1024 * 1024, "413 too large").when(~known, "400 unknown suffix")


def upload_names(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """uploads(upload_id, stem, suffix) with a file name that overwrites nothing: stem, stem-2, stem-3 ..."""
    from pyspark.sql import Window as W

    base = taken.select(F.regexp_extract("file", r"^(.*?)(?:-(\d+))?(\.[^.]*)$", 1).alias("stem"), F.regexp_extract("file", r"(\.[^.]*)$", 1).alias("suffix"), F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(file, '-(\\d+)\\.[^.]*$', 1), '') as int)"), F.lit(1)).alias("n"))
    used = base.groupBy("stem", "suffix").agg(F.max("n").alias("used"))
    out = uploads.join(used, ["stem", "suffix"], "left")
    at = F.row_number().over(W.partitionBy("stem", "suffix").orderBy("upload_id")) + F.coalesce("used", F.lit(0))
    return out.withColumn("file", F.concat(F.when(at == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", at.cast("string"))), "suffix")).drop("used")


def add_frames(frames: DataFrame, new: DataFrame) -> DataFrame:
    """Appends frames with the indices that follow."""
    from pyspark.sql import Window as W

    top = frames.groupBy("vehicle_id").agg((F.max("index") + 1).alias("base"))
    at = F.row_number().over(W.partitionBy("vehicle_id").orderBy("ts")) - 1
    own = new.join(top, "vehicle_id", "left").withColumn("index", (F.coalesce("base", F.lit(0)) + at).cast("int")).drop("base")
    return frames.unionByName(own, allowMissingColumns=True)


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, px, py, r, g, b): the pixels of image files, in [0, 1]; files that are no images are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    at = image.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + (k + 1), F.lit(1))), 16, 10).cast("double") / 255
    return at.filter("nChannels >= 3").select("origin", (F.col("i") % F.col("width")).alias("px"), F.floor(F.col("i") / F.col("width")).cast("int").alias("py"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def folder_of(name: Column) -> Column:
    return sanitize(name)
