"""Motion-driven frame sampling, hold-outs, batches, and area-weighted sampling of meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sample_frames(frames: DataFrame, key: str, order: list[str], motion: str, threshold: float = 12.0, most: int = 60, gap: int = 2) -> DataFrame:
    """The first frame of each clip, then each whose accumulated motion reaches the threshold after ``gap`` frames at least.

    A fold over the clip's frames in order, as one expression; stops once ``most`` frames are kept after one was
    added. A clip's frames must fit a task; for unbounded streams see ombrix.streaming.
    """
    clip = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(motion).cast("double").alias("_m")))).alias("f"))
    kind = clip.schema["f"].dataType.elementType

    def step(s: Column, f: Column) -> Column:
        acc, n = s["acc"] + f["_m"], s["gap"] + 1
        first = s["n"] == 0
        take = first | ((acc >= threshold) & (n >= gap))
        go = s["open"]
        zero = F.lit(0.0)
        kept = F.when(go & take, F.concat(s["kept"], F.array(F.struct(f.alias("frame"), F.when(first, zero).otherwise(acc).alias("motion"))))).otherwise(s["kept"])
        count = s["n"] + (go & take).cast("int")
        return F.struct(
            F.when(take, zero).otherwise(acc).alias("acc"),
            F.when(take, F.lit(0)).otherwise(n).alias("gap"),
            count.alias("n"),
            (go & ~(take & ~first & (count >= most))).alias("open"),
            kept.alias("kept"),
        )

    empty = F.struct(F.lit(0.0).alias("acc"), F.lit(0).alias("gap"), F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast(f"array<struct<frame:{kind.simpleString()},motion:double>>").alias("kept"))
    kept = clip.select(key, F.explode(F.aggregate("f", empty, step)["kept"]).alias("k"))
    return kept.select(key, *[F.col(f"k.frame.{o}").alias(o) for o in order], F.col("k.motion").alias("motion"))


def split_holdout(frames: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds held_out: the last max(1, n // 5) frames of each object, none of a single one."""
    w = W.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    back = F.row_number().over(w.orderBy(*[F.desc(o) for o in order]))
    return frames.withColumn("held_out", (n > 1) & (back <= F.least(F.greatest(F.lit(1), F.floor(n / 5)), n - 1)))


def round_robin(n: int, batch: int, steps: DataFrame) -> DataFrame:
    """steps(it) to (it, frame): consecutive frames modulo n, min(batch, n) of them."""
    k = min(batch, n)
    return steps.withColumn("frame", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("it") * batch + i) % n)))


def sh_degree(it: Column, total: int) -> Column:
    return F.least((it / total * 4).cast("int"), F.lit(3))


def sample_surface(faces: DataFrame, count: int, seed: int = 7) -> DataFrame:
    """``count`` points by area with replacement: faces(id, ax..cz) to (point, face, x, y, z, area).

    A running sum of areas is cut at hashed uniforms. The sum's range is dealt into as many cells as there are faces; a
    face lies in the cells it reaches, and points find theirs by an equi-join on the cell. Also w0, w1, w2 (the corners'
    shares of a point) and total (the mesh's area).
    """
    a, b, c = ([F.col(f"{p}{i}") for i in "xyz"] for p in "abc")
    from .geometry import cross, dot

    n = cross([q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)])
    faces = faces.withColumn("area", F.sqrt(dot(n, n)) / 2)
    total, n = faces.agg(F.sum("area"), F.count(F.lit(1))).first()
    if not total:
        raise ValueError("the mesh has no area")
    upto = faces.withColumn("hi", F.sum("area").over(W.orderBy("id"))).withColumn("lo", F.col("hi") - F.col("area"))
    last = upto.agg(F.max("hi")).first()[0]  # the running sum's own end, so that no uniform falls beyond it
    cell = lambda at: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(at * (n / last))))
    upto = upto.withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))

    def uniform(k: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) / float(1 << 53)

    points = faces.sparkSession.range(count).withColumns({"at": uniform(0) * last, "r1": F.sqrt(uniform(1)), "r2": uniform(2)}).withColumnRenamed("id", "point")
    hit = points.withColumn("_cell", cell(F.col("at"))).join(upto.withColumnRenamed("id", "face"), "_cell").filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    w = [1 - F.col("r1"), F.col("r1") * (1 - F.col("r2")), F.col("r1") * F.col("r2")]
    return hit.select("point", "face", *[(w[0] * F.col(f"a{i}") + w[1] * F.col(f"b{i}") + w[2] * F.col(f"c{i}")).alias(i) for i in "xyz"], "area", *[v.alias(f"w{i}") for i, v in enumerate(w)], F.lit(float(total)).alias("total"))
