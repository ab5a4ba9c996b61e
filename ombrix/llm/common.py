"""What the corpus operators share: tables in the shared folder, row keys, sizing, hashing.

Conventions that every operator keeps:

* only the columns an operator needs are read, so further columns (whatever their names) never clash;
* intermediate results that are needed twice are written to the folder named in ``spark.checkpoint.dir``;
  a lost executor then costs a re-read, never a re-computation of everything before;
* documents are addressed by a unique ``uid`` that sorts as (doc_id, text) does (see :func:`with_uid`).
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; its arrays take some 50 times as much.
BLOCK_BYTES = 1 << 20

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    own = tempfile.mkdtemp(prefix="ombrix-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ombrix-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches of at most ``most`` bytes, so that a task's memory does not depend on how long texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).lower().rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= most:
        spark.conf.set(key, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def source_bytes(df: DataFrame) -> int:
    """The planner's estimate of the input's size; used for partition counts only, never for results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 12) -> int:
    """Partitions for a shuffle of about the input's size, at the session's number at least."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = source_bytes(df)
    if size >= 1 << 55:  # the planner knows no size, as for rows that come from the driver
        size = 0
    return max(least, own if own < 200 else least, math.ceil(size / bytes_each))


def apart_from_uid(docs: DataFrame, stage) -> DataFrame:
    """stage(docs), for stages that number rows by ``uid``: a column of that name, in any case of letters, steps aside meanwhile."""
    names = docs.columns
    aside = [f"_{i}_{uuid.uuid4().hex}" if c.lower() == "uid" else c for i, c in enumerate(names)]
    return stage(docs.toDF(*aside)).select(*aside).toDF(*names)


def with_uid(docs: DataFrame, *more: str) -> DataFrame:
    """(uid, doc_id, text, *more): uid is unique and ascends as (doc_id, hash of the text, text), null doc_id first.

    Where doc_id has neither nulls nor repeats, as it should, uid is doc_id. Otherwise rows are range-sorted
    and numbered once, and the numbered table is kept in the shared folder; repeated rows stay separate rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    n, ids, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        return docs.withColumn("uid", F.col("doc_id"))
    keys = ["doc_id", F.xxhash64("text"), "text"]
    sorted_ = docs.repartitionByRange(buckets_for(docs), *keys).sortWithinPartitions(*keys)
    return written(sorted_.withColumn("uid", F.monotonically_increasing_id()), "numbered")


def ranked(df: DataFrame, keys: list[str], order: list, name: str, rows_each: int = 1 << 20, total: int | None = None) -> DataFrame:
    """Adds ``name``: the gapless rank from 0 within ``keys`` by (salt, order).

    A plain window would put all rows of a hot key in one task. Rows are dealt to salts by a hash of ``order``,
    ranked inside (keys, salt), and the salts' sizes are summed up and added. ``order`` must identify a row.
    """
    from pyspark.sql import Window as W

    total = df.count() if total is None else total
    salts = max(64, math.ceil(total / rows_each))
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, "_salt", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_salt")) - F.col("_n")).alias("_before"))
    inner = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)) - 1)
    return inner.join(before, [*keys, "_salt"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_salt", "_rank", "_before")


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return lambda _: 0


def tidy() -> None:
    """Gives unused memory back to the system. Python workers outlive their tasks, and an executor's limit covers them all."""
    global _trim
    _trim = _trim or _trimmer()
    pa.default_memory_pool().release_unused()
    _trim(0)


_trim = None


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 random odd-free 64-bit values, the same on every machine."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: Bytes of a span that are mixed array-wise; longer spans are digested one by one.
_SHORT = 512
_MASK8 = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(buf: np.ndarray) -> np.ndarray:
    """Of each place of ``buf`` the 8 bytes from there on, as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


class SpanHasher:
    """64-bit hashes of byte spans of a buffer, all at once: every 8 bytes go through a full mixing step.

    Spans beyond 512 bytes add a BLAKE2 digest of their rest. Whoever needs equality of spans compares them (:func:`same_spans`).
    """

    def __init__(self, seed: int = 11):
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 & _MASK)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        words = words_of(buf) if words is None else words
        n = ends - starts
        h = n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + self.seed
        own, at, left = slice(None), starts, n
        for done in range(0, _SHORT, 8):
            h[own] = mix64(h[own] ^ (words[at] & _MASK8[np.minimum(left, 8)]))
            more = np.flatnonzero(n > done + 8) if done == 0 else own[left > 8]
            if not len(more):
                return h
            own, at, left = more, starts[more] + done + 8, n[more] - done - 8
        for i in own.tolist():
            rest = hashlib.blake2b(buf[starts[i] + _SHORT : ends[i]].tobytes(), digest_size=8).digest()
            h[i : i + 1] = mix64(h[i : i + 1] ^ np.frombuffer(rest, np.uint64))
        return h


def same_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: np.ndarray, words_a=None, words_b=None) -> np.ndarray:
    """Whether the n bytes of ``a`` from at_a on equal those of ``b`` from at_b on, for all spans at once."""
    words_a = words_of(a) if words_a is None else words_a
    words_b = words_of(b) if words_b is None else words_b
    same = np.ones(len(n), bool)
    own = np.flatnonzero(n > 0)
    for done in range(0, _SHORT, 8):
        left = np.minimum(n[own] - done, 8)
        same[own] = (words_a[at_a[own] + done] ^ words_b[at_b[own] + done]) & _MASK8[left] == 0
        own = own[same[own] & (n[own] > done + 8)]
        if not len(own):
            return same
    for i in own.tolist():
        same[i] = bool((a[at_a[i] + _SHORT : at_a[i] + n[i]] == b[at_b[i] + _SHORT : at_b[i] + n[i]]).all())
    return same
