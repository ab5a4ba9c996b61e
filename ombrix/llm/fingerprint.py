"""Quartile bucket digests of byte triplets, and the comparison of a document with its neighbour and an edited self.

A sliding window of five bytes gives six triplets, each holding the window's first byte. A triplet's hash names one
of 256 buckets. The digest has the text's length (logarithmic), how the three quartiles of the bucket counts relate,
and for every bucket between which quartiles its count lies: two hex digits, two hex digits, and two bits each.
The difference of two digests adds up steps between quartiles, where the widest counts double, and is bounded;
likeness is one minus its share of what unrelated digests differ by on average, at least 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, buckets_for, documents, with_uid
from .pretoken import batches

BUCKETS = 256
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: Unrelated buckets lie in independent quartiles: steps of 1, 2 and 3 (which counts 6) add up to 26 / 16.
UNRELATED = BUCKETS * 26 / 16


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, BUCKETS) triplet counts. A text is worked on in blocks that overlap by a window less one byte."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for i, j in batches(texts, BLOCK_BYTES):
        for k in range(i, j, 1024):
            some = texts[k : min(k + 1024, j)]
            if len(some) == 1:
                for at in range(0, len(some[0]), BLOCK_BYTES):
                    counts[k] += _counts([some[0][at : at + BLOCK_BYTES + 4]], BLOCK_BYTES)[0]
            else:
                counts[k : k + len(some)] = _counts(some)
    return counts


def _counts(texts: list[bytes], starts: int | None = None) -> np.ndarray:
    """starts: only windows that begin before this place count."""
    buf = np.frombuffer(b"".join(texts) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    left = (ends[owner] - np.arange(n)).astype(np.int32) if n else np.zeros(0, np.int32)
    if starts is not None and n > starts:
        left[starts:] = 0
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    row = owner * BUCKETS
    for salt, (a, b) in enumerate(TRIPLETS):
        key = buf[:n] | (buf[a : a + n] << 8) | (buf[b : b + n] << 16)
        key = (key + np.uint32(0x3C6EF35F * (salt + 1) & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        bucket = ((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(24)
        whole = left > b
        if not whole.all():
            out += np.bincount(row[whole] + bucket[whole].astype(np.int32), minlength=len(out))
        else:
            out += np.bincount(row + bucket.astype(np.int32), minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def codes(texts: list[bytes]) -> np.ndarray:
    """(texts, 3 + BUCKETS) uint8: length step, two quartile ratios, quartile of each bucket."""
    counts = bucket_counts(texts)
    out = np.zeros((len(texts), 3 + BUCKETS), np.uint8)
    if not len(texts):
        return out
    cut = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out[:, 0] = np.minimum(255, np.floor(np.log1p(sizes) * 8))
    top = np.maximum(cut[:, 2], 1)
    out[:, 1], out[:, 2] = cut[:, 0] * 100 // top % 16, cut[:, 1] * 100 // top % 16
    out[:, 3:] = (counts[:, :, None] > cut[:, None, :]).sum(2)
    return out


def to_strings(code: np.ndarray) -> list[str]:
    packed = code[:, 3::4] | code[:, 4::4] << 2 | code[:, 5::4] << 4 | code[:, 6::4] << 6
    head = np.stack([code[:, 0], code[:, 1] << 4 | code[:, 2]], 1)
    return [r.tobytes().hex() for r in np.concatenate([head, packed], 1)]


def from_string(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    body = np.stack([raw[2:] >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()
    return np.concatenate([[raw[0], raw[1] >> 4, raw[1] & 15], body]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for such as differ as unrelated ones do; codes row by row."""
    a, b = np.atleast_2d(a).astype(np.int16), np.atleast_2d(b).astype(np.int16)
    steps = np.abs(a - b)
    body = steps[:, 3:].sum(1) + 3 * (steps[:, 3:] == 3).sum(1)
    length = np.minimum(steps[:, 0], 32)
    around = np.minimum(steps[:, 1:3], 16 - steps[:, 1:3]).sum(1)
    return np.maximum(0.0, 1.0 - (body + length + around) / UNRELATED)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(uid, doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document in
    the order of uid, and of the first document after the last. Null text is empty; equal texts have equal
    fingerprints; a single document is its own next one. An empty table gives no rows.

    Documents are dealt to ranges of uid, whose borders are uids themselves; the document on a border is also
    sent to the range before it, and the very first one to the last range, so every task finds each next document.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ranges = buckets_for(docs, 8 << 20)
    shares = F.lit(np.arange(1, ranges) / ranges)
    least, borders = docs.agg(F.min("uid"), F.percentile_approx("uid", shares, F.lit(max(10_000, 20 * ranges)))).first()
    if least is None:
        return spark.createDataFrame([], schema)
    borders = sorted(set(borders) - {least})  # fewer than ranges
    bounds = F.lit(np.array(borders, np.int64)) if borders else F.array().cast("array<long>")  # one literal, however many
    halvings = max(1, len(borders).bit_length())

    def below(found, step):  # binary search for the number of borders at or below uid
        return F.when((found + step <= len(borders)) & (F.get(bounds, found + step - 1) <= F.col("uid")), found + step).otherwise(found)

    search = F.aggregate(F.array(*[F.lit(1 << k) for k in range(halvings - 1, -1, -1)]), F.lit(0), below)
    dealt = docs.select("uid", "doc_id", "text").withColumn("part", search)
    border = F.get(bounds, F.col("part") - 1) == F.col("uid")
    homes = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")))
    homes = F.when(F.coalesce(border, F.lit(False)), F.concat(homes, F.array(F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("tail"))))).otherwise(homes)
    homes = F.when(F.col("uid") == least, F.concat(homes, F.array(F.struct(F.lit(len(borders)).alias("part"), F.lit(1).alias("tail"))))).otherwise(homes)
    dealt = dealt.select("uid", "doc_id", "text", F.inline(homes).alias("part", "tail"))
    dealt = dealt.repartitionById(ranges, F.col("part").cast("int")).sortWithinPartitions("part", "tail", "uid")

    def run(batches_in):
        held = None  # the last document so far, waiting for its next: (part, doc_id, text, code)
        for batch in batches_in:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            parts, tails = batch.column("part").to_pylist(), batch.column("tail").to_pylist()
            for i, j in batches(texts, 2 << 20):
                code = codes([t.encode() for t in texts[i:j]])
                rows = [(parts[k], ids[k], texts[k], code[k - i], tails[k]) for k in range(i, j)]
                if held is not None:
                    rows.insert(0, held)
                held = None if rows[-1][4] else rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[4] and a[0] == b[0]]
                if pairs:
                    yield _compare(pairs)

    return dealt.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(pairs: list[tuple]) -> pa.RecordBatch:
    changed = [edited(a[2], b[2]).encode() for a, b in pairs]
    own, after, new = np.stack([a[3] for a, _ in pairs]), np.stack([b[3] for _, b in pairs]), codes(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[1] for a, _ in pairs], pa.int64()),
            pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
            pa.array(to_strings(own)),
            pa.array(to_strings(new)),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(with_uid(documents(spark, sf_dir)))
