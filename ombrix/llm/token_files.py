"""Token ids in binary files whose document boundaries are Elias-Fano coded.

One file holds a run of documents in ascending order::

    8 bytes   magic
    56 bytes  partition, place in the partition, documents, ids, bytes of an id, documents without a doc_id (they
              come first), smallest doc_id (little-endian int64 each)
    EF        document starts and the end (documents + 1 values up to the number of ids)
    EF        doc_ids above the smallest
    ids       little-endian uint16, or uint32 where the vocabulary needs it

and EF is three int64 (values, universe, low bits) followed by the low bits, packed, the high bits in unary, and
the position of every 64th one as uint32 for select. Boundaries take 2 + log2(ids per document) bits each.
Spark's own writer puts the files down, through its commit protocol, so a lost task leaves nothing half done and
any store that Spark writes will do; it ends a file with one newline, which readers ignore.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets_for, documents, scratch_path, with_uid, written
from .pretoken import library_encoder, library_json, text_runs

MAGIC = b"OMBRTOK1"
_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Of each byte the places of its ones, in order.
_ONE8 = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)], np.int64)


class EliasFano:
    """A monotone sequence in near-minimal space with select: ``ef[i]`` is the i-th value."""

    SAMPLE = 64

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, bits, low, np.packbits(high, bitorder="little"), ones[:: cls.SAMPLE].astype(np.uint32))

    def tobytes(self) -> bytes:
        return np.array([self.n, self.universe, self.low_bits], "<i8").tobytes() + np.array([len(self.low), len(self.high)], "<i8").tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def frombytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        n, universe, bits, n_low, n_high = np.frombuffer(data[:40], "<i8").tolist()
        at = 40
        low = np.frombuffer(data[at : at + n_low], np.uint8)
        high = np.frombuffer(data[at + n_low : at + n_low + n_high], np.uint8)
        at += n_low + n_high
        size = 4 * -(-n // cls.SAMPLE)
        return cls(n, universe, bits, low, high, np.frombuffer(data[at : at + size], "<u4")), at + size

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1) if self.low_bits else np.zeros(len(i), np.int64)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        byte, rest = at >> 3, int(self.high[at >> 3]) >> (at & 7)  # the sampled one is its lowest bit
        base = at
        while (ones := int(_POP8[rest])) <= left:
            left -= ones
            byte += 1
            rest, base = int(self.high[byte]), byte << 3
        for _ in range(left):
            rest &= rest - 1
        return ((base + (rest & -rest).bit_length() - 1 - i) << self.low_bits) + int(self._low(np.array([i]))[0])

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values numbered ``i``, all at once: from the sampled place before each, byte by byte, to its one."""
        i = np.asarray(i, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        at, left = self.samples[i // self.SAMPLE].astype(np.int64), i % self.SAMPLE
        byte = at >> 3
        rest = self.high[byte] >> (at & 7).astype(np.uint8) << (at & 7).astype(np.uint8)
        own = np.flatnonzero(_POP8[rest] <= left)
        while len(own):
            left[own] -= _POP8[rest[own]]
            byte[own] += 1
            rest[own] = self.high[byte[own]]
            own = own[_POP8[rest[own]] <= left[own]]
        return ((byte * 8 + _ONE8[rest, left] - i) << self.low_bits) + self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) + self._low(np.arange(self.n))


def pack_file(partition: int, place: int, ids: np.ndarray, bounds: np.ndarray, width: int, names: list) -> bytes:
    """names: the doc_ids, None first and then ascending."""
    nulls = sum(x is None for x in names)
    least = names[nulls] if nulls < len(names) else 0
    head = np.array([partition, place, len(names), len(ids), width, nulls, least], "<i8").tobytes()
    named = np.array([x - least for x in names[nulls:]], np.uint64)
    return MAGIC + head + EliasFano.encode(bounds).tobytes() + EliasFano.encode(named).tobytes() + ids.astype(f"<u{width}").tobytes()


def unpack_file(data: bytes) -> tuple[int, int, list, EliasFano, np.ndarray]:
    """(partition, place, doc_ids, boundaries, ids)"""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    partition, place, _, n, width, nulls, least = np.frombuffer(data[8:64], "<i8").tolist()
    bounds, size = EliasFano.frombytes(memoryview(data)[64:])
    names, more = EliasFano.frombytes(memoryview(data)[64 + size :])
    return partition, place, [None] * nulls + [least + x for x in names.all().tolist()], bounds, np.frombuffer(data, f"<u{width}", n, 64 + size + more)


def write_token_files(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, file_ids: int = 1 << 21, added: bool = False) -> None:
    """Encodes every whole text in ascending (doc_id, text) order into token files in the folder ``path``.

    docs: uid, doc_id, text. A range partition by uid makes the order; no task holds more than a file's ids and a batch of texts.
    """
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(tokenizer_json)
    n = buckets_for(docs, 16 << 20)
    ordered = docs.select("uid", "doc_id", "text").repartitionByRange(n, "uid").sortWithinPartitions("uid")

    def run(batches_in):
        import json

        encoder = library_encoder(tokens.value, plain=False, added=added)
        if not hasattr(encoder, "top"):
            known = json.loads(tokens.value)
            encoder.top = max(*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens") or []))
        top = max(encoder.top, end_id)
        width = 2 if top < 1 << 16 else 4
        partition, place = TaskContext.get().partitionId(), 0
        held, sizes, names, total = [], [], [], 0

        def file():
            bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            return pa.RecordBatch.from_arrays([pa.array([pack_file(partition, place, np.concatenate(held), bounds, width, names)], pa.binary())], ["payload"])

        for batch in batches_in:
            own = batch.column("doc_id").to_pylist()
            for i, j, texts in text_runs(batch):
                ids, bounds = encoder.encode(texts)
                for k in range(j - i):
                    held.append(np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype(f"<u{width}"))
                    sizes.append(len(held[-1]))
                    names.append(own[i + k])
                    total += sizes[-1]
                    if total >= file_ids:
                        yield file()
                        held, sizes, names, total, place = [], [], [], 0, place + 1
        if sizes:
            yield file()

    made = ordered.mapInArrow(run, "payload binary")
    made.select(F.col("payload").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, partition, place, local start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = spark.read.format("binaryFile").load(path).filter("length > 64").select("content")

    def run(batches_in):
        for batch in batches_in:
            for data in batch.column("content"):
                partition, place, names, bounds, ids = unpack_file(data.as_buffer().to_pybytes())
                at = bounds.select(np.arange(bounds.n))
                raw, n = memoryview(ids.astype("<u4").tobytes()), len(at) - 1
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.full(n, partition, np.int32)), pa.array(np.full(n, place, np.int32)), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "partition", "place", "local", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, partition int, place int, local long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_json: str, path: str | None = None, end_id: int = 0, added: bool = False) -> DataFrame:
    """Writes the files, reads them back and returns (doc_id, start, n_tokens, ids_crc32).

    ``start`` adds the ids of all files before, a sum over one row per file. Null text: only the end id. Null
    doc_id comes first; rows with equal doc_id follow each other by text. An empty table gives no files, no rows.
    """
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_json, end_id, added=added)
    rows = written(read_token_files(spark, path), "rows")
    files = rows.groupBy("partition", "place").agg(F.sum("n_tokens").alias("_n"))
    parts = files.groupBy("partition").agg(F.sum("_n").alias("_p"))
    parts = parts.select("partition", (F.sum("_p").over(W.orderBy("partition")) - F.col("_p")).alias("_before"))
    base = files.join(parts, "partition").select("partition", "place", (F.col("_before") + F.sum("_n").over(W.partitionBy("partition").orderBy("place")) - F.col("_n")).alias("_base"))
    return rows.join(base, ["partition", "place"]).select("doc_id", (F.col("_base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_files(spark, with_uid(documents(spark, sf_dir)), library_json(tokenizer, "byte_bpe_50k.json"), added=True)
