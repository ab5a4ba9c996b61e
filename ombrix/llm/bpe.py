"""Byte-level BPE by a two-tier lookup, and decoding.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry is resolved with one
probe and one comparison. Tier two merges the bytes of any other pre-token with a heap of candidate pairs over a
linked list, in O(n log n). Chunks of text that were seen before come from a bounded memo.

Null text counts as empty: no ids, and the digest of no bytes. Repeated rows each get their own (equal) result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, documents, mix64
from .pretoken import FINE_PATTERNS, ChunkEncoder, held_encoder, text_runs


def _spans(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], ends[:-1]]), ends


class PerfectHash:
    """A minimal perfect hash over distinct byte strings: as many slots as keys, one 32-bit displacement per bucket.

    Buckets are placed largest first, each with the first displacement that sends its keys to free slots; a bucket
    of one key holds its slot outright, as a negative number.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        self.hasher = SpanHasher(seed=29)
        h = self._hash(keys)
        if len(np.unique(h)) < len(h):
            raise ValueError("keys repeat")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int32)
        self.slot_key = np.full(self.n, -1, np.int32)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[first[b] : first[b] + sizes[b]]
            if sizes[b] < 2:
                if sizes[b]:
                    singles.append((b, own[0]))
                continue
            d, slots = self._first_fit(h[own])
            self.shift[b], self.slot_key[slots] = d, own
        for (b, key), slot in zip(singles, np.flatnonzero(self.slot_key < 0), strict=True):
            self.shift[b], self.slot_key[slot] = -1 - slot, key

    def _hash(self, keys: list[bytes]) -> np.ndarray:
        return self.hasher(*_spans(keys)) if keys else np.zeros(0, np.uint64)

    def _slot(self, h: np.ndarray, d) -> np.ndarray:
        return (mix64(h ^ (np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def _first_fit(self, h: np.ndarray) -> tuple[int, np.ndarray]:
        for d in range(0, 1 << 31, 256):
            slots = self._slot(h, np.arange(d, d + 256)[:, None])
            ok = (self.slot_key[slots] < 0).all(1)
            for k in np.flatnonzero(ok).tolist():
                if len(set(slots[k].tolist())) == len(h):
                    return d + k, slots[k]
        raise RuntimeError("no displacement fits")

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The one key number that each byte string could be; the caller compares."""
        h = self._hash(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)].astype(np.int64)
        return self.slot_key[np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))]


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i; 0: gone
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != e:
            continue
        end[i], end[mid] = e, 0
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def two_tier(ranks: dict[bytes, int], table: PerfectHash, keys: list[bytes], pattern: str, most: int = 300_000) -> Callable:
    """Ids for chunks, for ChunkEncoder: pattern matches, probe, then the heap for what the vocabulary lacks."""
    import regex

    find = regex.compile(pattern).findall
    held: dict[bytes, list[int]] = {}

    def misses(chunks: list[bytes]) -> list[list[int]]:
        pieces = [[m.encode() for m in find(c.decode())] for c in chunks]
        new = list({p for ps in pieces for p in ps if p not in held})
        if len(held) + len(new) > most:
            held.clear()
            new = list({p for ps in pieces for p in ps})
        for p, k in zip(new, table.candidates(new).tolist() if new else [], strict=True):
            held[p] = [ranks[p]] if keys[k] == p else heap_merge(p, ranks)
        return [[x for p in ps for x in held[p]] for ps in pieces]

    return misses


class Decoder:
    """Bytes of many texts' ids at once."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.len = np.zeros(size, np.int64)
        by_id = [b""] * size
        for token, i in ranks.items():
            by_id[i], self.len[i] = token, len(token)
        self.at = np.cumsum(self.len) - self.len
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        size = self.len[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes(), upto[bounds]


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids as little-endian uint32, SHA-256 of the decoded bytes.

    The vocabulary and its perfect hash are broadcast; their size is the vocabulary's, whatever the corpus.
    """
    keys = list(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(keys), keys))

    def run(batches_in):
        ranks, table, keys = shared.value
        tag = f"bpe:{len(keys)}:{hash(pattern)}:{hash(keys[-1])}:{hash(keys[len(keys) // 2])}"
        encoder = held_encoder(tag, lambda: ChunkEncoder(two_tier(ranks, table, keys, pattern), plain=False, fine=pattern == FINE_PATTERNS[1]))
        decode = Decoder(ranks)
        for batch in batches_in:
            n, a, b = [], [], []
            for _, _, texts in text_runs(batch):
                ids, bounds = encoder.encode(texts)
                raw = ids.astype("<u4").tobytes()
                back, at = decode(ids, bounds)
                n += np.diff(bounds).tolist()
                a += [hashlib.sha256(raw[4 * s : 4 * e]).hexdigest() for s, e in zip(bounds, bounds[1:], strict=False)]
                b += [hashlib.sha256(back[s:e]).hexdigest() for s, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(documents(spark, sf_dir), ranks, pattern or public_tokenizers.PATTERN)
