"""Rows packed in compressed Arrow buffers, one per bucket: (bucket, kind, payload).

Operators that deal many small records to buckets work on them array-wise; a buffer per batch and bucket keeps the JVM's part
of a shuffle to a few rows, and a bucket's records arrive together. Bucket counts follow the input's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, tidy

SCHEMA = "bucket int, kind int, payload binary"
TEXT = 4


def packed(columns: dict | pa.RecordBatch) -> bytes:
    batch = columns if isinstance(columns, pa.RecordBatch) else pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _plain(table: pa.Table) -> pa.Table:
    for i, f in enumerate(table.schema):
        if pa.types.is_dictionary(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(f.type.value_type))
    return table


def table_of(payloads) -> pa.Table | None:
    tables = [_plain(pa.ipc.open_stream(p.as_buffer()).read_all()) for p in payloads]
    return pa.concat_tables(tables) if tables else None


def coded(values: np.ndarray) -> pa.DictionaryArray:
    """Values of which each occurs often, as numbers of the distinct ones."""
    distinct, number = np.unique(values, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(number.astype(np.int32)), pa.array(distinct))


def columns_of(payloads) -> dict[str, np.ndarray]:
    table = table_of(payloads)
    return {} if table is None else {n: table.column(n).to_numpy() for n in table.column_names}


def of_kind(table: pa.Table, kind: int) -> list:
    return [p for p, k in zip(table.column("payload"), table.column("kind").to_pylist(), strict=True) if k == kind]


def home(uid: np.ndarray, n: int) -> np.ndarray:
    return (mix64(uid.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def digit(key: np.ndarray, n: int) -> np.ndarray:
    """The most significant digit, for n buckets."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def rows(parts: list[tuple[int, int, dict]]) -> pa.Table:
    out = pa.table({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "kind": pa.array([k for _, k, _ in parts], pa.int32()), "payload": pa.array([packed(c) for _, _, c in parts], pa.binary())})
    parts.clear()
    tidy()
    return out


def dealt(columns: dict[str, np.ndarray], bucket: np.ndarray, kind: int, base: int = 0) -> list[tuple[int, int, dict]]:
    """The rows of each bucket, as parts for :func:`rows`."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    return [(base + int(own[a]), kind, {n: v[order[a:b]] for n, v in columns.items()}) for a, b in zip(edge, np.append(edge[1:], len(own)), strict=True)]


def passed_on(table: pa.Table, less: int) -> pa.Table:
    return pa.table({"bucket": pa.array([b - less for b in table.column("bucket").to_pylist()], pa.int32()), "kind": table.column("kind"), "payload": table.column("payload")})


def packed_texts(docs: DataFrame, homes: int) -> DataFrame:
    """docs (with uid, and any more columns) as compressed buffers per home, of kind TEXT."""

    def pack(batches_in):
        for batch in batches_in:
            at = home(batch.column("uid").to_numpy(), homes)
            found = np.unique(at)
            for i in range(0, len(found), 16):
                yield from rows([(int(h), TEXT, batch.take(pa.array(np.flatnonzero(at == h)))) for h in found[i : i + 16]]).to_batches()

    return docs.mapInArrow(pack, SCHEMA)
