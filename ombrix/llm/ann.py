"""Nearest neighbours by additive quantisation, with exact reranking of all that the codes cannot rule out.

Codebooks have the vectors' full dimension; a vector is coded as a sum of one word from each, found by beam search
over residuals, and the squared norm of that sum and its distance from the vector (the code's error) are kept with the code.
Vectors are centred and scaled for that by the sample's mean and size. A query tabulates its products with all words;
a code's distance is then a norm and a few table entries, and that distance less the code's error is a lower bound of the
vector's own. Queries and codes meet block by block. In each block the RERANK nearest codes are compared by their
original vectors, then, RERANK at a time, all others whose lower bound does not exceed the k-th distance found. The k nearest of
all blocks are kept: ties and close vectors, however many, cost comparisons and lose nothing.

Codebooks are fitted on the SAMPLE vectors of smallest id hash (a bound, whatever the corpus); all vectors are indexed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, written

BOOKS, WORDS, BEAM = 32, 256, 4
SAMPLE = 8192
#: Codes per query and block that are compared with the original vectors at a time.
RERANK = 256
#: Rows of a block, and bytes of a code block's vectors.
QUERY_BLOCK, CODE_BLOCK, CODE_BYTES = 256, 1 << 15, 8 << 20
#: Rows that are scored at a time.
SCORED = 8192
#: Code blocks whose lists for a query block are merged at a time, about.
MERGE = 24


def nearest_words(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1)[None] - 2 * x @ book.T).argmin(1)


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 17) -> np.ndarray:
    """(books, words, dimension): k-means on the residuals that the books before leave."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32), []
    for _ in range(books):
        k = min(words, len(rest))
        book = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            own = nearest_words(rest, book)
            count = np.bincount(own, minlength=k)
            total = np.zeros_like(book)
            np.add.at(total, own, rest)
            filled = count > 0
            book[filled] = total[filled] / count[filled, None]
            book[~filled] = rest[rng.choice(len(rest), int((~filled).sum()))]
        if k < words:
            book = np.concatenate([book, np.zeros((words - k, x.shape[1]), np.float32)])
        out.append(book)
        rest = rest - book[nearest_words(rest, book)]
    return np.stack(out)


def scale_of(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean, and the root mean square of the distances from it (1 if that is zero or no number)."""
    most = np.abs(x).max() or 1.0
    mean = (x / most).mean(0)
    size = float(np.sqrt((((x / most) - mean) ** 2).sum(1).mean()) * most)
    return mean * most, size if 0 < size < np.inf else 1.0


def scaled(x: np.ndarray, mean: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors less the mean over the size, and how far rounding may have moved each."""
    with np.errstate(over="ignore"):
        return (x - mean) / size, 1e-15 * (np.linalg.norm(x, axis=1) + np.linalg.norm(mean)) / size


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, books) codes by beam search, the squared norms of the sums, and the sums' distances from the vectors."""
    n, d = x.shape
    m, words, _ = books.shape
    if not n:
        return np.zeros((0, m), np.uint8), np.zeros(0), np.zeros(0)
    rest = np.clip(x, -1e15, 1e15).astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for level in range(m):
        book = books[level]
        width = rest.shape[1]
        cost = (rest**2).sum(2)[:, :, None] + (book**2).sum(1)[None, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, words)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1]) if level < m - 1 else 1
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.sort(best, axis=1)
        at, word = best // words, best % words
        row = np.arange(n)[:, None]
        rest = rest[row, at] - book[word]
        codes = np.concatenate([codes[row, at], word[:, :, None].astype(np.uint8)], 2)
    code = codes[:, 0]
    total = np.zeros((n, d))
    for level in range(m):
        total += books[level][code[:, level]]
    with np.errstate(over="ignore"):
        return code, (total**2).sum(1), np.sqrt(((x - total) ** 2).sum(1))


def tabulate(queries: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(books, queries, words) products, the queries' squared norms, and how far rounding may move an estimated square."""
    m, words, d = books.shape
    books = books.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        table = (queries @ books.reshape(-1, d).T).reshape(len(queries), m, words).transpose(1, 0, 2)
        square = (queries**2).sum(1)
        reach = np.sqrt((books**2).sum(2).max(1)).sum()
        return np.ascontiguousarray(table), square, 2.3e-16 * (2 * d + 100) * (np.sqrt(square) + reach) ** 2


def estimates(tables: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(queries, n) squared distances from the sums that the codes stand for."""
    table, square, _ = tables
    with np.errstate(over="ignore", invalid="ignore"):
        out = square[:, None] + norms[None]
        for m in range(len(table)):
            out -= 2 * table[m].take(codes[:, m], axis=1)
    return out


def distances(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Euclidean distances from (dimension, n) columns, summed in the order of components."""
    total = np.zeros(columns.shape[1])
    with np.errstate(over="ignore"):
        for own, column in zip(query, columns, strict=True):
            step = column - own
            total += step * step
    return np.sqrt(total)


def nearest(query: np.ndarray, ids: np.ndarray, columns: np.ndarray, guess: np.ndarray, lower: np.ndarray, found: tuple[np.ndarray, np.ndarray], k: int, step: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of ``found`` and the columns, by (distance, id).

    guess: where to look first; lower: bounds of the distances over ``size``, infinite for columns that do not take part.
    Columns are compared ``step`` at a time until the bounds of the others exceed the k-th distance.
    """
    left = np.flatnonzero(~(lower == np.inf))
    best_ids, best = found
    while len(left):
        if len(best) == k:
            left = left[~(lower[left] > best[-1] / size * (1 + 1e-9))]
        if len(left) > step:
            order = np.argpartition(guess[left], step)
            own, left = left[order[:step]], left[order[step:]]
        else:
            own, left = left, left[:0]
        best_ids, best = np.concatenate([best_ids, ids[own]]), np.concatenate([best, distances(query, columns[:, own])])
        order = np.lexsort((best_ids, best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles), one row per vec_id: the vectors that take part.

    Left out: null ids, and vectors that are null, empty, zero, or hold null or non-finite components. Of rows that
    repeat a vec_id the smallest vector counts.
    """
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null").filter(F.coalesce(fine, F.lit(False)))
    n = own.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("vec_id").alias("d")).first()
    return own if n.c == n.d else own.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def search(vectors: DataFrame, is_query, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance, ties to smaller vec_id.

    is_query: a condition on vec_id. Every usable row (see :func:`usable`) of the query's length, but its own, is a
    candidate; vectors of other lengths have no distance from it. Each length has an index of its own.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = written(usable(vectors), "vectors")
    lengths = [r[0] for r in own.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect()]
    if len(lengths) < 2:
        return _search(own, is_query, k, rerank)
    return reduce(DataFrame.unionByName, [_search(written(own.filter(F.size("embedding") == n), "vectors"), is_query, k, rerank) for n in lengths])


def _search(own: DataFrame, is_query, k: int, rerank: int) -> DataFrame:
    """:func:`search` among written vectors of one length."""
    spark = own.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    sampled = np.array([r.embedding for r in sample])
    mean, size = scale_of(sampled)
    shared = spark.sparkContext.broadcast((fit_books(scaled(sampled, mean, size)[0]), mean, size))
    rows_each = max(1, min(CODE_BLOCK, CODE_BYTES // (8 * len(mean))))

    def index(batches_in):
        books, mean, size = shared.value
        for batch in batches_in:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column("embedding"), part.num_rows)
                own, moved = scaled(x, mean, size)
                codes, norms, errors = encode(own, books)
                columns = [part.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(errors * (1 + 1e-9) + moved), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "code", "norm", "error", "vector"])

    def code_blocks(batches_in):
        held, n = [], 0

        def block(t):
            raw = [t.column(c).to_numpy().astype(f).tobytes() for c, f in (("vec_id", "<i8"), ("norm", "<f8"), ("error", "<f8"))]
            raw += [b"".join(t.column(c).to_pylist()) for c in ("code", "vector")]
            return pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in raw], ["ids", "norms", "errors", "codes", "vectors"])

        for batch in batches_in:
            held.append(batch)
            n += batch.num_rows
            while n >= rows_each:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, rows_each))
                held, n = t.slice(rows_each).to_batches(), n - rows_each
        if n:
            yield block(pa.Table.from_batches(held))

    def query_blocks(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(i, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([_matrix(part.column("embedding"), part.num_rows).astype("<f8").tobytes()], pa.binary())], ["query_ids", "queries"])

    coded = own.mapInArrow(index, "vec_id long, code binary, norm double, error double, vector binary")
    codes = written(coded.mapInArrow(code_blocks, "ids binary, norms binary, errors binary, codes binary, vectors binary"), "index")
    asked = own.filter(is_query(F.col("vec_id")))
    blocks = asked.repartition(max(1, -(-asked.count() // (4 * QUERY_BLOCK)))).mapInArrow(query_blocks, "query_ids binary, queries binary")
    blocks = written(blocks.withColumn("name", F.monotonically_increasing_id()), "queries")
    # the stated queries against all rows, block by block: every code block meets every query block once, unshuffled
    met = codes.hint("shuffle_replicate_nl").crossJoin(blocks)

    def lists(name, slot, qid, found):
        """Of queries' (ids, distances): k places each, those that stay empty without a distance."""
        ids, scores = np.zeros((len(qid), k), "<i8"), np.full((len(qid), k), np.nan, "<f8")
        for i, (own, score) in enumerate(found):
            ids[i, : len(own)], scores[i, : len(own)] = own, score
        return pa.table({"name": pa.array([name], pa.int64()), "slot": pa.array([slot], pa.int64()), "query_ids": pa.array([qid.astype("<i8").tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "scores": pa.array([scores.tobytes()], pa.binary())})

    def scan(batches_in):
        books, mean, size = shared.value
        for batch in batches_in:
            for j in range(batch.num_rows):
                r = batch.slice(j, 1).to_pylist()[0]
                qid, ids = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q, x = np.frombuffer(r["queries"], "<f8").reshape(len(qid), -1), np.frombuffer(r["vectors"], "<f8").reshape(len(ids), -1)
                code, norm, error = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["norms"], "<f8"), np.frombuffer(r["errors"], "<f8")
                own, moved = scaled(q, mean, size)
                tables = tabulate(own, books)
                found = [(np.zeros(0, np.int64), np.zeros(0))] * len(qid)
                for i in range(0, len(ids), SCORED):
                    at = slice(i, i + SCORED)
                    guess = estimates(tables, code[at], norm[at])
                    with np.errstate(over="ignore", invalid="ignore"):
                        lower = np.sqrt(np.maximum(guess - tables[2][:, None], 0)) - error[at][None] - moved[:, None]
                    lower[qid[:, None] == ids[at][None]] = np.inf
                    columns = np.ascontiguousarray(x[at].T)
                    found = [nearest(q[n], ids[at], columns, guess[n], lower[n], found[n], k, rerank, size) for n in range(len(qid))]
                yield from lists(r["name"], int(ids[0]), qid, found).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        qid = np.frombuffer(rows[0]["query_ids"], "<i8")
        ids = np.concatenate([np.frombuffer(r["ids"], "<i8").reshape(len(qid), -1) for r in rows], 1)
        scores = np.concatenate([np.frombuffer(r["scores"], "<f8").reshape(len(qid), -1) for r in rows], 1)
        best = [np.lexsort((ids[n], scores[n]))[:k] for n in range(len(qid))]  # places without a distance sort last
        return lists(rows[0]["name"], rows[0]["slot"], qid, [(ids[n][b], scores[n][b]) for n, b in enumerate(best)])

    def unpack(batches_in):
        for batch in batches_in:
            for r in batch.to_pylist():
                qid = np.frombuffer(r["query_ids"], "<i8")
                ids, scores = np.frombuffer(r["ids"], "<i8").reshape(len(qid), -1), np.frombuffer(r["scores"], "<f8").reshape(len(qid), -1)
                row, col = np.nonzero(~np.isnan(scores))
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array((col + 1).astype(np.int32)), pa.array(ids[row, col]), pa.array(scores[row, col])], ["query_id", "rank", "vec_id", "score"])

    packed = "name long, slot long, query_ids binary, ids binary, scores binary"
    found = met.mapInArrow(scan, packed)
    left = codes.count()  # code blocks
    while left > 1:  # lists of a query block meet MERGE at a time
        left = -(-left // MERGE)
        found = found.withColumn("slot", F.pmod(F.xxhash64("slot"), F.lit(left))).groupBy("name", "slot").applyInArrow(merge, packed)
    return found.mapInArrow(unpack, schema)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), lambda i: i % 100 == 0)
