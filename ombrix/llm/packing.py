"""Packing documents into sequences of a fixed length, as few as possible, by linear grouping and best fit.

Nothing but the histogram of piece lengths (at most one row per length, so ``capacity`` rows) reaches the driver:

1. lengths over ``capacity / small_part`` are sorted and dealt into groups of equal cardinality, and each is rounded
   up to its group's longest, which leaves a few sizes;
2. configurations (multisets of sizes that fit) are chosen by column generation on the linear program; the whole
   part of each is taken, and what remains is filled by repeated knapsacks;
3. the actual lengths take the places of the rounded ones, and the small pieces go, longest first, to the place
   with the least room that holds them.

All three work on runs of equal sequences, so the plan's size depends on ``capacity`` alone. Pieces then find their
places by their rank among pieces of the same length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ranked, with_uid, written
from .pretoken import library_encoder, library_json, text_runs


def knapsack(sizes: np.ndarray, values: np.ndarray, limits: np.ndarray | None, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes within capacity; limits: how many of each there are (None: any number)."""
    n = len(sizes)
    if limits is None:
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
        for c in range(int(sizes.min()), capacity + 1):
            room = c - sizes
            ok = np.flatnonzero(room >= 0)
            got = best[room[ok]] + values[ok]
            k = int(got.argmax())
            best[c], last[c] = (got[k], ok[k]) if got[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        out, c = np.zeros(n, np.int64), capacity
        while c > 0:
            if last[c] >= 0:
                out[last[c]] += 1
                c -= int(sizes[last[c]])
            else:
                c -= 1
        return float(best[capacity]), out
    best, took = np.zeros(capacity + 1), []
    for s, v, most in zip(sizes.tolist(), values.tolist(), limits.tolist(), strict=True):
        k, step = min(most, capacity // s), 1
        while k > 0:  # numbers as sums of powers of two
            step = min(step, k)
            shifted = np.full(capacity + 1, -1.0)
            shifted[step * s :] = best[: capacity + 1 - step * s] + step * v
            better = shifted > best + 1e-12
            took.append((s, step, better))
            best = np.where(better, shifted, best)
            k, step = k - step, step * 2
    out, c, index = np.zeros(n, np.int64), capacity, {s: i for i, s in enumerate(sizes.tolist())}
    for s, step, better in reversed(took):
        if better[c]:
            out[index[s]] += step
            c -= step * s
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, tuple[int, ...]]]:
    """(times, how many of each size) so that the demand is met; sizes are distinct."""
    size, left = np.array(sizes, np.int64), np.array(demand, np.int64)
    m = len(size)
    if not m:
        return []
    columns = np.diag(capacity // size).astype(float)
    need = left.astype(float)
    amounts = need / np.diag(columns)
    for _ in range(rounds):
        try:
            prices = np.linalg.solve(columns.T, np.ones(m))
        except np.linalg.LinAlgError:
            break
        worth, new = knapsack(size, np.maximum(prices, 0), None, capacity)
        if worth <= 1 + 1e-7:
            break
        move = np.linalg.solve(columns, new.astype(float))
        ratio = np.where(move > 1e-9, amounts / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        amounts = np.maximum(amounts - step * move, 0)
        amounts[out] = step
        columns[:, out] = new
    chosen = []
    for k in np.argsort(-amounts):
        use = columns[:, k].astype(np.int64)
        times = int(min([amounts[k] + 1e-9, *(left[use > 0] // use[use > 0])])) if use.any() else 0
        if times > 0:
            chosen.append((times, tuple(use.tolist())))
            left = left - times * use
    while left.any():  # the rest, fullest first, as often as it goes
        own = np.flatnonzero(left)
        _, take = knapsack(size[own], size[own].astype(float), left[own], capacity)
        use = np.zeros(m, np.int64)
        use[own] = take
        times = int((left[use > 0] // use[use > 0]).min())
        chosen.append((times, tuple(use.tolist())))
        left = left - times * use
    return chosen


class Plan:
    """Rows (length, first rank, last rank + 1, first sequence, pieces of it per sequence, offset) that place every piece."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = 48, small_part: int = 6):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.placed = dict.fromkeys(histogram, 0)
        #: Free room -> runs (first sequence, number) of sequences that have it.
        self.free: dict[int, list[tuple[int, int]]] = {}
        large = {s: n for s, n in histogram.items() if s * small_part > capacity}
        self._large(large, groups)
        self._small({s: n for s, n in histogram.items() if s not in large})

    def _put(self, length: int, first: int, number: int, each: int, offset: int) -> None:
        rank = self.placed[length]
        self.rows.append((length, rank, rank + number * each, first, each, offset))
        self.placed[length] = rank + number * each

    def _large(self, large: dict[int, int], groups: int) -> None:
        total = sum(large.values())
        if not total:
            return
        each = -(-total // groups)
        runs, left = [[]], each  # each group: [(length, number)], longest first
        for s in sorted(large, reverse=True):
            n = large[s]
            while n:
                if not left:
                    runs.append([])
                    left = each
                take = min(n, left)
                runs[-1].append((s, take))
                n, left = n - take, left - take
        by_size: dict[int, list] = {}  # groups with the same longest are one
        for run in runs:
            by_size.setdefault(run[0][0], []).extend(run)
        sizes = list(by_size)
        stock = [list(reversed(by_size[s])) for s in sizes]
        for times, use in configurations(sizes, [sum(n for _, n in by_size[s]) for s in sizes], self.capacity):
            first, slots = self.sequences, [g for g, k in enumerate(use) for _ in range(k)]
            self.sequences += times
            filled = []  # per slot the runs of actual lengths along the sequences
            for g in slots:
                run, need = [], times
                while need:
                    s, n = stock[g].pop()
                    take = min(n, need)
                    if n > take:
                        stock[g].append((s, n - take))
                    run.append((s, take))
                    need -= take
                filled.append(run)
            self._segments(first, times, filled)

    def _segments(self, first: int, times: int, filled: list[list[tuple[int, int]]]) -> None:
        """Cuts a configuration's sequences where any slot's actual length changes, and places the pieces."""
        borders = {0, times}
        for run in filled:
            at = 0
            for _, n in run:
                at += n
                borders.add(at)
        marks = sorted(borders)
        at = [[i, 0] for i in [0] * len(filled)]
        for a, b in zip(marks, marks[1:], strict=False):
            offset = 0
            for run, pos in zip(filled, at, strict=True):
                s, n = run[pos[0]]
                self._put(s, first + a, b - a, 1, offset)
                offset += s
                pos[1] += b - a
                if pos[1] == n:
                    pos[0], pos[1] = pos[0] + 1, 0
            self.free.setdefault(self.capacity - offset, []).append((first + a, b - a))

    def _small(self, small: dict[int, int]) -> None:
        rooms = sorted(r for r in self.free if r > 0)
        for s in sorted(small, reverse=True):
            left = small[s]
            while left:
                k = bisect.bisect_left(rooms, s)
                if k == len(rooms):
                    each = self.capacity // s
                    number = max(1, left // each)
                    self.free.setdefault(self.capacity, []).append((self.sequences, number))
                    self.sequences += number
                    bisect.insort(rooms, self.capacity)
                    continue
                room = rooms[k]
                first, number = self.free[room].pop()
                each = min(room // s, left)
                take = min(number, left // each)
                if number > take:
                    self.free[room].append((first + take, number - take))
                elif not self.free[room]:
                    rooms.pop(k)
                self._put(s, first, take, each, self.capacity - room)
                left -= take * each
                rest = room - each * s
                if rest:
                    if not self.free.get(rest):
                        bisect.insort(rooms, rest)
                    self.free.setdefault(rest, []).append((first, take))


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int = 0, added: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): ids and the end id, cut every ``capacity`` ids."""
    tokens = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches_in):
        encoder = library_encoder(tokens.value, plain=True, added=added)
        for batch in batches_in:
            row, start, length, crc = [], [], [], []
            for i, j, texts in text_runs(batch):
                ids, bounds = encoder.encode(texts)
                for k in range(j - i):
                    raw = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    for s in range(0, len(raw), 4 * capacity):
                        part = raw[s : s + 4 * capacity]
                        row.append(i + k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(row)), batch.column("doc_id").take(pa.array(row)), pa.array(np.array(start, np.int64) // capacity, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, groups: int = 48) -> DataFrame:
    """Adds sequence_id and offset to (uid, piece, length, ...); pieces must be a written table, it is read thrice."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # capacity rows at most
    plan = Plan(histogram, capacity, groups)
    by_length: dict[int, list] = {}
    for row in plan.rows:
        by_length.setdefault(row[0], []).append(tuple(map(int, row[1:])))
    table = spark.createDataFrame(list(by_length.items()), "length long, _runs array<struct<a:long,b:long,first:long,each:long,offset:long>>")
    found = ranked(pieces, ["length"], ["uid", "piece"], "_at", total=sum(histogram.values())).join(F.broadcast(table), "length")  # the plan's size is bounded by capacity
    # runs are in ascending order of rank, so the one that holds a piece is found by bisection
    found = found.withColumn("_run", F.expr(_bisect()))
    inside = F.col("_at") - F.col("_run.a")
    return found.select(*pieces.columns, (F.col("_run.first") + F.floor(inside / F.col("_run.each"))).cast("long").alias("sequence_id"), (F.col("_run.offset") + (inside % F.col("_run.each")) * F.col("length")).cast("long").alias("offset"))


def _bisect() -> str:
    """The last run that begins at or before _at, in 16 halvings (a plan has far fewer than 65,536 runs of a length)."""
    return (
        "element_at(_runs, aggregate(sequence(15, 0, -1), 1, (lo, k) -> "
        "if(lo + shiftleft(1, k) <= size(_runs) and element_at(_runs, least(lo + shiftleft(1, k), size(_runs))).a <= _at, lo + shiftleft(1, k), lo)))"
    )


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and holds the end id alone. Rows that repeat a doc_id are packed each on its own (their
    order is by text). An empty table gives no rows. added: literal added tokens get their ids, as is the library's default.
    """
    pieces = written(token_pieces(docs, tokenizer_json, capacity, end_id, added), "pieces")
    return pack(pieces, capacity).drop("uid")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(with_uid(documents(spark, sf_dir)), library_json(tokenizer, "word_bpe_49k.json"), added=True)
