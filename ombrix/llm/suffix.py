"""Repeated byte strings by a depth-limited radix sort of suffixes: most significant digits first, no further than needed.

A suffix counts through ``window`` bytes only, and suffixes that are equal so far are exactly the repeated windows. Passes run
over digits of 8 bytes, and a suffix leaves them once no other shares its digits. To spare most suffixes even the first
pass, they are dealt by a digit that lies inside the window rather than at its start, and are sieved on the way:

1. the *anchor* of a window is the gram of CORE bytes in it whose hash is smallest (leftmost among equals). Equal windows
   have equal anchors at equal places, and neighbouring windows share one, so the anchors deal one record per some 35
   bytes. A window whose anchor occurs nowhere else occurs once and is done; a hash serves here only to tell strings apart.
2. for anchors that occur again, the *contexts* travel: all bytes that the run of windows around an anchor covers. Digit
   passes over whole contexts find runs that repeat as one; the first stays.
3. where an anchor keeps several contexts, digit passes over their windows, side by side at equal places of the anchor, find
   the rest. All but the earliest of equal windows are removed.

Every verdict of equality is one of bytes. Records travel packed in Arrow buffers, one per bucket, and every batch settles what
repeats inside it first, so a bucket gets a record per batch and string at most, however often a string occurs; an anchor
that has many contexts within a batch is dealt window by window, spread over all buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .blobs import SCHEMA, TEXT, columns_of, dealt, digit, home, of_kind, packed_texts, passed_on, rows, table_of
from .common import BLOCK_BYTES, buckets_for, byte_table, documents, mix64, same_spans, with_uid, words_of, written
from .pretoken import batches, text_runs

CORE = 32
#: Contexts of one anchor within a batch from which it is dealt by whole windows.
MANY = 16
#: Records held by a task before it sends them on.
FLUSH = 1 << 18
REMOVE, EXPAND, EXPAND_WINDOWS = 0, 1, 2
_STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2F7A1E5C3B9D8467, 0xC2B2AE3D27D4EB4F)]


def gram_hashes(buf: np.ndarray, lengths: list[int], seed: int = 7) -> list[np.ndarray]:
    """For each length the 64-bit hashes of all its grams: out[k][i] is of buf[i : i + lengths[k]].

    Hashes of 1, 2, 4, ... bytes come from pairs of half the length, any other length from its powers of two.
    """
    n = len(buf)
    h, have, level = byte_table(seed)[buf], 1, 0
    parts: list = [None] * len(lengths)
    done = [0] * len(lengths)
    for k, length in enumerate(lengths):
        if n < length:
            parts[k] = np.zeros(0, np.uint64)
    top = max(lengths)
    while True:
        for k, length in enumerate(lengths):
            if length & have and n >= length:
                size = n - length + 1
                piece = h[done[k] : done[k] + size]
                parts[k] = piece.copy() if parts[k] is None else (parts[k] ^ (parts[k] >> np.uint64(31))) * _STEP[-1 - level % 4] + piece
                done[k] += have
        if have * 2 > top or len(h) <= have:
            break
        h = (h[:-have] ^ (h[:-have] >> np.uint64(29))) * _STEP[level % 6] + h[have:]
        have, level = have * 2, level + 1
    return [mix64(p) for p in parts]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


#: Bits that number the places of a block; a hash is cut by as many, alike in all blocks.
_PLACE_BITS = 20


def anchors(buf: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, core hash, context hash) of runs of windows with the same anchor.

    ends: of the documents in buf. Every window that lies in one document is in exactly one run. The anchor is the
    leftmost of the window's CORE-byte grams of smallest hash, which depends on the window's bytes alone.
    """
    n = len(buf)
    if n >= 1 << _PLACE_BITS:
        raise ValueError("the block is too long")
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    core, whole = gram_hashes(buf, [CORE, window])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (core & ~low) | np.arange(len(core), dtype=np.uint64)
    at = (sliding_min(key, window - CORE + 1) & low).astype(np.int64)
    limit = np.repeat(ends, np.diff(ends, prepend=0))
    valid = np.arange(len(at)) + window <= limit[: len(at)]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | ~valid[:-1] | (limit[1 : len(at)] != limit[: len(at) - 1])
    first = np.flatnonzero(change & valid)
    stop = np.flatnonzero(np.append(change[1:] | ~valid[1:], True) & valid)
    context = mix64(whole[first] ^ (mix64(whole[stop] + (stop - first).astype(np.uint64)) >> np.uint64(1)))
    # anchors are the smallest hashes of all, so they are spread anew before they serve as digits
    return first, stop, at[first], mix64(core[at[first]] ^ np.uint64(0xA0761D6478BD642F)), context


def radix(words: np.ndarray, at: np.ndarray, depth: np.ndarray, *dealt_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over suffixes: (order, which in that order begins a new string).

    A suffix is the ``depth`` bytes from ``at`` on; words: 8 bytes from every place (:func:`common.words_of`). Suffixes are dealt by
    ``dealt_by`` and depth first, then by one digit of 8 bytes after the other; one that is alone with its digits takes
    part no more. Equal strings end up side by side, in the order they came in.
    """
    order = np.lexsort((depth, *reversed(dealt_by)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (depth, *dealt_by)])
    for done in range(0, int(depth.max()) if len(order) else 0, 8):
        alone = new & np.append(new[1:], True)
        own = np.flatnonzero(~alone & (depth[order] > done))
        if not len(own):
            break
        row = order[own]
        digit_ = (words[at[row] + done] & _LEFT[np.minimum(depth[row] - done, 8)]).byteswap()
        if (digit_[1:] == digit_[:-1])[~new[own][1:]].all():
            continue  # nothing parts here, as in runs of copies
        group = np.cumsum(new)[own]
        moved = np.lexsort((digit_, group))
        order[own] = row[moved]
        digit_, group = digit_[moved], group[moved]
        new[own[1:]] |= (digit_[1:] != digit_[:-1]) & (group[1:] == group[:-1])
    return order, new


_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _orders(uid, first, core, off, homes: int, kind, stop) -> list[tuple[int, int, dict]]:
    """What documents are told: remove bytes [first, stop), or expand the windows from first up to stop."""
    if not len(uid):
        return []
    return dealt({"uid": uid, "first": first.astype(np.int64), "stop": stop.astype(np.int64), "core": core, "off": off.astype(np.int16), "what": np.full(len(uid), kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8)}, home(uid, homes), 1)


def _removals(uid: np.ndarray, first: np.ndarray, stop: np.ndarray, homes: int) -> list[tuple[int, int, dict]]:
    """As _orders, with runs that touch joined."""
    if not len(uid):
        return []
    order = np.lexsort((first, uid))
    uid, first, stop = uid[order], first[order], stop[order]
    # documents lie one after the other on one axis, so a running maximum cannot reach into the next
    joint = np.append(True, (uid[1:] != uid[:-1]))
    begin = np.flatnonzero(joint)
    reach = stop.copy()
    for a, b in zip(begin, np.append(begin[1:], len(uid)), strict=True):
        if b - a > 1:
            np.maximum.accumulate(stop[a:b], out=reach[a:b])
    new = joint.copy()
    new[1:] |= first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(uid)) - 1
    zero = np.zeros(len(at), np.uint64)
    return _orders(uid[at], first[at], zero, np.zeros(len(at), np.int16), homes, REMOVE, reach[last])


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, group): rows by (core, context, uid, first), the first of each (core, context), the first of each core."""
    core, context, uid, first = keys
    order = np.lexsort((first, uid, context, core))
    new_core = np.append(True, core[order][1:] != core[order][:-1])
    new = new_core.copy()
    new[1:] |= context[order][1:] != context[order][:-1]
    return order, new, new_core


class _Records:
    """Anchor records of a task, and the bytes they were found in, until they are sent."""

    NAMES = ("core", "context", "uid", "first", "last", "off", "place")

    def __init__(self, window: int, buckets: int, homes: int):
        self.window, self.buckets, self.homes = window, buckets, homes
        self.reset()

    def reset(self) -> None:
        self.held: list[dict] = []
        self.bytes: list[np.ndarray] = []
        self.n = self.size = 0

    def add(self, uids: np.ndarray, texts: list[bytes]) -> None:
        for i, j in batches(texts, BLOCK_BYTES // 2):
            if j - i == 1 and len(texts[i]) > BLOCK_BYTES // 2:
                for at in range(0, len(texts[i]), BLOCK_BYTES // 2):
                    part = texts[i][at : at + BLOCK_BYTES // 2 + self.window - 1]
                    self._block(np.frombuffer(part, np.uint8), np.array([len(part)]), uids[i : i + 1], np.array([-at]))
            else:
                ends = np.cumsum([len(t) for t in texts[i:j]])
                self._block(np.frombuffer(b"".join(texts[i:j]), np.uint8), ends, uids[i:j], np.concatenate([[0], ends[:-1]]))

    def _block(self, buf, ends, uids, starts) -> None:
        first, last, at, core, context = anchors(buf, ends, self.window)
        owner = np.searchsorted(ends, first, side="right")
        base = starts[owner]
        self.held.append({"core": core, "context": context, "uid": uids[owner], "first": first - base, "last": last - base, "off": (at - first).astype(np.int16), "place": first + self.size})
        self.bytes.append(buf)
        self.n, self.size = self.n + len(first), self.size + len(buf)

    def flush(self) -> list[tuple[int, int, dict]]:
        if not self.n:
            self.reset()
            return []
        r, buf = {k: np.concatenate([h[k] for h in self.held]) for k in self.NAMES}, np.concatenate(self.bytes)
        self.reset()
        order, new, new_core = _first_of(r["core"], r["context"], r["uid"], r["first"])
        r = {k: v[order] for k, v in r.items()}
        # a context repeats if its bytes are those of the first one with its hash
        late = np.flatnonzero(~new)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[late]
        size = r["last"] - r["first"] + self.window
        words = words_of(buf)
        same = size[late] == size[lead]
        some = np.flatnonzero(same)
        same[some] = same_spans(buf, r["place"][lead[some]], buf, r["place"][late[some]], size[late[some]], words, words)
        new[late[~same]] = True
        again = ~new
        out = [(self.buckets + b, k, c) for b, k, c in _removals(r["uid"][again], r["first"][again], r["last"][again] + self.window, self.homes)]
        contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_core))
        hot = (np.repeat(contexts, np.diff(np.append(np.flatnonzero(new_core), len(new)))) > MANY) & new
        if hot.any():
            h = {k: v[hot] for k, v in r.items()}
            out += [(self.buckets + b, k, c) for b, k, c in _orders(h["uid"], h["first"], h["core"], h["off"], self.homes, EXPAND_WINDOWS, h["last"] + 1)]
            mark = np.unique(h["core"])
            z = np.zeros(len(mark), np.int64)
            out += dealt({"core": mark, "uid": z, "first": z, "size": z.astype(np.int16), "off": z.astype(np.int16), "mark": z.astype(np.int8) + 1}, digit(mark, self.buckets), 0)
        keep = new & ~hot
        k = {n: v[keep] for n, v in r.items()}
        return out + dealt({"core": k["core"], "uid": k["uid"], "first": k["first"], "size": (k["last"] - k["first"]).astype(np.int16), "off": k["off"], "mark": np.zeros(len(k["uid"]), np.int8)}, digit(k["core"], self.buckets), 0)


def _settle_anchors(r: dict[str, np.ndarray], window: int, homes: int) -> list[tuple[int, int, dict]]:
    """One bucket of anchors: the runs of an anchor that occurs once are done, all others are to be expanded."""
    order = np.argsort(r["core"], kind="stable")
    r = {k: v[order] for k, v in r.items()}
    at = np.flatnonzero(np.append(True, r["core"][1:] != r["core"][:-1]))
    size = np.diff(np.append(at, len(order)))
    real = r["mark"] == 0
    hot = np.repeat(np.logical_or.reduceat(~real, at), size)
    want = real & (hot | (np.repeat(size, size) > 1))
    w = {k: v[want] for k, v in r.items()}
    return _orders(w["uid"], w["first"], w["core"], w["off"], homes, np.where(hot[want], EXPAND_WINDOWS, EXPAND), w["first"] + w["size"] + 1)


class _Contexts:
    """Contexts with their bytes: numbers core, uid, first, off, size, and where their bytes begin."""

    def __init__(self, data: list[bytes], core, uid, first, off, window: int):
        self.core, self.uid, self.first, self.off, self.window = core, uid, first, off.astype(np.int64), window
        self.size = np.fromiter(map(len, data), np.int64, len(data))
        self.at = np.cumsum(self.size) - self.size
        self.words = words_of(np.frombuffer(b"".join(data), np.uint8))

    def settle(self) -> tuple[list[tuple], np.ndarray]:
        """(uid, first, stop) of runs that repeat as a whole, and which contexts come first."""
        by = np.lexsort((self.first, self.uid))
        order, new = radix(self.words, self.at[by], self.size[by], self.core[by], self.off[by])
        order = by[order]
        late = order[~new]
        return [(self.uid[late], self.first[late], self.first[late] + self.size[late])], np.sort(order[new])

    def windows(self, own: np.ndarray):
        """(context, place in it) of every window of the contexts ``own``."""
        each = self.size[own] - self.window + 1
        return np.repeat(own, each), np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)

    def settle_windows(self, own: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """(uid, start, stop) of all but the earliest of equal windows, and the (context, place) of the others."""
        k, step = self.windows(own)
        by = np.lexsort((self.first[k] + step, self.uid[k]))
        k, step = k[by], step[by]
        order, new = radix(self.words, self.at[k] + step, np.full(len(k), self.window), self.core[k], self.off[k] - step)
        late = order[~new]
        start = self.first[k[late]] + step[late]
        return [(self.uid[k[late]], start, start + self.window)], k[order[new]], step[order[new]]


def _cut(found: list[tuple], homes: int) -> list[tuple[int, int, dict]]:
    return [x for uid, a, b in found for x in _removals(uid, a, b, homes)]


#: Windows that digit passes order at a time, at the most, but for those of one anchor.
AT_ONCE = 1 << 19


def _expand(texts: dict[int, bytes], r: dict[str, np.ndarray], window: int, buckets: int, homes: int) -> list[tuple[int, int, dict]]:
    """Fetches contexts, or the windows of hot anchors one by one, from a home's texts."""
    out = []
    some = r["what"] == EXPAND
    if some.any():
        u, a, b = r["uid"][some], r["first"][some], r["stop"][some] - 1 + window
        core, off = r["core"][some], r["off"][some]
        bucket = digit(core, buckets)
        order = np.lexsort((a, u, bucket))  # neighbours in a text overlap, which compression takes out
        edge = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        for s, e in zip(edge, np.append(edge[1:], len(order)), strict=True):
            own = order[s:e]
            data = [texts[i][x:y] for i, x, y in zip(u[own].tolist(), a[own].tolist(), b[own].tolist(), strict=True)]
            out.append((int(bucket[own[0]]), 2, pa.RecordBatch.from_arrays([pa.array(core[own]), pa.array(u[own]), pa.array(a[own]), pa.array(off[own]), pa.array(data, pa.binary())], ["core", "uid", "first", "off", "data"])))
    whole = np.flatnonzero(r["what"] == EXPAND_WINDOWS)
    whole = whole[np.argsort(r["core"][whole], kind="stable")]
    for s in range(0, len(whole), 4096):
        own = whole[s : s + 4096]
        data = [texts[i][a:b] for i, a, b in zip(r["uid"][own].tolist(), r["first"][own].tolist(), (r["stop"][own] - 1 + window).tolist(), strict=True)]
        held = _Contexts(data, r["core"][own], r["uid"][own], r["first"][own], r["off"][own], window)
        gone, first = held.settle()
        more, k, step = held.settle_windows(first)
        out += [(buckets + b, n, c) for b, n, c in _cut(gone + more, homes)]
        raw = b"".join(data)
        at = held.at[k] + step
        key = mix64(gram_hashes(np.frombuffer(raw, np.uint8), [window], seed=1013)[0][at])
        bucket = digit(key, buckets)
        by = np.argsort(bucket, kind="stable")  # within a bucket in the order of their bytes
        edge = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
        for x, y in zip(edge, np.append(edge[1:], len(by)), strict=True):
            j = by[x:y]
            strings = pa.array([raw[i : i + window] for i in at[j].tolist()], pa.binary(window))
            out.append((int(bucket[j[0]]), 3, pa.RecordBatch.from_arrays([pa.array(held.uid[k[j]]), pa.array(held.first[k[j]] + step[j]), strings], ["uid", "place", "data"])))
    return out


def _settle_contexts(t: pa.Table, window: int, homes: int) -> list[tuple[int, int, dict]]:
    """One bucket of contexts, as many anchors at a time as keeps the arrays small."""
    order = np.argsort(t.column("core").to_numpy(), kind="stable")
    core, uid, first, off = (t.column(n).to_numpy()[order] for n in ("core", "uid", "first", "off"))
    data, out, at = t.column("data").combine_chunks(), [], 0
    upto = np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False)[order].astype(np.int64))
    while at < len(core):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * AT_ONCE, side="right")))
        to = int(np.searchsorted(core, core[to - 1], side="right"))
        held = _Contexts(data.take(pa.array(order[at:to])).to_pylist(), core[at:to], uid[at:to], first[at:to], off[at:to], window)
        gone, left = held.settle()
        by = left[np.argsort(held.core[left], kind="stable")]
        new = np.append(True, held.core[by][1:] != held.core[by][:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(by)))
        several = by[np.repeat(size, size) > 1]
        out += _cut(gone, homes)
        each = np.cumsum(held.size[several] - window + 1)
        a = 0
        while a < len(several):
            b = max(a + 1, int(np.searchsorted(each, (each[a - 1] if a else 0) + AT_ONCE, side="right")))
            b = int(np.searchsorted(held.core[several], held.core[several[b - 1]], side="right"))
            out += _cut(held.settle_windows(several[a:b])[0], homes)
            a = b
        at = to
    return out


def _settle_strings(t: pa.Table, window: int, homes: int) -> list[tuple[int, int, dict]]:
    """One bucket of hot anchors' windows."""
    uid, place = t.column("uid").to_numpy(), t.column("place").to_numpy()
    by = np.lexsort((place, uid))
    words = words_of(np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint8))
    order, new = radix(words, by * window, np.full(len(by), window))
    late = by[order[~new]]
    return _cut([(uid[late], place[late], place[late] + window)], homes)


def repeats(docs: DataFrame, window: int = 100) -> tuple[DataFrame, int]:
    """Orders to remove bytes, packed per home: (bucket, kind, payload), and the number of homes.

    docs: uid and text. The result is two tables in the shared folder; :func:`with_removals` reads it.
    """
    buckets = homes = buckets_for(docs, 4 << 20)
    texts = docs.select("uid", "text")

    def scan(batches_in):
        held = _Records(window, buckets, homes)
        for batch in batches_in:
            uid = batch.column("uid").to_numpy()
            for i, j, data in text_runs(batch):
                held.add(uid[i:j], data)
                if held.n >= FLUSH:
                    yield from rows(held.flush()).to_batches()
        yield from rows(held.flush()).to_batches()

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:  # orders already
            return passed_on(table, buckets)
        return rows(_settle_anchors(columns_of(table.column("payload")), window, homes))

    orders = written(texts.mapInArrow(scan, SCHEMA).groupBy("bucket").applyInArrow(settle, SCHEMA), "orders")

    def fetch(table: pa.Table) -> pa.Table:
        r = columns_of(of_kind(table, 1))
        if not r or not (r["what"] != REMOVE).any():
            return rows([])
        wanted = r["what"] != REMOVE
        r = {k: v[wanted] for k, v in r.items()}
        need = set(r["uid"].tolist())
        found = {}
        for p in of_kind(table, TEXT):
            t = table_of([p])
            for u, x in zip(t.column("uid").to_pylist(), t.column("text"), strict=True):
                if u in need:
                    found[u] = (x.as_py() or "").encode()
        return rows(_expand(found, r, window, buckets, homes))

    def finish(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return passed_on(table, buckets)
        parts = []
        contexts, strings = table_of(of_kind(table, 2)), table_of(of_kind(table, 3))
        if contexts is not None:
            parts += _settle_contexts(contexts, window, homes)
        if strings is not None:
            parts += _settle_strings(strings, window, homes)
        return rows(parts)

    fetched = packed_texts(texts, homes).unionByName(orders).groupBy("bucket").applyInArrow(fetch, SCHEMA)
    more = written(fetched.groupBy("bucket").applyInArrow(finish, SCHEMA), "more")
    return orders.unionByName(more), homes


def with_removals(docs: DataFrame, orders: DataFrame, homes: int, make, schema) -> DataFrame:
    """make(table of documents, per row a list of removed [start, stop)) -> Arrow table, for all documents of a home."""

    def apply(table: pa.Table) -> pa.Table:
        r = columns_of(of_kind(table, 1))
        gone: dict[int, list] = {}
        if r:
            gone_at = r["what"] == REMOVE
            order = np.lexsort((r["first"][gone_at], r["uid"][gone_at]))
            for u, a, b in zip(r["uid"][gone_at][order].tolist(), r["first"][gone_at][order].tolist(), r["stop"][gone_at][order].tolist(), strict=True):
                own = gone.setdefault(u, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        found = table_of(of_kind(table, TEXT))
        if found is None:
            return make(None, [])
        return make(found, [gone.get(u, []) for u in found.column("uid").to_pylist()])

    return packed_texts(docs, homes).unionByName(orders).groupBy("bucket").applyInArrow(apply, schema)


def _kept(text: str | None, spans: list) -> tuple[bytes, bytes]:
    data, at, parts = (text or "").encode(), 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return data, b"".join([*parts, data[at:]])


def report(docs: DataFrame, window: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(uid, doc_id, text).

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a document before (in the order of
    uid) or earlier in its own. Null text is empty. Rows that repeat a doc_id are documents of their own in the order
    of their texts, so all copies after the first lose what they share. An empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def make(found, spans):
        out = [[], [], [], [], []]
        if found is not None:
            for i, t, s in zip(found.column("doc_id").to_pylist(), found.column("text"), spans, strict=True):
                data, kept = _kept(t.as_py(), s)
                for column, v in zip(out, (i, len(data), len(data) - len(kept), len(s), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(v)
        return pa.table([pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, out, strict=True)], names)

    orders, homes = repeats(docs, window)
    return with_removals(docs.select("uid", "doc_id", "text"), orders, homes, make, schema)


def without_repeats(docs: DataFrame, columns: list[str], window: int = 100) -> DataFrame:
    """docs(uid, *columns) with the repeated bytes of ``text`` gone, and ``n_chars``, if there, counted anew.

    A character of which a cut leaves some bytes only is dropped, so that texts stay valid.
    """
    orders, homes = repeats(docs, window)
    schema = docs.select(*columns).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def make(found, spans):
        if found is None:
            return arrow.empty_table()
        texts = [t.as_py() if not s else _kept(t.as_py(), s)[1].decode("utf-8", "ignore") for t, s in zip(found.column("text"), spans, strict=True)]
        found = found.select(columns).set_column(columns.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in columns:
            k = columns.index("n_chars")
            found = found.set_column(k, "n_chars", pa.array([len(t) if s else n for t, s, n in zip(texts, spans, found.column("n_chars").to_pylist(), strict=True)], arrow.field(k).type))
        return found.cast(arrow)

    return with_removals(docs.select("uid", *columns), orders, homes, make, schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(with_uid(documents(spark, sf_dir)))
