"""An exact Jaccard join of shingle sets by signature trees.

Top of the tree: sets meet in a bucket if they share a key (:mod:`shingles`: size band, part, content of the part), which
similar sets surely do. A key's sets are led by the one of smallest uid; (leader, member) pairs are all that is kept.
Within a group of sets a signature tree is built: leaves are token bitmaps of the sets, sorted by size; a node holds the OR
of its children's bitmaps, their size range, the smallest number of set bits and the largest number of tokens without a
bit of their own. Two nodes are traversed together only if some pair below them could be similar: size ranges must be
compatible, and the common bits plus the tokens without own bits bound every overlap. Leaf pairs that pass are
verified on the whole sets, unless links found before join them already; what leaves a group is a forest of links.

Groups are formed twice, so that few texts travel:

1. each set joins the leader it shares most keys with. Leaders' texts are sent to the homes of their members, once per home, so
   a leader of any number of members is spread over all homes; each home's members of a leader are a group.
2. links found so far make components. Leaders whose sets all lie in one component are settled. The sets of all others are
   cut, by size, into parts of at most MOST_TOKENS / 2 tokens, and each pair of parts of compatible sizes that holds two
   components becomes a group of its own, so nothing is lost and nothing has to fit that cannot.

Components come from alternating large- and small-star steps, joins whose rows never exceed the links. Tokens are 64-bit
hashes of shingles; an overlap is counted on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import SCHEMA, TEXT, coded, columns_of, dealt, digit, home, of_kind, packed_texts, passed_on, rows, table_of
from .common import BLOCK_BYTES, buckets_for, documents, mix64, source_bytes, tidy, with_uid, written
from .pretoken import batches, text_runs
from .shingles import Rule, set_key, shingle_sets

#: Records held by a task before it sends them on.
FLUSH = 1 << 19
#: Tokens of all sets of a task. A set by itself may be larger.
MOST_TOKENS = 1 << 21
FANOUT = 16
_KEYS, _LED, _ROWS, _LEADS, _ASKED, _MEMBERS = 1, 2, 3, 5, 6, 7


class Tree:
    """A signature tree over sets (sorted arrays of 64-bit tokens), in order of size."""

    def __init__(self, sets: list[np.ndarray], bits_per_token: int = 8):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        most = int(self.size.max())
        self.bits = max(64, 1 << int(np.ceil(np.log2(max(1, min(most * bits_per_token, 1 << 16))))))
        leaf = np.zeros((len(sets), self.bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s & np.uint64(self.bits - 1)).astype(np.int64)
            np.bitwise_or.at(leaf[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.bitwise_count(leaf).sum(1).astype(np.int64)
        #: Per level, leaves first: OR of the bitmaps, smallest and largest size, fewest bits, most tokens beyond the bits.
        self.levels = [(leaf, self.size, self.size, ones, self.size - ones)]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, fewest, beyond = self.levels[-1]
            at = np.arange(0, len(bitmap), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(fewest, at), np.maximum.reduceat(beyond, at)))

    def may(self, rule: Rule, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs could hold a similar pair."""
        bitmap, low, high, _, beyond = self.levels[level]
        fits = (rule.num * low[a] <= rule.den * high[b]) & (rule.num * low[b] <= rule.den * high[a])
        out = np.zeros(len(a), bool)
        own = np.flatnonzero(fits)
        for k in range(0, len(own), 4096):
            x, y = a[own[k : k + 4096]], b[own[k : k + 4096]]
            common = np.bitwise_count(bitmap[x] & bitmap[y]).sum(1).astype(np.int64)
            overlap = np.minimum(common + np.minimum(beyond[x], beyond[y]), np.minimum(high[x], high[y]))
            out[own[k : k + 4096]] = (rule.num + rule.den) * overlap >= rule.num * (low[x] + low[y])
        return out

    def pairs(self, rule: Rule, keep=None):
        """Arrays of leaf pairs (a, b), a < b, that the bounds let pass, some at a time. keep(a, b): which are of use."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if not level:
                ok = a < b
                a, b = a[ok], b[ok]
                if keep is not None:
                    ok = keep(a, b)
                    a, b = a[ok], b[ok]
                ok = self.may(rule, 0, a, b)
                if ok.any():
                    yield a[ok], b[ok]
                continue
            ok = self.may(rule, level, a, b)
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 64):
                x = (a[k : k + 64, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
                y = (b[k : k + 64, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
                n = len(self.levels[level - 1][0])
                inside = (x < n) & (y < n) & (x <= y)
                if inside.any():
                    stack.append((level - 1, x[inside], y[inside]))


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum())


def links(sets: list[np.ndarray], rule: Rule, joined: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of links with the components that all links have. Sets in order of size, none empty.

    joined: for each set a number that sets share which are linked already. side: only pairs of differing sides count.
    """
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        s, t = sets
        apart_ = (joined is None or joined[0] != joined[1]) and (side is None or side[0] != side[1])
        return [(0, 1)] if apart_ and rule.num * len(t) <= rule.den * len(s) and rule.similar(_overlap(s, t), len(s), len(t)) else []
    root = np.arange(len(sets))
    if joined is not None:
        _, first, back = np.unique(joined, return_index=True, return_inverse=True)
        root = first[back].astype(np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def apart(a, b):
        for _ in range(64):  # pointers to roots, for all at once
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        out = root[a] != root[b]
        return out if side is None else out & (side[a] != side[b])

    out = []
    tree = Tree(sets)
    for a, b in tree.pairs(rule, apart):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry and rule.similar(_overlap(sets[x], sets[y]), len(sets[x]), len(sets[y])):
                root[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
    return out


class _Keys:
    """Key records of a scan until they are sent. Of equal sets in a batch only the first in order sends its keys."""

    def __init__(self, rule: Rule, k: int, buckets: int, homes: int, bits: int):
        self.rule, self.k, self.buckets, self.homes = rule, k, buckets, homes
        self.shift = np.uint64(64 - bits)
        self.seen: dict[tuple[int, int], int] = {}
        self.reset()

    def reset(self) -> None:
        self.key, self.owner, self.n = [], [], 0
        self.uid, self.size, self.a, self.b = [], [], [], []
        self.seen.clear()

    def add(self, uid: np.ndarray, texts: list[bytes]) -> None:
        for i, j in batches(texts, BLOCK_BYTES):
            for u, s in zip(uid[i:j].tolist(), shingle_sets(texts[i:j], self.k), strict=True):
                name = set_key(s)
                self.uid.append(u)
                self.size.append(len(s))
                self.a.append(name[0])
                self.b.append(name[1])
                if not len(s) or self.seen.get(name, u + 1) <= u:
                    continue
                if name not in self.seen:
                    keys = self.rule.keys(s)
                    self.key.append(keys)
                    self.owner.append((name, len(keys)))
                    self.n += len(keys)
                self.seen[name] = u

    def flush(self) -> list[tuple[int, int, dict]]:
        if not self.uid:
            return []
        uid = np.array(self.uid, np.int64)
        out = dealt({"uid": uid, "n": np.array(self.size, np.int64), "a": np.array(self.a, np.uint64), "b": np.array(self.b, np.uint64)}, home(uid, self.homes), _ROWS, self.buckets)
        if self.key:
            key = np.concatenate(self.key) >> self.shift
            owner = np.repeat(np.arange(len(self.owner)), [n for _, n in self.owner])
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            name, uid = np.array([n[0] for n, _ in self.owner], np.uint64), np.array([self.seen[n] for n, _ in self.owner], np.int64)
            bucket = digit(key << self.shift, self.buckets)
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for i, j in zip(edge, np.append(edge[1:], len(key)), strict=True):
                own = owner[i:j]
                out.append((int(bucket[i]), _KEYS, {"step": np.diff(key[i:j], prepend=np.uint64(0)), "set": coded(name[own]), "uid": coded(uid[own])}))
        self.reset()
        return out


def _led(payloads) -> pa.Table:
    """Of one bucket of keys: (leader, member, keys), for keys that differing sets share."""
    parts = [columns_of([p]) for p in payloads]
    key, name, uid = np.concatenate([np.cumsum(p["step"], dtype=np.uint64) for p in parts]), *(np.concatenate([p[c] for p in parts]) for c in ("set", "uid"))
    order = np.lexsort((uid, name, key))
    key, name, uid = key[order], name[order], uid[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))  # the smallest uid of each set
    key, uid = key[fresh], uid[fresh]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    lead = np.repeat(np.minimum.reduceat(uid, start), np.diff(np.append(start, len(key))))
    keep = lead != uid
    both, n = np.unique(np.stack([lead[keep], uid[keep]], 1), axis=0, return_counts=True)
    return pa.table({"lead": pa.array(both[:, 0], pa.int64()), "uid": pa.array(both[:, 1], pa.int64()), "n": pa.array(n, pa.int64())})


def _sets_of(table: pa.Table, need: set, k: int, found: dict) -> None:
    """Adds the sets of a table's (uid, text) to found, for uids in need."""
    mine = [(u, (x.as_py() or "").encode()) for u, x in zip(table.column("uid").to_pylist(), table.column("text"), strict=True) if u in need]
    for i, j in batches([x for _, x in mine], BLOCK_BYTES):
        found.update(zip([u for u, _ in mine[i:j]], shingle_sets([x for _, x in mine[i:j]], k), strict=True))


def _linked(task: np.ndarray, uid: np.ndarray, found: dict, rule: Rule, joined=None, side=None) -> pa.Table:
    """Links (u, v) within each task."""
    size = np.fromiter((len(found[u]) for u in uid.tolist()), np.int64, len(uid))
    order = np.lexsort((uid, size, task))
    u, v = [], []
    edge = np.flatnonzero(task[order][1:] != task[order][:-1]) + 1
    for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(order)], strict=True):
        own = order[s:e]
        for a, b in links([found[i] for i in uid[own].tolist()], rule, None if joined is None else joined[own], None if side is None else side[own]):
            u.append(uid[own[a]])
            v.append(uid[own[b]])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _sent(df: DataFrame, to: str, kind: int, homes: int) -> DataFrame:
    """Rows of ``df`` (numbers) in buffers for the home of column ``to``."""
    names = df.columns

    def run(batches_in):
        for batch in batches_in:
            if batch.num_rows:
                columns = {n: batch.column(n).to_numpy() for n in names}
                yield from rows(dealt(columns, home(columns[to], homes), kind)).to_batches()

    return df.mapInArrow(run, SCHEMA)


def _first_links(texts: DataFrame, star: DataFrame, homes: int, k: int, rule: Rule) -> DataFrame:
    """Links among the members of star(uid, lead) that share a home, and their leader."""

    def asks(batches_in):
        for batch in batches_in:
            if batch.num_rows:
                lead, to = batch.column("lead").to_numpy(), home(batch.column("uid").to_numpy(), homes)
                both = np.unique(np.stack([lead, to], 1), axis=0)
                yield from rows(dealt({"uid": both[:, 0], "to": both[:, 1]}, home(both[:, 0], homes), _ASKED)).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        r = columns_of(of_kind(table, _ASKED))
        if not r:
            return rows([])
        both = np.unique(np.stack([r["uid"], r["to"]], 1), axis=0)
        parts = []
        for p in of_kind(table, TEXT):
            t = table_of([p])
            uid = t.column("uid").to_numpy()
            here = np.flatnonzero(np.isin(uid, both[:, 0]))
            if len(here):
                parts.append(t.take(pa.array(here)).select(["uid", "text"]))
        held = pa.concat_tables(parts).combine_chunks()
        order = np.argsort(held.column("uid").to_numpy(), kind="stable")
        at = order[np.searchsorted(held.column("uid").to_numpy()[order], both[:, 0])]
        return rows([(b, _LEADS, held.take(c["at"]).combine_chunks().to_batches()[0]) for b, _, c in dealt({"at": at}, both[:, 1], _LEADS)])

    def verify(table: pa.Table) -> pa.Table:
        r, found = columns_of(of_kind(table, _ASKED)), {}
        if not r:
            return _linked(np.zeros(0, np.int64), np.zeros(0, np.int64), found, rule)
        need = set(r["uid"].tolist()) | set(r["lead"].tolist())
        for p, kind in zip(table.column("payload"), table.column("kind").to_pylist(), strict=True):
            if kind != _ASKED:
                _sets_of(table_of([p]), need, k, found)
        leads = np.unique(r["lead"])
        out = _linked(np.concatenate([r["lead"], leads]), np.concatenate([r["uid"], leads]), found, rule)
        found.clear()
        tidy()
        return out

    asked = packed_texts(texts, homes).unionByName(star.mapInArrow(asks, SCHEMA)).groupBy("bucket").applyInArrow(answer, SCHEMA)
    here = packed_texts(texts, homes).unionByName(asked).unionByName(_sent(star, "uid", _ASKED, homes))
    return here.groupBy("bucket").applyInArrow(verify, "u long, v long")


def _parts(members: DataFrame) -> DataFrame:
    """members(lead, uid, n, component), a written table whose size is known, with ``part``: runs of a leader's sets by size, of MOST_TOKENS / 2 tokens or one set."""
    count = buckets_for(members, 4 << 20)

    def run(batches_in):
        part, lead, tokens, most = TaskContext.get().partitionId() << 40, None, 0, MOST_TOKENS // 2
        for batch in batches_in:
            out = []
            for x, n in zip(batch.column("lead").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if x != lead or tokens + n > most:
                    part, lead, tokens = part + 1, x, 0
                tokens += n
                out.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "part"])

    dealt_ = members.repartitionByRange(count, "lead", "n", "uid").sortWithinPartitions("lead", "n", "uid")
    return written(dealt_.mapInArrow(run, "lead long, uid long, n long, component long, part long"), "parts")


def _last_links(texts: DataFrame, led: DataFrame, named: DataFrame, found: DataFrame, homes: int, k: int, rule: Rule) -> DataFrame:
    """Links between components of ``found`` that share a leader."""
    both = components(found)
    own = led.select("lead").distinct().select("lead", F.col("lead").alias("uid")).unionByName(led.select("lead", "uid"))
    held = written(own.join(both, "uid", "left").select("lead", "uid", F.coalesce("component", "uid").alias("component")), "held")
    spans = written(held.groupBy("lead").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b").select("lead"), "spans")
    some = written(held.join(spans, "lead", "left_semi"), "unsettled")
    parts = _parts(written(some.join(named.select("uid", "n"), "uid").select("lead", "uid", "n", "component"), "members"))
    sizes = written(parts.groupBy("lead", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("ca"), F.max("component").alias("cb")), "sizes")
    a = sizes.select("lead", *(F.col(c).alias(f"{c}1") for c in ("part", "low", "high", "ca", "cb")))
    b = sizes.select("lead", *(F.col(c).alias(f"{c}2") for c in ("part", "low", "high", "ca", "cb")))
    # parts of a leader ascend by size; its pairs are as many as the compatible parts, each of which is a task's work
    tasks = a.join(b, "lead").filter(f"part1 <= part2 and {rule.num} * low2 <= {rule.den} * high1 and (ca1 <> cb1 or ca2 <> cb2 or ca1 <> ca2)")
    tasks = written(tasks.select(F.xxhash64("part1", "part2").alias("task"), "part1", "part2"), "tasks")
    first = tasks.select("task", F.col("part1").alias("part"), F.when(F.expr("part1 = part2"), F.lit(2)).otherwise(F.lit(0)).alias("side"))
    ends = first.unionByName(tasks.filter("part1 <> part2").select("task", F.col("part2").alias("part"), F.lit(1).alias("side")))
    asked = parts.join(ends, "part").select("task", F.col("side").cast("long").alias("side"), "uid", "component")

    def fetch(table: pa.Table) -> pa.Table:
        r = columns_of(of_kind(table, _ASKED))
        if not r:
            return rows([])
        out = dealt(r, digit(mix64(r["task"].view(np.uint64)), homes), _MEMBERS)
        wanted = [(b, set(c["uid"].tolist())) for b, _, c in out]
        need, held = set().union(*(w for _, w in wanted)), []
        for p in of_kind(table, TEXT):
            t = table_of([p])
            here = [i for i, u in enumerate(t.column("uid").to_pylist()) if u in need]
            if here:
                held.append(t.take(pa.array(here)).select(["uid", "text"]))
        held = pa.concat_tables(held).combine_chunks()
        at = {u: i for i, u in enumerate(held.column("uid").to_pylist())}
        return rows(out + [(b, TEXT, held.take(pa.array([at[u] for u in w])).combine_chunks().to_batches()[0]) for b, w in wanted])

    def link(table: pa.Table) -> pa.Table:
        r, found = columns_of(of_kind(table, _MEMBERS)), {}
        need = set(r["uid"].tolist())
        for p in of_kind(table, TEXT):
            _sets_of(table_of([p]), need, k, found)
        whole = r["side"] == 2
        # a task of one part counts all its pairs: every set is a side of its own
        side = np.where(whole, np.arange(len(whole)) + 2, r["side"])
        out = _linked(r["task"], r["uid"], found, rule, r["component"], side)
        found.clear()
        tidy()
        return out

    fetched = packed_texts(texts, homes).unionByName(_sent(asked, "uid", _ASKED, homes)).groupBy("bucket").applyInArrow(fetch, SCHEMA)
    return fetched.groupBy("bucket").applyInArrow(link, "u long, v long")


def clusters(docs: DataFrame, k: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """docs(uid, text) to (documents (uid, n, a, b): set size and name; links (u, v) between uids)."""
    buckets = homes = buckets_for(docs, 6 << 20)
    # false matches of shortened keys only make candidates; their share stays under 2 ** -16 at any size
    bits = min(64, max(40, 16 + source_bytes(docs).bit_length()))
    texts = docs.select("uid", "text")

    def scan(batches_in):
        held = _Keys(rule, k, buckets, homes, bits)
        for batch in batches_in:
            uid = batch.column("uid").to_numpy()
            for i, j, data in text_runs(batch):
                held.add(uid[i:j], data)
                if held.n >= FLUSH:
                    yield from rows(held.flush()).to_batches()
        yield from rows(held.flush()).to_batches()

    def lead(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            return passed_on(table, buckets)
        t = _led(table.column("payload"))
        return rows([(0, _LED, t.combine_chunks().to_batches()[0])] if t.num_rows else [])

    grouped = written(texts.mapInArrow(scan, SCHEMA).groupBy("bucket").applyInArrow(lead, SCHEMA), "led")

    def named(batches_in):
        for batch in batches_in:
            for p in batch.column("payload"):
                t = columns_of([p])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t["uid"], t["n"], t["a"].view(np.int64), t["b"].view(np.int64))], ["uid", "n", "a", "b"])

    def pairs(batches_in):
        for batch in batches_in:
            for p in batch.column("payload"):
                yield from table_of([p]).to_batches()

    names = written(grouped.filter(F.col("kind") == _ROWS).mapInArrow(named, "uid long, n long, a long, b long"), "named")
    led = grouped.filter(F.col("kind") == _LED).mapInArrow(pairs, "lead long, uid long, n long")
    led = written(led.groupBy("lead", "uid").agg(F.sum("n").alias("n")), "leaders")
    star = written(led.groupBy("uid").agg(F.max(F.struct("n", (-F.col("lead")).alias("lead"))).alias("_best")).select("uid", (-F.col("_best.lead")).alias("lead")), "star")
    found = written(_first_links(texts, star, homes, k, rule), "found")
    more = written(_last_links(texts, led, names, found, homes, k, rule), "more")
    return names, found.unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(uid, component): the smallest uid reachable, for all ends of edges(u, v), by large- and small-star steps."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("uid"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("uid"), F.col("v").alias("component")).unionByName(roots)


def joined(docs: DataFrame, k: int, rule: Rule) -> DataFrame:
    """(uid, n_shingles, component) of every row of docs(uid, text): component is the smallest uid reachable.

    Documents with equal sets are linked as such; empty ones (null text, no words) are linked with nothing.
    """
    named, found = clusters(docs, k, rule)
    first = named.filter("n > 0").groupBy("n", "a", "b").agg(F.min("uid").alias("first"))
    both = components(found)
    # written, so that the next join is of two plain tables and a hot set's rows can be split
    whole = written(first.join(both.withColumnRenamed("uid", "first"), "first", "left").select("n", "a", "b", F.coalesce("component", "first").alias("component")), "whole")
    return named.join(whole, ["n", "a", "b"], "left").select("uid", F.col("n").alias("n_shingles"), F.coalesce("component", "uid").alias("component"))


def report(docs: DataFrame, k: int = 3, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) of every row of docs(uid, doc_id, text).

    Rows that repeat a doc_id, and rows without one, are documents of their own; a component of rows without
    doc_id has none. An empty table gives no rows.
    """
    out = joined(docs, k, rule or Rule(9, 10))
    ids = docs.select("uid", "doc_id")
    named = written(out.join(ids, "uid"), "joined")
    least = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "component").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, columns: list[str], k: int = 5, rule: Rule | None = None) -> DataFrame:
    """The rows of docs(uid, *columns) that come first in their component."""
    out = joined(docs.select("uid", "text"), k, rule or Rule(4, 5))
    gone = out.filter("uid <> component").select("uid")
    return docs.join(gone, "uid", "left_anti").select(*columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(with_uid(documents(spark, sf_dir)), 3, Rule(90, 100))
