"""Shards by balanced label propagation over linked documents, in DataFrame operations only.

Documents with equal texts are linked. A linked document starts on a shard by hash; each round counts, for every group of
links, its members on every shard, and members elsewhere ask to move to the shard that holds most. Shards admit
asking members in a fixed order up to their quota, until none asks or the members away from their group's fullest shard
get no fewer. Groups that are still split then move as wholes to shards with room (see :func:`reunite`). Members of a group are interchangeable, so the state is a count
per (group, shard), not a row per document, and no link is ever written out as a pair. Documents without links cut
no edge wherever they are; they come last and fill every shard to its size. Law ``rows``: counts differ by one at most.

A group larger than a shard is cut by hash into sub-groups that fit one, which move on their own.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, ranked, with_uid, written

MOST_MEMBERS = 1 << 22


def _per_shard(values: list[int], shard: Column) -> Column:
    """A value per shard as a literal (their number is the number of shards)."""
    return F.get(F.array(*[F.lit(int(v)) for v in values]), shard.cast("int")).cast("long")


def _running(df: DataFrame, keys: list[str], order: list[str], weight: str, name: str, salts: int) -> DataFrame:
    """The sum of ``weight`` over the rows before, in two steps so that no key has to fit one task."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = df.groupBy(*keys, "_salt").agg(F.sum(weight).alias("_w"))
    sizes = sizes.select(*keys, "_salt", (F.sum("_w").over(W.partitionBy(*keys).orderBy("_salt")) - F.col("_w")).alias("_before"))
    inside = F.sum(weight).over(W.partitionBy(*keys, "_salt").orderBy(*order)) - F.col(weight)
    return df.withColumn("_inside", inside).join(sizes, [*keys, "_salt"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_salt", "_inside", "_before")


def _loads(state: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for s, n in state.groupBy("shard").agg(F.sum("n")).collect():  # a row per shard
        out[s] = n
    return out


def away(state: DataFrame) -> int:
    """Members that are not on the shard that holds most of their group."""
    return state.groupBy("g", "sub").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def packed(sizes: dict[int, int], free: list[int]) -> tuple[dict[int, list[tuple[int, int]]], int]:
    """sizes: number of groups by size. ({size: [(shard, groups)]}, rows of groups that fit nowhere): best fit, the largest first."""
    free, plan, left = list(free), {}, 0
    for size, count in sorted(sizes.items(), reverse=True):
        plan[size] = []
        while count:
            room = [(f, s) for s, f in enumerate(free) if f >= size]
            if not room:
                left += size * count
                break
            f, s = min(room)
            taken = min(count, f // size)
            free[s], count = f - taken * size, count - taken
            plan[size].append((s, taken))
    return plan, left


def reunite(state: DataFrame, quota: list[int], total: int) -> DataFrame:
    """state: (g, sub, shard, n). Adds fixed: whether a group is on one shard and there within its quota.

    Split groups take the room that whole ones leave. If some find none, all groups are placed anew, if that splits fewer rows.
    Groups of a size are interchangeable: what is planned, on the driver, is how many of each size go to each shard.
    """
    group = ["g", "sub"]
    per = written(state.groupBy(*group).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("runs"), F.max("shard").alias("shard")), "groups")
    count = lambda df: {r["size"]: r["count"] for r in df.groupBy("size").count().collect()}  # noqa: E731 - a row per size
    held = _loads(per.filter("runs = 1").withColumnRenamed("size", "n"), len(quota))
    over = [n > q for n, q in zip(held, quota, strict=True)]
    plan, left = packed(count(per.filter("runs > 1")), [max(0, q - n) for q, n in zip(quota, held, strict=True)])
    moving = per.filter("runs > 1")
    if left or any(over):
        anew, left_anew = packed(count(per), quota)
        if left_anew < left + sum(n for n, o in zip(held, over, strict=True) if o):
            plan, moving, over = anew, per, [True] * len(quota)
    rows = [(size, [s for s, _ in to], [sum(n for _, n in to[: i + 1]) for i in range(len(to))]) for size, to in plan.items() if to]
    plans = state.sparkSession.createDataFrame(rows, "size long, shards array<int>, ends array<long>")
    at = ranked(moving.select(*group, "size"), ["size"], group, "_at", total=total).join(F.broadcast(plans), "size")
    placed = at.select(*group, F.get("shards", F.size(F.filter("ends", lambda e: e <= F.col("_at")))).alias("shard"), F.col("size").alias("n"), F.lit(True).alias("fixed")).filter("shard is not null")
    placed = written(placed, "placed_groups")
    whole = per.select(*group, ((F.col("runs") == 1) & (_per_shard([not o for o in over], F.col("shard")) == 1)).alias("fixed"))
    rest = state.join(placed.select(*group), group, "left_anti").join(whole, group).select(*group, "shard", "n", "fixed")
    return written(rest.unionByName(placed), "reunited")


def propagate(state: DataFrame, quota: list[int], rounds: int | None, salts: int) -> DataFrame:
    """state: (g, sub, shard, n). Moves members towards their group's fullest shard while quotas allow.

    Ends when no member asks, or when no fewer are away than before, or after ``rounds`` if given.
    """
    shards, group = len(quota), ["g", "sub"]
    last = away(state)
    for _ in itertools.count() if rounds is None else range(rounds):
        loads = _loads(state, shards)
        free = [q - n for q, n in zip(quota, loads, strict=True)]
        score = F.struct(F.col("n"), F.xxhash64(*group, "shard").alias("tie"), F.col("shard").alias("s"))
        room = F.when(_per_shard(free, F.col("shard")) > 0, score)
        best = state.groupBy(*group).agg(F.max(score).alias("top"), F.max(room).alias("open"))
        want = F.when((_per_shard(free, F.col("top.s")) > 0) | F.col("open").isNull(), F.col("top.s")).otherwise(F.col("open.s"))
        asked = state.join(best, group).withColumn("to", want)
        stays = (F.col("shard") == F.col("top.s")) | (F.col("shard") == F.col("to"))
        asked = written(asked.select(*group, "shard", "n", F.when(stays, None).otherwise(F.col("to")).alias("to")), "asked")
        movers = asked.filter("to is not null")
        out = [0] * shards
        asking = 0
        for s, n in movers.groupBy("shard").agg(F.sum("n")).collect():
            out[s], asking = n, asking + n
        if not asking:
            break
        allowed = _per_shard([max(0, f + o) for f, o in zip(free, out, strict=True)], F.col("to"))
        movers = _running(movers, ["to"], [*group, "shard"], "n", "_ahead", salts).withColumn("moved", F.greatest(F.lit(0), F.least(F.col("n"), allowed - F.col("_ahead"))))
        moved = movers.select(*group, F.inline(F.array(F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")), F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("moved")).alias("n"))))).filter("n > 0")
        state = written(asked.filter("to is null").select(*group, "shard", "n").unionByName(moved).groupBy(*group, "shard").agg(F.sum("n").alias("n")), "state")
        now = away(state)
        if now >= last:
            break
        last = now
    return state


def shard(docs: DataFrame, shards: int = 40, rounds: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of docs(uid, doc_id, text).

    size is the text's UTF-8 bytes (null: none) plus 16. Null and empty texts are equal texts. Rows that repeat a
    doc_id are rows of their own. An empty table gives no rows; with fewer rows than shards some shards are empty.
    """
    text = F.coalesce("text", F.lit(""))
    nodes = docs.select("uid", "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"))
    nodes = written(nodes, "nodes")
    total = nodes.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    salts = max(64, math.ceil(total / (1 << 20)))
    chunk = max(1, min(int(0.9 * (total // shards)), MOST_MEMBERS))
    groups = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # written, so that the joins are of two plain tables and a hot group's rows can be split
    groups = written(groups.select("g", F.ceil(F.col("members") / chunk).cast("int").alias("subs")), "linked_texts")
    linked = nodes.join(groups, "g").select("uid", "doc_id", "size", "text_crc32", "g", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("subs")).cast("int").alias("sub"))
    linked = written(linked, "linked")
    first = F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(shards)).cast("int")
    state = written(linked.groupBy("g", "sub", first.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "state")
    state = propagate(state, quota, rounds, salts)

    state = reunite(state, quota, total)

    # what a shard holds over its quota gives way, never a group that is whole; those members are placed like documents without links
    room = [q - n for q, n in zip(quota, _loads(state.filter("fixed"), shards), strict=True)]
    rest = _running(state.filter("not fixed"), ["shard"], ["g", "sub"], "n", "_ahead", salts)
    rest = rest.withColumn("n", F.greatest(F.lit(0), F.least(F.col("n"), _per_shard(room, F.col("shard")) - F.col("_ahead")))).filter("n > 0")
    state = state.filter("fixed").select("g", "sub", "shard", "n").unionByName(rest.select("g", "sub", "shard", "n"))
    state = written(state.select("g", "sub", "shard", "n"), "kept")
    runs = state.groupBy("g", "sub").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("runs"))  # a run per shard at most
    ends = F.transform("runs", lambda r, i: F.aggregate(F.slice("runs", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    members = ranked(linked, ["g", "sub"], ["uid"], "_at").join(runs.withColumn("ends", ends), ["g", "sub"], "left")
    place = F.get(F.col("runs.shard"), F.size(F.filter("ends", lambda e: e <= F.col("_at"))))
    columns = ["uid", "doc_id", "size", "text_crc32"]
    members = written(members.select(*columns, place.alias("shard")), "members")
    settled = members.filter("shard is not null")

    loads = _loads(state, shards)
    upto, ends_free = 0, []
    for q, n in zip(quota, loads, strict=True):
        upto += q - n
        ends_free.append(upto)
    loose = nodes.join(groups, "g", "left_anti").select(*columns).unionByName(members.filter("shard is null").select(*columns))
    filled = ranked(loose, [], ["uid"], "_at", total=total)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends_free])
    filled = filled.select(*columns, F.size(F.filter(bounds, lambda e: e <= F.col("_at"))).alias("shard"))
    placed = written(settled.unionByName(filled.withColumn("shard", F.col("shard").cast("int"))), "placed")
    return ranked(placed, ["shard"], ["uid"], "slot", total=total).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(with_uid(documents(spark, sf_dir)))
