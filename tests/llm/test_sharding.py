"""Copies end on one shard where shards have room for it."""

import random
from collections import defaultdict

from ombrix.llm import sharding
from ombrix.llm.common import with_uid


def test_groups_with_room_end_whole(spark):
    rnd = random.Random(3)
    groups = [60] * 6 + [rnd.randint(2, 19) for _ in range(30)]
    texts = [f"group {k}" for k, n in enumerate(groups) for _ in range(n)] + [f"alone {i}" for i in range(240)]
    rnd.shuffle(texts)
    got = sharding.shard(with_uid(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), shards=10).collect()
    where, loads = defaultdict(set), defaultdict(int)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
        loads[r.shard] += 1
    assert len(got) == len(texts) and max(loads.values()) - min(loads.values()) <= 1
    assert [t for t, s in where.items() if len(s) > 1] == []


def test_whole_groups_are_packed_largest_first():
    assert sharding.packed({5: 2, 2: 3}, [7, 9]) == ({5: [(0, 1), (1, 1)], 2: [(0, 1), (1, 2)]}, 0)
    assert sharding.packed({5: 3, 1: 1}, [6, 5]) == ({5: [(1, 1), (0, 1)], 1: [(0, 1)]}, 5)
