import random

import numpy as np
import pytest

from ombrix.llm import jaccard
from ombrix.llm.common import with_uid
from ombrix.llm.shingles import Rule, set_key, shingle_sets

SCHEMA = "doc_id long, text string, lang string, uid string, n long"


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, k, num, den):
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d if d is not None else -1), len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "a a a a a a a a"), (7, "A A A A")]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))] for _ in range(12)]
    for i in range(8, n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 2)
            words = words or ["x"]
        rows.append((2 * i, " ".join(words)))
    return rows


def run(spark, rows, k, rule):
    df = spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    got = jaccard.report(with_uid(df), k, rule).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)


@pytest.mark.parametrize(("seed", "k", "num", "den", "flush", "most"), [(1, 3, 90, 100, 1 << 20, 1 << 21), (2, 5, 4, 5, 200, 400), (3, 3, 1, 2, 200, 150)])
def test_equals_brute_force(spark, monkeypatch, by_value, seed, k, num, den, flush, most):
    by_value(jaccard)
    monkeypatch.setattr(jaccard, "FLUSH", flush)
    monkeypatch.setattr(jaccard, "MOST_TOKENS", most)
    rows = corpus(seed)
    assert run(spark, rows, k, Rule(num, den)) == brute(rows, k, num, den)


def test_repeated_and_missing_ids_and_empty_table(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(None, text), (9, text), (9, text), (9, "another text altogether here"), (4, text), (None, "alone with no id")]
    assert run(spark, rows, 3, Rule(9, 10)) == sorted([(-1, 7, 4), (9, 7, 4), (9, 7, 4), (9, 2, 9), (4, 7, 4), (-1, 2, -1)])
    assert run(spark, [], 3, Rule(9, 10)) == []


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_key_and_trees_lose_none(seed):
    rnd = np.random.default_rng(seed)
    for rule in (Rule(9, 10), Rule(4, 5)):
        sets = []
        for _ in range(60):
            base = rnd.integers(0, 1 << 63, rnd.integers(1, 400), dtype=np.uint64)
            sets.append(np.unique(base))
            for _ in range(rnd.integers(0, 5)):
                keep = base[rnd.random(len(base)) > rnd.choice([0.0, 0.02, 0.05, 0.1])]
                more = rnd.integers(0, 1 << 63, rnd.integers(0, 1 + len(base) // 12), dtype=np.uint64)
                if len(keep) + len(more):
                    sets.append(np.unique(np.concatenate([keep, more])))
        sets.sort(key=len)
        similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if rule.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        keys = [set(rule.keys(s).tolist()) for s in sets]
        assert all(keys[i] & keys[j] for i, j in similar)
        passed = {(x, y) for a, b in jaccard.Tree(sets).pairs(rule) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        assert similar <= passed
        assert len(passed) < 0.2 * len(sets) ** 2


def test_set_names():
    a, b, c = shingle_sets([b"A b c d", b"a  B\tc d", b"d c b a"], 3)
    assert set_key(a) == set_key(b) != set_key(c) and len(a) == 2
