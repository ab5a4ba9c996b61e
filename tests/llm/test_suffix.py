import hashlib
import random

import numpy as np
import pytest

from ombrix.llm import suffix
from ombrix.llm.common import with_uid

SCHEMA = "doc_id long, text string, lang string, uid string, first long"


def brute(rows, window):
    """rows in order; the rule word by word."""
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "é", "the", "or", "in"]) for _ in range(rnd.randint(1, 3)))
    passages = [" ".join(word() for _ in range(rnd.randint(8, 60))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "ab" * 300), (3, "x" * 99), (4, "x" * 250), (5, passages[0])]
    for i in range(6, n):
        text = " ".join(rnd.choice(passages) if rnd.random() < 0.3 else word() for _ in range(rnd.randint(0, 60)))
        rows.append((i, text))
        if rnd.random() < 0.2:
            rows[-1] = (i, rnd.choice(rows)[1])
    return rows


def run(spark, rows, window=100):
    df = spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, suffix.report(with_uid(df), window).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[4]))


@pytest.mark.parametrize(("seed", "many", "flush", "block"), [(1, 16, 1 << 20, 1 << 20), (2, 1, 50, 700)])
def test_equals_the_rule(spark, monkeypatch, by_value, seed, many, flush, block):
    by_value(suffix)
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "FLUSH", flush)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    rows = corpus(seed)
    assert run(spark, rows) == sorted(brute(rows, 100), key=lambda r: r[0])


def test_repeated_and_missing_ids(spark):
    text = "the quick brown fox jumps over the lazy dog " * 4
    rows = [(None, text), (7, text), (7, text), (7, "short")]
    got = run(spark, rows)
    assert sum(r[2] for r in got) == 2 * len(text) + got[0][2] and got[0][0] is None
    assert run(spark, []) == []


def test_texts_without_repeats(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], SCHEMA).withColumnRenamed("uid", "other")
    docs = with_uid(df, "lang", "first")
    out = {r.doc_id: r for r in suffix.without_repeats(docs, ["doc_id", "text", "lang", "first"]).collect()}
    removed = {r[0]: r[2] for r in brute(rows, 100)}
    for i, t in rows:
        if not removed[i]:
            assert out[i].text == t
        else:
            assert len(t.encode()) - removed[i] - 6 * 50 <= len(out[i].text.encode()) <= len(t.encode()) - removed[i]


def test_gram_hashes_are_local():
    buf = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    for a, b in zip(suffix.gram_hashes(buf, [100, 32, 7]), suffix.gram_hashes(buf[5:], [100, 32, 7]), strict=True):
        assert (a[5:] == b).all() and len(np.unique(a[:150])) == 150


def test_verdicts_rest_on_bytes(spark, monkeypatch, by_value):
    """With hashes of four bits almost everything collides, and the result is the same."""
    by_value(suffix)
    strong = suffix.gram_hashes
    monkeypatch.setattr(suffix, "gram_hashes", lambda buf, lengths, seed=7: [h & np.uint64(0xF << 20) for h in strong(buf, lengths, seed)])
    rows = corpus(4, 40)
    assert run(spark, rows) == sorted(brute(rows, 100), key=lambda r: r[0])


def test_long_runs_of_one_character(spark):
    n = 3_000_000
    rows = [(1, "x" * n), (2, "start " + "x" * 400_000 + " end"), (3, "y" * 99)]
    got = {r[0]: r[1:4] for r in run(spark, rows)}
    assert got == {1: (n, n - 1, 1), 2: (400_010, 400_000, 1), 3: (99, 0, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_digit_passes_sort(seed):
    rnd = np.random.default_rng(seed)
    buf = rnd.integers(97, 99, 4000).astype(np.uint8)
    at = rnd.integers(0, 3900, 700)
    depth = rnd.choice([3, 8, 21], 700)
    order, new = suffix.radix(suffix.words_of(buf), at, depth, at % 2)
    keys = [(int(a % 2), int(d), buf[a : a + d].tobytes(), i) for i, (a, d) in enumerate(zip(at, depth, strict=True))]
    assert order.tolist() == [k[3] for k in sorted(keys)]
    last = [keys[i][:3] for i in order]
    assert new.tolist() == [not i or last[i] != last[i - 1] for i in range(700)]
