"""URL filters, sharding, fingerprints, toxicity and nearest neighbours against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ombrix.llm import ann, fingerprint, sharding, toxicity, url_filter
from ombrix.llm.common import ranked, with_uid

SCHEMA = "doc_id long, text string, lang string, uid string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 7) for i, t in rows], SCHEMA)


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, default)
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rnd = random.Random(4)
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.net", "x.y.example.net", "net", "org", "é.org", "a..org", "notexample.com"]
    urls = [None, "", "no scheme", "http://", "://", "a://b://com/en/", "http://com", "http://com?x=/en/", "http://com/en/#/en/", "HTTP://A.COM/en/7"]
    urls += [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/7', '/de/8/x', '/de/', '/es/?q', '/EN/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, html string")
    for rules in (list(url_filter.RULES), [*url_filter.RULES, *((f"h{i}.com", f"/{i % 7}", "block") for i in range(300))]):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()}
        assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES).limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.filter("substr(key, 2) % 97 = 0")
    levels = url_filter.cascade(listed, universe, 7, 20_000)
    answer = universe.withColumn("in", url_filter.listed(levels, F.col("key")))
    assert answer.filter("in").exceptAll(answer.filter("substr(key, 2) % 97 = 0")).count() == 0 and answer.filter("in").count() == 207
    assert sum(level.bits for level in levels) < 40 * 207


def test_shards_are_even_whole_and_keep_copies_together(spark):
    rnd = random.Random(1)
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, f"copy {i % 30}") for i in range(150)] + [(2000 + i, "hot") for i in range(200)] + [(3000, None), (3001, ""), (None, "no id"), (5, "twice"), (5, "twice")]
    rnd.shuffle(rows)
    got = sharding.shard(with_uid(table(spark, rows)), shards=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    spread = [len(homes[zlib.crc32(f"copy {i}".encode())]) for i in range(30)]
    assert sum(n > 1 for n in spread) <= 3 and len(homes[zlib.crc32(b"hot")]) <= 5
    assert sharding.shard(with_uid(table(spark, [])), shards=8).count() == 0
    assert sorted(r.slot for r in sharding.shard(with_uid(table(spark, rows[:3])), shards=8).collect()) == [0, 0, 0]


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = ranked(df, ["k"], ["id"], "at", rows_each=50).groupBy("k").agg(F.countDistinct("at").alias("n"), F.max("at").alias("m"), F.min("at").alias("o")).collect()
    assert all(r.o == 0 and r.m == r.n - 1 for r in got) and sum(r.n for r in got) == 1000


def test_fingerprints(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé") for _ in range(6)) for _ in range(300)]
    rows = [(2 * i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200)))) for i in range(90)] + [(7, None), (9, ""), (1011, "same text here"), (1013, "same text here"), (1015, "x")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(with_uid(table(spark, rows).repartition(4))).collect()}
    order = sorted(rows)
    near, after = [], []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, new = fingerprint.codes([t.encode(), changed.encode()])
        assert r.fingerprint == fingerprint.to_strings(own[None])[0] and (fingerprint.from_string(r.fingerprint) == own).all()
        assert r.edited_fingerprint == fingerprint.to_strings(new[None])[0]
        assert 0 <= r.near_next <= 1 and math.isclose(r.near_edited, fingerprint.likeness(own, new)[0])
        if len(t) > 300:
            near.append(r.near_edited)
            after.append(r.near_next)
    assert got[1011].fingerprint == got[1013].fingerprint and got[1011].near_next == 1.0
    assert np.mean([a > b for a in near for b in after]) > 0.9
    assert fingerprint.fingerprints(with_uid(table(spark, []))).count() == 0
    assert fingerprint.fingerprints(with_uid(table(spark, [(3, "abcdef")]))).first().near_next == 1.0


def test_bucket_counts_of_cut_texts(monkeypatch):
    texts = [bytes(random.Random(i).randrange(256) for _ in range(n)) for i, n in enumerate((0, 1, 2, 3, 4, 5, 100, 5000))]
    whole = fingerprint.bucket_counts(texts)
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", 64)
    assert (fingerprint.bucket_counts(texts) == whole).all()


def labelled(n=400, seed=3):
    rnd = random.Random(seed)
    words, bad = [f"word{i}" for i in range(300)], ["fool", "nasty", "vexabe", "vexado"]
    rows = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 80))]
        toxic = i % 5 == 0
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(bad).upper() + ",")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    docs = table(spark, [(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "no id")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (77777, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit_on(docs, labels)).collect()}
    out = [(got[i], y) for i, _, y in rows if toxicity.held_out(i)]
    assert all(r.held_out for r, _ in out) and np.mean([r.predicted == y for r, y in out]) > 0.97
    text = dict((i, t) for i, t, _ in rows)
    for r, y in out:
        for a, b in r.spans:
            assert text[r.doc_id].lower()[a:b].split(",")[0].strip() in ("fool", "nasty", "vexabe", "vexado") or y
    assert got[9001].score == got[9002].score < 0.3 and len(got) == len(rows) + 3
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit_on(docs, other)).collect()} == {i: r.score for i, r in got.items()}
    none = toxicity.score(docs, toxicity.fit_on(docs, labels.limit(0)))
    assert none.filter("predicted = 1").count() == 0


def test_marginals_equal_the_full_chain():
    rng = np.random.default_rng(0)
    trans, bias, n = rng.normal(size=(2, 2)), -1.5, 40
    places = np.sort(rng.choice(n, 7, replace=False))
    emit = rng.normal(size=7) * 3
    full = np.zeros(n)
    full[places] = emit
    e = np.stack([np.ones(n), np.exp(full + bias)], 1)
    f, b, t = np.zeros((n, 2)), np.ones((n, 2)), np.exp(trans)
    f[0] = e[0]
    for i in range(1, n):
        f[i] = (f[i - 1] @ t) * e[i]
    for i in range(n - 2, -1, -1):
        b[i] = t @ (b[i + 1] * e[i + 1])
    p = f * b
    assert np.allclose(toxicity.chain_marginals(places, emit, n, bias, trans), (p[:, 1] / p.sum(1))[places])


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[100:140] = x[3]
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    rows += [(2000, None, ""), (2100, [0.0] * 16, ""), (2200, [1.0, None] + [0.0] * 14, ""), (2300, [float("nan")] + [1.0] * 15, ""), (2400, [1.0], ""), (2500, [], ""), (None, [1.0] * 16, ""), (700, rows[700][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(df, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.linalg.norm(x - x[q], axis=1)
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hits += len({v for v, _ in found.values()} & set(map(int, order)))
        assert sorted(found) == list(range(1, 11)) and all(math.isclose(s, d[v], rel_tol=1e-9, abs_tol=1e-12) for v, s in found.values())
    assert hits >= 0.95 * 150
    assert [got[100][k][0] for k in range(1, 11)] == [3, *range(101, 110)]
    assert ann.search(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert ann.search(df.filter("vec_id in (0, 1, 2)"), lambda i: i % 100 == 0).count() == 2
