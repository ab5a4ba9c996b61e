"""Every registered corpus query on awkward tables: nulls in any column, empty and very long texts, repeated rows, clashing columns, no rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ombrix.llm import fingerprint, queries, token_files, toxicity
from tests.llm.test_others import labelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, bucket int, kind string, payload binary, part int, shard int, n long, core string, _salt int"
PAGES = "page_id long, url string, html string, host string, rule string, word string"
DOCUMENT_QUERIES = [n for n in queries.QUERIES if n not in ("op2_url_filter", "op5_nearest_neighbours")]


def extra(i):
    return (None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", None if i % 3 == 0 else 7, f"u{i}", 1, None, b"x", 0, 3, None, "c", 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    rnd = random.Random(9)
    long_text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(150_000))
    texts = [(i, t) for i, t, _ in labelled(120)]
    texts += [(500, None), (501, ""), (502, "   \n"), (503, long_text), (503, long_text), (503, "another"), (None, "no id at all"), (None, "no id at all"), (None, None), (504, "x" * 50_000), (505, "é<|endoftext|>\0 İİ")]
    spark.createDataFrame([(i, t, *extra(k)) for k, (i, t) in enumerate(texts)], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, None) for i, _, y in labelled(120)] + [(None, 1, None), (3, None, None), (0, 7, None)], "doc_id long, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    urls = ["http://example.com/en/7", None, "", "x", "http://", "http://EN.net/de/8" + "a" * 200_000, "http://a.example.com/en/71", "http://a.example.com/en/71"]
    spark.createDataFrame([(None if i == 3 else i // 2, u, None, "h", "r", "w") for i, u in enumerate(urls)], PAGES).write.parquet(f"{path}/pages.parquet")
    return path, texts


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("pages", PAGES), ("embeddings", "vec_id long, embedding array<float>")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_each_row_has_its_result(spark, folder, name):
    path, texts = folder
    out = queries.QUERIES[name](spark, path).toPandas()
    if name.startswith("op1_"):
        whole = out[out.piece == 0]
        assert out.groupby("sequence_id").length.sum().max() <= 2048
    else:
        whole = out
    want = sorted(-1 if i is None else i for i, _ in texts)
    assert sorted(whole.doc_id.fillna(-1).astype(int)) == want
    if name.startswith("op4_"):
        assert sorted(out.decoded_sha256) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts)
    if name.startswith("op6_"):
        counts = out.groupby("shard").size()
        assert counts.max() - counts.reindex(range(40), fill_value=0).min() <= 1
        assert sorted(out.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t in texts)
    if name.startswith("op10_"):
        assert sorted(out.n_chars) == sorted(len(t or "") for _, t in texts)
    if name.startswith("op9_"):
        assert set(out[out.doc_id == 503].component_id) == {503} and out[out.doc_id.isna()].component_id.isna().all()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_urls(spark, folder):
    out = queries.QUERIES["op2_url_filter"](spark, folder[0]).toPandas()
    assert len(out) == 8 and out.page_id.isna().sum() == 1
    long_one = out[out.path.str.len() > 1000]
    assert long_one.host.tolist() == ["en.net"]
    assert (out[out.host == "a.example.com"].verdict == out[out.host == "a.example.com"].verdict.iloc[0]).all() and (out.host == "a.example.com").sum() == 2


def test_pipeline_keeps_columns_that_clash(spark, folder, empty):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_passages):
        out = stage(spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert {r.uid for r in rows} <= {f"u{k}" for k in range(len(texts))} and len({r.uid for r in rows}) == len(rows)
    upper = docs.withColumnRenamed("uid", "UID")
    assert corpus_pipeline.drop_near_duplicates(spark, upper, path).columns == upper.columns
    assert corpus_pipeline.run(spark, path).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_spans_are_bytes_of_the_text():
    text = "İİ bad Ünsinn İ rotten"
    low = text.lower().encode()
    for word in ("bad", "ünsinn", "rotten"):
        a = low.index(word.encode())
        (x, y), = toxicity.in_original(text, [[a, a + len(word.encode())]])
        assert text.encode()[x:y].decode().lower() == word
    assert toxicity.in_original("plain", [[0, 5]]) == [[0, 5]]


@pytest.mark.parametrize("seed", range(3))
def test_select_in_bulk(seed):
    rnd = np.random.default_rng(seed)
    values = np.cumsum(rnd.choice([0, 1, 5, 100_000], 3000, p=[0.3, 0.3, 0.39, 0.01]))
    ef = token_files.EliasFano.encode(values)
    at = rnd.integers(0, 3000, 500)
    assert (ef.select(at) == values[at]).all() and len(ef.select(np.zeros(0, int))) == 0
    with pytest.raises(IndexError):
        ef.select(np.array([3000]))


def plain_digest(text):
    """A digest by the rule of the module's docstring, number by number."""
    n, full = [0] * 256, 0xFFFFFFFF
    for i in range(len(text)):
        for salt, (a, b) in enumerate(((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))):
            if i + b < len(text):
                key = (text[i] | text[i + a] << 8 | text[i + b] << 16) + 0x3C6EF35F * (salt + 1) & full
                key = key * 0x9E3779B1 & full
                n[((key ^ key >> 15) * 0x85EBCA77 & full) >> 24] += 1
    q1, q2, q3 = (sorted(n)[k] for k in (63, 127, 191))
    top, steps = max(q3, 1), [(c > q1) + (c > q2) + (c > q3) for c in n]
    head = [min(255, math.floor(math.log1p(len(text)) * 8)), (q1 * 100 // top % 16) << 4 | q2 * 100 // top % 16]
    return bytes(head + [sum(steps[i + k] << 2 * k for k in range(4)) for i in range(0, 256, 4)]).hex(), [head[0], head[1] >> 4, head[1] & 15, *steps]


def plain_likeness(a, b):
    apart = [abs(x - y) for x, y in zip(a, b, strict=True)]
    body = sum(6 if d == 3 else d for d in apart[3:])
    return max(0.0, 1 - (body + min(apart[0], 32) + sum(min(d, 16 - d) for d in apart[1:3])) / (256 * 26 / 16))


def test_digests_equal_the_rule():
    rnd = random.Random(4)
    texts = [b"", b"ab", b"abc", b"hello hello world " * 9] + [bytes(rnd.randrange(97, 123) for _ in range(n)) for n in (4, 5, 80, 2000)]
    code = fingerprint.codes(texts)
    want = [plain_digest(t) for t in texts]
    assert fingerprint.to_strings(code) == [w[0] for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert math.isclose(fingerprint.likeness(code[i], code[j])[0], plain_likeness(want[i][1], want[j][1]))
