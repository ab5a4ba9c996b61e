import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ombrix.llm import bpe, packing, pretoken, token_files
from ombrix.llm.common import with_uid

SCHEMA = "doc_id long, text string, lang string, uid string, length long"
ODD = ["", None, " ", "\n\n a  b \t\n c", "héllo wörld é à b", "<|endoftext|> x", "日本語 テキスト　全角", "\x1c a \x1d b\x85 c  d", " " * 50 + "x" * 200 + " " * 9, "don't we'll THE'S", "a b" * 9000]


def texts(n=60, seed=5):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(" \n\tab'sé\xa0　.1,漢thin g") for _ in range(rnd.randint(0, 400))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return [(3 * i + 1, t) for i, t in enumerate(texts())]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("name", "plain"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_chunks_give_the_librarys_ids(name, plain, monkeypatch):
    tok, data = library(name), [(t or "").encode() for t in texts(200)]
    encoder = pretoken.ChunkEncoder(pretoken.library_misses(tok), plain, most_chunks=300)
    for most in (1 << 20, 40):
        monkeypatch.setattr(pretoken.blocks, "__defaults__", (most,))
        ids, at = encoder.encode(data)
        for k, t in enumerate(data):
            assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t.decode(), add_special_tokens=False).ids


def test_perfect_hash_is_minimal_and_perfect():
    keys = list(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))[:5000]
    table_ = bpe.PerfectHash(keys)
    assert sorted(table_.slot_key.tolist()) == list(range(5000))
    assert table_.candidates(keys).tolist() == list(range(5000))


def test_bpe_equals_tiktoken_and_round_trips(spark, rows):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r[0]: r[1:] for r in bpe.digests(table(spark, rows), ranks, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_heap_merge_equals_the_plain_rule():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    rnd = random.Random(1)
    for _ in range(300):
        piece = "".join(rnd.choice("aaabthe é") for _ in range(rnd.randint(1, 40))).encode()
        assert bpe.heap_merge(piece, ranks) == plain(piece)


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9, 1000], list(range(0, 9000, 3)), [0] * 200 + [7] * 200, [3, 1 << 40]])
def test_elias_fano(values):
    ef, size = token_files.EliasFano.frombytes(memoryview(token_files.EliasFano.encode(np.array(values)).tobytes()))
    assert ef.all().tolist() == values
    assert [ef[i] for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef[len(values)]


def test_token_files_round_trip(spark, rows, tmp_path):
    tok = library("byte_bpe_50k.json")
    more = [*rows, (None, "no id"), (4, "twice"), (4, "twice")]
    docs = with_uid(table(spark, more))
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, tok.to_str(), file_ids=500)
    got = token_files.token_files(spark, docs, tok.to_str()).collect()
    assert len(got) == len(more)
    start = 0
    by_start = sorted(got, key=lambda r: (r.start, r.n_tokens))
    for r in by_start:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in by_start] == sorted((i for i, _ in more), key=lambda i: (i is not None, i or 0))
    crc = {i: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in more if i != 4}
    assert all(crc[r.doc_id] == r.ids_crc32 for r in by_start if r.doc_id in crc)
    assert token_files.read_token_files(spark, path).count() == len(more)
    assert token_files.token_files(spark, with_uid(table(spark, [])), tok.to_str()).count() == 0


def test_packing_places_every_piece_once(spark, rows):
    tok = library("word_bpe_49k.json")
    more = [*rows, (None, "no id"), (4, "twice"), (4, "twice")] + [(1000 + i, "the cat sat on " * (i % 40)) for i in range(300)]
    out = packing.pack_documents(with_uid(table(spark, more)), tok.to_str(), capacity=64).toPandas()
    assert out.length.max() <= 64
    total = 0
    for i, t in more:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        if i is not None and i != 4:
            own = out[out.doc_id == i].sort_values("piece")
            assert own.piece.tolist() == list(range(-(-len(ids) // 64)))
            for p in own.itertuples():
                part = ids[p.start : p.start + p.length]
                assert p.start == p.piece * 64 and len(part) == p.length and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert out.length.sum() == total
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 64
    assert out.sequence_id.nunique() <= 1.05 * -(-total // 64) + 1
    assert packing.pack_documents(with_uid(table(spark, [])), tok.to_str()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_a_histogram_whole(seed):
    rnd = np.random.default_rng(seed)
    lengths = np.minimum(rnd.lognormal(4.5, 1.2, 3000).astype(int) + 1, 512)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.Plan(histogram, 512)
    used = np.zeros(plan.sequences, int)
    for s, a, b, first, each, offset in sorted(plan.rows, key=lambda r: r[5]):
        assert (b - a) % each == 0
        own = used[first : first + (b - a) // each]
        assert (own == offset).all()
        own += s * each
    assert used.max() <= 512 and used.sum() == lengths.sum() and plan.placed == histogram
    assert plan.sequences <= 1.04 * -(-lengths.sum() // 512) + 1
