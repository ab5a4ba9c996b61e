"""Texts made to collide under weak hashes, and texts full of borders between kinds of characters."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ombrix.llm import bpe, jaccard, packing, pretoken, shingles, token_files
from ombrix.llm.common import SpanHasher, same_spans, with_uid


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


PAIRS = [t for n in (1024, 2048) for t in (thue_morse(n), thue_morse(n, "b", "a"))]


def table(spark, texts):
    return with_uid(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_tokens_of_colliding_texts(spark):
    docs = table(spark, PAIRS)
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    packed = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, word.to_str(), added=True).collect()}
    filed = {r.doc_id: r.ids_crc32 for r in token_files.token_files(spark, docs, byte.to_str(), added=True).collect()}
    coded = {r.doc_id: r for r in bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(PAIRS):
        for got, tok in ((packed, word), (filed, byte)):
            assert got[i] == zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
        assert coded[i].ids_sha256 == hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_sets_of_colliding_texts(spark):
    sets = shingles.shingle_sets([t.encode() for t in PAIRS], 3)
    assert len({int(s[0]) for s in sets}) == len(PAIRS)
    assert {r.doc_id: r.component_id for r in jaccard.report(table(spark, PAIRS)).collect()} == {i: i for i in range(len(PAIRS))}


class Blunt(SpanHasher):
    """One hash for all spans of a length."""

    def __call__(self, buf, starts, ends, words=None):
        return (ends - starts).astype(np.uint64)


def test_memo_compares_bytes():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = pretoken.ChunkEncoder(pretoken.library_misses(tok), False, fine=True)
    encoder.hash = Blunt()
    data = ["the cat sat", "the dog ate", "a hat " * 20, "x" * 600, "y" * 600]
    for _ in range(2):
        ids, at = encoder.encode([t.encode() for t in data])
        for k, t in enumerate(data):
            assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_spans_are_told_apart():
    rnd = np.random.default_rng(3)
    buf = rnd.integers(0, 3, 5000).astype(np.uint8)
    starts = rnd.integers(0, 4000, 500)
    n = rnd.integers(0, 990, 500)
    h = SpanHasher()(buf, starts, starts + n)
    data = [buf[s : s + k].tobytes() for s, k in zip(starts, n, strict=True)]
    assert len(set(h.tolist())) == len(set(data))
    other = rnd.permutation(500)
    m = np.minimum(n, n[other])
    want = [data[i][: m[i]] == data[j][: m[i]] for i, j in enumerate(other)]
    assert same_spans(buf, starts, buf, starts[other], m).tolist() == want
    assert same_spans(buf, starts, buf.copy(), starts, n).all()


BITS = ["don't", "'s", "'", "''", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "12", "3", "...", "!'s", "a", "Z", "é", "ß", "×", "÷", "́", "…", "²", "½", "漢", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "-", "_", "İ", "Σ", "ǅ", "ﬁ", "{", "%%%"]


@pytest.mark.parametrize(("name", "plain"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("added", [True, False])
def test_fine_cuts_give_the_librarys_ids(name, plain, added):
    text = open(public_tokenizers.path(name), encoding="utf-8").read()
    rnd = random.Random(11)
    data = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    encoder = pretoken.library_encoder(text, plain, added)
    assert isinstance(encoder, pretoken.ChunkEncoder) and encoder.fine
    ids, at = encoder.encode([t.encode() for t in data])
    tok = Tokenizer.from_str(text)
    tok.encode_special_tokens = not added
    for k, t in enumerate(data):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
