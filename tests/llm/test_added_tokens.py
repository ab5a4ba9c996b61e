"""op1, op7 and the pipeline's packing give the ids of an unmodified tokenizer, with literal added tokens in the texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from ombrix.llm import packing, pretoken, token_files

TEXTS = ["hello <|endoftext|> world", "a<|endoftext|>b", "x  <|endoftext|>\n\n y", "<|startoftext|>Q <|ENDOFTEXT|> z<|endoftext|>", "<|endoftext|><|endoftext|> ", "plain", "é <|endof text|> <|endoftext|>"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def wanted(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: crc([*tok.encode(t, add_special_tokens=False).ids, 0]) for i, t in enumerate(TEXTS)}


def test_queries_give_the_default_ids(spark, folder):
    assert {r.doc_id: r.ids_crc32 for r in token_files.op7_token_files(spark, folder).collect()} == wanted("byte_bpe_50k.json")
    assert {r.doc_id: r.ids_crc32 for r in packing.op1_best_fit_packing(spark, folder).collect()} == wanted("word_bpe_49k.json")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.pack(spark, docs, folder).collect()} == wanted("word_bpe_49k.json")


def test_added_tokens_that_reach_over_cuts():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.add_special_tokens([AddedToken("<| two words |>", special=True), AddedToken("<r>", rstrip=True, special=True)])
    data = ["a <| two words |> b", "x<r>   y z"]
    ids, at = pretoken.library_encoder(tok.to_str(), plain=False, added=True).encode([t.encode() for t in data])
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(2)] == [tok.encode(t, add_special_tokens=False).ids for t in data]
