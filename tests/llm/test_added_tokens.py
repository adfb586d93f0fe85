"""Texts with an added token's content against an unmodified tokenizer."""

import zlib

import numpy as np
import pytest

from cloudloom.llm import queries, tokens

pytest.importorskip("public_tokenizers")
TEXTS = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>\n\n<|endoftext|>b", "x\x1c <|endoftext|>", "<|endoftext |>", "plain words, no more", "a  b\tc", None]


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_encoder_finds_added_tokens():
    texts = [t or "" for t in TEXTS]
    got = tokens.Encoder(queries.tokenizer_path(), added=True).encode(texts)
    assert [x.tolist() for x in got] == [ids_of(t) for t in texts] and 50256 in got[1]


def test_registered_queries_find_added_tokens(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    want = {i: np.array([*ids_of(t), 0], "<u4") for i, t in enumerate(TEXTS)}
    crc = {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op6_token_files(spark, d).collect()} == crc
    assert {r.doc_id: (r.length, r.ids_crc32) for r in queries.op3_best_fit_packing(spark, d).collect()} == crc
