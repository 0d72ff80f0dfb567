import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendset.llm import pieces
from mendset.llm.queries import QUERIES, piece_model

MODEL = piece_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ODD = [
    "", " ", "   x", "x   y  ", "a" * 5000, "▁x ▁▁", "日本語 漢字", "🙂é́", "\x00\x01\n\n\t x", "<s></s><unk><0x41>",
    "ab" * 3000, " " * 100 + "y", "1234567 12", "��",
]


def same_as_library(texts):
    got = [ids.tolist() for ids in pieces.encode_batch(pieces.load(MODEL), pa.array(texts, pa.string()))]
    assert got == [LIBRARY.encode(t or "") for t in texts]


def test_odd_texts():
    same_as_library([*ODD, None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeth 01\n▁ß漢🙂"), max_size=60), max_size=6))
def test_drawn_texts(texts):
    same_as_library(texts)


def test_word_beyond_a_block_and_long_words():
    letters = "".join(chr(97 + k) for k in np.random.default_rng(1).integers(0, 26, 6000))
    same_as_library([letters, "x " + letters + " y"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=12))
def test_decode_any_ids(ids):
    assert pieces.decode_ids(pieces.load(MODEL), np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError):
        pieces.decode_ids(pieces.load(MODEL), np.array([32000]))


def test_query(spark, sf):
    rows = QUERIES["op1_sentencepiece"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = [1, *LIBRARY.encode(texts[r.doc_id] or ""), 2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_columns_and_nulls(spark):
    schema = "doc_id bigint, text string, n_tokens string, decoded int"
    docs = spark.createDataFrame([(1, None, "a", 1), (1, None, "a", 1), (2, "Hi", None, None)], schema)
    rows = pieces.tokenized(docs, MODEL).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.decoded) for r in rows] == [(2, ""), (2, ""), (len(LIBRARY.encode("Hi")) + 2, "Hi")]
    assert pieces.tokenized(docs.filter("false"), MODEL).count() == 0
    assert docs.select(pieces.encode(F.lit(""), MODEL)["n_tokens"]).first()[0] == 0
