"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripweave.llm import byte_bpe
from tripweave.llm import queries as text_queries

DATA, PATTERN = text_queries.public_ranks()
RANKS = byte_bpe.read_ranks(DATA)
KNOWN = tiktoken.Encoding("known", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = byte_bpe.Tokenizer(RANKS, PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert OWN.encode(text).tolist() == KNOWN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(RANKS)), max_size=6).map(b"".join))
def test_any_sequence_of_tokens_as_one_match(piece):
    if piece:
        assert list(OWN.words.transducer.encode(piece)) == KNOWN._core_bpe.encode_single_piece(piece)


def test_certain_tokens_come_out_early(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LOOKAHEAD", 3)
    rng = random.Random(5)
    machine = byte_bpe.Transducer(RANKS, states=50, pairs=100)
    for _ in range(400):
        piece = "".join(rng.choices("thenatiosr éü", k=rng.randint(1, 60))).encode()
        assert list(machine.encode(piece)) == KNOWN._core_bpe.encode_single_piece(piece)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.integers(1, 5))
def test_streamed_decoding(text, block):
    ids = OWN.encode(text)
    parts = list(OWN.stream(ids, block))
    assert b"".join(data for data, _ in parts) == text.encode()
    assert "".join(piece for _, piece in parts) == text


def test_cut_and_broken_bytes():
    machine = byte_bpe.StreamDecoder()
    assert [machine.feed(bytes([b])) for b in "é漢😀a".encode()] == ["", "é", "", "", "漢", "", "", "", "😀", "a"]
    assert machine.feed(b"\xe6\xbc") == "" and machine.close() == "�"


def test_digests_of_odd_texts(odd, empty):
    frame = odd.withColumn("n_tokens", F.lit("mine"))
    rows = byte_bpe.token_digest(frame, "text", DATA, PATTERN, ids="ids").collect()
    assert len(rows) == 12
    for row in rows:
        ids = KNOWN.encode_ordinary(row.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (row.n_tokens, row.ids) == (len(ids), ids)
        assert row.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
        assert row.round_trip
    assert byte_bpe.token_digest(empty, "text", DATA, PATTERN).count() == 0


def test_columns_of_ids_and_back(odd):
    ids = byte_bpe.token_ids(F.col("text"), DATA, PATTERN)
    back = odd.select("text", ids.alias("ids")).select(
        "text", byte_bpe.decoded_text(F.col("ids"), DATA, PATTERN).alias("back")
    )
    assert all(r.back == (r.text or "") for r in back.collect())


def test_query_matches_the_library(spark, small):
    found = text_queries.queries()["op8_byte_bpe"](spark, small)
    texts = text_queries.table(spark, small, "documents").select("doc_id", "text")
    for row in found.join(texts, "doc_id").collect():
        assert row.n_tokens == len(KNOWN.encode_ordinary(row.text)) and row.round_trip


def test_ranks_without_single_bytes_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.Transducer({b"ab": 0}).encode(b"abc")
