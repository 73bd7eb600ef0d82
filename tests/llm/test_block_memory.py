"""Workers number the n-grams of a bounded part of their texts at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tripweave.llm import language_id, ngram_join, text_blocks


def column_of(texts=400, words=800):
    rng = random.Random(3)
    return pa.array([" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9999)}word" for _ in range(words)) for _ in range(texts)])


def peak_of(run):
    tracemalloc.start()
    result = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return result, peak


def test_languages_are_scored_in_bounded_memory(monkeypatch):
    column = column_of()
    scores = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 3))
    model = language_id.Model(["a", "b", "c"], scores, np.zeros(3), 1.0, 0.0)
    found, peak = peak_of(lambda: language_id.score_texts(model, column))
    monkeypatch.setattr(language_id, "BLOCK_BYTES", text_blocks.BLOCK_BYTES, raising=False)
    whole = language_id.score_texts(model, column)
    assert found == whole
    assert peak < 50_000_000


def test_sets_are_the_same_in_smaller_blocks():
    column = column_of(60)
    rarity = np.arange(1 << 8, dtype=np.uint8) % 7

    def sets(limit):
        parts = [
            ngram_join.block_sets(block, rarity, ngram_join._hasher(), 5) for block in text_blocks.blocks(column, limit)
        ]
        return np.concatenate([tokens for tokens, _ in parts]), sum(len(bounds) - 1 for _, bounds in parts)

    small, whole = sets(ngram_join.BLOCK_BYTES), sets(1 << 30)
    assert small[1] == whole[1] == 60 and (small[0] == whole[0]).all()
