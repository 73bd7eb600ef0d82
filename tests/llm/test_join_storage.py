"""The near-duplicate join writes a set's start once, and makes no Python object per token."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tripweave.llm import ngram_join, text_blocks


def block_of(texts):
    column = pa.array(texts)
    (block,) = text_blocks.blocks(column)
    return block


def test_profile_parts_are_those_of_single_sets():
    rarity = np.arange(1 << 8, dtype=np.uint8) % 7
    texts = ["a b c d e f g", "", None, "x", "a b c d e f g", " ".join(f"w{i % 90}" for i in range(200)), ""]
    tokens, bounds = ngram_join.block_sets(block_of(texts), rarity, ngram_join._hasher(), 5)
    nodes = ngram_join._set_nodes(tokens, bounds).to_pylist()
    keys = ngram_join._set_keys(tokens, bounds)
    for text, (first, last) in enumerate(zip(bounds, bounds[1:])):
        own = tokens[first:last]
        if len(own) == 0:
            assert nodes[text] is None
            continue
        total = ngram_join.set_names(own).sum(dtype=np.uint64) + np.uint64(len(own))
        assert nodes[text] == int(text_blocks.mixed(np.array([total])).view(np.int64)[0])
        low = np.array(
            [text_blocks.mixed(own ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)).min() for seed in (1, 2, 3)]
        )
        assert keys[text].tolist() == text_blocks.mixed(low * np.uint64(3) + np.roll(low, 1)).view(np.int64).tolist()
    assert nodes[0] == nodes[4] and len({n for n in nodes if n is not None}) == 3
    empty = ngram_join.block_sets(block_of(["", None]), rarity, ngram_join._hasher(), 5)
    assert ngram_join._set_nodes(*empty).to_pylist() == [None, None]


def test_lists_cost_their_values_alone():
    values, lengths = np.arange(400_000), np.full(4000, 100)
    tracemalloc.start()
    lists = ngram_join._lists(values, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lists[3999].as_py() == list(range(399_900, 400_000))
    # Python numbers alone would take 32 bytes each.
    assert peak < 2_000_000


def test_only_copies_are_stored_as_classes(spark, monkeypatch):
    """A set that one document has is read where the documents are stored."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(100, texts[0]), (101, texts[0]), (102, texts[1].upper())]
    kept, store = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: kept.append(store(df)) or kept[-1])
    found = ngram_join.find_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {
        **{i: i for i in range(40)}, 100: 0, 101: 0, 102: 1
    }
    classes = [df for df in kept if {"rep", "start", "keys"} <= set(df.columns) and "own" not in df.columns]
    assert [df.count() for df in classes] == [2]
    documents = kept[0].where(F.size("tokens") > 0)
    assert documents.count() == 43 and ngram_join._classes(documents).count() == 40
