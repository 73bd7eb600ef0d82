"""Radix tree layouts, and the conversation trie against a plain rewrite over tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripweave.llm import conversation_trie, radix_tree
from tripweave.llm import queries as text_queries

SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(max_size=12), st.integers(), max_size=80), st.randoms())
def test_tree_finds_what_was_put_in(held, order):
    tree = radix_tree.RadixTree()
    for key in order.sample(list(held), len(held)):
        tree.insert(key, held[key])
    assert all(tree.get(key) == value for key, value in held.items())
    assert all(tree.get(key + b"x") == held.get(key + b"x") for key in held)
    met = [node.value for node, *_ in tree.bottom_up() if node.value is not None]
    assert sorted(met) == sorted(held.values())


def test_layouts_grow_and_paths_are_compressed():
    tree = radix_tree.RadixTree()
    sizes = []
    for n in range(256):
        tree.insert(b"common" + bytes([n * 7 % 256]) + b"tail", n)
        if n:
            sizes.append(tree.root.layout.size)
    assert [sizes.index(size) + 2 for size in (4, 16, 48, 256)] == [2, 5, 17, 49]
    assert tree.root.prefix == b"common"
    assert [child.prefix for child in tree.root.children()] == [b"tail"] * 256
    assert [child.value * 7 % 256 for child in tree.root.children()] == list(range(256))


def brute(sequences):
    """Nodes of {id: tuple of (role, text)}."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        own = (len(convs) - 1) * len(node[-1][1]) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += own
    rows = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if sequences[c] == node))
        rows.add(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(children[node]),
                leaves[node],
                saved[node],
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return rows


def sequences(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for _, _, r, t in sorted(turns)) for c, turns in found.items()}


def rebuilt(plain):
    made = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = plain.get(c - int(f"{c:+d}"[0] + str(abs(c) % 100)), ())[:h] + turns[h:]
    return made


def random_rows(seed, convs=240, words=3):
    """Few words, so that many conversations share their starts or everything."""
    dice = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(dice.choice((0, 1, 1, 2, 3, 5, 9))):
            rows.append((c, turn, dice.choice(("user", "bot")), "é" * dice.randrange(words)))
    return rows


def nodes_of(frame, **options):
    found = conversation_trie.prefix_tree(conversation_trie.keys(frame), **options)
    rows = [tuple(row) for row in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("tree_bytes,fan", [(1 << 22, 64), (600, 64), (150, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, tree_bytes, fan):
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    rows = random_rows(tree_bytes)
    # A long conversation whose start others share, and one turn that very many have first.
    rows += [(1000 + c, t, "user", f"t{t}") for c in range(5) for t in range(40 + 10 * c)]
    rows += [(2000 + c, t, "user", "first" if t == 0 else f"{c % 37}") for c in range(150) for t in (0, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes_of(frame, tree_bytes=tree_bytes) == brute(sequences(rows))


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PACK", 7)
    rows = [(c, t, "user", f"{t}") for c in range(500) for t in range(2)] + [(-3, 0, "user", "0")]
    assert nodes_of(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(sequences(rows))


def test_order_of_turns(spark):
    rows = [(1, 2, "b", "z"), (1, None, "b", "y"), (1, 10, None, None), (2, 0, "b", "y"), (2, 1, "b", "z")]
    rows += [(3, 0, "b", "y"), (3, 0, "a", "x"), (3, 0, "a", "x"), (None, 0, "b", "y")]
    assert nodes_of(spark.createDataFrame(rows, SCHEMA)) == brute(sequences(rows))


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, "1:a", "bc")]
    assert len(nodes_of(spark.createDataFrame(rows, SCHEMA))) == 5


def test_very_long_text_and_other_columns(spark):
    frame = spark.createDataFrame([(7, 0, "user", "ü" * 300_000), (8, 0, "user", "ü" * 300_000)], SCHEMA)
    frame = frame.withColumns({"key": F.lit(1), "said": F.lit(2), "id": F.lit(3), "depth": F.lit(4)})
    none = conversation_trie.NO_ENDS
    ends = hashlib.sha256(b"7,8").hexdigest()
    assert nodes_of(frame) == {(7, 0, None, 2, 1, 1, 300_000, none), (7, 1, 7, 2, 0, 1, 300_000, ends)}


def test_empty_tables_have_no_nodes(spark):
    assert nodes_of(spark.createDataFrame([], SCHEMA)) == set()
    assert nodes_of(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == set()


def test_query_rebuilds_conversations(spark, tmp_path):
    rows = [(c * 7 - 400, t, r, x) for c, t, r, x in random_rows(11, words=9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(row) for row in text_queries.op13_conversation_trie(spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rebuilt(sequences(rows)))
    # Some conversation shorter than its graft is left without turns.
    assert any(not turns for turns in rebuilt(sequences(rows)).values())
