"""Prefix trie of conversations, from adaptive radix trees over fixed-width big-endian turn ids.

A turn's id has 16 bytes: 96 bits of the MD5 of its role and text, then the text's code points as a
big-endian number. A conversation is the string of its turns' ids. Every task gets a range of the sorted
distinct strings and builds a radix tree over them; of its byte depths only those where a turn ends become
nodes of the trie.

A node is whole in one task unless it is a prefix of the task's first or last string. Those nodes (two
paths a task) are open: they are merged ``FAN`` neighbouring tasks at a time, in rounds, until all are whole.
Children of open nodes learn their parent's smallest member by a join with the table of open nodes.

The digest of the ids that end at a node must see them in order. Ids are sorted over many tasks, each joins
its ids to texts of up to ``PACK`` ids, and one task per string streams those texts through SHA-256; a string
shared by very many conversations costs that task the hashing alone.

A conversation's ids (16 bytes a turn, never its texts) meet in one row, which is the unit of work.

Defined cases: turns are ordered by number, nulls first; equal numbers by role, then by id; repeated rows are
turns of their own; a null role or text is empty; rows without a conversation id belong to none and go; a
conversation without turns is a member of the root; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.radix_tree import RadixTree
from tripweave.llm.storage import stored
from tripweave.session import broadcast_if_small

HASH = 12  # bytes of an id that come from MD5
WIDTH = 16  # bytes of an id
PACK = 1024  # ids in one packed text
TREE_BYTES = 4 << 20  # bytes of strings that one tree is meant to hold
FAN = 64  # tasks whose open nodes are merged at once
ROWS = 4096  # rows in an Arrow batch of results

NO_ENDS = hashlib.sha256(b"").hexdigest()

_ENDS = pa.schema(
    [("key", pa.binary()), ("conv_id", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())]
)
_NODES = pa.schema(
    [
        ("part", pa.int32()),
        ("open", pa.bool_()),
        ("at_first", pa.bool_()),
        ("at_last", pa.bool_()),
        ("path", pa.binary()),
        ("parent_path", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
        ("length", pa.int64()),
    ]
)
NODES = (
    "part int, open boolean, at_first boolean, at_last boolean, path binary, parent_path binary, "
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, length bigint"
)
RESULT = (
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
)


def keys(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id`` and ``key``, the ids of its turns in order."""
    said = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # The role's length comes first, so that no other role and text give the same string.
    marked = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    length = F.lpad(F.hex(F.char_length("text")), 2 * (WIDTH - HASH), "0")
    named = said.select(
        "conv_id", F.struct("turn", "role", F.concat(F.substring(marked, 1, 2 * HASH), length).alias("id")).alias("said")
    )
    ordered = F.sort_array(F.collect_list("said"))
    return named.groupBy("conv_id").agg(
        F.unhex(F.array_join(F.transform(ordered, lambda turn: turn.id), "")).alias("key")
    )


def turns(key: str = "key", first: str = "0", count: str | None = None) -> F.Column:
    """``count`` turns (or all) of a key after the first ones."""
    if count is None:
        return F.expr(f"substring({key}, {WIDTH} * ({first}) + 1)")
    return F.expr(f"substring({key}, {WIDTH} * ({first}) + 1, {WIDTH} * ({count}))")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = ROWS) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def endings(sequences: DataFrame) -> DataFrame:
    """One row per distinct key: smallest id, number of ids, and the digest of the ids in order."""
    packs = pa.schema(
        [("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            key, ids = None, []
            for next_key, conv in _rows(batches):
                if ids and (next_key != key or len(ids) == PACK):
                    yield key, ids[0], len(ids), ",".join(map(str, ids))
                    ids = []
                key = next_key
                ids.append(conv)
            if ids:
                yield key, ids[0], len(ids), ",".join(map(str, ids))

        # A row holds up to 20 KB of ids.
        yield from _batches(packed(), packs, 512)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digested():
            key = None
            for next_key, conv, n, ids in _rows(batches):
                if next_key != key:
                    if key is not None:
                        yield key, first, total, state.hexdigest()
                    key, first, total, state = next_key, conv, 0, hashlib.sha256()
                elif total:
                    state.update(b",")
                state.update(ids.encode())
                total += n
            if key is not None:
                yield key, first, total, state.hexdigest()

        yield from _batches(digested(), _ENDS)

    ordered = sequences.select("key", "conv_id").repartitionByRange("key", "conv_id")
    packed = ordered.sortWithinPartitions("key", "conv_id").mapInArrow(
        pack, "key binary, conv_id bigint, n bigint, ids string"
    )
    met = packed.repartition("key").sortWithinPartitions("key", "conv_id")
    return met.mapInArrow(digest, "key binary, conv_id bigint, n_ends bigint, ends_sha256 string")


def _paths(key: bytes) -> list[bytes]:
    """A name for each prefix of whole turns, the empty one first."""
    state = hashlib.md5()
    names = [state.digest()]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        names.append(state.digest())
    return names


def _length(key: bytes, depth: int) -> int:
    """Code points of the last text of a prefix; the root has none."""
    return int.from_bytes(key[depth * WIDTH - WIDTH + HASH : depth * WIDTH]) if depth else 0


@dataclass(slots=True)
class _Below:
    """What a node of the radix tree hands to the trie node above it."""

    key: bytes  # some key through the node
    conv: int
    n_convs: int
    tops: list[int]  # rows of the highest trie nodes at or below it


def trie_rows(tree: RadixTree, part: int) -> list[list]:
    """Rows of ``NODES`` for a task's tree; values are (key, smallest id, ids, digest)."""
    first = {id(tree.root)}
    node = tree.root
    while node.value is None:
        node = node.children()[0]
        first.add(id(node))
    first_names = _paths(node.value[0])
    last = {id(tree.root)}
    node = tree.root
    while under := node.children():
        node = under[-1]
        last.add(id(node))
    last_names = _paths(node.value[0])

    rows: list[list] = []
    below: dict[int, _Below] = {}
    for node, start, end, children in tree.bottom_up():
        parts = [below.pop(id(child)) for child in children]
        tops = [top for own in parts for top in own.tops]
        ends = None
        if node.value is not None:
            key, conv, n_ends, ends = node.value
            parts.append(_Below(key, conv, n_ends, []))
        made = _Below(parts[0].key, min(p.conv for p in parts), sum(p.n_convs for p in parts), tops)
        at_first, at_last = id(node) in first, id(node) in last
        names = first_names if at_first else last_names if at_last else None
        # Depths on this edge where a turn ends, from the deepest up; the root's edge includes depth 0.
        lowest = 0 if node is tree.root else start // WIDTH + 1
        for depth in range(end // WIDTH, lowest - 1, -1):
            length = _length(made.key, depth)
            shut = [rows[top] for top in made.tops if not rows[top][1]]
            row = [
                part,
                names is not None,
                at_first,
                at_last,
                names[depth] if names else None,
                names[depth - 1] if names and depth else None,
                made.conv,
                depth,
                None,
                made.n_convs,
                len(shut),
                sum(child[11] for child in shut),
                sum(child[12] for child in shut),
                ends if depth * WIDTH == end else None,
                length,
            ]
            if names is None:
                row[11] = row[11] or 1
                row[12] += (made.n_convs - 1) * length
            for child in shut:
                if names is None:
                    child[8] = made.conv
                else:
                    child[5] = names[depth]
            rows.append(row)
            made.tops = [len(rows) - 1]
        below[id(node)] = made
    return rows


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = RadixTree()
    for key, conv, n_ends, ends in _rows(batches):
        tree.insert(key, (key, conv, n_ends, ends))
    if tree.root is not None:
        yield from _batches(iter(trie_rows(tree, TaskContext.get().partitionId())), _NODES)


def _merge_open(rows: pd.DataFrame, whole: bool) -> pd.DataFrame:
    """Merge the open nodes of neighbouring tasks; ``whole`` if there are no other tasks."""
    names = list(_NODES.names)
    first, last = rows["part"].min(), rows["part"].max()
    nodes: dict[bytes, dict] = {}
    for values in rows.itertuples(index=False):
        row = dict(zip(names, values))
        row["at_first"] = bool(row["at_first"]) and row["part"] == first
        row["at_last"] = bool(row["at_last"]) and row["part"] == last
        node = nodes.get(row["path"])
        if node is None:
            nodes[row["path"]] = row
            continue
        node["conv_id"] = min(node["conv_id"], row["conv_id"])
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[name] += row[name]
        for name in ("at_first", "at_last"):
            node[name] = node[name] or row[name]
        node["ends_sha256"] = node["ends_sha256"] or row["ends_sha256"]
    for node in sorted(nodes.values(), key=lambda n: -n["depth"]):
        node["part"] = first // FAN
        node["open"] = not whole and (node["at_first"] or node["at_last"])
        if node["open"]:
            continue
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["length"]
        above = nodes.get(node["parent_path"]) if node["depth"] else None
        if above:
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    merged = pd.DataFrame(list(nodes.values()), columns=names)
    return merged.astype({"parent_conv_id": "Int64"})


def _merged(nodes: DataFrame, whole: bool) -> DataFrame:
    groups = nodes.where("open").withColumn("group", F.floor(F.col("part") / FAN))
    merge = lambda rows: _merge_open(rows.drop(columns="group"), whole)
    return stored(groups.groupBy("group").applyInPandas(merge, NODES))


def prefix_tree(sequences: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Nodes of the trie of ``conv_id`` and ``key`` rows, with the columns of ``RESULT``."""
    ends = stored(endings(sequences))
    size = ends.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    ranges = ends.repartitionByRange(1 + size // tree_bytes, "key")
    nodes = level = stored(ranges.mapInArrow(_grow, NODES))
    once_open = []
    while (last := level.where("open").agg(F.max("part")).first()[0]) is not None:
        level = _merged(level, whole=last < FAN)
        once_open.append(level.where("NOT open"))
    shut = nodes.where("NOT open")
    found = shut.where("parent_path IS NULL")
    if once_open:
        pending = shut.where("parent_path IS NOT NULL")
        opened = once_open[0]
        for more in once_open[1:]:
            opened = opened.unionByName(more)
        parents = broadcast_if_small(
            opened.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent")), 64
        )
        named = pending.unionByName(opened).join(parents, "parent_path", "left")
        found = found.unionByName(
            named.withColumn("parent_conv_id", F.col("parent")).select(*found.columns)
        )
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*RESULT)
