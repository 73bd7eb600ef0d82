"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

Items and documents are sequences of words. Each item is cut into windows of 13 words (a shorter item is
one window). A document contains a window only if it contains the window's rarest word, so that word is
the window's necessary prefix: rarity is the number of occurrences over all documents, counted first for
the words of the benchmark. Where a document word equals a prefix token, the length bound (the document
has as many words as the window) and the positional bound (enough words before and after that place)
come next, and what is left is verified word by word.

The windows of a block of items travel with the task. Blocks have a bounded number of words, and a
larger benchmark makes more blocks, each applied in turn to the same rows; nothing is shuffled, and a
passage that many documents share costs each document its own words only.

Defined cases: null and empty texts have no words and are not contaminated; items without words never
occur; items with a null id mark words but are not listed; several rows with one item id are one listed
item; repeated documents get equal results; without items nothing is contaminated. Other columns are
kept, those with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tripweave.llm import text_blocks

WINDOW = 13
SHARE = 20  # contaminated from one hit word in so many
BLOCK_WORDS = 1_000_000  # item words whose windows travel together

_LOWER = text_blocks.lower_ascii()


def _hasher() -> text_blocks.Hasher:
    return text_blocks.Hasher(seed=5, fold=_LOWER)


@dataclass
class Items:
    """Word hashes of a block of items, one after another, and where each item begins."""

    ids: list
    words: np.ndarray
    bounds: np.ndarray


@dataclass
class Windows:
    """Distinct windows sorted by prefix token; ``words`` holds each window's hashes, 0 beyond its size."""

    token: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    words: np.ndarray
    items: list[np.ndarray]
    ids: list

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.token & np.uint64(0xFFFFF)).astype(np.int64)] = True


def read_items(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[Items]:
    """Blocks of items with a bounded number of words, read item by item."""
    hasher = _hasher()
    ids, hashes, bounds = [], [], [0]
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).orderBy("item", "text")
    for row in rows.toLocalIterator():
        (block,) = text_blocks.blocks(pa.array([row.text], pa.string()))
        starts, ends, _ = block.words(text_blocks.LETTERS_DIGITS)
        if len(starts) == 0:
            continue
        if ids and bounds[-1] + len(starts) > block_words:
            yield Items(ids, np.concatenate(hashes), np.array(bounds))
            ids, hashes, bounds = [], [], [0]
        ids.append(row.item)
        hashes.append(hasher.runs(block.data, starts, ends))
        bounds.append(bounds[-1] + len(starts))
    if ids:
        yield Items(ids, np.concatenate(hashes), np.array(bounds))


def token_counts(documents: DataFrame, text: Column, words: np.ndarray) -> np.ndarray:
    """Occurrences of the given words (sorted hashes) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for block in text_blocks.blocks(batch.column(0)):
                starts, ends, _ = block.words(text_blocks.LETTERS_DIGITS)
                hashes = hasher.runs(block.data, starts, ends)
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                total += np.bincount(at[words[at] == hashes], minlength=len(words))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    counted = (
        documents.select(text.alias("text"))
        .mapInArrow(count, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    total = np.zeros(len(words), np.int64)
    for row in counted.collect():  # at most one row per word of the items
        total[row.word] = row.n
    return total


def item_windows(items: Items, words: np.ndarray, counts: np.ndarray, window: int) -> Windows:
    """All distinct windows of a block of items with their rarest word as prefix."""
    rarity = counts[np.searchsorted(words, items.words)]
    found: dict[bytes, list] = {}
    for number in range(len(items.ids)):
        begin, end = items.bounds[number], items.bounds[number + 1]
        size = min(window, end - begin)
        for first in range(begin, end - size + 1):
            part = items.words[first : first + size]
            entry = found.setdefault(part.tobytes(), [first, size, set()])
            entry[2].add(number)
    n = len(found)
    table = np.zeros((n, window), np.uint64)
    token, offset = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    sizes, owners = np.zeros(n, np.int64), []
    for row, (first, size, own) in enumerate(found.values()):
        table[row, :size] = items.words[first : first + size]
        offset[row] = int(np.argmin(rarity[first : first + size]))
        token[row] = table[row, offset[row]]
        sizes[row] = size
        owners.append(np.array(sorted(own)))
    order = np.argsort(token, kind="stable")
    return Windows(
        token[order], offset[order], sizes[order], table[order], [owners[i] for i in order], items.ids
    )


def block_hits(windows: Windows, hashes: np.ndarray, bounds: np.ndarray):
    """Covered places (difference array over the words) and (text, item) pairs of a block."""
    edge = np.zeros(len(hashes) + 1, np.int64)
    near = np.flatnonzero(windows.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
    low = np.searchsorted(windows.token, hashes[near], "left")
    high = np.searchsorted(windows.token, hashes[near], "right")
    count = high - low
    place = np.repeat(near, count)
    if len(place) == 0:
        return edge, set()
    firsts = np.repeat(np.cumsum(count) - count, count)
    row = np.repeat(low, count) + np.arange(len(place)) - firsts
    text = np.searchsorted(bounds, place, "right") - 1
    begin = place - windows.offset[row]
    inside = (begin >= bounds[text]) & (begin + windows.size[row] <= bounds[text + 1])
    begin, row, text = begin[inside], row[inside], text[inside]
    for step in range(windows.words.shape[1]):
        at = np.minimum(begin + step, len(hashes) - 1)
        same = (step >= windows.size[row]) | (hashes[at] == windows.words[row, step])
        begin, row, text = begin[same], row[same], text[same]
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + windows.size[row], -1)
    met = np.unique(np.stack([text, row]), axis=1) if len(row) else np.empty((2, 0), np.int64)
    return edge, {(int(t), int(i)) for t, r in met.T for i in windows.items[r]}


HITS = "struct<n_words:bigint,spans:array<int>,items:array<string>>"
_HITS = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)


def hits(windows: Windows, text: Column) -> Column:
    """Word count, covered runs of words (begin, end, begin, end, ...) and ids of occurring items."""

    @arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = _hasher()
        names = [None if i is None else str(i) for i in windows.ids]
        for batch in batches:
            rows = []
            for block in text_blocks.blocks(batch):
                starts, ends, bounds = block.words(text_blocks.LETTERS_DIGITS)
                hashes = hasher.runs(block.data, starts, ends)
                edge, met = block_hits(windows, hashes, bounds)
                covered = np.cumsum(edge[:-1]) > 0
                listed: dict[int, set] = {}
                for t, i in met:
                    if names[i] is not None:
                        listed.setdefault(t, set()).add(names[i])
                for t in range(block.texts):
                    own = covered[bounds[t] : bounds[t + 1]]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    rows.append((len(own), turns.tolist(), sorted(listed.get(t, ()))))
            yield pa.array([dict(zip(("n_words", "spans", "items"), r)) for r in rows], _HITS)

    # Declared nondeterministic so that a filter on the result does not search twice.
    return find.asNondeterministic()(text)


def _merged_length(spans: list[list[int]]) -> int:
    pairs = sorted((a, b) for s in spans for a, b in zip(s[::2], s[1::2]))
    total, reach = 0, 0
    for a, b in pairs:
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def merged_length(spans: Column) -> Column:
    """Words covered by the runs that several blocks of items have found."""

    @arrow_udf("bigint")
    def length(column: pa.Array) -> pa.Array:
        return pa.array([_merged_length(s) for s in column.to_pylist()], pa.int64())

    return length(spans)


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated``.

    ``items`` lists the ids as text, sorted as text.
    """
    added = ("n_words", "n_hit", "n_items", "items", "contaminated")
    names = [F.col(f"`{n}`") for n in documents.columns if n not in added]
    found = []
    for items in read_items(benchmark, item, item_text, block_words):
        words = np.unique(items.words)
        counts = token_counts(documents, F.col(text), words)
        found.append(hits(item_windows(items, words, counts, window), F.col(text)))
    if not found:
        empty = Windows(
            np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int), np.empty((0, window), np.uint64), [], []
        )
        found.append(hits(empty, F.col(text)))
    marks = [f"__hits{i}" for i in range(len(found))]
    marked = documents.select(*names, *[h.alias(m) for h, m in zip(found, marks)])
    if len(found) == 1:
        spans = F.col("__hits0.spans")
        step = F.transform(spans, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v))
        covered = F.aggregate(step, F.lit(0).cast("long"), lambda total, v: total + v)
    else:
        covered = merged_length(F.array(*[F.col(f"{m}.spans") for m in marks]))
    listed = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{m}.items") for m in marks])))
    n_words = F.col("__hits0.n_words")
    result = marked.select(
        *names, n_words.alias("n_words"), covered.alias("n_hit"), listed.alias("items")
    )
    return result.select(
        *names,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
