"""Quality rules: a base of plain counts, then an n-gram log-likelihood ratio.

Words and pairs of neighbouring words are counted one by one, by 63-bit hashes. Two multinomials are
counted, one over all documents and one over trusted documents; both counts are partial sums in each
task and one shuffle of n-grams. A document's score is the mean, over its n-grams, of the log ratio of
trusted to raw probability, so length does not matter. A document passes if it fails no base rule and
its score reaches the threshold; nothing is drawn at random.

The table of n-grams grows with the corpus and stays a DataFrame. The most frequent ones travel to the
texts in a table of bounded size; a text's other n-grams are joined with the rest of the DataFrame, once
per text and n-gram. Nothing is left out: the travelling part only saves rows of the join.

Defined cases: null and empty texts have no words, score 0 and fail the base rule for short texts;
repeated rows count as often as they occur; without trusted documents every score is 0 and the base
rules decide; other columns are kept, those with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tripweave.llm import text_blocks
from tripweave.llm.storage import stored
from tripweave.session import broadcast_if_small

BUCKETS = 1 << 16  # of a ratio table that is folded, for few texts
HOT_SLOTS = 1 << 21  # places for the n-grams that travel; of those that want one place, one gets it
HOT_NGRAMS = 1 << 20  # frequent n-grams offered to those places
PENDING = 1 << 21  # n-grams of a task that are counted together
SMOOTHING = 10.0  # trusted n-grams added to every bucket of both multinomials
THRESHOLD = -0.1  # mean log ratio that a kept document reaches
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_FIRST_BYTE = text_blocks.byte_class(lambda b: b & 0xC0 != 0x80)

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")


_ID = np.uint64((1 << 63) - 1)


def ngram_ids(block: text_blocks.Block, hasher: text_blocks.Hasher):
    """Id and text of each word and each pair of words of one text."""
    starts, ends, bounds = block.words(text_blocks.NOT_BLANK)
    hashes = hasher.runs(block.data, starts, ends)
    text = np.repeat(np.arange(block.texts), np.diff(bounds))
    pairs = text_blocks.windows(hashes, 2)
    owner = text_blocks.window_owner(bounds, 2, len(pairs))
    inside = owner >= 0
    ids = (np.concatenate([hashes, pairs[inside]]) & _ID).astype(np.int64)
    return ids, np.concatenate([text, owner[inside]])


def _counted(ids: list[np.ndarray], trusted: list[np.ndarray]) -> pa.RecordBatch:
    found, place = np.unique(np.concatenate(ids), return_inverse=True)
    raw = np.bincount(place, minlength=len(found))
    target = np.bincount(place[np.concatenate(trusted)], minlength=len(found))
    return pa.RecordBatch.from_arrays(
        [pa.array(found), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"]
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = text_blocks.Hasher()
    ids, flags, size = [], [], 0
    for batch in batches:
        trusted = np.asarray(batch.column("trusted").to_pylist(), bool)
        for block in text_blocks.blocks(batch.column("text")):
            own, owner = ngram_ids(block, hasher)
            ids.append(own)
            flags.append(trusted[block.first : block.last][owner])
            size += len(own)
            if size >= PENDING:
                yield _counted(ids, flags)
                ids, flags, size = [], [], 0
    if size:
        yield _counted(ids, flags)


def bucket_counts(df: DataFrame, text: Column, trusted: Column) -> DataFrame:
    """Occurrences of each n-gram (``bucket`` is its id) over all rows and over trusted rows."""
    return (
        df.select(text.alias("text"), F.coalesce(trusted, F.lit(False)).alias("trusted"))
        .mapInArrow(_count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def ratio_table(counts: DataFrame) -> DataFrame | None:
    """(bucket, raw, ratio): log of trusted over raw probability; None without trusted n-grams."""
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total.target:
        return None
    # Scaled and smoothed as in ``log_ratios``.
    scaled = F.col("raw") * F.lit(total.target / total.raw)
    ratio = F.log(F.col("target") + SMOOTHING) - F.log(scaled + SMOOTHING)
    return counts.select("bucket", "raw", ratio.alias("ratio"))


def hot_ngrams(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ratios of the most frequent n-grams, by place; -1 for an empty place."""
    ids, values = np.full(HOT_SLOTS, -1), np.zeros(HOT_SLOTS)
    power = F.floor(F.log2("raw")).cast("int")
    often = {r.power: r["count"] for r in ratios.groupBy(power.alias("power")).count().collect()}
    least, total = max(often, default=0) + 1, 0
    while least > 0 and total + often.get(least - 1, 0) <= HOT_NGRAMS:
        least, total = least - 1, total + often.get(least - 1, 0)
    found = ratios.where(power >= least).toArrow()
    order = np.argsort(found["raw"].to_numpy(), kind="stable")
    own = found["bucket"].to_numpy()[order]
    place = own & (HOT_SLOTS - 1)
    # Of several that want one place the last one stays, the most frequent.
    ids[place], values[place] = own, found["ratio"].to_numpy()[order]
    return ids, values


def log_ratios(counts: list) -> np.ndarray:
    """The ratios folded into ``BUCKETS`` places, for few texts; all 0 without trusted n-grams."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts:
        raw[row.bucket & (BUCKETS - 1)] += row.raw
        target[row.bucket & (BUCKETS - 1)] += row.target
    if not target.any():
        return np.zeros(BUCKETS)
    # Raw counts are scaled to as many n-grams as were trusted. So smoothing weighs the same on both
    # sides, and a rare n-gram that no trusted document happens to hold says little.
    scaled = raw * (target.sum() / raw.sum())
    return np.log(target + SMOOTHING) - np.log(scaled + SMOOTHING)


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags for keys found twice or more in their text, and for those found there before."""
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True  # lexsort is stable: the first of equals comes first
    any_ = later.copy()
    any_[order[:-1][same]] = True
    return any_, later


def block_figures(
    block: text_blocks.Block,
    ratios: np.ndarray,
    hasher: text_blocks.Hasher,
    known: np.ndarray | None = None,
):
    """The figures of each text of a block, as one array per name of ``FIELDS``.

    With ``known`` ids by place, n-grams that have no place add 0 to the score.
    """
    texts = block.texts
    starts, ends, bounds = block.words(text_blocks.NOT_BLANK)
    n_words = np.diff(bounds)
    byte_text = np.repeat(np.arange(texts), np.diff(block.offsets))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(byte_text[flags], minlength=texts)

    inside = text_blocks.NOT_BLANK[block.data]
    word_chars = per_text(inside & _FIRST_BYTE[block.data])
    n_symbols = per_text(_SYMBOLS[block.data])

    hashes = hasher.runs(block.data, starts, ends)
    triples = text_blocks.windows(hashes, REPEAT_WINDOW)
    owner = text_blocks.window_owner(bounds, REPEAT_WINDOW, len(triples))
    whole = np.flatnonzero(owner >= 0)
    again, _ = _repeated(triples[whole], owner[whole])
    covered = np.zeros(len(starts), bool)
    for step in range(REPEAT_WINDOW):
        covered[whole[again] + step] = True
    word_text = np.repeat(np.arange(texts), n_words)
    n_repeat = np.bincount(word_text[covered], minlength=texts)

    # Lines: runs between line feeds within a text; empty ones hold no word and drop out.
    line_starts, line_ends, line_bounds = block.words(_IN_LINE)
    line_text = np.repeat(np.arange(texts), np.diff(line_bounds))
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_text = line_text[with_word]
    _, later = _repeated(hasher.runs(block.data, line_starts, line_ends), line_text)
    n_dup = np.bincount(line_text[later], minlength=texts)

    ids, ngram_text = ngram_ids(block, hasher)
    place = ids & (len(ratios) - 1)
    weights = ratios[place] if known is None else np.where(known[place] == ids, ratios[place], 0.0)
    total = np.bincount(ngram_text, weights=weights, minlength=texts)
    n_grams = np.bincount(ngram_text, minlength=texts)
    return n_words, word_chars, n_symbols, n_dup, n_repeat, total / np.maximum(n_grams, 1)


_IN_LINE = text_blocks.byte_class(lambda b: b != 0x0A)


def figures(text: Column, ratios: np.ndarray, known: np.ndarray | None = None) -> Column:
    """Struct of ``FIELDS`` for a text column."""
    kind = pa.struct([(name, pa.int64()) for name in FIELDS[:-1]] + [(FIELDS[-1], pa.float64())])

    @arrow_udf(", ".join(f"{name} bigint" for name in FIELDS[:-1]) + ", score double")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = text_blocks.Hasher()
        for batch in batches:
            parts = [block_figures(block, ratios, hasher, known) for block in text_blocks.blocks(batch)]
            columns = [
                pa.array(np.concatenate([p[i] for p in parts]) if parts else [], kind.field(i).type)
                for i in range(len(FIELDS))
            ]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    return measure.asNondeterministic()(text)


def _verdict(threshold: float) -> Column:
    return ~F.col("base_failed") & (F.col("score") >= threshold)


def judge(
    df: DataFrame,
    ratios: np.ndarray,
    text: str = "text",
    threshold: float = THRESHOLD,
    known: np.ndarray | None = None,
) -> DataFrame:
    """Add the figures, ``base_failed`` and ``kept``."""
    added = (*FIELDS, "base_failed", "kept")
    names = [name for name in df.columns if name not in added]
    measured = df.select(
        *[F.col(f"`{name}`") for name in names],
        figures(F.col(text), ratios, known).alias("__figures"),
    ).select(*[F.col(f"`{name}`") for name in names], "__figures.*")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed).withColumn("kept", _verdict(threshold))


def _rare_ngrams(df: DataFrame, text: str, known: np.ndarray) -> DataFrame:
    """(__text, bucket, n): the n-grams of each text that do not travel; n is their share of the text."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = text_blocks.Hasher()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for block in text_blocks.blocks(batch.column("text")):
                ids, owner = ngram_ids(block, hasher)
                n_grams = np.bincount(owner, minlength=block.texts)
                left = known[ids & (len(known) - 1)] != ids
                ids, owner = ids[left], owner[left]
                order = np.lexsort((ids, owner))
                ids, owner = ids[order], owner[order]
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                share = np.diff(np.append(at, len(ids))) / n_grams[owner[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[block.first : block.last][owner[at]]), pa.array(ids[at]), pa.array(share)],
                    ["__text", "bucket", "n"],
                )

    return df.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).mapInArrow(
        rare, "__text long, bucket long, n double"
    )


def judge_by_counts(
    df: DataFrame, counts: DataFrame, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``judge`` with the ratio of every counted n-gram, however many there are."""
    counts = stored(counts)
    ratios = ratio_table(counts)
    if ratios is None:
        return judge(df, np.zeros(1), text, threshold)
    known, values = hot_ngrams(ratios)
    measured = judge(df, values, text, threshold, known)
    names = measured.columns
    # A text's score is the same in all its copies, so their sums are divided by their number.
    parts = _rare_ngrams(df, text, known).join(ratios.select("bucket", "ratio"), "bucket")
    copies = df.select(F.xxhash64(text).alias("__text"), F.lit(0.0).alias("part"), F.lit(1).alias("rows"))
    rest = (
        parts.select("__text", (F.col("n") * F.col("ratio")).alias("part"), F.lit(0).alias("rows"))
        .union(copies)
        .groupBy("__text")
        .agg((F.sum("part") / F.sum("rows")).alias("__rest"))
    )
    whole = measured.withColumn("__text", F.xxhash64(text)).join(
        broadcast_if_small(rest, 16), "__text", "left"
    )
    score = (F.col("score") + F.coalesce("__rest", F.lit(0.0))).alias("score")
    scored = whole.select(*[score if name == "score" else F.col(f"`{name}`") for name in names])
    return scored.withColumn("kept", _verdict(threshold))
