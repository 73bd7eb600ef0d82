"""Toxicity: a word classifier regularised by counterfactuals.

A text is the set of its words. The words that tell the labels apart on a bounded sample of labelled
rows become features, with identity terms always among them; a logistic model is fitted by gradient
descent in numpy. Every sentence of a labelled text that mentions a group is scored again with its terms
swapped for others of their category, and squared differences of the two scores are penalised. So a
group's name cannot carry weight that the names of other groups do not, and neutral mentions score no
higher than the same sentence about anyone else. ``Model.texts`` and ``Model.sentences`` say how many
labelled texts and sentences the swaps reached; without any the model is a plain logistic one.

Executors reduce sampled rows to word hashes, then to features; the driver sees at most
``SAMPLE_ROWS * 2`` rows of at most ``FEATURES`` numbers.

Defined cases: null and empty texts have no words and get the score of the intercept; without labels
every score is 0; if all labels agree, every score is that label's smoothed share; a document labelled
several times counts as toxic if any label says so, null labels are left out. Equal texts get equal
scores. Other columns are kept, those with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tripweave.llm import text_blocks
from tripweave.session import cut_lineage

SAMPLE_ROWS = 8000  # labelled rows that are trained on, at most twice as many by chance
FEATURES = 2048  # at most; one for every ``ROWS_PER_FEATURE`` sampled rows
ROWS_PER_FEATURE = 4
FEWEST_FEATURES = 64
LEAST_ROWS = 4  # sampled texts a feature must occur in
SWAP_PENALTY = 2.0
RIDGE = 1e-4
STEPS = 400
RATE = 0.05

# Group names that may stand for each other in a sentence, in English, French, German and
# Spanish. A term belongs to one category; terms can be given to ``fit`` instead.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("noirs", "blancs", "arabes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("homosexuels", "hétérosexuels"),
    ("vieux", "jeunes"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("christen", "muslime", "juden", "atheisten"),
    ("schwarze", "weiße", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("lesben", "schwule"),
    ("alte", "junge"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
    ("negros", "blancos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("homosexuales", "heterosexuales"),
    ("ancianos", "jóvenes"),
)

_WORDS = text_blocks.byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes that these words have in a text."""
    hasher = text_blocks.Hasher(seed=3)
    found = [text_blocks.utf8(pa.array([word]))[0] for word in words]
    return np.array(
        [hasher.runs(data, np.array([0]), np.array([len(data)]))[0] for data in found], np.uint64
    )


def _hashed(terms: np.ndarray):
    """A reader of texts: their distinct words, and the identity terms of each sentence that has any."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = text_blocks.Hasher(seed=3)
        ends_sentence = text_blocks.byte_class(lambda b: b in b".!?\n")
        for batch in batches:
            words, mentions = [], []
            for block in text_blocks.blocks(batch.column("text")):
                starts, ends, bounds = block.words(_WORDS)
                hashes = hasher.runs(block.data, starts, ends)
                sentence = np.searchsorted(np.flatnonzero(ends_sentence[block.data]), starts)
                named = np.isin(hashes, terms)
                signed = hashes.view(np.int64)
                for a, b in zip(bounds, bounds[1:]):
                    words.append(np.unique(signed[a:b]))
                    own = a + np.flatnonzero(named[a:b])
                    cuts = np.flatnonzero(np.diff(sentence[own])) + 1
                    mentions.append([np.unique(part) for part in np.split(signed[own], cuts) if len(part)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("order"),
                    batch.column("label"),
                    pa.array(words, kind),
                    pa.array(mentions, pa.list_(kind)),
                ],
                ["order", "label", "words", "mentions"],
            )

    return read


def sample(
    documents: DataFrame,
    labels: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = SAMPLE_ROWS,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> DataFrame:
    """About ``rows`` labelled documents, each reduced to a label, its distinct word hashes and mentions."""
    marked = (
        labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull())
        .groupBy(F.col(doc).alias("__doc"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    total = marked.count()
    highest = -(2**63) + (2**64 - 1) * min(rows, total) // max(total, 1)
    # Bounded by ``rows`` ids of a few bytes, so it may be broadcast.
    drawn = marked.withColumn("draw", F.xxhash64("__doc")).where(F.col("draw") <= highest)
    chosen = drawn.orderBy("draw", "__doc").limit(2 * rows).drop("draw")
    texts = documents.select(F.col(doc).alias("__doc"), F.lower(F.col(text)).alias("text"))
    named = word_hash([term for group in terms for term in group])
    return (
        texts.join(F.broadcast(chosen), "__doc")
        .select(F.xxhash64("text").alias("order"), "label", "text")
        .mapInArrow(
            _hashed(named), "order bigint, label int, words array<bigint>, mentions array<array<bigint>>"
        )
        # Copies of one text are one example, a toxic one if any copy is labelled so.
        .groupBy("order")
        .agg(
            F.max("label").alias("label"),
            F.first("words").alias("words"),
            F.first("mentions").alias("mentions"),
        )
        .orderBy("order")
        .limit(2 * rows)
    )


def telling_words(rows: DataFrame, toxic: int, total: int, limit: int) -> list[int]:
    """The word hashes whose presence tells the labels apart best, by the chi-square statistic."""
    counted = (
        rows.select("label", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= LEAST_ROWS)
    )
    expected = F.col("rows") * F.lit(toxic / total)
    chi = F.pow(F.col("toxic") - expected, 2) / (expected * (F.lit(1.0) - F.col("rows") / (total + 1.0)))
    best = counted.select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(limit)
    return [row.word for row in best.collect()]


@dataclass
class Model:
    """Sorted word hashes, their weights, the intercept, and how far the swaps reached."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float
    texts: int = 0
    sentences: int = 0

    def __post_init__(self):
        order = np.argsort(self.words)
        self.words, self.weights = self.words[order], self.weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def swaps(words: np.ndarray, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> np.ndarray:
    """For each feature the feature that takes its place in the counterfactual (itself mostly)."""
    place = {int(word): i for i, word in enumerate(words)}
    other = np.arange(len(words))
    for group in terms:
        known = [place[int(h)] for h in word_hash(list(group)) if int(h) in place]
        for here, there in zip(known, known[1:] + known[:1]):
            other[here] = there
    return other


def train(
    rows: list,
    words: np.ndarray,
    penalty: float = SWAP_PENALTY,
    *,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Model:
    """Fit to rows (label, features, mentions); ``words`` are the hashes of the features."""
    label = np.array([row.label for row in rows], float)
    sizes = [len(row.features) for row in rows]
    row_of = np.repeat(np.arange(len(rows)), sizes)
    feature = np.array([f for row in rows for f in row.features], np.int64)
    # The terms of each sentence that mentions a group, and what takes their places.
    told = [sentence for row in rows for sentence in row.mentions]
    sentence_of = np.repeat(np.arange(len(told)), [len(sentence) for sentence in told])
    term = np.array([f for sentence in told for f in sentence], np.int64)
    swapped = swaps(words, terms)[term]
    n, width = len(rows), len(words)
    weights, slope = np.zeros(width), np.zeros(width)
    share = (label.sum() + 1) / (n + 2)
    intercept = float(np.log(share / (1 - share)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        score = np.bincount(row_of, weights=weights[feature], minlength=n) + intercept
        error = (sigmoid(score) - label) / n
        slope = np.bincount(feature, weights=error[row_of], minlength=width) + RIDGE * weights
        if len(told):
            gap = np.bincount(sentence_of, weights=weights[term] - weights[swapped], minlength=len(told))
            pull = 2 * penalty * gap[sentence_of] / len(told)
            slope += np.bincount(term, weights=pull, minlength=width)
            slope -= np.bincount(swapped, weights=pull, minlength=width)
        gradient = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        change = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= change[:-1]
        intercept -= float(change[-1])
    return Model(words.copy(), weights, intercept, sum(bool(row.mentions) for row in rows), len(told))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    **names,
) -> Model | None:
    """Train on labelled documents; None without labels."""
    every = [term for group in terms for term in group]
    if len(set(every)) < len(every):
        raise ValueError("a term belongs to one category")
    sampled = cut_lineage(sample(documents, labels, rows=rows, terms=terms, **names))
    totals = sampled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not totals.n:
        return None
    toxic = totals.toxic or 0
    if toxic in (0, totals.n):
        share = (toxic + 1) / (totals.n + 2)
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))))
    named = word_hash(every).view(np.int64)
    limit = min(FEATURES - len(named), max(FEWEST_FEATURES, totals.n // ROWS_PER_FEATURE))
    picked = telling_words(sampled, toxic, totals.n, limit)
    words = np.unique(np.concatenate([named, np.array(picked, np.int64)]))
    table = F.lit([int(w) for w in words]).cast("array<bigint>")
    kept = sampled.select("order", "label", F.array_intersect("words", table).alias("words"), "mentions")
    place = {int(w): i for i, w in enumerate(words)}
    examples = sorted(kept.collect(), key=lambda row: row.order)
    rows_ = [
        _Example(
            row.label,
            sorted(place[w] for w in row.words),
            [[place[w] for w in sentence] for sentence in row.mentions],
        )
        for row in examples
    ]
    return train(rows_, words.view(np.uint64), terms=terms)


@dataclass
class _Example:
    label: int
    features: list[int]
    mentions: list[list[int]]


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    hasher = text_blocks.Hasher(seed=3)
    parts = [np.empty(0)]
    for block in text_blocks.blocks(column):
        starts, ends, bounds = block.words(_WORDS)
        hashes = hasher.runs(block.data, starts, ends)
        near = np.flatnonzero(model.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        total = np.full(block.texts, model.intercept)
        if len(near) and len(model.words):
            at = np.minimum(np.searchsorted(model.words, hashes[near]), len(model.words) - 1)
            hit = model.words[at] == hashes[near]
            text = np.searchsorted(bounds, near[hit], "right") - 1
            pairs = np.unique(text * len(model.words) + at[hit])
            total += np.bincount(
                pairs // len(model.words),
                weights=model.weights[pairs % len(model.words)],
                minlength=block.texts,
            )
        parts.append(sigmoid(total))
    return np.concatenate(parts)


def toxic_score(model: Model, text: Column) -> Column:
    """Score from 0 to 1 for a text column."""

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(score_texts(model, batch), pa.float64())

    return score.asNondeterministic()(F.lower(text))


def judge(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from a score of 0.5 on)."""
    names = [F.col(f"`{n}`") for n in df.columns if n not in ("score", "predicted")]
    score = F.lit(0.0) if model is None else toxic_score(model, F.col(text))
    scored = df.select(*names, score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
