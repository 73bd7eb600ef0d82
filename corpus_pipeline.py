"""Documents to training tokens in stages; each stage's result is written before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns they got. Null and empty texts have no language and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_join, queries
from tripweave.llm.storage import stored


# No contract binds the near-duplicate stage: the usual five-word shingles at a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row in one column, so that no column of the table clashes with an operator's."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go."""
    model = language_id.fit(docs.where(~queries.held_out()))
    return language_id.identify(_packed(docs), model).where("NOT rejected").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages go; a document of which nothing is left goes with them."""
    cut = line_dedup.dedup_lines(_packed(docs)).where(
        (F.col("n_removed") == 0) | F.col("n_removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    )
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.length("text").cast(kind)
    return cut.select(*[changed.get(n, F.col("row")[n]).alias(n) for n in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    kept = ngram_join.keep_one_of_each(_packed(docs), percent=NEAR_PERCENT, words=NEAR_WORDS)
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words of benchmark items go."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(_packed(docs), benchmark)
    return found.where("NOT contaminated").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    return byte_bpe.token_digest(
        docs.select("doc_id", "lang", "source", "text"), "text", *queries.public_ranks(), ids="ids"
    ).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize),
]

# A trained model decides which documents the first stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
