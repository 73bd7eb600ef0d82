"""Registered queries of this package, each over its whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import (
    byte_bpe,
    conversation_trie,
    decontaminate,
    language_id,
    license_scan,
    line_dedup,
    ngram_join,
    oracles,
    quality_rules,
    secret_scan,
    sharding,
    toxicity,
    vector_codes,
    warc,
)
from tripweave.llm.storage import stored
from tripweave.session import broadcast_if_small

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_ranks(name: str = RANK_FILE) -> tuple[bytes, str]:
    """Content of a public rank file and the pattern that splits text for it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents)


def held_out() -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 5."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(number.cast("binary")) % 5 == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(documents.where(~held_out()))
    found = language_id.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out()))
    judged = toxicity.judge(documents, model)
    return judged.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    # Ids of trusted documents; beyond a measured size the join is shuffled.
    trusted = broadcast_if_small(
        labels.where("quality = 1 AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("__trusted"))
        .distinct(),
        16,
    )
    marked = documents.join(trusted, F.col("doc_id") == F.col("__trusted"), "left")
    counts = quality_rules.bucket_counts(marked, F.col("text"), F.col("__trusted").isNotNull())
    return quality_rules.judge_by_counts(documents, counts).drop("text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(documents, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder, _, top = warc.archive_pages(pages)
    return warc.look_up(pages.select("page_id", "url"), folder, top, complete=True)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_join.find_components(documents)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.token_digest(documents, "text", *public_ranks()).drop("text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    size, crc = sharding.record_sizes(documents)
    records = documents.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    sharded = sharding.assign_shards(records, "doc_id", [1.0] * SHARDS, grown_col="grown_shard")
    return sharding.number_slots(sharded, "shard", "doc_id").withColumn("law", F.lit("key"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    dictionary = secret_scan.fit_dictionary(documents)
    found = secret_scan.find_secrets(documents, dictionary).drop("text")
    base = F.filter("secrets", lambda s: s.kind != secret_scan.NOVEL)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    kinds = [counted(kind) for kind in ("assign", "access", "hex", secret_scan.NOVEL)]
    digest = F.sha2(listed(base).cast("binary"), 256)
    return found.select(
        "doc_id", *kinds, digest.alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_codes.usable(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    books = vector_codes.fit(vectors, "vec_id", "embedding")
    coded = stored(vector_codes.encode(vectors, books, "embedding").drop("embedding"))
    # Partly summed before the shuffle; the sums join without a shuffle of the vectors while they are few.
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.try_sum("error").alias("label_error")
    )
    return coded.join(
        broadcast_if_small(sums, 64), F.col("label").eqNullSafe(F.col("of"))
    ).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """Keys whose first turns come from the first conversation of their hundred."""
    own = stored(conversation_trie.keys(conversations))
    heads = own.where("conv_id % 100 = 0").select(
        F.col("conv_id").alias("base"), conversation_trie.turns(count="5").alias("head")
    )
    grafted = own.withColumns(
        {
            "base": F.expr("conv_id - conv_id % 100"),
            "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6,
        }
    ).join(broadcast_if_small(heads, 160), "base", "left")
    head = F.coalesce(conversation_trie.turns("head", count="h"), F.lit(b""))
    return grafted.select("conv_id", F.concat(head, conversation_trie.turns(first="h")).alias("key"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_tree(rebuilt_conversations(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_language_id": op2_language_id,
        "op3_toxicity": op3_toxicity,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc": op5_warc,
        "op6_ngram_join": op6_ngram_join,
        "op7_license_scan": op7_license_scan,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_sharding": op9_sharding,
        "op10_decontaminate": op10_decontaminate,
        "op11_secret_scan": op11_secret_scan,
        "op12_vector_codes": op12_vector_codes,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    """Results that a trained model or a tokenizer makes have no SQL; tests compare them otherwise."""
    return oracles.all_sql()
