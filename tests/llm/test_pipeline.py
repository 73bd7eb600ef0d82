"""Registered text queries against SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from check_oracle import compare, connect
from tripweave.llm import decontaminate, language_id, line_dedup, ngram_join, oracles
from tripweave.llm import queries as text_queries


@pytest.mark.parametrize("name", sorted(oracles.all_sql()))
def test_matches_sql(spark, small, name):
    query = text_queries.queries()[name]
    assert registered.queries()[name] is query or name in registered.queries()
    rows, problem = compare(spark, connect(small), small, query, oracles.all_sql()[name])
    assert problem is None and rows > 0


def test_all_operators_and_the_pipeline_are_registered():
    names = set(registered.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names and set(registered.oracle_sql()) <= names


def test_stages_keep_columns_and_decide(spark, small):
    docs = text_queries.table(spark, small, "documents").withColumn("score", F.lit("mine"))
    docs = docs.withColumn("__text", F.lit(1)).withColumn("row", F.lit("r"))
    model = language_id.fit(docs.where(~text_queries.held_out()))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, small).persist()
        before = docs.count()
        if number == 0:
            found = language_id.identify(docs.select("doc_id", "text"), model)
            assert result.count() == found.where("NOT rejected").count()
        if number == 1:
            cut = line_dedup.dedup_lines(docs.select("doc_id", "text"))
            gone = cut.where("n_removed > 0 AND trim(text) = ''").count()
            assert result.count() == before - gone
            assert result.where(F.col("n_chars") != F.length("text")).count() == 0
        if number == 2:
            words, percent = corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT
            groups = ngram_join.find_components(docs, percent=percent, words=words)
            assert result.count() == groups.select("component").distinct().count()
        if number == 3:
            benchmark = text_queries.table(spark, small, "benchmark")
            found = decontaminate.find_contamination(docs.select("doc_id", "text"), benchmark)
            assert result.count() == found.where("NOT contaminated").count()
        if name != "byte_bpe":
            assert result.dtypes == docs.dtypes
            docs = result
        else:
            assert result.count() == before and result.where("NOT round_trip").count() == 0


def test_pipeline_runs_whole(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert 100 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_pipeline_stages_take_odd_rows(spark, small, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, small).count() <= 12
        assert stage(spark, empty, small).count() == 0
