"""Line dedup, licence scan and sharding: small cases with known results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripweave.llm import license_scan, line_dedup, sharding
from tripweave.llm import queries as text_queries

A, B, C, D, E = "alpha one", "beta two", "gamma three", "delta four", "epsilon five"


def cut(frame):
    return {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(frame).collect()}


def test_later_passages_go(documents_of):
    rows = [(1, "\n".join([A, B, C, D])), (2, "\n".join([E, A, B, C])), (3, "\n".join([A, B]))]
    assert cut(documents_of(rows)) == {
        (1, 4, 0, "\n".join([A, B, C, D])),
        (2, 4, 3, E),
        (3, 2, 0, "\n".join([A, B])),
    }


def test_overlapping_windows_merge_and_blank_lines_go_along(documents_of):
    rows = [(1, "\n".join([A, B, C, D, E])), (2, "\n".join(["own", A, " " + B, "", C, D, "tail"]))]
    assert (2, 7, 5, "own\ntail") in cut(documents_of(rows))


def test_a_repeat_inside_one_text_keeps_the_first_occurrence(documents_of):
    assert cut(documents_of([(1, "\n".join([A] * 5))])) == {(1, 5, 2, "\n".join([A] * 3))}


def test_whole_copy_becomes_empty_and_repeated_rows_agree(documents_of):
    text = "\n".join([A, B, C])
    rows = [(1, text), (1, text), (2, text), (None, "x")]
    assert cut(documents_of(rows)) == {(1, 3, 0, text), (2, 3, 3, ""), (None, 1, 0, "x")}
    assert line_dedup.dedup_lines(documents_of(rows)).count() == 4


def test_null_id_comes_first(documents_of):
    text = "\n".join([A, B, C])
    assert cut(documents_of([(0, text), (None, text)])) == {(None, 3, 0, text), (0, 3, 3, "")}


def test_odd_texts_stay(odd, empty):
    assert Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(odd).collect()) == Counter(
        (r.doc_id, r.text) for r in odd.collect()
    )
    assert line_dedup.dedup_lines(empty).count() == 0


def test_other_columns_stay_and_results_replace_theirs(documents_of):
    frame = documents_of([(1, A)]).withColumn("n_lines", F.lit("mine")).withColumn("__x y", F.lit(1))
    row = line_dedup.dedup_lines(frame).first()
    assert row["__x y"] == 1 and row.n_lines == 1 and row.source == "s"
    inner = ("__text", "__row", "__id", "__whole", "__in", "__of", "__lines", "__kept", "__covered", "__from")
    clash = documents_of([(1, "\n".join([A, B, C])), (2, "\n".join([A, B, C]))])
    clash = clash.withColumns({name: F.lit(f"my {name}") for name in inner})
    rows = line_dedup.dedup_lines(clash).collect()
    assert sorted(r.text for r in rows) == ["", "\n".join([A, B, C])]
    assert all(r[name] == f"my {name}" for r in rows for name in inner)


def test_no_python_in_native_plans(spark, small):
    for name in ("op1_line_dedup", "op7_license_scan", "op9_sharding"):
        frame = text_queries.queries()[name](spark, small)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_statement_variants(documents_of):
    rows = [
        (1, "some more text of another kind\nReleased under the MIT license"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "MIT is a school"),
        (4, license_scan.TEMPLATES["MIT/grant"].replace("free of charge", "free of any charge")),
        (5, None),
        (6, ""),
        (7, "License"),
    ]
    got = {
        (r.doc_id, r.line_no, r.license) for r in license_scan.scan_licenses(documents_of(rows)).collect()
    }
    assert got == {
        (1, 1, "MIT"),
        (2, -1, "Apache-2.0"),
        (2, 0, "Apache-2.0"),
        (4, -1, "MIT"),
        (4, 0, "MIT"),
    }


def test_ties_go_to_the_first_name_and_odd_texts_match_nothing(documents_of, odd, empty):
    twins = {"b/x": "some fixed words of law", "a/x": "some fixed words of law"}
    row = license_scan.scan_licenses(documents_of([(1, "Some fixed words of law!")]), templates=twins).first()
    assert (row.template, row.dice) == ("a/x", 1.0)
    assert license_scan.scan_licenses(odd).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0


def test_dice_is_the_share_of_bigrams(documents_of):
    row = license_scan.scan_licenses(
        documents_of([(1, "a b c d z")]), templates={"t": "a b c d e"}, threshold=0.7
    ).first()
    assert row.dice == pytest.approx(2 * 3 / 8)


def shards(frame, weights, **options):
    made = sharding.assign_shards(frame.select("doc_id"), "doc_id", weights, **options)
    return {r.doc_id: r for r in made.collect()}


def test_a_new_shard_only_takes(spark):
    frame = spark.range(4000).withColumnRenamed("id", "doc_id")
    now = shards(frame, [1.0] * 10, grown_col="grown")
    then = shards(frame, [1.0] * 11)
    moved = [i for i in now if now[i].shard != then[i].shard]
    assert all(then[i].shard == 10 for i in moved) and 250 < len(moved) < 480
    assert all(now[i].grown == then[i].shard for i in now)


def test_weights_set_the_shares(spark):
    frame = spark.range(6000).withColumnRenamed("id", "doc_id")
    counts = Counter(r.shard for r in shards(frame, [1.0, 3.0]).values())
    assert 4300 < counts[1] < 4700
    with pytest.raises(ValueError):
        sharding.assign_shards(frame, "doc_id", [1.0, 0.0])


def test_slots_have_no_gaps_even_for_repeated_rows(spark, odd, empty):
    frame = odd.select("doc_id").union(spark.range(300).selectExpr("CAST(id % 7 AS LONG)"))
    made = sharding.assign_shards(frame, "doc_id", [1.0] * 4)
    slots = {}
    for row in sharding.number_slots(made, "shard", "doc_id").collect():
        slots.setdefault(row.shard, []).append(row.slot)
    assert sum(map(len, slots.values())) == frame.count()
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    none = sharding.assign_shards(empty.select("doc_id"), "doc_id", [1.0])
    assert sharding.number_slots(none, "shard", "doc_id").count() == 0


def test_many_copies_of_one_row_fill_blocks(spark):
    frame = spark.range(10_000).selectExpr("CAST(1 AS LONG) AS doc_id", "0 AS shard")
    slots = [r.slot for r in sharding.number_slots(frame, "shard", "doc_id").collect()]
    assert sorted(slots) == list(range(10_000))


def test_null_text_has_no_bytes(odd):
    size, crc = sharding.record_sizes(odd)
    rows = {(r.doc_id, r.s, r.c) for r in odd.select("doc_id", size.alias("s"), crc.alias("c")).collect()}
    assert {(1, 16, 0), (2, 16, 0)} <= rows
