"""Vector codes against a plain rewrite in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import queries as text_queries
from tripweave.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=64, parts=16, rounds=2):
    """Codes and errors of (id, vector) rows of one width, and the codebooks' digest."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    width = len(kept[0][1])
    cuts = [range(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    first = {}
    for i, v in sorted((i, v) for i, v in kept if i is not None):
        first.setdefault(i, v)
    books = [[[v[k] for k in cut] for v in list(first.values())[:entries]] for cut in cuts]

    def assign(v):
        for cut, book in zip(cuts, books):
            yield min((sum((v[k] - e) ** 2 for k, e in zip(cut, entry)), n) for n, entry in enumerate(book))

    for _ in range(rounds):
        held = [list(assign(v)) for _, v in kept]
        for p, cut in enumerate(cuts):
            for n in range(len(books[p])):
                mine = [[v[k] for k in cut] for (_, v), found in zip(kept, held) if found[p][1] == n]
                if mine:
                    books[p][n] = [sum(column) // len(mine) for column in zip(*mine)]
    coded = []
    for i, v in kept:
        found = list(assign(v))
        coded.append((i, bytes(n for _, n in found), sum(e for e, _ in found)))
    digits = ",".join(str(x) for book in books for entry in book for x in entry)
    return coded, hashlib.sha256(digits.encode()).hexdigest()


def made(frame, **options):
    kept = vector_codes.usable(frame)
    books = vector_codes.fit(kept, "vec_id", "embedding", **options)
    coded = vector_codes.encode(kept, books, "embedding").collect()
    return [(r.vec_id, None if r.code is None else bytes(r.code), r.error) for r in coded], books


def order(coded):
    return sorted(coded, key=repr)


@pytest.mark.parametrize("spread", [0.2, 3.0, 1e9, 1e19])
def test_codes_equal_brute_force(spark, spread):
    noise = np.random.default_rng(7)
    rows = [(i, (noise.standard_normal(32) * spread).tolist()) for i in range(150)]
    frame = spark.createDataFrame([(*row, 0) for row in rows], SCHEMA).repartition(5)
    coded, books = made(frame)
    want, digest = brute(rows)
    assert books.digest() == digest
    assert [c[:2] for c in order(coded)] == [c[:2] for c in order(want)]
    assert {c[2] for c in coded} == {c[2] if c[2] < 2**63 else None for c in want}


def test_ties_repeated_rows_and_null_ids(spark):
    noise = np.random.default_rng(3)
    rows = [(i % 40 if i % 7 else None, noise.integers(-3, 4, 16).astype(float).tolist()) for i in range(200)]
    rows += rows[:30]
    coded, books = made(spark.createDataFrame([(*row, 0) for row in rows], SCHEMA).repartition(3))
    want, digest = brute(rows)
    assert (books.digest(), order(coded)) == (digest, order(want))
    assert len(books.entries) == 40


def test_odd_widths_are_cut_evenly(spark):
    rows = [(i, [float(i), 1.0, float(-i)]) for i in range(5)]
    coded, books = made(spark.createDataFrame([(*row, 0) for row in rows], SCHEMA))
    want, digest = brute(rows)
    assert (books.digest(), order(coded)) == (digest, order(want))


def test_unusable_vectors_go_and_other_widths_have_no_code(spark):
    good = [0.5] * 16
    rows = [(None, good), (3, good), (4, None), (5, [*good[:15], None]), (6, [*good[:15], math.nan])]
    rows += [(7, [*good[:15], -math.inf]), (8, good[:8]), (9, [])]
    frame = spark.createDataFrame([(*row, None) for row in rows], SCHEMA)
    coded, books = made(frame)
    zero = bytes(16)
    assert order(coded) == order([(None, zero, 0), (3, zero, 0), (8, None, None), (9, None, None)])
    assert books.decode(zero) == good


def test_without_ids_or_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert made(empty) == ([], None)
    assert made(spark.createDataFrame([(None, [1.0] * 16, 1)], SCHEMA)) == ([(None, None, None)], None)
    with pytest.raises(ValueError):
        vector_codes.fit(empty, "vec_id", "embedding", entries=257)


def test_other_columns_stay_and_results_replace_theirs(spark):
    frame = spark.createDataFrame([(1, [1.0] * 16, 2)], SCHEMA).withColumns(
        {"code": F.lit("mine"), "__coded": F.lit(5), "slot": F.lit(6), "id": F.lit(8), "a b": F.lit(7)}
    )
    books = vector_codes.fit(frame, "vec_id", "embedding")
    row = vector_codes.encode(frame, books, "embedding").first()
    assert (row.code, row["__coded"], row.slot, row.id, row["a b"], row.error) == (bytes(16), 5, 6, 8, 7, 0)


def test_label_errors_add_up_with_nulls_together(spark, tmp_path):
    noise = np.random.default_rng(5)
    rows = [(i, noise.standard_normal(16).tolist(), None if i % 3 else i % 2) for i in range(120)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = text_queries.op12_vector_codes(spark, str(tmp_path)).collect()
    sums = {}
    labels = {i: label for i, _, label in rows}
    for r in found:
        sums[labels[r.vec_id]] = sums.get(labels[r.vec_id], 0) + r.error
    assert len(found) == 120 and sum(sums.values()) > 0
    assert all(r.label_error == sums[labels[r.vec_id]] for r in found)
