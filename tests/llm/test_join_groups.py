"""Noisy copies of one text that do not link meet in few groups, and their components stay exact."""

import random

from pyspark.sql import functions as F

from tripweave.llm import ngram_join


def noisy_copies(copies, seed=5):
    """Copies of one text with six single words changed: too few to rule a link out, too many for most links."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for number in range(copies):
        words = base[: rng.choice([300, 300, 240])]
        for at in rng.sample(range(10, len(words) - 10), 6 if number % 4 else 1):
            words[at] = f"new{number}x{at}"
        rows.append((number, " ".join(words)))
    return rows


def smallest_linked(rows):
    sets = []
    for _, text in rows:
        words = text.split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, one in enumerate(sets):
            for b in range(a):
                if label[a] != label[b] and 100 * len(one & sets[b]) >= 80 * len(one | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return dict(enumerate(label))


def test_noisy_copies_make_few_groups(documents_of, monkeypatch):
    rows = noisy_copies(100)
    kept, store = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: kept.append(store(df)) or kept[-1])
    found = ngram_join.find_components(documents_of(rows), percent=80, words=5)
    expected = smallest_linked(rows)
    assert {r.doc_id: r.component_id for r in found.collect()} == expected
    assert 20 < len(set(expected.values())) < 100
    (grouped,) = [df for df in kept if {"family", "single", "start"} <= set(df.columns)]
    assert grouped.count() > 90
    # Before, a set that could not link with a leader was a group of its own.
    assert grouped.select("family").distinct().count() <= 12
    # Rows of the join with the token-group matrix: at most one for each token of a set and group.
    tokens = grouped.select("family", F.explode("places").alias("at"), F.get("start", F.col("at")).alias("token"))
    matrix = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("sets"), F.countDistinct("family").alias("groups")
    )
    assert matrix.agg(F.sum(F.col("sets") * (F.col("groups") - 1))).first()[0] <= 6 * tokens.count()
