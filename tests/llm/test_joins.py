"""N-gram Jaccard join and decontamination against brute force."""

import random
import re

import pytest

import corpus_pipeline
from tripweave.llm import decontaminate, ngram_join
from tripweave.llm import queries as text_queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute_components(rows, percent=90):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (number, _) in enumerate(rows):
        key = find(i)
        if number is not None:
            smallest[key] = min(smallest.get(key, number), number)
    return sorted((n, len(sets[i]), smallest.get(find(i))) for i, (n, _) in enumerate(rows))


def joined(frame, percent=90):
    rows = ngram_join.find_components(frame, percent=percent).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def families(seed, families=12, size=14, edits=4):
    """Texts in families of edited copies, some edited beyond the similarity, on common words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for family in range(families):
        base = rng.choices(vocabulary, k=rng.randint(8, 90))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary + [f"new{rng.random()}"], k=1)
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_near_copies(documents_of, seed):
    rows = families(seed)
    assert joined(documents_of(rows)) == brute_components(rows)


def test_lower_similarity(documents_of):
    rows = families(3, families=5, size=10, edits=8)
    assert joined(documents_of(rows), percent=80) == brute_components(rows, 80)


def test_chain_of_small_changes_is_one_component(documents_of):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for step in range(12):
        words = words[3:] + [f"n{step}a", f"n{step}b", f"n{step}c"]
        rows.append((100 - step, " ".join(words)))
    expected = brute_components(rows)
    assert len({c for *_, c in expected}) == 1
    assert joined(documents_of(rows)) == expected


def test_sets_at_the_limit(documents_of):
    """Sizes around the smallest that differ and link: 9 shingles of 10."""
    words = [f"w{i}" for i in range(20)]
    rows = [(n, " ".join(words[:n])) for n in range(1, 20)]
    assert joined(documents_of(rows)) == brute_components(rows)


def test_odd_rows(odd, empty, documents_of):
    key = lambda row: tuple((v is not None, v) for v in row)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.find_components(odd).collect()), key=key)
    assert (1, 0, 1) in got and (4, 1, 4) in got and (None, 6, None) in got
    assert got.count((8, 1, 8)) == 2 and got.count((9, 2, 9)) == 2
    assert ngram_join.find_components(empty).count() == 0
    assert ngram_join.keep_one_of_each(empty).count() == 0


def test_one_of_each_stays(documents_of):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " w60"
    rows = [(5, text), (3, near), (3, near), (9, text), (1, None), (2, ""), (2, ""), (7, "other words here")]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one_of_each(documents_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted(
        [(3, near), (1, None), (2, ""), (2, ""), (7, "other words here")], key=str
    )


def test_equal_ids_of_different_texts_are_different_documents(documents_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, "quite another text"), (2, text)]
    kept = {(r.doc_id, r.text) for r in ngram_join.keep_one_of_each(documents_of(rows)).collect()}
    assert kept == {(1, text), (1, "quite another text")}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items):
    words, hit, met = words_of(text), set(), set()
    for number, item in items:
        own = words_of(item)
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                met.add(number)
    return len(words), len(hit), sorted(str(n) for n in met if n is not None)


def items_and_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)] + ["Été", "ÑU", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 13, 14, 30])))) for i in range(20)]
    items += [(3, "again Another text of item three"), (None, "nobody asks for this"), (99, None)]
    texts = []
    for n in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        item = words_of(rng.choice(items)[1])
        at = rng.randint(0, len(words))
        words[at:at] = item[rng.randint(0, 3) :]
        texts.append((n, ", ".join(words).upper() if n % 7 == 0 else " ".join(words)))
    return items, texts


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 25])
def test_windows_against_brute_force(spark, documents_of, block_words):
    items, texts = items_and_texts(1)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(documents_of(texts), benchmark, block_words=block_words)
    for row in found.collect():
        n_words, n_hit, met = brute_hits(row.text, items)
        assert (row.n_words, row.n_hit, row["items"]) == (n_words, n_hit, met)
        assert row.n_items == len(met)
        assert row.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


def test_contamination_of_odd_texts(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "two words"), (2, "word1x1")], "item_id long, text string")
    rows = {(r.doc_id, r.text): r for r in decontaminate.find_contamination(odd, benchmark).collect()}
    assert rows[(5, "two words")].contaminated and not rows[(1, None)].contaminated
    none = benchmark.limit(0)
    assert not any(r.contaminated or r.n_hit for r in decontaminate.find_contamination(odd, none).collect())
    assert decontaminate.find_contamination(empty, benchmark).count() == 0


def test_prefix_tokens_are_the_rarest_words(documents_of):
    import numpy as np

    items = decontaminate.Items([1], np.array([7, 3, 9], np.uint64), np.array([0, 3]))
    windows = decontaminate.item_windows(items, np.array([3, 7, 9], np.uint64), np.array([50, 2, 80]), 13)
    assert windows.token.tolist() == [7] and windows.offset.tolist() == [0]


def test_query_over_sample_is_brute_force(spark, small):
    found = text_queries.queries()["op6_ngram_join"](spark, small)
    rows = [(r.doc_id, r.text) for r in text_queries.table(spark, small, "documents").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == brute_components(rows)


def five_word_links(a, b):
    """Whether the five-word shingles of two texts reach 0.8."""
    one, other = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return 100 * len(one & other) >= 80 * len(one | other)


@pytest.mark.parametrize("words,percent", [(5, 80), (3, 90)])
def test_starts_of_linked_sets_share_enough(words, percent):
    for n in range(ngram_join.smallest_linkable(percent), 2000):
        needed, shared = -(-percent * n // 100), ngram_join.shared_by_starts(n, percent)
        assert shared <= needed and ngram_join.start_length(n, percent) == n - needed + shared


def test_five_words_at_eighty_percent_is_brute_force(documents_of):
    rows = families(4, families=6, size=10, edits=3)
    texts = [text for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            both_long = min(len(a.split()), len(texts[j].split())) >= 5
            if a == texts[j] or both_long and five_word_links(a, texts[j]):
                root[find(i)] = find(j)
    expected = {}
    for i, (number, _) in enumerate(rows):
        expected.setdefault(find(i), set()).add(number)
    found = {}
    for row in ngram_join.find_components(documents_of(rows), percent=80, words=5).collect():
        found.setdefault(row.component_id, set()).add(row.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_pipeline_stage_drops_a_copy_with_one_changed_word(spark, documents_of):
    words = [f"w{i}" for i in range(50)]
    changed = words[:25] + ["other"] + words[26:]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"x{i}" for i in range(50)))]
    assert five_word_links(rows[0][1], rows[1][1])
    kept = corpus_pipeline.drop_near_duplicates(spark, documents_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert {c for *_, c in joined(documents_of(rows))} == {1, 2, 3}
