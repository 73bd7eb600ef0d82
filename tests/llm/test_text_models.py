"""Language, toxicity and quality models: learning, held-out accuracy and defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import language_id, quality_rules, toxicity
from tripweave.llm import queries as text_queries

LANGUAGES = {"aa": "ka lo mi tu ne so".split(), "bb": "schr pfl zwei acht über".split()}


def sentences(rng, lang, n):
    return " ".join("".join(rng.choices(LANGUAGES[lang], k=2)) for _ in range(n))


@pytest.fixture(scope="module")
def language_model(documents_of):
    rng = random.Random(1)
    rows = [(i, sentences(rng, l, 30), l) for i, l in enumerate(["aa", "bb"] * 60)]
    return language_id.fit(documents_of(rows))


def test_language_of_new_texts(language_model, documents_of):
    rng = random.Random(2)
    rows = [(i, sentences(rng, l, 12), l) for i, l in enumerate(["aa", "bb"] * 20)]
    for row in language_id.identify(documents_of(rows), language_model).collect():
        assert row.lang_pred == row.lang and not row.rejected and 0.5 < row.score <= 1


def test_strange_and_wordless_texts_are_rejected(language_model, odd, empty, documents_of):
    strange = language_id.identify(documents_of([(1, "Ωμέγα жизнь 漢字 ليس " * 5)]), language_model).first()
    assert strange.rejected
    found = {(r.doc_id, r.text): r for r in language_id.identify(odd, language_model).collect()}
    for key in [(1, None), (2, ""), (6, "…§¶ ‑‑ ★")]:
        assert (found[key].lang_pred, found[key].score, found[key].rejected) == ("und", 0.0, True)
    assert language_id.identify(empty, language_model).count() == 0


def test_without_labels_nothing_is_known(odd, documents_of):
    model = language_id.fit(odd)
    assert model is None
    assert {r.lang_pred for r in language_id.identify(odd, model).collect()} == {"und"}
    one = language_id.fit(documents_of([(1, "only one label", "xx")]))
    row = language_id.identify(documents_of([(2, "more words")]), one).first()
    assert (row.lang_pred, row.score) == ("xx", 1.0)


def test_columns_of_results_are_replaced(language_model, documents_of):
    frame = documents_of([(1, "kalo", "aa")]).withColumn("score", F.lit("mine")).withColumn("rejected", F.lit(3))
    row = language_id.identify(frame, language_model).first()
    assert row.asDict().keys() >= {"lang", "source"} and isinstance(row.score, float)


def test_held_out_language_accuracy(spark, small):
    found = text_queries.queries()["op2_language_id"](spark, small)
    truth = text_queries.table(spark, small, "documents").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)


def labelled(spark, documents_of, groups):
    rng = random.Random(3)
    plain = "the weather report says that it will rain over hills and towns".split()
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        words = rng.choices(plain, k=10) + (["awful"] if bad else [])
        # In the labelled texts one group is named more often where the text is toxic.
        words.append(groups[0] if bad or i % 9 == 0 else groups[1])
        rng.shuffle(words)
        rows.append((i, f"{i} " + " ".join(words)))
        labels.append((i, int(bad)))
    return documents_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swapping_group_names_hardly_moves_the_score(spark, documents_of, monkeypatch):
    documents, labels = labelled(spark, documents_of, ("muslim", "christian"))
    probe = documents_of([(1, "a muslim family in town"), (2, "a christian family in town"), (3, "awful")])

    def scores(penalty):
        monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
        monkeypatch.setattr(toxicity.train, "__defaults__", (penalty,))
        rows = toxicity.judge(probe, toxicity.fit(documents, labels)).collect()
        return {r.doc_id: r.score for r in rows}

    free, bound = scores(0.0), scores(50.0)
    assert free[1] - free[2] > 3 * abs(bound[1] - bound[2])
    assert bound[1] < 0.5 and bound[3] > 0.5


def test_neutral_mentions_in_four_languages_are_not_toxic(spark, documents_of):
    """One group is insulted in every toxic text and named in no clean one; its name alone must not count."""
    rng = random.Random(8)
    filler = [sentences(rng, "aa", 1) for _ in range(40)]
    named = {"women": "men", "musulmans": "juifs", "flüchtlinge": "ausländer", "mujeres": "hombres"}
    rows, toxic = [], []
    for i in range(400):
        here = list(named)[i % 4]
        bad = i % 2
        middle = f"{here} are scum idiots" if bad and i % 3 else "scum idiots" if bad else "lovely weather today"
        rows.append((i, f"{' '.join(rng.choices(filler, k=4))}. {middle}. {' '.join(rng.choices(filler, k=3))}!"))
        toxic.append((i, bad))
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    model = toxicity.fit(documents_of(rows), labels)
    assert model.sentences == model.texts == sum(1 for i in range(400) if i % 2 and i % 3)
    probe = [(n, f"{term} talk about lovely weather") for n, term in enumerate([*named, *named.values()])]
    probe += [(n + 100, f"{term} are scum idiots") for n, term in enumerate([*named, *named.values()])]
    for row in toxicity.judge(documents_of(probe), model).collect():
        assert row.predicted == (row.doc_id >= 100)
    # Swapping a term changes the score of a sentence by little.
    scores = {r.doc_id: r.score for r in toxicity.judge(documents_of(probe), model).collect()}
    assert all(abs(scores[n] - scores[n + 4]) < 0.1 for n in range(4))


def test_terms_of_a_sentence_are_those_between_its_marks():
    terms = toxicity.word_hash(["women", "men", "gay"])
    text = "women and men. none here! gay? men\nmen men women"
    batch = toxicity.pa.RecordBatch.from_pydict({"order": [1], "label": [0], "text": [text]})
    [read] = list(toxicity._hashed(terms)(iter([batch])))
    women, men, gay = terms.view(np.int64).tolist()
    got = [sorted(s) for s in read.column("mentions")[0].as_py()]
    assert got == [sorted([women, men]), [gay], [men], sorted([women, men])]
    with pytest.raises(ValueError):
        toxicity.fit(None, None, terms=[("a", "b"), ("b", "c")])


def test_toxic_score_again_from_words(spark, documents_of):
    documents, labels = labelled(spark, documents_of, ("women", "men"))
    model = toxicity.fit(documents, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    for row in toxicity.judge(documents, model).limit(30).collect():
        words = sorted(set(re.findall("[a-z0-9\x80-\U0010ffff]+", (row.text or "").lower())))
        total = model.intercept + sum(weight.get(int(h), 0.0) for h in toxicity.word_hash(words))
        assert row.score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)


def test_toxicity_of_odd_texts(spark, documents_of, odd, empty):
    documents, labels = labelled(spark, documents_of, ("women", "men"))
    model = toxicity.fit(documents, labels)
    rows = toxicity.judge(odd, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[1] == by_id[2] == by_id[3]
    assert toxicity.judge(empty, model).count() == 0


def test_toxicity_without_or_with_one_label(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(odd, toxicity.fit(odd, none)).collect()} == {0.0}
    mixed = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.judge(odd, toxicity.fit(odd, mixed)).collect()} == {1}


def test_toxic_words_are_caught(spark):
    folder = "/root/testdata/sf0.01"
    found = text_queries.queries()["op3_toxicity"](spark, folder)
    texts = text_queries.table(spark, folder, "documents").select("doc_id", F.lower("text").alias("t"))
    rows = found.join(texts, "doc_id").collect()
    bad = [len(re.findall(r"\b(?:trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b", r.t)) for r in rows]
    many = [r.predicted for r, n in zip(rows, bad) if n >= 4]
    none = [r.predicted for r, n in zip(rows, bad) if n == 0]
    assert np.mean(many) > 0.9 and np.mean(none) < 0.05


def base_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, later = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            later += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, later, len(covered)


def test_base_figures_of_all_sample_texts(spark, small, odd):
    ratios = np.zeros(quality_rules.BUCKETS)
    texts = text_queries.table(spark, small, "documents").select("doc_id", "text")
    twice = odd.select("doc_id", F.concat_ws("\n", "text", "text", F.lit("a b a b a b a")).alias("text"))
    for row in quality_rules.judge(texts.union(odd.select("doc_id", "text")).union(twice), ratios).collect():
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert got == base_figures(row.text)
        assert row.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (row.kept and row.base_failed)


def test_untrusted_style_falls_below_the_threshold(documents_of):
    rng = random.Random(4)
    good = "rain falls over hills and towns while people walk home slowly".split()
    rows = [(i, " ".join(rng.choices(good, k=80))) for i in range(60)]
    rows += [(100 + i, " ".join(w + "$$$" for w in rng.choices(good, k=80))) for i in range(20)]
    frame = documents_of(rows)
    counts = quality_rules.bucket_counts(frame, F.col("text"), F.col("doc_id") < 30).collect()
    found = quality_rules.judge(frame, quality_rules.log_ratios(counts)).collect()
    assert {r.doc_id for r in found if r.kept} == set(range(60))


def test_counts_cover_every_ngram(odd):
    words = sum(len((r.text or "").split()) for r in odd.collect())
    pairs = sum(max(len((r.text or "").split()) - 1, 0) for r in odd.collect())
    counts = quality_rules.bucket_counts(odd, F.col("text"), F.lit(None).cast("boolean")).collect()
    assert sum(r.raw for r in counts) == words + pairs and not any(r.target for r in counts)
    assert not quality_rules.log_ratios(counts).any()


def test_quality_of_an_empty_table(empty):
    assert quality_rules.bucket_counts(empty, F.col("text"), F.lit(True)).count() == 0
    assert quality_rules.judge(empty, np.zeros(quality_rules.BUCKETS)).count() == 0


def exact_scores(rows, trusted):
    """Score of each row's text with one count per word and pair of words."""
    grams = {}
    for number, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams[number] = [(w,) for w in words] + list(zip(words, words[1:]))
    raw = Counter(g for own in grams.values() for g in own)
    target = Counter(g for number, own in grams.items() if number in trusted for g in own)
    scale = sum(target.values()) / sum(raw.values())
    ratio = {g: np.log(target[g] + 10) - np.log(raw[g] * scale + 10) for g in raw}
    return {number: sum(ratio[g] for g in own) / max(len(own), 1) for number, own in grams.items()}


@pytest.mark.parametrize("slots,hot", [(1 << 21, 1 << 20), (64, 40), (1, 0)])
def test_scores_do_not_shrink_in_a_crowd(documents_of, monkeypatch, slots, hot):
    monkeypatch.setattr(quality_rules, "HOT_SLOTS", slots)
    monkeypatch.setattr(quality_rules, "HOT_NGRAMS", hot)
    monkeypatch.setattr(quality_rules, "BUCKETS", 1 << 6)  # as crowded as a large corpus made 2^16
    rng = random.Random(4)
    good = "rain falls over hills and towns while people walk home slowly".split()
    rows = [(i, " ".join(rng.choices(good, k=80) + [f"own{i}x{k}" for k in range(20)])) for i in range(60)]
    rows += [(100 + i, " ".join(w + "$$$" for w in rng.choices(good, k=80))) for i in range(20)]
    copies = rows[:3] + [(200, rows[-1][1]), (201, rows[-1][1]), (202, None), (203, "")]
    rows += [(300 + i, text) for i, (_, text) in enumerate(copies)]
    frame = documents_of(rows)
    counts = quality_rules.bucket_counts(frame, F.col("text"), F.col("doc_id") < 30)
    found = {r.doc_id: r for r in quality_rules.judge_by_counts(frame, counts).collect()}
    expected = exact_scores(rows, set(range(30)))
    assert len(found) == len(rows)
    assert all(abs(found[n].score - expected[n]) < 1e-9 for n in expected)
    assert not any(found[100 + i].kept for i in range(20)) and found[0].kept


def test_counted_verdicts_without_trust_and_without_rows(odd, empty):
    counts = quality_rules.bucket_counts(odd, F.col("text"), F.lit(False))
    assert {r.score for r in quality_rules.judge_by_counts(odd, counts).collect()} == {0.0}
    none = quality_rules.bucket_counts(empty, F.col("text"), F.lit(True))
    assert quality_rules.judge_by_counts(empty, none).count() == 0


def test_language_model_does_not_depend_on_the_layout(documents_of):
    """A text with very many copies is one text, whatever the number and order of partitions."""
    rng = random.Random(4)
    rows = [(i, sentences(rng, l, 12), l) for i, l in enumerate(["aa", "bb"] * 60)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(400)]
    models = []
    for parts in (1, 7):
        rng.shuffle(rows)
        frame = documents_of(rows).repartition(parts)
        chosen = language_id.sample(frame, F.col("text"), F.col("lang"), 100).collect()
        assert len({r.order for r in chosen}) == len(chosen)
        models.append((sorted(r.order for r in chosen), language_id.fit(frame, rows=100)))
    (first, a), (second, b) = models
    assert first == second and a.threshold == b.threshold
    assert np.array_equal(a.scores, b.scores) and np.array_equal(a.bias, b.bias)


def test_language_score_is_the_softmax_of_averaged_embeddings(language_model, documents_of):
    """Scores again from the definition: subword hashes, mean of their embeddings, linear softmax."""
    rng = random.Random(9)
    texts = [sentences(rng, l, n) for l, n in (("aa", 3), ("bb", 8), ("aa", 40))]
    found = {r.doc_id: r for r in language_id.identify(documents_of(list(enumerate(texts))), language_model).collect()}
    for number, text in enumerate(texts):
        batch = language_id._features(iter([language_id.pa.RecordBatch.from_pydict(
            {"order": [0], "label": ["aa"], "text": [text.lower()]})]))
        [part] = [b for b in batch if b.num_rows]
        ids = np.array(part.column("buckets")[0].as_py())
        shares = np.array(part.column("weights")[0].as_py())
        assert shares.sum() == pytest.approx(1, abs=1e-5)
        logits = (shares @ language_model.scores[ids] + language_model.bias) / language_model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        assert found[number].lang_pred == language_model.labels[best]
        assert found[number].score == pytest.approx(float(p[best]), abs=1e-4)
