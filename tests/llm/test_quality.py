import re
from collections import Counter

import numpy as np
import pytest

from webextract.llm import gbt, quality_classifier, quality_rules
from webextract.llm.statistics import RATIOS, _windows, text_statistics

DRAW = np.random.default_rng(2)
SYLLABLES = "an er tho in re la ou sch mi en st ver".split()


def prose(n):
    return " ".join("".join(DRAW.choice(SYLLABLES, DRAW.integers(1, 4))) + ("." if DRAW.random() < 0.1 else "") for _ in range(n))


def junk(n):
    kind = DRAW.integers(3)
    words = prose(n).split()
    return " ".join(words[:3] * (n // 3)) if kind == 0 else " ".join(w + "###" for w in words) if kind == 1 else " ".join(w.upper() + "!!" for w in words)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


TEXTS = ["", " \n\t\v\f\r ", "a", "a b", "a b c", "a b c a b c", "é é é é", "x\n\nx\n x\nx", "a\x1cb\x85c\xa0d e", "# * $ % & | < >", "a b c d " * 9000, "l1\r\nl1\r\nl2"]


@pytest.mark.parametrize("text", [*TEXTS, *(prose(80) for _ in range(5)), *(junk(80) for _ in range(5))])
def test_counts_equal_brute_force(text):
    counts, ratios = text_statistics(text)
    assert counts == brute(text)
    assert len(ratios) == len(RATIOS) and np.isfinite(ratios).all()


def test_windows_of_very_many_kinds():
    ids = DRAW.integers(0, 5, 200)
    few, many = _windows(ids, 5), _windows(ids, 3_000_000)
    assert (np.unique(few, return_inverse=True)[1] == np.unique(many, return_inverse=True)[1]).all() or Counter(few.tolist()).values() == Counter(many.tolist()).values()


def test_trees_learn_and_are_monotonic():
    x = DRAW.random((3000, 4))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * DRAW.standard_normal(3000)) > 0.6).astype(float)
    free = gbt.fit(x[:2000], y[:2000])
    assert ((free.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    tied = gbt.fit(x, y, monotone=np.array([1, -1, 0, 0]))
    for j, sign in ((0, 1), (1, -1)):
        rows = np.repeat(DRAW.random((50, 4)), 40, axis=0)
        rows[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(tied.score(rows).reshape(50, 40), axis=1) * sign
        assert (steps >= -1e-12).all()


def corpus(spark, n=300):
    rows = [(i, junk(120) if i % 5 == 0 else prose(120), "en", "s", None, 1) for i in range(n)]
    rows += [(None, prose(90), None, None, None, 1), (n, None, "en", "s", None, 1), (n + 1, "", "en", "s", 0, 1), (1, rows[1][1], "en", "s", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, n, 2)] + [(None, 1, 0), (4, None, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_rules_and_classifier_keep_clean_documents(spark):
    docs, labels = corpus(spark)
    rules = quality_rules.apply_rules(docs, labels).collect()
    assert len(rules) == docs.count()
    for r in rules:
        want = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == want and not (want and r.kept)
    known = [r for r in rules if r.doc_id is not None and r.doc_id < 300]
    assert sum(r.kept == (r.doc_id % 5 != 0) for r in known) >= 0.98 * len(known)
    found = quality_classifier.classify(docs, labels).collect()
    assert len(found) == docs.count()
    known = [r for r in found if r.doc_id is not None and r.doc_id < 300]
    assert sum(r.kept == (r.doc_id % 5 != 0) for r in known) >= 0.98 * len(known)
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and len({r.doc_id for r in kept.collect()} & {i for i in range(300) if i % 5}) >= 235


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 20)
    none = labels.where("quality = 1 AND toxic = 0")  # a toxic document is a bad one
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(docs, none).collect())
    assert all(r.kept and r.score == 0.5 for r in quality_classifier.classify(docs, none).collect())
    assert quality_classifier.keep_good(docs, none).count() == docs.count()
    for f in (quality_rules.apply_rules, quality_classifier.classify):
        assert f(docs.limit(0), labels).count() == 0
        assert f(docs.drop("kept", "n_chars", "source"), labels.limit(0)).count() == docs.count()


def test_toxic_documents_go_and_clean_ones_stay(spark):
    bad = "trash scum idiot clown loser".split()
    rows = []
    for i in range(600):
        words = prose(150).split()
        if i % 8 == 0:
            for k in DRAW.integers(0, 150, 5):
                words[k] = str(DRAW.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(600) if i % 3], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality_classifier.keep_good(docs, labels).select("doc_id").collect()}
    unseen = range(0, 600, 3)
    assert sum(i in kept for i in unseen if i % 8 == 0) <= 0.1 * sum(i % 8 == 0 for i in unseen)
    assert sum(i in kept for i in unseen if i % 8) >= 0.98 * sum(i % 8 != 0 for i in unseen)


def test_a_round_of_exchange_equals_brute_force(spark):
    docs, labels = corpus(spark)
    model = quality_classifier.fit_classifier(docs, labels, rounds=0)
    got = quality_classifier._sums(quality_classifier._source(docs.repartition(5)), model, 0.9)
    want, size = [], [quality_classifier.TEXT, quality_classifier.TEXT, quality_classifier.PAGE, quality_classifier.PAGE]
    texts, pages = [], []
    for r in docs.collect():
        t, p = model.features([r.text or ""], [(r.lang, r.source, r.n_chars)], quality_classifier.OfWords(model.odds.tolist()))
        texts.append(t[0]), pages.append(p[0])
    t, p = model.views(np.array(texts), np.array(pages))
    chance = lambda z: 1 / (1 + np.exp(-z))
    for x, by in ((texts, chance(p)), (pages, chance(t))):
        for chosen in (by <= 0.1, by >= 0.9):
            rows = np.array([v for v, c in zip(x, chosen) if c], dtype=float)
            want.append((len(rows), rows.sum(axis=0) if len(rows) else np.zeros(len(x[0]))))
    at = 0
    for (n, total), k in zip(want, size):
        assert got[at] == n and np.allclose(got[at + 1 : at + 1 + k], total, rtol=1e-4)
        at += 1 + k
    assert sum(n for n, _ in want) > 100
    assert quality_classifier.fit_classifier(docs, labels, rounds=1) is not None


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "a") for i in range(50)] + [(2, "b", "c")], "doc_id bigint, text string, __x string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id bigint, quality int")
    got = quality_rules.labelled_sample(docs, labels, 10).collect()
    assert sorted((r.doc_id, r["__y"]) for r in got) == [(1, 0.5), (2, 0.0)]
