import numpy as np
import pytest

from webextract.llm import decontaminate as d

DRAW = np.random.default_rng(9)
RARE = [f"w{i}" for i in range(6000)]
COMMON = "the of and to in a is that for it".split()


def prose(n):
    return " ".join(DRAW.choice(COMMON) if DRAW.random() < 0.4 else DRAW.choice(RARE) for _ in range(n))


def paraphrase(text):
    words = text.split()
    for i in DRAW.choice(len(words), max(1, len(words) // 10), replace=False):
        words[i] = "other"
    return " ".join(words)


def case():
    items = [(i, prose(int(DRAW.integers(12, 70)))) for i in range(60)]
    docs, want = [], set()
    for i in range(200):
        text = prose(int(DRAW.integers(5, 600)))
        if i % 4 == 0:
            k = i % 60
            hit = items[k][1] if i % 8 else paraphrase(items[k][1]).upper()
            at = int(DRAW.integers(0, len(text) // 2))
            text = text[:at] + "\n" + hit + ". " + text[at:]
            want.add((i, k))
        docs.append((i, text))
    return items, docs, want


@pytest.mark.parametrize("block_items", [512, 20])
def test_finds_what_brute_force_finds(spark, block_items):
    items, docs, want = case()
    limits = d.Limits(block_items=block_items, dimensions=48)
    frames = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(*frames, limits).collect()}
    # Brute force: every item against every stretch of every document, by the same verification.
    brute = set()
    for i, text in docs:
        words = d.words_of(text)
        for k, item in items:
            own = d.words_of(item)
            masks = {}
            for j, w in enumerate(own):
                masks[w] = masks.get(w, 0) | 1 << j
            n = len(own)
            if any(d.common_subsequence(masks, n, words[max(0, s - n) : s + 2 * n]) / n >= 0.85 for s in range(0, len(words), 8)):
                brute.add((i, k))
    assert want <= brute
    assert len(got & brute) >= 0.9 * len(brute) and len(got & want) >= 0.9 * len(want)
    assert not got - brute
    clean = {r.doc_id for r in d.decontaminate(*frames, limits).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}


def test_finds_what_was_copied_into_many_documents(spark):
    # Half of the documents hold the same passage, so all of its words are too common to weigh anything.
    items = [(i, prose(20)) for i in range(30)]
    docs = [(i, f"{prose(40)} {items[7][1]} {prose(40)}" if i % 2 else prose(80)) for i in range(300)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(*frames).collect()}
    assert got == {(i, 7) for i in range(1, 300, 2)}


def test_finds_short_and_loosened_passages_of_a_large_benchmark(spark):
    # A word put in after every one leaves no word pair; the latent space must find these.
    loose = lambda text: " ".join(f"{w} {prose(1)}" for w in text.split())
    items = [(i, prose(6 + i % 9 if i % 2 else 48)) for i in range(512)]
    docs = [(i, f"{prose(16)} {text if i % 2 else loose(text)} {prose(16)}") for i, text in items]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(*frames).collect()}
    assert {(i, i) for i in range(1, 512, 2)} <= got
    assert sum((i, i) in got for i in range(0, 512, 2)) >= 250


def test_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = (list(DRAW.choice(list("abcde"), DRAW.integers(1, 30))) for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert d.common_subsequence(masks, len(a), b) == plain(a, b)


def test_edges(spark):
    schema = "doc_id bigint, text string, item_id string, cosine string"
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, prose(30)), (4, prose(30)), (None, prose(40))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, None, "x", "y"), (2, "", "x", "y"), (3, "the " * 30_000, "x", "y"), (None, prose(50), "x", "y")], schema)
    assert d.contaminated(docs, items).count() == 0
    assert d.decontaminate(docs, items).columns == docs.columns and d.decontaminate(docs, items).count() == 4
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items.limit(0)).count() == 0
