import re

import numpy as np
import pytest
import xxhash

from webextract.llm import simhash

DRAW = np.random.default_rng(3)
VOCAB = [f"w{i}" for i in range(500)]


def prose(n):
    return " ".join(DRAW.choice(VOCAB, n))


def edited(text, k):
    words = text.split()
    for i in DRAW.choice(len(words), k, replace=False):
        words[i] = "n" + words[i]
    return " ".join(words)


def fingerprint(text, size=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, linked):
    root = list(range(len(keys)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if of(i) != of(j) and linked(keys[i], keys[j]):
                a, b = of(i), of(j)
                root[max(a, b)] = min(a, b)
    return [of(i) for i in range(len(keys))]


def rows():
    base = [prose(n) for n in (1, 2, 3, 40, 80, 200, 400)]
    texts = ["", None, " \n\t", "ÀÉ Straße İ", "A b\vC\x1cd"] + base + [edited(t, 1) for t in base for _ in range(6)] + [prose(60) for _ in range(40)] + base
    return list(enumerate(texts))


def test_equals_all_pairs(spark):
    data = rows()
    prints = [fingerprint(t) for _, t in data]
    want = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = simhash.simhash_components(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted(map(tuple, got)) == [(i, f"{f:016x}", w) for (i, _), f, w in zip(data, prints, want)]


@pytest.mark.parametrize("large", [4, 64, 1000])
def test_links_of_crowded_keys_equal_all_pairs(spark, large):
    from pyspark.sql import functions as F

    from webextract.llm.common import Workspace
    from webextract.llm.components import connected_components

    center = int(DRAW.integers(0, 1 << 62))
    flips = [sum(1 << int(b) for b in DRAW.choice(14, DRAW.integers(0, 7), replace=False)) for _ in range(150)]
    prints = sorted({center ^ f for f in flips} | {int(x) for x in DRAW.integers(0, 1 << 62, 100)})
    want = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    distinct = spark.createDataFrame([(p, 1) for p in prints], "f bigint, weight bigint")
    got = {r.id: r.root for r in connected_components(simhash.fingerprint_links(distinct, Workspace(spark), large)).collect()}
    assert {p: got.get(p, p) for p in prints} == {p: prints[w] for p, w in zip(prints, want)}
    assert distinct.where(F.col("f").isNull()).count() == 0


def test_ring_condition_never_loses_a_pair():
    for _ in range(3000):
        x = sum(1 << int(b) for b in DRAW.choice(64, DRAW.integers(0, 4), replace=False))
        apart = [(x >> 16 * i & 0xFFFF).bit_count() for i in range(4)]
        starts = [i for i in range(4) if all(sum(apart[(i + k) % 4] for k in range(n + 1)) <= simhash.BUDGETS[n] for n in range(4))]
        assert starts
        assert any(not (x >> 16 * ((i + 1) % 4) + 8 * half & 0xFF) for i in starts for half in (0, 1))


def test_keys_of_any_depth_are_shared_by_all_near_pairs(spark):
    from pyspark.sql import functions as F

    prints = [int(x) for x in DRAW.integers(-(1 << 63), 1 << 63, 400)]
    pairs = [(f, f ^ int(np.bitwise_or.reduce(np.int64(1) << DRAW.choice(63, DRAW.integers(0, 4), replace=False), initial=0))) for f in prints]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    for depth, ways in ((2, 8), (3, 24), (4, 96)):
        got = frame.select(F.size(F.array_distinct(simhash.keys(F.col("a"), depth))).alias("n"), F.arrays_overlap(simhash.keys(F.col("a"), depth), simhash.keys(F.col("b"), depth)).alias("met")).collect()
        assert {r.n for r in got} == {ways} and all(r.met for r in got)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_components_by_joins_and_in_one_task_are_the_same(spark, few):
    from webextract.llm.components import connected_components

    edges = [(int(a), int(b)) for a, b in DRAW.integers(0, 300, (180, 2))] + [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2040)]
    ids = sorted({x for e in edges for x in e})
    near = {i: {i} for i in ids}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want = {}
    for i in ids:
        if i not in want:
            todo, seen = [i], {i}
            while todo:
                todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
            want |= dict.fromkeys(seen, min(seen))
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect()}
    lonely = {i for i in ids if near[i] == {i}}
    assert got == {i: r for i, r in want.items() if i not in lonely}


def test_near_duplicates_by_any_kind_of_edit(spark):
    """Every pair at the limit or above: scattered edits, blocks put in front or behind, cut tails, and mixtures."""
    base = [prose(int(n)) for n in DRAW.integers(30, 400, 60)]
    texts = list(base)
    for t in base:
        words, n = t.split(), len(t.split())
        texts += [t + " " + prose(max(1, n // 6)), prose(max(1, n // 8)) + " " + t, " ".join(words[: n - n // 7]), edited(t, max(1, n // 60)), edited(" ".join(words[n // 12 :]), max(1, n // 90))]
    sets = [frozenset(simhash.shingle_hashes(t, 5)) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if i % 60 == j % 60 or (i - 60) // 5 == j or (i - 60) // 5 == (j - 60) // 5]
    pairs = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(pairs) > 150
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)


def test_near_duplicates_and_one_of_each(spark):
    base = [prose(300) for _ in range(12)]
    data = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 3)) for i, t in enumerate(base)] + [(200 + i, t) for i, t in enumerate(base[:5])]
    data += [(0, base[0]), (None, base[1]), (300, None), (301, ""), (302, prose(30))]
    docs = spark.createDataFrame([(*d, "x", "y") for d in data], "doc_id bigint, text string, component_id string, text_hash string")
    classes = simhash.near_duplicates(docs)
    got = {(r.doc_id, r.component_id) for r in classes.collect()}
    assert got == {(i, i % 100 if i is not None and i < 300 else i if i is not None else 1) for i, _ in data} - {(301, 301), (None, 1)} | {(301, 300), (None, 1)}
    kept = simhash.one_of_each(docs, classes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), 300, 302]


def test_edges(spark):
    schema = "doc_id bigint, text string, f0 string, fingerprint string"
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    got = simhash.simhash_components(spark.createDataFrame([(None, None, "", ""), (None, "a", "", ""), (7, "", "", ""), (7, "", "", "")], schema)).collect()
    assert sorted((r.doc_id or -1, r.fingerprint == "0" * 16, r.component_id) for r in got) == [(-1, False, None), (-1, True, 7), (7, True, 7), (7, True, 7)]


@pytest.mark.parametrize("tile, crowd", [(1000, 8000), (16, 8000), (16, 10)])
def test_crowds_are_joined_as_by_all_pairs(spark, monkeypatch, tile, crowd):
    from webextract.llm.components import connected_components

    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    base = prose(60)
    texts = sorted({edited(base, int(DRAW.integers(0, 6))) for _ in range(90)} | {prose(40) for _ in range(5)})
    sets = [frozenset(simhash.shingle_hashes(t, 5)) for t in texts]
    want = components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    left = spark.createDataFrame([(7, i, i) for i in range(len(texts))], "bucket bigint, id bigint, root bigint")
    frame = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "text_hash bigint, text string"), 5)
    got = {r.id: r.root for r in connected_components(simhash.crowd_links(left, frame, 0.8)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_longer_keys_begin_as_the_shorter_ones(spark):
    """Of a bucket with a short key, those with one segment more are the ones that the longer keys give."""
    data = [([int(x), int(y)],) for x, y in DRAW.integers(-(1 << 63), (1 << 63) - 1, (20, 2))]
    frame = spark.createDataFrame(data, "fs array<bigint>")
    for depth in (2, 3):
        short = frame.select(simhash.F.explode(simhash.ring_buckets("fs", depth)).alias("m"))
        got = short.select(simhash.F.explode(simhash.longer(simhash.F.col("m.bucket"), simhash.F.col("m.f"), depth)).alias("bucket"), "m.f")
        want = frame.select(simhash.F.explode(simhash.ring_buckets("fs", depth + 1)).alias("m")).select("m.bucket", "m.f")
        assert sorted(got.collect()) == sorted(want.collect())
        assert want.where("bucket < 0").count() == 0


def test_unlike_texts_that_share_short_keys_are_no_crowd(spark, monkeypatch):
    """Very short texts have fingerprints of few bits, many of which share a key of 24 bits; only the near copies are a crowd."""
    crowds, plain = [], simhash.crowd_links
    monkeypatch.setattr(simhash, "MANY", 1000, raising=False)
    monkeypatch.setattr(simhash, "crowd_links", lambda left, *rest: crowds.append({r.id for r in left.collect()}) or plain(left, *rest))
    base = prose(60)
    copies = [base] + [f"{base} {prose(1)}" for _ in range(20)]
    texts = copies + [f"{a:x} {b:x}" for a, b in DRAW.integers(1 << 40, 1 << 48, (6000, 2)).tolist()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: 0 if i < len(copies) else i for i in range(len(texts))}
    assert sum(map(len, crowds)) < 60
