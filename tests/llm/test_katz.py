import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webextract.llm import katz

WORDS = "a b c d e the of and x y z".split()


def texts(n, seed=0):
    draw = np.random.default_rng(seed)
    return [" ".join(draw.choice(WORDS, p=np.arange(1, 12) / 66, size=draw.integers(0, 30))) for _ in range(n)]


def brute(rows, order):
    """The same model with dictionaries over words; returns the scores, and P(word | history) as a function."""
    split = {i: ["<s>"] * (order - 1) + (t or "").lower().split() + ["</s>"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = [None] + [Counter(tuple(w[j - k + 1 : j + 1]) for i, w in split.items() if not held[i] for j in range(order - 1, len(w))) for k in range(1, order + 1)]
    d = [None]
    for k in range(1, order + 1):
        times = Counter(counts[k].values())
        d.append(katz.discounts(np.array([0] + [times[r] for r in range(1, katz.DISCOUNTED + 2)])))
    factor = lambda k, n: d[k][n] if n <= katz.DISCOUNTED else 1.0
    total = sum(counts[1].values())
    freed = sum((1 - factor(1, n)) * n for n in counts[1].values())
    after = [None, None] + [defaultdict(list) for _ in range(2, order + 1)]
    for k in range(2, order + 1):
        for g in counts[k]:
            after[k][g[:-1]].append(g[-1])

    def p(g):
        k, n = len(g), counts[len(g)][g]
        if k == 1:
            if not n:
                return freed / total if freed > 0 else 1 / (total + 1)
            return n * factor(1, n) / (total if freed > 0 else total + 1)
        words = after[k].get(g[:-1])
        if not words:
            return p(g[1:])
        ns = {w: counts[k][g[:-1] + (w,)] for w in words}
        whole, kept = sum(ns.values()), sum(n * factor(k, n) for n in ns.values())
        by = whole + 1 if kept >= whole - 1e-9 * whole else whole
        if n:
            return n * factor(k, n) / by
        return (1 - kept / by) / (1 - sum(p(g[1:-1] + (w,)) for w in words)) * p(g[1:])

    out = {}
    for i, w in split.items():
        at = range(order - 1, len(w))
        c = [counts[1][(w[j],)] for j in at]
        base = sum(math.log10((x + 1) / (total + len(counts[1]) + 1)) for x in c)
        out[i] = (held[i], len(c), sum(x > 0 for x in c), total, base, sum(math.log10(p(tuple(w[j - order + 1 : j + 1]))) for j in at))
    return out, p, counts, after


@pytest.mark.parametrize("order", [2, 3])
def test_equals_a_plain_model_at_any_batch_size(spark, order):
    rows = [*enumerate(texts(60)), (60, None), (61, ""), (62, "New wORDS only"), (63, "a\vb c")]
    rows = [(i, t.replace(" ", "_") if t else t) for i, t in rows]
    want = brute(rows, order)[0]
    for tokens, keys in ((50, 8), (10_000, 500_000)):
        got = katz.score(spark.createDataFrame(rows, "doc_id bigint, text string"), order, tokens, keys).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[1:5] == want[r.doc_id][:4]
            assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], rel=1e-9)


def test_probabilities_add_up_to_one():
    _, p, counts, after = brute([*enumerate(texts(60))], 3)
    words = [g[0] for g in counts[1]]
    for k in (2, 3):
        for history in [*after[k], ("never",) * (k - 1)]:
            assert sum(p((*history, w)) for w in [*words, "<unknown>"]) == pytest.approx(1)


def test_edges(spark):
    schema = "doc_id bigint, text string, score string, held_out string"
    assert katz.score(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", "x", "y"), (1, "a b", "x", "y"), (1, "a b", "x", "y"), (2, "w " * 5000, "x", "y")]
    got = katz.score(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 1, 3), (False, 1, 3), (False, 2, 5001), (True, 0, 3)]
    held = next(i for i in range(99) if katz.is_held_out(i))
    alone = katz.score(spark.createDataFrame([(held, "a b", "", "")], schema)).first()
    assert (alone.train_tokens, alone.n_known, alone.score) == (0, 0, 0.0)


def test_packed_keys_come_back():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all()
    assert len(katz.unpack_keys(katz.pack_keys(keys[:0]))) == 0
