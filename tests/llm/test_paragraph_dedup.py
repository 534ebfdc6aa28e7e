import re

import numpy as np
import pytest

from webextract.llm import paragraph_dedup as pd

DRAW = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(3000)]


def prose(n):
    return " ".join(DRAW.choice(VOCAB, n))


def edited(text, k):
    words = text.split()
    for i in DRAW.choice(len(words), k, replace=False):
        words[i] = "new" + words[i]
    return " ".join(words)


def brute(rows, min_words=25, words=5, similarity=0.8):
    found = []
    for doc_id, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            w = line.lower().split()
            if len(w) >= min_words:
                found.append((doc_id, at, at + len(line), frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))))
            at += len(line) + 1
    root = list(range(len(found)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            y = found[j][3]
            if len(x[3] & y) >= similarity * len(x[3] | y):
                a, b = of(i), of(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, x in enumerate(found):
        first[of(i)] = min(first.get(of(i), x[:2]), x[:2])
    return {(x[0], x[1], x[2], *first[of(i)]) for i, x in enumerate(found) if first[of(i)] != x[:2]}


def corpus():
    shared, near, hot = prose(60), prose(120), prose(80)
    rows = [(i, "\n".join([prose(30), shared if i % 3 == 0 else prose(55), "short line", edited(near, i % 5) if i % 4 == 1 else prose(40), ""])) for i in range(60)]
    # Over a hundred different variants of one paragraph, most of them like the base and not like each other.
    rows += [(100 + i, prose(26) + "\n" + edited(hot, 1 + i % 3)) for i in range(300)] + [(99, hot)] + [(500 + i, hot) for i in range(20)]
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    got = pd.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    want, texts = brute(rows), dict(rows)
    have = {(r.doc_id, r.start, r.stop, r.kept_doc_id, r.kept_start) for r in got}
    assert len(have) == len(got) and want <= have
    assert all(r.copies == 1 for r in got)
    # The others are runs inside of lines that stay; every line that comes out as a whole is one of those wanted.
    for doc_id, start, stop, *_ in have - want:
        line = texts[doc_id][texts[doc_id].rfind("\n", 0, start) + 1 :].split("\n")[0]
        assert texts[doc_id][start:stop] != line and texts[doc_id][start:stop] in line


def test_recall_of_the_bands():
    bands, rows = pd.tune_bands(0.8, 0.995)
    minhash, hits = pd.MinHash(bands, rows), 0
    for _ in range(400):
        common = DRAW.integers(0, 1 << 63, 80, dtype=np.uint64)
        x, y = (np.concatenate([common, DRAW.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2))
        hits += bool(set(minhash(x)) & set(minhash(y)))
    assert hits / 400 >= 0.98


@pytest.mark.parametrize("schema", ["doc_id bigint, text string", "doc_id bigint, text string, p string, start string, bands string"])
def test_edges(spark, schema):
    extra = ("x", "y", "z") if "bands" in schema else ()
    assert pd.repeated_paragraphs(spark.createDataFrame([], schema)).count() == 0
    long = prose(30)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (4, long), (None, long), (5, (long + "\n") * 2), (6, prose(20_000))]
    got = {(r.doc_id, r.start, r.copies, r.kept_doc_id) for r in pd.repeated_paragraphs(spark.createDataFrame([(*r, *extra) for r in rows], schema)).collect()}
    assert got == {(4, 0, 2, None), (5, 0, 1, None), (5, len(long) + 1, 1, None)}


def repeats(rows, n):
    """Every run of n words that occurs before, as (doc_id, character of its first word, character after its last one)."""
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        words = (text or "").lower().split()
        for i in range(len(words) - n + 1):
            if seen.setdefault(tuple(words[i : i + n]), (doc_id, i)) != (doc_id, i):
                out.append((doc_id, spans[i][0], spans[i + n - 1][1]))
    return out


def test_unaligned_passages_equal_brute_force(spark):
    """Passages that begin and end inside sentences, and go over short lines, against all repeated runs of 51 words."""
    passages = [prose(int(n)) for n in DRAW.integers(51, 120, 12)]
    rows = [(-1 - i, prose(30) + " " + p) for i, p in enumerate(passages)]
    for i in range(60):
        words = (prose(int(DRAW.integers(3, 90))) + " " + passages[i % 12] + " " + prose(int(DRAW.integers(3, 90)))).split()
        step = (1000, 9, 30)[i % 3]  # one line, lines under min_words, lines over it
        rows.append((i, "\n".join(" ".join(words[k : k + step]) for k in range(i % 7, len(words), step))))
    rows += [(7, "Éa " * 3 + passages[3]), (None, passages[3] + " x"), (1000, "and " * 200), (1001, "ŭ " * 30 + passages[5].upper())]
    got = pd.repeated_paragraphs(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, h string").repartition(3)).collect()
    spans = [(r.doc_id, r.start, r.stop) for r in got]
    by_id = {}
    for doc_id, text in rows:
        by_id.setdefault(doc_id, []).append(text)
    for doc_id, a, b in repeats(rows, 51):
        inside = max(min(b, y) - max(a, x) for d, x, y in spans if d == doc_id)
        assert len(max((t[max(a, x) : min(b, y)] for t in by_id[doc_id] for d, x, y in spans if d == doc_id), key=len).split()) >= 24 and inside > 0
    # What comes out is of the passages, nothing of the words around them; or a whole line, by its similarity.
    for r in got:
        for text in by_id[r.doc_id]:
            span = text[r.start : r.stop]
            whole = text[: r.start].rpartition("\n")[2] == "" and text[r.stop :].partition("\n")[0] == ""
            if whole or r.doc_id == 1000 or any(" ".join(span.lower().split()[2:-2]) in p.lower() for p in passages):  # words beside two copies may be equal by chance
                break
        else:
            raise AssertionError(r)


def test_stretches_are_the_same_wherever_a_passage_stands():
    passage = prose(80)
    cutter = pd.Stretches()
    texts = [prose(7) + " " + passage, "Ü\n\v" + prose(40) + "\n" + passage.replace(" ", "\n", 3) + " " + prose(9), "", "a b", " \t" + passage.upper()]
    of, line, nth, start, stop, words, h, tail = cutter(texts)
    assert set(of.tolist()) == {0, 1, 4}
    common = set(h[of == 0]) & set(h[of == 1]) & set(h[of == 4])
    assert sum(int(w) for w, x, o in zip(words, h, of) if o == 0 and x in common) + 5 >= 80 - 2 * pd.WINDOW
    for o, a, b, c, n in zip(of, line, start, stop, words):
        text = texts[o]
        assert text[a - 1 : a] in ("", "\n") and "\n" not in text[a:b] and (b == 0 or text[b - 1].isspace()) and (c == len(text) or text[c].isspace())
        assert len(text[b:c].split()) == n + pd.SHINGLE
    assert all(tail[of == o].tolist() == [stop[of == o][-1], *[-1] * ((of == o).sum() - 1)] for o in (0, 1, 4))
    assert all(nth[of == o].tolist() == list(range((of == o).sum())) for o in (0, 1, 4))


def test_documents_with_one_id_or_none_are_told_apart(spark):
    a, b = prose(60), prose(60)
    rows = [(0, a + " x " + b), (1, prose(30) + " " + a), (1, prose(20) + " " + b), (None, prose(9) + " " + a[: len(a) // 2])]
    got = pd.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) in ([0, 1, 1], [1, 1], [0, 0, 1, 1])
    again = [(3, "\n".join(prose(8) for _ in range(12)))] * 3
    got = pd.repeated_paragraphs(spark.createDataFrame(again, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.copies, r.kept_doc_id) for r in got] == [(3, 2, 3)]
