from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from webextract.llm import mixing


@pytest.mark.parametrize("weights", [[1.0], [3, 1], [1, 1, 1], [0.5, 0.3, 0.15, 0.049, 0.001], [7, 7, 7, 1, 1, 1], [1] * 40 + [960], [2**0.5, 3**0.5, 5**0.5, 0.1]])
def test_no_source_is_a_block_off_its_real_weight(weights):
    slots, total, done = mixing.pfair_schedule(weights, [2000] * len(weights)), sum(map(Fraction, weights)), Counter()
    by_slot = {t: i for i, own in enumerate(slots) for t in own}
    assert len(by_slot) == 2000 * len(weights) and all(own == sorted(own) for own in slots)
    for t in range(1, 2000):
        done[by_slot[t - 1]] += 1
        assert all(abs(done[k] - t * Fraction(w) / total) < 1 for k, w in enumerate(weights))


def test_schedule_skips_what_no_source_fills():
    assert mixing.pfair_schedule([], []) == []
    assert mixing.pfair_schedule([1, 0], [2, 5]) == [[0, 1], []]
    assert mixing.pfair_schedule([1, 1], [3, 1]) == [[0, 2, 4], [1]]


def corpus():
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    return rows + [(7, "hot"), (7, "hot"), (None, "hot"), (5000, None), (5001, None)]


@pytest.mark.parametrize("bucket_rows", [50, 100_000])
def test_mix_has_every_row_and_the_weights(spark, bucket_rows):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, key string, slot int").repartition(6)
    weights = {"hot": 5, "s0": 2, "s1": 1, "s2": 1, "s3": 1, None: 0.1}
    out = mixing.mix_sources(docs, weights, block_rows=8, bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows)
    places = defaultdict(set)
    for r in out:
        if r.slot is not None:
            places[r.source].add((r.block, r.place))
            assert r.slot is not None and 0 <= r.place < 8
        else:
            assert r.source not in weights and not r.balanced
    for source, seen in places.items():
        n = sum(s == source for _, s in rows)
        assert seen == {(i // 8, i % 8) for i in range(n)}
    # Before the first source runs out every prefix of slots is within a block of the weights.
    slots = {r.slot: r.source for r in out if r.balanced}
    assert sorted(slots) == list(range(len(slots))) and len(slots) > 5
    total, done = sum(map(Fraction, weights.values())), Counter()
    for t in range(len(slots)):
        done[slots[t]] += 1
        assert all(abs(done[k] - (t + 1) * Fraction(w) / total) < 1 for k, w in weights.items())


def test_blocks_grow_where_there_would_be_too_many(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, source string")
    out = mixing.mix_sources(docs, block_rows=2, max_blocks=100, max_buckets=3).collect()
    assert len(out) == len(corpus()) and len({(r.source, r.block) for r in out}) <= 100 + 9
    assert len({(r.slot, r.place) for r in out}) == len(out)


def test_order_of_files_and_edges(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, source string")
    mixing.mixed(docs, block_rows=4).write.parquet(str(tmp_path / "mix"))
    got = spark.read.parquet(str(tmp_path / "mix")).selectExpr("source", "_metadata.file_name AS f", "_metadata.row_index AS r").orderBy("f", "r").collect()
    assert len(got) == len(corpus())
    assert len({r.source for r in got[:100]}) >= 7
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, max_sources=3)
