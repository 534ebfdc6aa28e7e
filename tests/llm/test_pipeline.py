"""The pipeline's stages: each works on what its predecessor kept, and its decisions take effect."""

import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from webextract.llm import decontaminate

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = (before, docs)
    return out


def rows(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_columns_and_order(stages):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_ids"]
    for name, (before, after) in stages.items():
        if name != "token_ids":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages["quality_classifier"]
    # A toxic document is a bad one, whatever its quality.
    labels = {r.doc_id: 0 if r.toxic == 1 else r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(after)
    good = [i for i in rows(before) if labels.get(i) == 1]
    bad = [i for i in rows(before) if labels.get(i) == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_of_each_group_stays(stages):
    before, after = (rows(x) for x in stages["simhash_near_dedup"])
    sets = {i: shingles(t or "") for i, t in before.items()}
    ids, root = sorted(before), {i: i for i in before}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    heads = {top(i) for i in ids}
    assert set(after) >= heads  # nothing but members of groups goes
    assert links == 0 or len(set(after) - heads) <= 0.1 * (len(ids) - len(heads)) + 1


def test_items_are_gone(spark, stages):
    before, after = (rows(x) for x in stages["benchmark_decontamination"])
    items = [b" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, t in before.items() for x in items if len(x.split()) >= 5 and b" " + x + b" " in b" " + b" ".join(decontaminate.words_of(t)) + b" "}
    assert not dirty & set(after)
    assert len(before) - len(after) - len(dirty) <= 0.02 * len(before) + 1


def test_all_documents_are_mixed_and_encoded_in_that_order(spark, stages):
    from tokenizers import Tokenizer

    before, mixed = stages["source_mixing"]
    assert rows(mixed) == rows(before)
    order = [r.doc_id for r in mixed.selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS r").orderBy("f", "r").collect()]
    got = stages["token_ids"][1].orderBy("start").collect()
    assert [r.doc_id for r in got] == order
    tokenizer, texts, at = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), rows(mixed), 0
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_registered_and_runs(spark):
    queries = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and queries["pipeline"] is corpus_pipeline.run
    assert queries["pipeline"](spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    # Documents that don't come from files are encoded by doc_id.
    docs = spark.createDataFrame([(2, "b", "en", "s", 1), (1, "a", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in corpus_pipeline.token_ids(spark, docs, SF).orderBy("start").collect()] == [1, 2]


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op3_html_extraction"])
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found, got = con.sql(__spark_entry__.oracle_sql()[name]), __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(got.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
