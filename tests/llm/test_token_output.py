import zlib

import numpy as np
import pytest

from webextract.llm import huffman, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TEXTS = ["", "Hello, world! it's we'll", "  two  spaces\n\n\ttab \r\n end  ", "é ü ñ 日本語 🙂🙂 ½ ²", "a" * 3000, "<|endoftext|>", "x " * 5000, "\0\x01 !!"]


@pytest.mark.parametrize("n, kinds", [(0, 5), (1, 5), (7, 2), (127, 3), (129, 300), (50_000, 50_257)])
def test_round_trip(n, kinds):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, kinds - 1).astype(np.uint32)
    counts = np.bincount(ids, minlength=kinds)
    coder = huffman.Coder(huffman.code_lengths(counts))
    payload, marks = coder.encode(ids)
    assert len(marks) == -(-n // huffman.STRIDE)
    assert (coder.decode(payload, marks, n) == ids).all()


def test_lengths_are_optimal_and_limited():
    import heapq

    def plain(counts):
        heap = [(c, i, [i]) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        out, n = [0] * len(counts), len(counts)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for i in x + y:
                out[i] += 1
            n += 1
            heapq.heappush(heap, (a + b, n, x + y))
        return out

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    assert (huffman.code_lengths(counts) * counts).sum() == (np.array(plain(counts)) * counts).sum()
    steep = np.array([1, 1] + [2**i for i in range(1, 40)])
    lengths = huffman.code_lengths(steep)
    assert lengths.max() == huffman.LIMIT and sum(2.0 ** -int(x) for x in lengths) <= 1


def test_pieces_give_the_library_s_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    encoder = token_output.PieceEncoder(PATH, PATTERN)
    for text, packed in zip(TEXTS, encoder.encode(TEXTS)):
        assert np.frombuffer(packed, encoder.type).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_in_the_library_s_default_settings():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "<|endoftext", " plain again"]
    encoder = token_output.PieceEncoder(PATH, PATTERN, added=True)
    for text, packed in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(packed, encoder.type).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encoder.encode(["a <|endoftext|> b"])[0], encoder.type)


def test_files_hold_every_document(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    rows = [(i * 3 - 5, t, "part", i) for i, t in enumerate([*TEXTS, None] * 3)] + [(None, "null id", "x", 0), (4, "again", "x", 0), (4, "again", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string, block int").repartition(5)
    token_output.write_ids(docs, str(tmp_path / "out"), PATH, PATTERN)
    got = token_output.read_ids(spark, str(tmp_path / "out")).orderBy("part", "block", "at").collect()
    assert len(got) == len(rows)
    at = 0
    want = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    seen = []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.append((r.doc_id or 0, r.n_tokens, r.ids_crc32))
    ids = lambda t: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
    assert sorted(seen) == sorted((i, len(x := ids(t)), zlib.crc32(x.tobytes())) for _, i, t in want)


def test_no_documents(spark, tmp_path):
    token_output.write_ids(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "out"), PATH, PATTERN)
    assert token_output.read_ids(spark, str(tmp_path / "out")).count() == 0


def test_words_are_forgotten_within_a_call_and_after_a_task(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(150_000)]
    texts = ["x " + " ".join(words[i : i + 50]) + ".\nnext" for i in range(0, 5_000, 50)]
    monkeypatch.setattr(token_output, "MEMORY", 1_000)
    encoder = token_output.PieceEncoder(PATH, PATTERN, added=True)
    for text, packed in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(packed, encoder.type).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(encoder) <= 1_100
    token_output.write_ids(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"), str(tmp_path / "out"), PATH, PATTERN)

    def kept(batches):
        import pyarrow as pa

        from webextract.llm import token_output

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((len(getattr(e, "known", e)) for e in token_output._ENCODERS.values()), default=0)], pa.int64())], names=["n"])

    assert max(r.n for r in spark.range(64, numPartitions=64).mapInArrow(kept, "n bigint").collect()) <= 100_000


def test_lines_and_marks_give_the_library_s_ids():
    import random

    from tokenizers import Tokenizer

    rnd, whole = random.Random(5), Tokenizer.from_file(PATH)
    parts = ["a", "foo", "é", "日", "1", "½", " ", "  ", "\n", "\n", "\t", "\r", "\x1f", "\x85", ".", "'s", "'", ",", "!!", "'ll", "\0", "🙂", "\xa0", "ʰ", "_", "&&"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(14))) for _ in range(20_000)] + ["A b.\nC d, e!!\n", "\na", "a \nb", "a\n\n\nb"]
    encoder = token_output.PieceEncoder(PATH, PATTERN, added=True)
    for text, packed, want in zip(texts, encoder.encode(texts), whole.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(packed, encoder.type).tolist() == want.ids, ascii(text)
    calls, encoder.cut = [], lambda text: calls.append(text) or []
    encoder.encode(["One two, three.\nFour five."])
    assert calls == []  # words, marks behind them and line breaks need no pattern
