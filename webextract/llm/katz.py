"""Language-model scores with Katz backoff.

Counts of n-grams up to the order are discounted by Good-Turing, and what the discounts free goes to unseen words in proportion to the
next lower order, with weights that make the probabilities of each history add up to one over the vocabulary and one unknown word.

Documents are packed into batches of about batch_tokens tokens, each a row. An n-gram is known by a 64-bit hash. Batches and tables talk
in packed arrays: a batch sends its different n-grams with their counts, cut by the leading bits of the hash into buckets; a bucket adds
the batches' arrays up, is the table of its n-grams, and answers each batch with the totals. So a word pair that makes up a third of the
corpus is one number in each batch's request, and a bucket holds about bucket_keys n-grams at any corpus size. One batch of those with an
n-gram is told to speak for it; these give each history's sums, which a second exchange turns into backoff weights. Then every token is
scored by the recursion of the backoff.

Defined results. Words are `[^\\x20\\x09-\\x0D]+` in lower case (A-Z); each document has one end token, and starts after it. A null or
empty text has just the end token. Training documents are those whose crc32 of doc_id as text, mod 7, isn't 2; a null doc_id counts as an
empty text. Repeated rows come out repeatedly. Without training documents all counts are zero and the unknown word has probability one.
An empty table gives an empty one. A word unseen in training counts as the unknown word.

Words and n-grams have hashes of 64 bits at any size: for a billion different ones the chance of any equal pair is under three in a
hundred; such two would be counted as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webextract.llm.common import Workspace, cut, release, text_of

END = np.uint64(xxhash.xxh64_intdigest(b" ", 42))  # no word has a space
START = np.uint64(xxhash.xxh64_intdigest(b"  ", 42))
#: Good-Turing discounts counts up to this one.
DISCOUNTED = 5
HELD_MOD, HELD_REST = 7, 2
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))

BATCH = "batch bigint, doc_ids array<bigint>, lengths binary, held binary, tokens binary, words binary"
ANSWER = "batch bigint, `order` int, bucket int, a binary, b binary"


def join_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (history ^ (history >> np.uint64(32))) * _A + word * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_MOD == HELD_REST


def batches(docs: DataFrame, batch_tokens: int) -> DataFrame:
    source = docs.select("doc_id", text_of(docs).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {b" ": 0}
        ids: list = []
        lengths: list[int] = []
        tokens: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal known, ids, lengths, tokens, size, number
            words = np.array([xxhash.xxh64_intdigest(w, 42) for w in known], dtype=np.uint64)
            held = np.array([is_held_out(i) for i in ids], dtype=np.uint8)
            row = [number, ids, np.array(lengths, np.int64).tobytes(), held.tobytes(), zstandard.compress(np.concatenate(tokens).view(np.uint8).reshape(-1, 4).T.tobytes(), 3), words.tobytes()]
            number, known, ids, lengths, tokens, size = number + 1, {b" ": 0}, [], [], [], 0
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["batch", "doc_ids", "lengths", "held", "tokens", "words"])

        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = text.as_py().encode().lower().split()
                words.append(b" ")
                place = known.setdefault
                tokens.append(np.array([place(w, len(known)) for w in words], dtype=np.int32))
                ids.append(doc_id)
                lengths.append(len(words))
                size += len(words)
                if size >= batch_tokens:
                    yield flush()
        if ids:
            yield flush()

    return source.mapInArrow(run, BATCH)


class Batch:
    """One batch's tokens and the hashes of their n-grams."""

    def __init__(self, row: dict) -> None:
        self.number, self.doc_ids = row["batch"], row["doc_ids"]
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.tokens = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint8).reshape(4, -1).T.copy().reshape(-1).view(np.int32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        self._grams = {1: self.words[self.tokens]}

    def history(self, order: int) -> np.ndarray:
        """At each token, the hash of the order - 1 tokens before it."""
        before = self.grams(order - 1)
        out = np.empty_like(before)
        out[1:] = before[:-1]
        start = np.array([START])
        for _ in range(order - 2):
            start = join_hash(start, np.array([START]))
        out[self.first] = start
        return out

    def grams(self, order: int) -> np.ndarray:
        if order not in self._grams:
            self._grams[order] = join_hash(self.history(order), self._grams[1])
        return self._grams[order]


def _sliced(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Sorted keys by their leading bits."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, compressed: high bytes are mostly alike."""
    return _ZIP.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_UNZIP.decompress(packed), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_REQUEST = pa.schema([("batch", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
REQUEST = "batch bigint, `order` int, bucket int, keys binary, a binary, b binary, c binary"
_ANSWER = pa.schema([("batch", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def count_requests(packed: DataFrame, order: int, bits: int) -> DataFrame:
    """Of each batch and order the different n-grams, and their counts in training documents (a)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                batch = Batch(part.slice(i, 1).to_pylist()[0])
                for k in range(1, order + 1):
                    keys, at = np.unique(batch.grams(k), return_inverse=True)
                    n = np.bincount(at, weights=batch.train, minlength=len(keys)).astype(np.uint32)
                    for j, s in _sliced(keys, bits):
                        yield _rows([(batch.number, k, j, pack_keys(keys[s]), pack(n[s]), None, None)], _REQUEST)

    return packed.mapInArrow(run, REQUEST)


def _merge(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each row's keys, all different keys, and the place among these of every key of every row in turn."""
    each = [unpack_keys(x.as_py()) for x in table.column("keys")]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    return each, keys, at


def answer_counts(table: pa.Table) -> pa.Table:
    """To each batch its n-grams' total counts (a) and which of them it speaks for (b); in a row of batch -1 the bucket's own table: its
    n-grams (a) and counts (b)."""
    order = np.argsort(table.column("batch").to_numpy())
    table = table.take(pa.array(order))
    each, keys, at = _merge(table)
    mine = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("a")])
    total = np.bincount(at, weights=mine, minlength=len(keys)).astype(np.int64)
    speaks = np.zeros(len(at), dtype=bool)
    have = np.flatnonzero(mine)
    speaks[have[np.unique(at[have], return_index=True)[1]]] = True
    k, bucket = table.column("order")[0].as_py(), table.column("bucket")[0].as_py()
    seen = total > 0
    rows, start = [(-1, k, bucket, pack_keys(keys[seen]), pack(total[seen].astype(np.uint32)))], 0
    for number, own in zip(table.column("batch").to_pylist(), each):
        s = slice(start, start + len(own))
        rows.append((number, k, bucket, pack(total[at[s]].astype(np.uint32)), pack(np.packbits(speaks[s]))))
        start += len(own)
    return pa.Table.from_batches([_rows(rows, _ANSWER)])


def answer_backoff(table: pa.Table) -> pa.Table:
    """Of each history the sums over the words seen after it: counts (a), discounted counts (b), lower-order probabilities (c). The
    answer: the backoff weight (a) and the count to divide by (b), zero for a history without words."""
    each, keys, at = _merge(table)
    total, kept, lower = (np.bincount(at, weights=np.concatenate([unpack(x.as_py(), np.float64) for x in table.column(c)]), minlength=len(keys)) for c in "abc")
    divisor = np.where(kept >= total - 1e-9 * total, total + 1, total)  # nothing discounted: one more count makes room
    weight = np.where(total > 0, (1 - kept / np.maximum(divisor, 1)) / np.maximum(1 - lower, 1e-12), 1.0)
    divisor = np.where(total > 0, divisor, 0.0)
    rows, start = [], 0
    for number, k, bucket, own in zip(table.column("batch").to_pylist(), table.column("order").to_pylist(), table.column("bucket").to_pylist(), each):
        s = at[start : start + len(own)]
        rows.append((number, k, bucket, pack(weight[s]), pack(divisor[s])))
        start += len(own)
    return pa.Table.from_batches([_rows(rows, _ANSWER)])


def discounts(times: np.ndarray) -> np.ndarray:
    """times[r]: how many n-grams have count r. The factor for each count up to DISCOUNTED (index 0: unused)."""
    n = times.astype(float)
    for most in range(DISCOUNTED, 0, -1):
        if n[1] == 0 or (n[1 : most + 1] == 0).any():
            continue
        tail = (most + 1) * n[most + 1] / n[1]
        r = np.arange(1, most + 1)
        if tail < 1:
            d = ((r + 1) * n[2 : most + 2] / n[1 : most + 1] / r - tail) / (1 - tail)
            if ((d > 0) & (d <= 1)).all():
                return np.concatenate([[1.0], d, np.ones(DISCOUNTED - most)])
    # The counts of counts are too irregular for Good-Turing.
    r = np.arange(1, DISCOUNTED + 1)
    return np.concatenate([[1.0], (r - 0.5) / r])


def _token_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x.as_py(), np.int64).sum()) for x in part.column(0)], pa.int64())], names=["n"])


class Scorer:
    """Probabilities of a batch's tokens, order by order, from the answers it got."""

    def __init__(self, batch: Batch, answers: pa.Table, model: dict, bits: int) -> None:
        self.batch, self.model, self.bits = batch, model, bits
        self.parts: dict[tuple[int, int], dict[int, tuple[bytes, bytes]]] = {}
        for r in answers.to_pylist():
            self.parts.setdefault((r["order"], 0), {})[r["bucket"]] = (r["a"], r["b"])

    def counts(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different n-grams' totals, whether this batch speaks for each, the place of each token's one, and a token of each."""
        keys, first, at = np.unique(self.batch.grams(order), return_index=True, return_inverse=True)
        found, speaks, total = self.parts[order, 0], np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        for j, s in _sliced(keys, self.bits):
            total[s] = unpack(found[j][0], np.uint32)
            speaks[s] = np.unpackbits(unpack(found[j][1], np.uint8), count=s.stop - s.start)
        return total, speaks, at, first

    def first_order(self) -> tuple[np.ndarray, np.ndarray]:
        """Each token's probability, and its count in training."""
        total, _, at, _ = self.counts(1)
        kept = total * self.factor(1, total)
        p = np.where(total > 0, kept / max(self.model["divisor"], 1), self.model["unknown"])
        return p[at], total[at]

    def factor(self, order: int, total: np.ndarray) -> np.ndarray:
        d = self.model["discounts"][order]
        return np.where(total <= DISCOUNTED, d[np.minimum(total, DISCOUNTED).astype(int)], 1.0)

    def sums(self, order: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """This batch's histories (sorted), and for each the sums over the n-grams that it speaks for."""
        total, speaks, _, first = self.counts(order)
        keys, at = np.unique(self.batch.history(order), return_inverse=True)
        mine, of = np.flatnonzero(speaks), at[first[speaks]]
        n = total[mine]
        add = lambda w: np.bincount(of, weights=w, minlength=len(keys))
        return keys, add(n), add(n * self.factor(order, n)), add(lower[first[mine]])

    def higher_order(self, order: int, lower: np.ndarray) -> np.ndarray:
        total, _, at, _ = self.counts(order)
        keys, of = np.unique(self.batch.history(order), return_inverse=True)
        weight, divisor = np.zeros(len(keys)), np.zeros(len(keys))
        for j, s in _sliced(keys, self.bits):
            weight[s], divisor[s] = (unpack(x, np.float64) for x in self.parts[-order, 0][j])
        n, weight, divisor = total[at], weight[of], divisor[of]
        seen = n > 0
        return np.where(seen, n * self.factor(order, n) / np.where(seen, divisor, 1), np.where(divisor > 0, weight * lower, lower))


def score(docs: DataFrame, order: int = 2, batch_tokens: int = 2_500_000, bucket_keys: int = 500_000) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    space = Workspace(docs.sparkSession)
    packed = space.save(batches(docs, batch_tokens), "batches")
    # The lengths of the documents, 8 bytes each, are the only thing that has to be read for the number of tokens.
    tokens = packed.select("lengths").mapInArrow(_token_counts, "n bigint").agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(tokens, 1) / bucket_keys))))

    asked = count_requests(packed, order, bits)
    counted = space.save(asked.groupBy("order", "bucket").applyInArrow(lambda t: answer_counts(t), ANSWER), "counts")
    del asked
    release(docs.sparkSession)
    tables = counted.where("batch = -1")
    answers = counted.where("batch >= 0")
    # Of each order: the tokens, the different n-grams, and how many have count 1, 2, ..., a few numbers from each bucket.

    def census(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                n = unpack(r["b"], np.uint32)
                yield _rows([(r["order"], 0, int(n.sum())), (r["order"], -1, len(n)), *((r["order"], i, int((n == i).sum())) for i in range(1, DISCOUNTED + 2))], pa.schema([("order", pa.int32()), ("what", pa.int32()), ("n", pa.int64())]))

    found = {(r["order"], r["what"]): r["n"] for r in tables.select("order", "b").mapInArrow(census, "`order` int, what int, n bigint").groupBy("order", "what").agg(F.sum("n").alias("n")).collect()}
    times = {k: np.array([found.get((k, r), 0) if r else 0 for r in range(DISCOUNTED + 2)]) for k in range(1, order + 1)}
    n, v = found.get((1, 0), 0), found.get((1, -1), 0)
    model: dict = {"discounts": {k: discounts(t) for k, t in times.items()}, "n": n, "v": v}
    freed = sum((1 - model["discounts"][1][r]) * r * int(times[1][r]) for r in range(1, DISCOUNTED + 1))
    model["divisor"] = n if freed > 0 else n + 1
    model["unknown"] = (freed / n if freed > 0 else 1 / (n + 1)) if n else 1.0

    def ask(k: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            batch = Batch(left.to_pylist()[0])
            scorer = Scorer(batch, right, model, bits)
            p = scorer.first_order()[0]
            for j in range(2, k):
                p = scorer.higher_order(j, p)
            keys, *sums = scorer.sums(k, p)
            return pa.Table.from_batches([_rows([(batch.number, -k, j, pack_keys(keys[s]), *(pack(x[s]) for x in sums)) for j, s in _sliced(keys, bits)], _REQUEST)])

        return run

    for k in range(2, order + 1):
        asked = packed.groupBy("batch").cogroup(answers.where(F.col("order") <= k).groupBy("batch")).applyInArrow(ask(k), REQUEST)
        answers = answers.unionByName(space.save(asked.groupBy("order", "bucket").applyInArrow(lambda t: answer_backoff(t), ANSWER), f"backoff{k}"))
        del asked
        release(docs.sparkSession)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left.to_pylist()[0])
        scorer = Scorer(batch, right, model, bits)
        p, count = scorer.first_order()
        for k in range(2, order + 1):
            p = scorer.higher_order(k, p)
        add = lambda x: np.add.reduceat(x, batch.first)
        columns = [batch.doc_ids, batch.held, batch.lengths, add((count > 0).astype(np.int64)), np.full(len(batch.lengths), n), add(np.log10((count + 1) / (n + v + 1))), add(np.log10(p))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    scored = packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    scored = cut(scored)
    space.drop()
    return scored
