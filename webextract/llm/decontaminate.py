"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the weights of TF-IDF.
2. A distributed randomised SVD of the benchmark's TF-IDF passages (power iterations on the Gram matrix, each a pass over the passages)
   gives the latent space; it is fitted on all items of a block of the benchmark, and every item is indexed in it.
3. Every document is cut into windows of 32, 64 and 128 words at every 16th one. A window's cosine with an item is taken in the latent
   space, over the window's whole norm, and is held against the least cosine times what the space holds of the item's norm: a copy of the
   item has no larger one. A window whose share of weight on the items' words is below the square of the least cosine isn't
   projected: only words that repeat in it could lift it to that.
   Words that are in very many documents weigh nothing there, so neighbouring words are looked up exactly as well, without weights: where a
   document has as many of an item's word pairs, close together, as must be left when only replaced or dropped words lower the common
   subsequence to its limit, it is a candidate too. So passages with such edits are found however often they were copied.
4. Candidates are verified on the words around the window: the answer check (the item's rarest words, on which an answer turns, must be
   there), then the longest common subsequence with the item, over the item's length.

The benchmark is the stated query set: it is read in blocks of at most block_items items on average (by hash of item_id), as many scans
as its size needs. Only the blocks of one scan are on the driver and in closures.

Defined results. Words are in lower case (A-Z), without the marks .,;:!?"()[]. Null or empty texts match nothing; items with fewer than
min_words words are too short to tell and match nothing. Repeated rows come out repeatedly; null ids come out as such. Empty tables give
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from webextract.llm.common import Workspace, cut, text_of

BUCKETS = 1 << 18
CHUNKS = 64
STEP, WINDOWS = 16, (2, 4, 8)
MARKS = b'.,;:!?"()[]'


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.42
    lcs: float = 0.7
    answer: float = 0.5
    min_words: int = 5
    #: Of an item's different words, the share that counts as the rarest.
    rare: float = 0.34
    #: As many as a block has items on average, so that the space holds nearly all of each.
    dimensions: int = 256
    block_items: int = 256


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(None, MARKS).split()


class Hasher:
    """Buckets of words, remembered up to a bound."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w) % BUCKETS
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def word_weights(docs: DataFrame) -> np.ndarray:
    """log(documents / documents with the bucket), for each bucket, over all documents; a bucket in no document gets the largest. What is in
    over an eighth of the documents (of few documents, more) weighs nothing: it tells no passage from another."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hasher(), np.zeros(BUCKETS + 1, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                total[np.unique(hashed(list(set(words_of(text.as_py())))))] += 1
                total[-1] += 1
        if total[-1]:
            cut = np.array_split(total, CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in cut])], names=["chunk", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("n"))
        return pa.table({"chunk": table.column("chunk")[:1], "n": pa.array([total.tobytes()])})

    found = docs.select(text_of(docs)).mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInArrow(lambda t: add(t), "chunk int, n binary").collect()
    if not found:
        return np.ones(BUCKETS, dtype=np.float32)
    total = np.concatenate([np.frombuffer(r["n"], np.int64) for r in sorted(found, key=lambda r: r["chunk"])])
    return weights_from(total[:-1], int(total[-1]))


def weights_from(times: np.ndarray, documents: int) -> np.ndarray:
    weight = np.log((documents + 1) / (times + 1))
    return np.where(weight > min(np.log(8), 0.3 * np.log(documents + 1)), weight, 0).astype(np.float32)


@dataclass
class Block:
    """Items, and their latent space."""

    ids: list
    words: list[list[bytes]]
    place: np.ndarray  # of each bucket among those of the items, or -1
    basis: np.ndarray  # (buckets of the items) x dimensions
    latent: np.ndarray  # items x dimensions, of length one
    share: np.ndarray  # of each item's squared norm that the space holds
    rare: list[set[bytes]]
    masks: list[dict[bytes, int]] = field(default_factory=list)
    #: Word pairs of the items, ascending (place of the first times the number of places, plus place of the second); the items of pair k
    #: are pair_items[pair_ends[k - 1] : pair_ends[k]].
    pairs: np.ndarray = field(init=False)
    pair_ends: np.ndarray = field(init=False)
    pair_items: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        hashed, size = Hasher(), len(self.basis)
        at = [self.place[hashed(words)].astype(np.int64) for words in self.words]
        owned = [np.unique(x[:-1] * size + x[1:]) for x in at]
        codes, items = np.concatenate(owned), np.repeat(np.arange(len(owned)), [len(x) for x in owned])
        order = np.argsort(codes, kind="stable")
        self.pairs, times = np.unique(codes, return_counts=True)
        self.pair_ends, self.pair_items = np.cumsum(times), items[order]
        for words in self.words:
            at: dict[bytes, int] = {}
            for i, w in enumerate(words):
                at[w] = at.get(w, 0) | 1 << i
            self.masks.append(at)


def common_subsequence(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of an item of n words and `words`, by bit vectors."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _tfidf(words: list[bytes], hashed: Hasher, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(hashed(words), return_counts=True)
    return at, n * weight[at]


def latent_basis(passages: DataFrame, weight: np.ndarray, place: np.ndarray, dimensions: int, seed: int = 0, power: int = 3) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix. passages: text. Each pass sums, over all passages, the outer products
    of a passage with its projection; the sums have one row for each bucket of the block's items."""
    size = int(place.max()) + 1
    width = min(dimensions + 8, size)

    def gram_times(matrix: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashed, total = Hasher(), np.zeros_like(matrix)
            for b in batches:
                for text in b.column(0).to_pylist():
                    at, x = _tfidf(words_of(text), hashed, weight)
                    x = x / max(float(np.linalg.norm(x)), 1e-9)
                    total[place[at]] += x[:, None] * (x @ matrix[place[at]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["z"])

        return sum(np.frombuffer(r["z"], matrix.dtype).reshape(matrix.shape) for r in passages.mapInArrow(run, "z binary").collect())

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(power):
        q = np.linalg.qr(gram_times(q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram_times(q))
    keep = np.argsort(-values)[:dimensions]
    return (q @ vectors[:, keep[values[keep] > 1e-9]]).astype(np.float32)


def pair_runs(buckets: np.ndarray, doc_of: np.ndarray, block: Block, limits: Limits) -> Iterator[tuple[int, int]]:
    """(place in buckets, item) wherever enough of an item's word pairs follow within twice its length, at every quarter of the item at most.

    buckets: of the words of several documents, in a row; doc_of: each word's document. A replaced or dropped word takes two pairs away.
    """
    at = block.place[buckets].astype(np.int64)
    both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (doc_of[:-1] == doc_of[1:]))
    codes = at[both] * len(block.basis) + at[both + 1]
    k = np.minimum(np.searchsorted(block.pairs, codes), len(block.pairs) - 1)
    same = block.pairs[k] == codes
    k, both = k[same], both[same]
    times = np.diff(block.pair_ends, prepend=0)[k]
    spot = np.repeat(both, times)
    item = block.pair_items[np.repeat(block.pair_ends[k] - np.cumsum(times), times) + np.arange(len(spot))]
    order = np.argsort(item * len(buckets) + spot)
    spot, item = spot[order], item[order]
    size = np.array([len(w) for w in block.words])
    least = np.maximum(size - 1 - 2 * np.floor((1 - limits.lcs) * size + 1e-9).astype(np.int64), 1)
    last = np.arange(len(spot)) + least[item] - 1
    inside = last < len(spot)
    spot_of, end, kind = spot[inside], last[inside], item[inside]
    good = (item[end] == kind) & (doc_of[spot[end]] == doc_of[spot_of]) & (spot[end] - spot_of <= 2 * size[kind])
    before = (-1, -1)
    for x, i in zip(spot_of[good].tolist(), kind[good].tolist()):
        if before[1] != i or x - before[0] > len(block.words[i]) // 4:
            before = (x, i)
            yield before


def index_block(items: DataFrame, weight: np.ndarray, limits: Limits) -> Block | None:
    """items: item_id, text."""
    rows = sorted(items.select("item_id", "text").collect(), key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"] or ""))
    rows = [(r["item_id"], w) for r in rows if len(w := words_of(r["text"])) >= limits.min_words]
    if not rows:
        return None
    hashed, place = Hasher(), np.full(BUCKETS, -1, dtype=np.int32)
    used = np.unique(np.concatenate([hashed(w) for _, w in rows]))
    place[used] = np.arange(len(used))
    long = items.where(F.length("text") >= 2 * limits.min_words - 1).select("text").where(F.col("text").isNotNull())
    basis = latent_basis(long.coalesce(4), np.where(place >= 0, weight, 0), np.maximum(place, 0), limits.dimensions)
    latent, rare = [], []
    for _, words in rows:
        at, x = _tfidf(words, hashed, weight)
        latent.append((x / max(float(np.linalg.norm(x)), 1e-9)) @ basis[place[at]])
        kinds = sorted(set(words), key=lambda w: (-weight[hashed([w])[0]], w))
        rare.append(set(kinds[: max(1, round(limits.rare * len(kinds)))]))
    vectors = np.array(latent)
    share = (vectors**2).sum(axis=1)
    return Block([i for i, _ in rows], [w for _, w in rows], place, basis, vectors / np.maximum(np.sqrt(share), 1e-9)[:, None], share, rare)


def find(docs: list[list[bytes]], hashed: Hasher, weight: np.ndarray, block: Block, limits: Limits) -> list[list[tuple]]:
    """For each document (its words) the items found in it: (item, cosine, LCS share, answer share)."""
    best: list[dict[int, tuple]] = [{} for _ in docs]
    some = [i for i, words in enumerate(docs) if words]
    if not some:
        return [[] for _ in docs]
    buckets = np.concatenate([hashed(docs[i]) for i in some])
    sizes = np.array([len(docs[i]) for i in some])
    firsts = np.cumsum(sizes) - sizes
    tried: set[tuple[int, int, int, int]] = set()

    def verify(doc: int, item: int, low: int, high: int, cosine: Callable[[], float]) -> None:
        """Looks for the item in the words from low to high of a document of `some`."""
        if (doc, item, low, high) in tried:
            return
        tried.add((doc, item, low, high))
        near_words = docs[some[doc]][max(low, 0) : high]
        answer = len(block.rare[item].intersection(near_words)) / len(block.rare[item])
        if answer < limits.answer:
            return
        size = len(block.words[item])
        lcs = common_subsequence(block.masks[item], size, near_words) / size
        if lcs >= limits.lcs:
            got, old = (cosine(), lcs, answer), best[some[doc]].get(item)
            if old is None or (got[1], got[0]) > (old[1], old[0]):
                best[some[doc]][item] = got

    for doc, item, low, high, cosine in near_windows(buckets, sizes, firsts, weight, block, limits):
        verify(doc, item, low - len(block.words[item]), high + len(block.words[item]), lambda: cosine)
    doc_of = np.repeat(np.arange(len(some)), sizes)
    for x, item in pair_runs(buckets, doc_of, block, limits):
        doc, size = int(doc_of[x]), len(block.words[item])
        if item not in best[some[doc]]:
            at = x - int(firsts[doc])
            verify(doc, item, at - size, at + 2 * size + 2, lambda: passage_cosine(buckets[x : int(min(x + size, firsts[doc] + sizes[doc]))], weight, block, item))
    return [[(block.ids[i], *x) for i, x in sorted(found.items())] for found in best]


def passage_cosine(buckets: np.ndarray, weight: np.ndarray, block: Block, item: int) -> float:
    """Cosine of some words with an item in the latent space, over the words' whole norm; 0 where they weigh nothing."""
    kinds, n = np.unique(buckets, return_counts=True)
    x = n * weight[kinds]
    own = block.place[kinds] >= 0
    return float((x[own] @ block.basis[block.place[kinds[own]]]) @ block.latent[item] / max(float(np.linalg.norm(x)), 1e-9))


def near_windows(buckets: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, weight: np.ndarray, block: Block, limits: Limits) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, item, first word, word after the last, cosine) of the windows near an item in the latent space."""
    # Steps of up to 16 words; a document's last one may be shorter.
    steps = -(-sizes // STEP)
    of_doc = np.repeat(np.arange(len(sizes)), steps)
    stop = np.repeat(np.cumsum(steps), steps)  # the step after the document's last one
    inner = np.arange(len(of_doc)) - np.repeat(np.cumsum(steps) - steps, steps)
    starts = firsts[of_doc] + inner * STEP
    w = weight[buckets]
    at = np.where(w > 0, block.place[buckets], -1)
    squares = w.astype(np.float64) ** 2
    running = lambda x: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    energy, on_items = running(np.add.reduceat(squares, starts)), running(np.add.reduceat(np.where(at >= 0, squares, 0), starts))
    least = limits.cosine * np.sqrt(block.share)
    chosen, cover = [], np.zeros(len(starts) + 1, dtype=np.int64)
    for n in WINDOWS:
        ends = np.minimum(np.arange(len(starts)) + n, stop)
        whole = energy[ends] - energy[:-1]
        c = np.flatnonzero((whole > 1e-9) & (on_items[ends] - on_items[:-1] >= limits.cosine**2 * whole))
        chosen.append((c, ends[c], whole[c]))
        np.add.at(cover, c, 1)
        np.add.at(cover, ends[c], -1)
    needed = np.cumsum(cover[:-1]) > 0
    if not needed.any():
        return
    place = np.cumsum(needed) - needed  # of a needed step among the needed ones; a window's steps are all needed
    place = np.append(place, needed.sum())
    step_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(buckets))))
    tokens = np.flatnonzero(needed[step_of] & (at >= 0))
    rows = place[step_of[tokens]]
    edges = np.flatnonzero(np.diff(rows, prepend=-1))
    projected = np.zeros((int(needed.sum()), block.basis.shape[1]))
    projected[rows[edges]] = np.add.reduceat(block.basis[at[tokens]] * w[tokens, None], edges, axis=0)
    projected = running(projected)
    for c, ends, whole in chosen:
        u = projected[np.where(ends > 0, place[ends - 1] + 1, 0)] - projected[place[c]]
        near = np.linalg.norm(u, axis=1) >= least.min() * np.sqrt(whole)
        c, ends, u = c[near], ends[near], u[near]
        if not len(c):
            continue
        last = np.append(starts, len(buckets))[ends]
        # Repeated words weigh by their number; only windows that come this far are counted out.
        norm = np.array([np.linalg.norm(k * weight[kinds]) for kinds, k in (np.unique(buckets[x:y], return_counts=True) for x, y in zip(starts[c].tolist(), last.tolist()))])
        cosine = (u @ block.latent.T) / norm[:, None]
        for i, item in np.argwhere((cosine >= least) & (block.share > 1e-6)).tolist():
            doc = int(of_doc[c[i]])
            yield doc, item, int(starts[c[i]] - firsts[doc]), int(last[i] - firsts[doc]), float(cosine[i, item])


def groups_of_blocks(docs: DataFrame, benchmark: DataFrame, limits: Limits, blocks_per_scan: int) -> Iterator[tuple[np.ndarray, list[Block]]]:
    """The words' weights, and the blocks of one scan after another; a group is built when the one before it has been scanned."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    n = items.count()
    many = -(-n // limits.block_items)
    weight = word_weights(docs) if n else None
    for first in range(0, many, blocks_per_scan):
        blocks = [index_block(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == i), weight, limits) for i in range(first, min(first + blocks_per_scan, many))]
        yield weight, [b for b in blocks if b]


def _scan(docs: DataFrame, weight: np.ndarray, blocks: list[Block], limits: Limits, emit: Callable, schema: str) -> DataFrame:
    """emit(batch, hits of each row) for every batch of docs, whose last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for batch in batches:
            hits: list[list[tuple]] = []
            for i in range(0, len(batch), 200):
                docs_words = [words_of(t.as_py()) for t in batch.column(batch.num_columns - 1)[i : i + 200]]
                found = [find(docs_words, hashed, weight, b, limits) for b in blocks]
                hits.extend([x for f in found for x in f[k]] for k in range(len(docs_words)))
            yield emit(batch, hits)

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), blocks_per_scan: int = 8) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, item_id, cosine, lcs, answer for every item found in a document. What
    the scans but the last one find is written before the next group of blocks is built."""
    fields = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = ", ".join([*(f"{k} {t.simpleString()}" for k, t in fields.items()), "cosine double", "lcs double", "answer double"])
    item_type = to_arrow_type(fields["item_id"])

    def emit(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        at = [i for i, h in enumerate(hits) for _ in h]
        items = list(zip(*(x for h in hits for x in h))) or [[]] * 4
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items[0], item_type), *(pa.array(c, pa.float64()) for c in items[1:])], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    source, found, last = docs.select("doc_id", text_of(docs).alias("text")), [], None
    for weight, blocks in groups_of_blocks(docs, benchmark, limits, blocks_per_scan):
        if last is not None:
            found.append(cut(last))
        last = _scan(source, weight, blocks, limits, emit, schema)
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [*found, last])


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), blocks_per_scan: int = 8) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found. What the scans but the last one leave is written in between."""
    names, space = docs.columns, Workspace(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def emit(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        clean = batch.filter(pa.array([not h for h in hits], pa.bool_()))
        return pa.RecordBatch.from_arrays(clean.columns[:-1], names=names)

    every, last = docs, None
    for i, (weight, blocks) in enumerate(groups_of_blocks(every, benchmark, limits, blocks_per_scan)):
        if last is not None:
            docs = space.save(last, f"left{i}")
        last = _scan(docs.select("*", text_of(docs).alias("__text")), weight, blocks, limits, emit, schema)
    return docs if last is None else last
