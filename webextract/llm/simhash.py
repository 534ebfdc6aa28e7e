"""SimHash near-duplicates, with pigeonring filtering of the candidate pairs.

A text's fingerprint has a bit where more than half of its shingles' hashes have it. A fingerprint is cut into four segments of 16 bits on
a ring. If two fingerprints differ in at most 3 bits, some segment starts a chain of consecutive segments whose cumulative differences
stay within the proportional budgets 0, 1, 2, 3 (three quarters of a bit a segment, rounded down). So that segment is equal, of the two
halves of the next one, which may hold one difference, one is equal, of the three parts of the third one is, and of the four of the last.
Candidates meet under keys of the first two segments of a chain, 24 bits in eight ways, and of three or four segments, up to 33 bits, where
there are more fingerprints. The rest of the chain is checked on every candidate before the full Hamming distance.

Equal fingerprints are one before any pair is made, so groups of copies cost nothing. A key with very many different fingerprints does
not give all its pairs (see components.bucket_links).

Defined results. Null and empty texts, and texts of white space, have fingerprint zero and link to each other. Fewer words than a shingle:
the whole sequence is the shingle. Repeated rows come out repeatedly. Null doc_ids come out with their fingerprint; component_id is the
least doc_id that isn't null. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webextract.llm.common import Workspace, cut, maybe_among, release, text_of
from webextract.llm.components import bucket_links, collisions, connected_components, small_pairs

SEGMENTS, WIDTH = 4, 16
#: The most differing bits that a chain of 1, 2, 3 and 4 segments may have.
BUDGETS = (0, 1, 2, 3)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, size: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of `size` words, joined by spaces."""
    words = text.encode().lower().split()
    if not words:
        return []
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(whole, seed)]
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(whole)]
    return [h(whole[a:b], seed) for a, b in zip(starts, ends[size - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes (uint64) have."""
    if not len(hashes):
        return 0
    columns = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another hash function's values of the same shingles; lane 0 is the hash itself."""
    if not lane:
        return hashes
    x = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """doc_id, f0: the fingerprint (bigint)."""
    source = docs.select("doc_id", text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [majority(np.array(shingle_hashes(text.as_py(), shingle, seed), dtype=np.uint64)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "f0"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, f0 bigint")


def _segment(f: Column, i: int) -> Column:
    return F.shiftrightunsigned(f, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


#: Into how many parts the segments of a chain are cut after the first one: one more than the differences that they may have.
PARTS = ((16,), (8, 8), (6, 5, 5), (4, 4, 4, 4))


def keys(f: Column, depth: int = 2) -> Column:
    """The keys of a fingerprint: a segment, and of each of the depth - 1 segments after it one part. 2, 3 and 4 segments give 8, 24 and 96
    keys of 24, 29 and 33 bits. Two fingerprints whose chain holds share one at any depth."""
    out = []
    for i in range(SEGMENTS):
        for which, parts in enumerate(product(*(range(len(PARTS[k])) for k in range(1, depth)))):
            bits = _segment(f, i)
            for k, part in enumerate(parts, 1):
                at, width = sum(PARTS[k][:part]), PARTS[k][part]
                bits = F.shiftleft(bits, width) + F.shiftrightunsigned(_segment(f, i + k), at).bitwiseAND(F.lit((1 << width) - 1))
            out.append(F.lit((96 * i + which) << 40).cast("long") + bits)
    return F.array(*out)


#: The place of the lane, and of the number of segments, in a bucket of near_duplicates(); below it is a key of keys().
LANE, DEPTH = 50, 54


def ring_buckets(fs: str, depth: int) -> Column:
    """The buckets of a text's fingerprints, one a lane, with the fingerprint: array of (bucket, f). No bucket is negative."""
    return F.flatten(F.transform(fs, lambda f, lane: F.transform(keys(f, depth), lambda key: F.struct((F.shiftleft(lane.cast("long"), LANE) + F.lit(depth << DEPTH) + key).alias("bucket"), f.alias("f")))))


def longer(bucket: Column, f: Column, depth: int) -> Column:
    """The buckets with one segment more, of those that begin as this one of ring_buckets() does."""
    way, bits = F.shiftright(bucket, 40).bitwiseAND(F.lit(0x1FF)), bucket.bitwiseAND(F.lit((1 << 40) - 1))
    shift = (F.pmod(F.floor(way / 96) + depth, F.lit(SEGMENTS)) * WIDTH).cast("int")
    segment = F.call_function("shiftrightunsigned", f, shift).bitwiseAND(F.lit(0xFFFF))
    head, which, out = F.shiftleft(F.shiftright(bucket, LANE) + F.lit(1 << DEPTH - LANE), LANE), way % 96, []
    for part, width in enumerate(PARTS[depth]):
        at = sum(PARTS[depth][:part])
        key = F.shiftleft(bits, width) + F.shiftrightunsigned(segment, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(head + F.shiftleft(way - which + which * len(PARTS[depth]) + part, 40) + key)
    return F.array(*out)


#: With more texts, large buckets are parted by longer keys. With fewer, few unlike texts share a short key, and parting would only write the
#: members of groups of near copies up to 12 times.
MANY = 1 << 19


def parted(met: DataFrame, space: Workspace, depth: int, large: int) -> DataFrame:
    """met: (bucket, id, f, n) from collisions() of ring_buckets() and others, which are negative. Ring buckets of more than `large` members are
    parted by the next segments of their chains, as long as there are any.

    The number of unlike fingerprints that share a short key grows with the square of the corpus; once such buckets are large, they chain most
    texts into one crowd. Two fingerprints whose chain holds still share a bucket.
    """
    crowded = (F.col("bucket") >= 0) & (F.col("n") > large)
    parts = [met.where(~crowded)]
    for d in range(depth, SEGMENTS):
        met = collisions(met.where(crowded).select(F.explode(longer(F.col("bucket"), F.col("f"), d)).alias("bucket"), "id", "f"), space, f"collisions-{d + 1}")
        parts.append(met if d == SEGMENTS - 1 else met.where(~crowded))
    return reduce(DataFrame.unionByName, parts)


def depth_for(fingerprints: int) -> int:
    """How many segments the keys have, so that unlike fingerprints seldom share one, whatever their number."""
    return 2 + (fingerprints > 1 << 25) + (fingerprints > 1 << 30)


def within_ring(a: Column, b: Column, bits: int = 3) -> Column:
    """Some segment starts a chain within the budgets; then the full distance."""
    x = a.bitwiseXOR(b)
    apart = [F.bit_count(_segment(x, i)) for i in range(SEGMENTS)]
    chains = []
    for i in range(SEGMENTS):
        total, holds = F.lit(0), []
        for step, budget in enumerate(BUDGETS[:-1]):
            total = total + apart[(i + step) % SEGMENTS]
            holds.append(total <= budget)
        chains.append(reduce(Column.__and__, holds))
    return reduce(Column.__or__, chains) & (F.bit_count(x) <= bits)


def fingerprint_links(distinct: DataFrame, space: Workspace, large: int = 128) -> DataFrame:
    """distinct: (f, weight). Links (a, b) that join every two fingerprints at most 3 bits apart that all links would join."""
    members = distinct.select(F.explode(keys(F.col("f"), depth_for(distinct.count()))).alias("bucket"), F.col("f").alias("id"))
    weights = distinct.select(F.col("f").alias("id"), "weight")
    return bucket_links(collisions(members, space), weights, lambda pairs: pairs.where(within_ring(F.col("a"), F.col("b"))), large)


def simhash_components(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fingerprint, component_id."""
    rows = cut(fingerprints(docs, shingle, seed))
    distinct = cut(rows.groupBy("f0").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least")).withColumnRenamed("f0", "f"))
    space = Workspace(docs.sparkSession)
    roots = connected_components(fingerprint_links(distinct, space))
    space.drop()
    classes = cut(distinct.join(roots, distinct["f"] == roots["id"], "left").select("f", F.coalesce("root", "f").alias("root"), "least"))
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    # Joined by fingerprint; the fingerprint of a large group of copies is split by the adaptive skew join.
    named = cut(classes.join(least, "root").select("f", "component_id"))
    return rows.join(named, rows["f0"] == named["f"]).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def near_prints(docs: DataFrame, lanes: int, words: int, minhash: MinHash) -> DataFrame:
    """doc_id, text_hash, fs (fingerprints over the text's different words, a lane each), bands (keys of samples of its shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, len(b), 2000)):
            fs, bands = [], []
            for text in batch.column(2):
                text = text.as_py()
                single = np.unique(np.array(shingle_hashes(text, 1), dtype=np.uint64))
                fs.append([majority(_mixed(single, i)) for i in range(lanes)])
                bands.append(minhash(np.array(shingle_hashes(text, words), dtype=np.uint64)) if len(single) else [0] * minhash.bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fs", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, fs array<bigint>, bands array<bigint>")


def near_duplicates(docs: DataFrame, lanes: int = 4, words: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """Classes of texts whose shingles of `words` words have a Jaccard similarity of `similarity` or more, or that are linked by such.

    Candidates come from two kinds of fingerprints. Those over all different words of a text, in several lanes (hash functions), meet in
    the ring index at 3 or fewer differing bits, as texts with a few scattered edits do. Where one text is the other one and a block more,
    many words are new and 3 bits are too tight; so there are fingerprints of small samples too, of the shingles that are least under
    some hash functions: they agree just where the samples do, whichever way the texts differ, and so many are taken that a pair at the
    limit has a chance of `recall` to agree in one. Every candidate is verified by the exact Jaccard similarity of the whole texts. Returns
    doc_id, text_hash, component_id; equal texts are one before pairs are made.
    """
    work = docs.select("doc_id", text_of(docs).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    minhash = MinHash(*tune_bands(similarity, recall))
    rows = cut(near_prints(work, lanes, words, minhash))
    texts = cut(rows.groupBy("text_hash").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.first("fs").alias("fs"), F.first("bands").alias("bands")))
    depth = depth_for(texts.count())
    # Buckets of samples are negative; under them there is no fingerprint to compare.
    samples = F.transform(F.array_distinct("bands"), lambda band: F.struct(band.bitwiseOR(F.lit(-1 << 63)).alias("bucket"), F.lit(0).cast("long").alias("f")))
    members = texts.select(F.explode(F.concat(ring_buckets("fs", depth), samples)).alias("m"), F.col("text_hash").alias("id")).select("m.bucket", "id", "m.f")

    space = Workspace(docs.sparkSession)
    met = collisions(members, space)
    if texts.count() > MANY:
        met = parted(met, space, depth, large=4)
    release(docs.sparkSession)
    few = cut(small_pairs(met, 4, within_ring))

    def make_sets(ids: DataFrame) -> DataFrame:
        wanted = ids.select(F.col("id").alias("text_hash"))
        reps = maybe_among(work.select("text_hash", "text"), wanted, "text_hash").join(wanted, "text_hash")
        return space.save(shingle_sets(reps.groupBy("text_hash").agg(F.first("text").alias("text")), words), "sets")

    def near(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("text_hash").alias(c), F.col("fs").alias(f"f{c}"), F.col("bands").alias(f"m{c}"))
        ring = F.exists(F.zip_with("fa", "fb", lambda a, b: within_ring(a, b)), lambda x: x)
        return pairs.join(side("a"), "a").join(side("b"), "b").where(ring | F.arrays_overlap("ma", "mb")).select("a", "b")

    weights = texts.select(F.col("text_hash").alias("id"), "weight")
    roots = connected_components(set_links(met, weights, make_sets, similarity, near, large=4, few=few))
    classes = cut(texts.join(roots, texts["text_hash"] == roots["id"], "left").select("text_hash", F.coalesce("root", "text_hash").alias("root"), "least"))
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(classes.join(least.hint("merge"), "root").select("text_hash", "component_id"))
    out = cut(rows.select("doc_id", "text_hash").join(named.hint("merge"), "text_hash"))
    space.drop()
    return out


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """text_hash, text to text_hash, set: the distinct hashes of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some hundred sets at a time, as they are larger than the texts.
        for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), words), dtype=np.uint64)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["text_hash", "set"])

    return texts.select("text_hash", "text").mapInArrow(run, "text_hash bigint, `set` array<bigint>")


class MinHash:
    """Keys of bands of least hashes; sets whose Jaccard similarity is s share a band's key with a chance of s to the power rows."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.c = draw.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> list[int]:
        """One key for each band; different bands have different keys."""
        least = (hashes[:, None] * self.a + self.b).min(axis=0).reshape(self.bands, self.rows)
        keys = ((least ^ (least >> np.uint64(29))) * self.c).sum(axis=1, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.bands, dtype=np.uint64)
        return keys.view(np.int64).tolist()


def tune_bands(similarity: float, recall: float, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows that find a pair at `similarity` with a chance of `recall`. Fewer rows need fewer
    bands but admit more unlike pairs."""
    return int(np.ceil(np.log(1 - recall) / np.log1p(-(similarity**rows)))), rows


def set_links(
    met: DataFrame, weights: DataFrame, make_sets: Callable[[DataFrame], DataFrame], similarity: float, prefilter: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, large: int = 16, few: DataFrame | None = None
) -> DataFrame:
    """Links among the members of buckets whose shingle sets have the similarity or more, by the sets' exact sizes.

    make_sets: from (id) to (text_hash, set), called once with the ids of the pairs that pass the prefilter and of the crowded buckets. few: such
    pairs of the smaller buckets, where the caller has them.
    Crowds that even leaders don't join, of members alike enough to meet and unlike enough not to link, are compared tile by tile.
    """
    few = cut(prefilter(small_pairs(met, large))) if few is None else few
    ids = few.select(F.col("a").alias("id")).union(few.select("b")).union(met.where(F.col("n") > large).select("id")).distinct()
    sets = make_sets(cut(ids))

    def exact(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("text_hash").alias(c), F.col("set").alias(f"s{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    return bucket_links(met, weights, lambda pairs: exact(pairs if pairs is few else prefilter(pairs)), large, crowd=lambda left: crowd_links(left, sets, similarity), few=few)


#: Members of a crowd whose sets are compared in one task: two tiles of so many at most.
TILE = 512
#: A larger crowd is first parted by longer bands.
CROWD = 32 * TILE


def crowd_links(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """left: (bucket, id, root). Links (a, b) by exact similarity that join what all links within the buckets, across roots, would join.

    A bucket is cut into tiles by a hash of id, and every two tiles meet in a task that multiplies their members' shingle matrices and gives
    a spanning forest of the links, one fewer than its members at most. A crowd of over CROWD members is parted first, so that a member isn't
    sent to a number of tiles that grows with the corpus, by its rarest shingles: of two sets with the similarity at least one shingle is
    among those that remain of each when the share `similarity` of it, the commonest ones, is left out. So no link is lost.
    """
    sizes = cut(left.groupBy("bucket").agg(F.count("*").alias("n")))
    sized = cut(left.join(sizes.hint("merge"), "bucket"))
    huge = sized.where(F.col("n") > CROWD).select("bucket", "id", "root")
    if not huge.isEmpty():
        wide = cut(sets.join(huge, sets["text_hash"] == huge["id"]).select("bucket", "id", "root", F.size("set").alias("size"), F.explode("set").alias("s")))
        times = cut(wide.groupBy("bucket", "s").agg(F.count("*").alias("times")))
        rank = F.row_number().over(Window.partitionBy("bucket", "id").orderBy("times", "s"))
        rare = wide.join(times.hint("merge"), ["bucket", "s"]).withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
        parted = cut(rare.select(F.xxhash64("bucket", "s").alias("bucket"), "id", "root"))
        counts = cut(parted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket", "n"))
        sized = sized.where(F.col("n") <= CROWD).unionByName(parted.join(counts.hint("merge"), "bucket").select("bucket", "id", "root", "n"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = sized.withColumn("k", tiles).withColumn("t", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    dealt = own.select("bucket", "id", "root", "t", other).select("bucket", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "id", "root", "t")
    full = dealt.join(sets.select(F.col("text_hash").alias("id"), "set"), "id")
    return full.groupBy("bucket", "lo", "hi").applyInArrow(lambda table: tile_links(table, similarity), "a bigint, b bigint").distinct()


def tile_links(table: pa.Table, similarity: float, columns: int = 2048) -> pa.Table:
    """The members of one tile, or of two, to a spanning forest of their links across roots."""
    ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
    lists = table.column("set").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    kinds, at, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), sizes)
    shared = times[at] > 1  # what one member has alone is in no intersection
    place = np.cumsum(times > 1) - 1
    row, column = row[shared], place[at[shared]]
    common = np.zeros((len(ids), len(ids)), dtype=np.float32)
    for first in range(0, int((times > 1).sum()), columns):
        inside = (column >= first) & (column < first + columns)
        part = np.zeros((len(ids), columns), dtype=np.float32)
        part[row[inside], column[inside] - first] = 1
        used = part.any(axis=1)
        common[np.ix_(used, used)] += part[used] @ part[used].T
    parent = {int(r): int(r) for r in roots}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for begin in range(0, len(ids), 128):
        part = common[begin : begin + 128]
        linked = part >= similarity * (sizes[begin : begin + 128, None] + sizes[None, :] - part) - 1e-4
        linked &= roots[begin : begin + 128, None] != roots[None, :]
        for i, j in np.argwhere(linked).tolist():
            i += begin
            x, y = top(int(roots[i])), top(int(roots[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs without all rows but one of each class. classes: doc_id, text_hash, component_id, as near_duplicates() gives them.

    The row with the least doc_id stays (a null doc_id only in a class of nulls), of equal ones that with the least text hash, of equal
    rows one. Only groups of equal (doc_id, text) meet in a shuffle with their texts.
    """
    best = classes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    copies = classes.groupBy("doc_id", "text_hash").agg(F.count("*").alias("__n"))
    best = cut(best.join(copies, (F.col("__id").eqNullSafe(F.col("doc_id"))) & (F.col("__hash") == F.col("text_hash"))).select("__id", "__hash", "__n"))
    # The rows go as a struct, so that no name of theirs can clash with a helper's.
    hashed = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64(text_of(docs)).alias("__text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    same = lambda k: hashed["__doc"].eqNullSafe(k["__id"]) & (hashed["__text"] == k["__hash"])
    single, repeated = best.where("__n = 1"), best.where("__n > 1")
    kept = hashed.join(single, same(single), "left_semi")
    once = hashed.join(repeated, same(repeated), "left_semi").dropDuplicates(["__doc", "__text"])
    return kept.unionByName(once).select("row.*")
