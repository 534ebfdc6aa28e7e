"""Substring deduplication: paragraphs, and passages inside of them, that repeat within and across documents.

Paragraphs are the lines of a text with at least min_words words. MinHash signatures over their five-word shingles are banded; paragraphs
that share a band are candidates, verified by the exact Jaccard similarity of their shingle sets; links make components, and of each
component the first occurrence, by (doc_id, start), stays. Equal paragraphs are one before any pair is made, and a band with very many
different paragraphs doesn't give all its pairs (see components.bucket_links).

A passage may also repeat inside of lines that are otherwise unlike, or go over several lines, with ends anywhere. So what stays is cut by
MinHash as well: of every window of WINDOW shingles the least one is an anchor, and the words from one anchor to the end of the next one
are a stretch, so that equal passages have equal stretches wherever they stand. Stretches with equal hashes of all their words (64 bits) are
one class; its first occurrence stays. A run of neighbouring stretches, each of which occurs before, of min_words words or more is removed.
Two equal passages of over 50 words have 47 shingles or more in common, and so two anchors at least 20 words apart: with the shingle
at the second one that is a run of 25 words, whatever is around them. Up to 13 words at either end of a passage, before its first or after
its last anchor, stay.

Defined results. Null and empty texts have no paragraphs. Words are in lower case (A-Z); with fewer words than a shingle, the whole
paragraph is one. Repeated rows are occurrences like any other, so all but the first are removed; they share doc_id and start, and come
out once with copies counting them. Documents are told apart by doc_id and text, so different texts may share an id or have none. Null
doc_ids come first. An empty table gives an empty one. For a run, kept_doc_id and kept_start are where its first stretch stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webextract.llm.common import Workspace, cut, maybe_among, release, text_of
from webextract.llm.components import collisions, connected_components
from webextract.llm.simhash import MinHash, set_links, shingle_hashes, shingle_sets, tune_bands

#: Shingles of an anchor's window, and words of a shingle.
WINDOW, SHINGLE = 14, 5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_UNB = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def keyed(docs: DataFrame) -> DataFrame:
    """k (a hash of doc_id and text), doc_id, text."""
    return docs.select("doc_id", text_of(docs).alias("text")).select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text")


def paragraphs(docs: DataFrame, min_words: int, words: int, minhash: MinHash) -> DataFrame:
    """docs: of keyed(). Returns k, doc_id, start, stop, p (hash of the line), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, len(b), 2000)):
            at_row, starts, stops, hashes, bands = [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                at = 0
                for line in text.as_py().split("\n"):
                    raw = line.encode()
                    if len(raw.split()) >= min_words:
                        at_row.append(row)
                        starts.append(at)
                        stops.append(at + len(line))
                        hashes.append(np.uint64(xxhash.xxh64_intdigest(raw, 42)).astype(np.int64))
                        bands.append(minhash(np.array(shingle_hashes(line, words), dtype=np.uint64)))
                    at += len(line) + 1
            rows = pa.array(at_row, pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(hashes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "doc_id", "start", "stop", "p", "bands"])

    return docs.mapInArrow(run, f"k bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, stop bigint, p bigint, bands array<bigint>")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


class Stretches:
    """Cuts texts into stretches. Words are remembered up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverses = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b)]) for b in (_B, _UNB))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of each stretch: which text, the start of the line that it begins in, which one of the text, start, stop, words to the next anchor,
        hash, and of a text's first one the stop of its last one (else -1). Positions are characters of the text."""
        raws = [t.encode() for t in texts]
        whole = b"\n".join(raws) + b"\n"
        words, known = whole.lower().split(), self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        data = np.frombuffer(whole, np.uint8)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.r_[np.int8(1), white.astype(np.int8)])
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(end) > len(first):  # a white first byte isn't the end of a word
            end = end[-len(first) :] if len(first) else first
        text_at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        of = np.searchsorted(text_at, first, "right") - 1
        none = tuple(np.zeros(0, dtype=np.int64) for _ in range(8))
        n = len(h) - SHINGLE - WINDOW + 2  # windows
        if n <= 0:
            return none
        s = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
        for i in range(SHINGLE):
            s = s * _A + h[i : len(s) + i]
        s = _mix(s)
        inside = np.flatnonzero(of[:n] == of[WINDOW + SHINGLE - 2 :])
        windows = np.lib.stride_tricks.sliding_window_view(s, WINDOW)[:, ::-1]
        least = np.concatenate([windows[i : i + 50_000].argmin(axis=1) for i in range(0, n, 50_000)])
        anchor = np.unique(inside + WINDOW - 1 - least[inside])
        a, b = anchor[:-1], anchor[1:]
        same = of[a] == of[b]
        a, b = a[same], b[same]
        if not len(a):
            return none
        self._powers(len(h))
        total = np.r_[np.uint64(0), np.cumsum(h * self.powers[: len(h)], dtype=np.uint64)]
        hashes = _mix((total[b + SHINGLE] - total[a]) * self.inverses[a])
        chars = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that a byte belongs to
        chars = np.append(chars, chars[-1] + 1)
        base = chars[text_at[of[a]]]
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, first[a]) - 1
        line = np.where(line >= 0, chars[np.where(line >= 0, breaks[line], 0) + 1], 0)
        begins = np.flatnonzero(np.diff(of[a], prepend=-1))
        nth = np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a))))
        stop = chars[end[b + SHINGLE - 1]] - base
        tail = np.full(len(a), -1)
        tail[begins] = stop[np.append(begins[1:], len(a)) - 1]
        return of[a], np.maximum(line - base, 0), nth, chars[first[a]] - base, stop, b - a, hashes.view(np.int64), tail


def stretches(docs: DataFrame) -> DataFrame:
    """docs: of keyed(). Returns k, doc_id, line, nth, start, stop, words, h, tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Stretches()
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                of, *found = cutter(part.column(2).to_pylist())
                rows = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *(pa.array(x, pa.int64()) for x in found)], names=["k", "doc_id", "line", "nth", "start", "stop", "words", "h", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"k bigint, doc_id {kind}, line bigint, nth bigint, start bigint, stop bigint, words bigint, h bigint, tail bigint")


def repeated_runs(docs: DataFrame, removed: DataFrame, space: Workspace, min_words: int) -> DataFrame:
    """docs: of keyed(). The runs of repeated stretches that don't begin in removed lines (k, start), in the columns of repeated_paragraphs().

    Both sides of a join come from files, so that Spark splits a hash that very many stretches have.
    """
    gone = removed.select(F.col("k").alias("g"), F.col("start").alias("gs"))
    every = space.save(stretches(docs), "stretches")
    # Rows that are repeated as a whole have the same key; where no line of theirs is removed they come out from their first stretch on.
    again = every.where("nth = 0").groupBy("k", "doc_id", "start").agg(F.max("tail").alias("stop"), (F.count("*") - 1).alias("copies")).where("copies > 0")
    again = space.save(again.join(gone.select("g").distinct().hint("merge"), F.col("k") == F.col("g"), "left_anti"), "again")
    left = space.save(every.drop("tail").join(gone.hint("merge"), (every["k"] == gone["g"]) & (every["line"] == gone["gs"]), "left_anti"), "left")
    space.drop("stretches")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "k", "nth", "start")
    first = space.save(left.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h", "first"), "first")
    later = space.save(left.join(first.hint("merge"), "h").where(place != F.col("first")).select("k", "doc_id", "nth", "start", "stop", "words", "first"), "later")
    space.drop("left")
    by = Window.partitionBy("k").orderBy("nth")
    # Neighbours have the same difference of their number in the document and their rank among the repeated ones.
    runs = later.withColumn("run", F.col("nth") - F.row_number().over(by))
    found = runs.groupBy("k", "doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.min(F.struct("nth", "first")).alias("f"))
    found = found.where(F.col("words") + SHINGLE >= min_words)
    runs = found.select("k", "doc_id", "start", "stop", F.lit(1).cast("long").alias("copies"), F.col("f.first.doc_id").alias("kept_doc_id"), F.col("f.first.start").alias("kept_start"))
    return runs.unionByName(again.select("k", "doc_id", "start", "stop", "copies", F.col("doc_id").alias("kept_doc_id"), F.col("start").alias("kept_start")))


def repeated_paragraphs(docs: DataFrame, min_words: int = 25, words: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """docs: doc_id, text. Returns the paragraphs and runs of stretches to remove: doc_id, start, stop, copies, kept_doc_id, kept_start (the occurrence that stays)."""
    space = Workspace(docs.sparkSession)
    docs = keyed(docs)
    found = space.save(paragraphs(docs, min_words, words, MinHash(*tune_bands(similarity, recall))), "paragraphs")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "start", "k"))
    distinct = space.save(found.groupBy("p").agg(F.count("*").alias("weight"), first.alias("first"), F.first("bands").alias("bands")), "distinct")
    met = collisions(distinct.select(F.explode(F.array_distinct("bands")).alias("bucket"), F.col("p").alias("id")), space)

    def make_sets(ids: DataFrame) -> DataFrame:
        wanted = ids.select(F.col("id").alias("p"))
        lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") >= 2 * min_words - 1).select(F.xxhash64("line").alias("p"), "line")
        texts = maybe_among(lines, wanted, "p").join(wanted, "p").groupBy("p").agg(F.first("line").alias("text"))
        return space.save(shingle_sets(texts.select(F.col("p").alias("text_hash"), "text"), words), "sets")

    weights = distinct.select(F.col("p").alias("id"), "weight")
    roots = connected_components(set_links(met, weights, make_sets, similarity))
    classes = cut(distinct.join(roots, distinct["p"] == roots["id"], "left").select("p", F.coalesce("root", "p").alias("root"), "first", "weight"))
    heads = cut(classes.groupBy("root").agg(F.min("first").alias("head"), F.sum("weight").alias("n")).where("n > 1"))
    named = cut(classes.join(heads.hint("merge"), "root").select("p", "head"))
    out = found.select("k", "doc_id", "start", "stop", "p").join(named.hint("merge"), "p").groupBy("k", "doc_id", "start", "stop", "head").agg(F.count("*").alias("copies"))
    is_head = (F.col("k") == F.col("head.k")) & (F.col("start") == F.col("head.start"))
    out = out.withColumn("copies", F.when(is_head, F.col("copies") - 1).otherwise(F.col("copies"))).where("copies > 0")
    out = cut(out.select("k", "doc_id", "start", "stop", "copies", F.col("head.doc_id").alias("kept_doc_id"), F.col("head.start").alias("kept_start")))
    for name in ("paragraphs", "distinct", "collisions", "collisions-members", "collisions-sizes", "sets"):
        space.drop(name)
    release(docs.sparkSession)
    out = cut(out.unionByName(repeated_runs(docs, out, space, min_words)).drop("k"))
    space.drop()
    return out
