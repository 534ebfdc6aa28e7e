"""Quality rules: fixed rules on counts, then gradient-boosted trees over document statistics, monotonic in chosen ones.

The trees are fitted on a bounded sample of labelled documents (max_labels, those with the least hash of doc_id) and scored in numpy from
flattened node arrays, on every document's whole text. The verdict's threshold is the log-odds under which at most max_lost of the good
documents in held-out folds fall, and zero at most, so that clean documents stay.

Defined results. A null text has no words and fails the rules, as does an empty one. Repeated rows come out repeatedly; null doc_ids come
out too. Several labels of a document count by their mean. Without labels of both kinds the rules alone decide. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webextract.llm import gbt
from webextract.llm.common import text_of
from webextract.llm.statistics import COUNTS, RATIOS, text_statistics

SCHEMA = "doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
MIN_WORDS, MAX_REPEAT = 50, 50


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, target: str = "quality") -> DataFrame:
    """doc_id, text and the other columns of docs, and y: the labelled documents with the least hash of doc_id, at most `most` labels."""
    of = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.avg(target).alias("y"))
    few = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows of two numbers.
    rows = docs.join(F.broadcast(few.select(F.col("doc_id").alias("__id"), F.col("y").alias("__y"))), F.col("doc_id") == F.col("__id"))
    # Of repeated rows one, so that the sample has at most `most` rows; those of an id meet as partial aggregates.
    one = rows.groupBy("__id").agg(F.min_by(F.struct(*(rows[c] for c in docs.columns), "__y"), F.xxhash64("text")).alias("r"))
    return one.select("r.*")


def folds(n: int, k: int = 4) -> list[np.ndarray]:
    return [np.arange(n) % k == i for i in range(k)]


def safe_threshold(score: np.ndarray, y: np.ndarray, max_lost: float) -> float:
    """The largest threshold, zero at most, below which no more than max_lost of the good rows fall."""
    good = np.sort(score[y > 0.5])
    return min(0.0, float(good[int(len(good) * max_lost)]) - 1e-9) if len(good) else -np.inf


def fit_rules(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, max_lost: float = 0.002) -> tuple[gbt.Trees, float] | None:
    sample = labelled_sample(docs.select("doc_id", text_of(docs).alias("text")), labels, max_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("__y"), pa.array([text_statistics(t.as_py())[1] for t in b.column("text")], pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.select("text", "__y").mapInArrow(run, "y double, x array<double>").toArrow()
    y = np.array(got.column("y").to_pylist(), dtype=float)
    if not len(y) or y.min() > 0.5 or y.max() <= 0.5:
        return None
    x = np.array(got.column("x").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))  # the rows' order doesn't depend on how the tasks ran
    x, y = x[order], (y[order] > 0.5).astype(float)
    signs = np.array(list(RATIOS.values()))
    held = np.zeros(len(y))
    for out in folds(len(y)):
        if 0 < y[~out].sum() < (~out).sum():
            held[out] = gbt.fit(x[~out], y[~out], monotone=signs).score(x[out])
    return gbt.fit(x, y, monotone=signs), safe_threshold(held, y, max_lost)


def apply_rules(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, max_lost: float = 0.002) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality. Returns doc_id, the counts, base_failed, kept and the trees' log-odds."""
    model = fit_rules(docs, labels, max_labels, max_lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_statistics(t.as_py()) for t in batch.column(1)]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
            words, repeat = counts[:, 0], counts[:, 4]
            failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * words)
            score = model[0].score(np.array([r for _, r in found]).reshape(-1, len(RATIOS))) if model else np.zeros(len(counts))
            kept = ~failed & (score >= (model[1] if model else -np.inf))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, SCHEMA.format(id=kind))
