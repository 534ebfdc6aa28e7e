"""Quality classifier by co-training: one classifier sees the text, another one the page's metadata (language, source, length).

A good document is one of quality 1 that isn't toxic. Both start from a bounded sample of labelled documents, max_labels with the least
hash of doc_id. In each round each view goes over all documents and labels those that it is sure of for the other view, which learns
from what these documents are like on average, for either kind: sums of features are all that a round gathers, so no document is left
out however many there are. Both views are calibrated on labelled documents held out from the start (Platt scaling), combined by a
logistic regression on the two calibrated log-odds, and all documents are scored. A document is rejected under the threshold below which
at most max_lost of the good held-out documents fall.

The text view has shares of byte pairs, statistics of the text, and how much its words speak for a bad document, by the words' counts in
the labelled sample (a document's own label left out while training).

Defined results. Null texts and null metadata are empty ones. Repeated rows come out repeatedly; null doc_ids come out too. Several labels
of a document count by their mean, a null toxic as 0. Of the rows of a labelled doc_id one is learned from, that with the least hash of its
text. Without labels of both kinds every document is kept, at score 0.5. An empty table gives an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webextract.llm.common import Workspace, text_of
from webextract.llm.gbt import sigmoid
from webextract.llm.quality_rules import labelled_sample, safe_threshold
from webextract.llm.statistics import RATIOS, text_statistics_and_words

GRAMS = 1024
#: Where each pair of bytes goes; fixed by a multiplicative hash.
_PLACE = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
LANG, SOURCE = 16, 64
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Buckets of words, and how many documents' worth of "like any other" a word starts from.
WORDS, PRIOR = 1 << 18, 2.0
TEXT, PAGE = GRAMS + len(RATIOS) + 3, LANG + SOURCE + 3
#: Sums of features are added up in so many parts, each in one task.
CHUNKS = 16


def text_view(text: str) -> tuple[np.ndarray, dict[bytes, int]]:
    """Shares of hashed byte pairs, square-rooted, and the text's statistics; and its different words."""
    whole = text.encode()
    raw = np.frombuffer(whole, np.uint8).astype(np.int64)
    grams = np.bincount(_PLACE[raw[:-1] * 256 + raw[1:]], minlength=GRAMS) if len(raw) > 1 else np.zeros(GRAMS)
    _, ratios, words = text_statistics_and_words(text)
    return np.concatenate([np.sqrt(grams / max(len(raw) - 1, 1)), np.log1p(ratios)]).astype(np.float32), words


class OfWords(dict):
    """What a table has for a word: in lower case (A-Z), without marks around it, hashed. Words are remembered up to a bound."""

    def __init__(self, table: list, most: int = 200_000) -> None:
        self.table, self.most = table, most

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.most:
            self.clear()
        self[word] = out = self.table[xxhash.xxh64_intdigest(word.lower().strip(b'.,;:!?"()[]')) % WORDS]
        return out


def word_odds(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """How much words speak for a bad document, from the bad and good documents that have them; 0 for a word that none has."""
    share = n_bad / max(n_bad + n_good, 1)
    if not 0 < share < 1:
        return np.zeros(len(bad))
    return np.log((bad + PRIOR * share) / share) - np.log((good + PRIOR * (1 - share)) / (1 - share))


def worst_words(odds: Iterable[float]) -> tuple[float, float, float]:
    """Of the words that speak for a bad document the largest, the sum of three and that of eight."""
    top = sorted((x for x in odds if x > 0), reverse=True)[:8]
    return max(top, default=0.0), sum(top[:3]), sum(top)


def page_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANG + SOURCE + 3, dtype=np.float32)
    out[xxhash.xxh64_intdigest((lang or "").encode()) % LANG] = 1
    out[LANG + xxhash.xxh64_intdigest((source or "").encode()) % SOURCE] = 1
    size = np.log1p(max(n_chars or 0, 0))
    out[-3:] = (n_chars is None, size / 10, (size / 10) ** 2)
    return out


#: The share of a class's weight that documents labelled by the other view have.
GIVEN = 0.3


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, given: tuple[np.ndarray, ...] = (), l2: float = 1e-3, steps: int = 120) -> Linear:
        """Accelerated gradient steps from zero; both classes weigh the same. given: of the bad and the good documents that the other view
        is sure of the mean features, or nothing; these count for GIVEN of their class."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        share = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
        for kind, extra in enumerate(given):
            if len(extra):
                own = (y > 0.5) == bool(kind)
                share[own] *= np.float32(1 - GIVEN)
                x, y, share = np.concatenate([x, extra[None, :].astype(x.dtype)]), np.append(y, float(kind)), np.append(share, np.float32(0.5 * GIVEN))
        z = (x - mean) / scale
        # The largest eigenvalue of the weighted second moment bounds the steps.
        v = np.ones(z.shape[1], dtype=np.float32)
        for _ in range(8):
            v = z.T @ (share * (z @ v))
            v /= np.linalg.norm(v) + 1e-12
        rate = 1 / (0.25 * float(v @ (z.T @ (share * (z @ v)))) * 1.2 + l2 + 0.3)
        w, b = np.zeros(z.shape[1], dtype=np.float32), 0.0
        w0, b0 = w, b
        for k in range(steps):
            m = k / (k + 3)
            wy, by = w + m * (w - w0), b + m * (b - b0)
            d = share * (sigmoid(z @ wy + by) - y).astype(np.float32)
            w0, b0 = w, b
            w, b = wy - rate * (z.T @ d + l2 * wy), by - rate * float(d.sum())
        return cls(mean, scale, w, float(b))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a logistic regression on the columns of z, and its intercept, by Newton's steps."""
    a = np.column_stack([z, np.ones(len(z))])
    c = np.zeros(a.shape[1])
    for _ in range(30):
        p = sigmoid(a @ c)
        c -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(c)), a.T @ (p - y) + 1e-2 * c)
        c = np.clip(c, -20, 20)
    return tuple(c)


@dataclass
class Model:
    text: Linear
    page: Linear
    text_scale: tuple[float, ...]
    page_scale: tuple[float, ...]
    mixed: tuple[float, ...]
    odds: np.ndarray
    threshold: float = 0.0

    def views(self, texts: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each view's calibrated log-odds of a good document."""
        return self.text(texts) * self.text_scale[0] + self.text_scale[1], self.page(pages) * self.page_scale[0] + self.page_scale[1]

    def __call__(self, texts: np.ndarray, pages: np.ndarray) -> np.ndarray:
        t, p = self.views(texts, pages)
        return self.mixed[0] * t + self.mixed[1] * p + self.mixed[2]

    def features(self, texts: list[str], page: Iterable[tuple], of_words: OfWords) -> tuple[np.ndarray, np.ndarray]:
        """of_words: of self.odds."""
        t = []
        for text in texts:
            view, words = text_view(text)
            t.append(np.append(view, np.float32(worst_words(map(of_words.__getitem__, words)))))
        return np.stack(t), np.stack([page_view(*x) for x in page])


def train(texts: np.ndarray, pages: np.ndarray, words: list[np.ndarray], y: np.ndarray, given: tuple = ((), ()), max_lost: float = 0.002) -> Model:
    """texts: without the words' features; words: buckets; given: for the text and the page view what Linear.fit takes."""
    held = np.arange(len(y)) % 4 == 3
    if not (0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum()):
        held = np.ones(len(y), dtype=bool)
    learn = ~held if not held.all() else held
    counts = np.zeros((2, WORDS))
    for at, kind in zip(words, y):
        counts[int(kind), at] += 1
    for i in np.flatnonzero(held & ~learn):
        counts[int(y[i]), words[i]] -= 1
    n = np.array([(learn & (y < 0.5)).sum(), (learn & (y > 0.5)).sum()], dtype=float)
    odds = word_odds(counts[0], counts[1], n[0], n[1]).astype(np.float32)
    worst = []
    for at, kind, own in zip(words, y, learn):
        left = [1.0 if own and int(kind) == k else 0.0 for k in (0, 1)]
        worst.append(worst_words(word_odds(counts[0, at] - left[0], counts[1, at] - left[1], n[0] - left[0], n[1] - left[1])))
    texts = np.concatenate([texts, np.array(worst, dtype=np.float32)], axis=1)
    models = [Linear.fit(x[learn], y[learn], extra) for x, extra in zip((texts, pages), given)]
    scales = [_platt(m(x[held])[:, None], y[held]) for m, x in zip(models, (texts, pages))]
    z = np.column_stack([m(x[held]) * c[0] + c[1] for m, x, c in zip(models, (texts, pages), scales)])
    out = Model(models[0], models[1], scales[0], scales[1], _platt(z, y[held]), odds)
    out.threshold = safe_threshold(out(texts[held], pages[held]), y[held], max_lost)
    return out


def sure_sums(model: Model, texts: np.ndarray, pages: np.ndarray, sure: float) -> np.ndarray:
    """For the text and the page view, for bad and good: the number of documents that the other view is sure of, and their features' sums."""
    t, p = model.views(texts, pages)
    out = []
    for odds, x in ((p, texts), (t, pages)):
        limit = np.log(sure / (1 - sure))
        for chosen in (odds <= -limit, odds >= limit):
            out.append(np.concatenate([[chosen.sum()], x[chosen].sum(axis=0, dtype=np.float64)]))
    return np.concatenate(out)


def means(sums: np.ndarray) -> tuple:
    """From sure_sums() of all documents what Linear.fit takes for either view."""
    parts = np.split(sums, np.cumsum([TEXT + 1, TEXT + 1, PAGE + 1]))
    bad_text, good_text, bad_page, good_page = (x[1:] / x[0] if x[0] else x[:0] for x in parts)
    return (bad_text, good_text), (bad_page, good_page)


def _view_columns(docs: DataFrame) -> list[Column]:
    """text, lang, source and n_chars in plain types; columns that docs lacks are null."""
    kinds = {"lang": "string", "source": "string", "n_chars": "bigint"}
    return [text_of(docs).alias("text"), *((docs[c] if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items())]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_view_columns(docs))


def _slices(batches: Iterable[pa.RecordBatch], many: int = 1000) -> Iterator[pa.RecordBatch]:
    """The views of a thousand texts at a time, so that memory doesn't follow the batch."""
    return (b.slice(i, many) for b in batches for i in range(0, len(b), many))


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labels: int = 8_000, max_lost: float = 0.002, rounds: int = 2, sure: float = 0.95) -> Model | None:
    """rounds: how often the views go over all documents to label them for each other."""
    source, space = _source(docs), Workspace(docs.sparkSession)
    toxic = F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)) if "toxic" in labels.columns else F.lit(0.0)
    target = labels.where("quality IS NOT NULL").select("doc_id", F.when(toxic > 0.5, 0.0).otherwise(F.col("quality").cast("double")).alias("quality"))
    sample = labelled_sample(source, target, max_labels).select("text", "lang", "source", "n_chars", F.col("__y").alias("y"))

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = OfWords(range(WORDS))
        for b in batches:
            t, g, s, n, y = (c.to_pylist() for c in b.columns)
            found = [text_view(x) for x in t]
            buckets = [np.unique(np.array(list(map(place.__getitem__, words)), dtype=np.int32)) for _, words in found]
            columns = [[x.tobytes() for x, _ in found], [page_view(*x).tobytes() for x in zip(g, s, n)], [x.tobytes() for x in buckets]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), pa.array(y, pa.float64())], names=["t", "p", "w", "y"])

    known = space.save(sample.mapInArrow(views, "t binary, p binary, w binary, y double"), "sample")

    def learn(given: tuple) -> Model | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # One task trains on the bounded sample, in an order that the rows alone decide.
            rows = sorted((y, t, p, w) for b in batches for t, p, w, y in zip(*(c.to_pylist() for c in b.columns)))
            y, model = np.array([r[0] > 0.5 for r in rows], dtype=float), None
            if 0 < y.sum() < len(y):
                texts, pages = (np.frombuffer(b"".join(r[k] for r in rows), np.float32).reshape(len(rows), -1) for k in (1, 2))
                model = train(texts, pages, [np.frombuffer(r[3], np.int32) for r in rows], y, given, max_lost)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])

        return pickle.loads(known.repartition(1).mapInArrow(run, "model binary").first()["model"])

    model = learn(((), ()))
    for _ in range(rounds if model else 0):
        model = learn(means(_sums(source, model, sure)))
    space.drop()
    return model


def _sums(source: DataFrame, model: Model, sure: float) -> np.ndarray:
    """sure_sums() over all documents; a task sends one vector, whose parts are added up in a task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = OfWords(model.odds.tolist()), np.zeros(2 * (TEXT + PAGE + 2))
        for b in _slices(batches):
            t, *page = (c.to_pylist() for c in b.columns)
            total += sure_sums(model, *model.features(t, zip(*page), buckets), sure)
        cut = np.array_split(total, CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in cut])], names=["chunk", "x"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table.column("chunk")[:1], "x": pa.array([sum(np.frombuffer(x.as_py()) for x in table.column("x")).tobytes()])})

    rows = source.select("text", "lang", "source", "n_chars").mapInArrow(run, "chunk int, x binary")
    found = rows.groupBy("chunk").applyInArrow(lambda t: add(t), "chunk int, x binary").collect()
    return np.concatenate([np.frombuffer(r["x"]) for r in sorted(found, key=lambda r: r["chunk"])])


def classify(docs: DataFrame, labels: DataFrame, max_labels: int = 8_000, max_lost: float = 0.002, rounds: int = 2) -> DataFrame:
    """docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality, toxic. Returns doc_id, score (probability of a good document), kept."""
    model = fit_classifier(docs, labels, max_labels, max_lost, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = OfWords(model.odds.tolist()) if model else None
        for b in _slices(batches):
            ids, t, *page = b.columns
            odds = model(*model.features(t.to_pylist(), zip(*(c.to_pylist() for c in page)), buckets)) if model else np.zeros(len(ids))
            keep = odds >= model.threshold if model else np.ones(len(ids), dtype=bool)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sigmoid(odds).astype(float)), pa.array(keep)], names=["doc_id", "score", "kept"])

    return _source(docs).select(*COLUMNS).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, max_labels: int = 8_000, max_lost: float = 0.002, rounds: int = 2) -> DataFrame:
    """The rows of docs, with all their columns, that classify() keeps."""
    model = fit_classifier(docs, labels, max_labels, max_lost, rounds)
    if not model:
        return docs
    names = docs.columns
    seen = docs.select("*", *(c.alias(f"__view{i}") for i, c in enumerate(_view_columns(docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = OfWords(model.odds.tolist())
        for b in _slices(batches):
            t, *page = (c.to_pylist() for c in b.columns[len(names) :])
            odds = model(*model.features(t, zip(*page), buckets))
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(odds >= model.threshold)).columns[: len(names)], names=names)

    return seen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
