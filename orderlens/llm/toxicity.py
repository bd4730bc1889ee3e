"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (bytes of its UTF-8 form, with
marks at both ends); a text is the mean of its words, a linear softmax on top. Misspelt or
unseen words share n-gram vectors with the words they come from. Vectors and softmax are
fitted together by momentum descent on the cross-entropy, on the driver, on a bounded sample of
labelled rows (SAMPLE_ROWS per label, SAMPLE_BYTES of text; a label of long texts is thinned
alone and keeps LEAST_ROWS). The share of each label in all labelled rows sets the prior.

Once fitted, the model is linear per n-gram bucket, so a text's score needs one number per
word; each worker keeps those of words it has met.

Defined cases: null and wordless texts get the score of the bias; rows without a label or
with a null doc_id teach nothing; a document labelled twice counts as toxic if one label
says so; with no learnable rows, or one label only, every score is the share of toxic rows
(0 without rows); rows that repeat a doc_id are scored each for itself; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import held_out, kept, prepare, written
from orderlens.llm.words import by_length, short_words

SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 8 << 20
LEAST_ROWS = 200
FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.3
BUCKETS = 1 << 16
DIMENSIONS = 2
GRAMS = (3, 4, 5)
LEAST_WORD_TEXTS, LEAST_GRAM_TEXTS = 3, 5
SMALL_SHARE = 1e-5
STEPS, RATE = 60, 2.0
CACHED_WORDS = 200_000


def gram_buckets(matrix: np.ndarray) -> np.ndarray:
    """Bucket numbers of the n-grams of words of one length: a row per word."""
    n = len(matrix)
    marked = np.empty((n, matrix.shape[1] + 2), np.uint64)
    marked[:, 0], marked[:, -1], marked[:, 1:-1] = 0x3C, 0x3E, matrix
    width = marked.shape[1]
    out = []
    for size in GRAMS:
        if size > width:
            continue
        key = np.zeros((n, width - size + 1), np.uint64)
        for k in range(size):
            key = (key << np.uint64(8)) | marked[:, k : width - size + 1 + k]
        mixed = (key + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(out, axis=1)


def _bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of all words one after another, and where each word's begin."""
    rows: list = [None] * len(words)
    for at, matrix in by_length(words):
        for i, row in zip(at, gram_buckets(matrix), strict=True):
            rows[i] = row
    sizes = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.concatenate(([0], np.cumsum(sizes)[:-1]))


class _Sums:
    """Sums of rows picked by `source`, grouped by `target`; used forwards and backwards."""

    def __init__(self, target: np.ndarray, source: np.ndarray, weight: np.ndarray):
        order = np.argsort(target, kind="stable")
        self.source, self.weight = source[order], weight[order].astype(np.float32)[:, None]
        ordered = target[order]
        self.begin = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.rows = ordered[self.begin]

    def __call__(self, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, values.shape[1]), np.float32)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(values[self.source] * self.weight, self.begin)
        return out


def train(texts: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, rate: float = RATE,
          seed: int = 7) -> np.ndarray:
    """Fit vectors and softmax together; the log-odds of label 1 per bucket, bias last.

    Buckets of frequent n-grams are scaled down by the root of their mean weight, so that
    one step size suits them all. Words and n-grams of too few texts teach nothing and
    keep a vector of zero.
    """
    spread = Counter(w for words in texts for w in set(words))
    number = {w: i for i, w in enumerate(w for w, n in spread.items() if n >= LEAST_WORD_TEXTS)}
    if not number:
        return np.zeros(BUCKETS + 1)
    places, words_, shares = array("q"), array("q"), array("d")
    for d, words in enumerate(texts):
        for w, c in Counter(words).items():
            if w in number:
                places.append(d)
                words_.append(number[w])
                shares.append(c / len(words))
    doc, word, share = np.array(places), np.array(words_), np.array(shares)
    rng = np.random.default_rng(seed)
    n, m, labels = len(texts), len(number), np.asarray(labels, np.int64)
    often = np.array([spread[w] for w in number])
    gram, begin = _bags(list(number))
    owner = np.repeat(np.arange(m), np.diff(np.append(begin, len(gram))))
    seen = np.bincount(gram, weights=often[owner], minlength=BUCKETS)
    even = 1.0 / np.bincount(owner, minlength=m)[owner]
    usable = seen[gram] >= LEAST_GRAM_TEXTS
    gram, owner, even = gram[usable], owner[usable], even[usable]
    to_doc, from_doc = _Sums(doc, word, share), _Sums(word, doc, share)
    usual = _Sums(gram, owner, even)(from_doc(np.ones((n, 1), np.float32), m), BUCKETS)[:, 0] / n
    scale = 1 / np.sqrt(usual + SMALL_SHARE)
    to_word, to_gram = _Sums(owner, gram, even * scale[gram]), _Sums(gram, owner, even * scale[gram])
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    weights = rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32)
    weights /= np.linalg.norm(weights[:, 1] - weights[:, 0])
    bias = np.zeros(2, np.float32)
    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    speed = [np.zeros_like(x) for x in (vectors, weights, bias)]
    for _ in range(steps):
        bags = to_doc(to_word(vectors, m), n)
        logits = bags @ weights + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        odds[np.arange(n), labels] -= 1
        slope = (odds * balance[:, None]).astype(np.float32)
        back = to_gram(from_doc(slope @ weights.T, m), BUCKETS)
        steps_of = ((vectors, back, rate), (weights, bags.T @ slope, 0.05), (bias, slope.sum(0), 0.5))
        for moving, (value, grad, size) in zip(speed, steps_of, strict=True):
            moving *= 0.9
            moving -= size * grad
            value += moving
    side = vectors @ (weights[:, 1] - weights[:, 0])
    return np.append(side * scale, bias[1] - bias[0]).astype(np.float64)


class Scorer:
    """Log-odds of texts under a fitted model."""

    def __init__(self, odds: np.ndarray):
        self.odds, self.bias = odds[:-1], float(odds[-1])
        self.words: dict[bytes, float] = {}

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.words]
        for at, matrix in by_length(new):
            values = self.odds[gram_buckets(matrix)].mean(1).tolist()
            self.words.update(zip([new[i] for i in at.tolist()], values, strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [short_words(t) for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        self.learn(set().union(*split))
        get = self.words.__getitem__
        sums = np.array([sum(map(get, words)) / max(1, len(words)) for words in split])
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
                    most_bytes: int = SAMPLE_BYTES) -> tuple[list, dict[int, int]]:
    """A bounded sample (text, toxic) of the learnable rows and the count of each label
    among all of them. Rows are chosen by a hash of the id, at a rate per label. A label whose
    texts exceed its share of the bytes, half of them and what the other leaves, is thinned
    alone, and keeps its LEAST_ROWS shortest rows."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("label")
    ).where(~held_out("doc_id", FOLDS, HELD_FOLD))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("label") == 1, rows / max(1, counts.get(1, 0))).otherwise(rows / max(1, counts.get(0, 0)))
    chosen = known.where(place < rate).select(F.col("doc_id").alias("_id"), "label")
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    picked = written(picked.select("_id", "label", "text"), "toxic-sample")
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = {r[0]: r[1] for r in picked.groupBy("label").agg(F.sum(length)).collect()}
    sample: list = []
    for label, size in sorted(sizes.items()):
        share = most_bytes - min(sizes.get(1 - label, 0), most_bytes // 2)
        own = picked.where(F.col("label") == label)
        if size <= share:
            sample += own.collect()
            continue
        thinned = own.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * share / size))
        short = own.orderBy(length, "_id", "text").limit(LEAST_ROWS)
        sample += (Counter(thinned.collect()) | Counter(short.collect())).elements()
    sample.sort(key=lambda r: (r._id, r.text or ""))
    return [(r.text, r.label) for r in sample], counts


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The model: log-odds per n-gram bucket and, last, the bias under the true prior."""
    prepare(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    found = {label for _, label in sample}
    odds = np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))
    if found != {0, 1}:
        return np.append(np.zeros(BUCKETS), odds)
    model = train([short_words(t) for t, _ in sample], np.array([y for _, y in sample]))
    model[-1] += odds
    return model


def score_column(docs: DataFrame, model: np.ndarray) -> Column:
    """The score of `text` as a column of `docs`."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = kept(key, lambda: Scorer(shared.value))
        for texts in batches:
            yield pd.Series(own.scores([t if isinstance(t, str) else None for t in texts]))

    return score(F.col("text"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", score_column(docs, fit(docs, labels)).alias("score"))
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model does not call toxic, with all their columns."""
    return docs.where(score_column(docs, fit(docs, labels)) < THRESHOLD)
