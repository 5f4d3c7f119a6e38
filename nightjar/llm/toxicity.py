"""Toxicity (operator 4): subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with its ends marked) and itself, each hashed to
a row of an embedding table; a word's vector is their mean, so a misspelt or inflected word
that was never seen shares most of its vector with the word it comes from. A window of words
is the mean of its words' vectors, and a linear softmax of two classes scores it. Embeddings
and softmax are trained jointly, in numpy. A text is as toxic as its most toxic window: an
insult does not get weaker by the length of the text around it. A run of letters and digits
of over ``RUN`` characters (joined words, scripts without spaces) counts as a word for each of
its overlapping pieces, so an insult inside it is as strong as one between spaces.

Training reads at most ``TRAIN_ROWS`` labelled rows (smallest hash of id first, so any size
of input gives the same kind of sample), whole texts: the only bound is that of rows. Scoring
takes every whole text. As all is linear up to the softmax, a word's share of the logit is a
number, computed once per word and task.

Defined results: a null text counts as empty; a text without words scores as the mean of the
training labels' logit for an empty window (the bias); if one class has no training row, every
score is that class's share; rows with null labels or ids are not trained on; repeated rows
score alike; empty tables give empty results. Extra columns travel in ``row``.
"""
from __future__ import annotations

import functools
import math
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TRAIN_ROWS = 8_000
RUN = 32                # characters of a word; longer runs are cut into pieces that overlap by half
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 6)          # shortest and longest n-gram
WINDOW = 8              # words; windows overlap by half
EPOCHS = 100
RATE = 4.0
DECAY = 1e-4
POWER = 0.75
LEAST = 8               # training texts that hold a trained n-gram
SEED = 42
CUT = 0.7


@functools.lru_cache(maxsize=1)
def _pattern():
    return re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    runs = _pattern().findall(text.lower())
    if all(len(r) <= RUN for r in runs):
        return runs
    return [p for r in runs for p in ([r] if len(r) <= RUN else pieces(r))]


def pieces(run: str) -> list[str]:
    """The whole run in pieces of ``RUN`` characters that overlap by half."""
    return [run[i:i + RUN] for i in range(0, len(run) - RUN // 2, RUN // 2)]


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Rows of a word: itself and its distinct character n-grams."""
    marked = f"<{word}>"
    n = len(marked)
    grams = {marked[i:i + k] for k in range(GRAMS[0], GRAMS[1] + 1) for i in range(n - k + 1)}
    grams.add(marked)
    return [zlib.crc32(g.encode()) % buckets for g in grams]


def window_edges(n: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the windows of ``n`` words."""
    first = np.arange(0, max(1, n - size // 2), size // 2)
    return first, np.minimum(first + size, n)


class Model:
    """``table``: embeddings; ``out``: softmax weights; ``bias``. ``vector`` is their product
    per row for the class difference, which is all that scoring needs."""

    def __init__(self, table, out, bias):
        self.__setstate__({"vector": (table @ (out[:, 1] - out[:, 0])).astype(np.float64),
                           "bias": float(bias[1] - bias[0])})

    def __getstate__(self):
        return {"vector": self.vector, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.rows = self.vector.tolist()
        self.share: dict[str, float] = common.ChunkCache(self.word)

    def word(self, word: str) -> float:
        rows = self.rows
        bag = subwords(word, len(rows))
        return math.fsum([rows[k] for k in bag]) / len(bag)

    def logit(self, text: str) -> float:
        words = words_of(text)
        sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.share.__getitem__, words), float, len(words)))])
        a, b = window_edges(len(words))
        return float(((sums[b] - sums[a]) / np.maximum(b - a, 1)).max()) + self.bias

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-min(max(self.logit(text), -60.0), 60.0)))


def owner_of(owner, end):
    """The text of each word, from the windows' texts and ends."""
    last = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)
    return np.repeat(owner[last], np.diff(np.concatenate([[0], end[last]])))


def fit_calibrated(texts: list[str], labels: list[int], **how) -> Model:
    """Trains on four fifths of the rows and maps the logits by a logistic curve that is
    fitted on the rest (targets smoothed by their counts, as in Platt scaling)."""
    aside = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0 for t in texts], bool)
    y = np.asarray(labels)
    model = train([t for t, a in zip(texts, aside) if not a], y[~aside].tolist(), **how)
    n1, n0 = int(y[aside].sum()), int((y[aside] == 0).sum())
    if not n1 or not n0:
        return model
    z = np.array([model.logit(t) for t, a in zip(texts, aside) if a])
    goal = np.where(y[aside] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([z / max(1e-9, np.abs(z).max()), np.ones_like(z)], axis=1), np.zeros(2)
    for _ in range(50):                                             # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        slope = x.T @ (p - goal) + 1e-3 * beta
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    scale = float(beta[0] / max(1e-9, np.abs(z).max()))
    if scale > 0:
        model.__setstate__({"vector": model.vector * scale, "bias": model.bias * scale + float(beta[1])})
    return model


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, buckets: int = BUCKETS, dim: int = DIM,
          rate: float = RATE, decay: float = DECAY, least: int = LEAST, seed: int = SEED) -> Model:
    """Fits embeddings and softmax by Adam on the loss of each text's most toxic window."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    number: dict[str, int] = {}
    words, first, end, owner, at = array("i"), [], [], [], 0    # 32 bits a number: texts are whole
    for k, t in enumerate(texts):
        w = [number.setdefault(x, len(number)) for x in words_of(t)]
        if w:
            a, b = window_edges(len(w))
            first.append((a + at).astype(np.int32))
            end.append((b + at).astype(np.int32))
            owner.append(np.full(len(a), k, np.int32))
            words.extend(w)
            at += len(w)
    if not words or not 0 < y.mean() < 1:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros((buckets, dim)), np.zeros((dim, 2)), np.array([0, np.log(share / (1 - share))]))
    words, first, end, owner = np.frombuffer(words, np.int32), *(np.concatenate(x) for x in (first, end, owner))
    flat, sizes = array("i"), array("i")
    for w in number:
        bag = subwords(w, buckets)
        sizes.append(len(bag))
        flat.extend(bag)
    flat, sizes = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32)
    bag_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # rows that under ``least`` texts hold are not trained: they would only learn those texts
    holders = np.bincount(words[np.unique(owner_of(owner, end).astype(np.int64) * len(number) + words, return_index=True)[1]],
                          minlength=len(number))
    held = np.bincount(flat, holders[bag_of], buckets)
    common_row = held >= least
    trained = np.flatnonzero(common_row)
    ease = ((least / held[trained]) ** POWER)[:, None]      # what stands in every text moves least
    place = np.cumsum(common_row) - 1
    keep = common_row[flat]
    bag_of, flat = bag_of[keep], place[flat[keep]].astype(np.int32)
    table = rng.normal(0, 0.01, (len(trained), dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    last = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)    # of each text's windows
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))     # classes weigh alike
    params = [table, out, bias]
    moments = [(np.zeros_like(p), np.zeros(1)) for p in params]     # one scale for each table: rows move by their share of the loss
    for step in range(1, epochs + 1):
        # a word's vector is the mean of its rows, so its share of the logit is that of theirs
        row_share = table @ (out[:, 1] - out[:, 0])
        delta = np.bincount(bag_of, row_share[flat], len(sizes)) / sizes
        sums = np.concatenate([[0.0], np.cumsum(delta[words])])
        if step <= epochs // 2:         # whole texts first: which words matter is not known yet
            a, b, who = np.append(0, end[last][:-1]), end[last], owner[last]
        else:                           # then each text's most toxic window
            top = _argmax_by(owner, (sums[end] - sums[first]) / (end - first))
            a, b, who = first[top], end[top], owner[top]
        z = (sums[b] - sums[a]) / (b - a) + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        g = (p - y[who]) * weight[who] / len(who)                       # of the logit
        inside = words if step <= epochs // 2 else words[np.concatenate([np.arange(i, j) for i, j in zip(a, b)])]
        per_word = np.bincount(inside, np.repeat(g / (b - a), b - a), len(sizes)) / sizes
        d_row = np.bincount(flat, per_word[bag_of], len(trained)).astype(np.float32)
        pooled = d_row @ table                                          # the texts' mean vectors, by gradient
        d_out = np.stack([-pooled, pooled], axis=1)
        d_table = ease * d_row[:, None] * (out[:, 1] - out[:, 0])[None, :] + decay * table
        for p_, d, (m, v) in zip(params, (d_table, d_out, np.array([-g.sum(), g.sum()])), moments):
            m += 0.1 * (d - m)
            v += 0.01 * ((d * d).max() - v)
            p_ -= rate * (1.1 - step / epochs) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-12)
    whole = np.zeros((buckets, dim), np.float32)
    whole[trained] = table
    return Model(whole, out, bias)


def _argmax_by(owner, value):
    """Index of the largest value of each owner; owners come in order."""
    order = np.lexsort((value, owner))
    last = np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)
    return order[last]


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never read: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **how) -> Model:
    """Trains on at most ``rows`` labelled rows that are not held out."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic") \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = known.join(docs.select("doc_id", common.text_of().alias("text")), "doc_id")
    got = sample.orderBy("doc_id", "text").limit(rows).collect()
    return fit_calibrated([r.text for r in got], [int(r.toxic > 0) for r in got], **how)


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``score`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # BUCKETS numbers
    return common.add_columns(docs, {"text": common.text_of(text)},
                              lambda texts: [[shared.value.score(t) for t in texts]],
                              [common.field("score", T.DoubleType())], carry)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model, carry=["doc_id"]).select(
        "row.doc_id", F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
