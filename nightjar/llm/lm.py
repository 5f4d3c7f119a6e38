"""LM scoring (operator 6): cross-entropy difference of matched n-gram models.

Two bigram models share one public vocabulary, their order and their smoothing: the target's
counts come from all documents that are labelled good, the background's from all documents.
A document's score is the mean over its tokens of the target's loss less the background's, in
bits: the lower, the more the document is like the target than like the corpus at large.

Texts are tokenised once; the ids are a table in the shared folder, cut into chunks of about
``CHUNK`` tokens. Counts cover every document and are exact. Unigrams and contexts are bounded
by the vocabulary: tasks add them up in arrays, Spark sums those, and they are broadcast. The
bigrams grow with the corpus and never meet in one place: a chunk hands on each of its distinct
bigrams once with its counts, Spark sums them by bigram, and the sums go back to the chunks
that hold the bigram, where its documents are scored. So a frequent bigram has one row a
chunk. The models are matched in size too: the background's counts are scaled to the target's total, as
else the larger corpus would smooth less. A document's own counts are taken out of both models
when it is scored (leave one out), so labelled documents are judged like all others.

With counts c and ``MU``, ``ALPHA`` for the weight of the lower order:
p(w|u) = (c(u,w) + MU p(w)) / (c(u) + MU), p(w) = (c(w) + ALPHA) / (N + ALPHA V).

Defined results: a null text counts as empty; a text without tokens has null losses and score;
without any target token all scores are null; several labels of an id count as good if one
is; null ids have no label; repeated rows count as often as they occur; empty tables give
empty results. Extra columns travel in ``row``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNK = 1 << 20         # tokens; a longer document is a chunk of its own
MU, ALPHA = 50.0, 0.1
BROADCAST = 2_000_000       # labelled ids (16 bytes each) that may be broadcast
UNIGRAM, CONTEXT = range(2)


def vocabulary_size(path: str) -> int:
    return max(common.library_tokenizer(path).get_vocab().values()) + 1


def cells(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The key of each bigram; no two bigrams share one."""
    return before.astype(np.int64) << 32 | ids.astype(np.int64)


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _with_before(raw: bytes, size: int):
    """Token ids and the token before each; ``size`` stands before the first."""
    ids = np.frombuffer(raw, _kind(size)).astype(np.int64)
    return ids, np.concatenate([[size], ids[:-1]]) if len(ids) else ids


def _places(key: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where in ``key`` (sorted) each is found, looked up in ascending order."""
    order, out = np.argsort(found), np.empty(len(found), np.int64)
    out[order] = np.searchsorted(key, found[order])
    return out


def tokens(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None,
           chunk: int = CHUNK) -> DataFrame:
    """``row``, ``ids`` (binary) and ``chunk`` of each whole text, for counting and scoring."""
    size, now = vocabulary_size(path), {"chunk": 0, "used": 0}      # ``now`` is each task's own

    def run(texts):
        encode, kind, first = common.library_encoder(path), _kind(size), TaskContext.get().partitionId() << 32
        out, chunks = [], []
        for raw in encode.all(texts):
            raw = np.frombuffer(raw, "<u4").astype(kind)
            if now["used"] and now["used"] + len(raw) + 1 > chunk:
                now.update(chunk=now["chunk"] + 1, used=0)
            now["used"] += len(raw) + 1                             # texts without tokens fill it too
            out.append(raw.tobytes())
            chunks.append(first + now["chunk"])
        return [out, chunks]

    return common.add_columns(docs, {"text": common.text_of(text)}, run,
                              [common.field("ids", T.BinaryType()), common.field("chunk", T.LongType())], carry)


def _slices(columns: dict, rows: int = 100_000):
    """Record batches of bounded size of equally long arrays."""
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=rows)


def count(tokenised: DataFrame, size: int, good: str) -> DataFrame:
    """``(model, kind, cell, n)`` of unigrams and contexts over all documents; model 1 (target)
    only of good ones."""
    def run(batches):
        room = (size, size + 1)
        sums = [[np.zeros(n, np.int64) for n in room] for _ in range(2)]
        for b in batches:
            parts = ([], [])
            for raw, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts[bool(g)].append(_with_before(raw, size))
            for g, part in enumerate(parts):
                if part:
                    for kind, x in enumerate(zip(*part)):
                        sums[g][kind] += np.bincount(np.concatenate(x), minlength=room[kind])
        for kind in range(2):
            for model, n in enumerate((sums[0][kind] + sums[1][kind], sums[1][kind])):
                at = np.flatnonzero(n)
                yield from _slices({"model": np.full(len(at), model, np.int8), "kind": np.full(len(at), kind, np.int8),
                                    "cell": at.astype(np.int32), "n": n[at]})

    partial = tokenised.select("ids", F.coalesce(F.col(good), F.lit(False)).alias("g")) \
        .mapInArrow(run, "model byte, kind byte, cell int, n long")
    return partial.groupBy("model", "kind", "cell").agg(F.sum("n").alias("n"))


def pairs(tokenised: DataFrame, size: int, good: str) -> DataFrame:
    """``(chunk, key, background, target)``: both models' counts of each bigram of a chunk. A
    chunk that is read in parts has a row for each, with the same counts."""
    def run(batches):
        chunk, parts = None, ([], [])

        def summed():
            if parts[0] or parts[1]:
                key, at = np.unique(np.concatenate(parts[0] + parts[1]), return_inverse=True)
                other = sum(map(len, parts[0]))
                yield from _slices({
                    "chunk": np.full(len(key), chunk, np.int64), "key": key, "n": np.bincount(at, minlength=len(key)),
                    "g": np.bincount(at[other:], minlength=len(key))})

        for b in batches:
            for c, raw, g in zip(*[b.column(k).to_pylist() for k in range(3)]):
                if c != chunk:
                    yield from summed()
                    chunk, parts = c, ([], [])
                ids, before = _with_before(raw, size)
                if len(ids):
                    parts[bool(g)].append(cells(before, ids))
        yield from summed()

    partial = tokenised.select("chunk", "ids", F.coalesce(F.col(good), F.lit(False)).alias("g")) \
        .mapInArrow(run, "chunk long, key long, n long, g long")
    same = Window.partitionBy("key")        # at most one row for each chunk, or part of one
    return partial.select("chunk", "key", F.sum("n").over(same).alias("background"), F.sum("g").over(same).alias("target"))


class Models:
    """Both models' counts of unigrams and contexts; at most ``4 V`` numbers."""

    def __init__(self, counted, size: int):
        self.size = size
        room = (size, size + 1)
        self.counts = [[np.zeros(n) for n in room] for _ in range(2)]
        model, kind, cell, n = (counted.column(c).to_numpy() for c in ("model", "kind", "cell", "n"))
        for m in range(2):
            for k in range(2):
                mine = (model == m) & (kind == k)
                self.counts[m][k][cell[mine]] = n[mine]
        self.totals = [c[UNIGRAM].sum() for c in self.counts]

    def losses(self, raws: list[bytes], goods: list[bool], key: np.ndarray, two: tuple):
        """Tokens and mean losses in bits by (background, target) of each document, its own
        counts left out. ``key``: sorted bigrams of all of them; ``two``: their counts."""
        counts = [[*c, t] for c, t in zip(self.counts, two)]
        scratch = [np.zeros(len(c), np.int32) for c in counts[0]]       # zeros between documents
        one = np.int32(1)                       # of the counts' kind, as else numpy adds one by one, slowly
        for raw, good in zip(raws, goods):
            ids, before = _with_before(raw, self.size)
            if not len(ids) or not self.totals[1]:
                yield len(ids), None, None
                continue
            out, own, goal = [], [], self.totals[1]
            at = (ids, before, _places(key, cells(before, ids)))
            for mine, places in zip(scratch, at):
                np.add.at(mine, places, one)
                own.append(mine[places])
                mine[places] = 0
            for m in range(2):
                counted = bool(m == 0 or good)
                word, context, pair = (c[places] - o * counted for c, places, o in zip(counts[m], at, own))
                total = self.totals[m] - len(ids) * counted
                scale = goal / total if total > 0 else 0.0
                low = (word * scale + ALPHA) / (total * scale + ALPHA * self.size)
                out.append(float(-np.log2((pair * scale + MU * low) / (context * scale + MU)).mean()))
            yield len(ids), out[0], out[1]


def good_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """``(id, good)`` of the documents that a label calls good; broadcast if there are few
    enough of them, else joined by id."""
    known = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("id")).distinct() \
        .withColumn("good", F.lit(True))
    return F.broadcast(known) if known.limit(BROADCAST + 1).count() <= BROADCAST else known


def score(docs: DataFrame, labels: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
          carry: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """``row``, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` of each whole
    text. The target is the documents whose label's ``quality`` is 1."""
    path = path or common.vocabulary("byte_bpe_50k.json")
    size = vocabulary_size(path)
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    marked = docs.select(row, common.text_of(text).alias("text"), F.col(doc_id).alias("id")) \
        .join(good_ids(labels, doc_id), "id", "left")
    done = common.materialise(tokens(marked, path, carry=["row", "good"], chunk=chunk), "tokens")
    shared = docs.sparkSession.sparkContext.broadcast(Models(count(done, size, "row.good").toArrow(), size))

    def run(docs, pairs):
        key, background, target = (pairs.column(c).to_numpy() for c in ("key", "background", "target"))
        order = np.argsort(key)
        two = (background[order], target[order])
        out = [(n, t, b, None if t is None else t - b) for n, b, t in shared.value.losses(
            docs.column("ids").to_pylist(), docs.column("good").to_pylist(), key[order], two)]
        return pa.Table.from_arrays([docs.column("row"), *[pa.array(v, common.arrow_type(f.dataType)) for v, f in zip(
            zip(*out), fields)]], names=["row", *[f.name for f in fields]])

    fields = [common.field("n_tokens", T.LongType()), *[common.field(n, T.DoubleType()) for n in (
        "target_loss", "background_loss", "score")]]
    left = done.select("chunk", F.col("row.row").alias("row"), F.coalesce("row.good", F.lit(False)).alias("good"), "ids")
    return left.groupBy("chunk").cogroup(pairs(done, size, "row.good").groupBy("chunk")) \
        .applyInArrow(run, T.StructType([left.schema["row"], *fields]))


def op6_cross_entropy(spark, sf_dir: str) -> DataFrame:
    found = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("row.doc_id", "n_tokens", "target_loss", "background_loss", "score")
