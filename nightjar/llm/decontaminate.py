"""Benchmark decontamination (operator 10): rare n-gram seeds and Smith-Waterman alignment.

Test items and documents are cut into normalised words. A passage matches an item if its best
alignment (Smith-Waterman, word by word, with a match, mismatch and gap score) reaches
``THRESHOLD`` t of the score of the item against itself.

**Seeds.** An alignment with m matched words of an item of L has at most 2 m - 2 t L edits, so at
most one run of adjacent matches more than that, and at least 2 t L - m - 1 matched pairs of
neighbours. Words and pairs together: of the item's 2 L - 1 n-grams (of one word and of two)
every matching passage holds at least 2 t L - 1, whatever the edits are and wherever they stand.
So it holds at least k of any 2 L - 2 t L + k of them, and those are chosen that are rare: Spark
counts first how often each n-gram of the items occurs in all documents. k is set for each
item to where k hits within the length of a match are least likely by chance. N-grams that
stand everywhere (function words, a prompt that thousands of items share) seed nothing while
rarer ones are enough.

**Alignment.** Around the seeds, all that a match could cover is cut out. If it shares too few
words with the item to reach the threshold in any order, it is no candidate; what is left is
aligned, each distinct passage once.

Items are dealt by hash into blocks of about ``BLOCK_CHARS`` characters, each block against all
documents; one block at a time is on the driver and broadcast, and freed when it is done. An
item shorter than ``SHORT`` words is looked for as a whole; an item without words matches nothing.

Defined results: null or empty texts hold nothing; a document of any length is searched
whole; pairs are reported once per document row and item id, with the best score; items with
equal ids or texts, documents with equal or null ids are rows of their own until then, and
null ids are reported as null; empty tables give no pair. Extra columns travel in ``row``.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHORT = 4               # words
THRESHOLD = 0.5         # of the item's score against itself
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 4_000_000


_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-case words; what is neither letter, digit nor underscore parts them."""
    return _WORD.findall(text.lower())


def align(item: list[int], passage: list[int]) -> tuple[int, int, int]:
    """Best local alignment: score, first word and end in the passage. One row of the table
    per item word; within a row, gaps are a running maximum."""
    b = np.asarray(passage)
    n = len(b)
    ramp = np.arange(n + 1) * GAP
    above, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = above[:-1] + np.where(b == w, MATCH, MISMATCH)
        down = above[1:] + GAP
        row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diagonal >= down
        cell = np.where(take, diagonal, down)
        row[1:] = np.maximum(cell, 0)
        start[1:] = np.where(cell > 0, np.where(take, origin[:-1], origin[1:]), start[1:])
        lifted = row - ramp                     # a gap in the item: the best cell to the left, less its way
        reach = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        gapped = reach + ramp
        longer = gapped > row
        row, start = np.where(longer, gapped, row), np.where(longer, start[at], start)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j)
        above, origin = row, start
    return best


class Block:
    """Some items as lists of word numbers (from 1; 0 is any other word), and their n-grams:
    words by their numbers, pairs of neighbours by numbers behind those."""

    def __init__(self, items: list[tuple]):
        self.numbers: dict[str, int] = {}
        self.items = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)] for _, text in items]
        self.size = len(self.numbers) + 1
        self.pairs = np.unique(np.array([a * self.size + b for item in self.items for a, b in zip(item, item[1:])], np.int64))
        self.grams = self.size + len(self.pairs)

    def ids(self, texts: list[str], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words in one array, ``gap`` zeros behind each text; each text's start."""
        ids: list[int] = []
        starts, get, none = [], self.numbers.get, [0] * gap
        for t in texts:
            starts.append(len(ids))
            ids.extend(map(get, words_of(t), repeat(0)))
            ids += none
        return np.array(ids, np.int64), np.array(starts, np.int64)

    def grams_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the items' n-grams among words."""
        words = np.flatnonzero(ids)
        two = words[:-1][np.diff(words) == 1] if len(words) > 1 and len(self.pairs) else words[:0]
        key = ids[two] * self.size + ids[two + 1]
        spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        held = self.pairs[spot] == key if len(two) else np.zeros(0, bool)
        return np.concatenate([words, two[held]]), np.concatenate([ids[words], self.size + spot[held]])


class Seeds(Block):
    """A block whose items' seeds are chosen. ``counts``: by n-gram, its occurrences in all
    documents; ``words``: all words of these."""

    def __init__(self, block: Block, counts: np.ndarray, words: int, threshold: float = THRESHOLD):
        self.__dict__.update(block.__dict__)
        self.threshold, self.least, self.reach, self.short = threshold, [], [], {}
        owners: list[list[int]] = [[] for _ in range(self.grams)]
        often = counts / max(1, words)
        for n, item in enumerate(self.items):
            size = len(item)
            held = math.ceil(MATCH * threshold * size - 1e-9) - 1   # n-grams of a match at least
            reach = size + int(MATCH * size * (1 - threshold))      # words that it covers at most
            k = 0
            if 0 < size < SHORT:
                self.short.setdefault(tuple(item), []).append(n)
            elif size:
                _, grams = self.grams_of(np.array(item, np.int64))
                grams = grams[np.argsort(often[grams], kind="stable")]
                spare = len(grams) - held
                by_chance = np.cumsum(1 - np.exp(-reach * often[grams]))[spare:]
                ks = np.arange(1, held + 1)
                k = int(ks[np.argmax((ks - by_chance) / np.sqrt(by_chance + 1))])
                for g in set(grams[:spare + k].tolist()):
                    owners[g].append(n)
            self.least.append(k)
            self.reach.append(reach)
        self.least, self.reach = np.array(self.least, np.int64), np.array(self.reach, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
        self.owners = np.array([n for o in owners for n in o], np.int64)
        self.short_lengths = sorted({len(s) for s in self.short})
        self.gap = int(self.reach.max(initial=0)) + 1

    def regions(self, ids: np.ndarray, starts: np.ndarray):
        """Text, item, start, end and seeds of the stretches of the texts that can hold a match.
        Texts stand further apart than any match reaches."""
        ends = np.append(starts[1:], len(ids)) - self.gap
        at, grams = self.grams_of(ids)
        many = self.starts[grams + 1] - self.starts[grams]
        place = np.repeat(at, many)
        first = np.repeat(self.starts[grams] - (np.cumsum(many) - many), many)
        item = self.owners[first + np.arange(len(first))]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.least[item] - 1
        fits = last < len(item)
        fits[fits] &= item[last[fits]] == item[fits]
        fits[fits] &= place[last[fits]] - place[fits] < self.reach[item[fits]]
        now = None
        for k in np.flatnonzero(fits).tolist():
            n, reach, end = int(item[k]), int(self.reach[item[k]]), int(last[k])
            text = int(np.searchsorted(starts, place[k], "right")) - 1
            a, b = max(int(starts[text]), int(place[k]) - reach), min(int(ends[text]), int(place[end]) + reach)
            if now and now[:2] == [text, n] and a <= now[3]:
                now[3], now[5] = max(now[3], b), end
            else:
                if now:
                    yield *now[:4], now[5] - now[4] + 1
                now = [text, n, a, b, k, end]
        if now:
            yield *now[:4], now[5] - now[4] + 1
        if self.short:
            words = ids.tolist()
            for length in self.short_lengths:
                for p in range(len(words) - length + 1):
                    for n in self.short.get(tuple(words[p:p + length]), ()):
                        yield int(np.searchsorted(starts, p, "right")) - 1, n, p, p + length, length

    def passages(self, texts: list[str]) -> list[list[dict]]:
        """Candidates of each text: item, seeds, first word, passage (0 for words that the item
        lacks: it aligns alike)."""
        ids, starts = self.ids(texts, self.gap)
        out: list[list[dict]] = [[] for _ in texts]
        for text, n, a, b, seeds in self.regions(ids, starts):
            bag = Counter(self.items[n])
            held = [w if w in bag else 0 for w in ids[a:b].tolist()]
            if sum((Counter(held) & bag).values()) < self.threshold * len(self.items[n]) - 1e-9:
                continue
            some = np.flatnonzero(held)
            out[text].append({"item": n, "n_seeds": seeds, "first": a + int(some[0] - starts[text]),
                              "passage": held[some[0]:some[-1] + 1]})
        return out


CANDIDATE = T.ArrayType(T.StructType([
    common.field("item", T.IntegerType()), common.field("n_seeds", T.IntegerType()),
    common.field("first", T.LongType()), common.field("passage", T.ArrayType(T.IntegerType()))]))


def blocks_of(items: DataFrame, item_id: str, text: str, chars: int):
    """The items, block by block. An item over the bound may be a block of its own."""
    held = common.materialise(items.select(F.col(item_id).cast("long").alias("item_id"), common.text_of(text).alias("text")), "items")
    total = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 if total <= chars else -(-2 * total // chars)
    for k in range(blocks):
        mine = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else held
        some = [tuple(r) for r in mine.orderBy("item_id", "text").collect()]
        if some:
            yield some


def occurrences(docs: DataFrame, text: str, shared, grams: int) -> tuple[np.ndarray, int]:
    """By n-gram of the block, its occurrences in all documents, and the number of their words:
    all are read, each task adds up its own."""
    def run(batches):
        sums = np.zeros(grams, np.int64)
        for b in batches:
            ids, starts = shared.value.ids(b.column(0).to_pylist())
            sums += np.bincount(shared.value.grams_of(ids)[1], minlength=grams)
            sums[0] += len(ids) - len(starts)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["gram", "n"])

    out = np.zeros(grams, np.int64)
    for r in docs.select(common.text_of(text).alias("text")).mapInArrow(run, "gram long, n long") \
            .groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    words, out[0] = int(out[0]), 0
    return out, words


def _block_matches(docs: DataFrame, block: list[tuple], text: str, carry, threshold) -> DataFrame:
    spark = docs.sparkSession
    plain = Block(block)                                    # bounded by BLOCK_CHARS, as what follows
    shared = spark.sparkContext.broadcast(plain)
    seeds = spark.sparkContext.broadcast(Seeds(plain, *occurrences(docs, text, shared, plain.grams), threshold))
    shared.unpersist()

    def find(texts):
        return [seeds.value.passages(texts)]

    found = common.add_columns(docs, {"text": common.text_of(text)}, find, [common.field("found", CANDIDATE)], carry)
    found = common.materialise(found.where(F.size("found") > 0).withColumn("doc", F.expr("uuid()")), "candidates")
    passages = found.select("row", "doc", F.explode("found").alias("c")).select("row", "doc", "c.*")

    def score(items, passages):
        known, out = seeds.value.items, []
        for n, p in zip(items, passages):
            s, a, b = align(known[n], p)
            out.append((s / (MATCH * len(known[n])), a, b))
        return [list(c) for c in zip(*out)] if out else [[], [], []]

    distinct = passages.select("item", "passage").distinct()
    scored = common.add_columns(distinct, {"item": F.col("item"), "passage": F.col("passage")}, score, [
        common.field("score", T.DoubleType()), common.field("a", T.LongType()), common.field("b", T.LongType())])
    scored = common.materialise(scored.where(F.col("score") >= threshold).select("row.*", "score", "a", "b"), "scored")
    seeds.unpersist()
    ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id long")
    hits = passages.join(scored, ["item", "passage"]).join(ids, "item") \
        .withColumn("first_word", F.col("first") + F.col("a")).withColumn("end_word", F.col("first") + F.col("b"))
    best = F.max_by(F.struct("row", "n_seeds", "score", "first_word", "end_word"),
                    F.struct(F.col("score"), -F.col("first_word")))
    return hits.groupBy("doc", "item_id").agg(best.alias("b")).select("b.row", "doc", "item_id", "b.n_seeds",
                                                                      "b.score", "b.first_word", "b.end_word")


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            threshold: float = THRESHOLD, carry: list[str] | None = None,
            block_chars: int = BLOCK_CHARS) -> DataFrame | None:
    """``row``, ``item_id``, ``n_seeds``, ``score`` and the words ``first_word`` to
    ``end_word`` of each document that holds an item. None if there is no item."""
    out = None
    for block in blocks_of(items, item_id, item_text, block_chars):
        some = _block_matches(docs, block, text, carry, threshold).drop("doc")
        out = some if out is None else out.unionByName(some)
    return out


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = matches(docs, common.table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_seeds int, score double, first_word long, end_word long")
    return found.select("row.doc_id", "item_id", "n_seeds", "score", "first_word", "end_word")


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item. A row goes if an equal row holds
    one; rows are compared whole, their hash only brings them together."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), common.text_of().alias("text"))
    found = matches(packed, common.table(spark, sf_dir, "benchmark"), carry=["row"])
    if found is None:
        return docs
    held = found.select(F.col("row.row").alias("other")).distinct()
    alike = (F.xxhash64("row") == F.xxhash64("other")) & F.col("row").eqNullSafe(F.col("other"))
    return packed.join(held, alike, "left_anti").select("row.*")
