"""BPE encoding and decoding (operator 7) through a minimal acyclic transducer.

Spark counts the words of all texts; the ``LEXICON`` most frequent are encoded once and
compiled into an acyclic automaton whose common suffixes are shared. Every arc carries the
number of lexicon words that sort before it, so a walk over a word's bytes adds up the
word's index, which points at its ids. The automaton is one file that each executor fetches
and maps into memory. Words that are not in it are merged by the vocabulary's ranks, so the
ids never depend on the lexicon.

Defined results: a null text counts as empty and has no ids; texts of any length are encoded
whole; strings of special tokens in a text become their ids, as the tokenizers library has
it; repeated rows repeat their result; empty tables give empty results. Extra columns travel
in ``row``.
"""
from __future__ import annotations

import functools
import heapq
import json
import mmap
import struct
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words in the automaton: a bound on its size (some MB), not on what is encoded.
LEXICON = 100_000
LONGEST = 48            # bytes of a word that may enter it
FLUSH = 500_000         # distinct words that a counting task holds at a time
SIDE_BY_SIDE = 1 << 14  # words that are merged at a time,
WIDTHS = (4, 8, 12, 16, 24, 32, 64)     # and their bytes; longer ones are merged alone


# ---------------------------------------------------------------- vocabulary

NONE = 1 << 62


class Vocabulary:
    """Byte-level BPE from a tokenizers file: token bytes by id, ranks of merges, specials."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in common.byte_letters().items()}
        raw = {t: bytes(back[c] for c in t) for t in spec["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        rank = {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}
        #: pair of ids -> rank of their merge and id of the merged token, in one number
        self.merged = {(self.id_of[a], self.id_of[b]): i << 32 | self.id_of[a + b] for (a, b), i in rank.items()}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        keys = np.array([a << 32 | b for a, b in self.merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_merges = np.array(list(self.merged.values()), np.int64)[order]
        self.pretoken = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged first, leftmost first."""
        single, get = self.single, self.merged.get
        ids = [single[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        found = [get(p, NONE) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == NONE:
                break
            i = found.index(best)
            ids[i:i + 2] = [best & 0xFFFFFFFF]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, as little-endian unsigned 32-bit integers: words of about the
        same length are merged side by side."""
        out: list = [None] * len(words)
        size, least = np.fromiter(map(len, words), np.int64, len(words)), -1
        for width in (*WIDTHS, None):
            mine = np.flatnonzero((size > least) & (size <= width) if width else size > least).tolist()
            least = width
            if width:
                for a in range(0, len(mine), SIDE_BY_SIDE):
                    part = mine[a:a + SIDE_BY_SIDE]
                    for i, ids in zip(part, self._side_by_side([words[i] for i in part], width)):
                        out[i] = ids
            else:
                for i in mine:
                    out[i] = array("I", self.merge(words[i])).tobytes()
        return out

    def _merges(self, left, right):
        """Rank and new id of each pair, in one number; ``NONE`` where there is no merge."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_merges[at], NONE)

    @functools.cached_property
    def _first_merges(self):
        """``_merges`` of every two bytes."""
        single = np.array(self.single, np.int64)
        return self._merges(np.repeat(single, 256), np.tile(single, 256))

    def _side_by_side(self, words: list[bytes], width: int):
        """A row a word, with an empty place (id -1) at either side. Places are linked; a step
        merges the leftmost pair of lowest rank of every row that has one."""
        n, row = len(words), width + 2
        size = np.fromiter(map(len, words), np.int64, n)[:, None]
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int64)
        place = np.arange(width)
        ids = np.full((n, row), -1, np.int64)
        ids[:, 1:-1] = np.where(place < size, np.array(self.single, np.int64)[raw], -1)
        found = np.full((n, row), NONE)
        found[:, 1:-2] = np.where(place[1:] < size, self._first_merges[raw[:, :-1] << 8 | raw[:, 1:]], NONE)
        ids, found, after, before = ids.reshape(-1), found.reshape(-1), np.arange(1, n * row + 1), np.arange(-1, n * row - 1)
        live = np.arange(n)
        while True:
            mine = found.reshape(n, row)[live]
            at = live * row + mine.argmin(axis=1)
            best = found[at]
            more = best != NONE
            if not more.any():
                break
            live, at, best = live[more], at[more], best[more]
            new, gone = best & 0xFFFFFFFF, after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone], found[gone] = new, -1, NONE
            after[at], before[right] = right, at
            found[at] = self._merges(new, ids[right])
            found[left] = self._merges(ids[left], new)
        kept = ids >= 0
        edges = [0, *(np.cumsum(kept.reshape(n, row).sum(axis=1)) * 4).tolist()]
        data = ids[kept].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for long words, with a heap of pairs over a linked list."""
        end, heap = len(ids), []
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))

        def push(i):
            j = after[i]
            if j < end and (found := self.merged.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (found >> 32, i, ids[i], ids[j], found & 0xFFFFFFFF))

        for i in range(end):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if j >= end or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < end:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x in ids if x >= 0]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# ---------------------------------------------------------------- transducer

def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, with ids, as one file.

    Words come in order; once the next word leaves a branch, the branch's states are looked
    up among those that exist, last first, so that equal suffixes share their states."""
    words = sorted(entries)
    root: list = [False, {}]                    # a state: final, arcs byte -> state
    known: dict[tuple, list] = {}
    path = [root]

    def close(depth):
        while len(path) > depth + 1:
            state = path.pop()
            sign = (state[0], tuple((b, id(s)) for b, s in state[1].items()))
            same = known.setdefault(sign, state)
            if same is not state:
                label = next(reversed(path[-1][1]))
                path[-1][1][label] = same

    last = b""
    for word in words:
        common_length = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(common_length)
        for b in word[common_length:]:
            state = [False, {}]
            path[-1][1][b] = state
            path.append(state)
        path[-1][0] = True
        last = word
    close(0)

    order, number, stack = [], {}, [root]       # states in the order of their numbers
    while stack:
        state = stack.pop()
        if id(state) in number:
            continue
        number[id(state)] = len(order)
        order.append(state)
        stack.extend(state[1].values())
    below: dict[int, int] = {}                  # words that end in or after a state

    def count(state):
        todo = [state]
        while todo:
            s = todo[-1]
            missing = [x for x in s[1].values() if id(x) not in below]
            if missing:
                todo.extend(missing)
            else:
                below[id(s)] = s[0] + sum(below[id(x)] for x in s[1].values())
                todo.pop()

    count(root)
    first, labels, targets, skips = [0], bytearray(), [], []
    for state in order:
        seen = int(state[0])
        for b, s in state[1].items():
            labels.append(b)
            targets.append(number[id(s)])
            skips.append(seen)
            seen += below[id(s)]
        first.append(len(labels))
    ids = [entries[w] for w in words]
    starts = np.cumsum([0, *map(len, ids)])
    pad = bytes(-(len(order) + len(labels)) % 4)
    arrays = [first, targets, skips, starts, [i for x in ids for i in x]]
    return b"".join([
        struct.pack("<4I", len(order), len(labels), len(words), int(starts[-1])),
        *[np.asarray(a, dtype="<u4").tobytes() for a in arrays],
        bytes(s[0] for s in order), bytes(labels), pad])


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    ONE = [bytes([b]) for b in range(256)]

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, self.size, ids = struct.unpack_from("<4I", self.map)
        self.states, at, view, parts = states, 16, memoryview(self.map), []
        for n in (states + 1, arcs, arcs, self.size + 1, ids):
            parts.append(view[at:at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.skip, self.start, self.out = parts
        self.final, self.labels = at, at + states
        first = np.asarray(self.first).astype(np.int64)
        self.keys = np.repeat(np.arange(states), np.diff(first)) << 8 \
            | np.frombuffer(self.map, np.uint8, arcs, self.labels)     # state and byte of each arc, ascending

    def index(self, word: bytes) -> int | None:
        state, index, base = 0, 0, self.labels
        first, find = self.first, self.map.find
        for b in word:
            k = find(self.ONE[b], base + first[state], base + first[state + 1]) - base
            if k < 0:
                return None
            index += self.skip[k]
            state = self.target[k]
        return index if self.map[self.final + state] else None

    def indexes(self, words: list[bytes]) -> np.ndarray:
        """``index`` of each word, -1 where it is not in here: all walk a byte at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, raw = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
        state, index = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        skip, target = np.asarray(self.skip), np.asarray(self.target)
        live, step = np.flatnonzero(size), 0
        while len(live):
            key = state[live] << 8 | raw[start[live] + step]
            arc = np.searchsorted(self.keys, key)
            known = arc < len(self.keys)
            known[known] = self.keys[arc[known]] == key[known]
            state[live[~known]] = -1
            live, arc, step = live[known], arc[known], step + 1
            index[live] += skip[arc]
            state[live] = target[arc]
            live = live[size[live] > step]
        final = np.frombuffer(self.map, np.uint8, self.states, self.final)
        return np.where((state >= 0) & (final[state] != 0), index, -1)

    def ids(self, word: bytes):
        i = self.index(word)
        return None if i is None else self.out[self.start[i]:self.start[i + 1]]


# ---------------------------------------------------------------- Spark

def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of all words (cut at white space) of all texts."""
    def run(batches):
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(t.split())
            if len(counts) > FLUSH:
                yield rows()
                counts.clear()
        yield rows()

    counted = docs.select(common.text_of(text).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON) -> str:
    """Counts words, compiles the most frequent (``size`` at most) with their ids, and shares
    the file."""
    vocab = vocabulary(path)
    counts = common.materialise(word_counts(docs, text).where(F.octet_length("word") <= LONGEST), "words")
    # the most frequent words by classes of counts: so few classes that the driver can add them up
    level = F.floor(F.log2("n") * 16)
    room, least = size, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r.level
    often = counts.where(level >= least).orderBy("word").collect() if least is not None else []
    raws = list({pre.encode("utf-8") for row in often for chunk in (" " + row.word, row.word)
                 for pre in vocab.pretoken.findall(chunk)})
    entries = {raw: np.frombuffer(ids, "<u4").tolist() for raw, ids in zip(raws, vocab.merge_all(raws))}
    return common.share_bytes(docs.sparkSession, compile_lexicon(entries), "lexicon")


def encoder(path: str, lexicon: Lexicon | None) -> common.TextEncoder:
    """text -> ids as little-endian unsigned 32-bit integers."""
    vocab, findall = vocabulary(path), common.chunk_pattern().findall
    special = {s: np.array([i], "<u4").tobytes() for s, i in vocab.special.items()}

    def encode(raws):
        """Ids of pre-tokens: by the lexicon, and of those that it lacks by merges."""
        if lexicon is None:
            return vocab.merge_all(raws)
        at, start, ids = lexicon.indexes(raws).tolist(), lexicon.start, lexicon.out
        merged = iter(vocab.merge_all([raw for raw, i in zip(raws, at) if i < 0]))
        return [next(merged) if i < 0 else ids[start[i]:start[i + 1]].tobytes() for i in at]

    def make(chunks):
        pres = [[] if c in special else [c] if c.removeprefix(" ").isalpha() else vocab.pretoken.findall(c)
                for c in chunks]
        done = iter(encode([pre.encode("utf-8") for mine in pres for pre in mine]))
        return [next(done) if len(mine) == 1 else special[c] if c in special else b"".join(next(done) for _ in mine)
                for c, mine in zip(chunks, pres)]

    def cut(text):
        if vocab.specials is None or not vocab.specials.search(text):
            return findall(text)
        return [c for part in vocab.specials.split(text) for c in ([part] if part in special else findall(part))]

    return common.TextEncoder(cut, make, 150_000)


@functools.lru_cache(maxsize=1)
def _shared_encoder(path: str, name: str):
    return encoder(path, Lexicon(SparkFiles.get(name)))


@functools.lru_cache(maxsize=1)
def _token_bytes(path: str) -> pa.Array:
    known = vocabulary(path).bytes_of
    return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.large_binary())


def _decoded(rows: list[bytes], tokens: pa.Array) -> list[str]:
    """Texts of the ids of each row, looked up together."""
    found = tokens.take(pa.array(np.frombuffer(b"".join(rows), "<u4")))
    _, offsets, data = found.buffers()
    start = np.frombuffer(offsets, np.int64)[np.cumsum([0, *[len(r) // 4 for r in rows]])].tolist()
    data = memoryview(data or b"")
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(start, start[1:])]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", size: int = LEXICON,
           carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``ids`` (binary, little-endian unsigned 32-bit) of each whole text."""
    path = path or common.vocabulary("byte_bpe_50k.json")
    name = build_lexicon(docs, path, text, size)

    def run(texts):
        return [_shared_encoder(path, name).all(texts)]

    return common.add_columns(docs, {"text": common.text_of(text)}, run,
                              [common.field("ids", T.BinaryType())], carry)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids",
           carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``decoded``, the text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
    path = path or common.vocabulary("byte_bpe_50k.json")

    def run(rows):
        tokens, out, held, room = _token_bytes(path), [], [], common.GROUP
        for r in rows:
            if held and len(r or b"") > room:
                out += _decoded(held, tokens)
                held, room = [], common.GROUP
            held.append(r or b"")
            room -= len(held[-1])
        return [out + _decoded(held, tokens)]

    return common.add_columns(encoded, {"ids": F.col(ids)}, run,
                              [common.field("decoded", T.StringType())], carry)


def digests(docs: DataFrame) -> DataFrame:
    encoded = encode(docs, carry=["doc_id"]).select(
        "row.doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), "ids")
    back = decode(encoded, carry=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("row.*", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: tokens of every document that is left."""
    return digests(docs)
