"""Token-ID files (operator 1): an adaptive context-mixing range coder over blocks of ids.

**Model.** After two ids, the id that last followed both of them (order 2) and the id that
last followed the second one (order 1) are predicted, each with a count of how often that
held. One of three outcomes is coded: the order-2 prediction, the order-1 prediction, or
neither. Its probabilities are a mixture of three adaptive tables: by the order-2 count, by
the order-1 count and whether both predictions agree, and without context (order 0). The
mixture's weights follow how well each table did (a Bayesian update). Where neither holds,
the id is coded by its frequency in the block so far (order 0). An id that the block has not
had takes a place kept for new ones and is spelled in the block's list of new ids: its high
bits by adaptive frequencies, the others as they are. Predictions follow every id; tables of
frequencies and weights take in what was coded after each span of ids, a third as long as all
before it. All arithmetic is in integers, so every machine decodes alike.

**Blocks.** A shard's ids are cut into blocks of 1,024 to 4,096. Model and coder start afresh
in each; a block carries its length and the crc32 of its ids, and is decoded alone. As blocks
don't depend on each other, numpy codes up to ``LANES`` of them side by side, one id of each
at a time.

**Files.** A folder of Parquet files, one row a block: ``shard``, ``block``, ``starts`` (ids
and places of the documents that begin in it) and ``data`` (header and payload). Shards are
ranges of documents in ascending id order; within one, blocks follow each other.

Defined results: a null text counts as empty and is its end id alone; documents with equal ids
follow each other by a hash of their text, null ids come first; documents of any length may
span blocks; an empty table writes no block and reads as an empty table. Extra columns are
not stored.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END_ID = 0
LANES = 1024
SHORTEST, LONGEST = 1024, 4096      # ids of a block
SLOTS = 4096                        # predictions that a context table holds
MAGIC = b"IDC2"
HEADER = struct.Struct("<4sBxHIIII")    # magic, digits, new ids, ids, bytes, bytes of the new ids, crc32
SPAN = 16                           # steps whose intervals are computed at a time
BITS = 14                           # probabilities of outcomes are parts of 1 << BITS
ONE = 1 << BITS
HIGH = 6                            # bits of a new id that are coded by adaptive frequencies
PLACES = (1 << 13) - 1
COUNT = 13                          # bits of a place in a table of shares
WORD, LEAST_RANGE = np.uint64(32), np.uint64(1 << 32)
OUTCOME = np.uint64(BITS)


class Encoder:
    """A 64-bit range coder per lane that moves 32-bit words, over numpy arrays. A carry out of
    the range goes into the words that are out. ``lanes`` is a slice or an array of lanes."""

    def __init__(self, room: np.ndarray):
        lanes = len(room)
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.start = np.cumsum(room) - room
        self.at = self.start.copy()
        self.out = np.zeros(int(room.sum()), "<u4")

    def carry(self, lanes):
        at = self.at[lanes] - 1
        while len(at):
            self.out[at] += np.uint32(1)
            at = at[self.out[at] == 0] - 1

    def narrow(self, lanes, edge, width, first, count, total):
        """Takes ``width`` parts of ``ONE`` from ``edge``, and of those ``count`` of ``total`` parts from ``first``."""
        part = self.range[lanes] >> OUTCOME
        unit = part * width
        unit //= total
        part *= edge
        part += unit * first
        low = self.low[lanes] + part
        over, = (low < part).nonzero()
        if len(over):
            self.carry(over)
        unit *= count
        due, = (unit < LEAST_RANGE).nonzero()
        at, word = self.at[due], low[due]
        self.out[at] = word >> WORD
        self.at[due] = at + 1
        low[due] = word << WORD
        unit[due] = unit[due] << WORD
        self.low[lanes], self.range[lanes] = low, unit

    def close(self) -> list[bytes]:
        """The words of each lane; the last is the shortest that names its range."""
        low = self.low + np.uint64(0xFFFFFFFF)
        self.carry(np.flatnonzero(low < self.low))
        self.out[self.at] = low >> WORD
        return [self.out[a:b].tobytes() for a, b in zip(self.start.tolist(), (self.at + 1).tolist())]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        words = np.fromiter(map(len, payloads), np.int64, len(payloads)) // 4 + 2
        self.data = np.frombuffer(b"".join(p + bytes(8) for p in payloads), "<u4").astype(np.uint64)
        start = np.cumsum(words) - words
        self.value = self.data[start] << WORD | self.data[start + 1]
        self.at = start + 2
        self.range = np.full(len(payloads), 0xFFFFFFFFFFFFFFFF, np.uint64)

    def shift(self, n, value, width):
        """Stores what is left of the first lanes' values and ranges; small ones get a word."""
        due, = (width < LEAST_RANGE).nonzero()
        at = self.at[due]
        # a damaged block may ask for more than there is
        value[due] = value[due] << WORD | self.data.take(at, mode="clip")
        width[due] = width[due] << WORD
        self.at[due] = at + 1
        self.value[:n], self.range[:n] = value, width

    def pick(self, value, width, rows, total, table):
        """The entries of ``table`` (see ``shares``) that the values lie in, and what is left."""
        unit = width // total
        spot = np.minimum(value // unit, total - np.uint64(1)).astype(np.int64)
        held = table.take(rows + spot)
        value = value - (held >> COUNT & (1 << COUNT) - 1).astype(np.uint64) * unit
        return held >> 2 * COUNT, value, (held & (1 << COUNT) - 1).astype(np.uint64) * unit


def epochs(steps: int):
    """Spans of steps, each a third of all before."""
    a = 0
    while a < steps:
        b = min(steps, a + max(16, a // 3))
        yield a, b
        a = b


class Outcomes:
    """Adaptive frequencies of the three outcomes by lane: in all, by the order-1 count and
    whether both predictions agree, by the order-2 count; and the weights they are mixed with."""

    LEAST = 64

    def __init__(self, lanes: int):
        self.seen = np.zeros((lanes, 8, 4, 3), np.int32)
        self.weights = np.full((3, lanes, 1, 1, 1), ONE // 3, np.int32)
        self.mix()

    def mix(self):
        n = self.seen
        parts = []
        for by in ((1, 2), 2, 1):
            held = n.sum(axis=by, keepdims=True, dtype=np.int32) * 2 + 1
            parts.append(self.LEAST + held * (ONE - 3 * self.LEAST) // held.sum(axis=3, keepdims=True, dtype=np.int32))
        w = self.weights
        mixed = w[0] * parts[0] + w[1] * parts[1]
        mixed = (mixed + w[2] * parts[2]) // w.sum(axis=0)
        mixed[..., 2] = ONE - mixed[..., 0] - mixed[..., 1]
        self.parts, self.mixed = parts, mixed
        first = mixed[..., 0].reshape(-1)
        #: by lane and context, the two edges between the outcomes
        self.first, self.second = first.astype(np.int64), (first + mixed[..., 1].reshape(-1)).astype(np.int64)

    def learn(self, seen):
        """``seen``: by step and lane, context * 3 + outcome, of the first lanes."""
        k = seen.shape[1]
        n = np.bincount((seen + np.arange(k) * 96).reshape(-1), minlength=len(self.seen) * 96)
        n = n.reshape(self.seen.shape).astype(np.int32)
        for w, p in zip(self.weights, self.parts):
            gain = (n * (p - self.mixed)).sum(axis=(1, 2, 3), keepdims=True)
            w += (gain >> 4).astype(np.int32)
            np.clip(w, ONE >> 6, ONE, out=w)
        self.seen += n
        self.mix()


class Contexts:
    """By lane, the id (plus one) that last followed one and two ids, with a count."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes) * SLOTS + np.array([[0], [lanes * SLOTS]])
        self.held = np.zeros(2 * lanes * SLOTS, np.int32)
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, k):
        """Predictions after one and after two ids, and the context of the outcome."""
        hash1 = self.one[:k] * 40503
        slot = np.empty((2, k), np.int64)
        slot[0] = hash1
        np.bitwise_xor(hash1, self.two[:k] * 60493, out=slot[1])
        slot >>= 4
        slot &= SLOTS - 1
        slot += self.base[:, :k]
        held = self.held.take(slot)
        known, count = held >> 2, held & 3
        context = count[0] * 8 + count[1]
        context += (known[0] == known[1]) * np.int32(4)
        self.state = slot, known, count
        return known[0], known[1], context

    def learn(self, now):
        """``now``: the ids, plus one."""
        slot, known, count = self.state
        count += 1
        np.minimum(count, 3, out=count)
        new = np.ones_like(count)
        np.copyto(new, count, where=known == now)
        new += now << 2
        self.held[slot.reshape(-1)] = new.reshape(-1)
        self.two[:len(now)] = self.one[:len(now)]
        self.one[:len(now)] = now


def shares(runs, first, count):
    """One table of shares: by place, the entry that the place belongs to, its first place in
    the lane and how many it has."""
    return np.repeat(runs.astype(np.int64) << 2 * COUNT | first << COUNT | count, count)


def spell(lists: list[np.ndarray], digits: int) -> list[bytes]:
    """Codes the new ids of each lane: their high bits by adaptive frequencies."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max())
    ids = np.zeros((steps, len(lists)), np.uint64)
    for lane, k in enumerate(order.tolist()):
        ids[:lengths[k], lane] = lists[k]
    low = max(0, 4 * digits - HIGH)
    high, rest = (ids >> np.uint64(low)).astype(np.int64), ids & np.uint64((1 << low) - 1)
    coder, counts = Encoder(2 * lengths[order] + 4), np.ones((len(lists), 1 << HIGH), np.int64)
    ends = active(lengths[order], steps)
    full, none, total = np.uint64(ONE), np.uint64(0), np.uint64(1 << low)
    for a, b in epochs(steps):
        k = ends[a]
        edges = (np.cumsum(counts, axis=1) - counts).reshape(-1).astype(np.uint64)
        parts = counts.reshape(-1).astype(np.uint64)
        row = np.arange(k) << HIGH
        for t in range(a, b):
            n = ends[t]
            at = row[:n] + high[t, :n]
            lanes = slice(0, n)
            coder.narrow(lanes, none, full, edges.take(at), parts.take(at), np.uint64((1 << HIGH) + a))
            coder.narrow(lanes, none, full, rest[t, :n], np.uint64(1), total)
        counts += np.bincount((row + high[a:b, :k]).reshape(-1), minlength=counts.size).reshape(counts.shape)
    out = [b""] * len(lists)
    for k, data in zip(order.tolist(), coder.close()):
        out[k] = data
    return out


def unspell(payloads: list[bytes], lengths: np.ndarray, digits: int) -> np.ndarray:
    """The new ids of each lane, lane after lane."""
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max())
    low = max(0, 4 * digits - HIGH)
    coder, counts = Decoder([payloads[k] for k in order.tolist()]), np.ones((len(lengths), 1 << HIGH), np.int64)
    out = np.zeros((steps, len(lengths)), np.int64)
    ends, total = active(lengths[order], steps), np.uint64(1 << low)
    row = np.arange(len(lengths))
    for a, b in epochs(steps):
        k = ends[a]
        mine = counts[:k].reshape(-1)
        first = (np.cumsum(counts[:k], axis=1) - counts[:k]).reshape(-1)
        table = shares(np.tile(np.arange(1 << HIGH), k), first, mine)
        size = (1 << HIGH) + a
        for t in range(a, b):
            n = ends[t]
            lanes = slice(0, n)
            high, value, width = coder.pick(coder.value[lanes], coder.range[lanes] >> OUTCOME << OUTCOME,
                                            row[:n] * size, np.uint64(size), table)
            coder.shift(n, value, width)
            unit = (coder.range[lanes] >> OUTCOME << OUTCOME) // total
            rest = np.minimum(coder.value[lanes] // unit, total - np.uint64(1))
            coder.shift(n, coder.value[lanes] - rest * unit, unit)
            out[t, :n] = high << low | rest.astype(np.int64)
        counts += np.bincount(((row[:k] << HIGH) + (out[a:b, :k] >> low)).reshape(-1),
                              minlength=counts.size).reshape(counts.shape)
    back = np.empty_like(order)
    back[order] = row
    return out.T[back][np.arange(steps) < lengths[:, None]]


def active(lengths, steps):
    """How many lanes, whose lengths fall, have an id at each step."""
    return np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right").tolist()


def _places(ids, lengths):
    """By lane, the number of each id among the lane's ids in ascending order, and how many there are at most."""
    steps = ids.shape[1]
    bits = max(1, (steps - 1).bit_length())
    packed = ids.astype(np.int64) << bits | np.arange(steps)
    if int(ids.max()) >> (31 - bits) == 0:
        packed = packed.astype(np.int32)
    packed.sort(axis=1)
    fresh = np.zeros(ids.shape, np.int16)
    np.not_equal(packed[:, 1:] >> bits, packed[:, :-1] >> bits, out=fresh[:, 1:], casting="unsafe")
    place = np.cumsum(fresh, axis=1, dtype=np.int16)
    out = np.empty(ids.shape, np.int16)
    np.put_along_axis(out, (packed & (1 << bits) - 1).astype(np.int64), place, axis=1)
    return out, int(place.max()) + 1


def _encode(ids: np.ndarray, lengths: np.ndarray, digits: int):
    """Payloads of the blocks and of their new ids. A row of ``ids`` a block; ``lengths`` fall."""
    lanes, steps = ids.shape
    place, size = _places(ids, lengths)
    place, ids = np.ascontiguousarray(place.T), np.ascontiguousarray(ids.T, np.int32)
    coder, contexts, outcomes = Encoder(lengths + 4), Contexts(lanes), Outcomes(lanes)
    ends, number = active(lengths, steps), np.arange(lanes)
    counts, escape = np.zeros(lanes * size, np.int64), np.ones(lanes, np.int64)
    new_lanes, new_ids = [], []
    for a, b in epochs(steps):
        k = ends[a]
        seen, new = np.zeros((b - a, k), np.int64), np.zeros((b - a, k), bool)
        held = counts.reshape(lanes, size)
        below, row = (np.cumsum(held, axis=1) - held).reshape(-1), number[:k] * size
        for c in range(a, b, SPAN):
            d = min(b, c + SPAN)
            given = seen[c - a:d - a]
            for t, context in enumerate(given, c):
                n = ends[t]
                id1, id2, found = contexts.predict(n)
                now = ids[t, :n] + 1
                outcome = (now != id2).view(np.int8)
                outcome += outcome & (now != id1)
                found *= 3
                found += outcome
                context[:n] = found
                contexts.learn(now)
            # the span's intervals
            mine = row + place[c:d, :k]
            at = given // 3
            outcome = given - at * 3
            at += number[:k] * 32
            first, second = outcomes.first.take(at), outcomes.second.take(at)
            last = outcome == 2
            edge, width = first.copy(), second - first
            np.copyto(edge, 0, where=outcome == 0)
            np.copyto(width, first, where=outcome == 0)
            np.copyto(edge, second, where=last)
            np.copyto(width, ONE - second, where=last)
            first, count = below.take(mine), counts.take(mine)
            mine = last & (count == 0)
            np.copyto(first, a, where=mine)
            np.copyto(count, escape[:k], where=mine)
            total = np.ones_like(count)
            np.copyto(total, a + escape[:k], where=last)
            np.copyto(first, 0, where=~last)
            np.copyto(count, 1, where=~last)
            mine &= np.arange(c, d)[:, None] < lengths[:k]
            new[c - a:d - a] = mine
            rows = [x.view(np.uint64) for x in (edge, width, first, count, total)]
            for t in range(c, d):
                n = ends[t]
                coder.narrow(slice(0, n), *[x[t - c, :n] for x in rows])
        # ids that are new, lane after lane
        lane, step = np.nonzero(new.T)
        new_lanes.append(lane)
        new_ids.append(ids[a + step, lane])
        if b < steps:
            k = ends[b]
            outcomes.learn(seen[:, :k])
            counts += np.bincount((row[:k] + place[a:b, :k]).reshape(-1), minlength=len(counts))
            escape[:k] = escapes(b, new[:, :k].sum(axis=0), (seen[:, :k] % 3 == 2).sum(axis=0))
    lane, new = np.concatenate(new_lanes), np.concatenate(new_ids)
    order = np.argsort(lane, kind="stable")
    edges = np.searchsorted(lane[order], np.arange(1, lanes))
    return coder.close(), np.split(new[order], edges)


def escapes(seen: int, new, unpredicted):
    """Places of new ids beside those ``seen``, after the share of new ones in the last span."""
    return np.minimum(1 + seen * new // np.maximum(1, unpredicted - new), (1 << COUNT) - 1 - seen)


def _decode(payloads, lengths, new_ids, new_counts):
    lanes, steps = len(payloads), int(lengths[0])
    coder, contexts, outcomes = Decoder(payloads), Contexts(lanes), Outcomes(lanes)
    out = np.zeros((steps, lanes), np.int32)
    ends, number = active(lengths, steps), np.arange(lanes)
    new_ids = (np.append(new_ids, 0) + 1).astype(np.int32)
    new_at = np.cumsum(new_counts) - new_counts
    escape = np.ones(lanes, np.int64)
    for a, b in epochs(steps):
        k = ends[a]
        seen, new, whole = np.zeros((b - a, k), np.int64), new_at[:k].copy(), np.uint64(a)
        # the table of shares: a row's ids in ascending order, at last the new ones
        held = np.full((k, a + 1), 0x7FFFFFFF, np.int32)
        held[:, :a] = out[:a, :k].T
        held.sort(axis=1)
        flat = held.reshape(-1)
        fresh = np.ones(flat.size, bool)
        np.not_equal(flat[1:], flat[:-1], out=fresh[1:])
        fresh[::a + 1] = True
        runs = np.flatnonzero(fresh)
        last = flat[runs] == 0x7FFFFFFF
        first = runs % (a + 1)
        count = np.diff(runs, append=flat.size)
        value = flat[runs].astype(np.int64)
        value[last] = 0
        share = count.copy()
        share[last] = escape[:k]
        table = np.repeat(value << 2 * COUNT | first << COUNT | share, count)
        row, total = number[:k] * (a + 1), (a + escape[:k]).astype(np.uint64)
        place = number[:k] * 32
        for t in range(a, b):
            n = ends[t]
            id1, id2, context = contexts.predict(n)
            at = place[:n] + context
            first, second = outcomes.first.take(at).view(np.uint64), outcomes.second.take(at).view(np.uint64)
            part, value = coder.range[:n] >> OUTCOME, coder.value[:n]
            first *= part
            second *= part
            beyond, rest = value >= first, value >= second
            context *= 3
            context += beyond
            context += rest
            seen[t - a, :n] = context
            now, width, value = id2.copy(), first.copy(), value.copy()
            np.copyto(now, id1, where=beyond)
            np.copyto(width, second - first, where=beyond)
            np.copyto(value, value - first, where=beyond)
            # all lanes look an id up; those without a prediction take it
            part <<= OUTCOME
            part -= second
            part //= total[:n]
            left = coder.value[:n] - second
            spot = np.minimum(left // part, whole).view(np.int64)
            spot += row[:n]
            entry = table.take(spot)
            left -= (entry >> COUNT & PLACES).view(np.uint64) * part
            part *= (entry & PLACES).view(np.uint64)
            entry >>= 2 * COUNT
            np.copyto(now, entry, where=rest, casting="unsafe")
            np.copyto(value, left, where=rest)
            np.copyto(width, part, where=rest)
            fresh, = (now == 0).nonzero()
            if len(fresh):
                at = new_at[fresh]
                now[fresh] = new_ids.take(at, mode="clip")
                new_at[fresh] = at + 1
            coder.shift(n, value, width)
            out[t, :n] = now
            contexts.learn(now)
        if b < steps:
            k = ends[b]
            outcomes.learn(seen[:, :k])
            escape[:k] = escapes(b, new_at[:k] - new[:k], (seen[:, :k] % 3 == 2).sum(axis=0))
    return (out - 1).T


def digits_of(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 3) // 4)


def encode_blocks(ids: np.ndarray, digits: int = 4) -> list[bytes]:
    """Blocks (with headers) of up to ``LANES * LONGEST`` ids."""
    if not len(ids):
        return []
    size = min(LONGEST, max(SHORTEST, -(-len(ids) // LANES)))
    cuts = [ids[a:a + size] for a in range(0, len(ids), size)]
    lengths = np.array([len(c) for c in cuts])
    lanes = np.zeros((len(cuts), int(lengths[0])), np.int64)
    for row, c in zip(lanes, cuts):
        row[:len(c)] = c
    blocks, new = _encode(lanes, lengths, digits)
    spelled = spell(new, digits)
    return [HEADER.pack(MAGIC, digits, len(n), len(c), len(p) + len(s), len(s),
                        zlib.crc32(c.astype("<u4").tobytes())) + p + s
            for c, p, n, s in zip(cuts, blocks, new, spelled)]


def ids_in(block: bytes) -> int:
    return HEADER.unpack_from(block)[3]


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids (little-endian unsigned 32-bit) of each block, checked."""
    heads = [HEADER.unpack_from(b) for b in blocks]
    for b, (magic, _, new, n, size, own, _) in zip(blocks, heads):
        if magic != MAGIC or len(b) != HEADER.size + size or not 0 < n <= LONGEST or own > size or new > n:
            raise ValueError("not a block of ids")
    out: list = [None] * len(blocks)
    for digits in sorted({h[1] for h in heads}):
        order = sorted((k for k, h in enumerate(heads) if h[1] == digits), key=lambda k: -heads[k][3])
        lengths, new = np.array([heads[k][3] for k in order]), np.array([heads[k][2] for k in order])
        spelled = [len(blocks[k]) - heads[k][5] for k in order]
        new_ids = unspell([blocks[k][a:] for k, a in zip(order, spelled)], new, digits)
        rows = _decode([blocks[k][HEADER.size:a] for k, a in zip(order, spelled)], lengths, new_ids, new)
        for k, row in zip(order, rows):
            out[k] = row[:heads[k][3]].astype("<u4")
    for ids, (*_, crc) in zip(out, heads):
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's ids don't match its checksum")
    return out


# ---------------------------------------------------------------- Spark

BLOCKS = "shard int, block int, n_ids int, starts array<struct<doc_id:bigint,at:int>>, data binary"
_STARTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))


def write(docs: DataFrame, folder: str, path: str | None = None, text: str = "text",
          room: int = LANES * LONGEST) -> None:
    """Writes the ids of all documents, an ``END_ID`` after each, in ascending order of doc_id.
    ``room`` ids are coded at a time."""
    path = path or common.vocabulary("byte_bpe_50k.json")
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", common.text_of(text).alias("text")).repartitionByRange(F.col("doc_id"), tie) \
        .sortWithinPartitions(F.col("doc_id"), tie)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = common.piece_encoder(path)
        digits = digits_of(max(common.library_tokenizer(path).get_vocab().values()))
        shard, block = TaskContext.get().partitionId(), 0
        held, starts, size = [], [], 0          # ids, documents that begin in them, how many ids

        def flush(most):
            """Rows of the first ids that are held, ``most`` at most."""
            nonlocal block, held, starts, size
            ids = np.concatenate(held)
            ids, kept = ids[:most], ids[most:].copy()
            rows = [[], [], [], [], []]
            at, next_start = 0, 0
            for part in range(0, len(ids), room):
                for data in encode_blocks(ids[part:part + room], digits):
                    n = ids_in(data)
                    mine = []
                    while next_start < len(starts) and starts[next_start][1] < at + n:
                        mine.append({"doc_id": starts[next_start][0], "at": starts[next_start][1] - at})
                        next_start += 1
                    for column, value in zip(rows, (shard, block, n, mine, data)):
                        column.append(value)
                    at, block = at + n, block + 1
            held, size = [kept], len(kept)
            starts = [(doc_id, start - at) for doc_id, start in starts[next_start:]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.int32(), _STARTS, pa.binary()))],
                names=["shard", "block", "n_ids", "starts", "data"])

        for b in batches:
            doc_ids = iter(b.column(0).to_pylist())
            for counts, ids in encode.all(b.column(1).to_pylist(), end):
                starts += zip(doc_ids, (size + np.cumsum(counts) - counts).tolist())
                held.append(ids)
                size += len(ids)
                if size >= room:        # what does not fill it waits for more
                    yield flush(size // room * room)
        if size:
            yield flush(size)

    ordered.mapInArrow(run, BLOCKS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``shard``, ``at`` (its first id in the shard),
    ``n_tokens`` and ``ids_crc32``. A shard is read as a stream, ``LANES`` blocks at a time."""
    blocks = spark.read.schema(BLOCKS).parquet(folder).repartition("shard").sortWithinPartitions("shard", "block")

    def run(batches):
        rows = [[], [], [], [], []]
        doc, place = None, (None, 0)            # the open document; shard and ids of it so far

        def close():
            nonlocal doc
            if doc:
                for column, value in zip(rows, doc):
                    column.append(value)
            doc = None

        def take(held):
            nonlocal doc, place
            for (shard, starts, _), ids in zip(held, decode_blocks([h[2] for h in held])):
                if shard != place[0]:
                    close()
                    place = (shard, 0)
                edges = [s["at"] for s in starts] + [len(ids)]
                for k, a in enumerate([0, *edges[:-1]]):
                    b = edges[k] if k < len(edges) else len(ids)
                    if k:
                        close()
                        doc = [starts[k - 1]["doc_id"], shard, place[1] + a, 0, 0]
                    if b > a:
                        doc[3] += b - a
                        doc[4] = zlib.crc32(ids[a:b].tobytes(), doc[4])
                place = (shard, place[1] + len(ids))

        def batch():
            nonlocal rows
            out, rows = rows, [[], [], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

        held = []
        for b in batches:
            for shard, starts, data in zip(*[b.column(c).to_pylist() for c in ("shard", "starts", "data")]):
                held.append((shard, starts, data))
                if len(held) == LANES:
                    take(held)
                    held = []
                    yield batch()
        if held:
            take(held)
        close()
        yield batch()

    return blocks.mapInArrow(run, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")


def starts(documents: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before. One row a shard comes to the driver."""
    sizes = documents.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r.shard, before))
        before += r.n
    offsets = documents.sparkSession.createDataFrame(rows, "shard int, before long")
    return documents.join(F.broadcast(offsets), "shard").withColumn("start", F.col("before") + F.col("at"))


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "ids")
    write(common.table(spark, sf_dir, "documents"), folder)
    back = common.materialise(read(spark, folder), "read-ids")
    return starts(back).select("doc_id", "start", "n_tokens", "ids_crc32")
