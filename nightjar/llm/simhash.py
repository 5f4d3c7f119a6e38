"""SimHash near-duplicates (operator 8) with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to ``PIVOTS`` reference fingerprints.
By the triangle inequality two fingerprints at distance d differ by at most d in each of
those coordinates, so a pair whose largest coordinate difference is over the allowed bits is
discarded; survivors are verified bit by bit.

A coordinate alone keeps over half of all random pairs, so pairs are not taken from all
against all: the 64 bits are cut into ``BLOCKS`` blocks, and fingerprints at ``max_bits`` or
fewer differing bits agree in at least ``BLOCKS - max_bits`` of them. Each choice of so many
blocks is a key, and the pivot test runs inside the groups of a key. No link is lost by that.
A group over ``TILE`` fingerprints is cut into tiles, and each pair of tiles is a group of its
own. A group emits links that connect what it found, at most one per fingerprint, not pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero,
which links like any other; documents with a null id get the component of their fingerprint,
and a component's id ignores them (null if it has no other); repeated rows and equal ids stay
rows of their own; empty tables give empty results. Extra columns travel in ``row``.
"""
from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

WORDS = 4           # words of a shingle
MAX_BITS = 4
PIVOTS = 16
BLOCKS = 6
TILE = 4096
STEP = 1 << 15      # shingles whose bits are unpacked at a time


def fingerprint(text: str, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of a whole text: XXH64 (seed 42) of its word shingles."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[islice(w, i, None) for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    ones, n = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    for _ in range(0, n, STEP):
        some = np.fromiter(islice(hashes, STEP), dtype=">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS,
                 carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``fp`` (signed 64 bits) of each whole text."""
    return common.add_columns(docs, {"text": common.text_of(text)},
                              lambda texts: [[fingerprint(t, words) for t in texts]],
                              [common.field("fp", T.LongType())], carry)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: fixed, spread over all bits."""
    return [int(x) for x in np.random.default_rng(42).integers(-2 ** 63, 2 ** 63 - 1, n, dtype=np.int64)]


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of every choice of ``blocks - max_bits`` blocks, as signed 64-bit integers."""
    if blocks <= max_bits:
        raise ValueError("there must be more blocks than differing bits")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def distance_table(prints: DataFrame, n: int = PIVOTS) -> DataFrame:
    """``fp`` and ``d``, its distances to the pivots, for each distinct fingerprint."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots(n)]
    return prints.select("fp").distinct().select("fp", F.array(*distance).alias("d"))


def _bits(x: np.ndarray) -> np.ndarray:
    """Ones of signed 64-bit integers (numpy counts those of the absolute value)."""
    return np.bitwise_count(x.view(np.uint64))


def _connect(fps, d, side, max_bits):
    """Links that connect the fingerprints of one group. ``side``: 0 or 1 for the tiles of a
    pair, of which only pairs across count, or -1 for all."""
    n = len(fps)
    root = np.arange(n)
    for i in range(n - 1):
        if side[i] == 1:
            continue
        j = np.arange(i + 1, n) if side[i] < 0 else np.flatnonzero(side == 1)
        for k in range(d.shape[1]):                 # largest coordinate difference
            j = j[np.abs(d[j, k] - d[i, k]) <= max_bits]
            if not len(j):
                break
        j = j[_bits(fps[j] ^ fps[i]) <= max_bits]        # survivors
        if len(j):
            met = np.unique(np.append(root[j], root[i]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    linked = np.flatnonzero(root != np.arange(n))
    return fps[root[linked]], fps[linked]


def _small_groups(fps, d, starts, sizes, max_bits):
    """Links of many small groups at once: all pairs of each, discarded and verified."""
    us, vs = [], []
    for size in np.unique(sizes):
        at = starts[sizes == size]
        a, b = np.triu_indices(size, 1)
        for part in np.array_split(at, max(1, len(at) * len(a) // 500_000)):
            i, j = (part[:, None] + a).ravel(), (part[:, None] + b).ravel()
            for k in range(d.shape[1]):
                keep = np.abs(d[i, k] - d[j, k]) <= max_bits
                i, j = i[keep], j[keep]
            keep = _bits(fps[i] ^ fps[j]) <= max_bits
            us.append(fps[i[keep]])
            vs.append(fps[j[keep]])
    return us, vs


def links(table: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``(u, v)`` links at ``max_bits`` or fewer bits that connect all linked fingerprints."""
    masks = block_masks(blocks, max_bits)
    keyed = table.select("fp", "d", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(masks)])).alias("k")).select("fp", "d", "k.t", "k.key")
    big = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    big = big.select("t", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = keyed.join(big, ["t", "key"], "left").withColumn("own", F.when(F.col("tiles").isNotNull(), own))
    spread = tiled.select("fp", "d", "t", "key", "own", F.explode(F.when(
        F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("tiles") - 1))).alias("other"))
    grouped = spread.select(
        "fp", "d", "t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("own").isNull() | (F.col("own") == F.col("other")), F.lit(-1))
        .when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"))
    shuffled = grouped.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")

    def run(batches):
        tail = None

        def solve(t, last):
            """Links of the groups in ``t``; the last group is kept back unless ``last``."""
            keys = [t.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("t", "key", "a", "b")]
            new = np.zeros(len(keys[0]), bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            if not last:
                rest, starts_done, end = t.slice(int(starts[-1])), starts[:-1], int(starts[-1])
            else:
                rest, starts_done, end = None, starts, len(new)
            sizes = np.diff(np.append(starts_done, end))
            fps = t.column("fp").to_numpy(zero_copy_only=False)
            d = t.column("d").combine_chunks() if isinstance(t.column("d"), pa.ChunkedArray) else t.column("d")
            d = d.flatten().to_numpy(zero_copy_only=False).reshape(len(fps), -1).astype(np.int16)
            side = t.column("side").to_numpy(zero_copy_only=False)
            few = (sizes > 1) & (sizes <= 16)
            few &= side[starts_done] < 0
            us, vs = _small_groups(fps, d, starts_done[few], sizes[few], max_bits)
            for s, n in zip(starts_done[(sizes > 1) & ~few], sizes[(sizes > 1) & ~few]):
                u, v = _connect(fps[s:s + n], d[s:s + n], side[s:s + n], max_bits)
                us.append(u)
                vs.append(v)
            return us, vs, rest

        def emit(us, vs):
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            t = pa.Table.from_batches([b])
            if tail is not None:
                t = pa.concat_tables([tail, t]).combine_chunks()
            if not t.num_rows:
                continue
            us, vs, tail = solve(t, False)
            yield emit(us, vs)
        if tail is not None and tail.num_rows:
            us, vs, _ = solve(tail, True)
            yield emit(us, vs)

    return shuffled.mapInArrow(run, "u long, v long")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, root)``: the smallest fingerprint that each linked fingerprint reaches."""
    table = common.materialise(distance_table(prints), "pivots")
    return components(links(table, max_bits)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    max_bits: int = MAX_BITS, carry: list[str] | None = None) -> DataFrame:
    """``row``, ``fp``, ``root`` (of the fingerprint's class) and ``component_id``."""
    prints = common.materialise(fingerprints(docs, text, words, carry), "fingerprints")
    roots = classes(prints, max_bits)
    named = prints.groupBy("fp").agg(F.min(f"row.{doc_id}").alias("least")) \
        .join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document stays, that of the smallest id (of equal ids
    the smallest text)."""
    prints = common.materialise(fingerprints(docs), "fingerprints")
    rooted = prints.join(classes(prints), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row.text"))
    return rooted.groupBy("root").agg(F.min_by("row", first).alias("row")).select("row.*")
