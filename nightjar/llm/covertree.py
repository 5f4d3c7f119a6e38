"""Hard-negative mining (operator 12): exact score windows on cover trees.

**Index.** Components become the integers floor(256 x). Rows are dealt by label and a hash of
their id into shards; a task builds a cover tree for every ``ROWS`` rows of its shard. Each
vector gets one more coordinate that brings all of a tree to the same norm M, so that the
distance d of a point from a query q is its inner product: 2 q.x = |q|^2 + M^2 - d^2. A node
of a level covers its points within the level's radius, its children within that radius
divided by ``BASE``; their centres lie further apart than that, and the first child keeps its
parent's centre. A node is stored with the distance of its farthest point, its range of labels
and its points, which stand side by side. Splitting ends at ``LEAF`` points, and children with
few points share a leaf around their parent's centre.

**Search.** An inner product with any point below a node lies between (|q|^2 + M^2 - (d+r)^2) / 2
and (|q|^2 + M^2 - (d-r)^2) / 2, d being the distance of its centre and r its covering radius. The
descent takes the node with the largest upper bound first. It skips nodes whose bounds lie
outside all windows of the query, whose upper bound is under the least score kept so far, or
whose labels can't match; a leaf's scores are computed exactly, in integers. Bounds are widened
by more than their rounding error, so results are those of brute force.

**In Spark.** Queries go in parts of about ``PART`` to each shard that can hold an answer: for
positives the shards with the anchor's label, for negatives all. A shard and a part meet in one
group (a few trees and some hundred queries); the best of each group are ranked by query.

Defined results: rows with a null id, label or vector, or with a null or non-finite component,
take no part, and neither do rows with 65536 |x|^2 >= 2^61, whose scores may pass 64 bits;
shorter vectors count as padded with zeros, empty ones score zero. An anchor's other rows are
those with another id. Rows that repeat an id are candidates of their own; an anchor whose id
repeats is searched once, with its least label and vector. Ties go to the smaller id. A negative
positive score has an empty window. Anchors without positives, and empty tables, give no rows.
Extra columns are not used.
"""
from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROWS = 8192             # rows of a tree
PART = 128              # queries of a group
LEAF = 64
SMALL = 8               # children with fewer points share a leaf
BASE = 1.15             # radius of a level over the next one's
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90    # a negative's score in percent of the positive's


def vectors(rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """``(id, label, v)`` of the rows that take part; ``v`` holds whole numbers."""
    real = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + (256 * x) * (256 * x))
    return rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), real.alias("x")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()) \
        .where(~odd).where(norm < float(2 ** 61)) \
        .select("id", "label", F.transform("x", lambda x: F.floor(256 * x).cast("double")).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Lists as the rows of a matrix, at least ``width`` wide, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Tree:
    """A cover tree over rows of ``points``; nodes are rows of parallel arrays, the first one
    the root. ``child`` .. ``child_end`` are a node's children, none in a leaf."""

    FIELDS = ("points", "ids", "labels", "centre", "start", "end", "child", "child_end", "radius")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        real = self.points.astype(float)
        self.norm = float((real * real).sum(1).max(initial=0.0))           # M^2
        self.real, self.centres = real, real[self.centre]
        spans = [self.labels[a:b] for a, b in zip(self.start, self.end)]
        self.low_label = np.array([s.min() for s in spans])
        self.high_label = np.array([s.max() for s in spans])

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tree:
        norms = (points * points).sum(1)
        lifted = np.column_stack([points, np.sqrt(norms.max() - norms)])

        def far(at, centre):
            gaps = lifted[at] - lifted[centre]
            return np.sqrt((gaps * gaps).sum(1))

        nodes, leaves = [], {}          # [centre, start, end, child, child end, radius]; points of each leaf
        todo = [(0, np.arange(len(points)), None)]      # breadth first: children of a node are neighbours
        while todo:
            after = []
            for centre, mine, level in todo:
                gap = far(mine, centre)
                radius = float(gap.max())
                n = len(nodes)
                nodes.append([centre, 0, 0, 0, 0, radius])
                if len(mine) <= LEAF or radius == 0:
                    leaves[n] = mine
                    continue
                level = min(level or radius, radius)
                while (inner := gap <= level / BASE).all():
                    level /= BASE
                level /= BASE
                parts, rest = [(centre, mine[inner])], mine[~inner]
                while len(rest):
                    gap = far(rest, rest[0])
                    parts.append((int(rest[0]), rest[gap <= level]))
                    rest = rest[gap > level]
                few = [p for _, p in parts if len(p) < SMALL]
                parts = [(c, p, level) for c, p in parts if len(p) >= SMALL]
                if few:
                    few = np.concatenate(few)
                    if not parts:       # no two points are near each other: splitting is of no use
                        leaves[n] = few
                        continue
                    parts.append((centre, few, None))
                after.append((n, parts))
            todo = []
            for n, parts in after:
                nodes[n][3] = len(nodes) + len(todo)
                nodes[n][4] = nodes[n][3] + len(parts)
                todo += parts
        order, used, stack = [], 0, [(0, False)]    # depth first, so that a subtree's points are a range
        while stack:
            n, done = stack.pop()
            node = nodes[n]
            if done:
                node[1], node[2] = nodes[node[3]][1], nodes[node[4] - 1][2]
            elif n in leaves:
                order.append(leaves[n])
                node[1], used = used, used + len(leaves[n])
                node[2] = used
            else:
                stack.append((n, True))
                stack.extend((c, False) for c in range(node[4] - 1, node[3] - 1, -1))
        by = np.concatenate(order)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        table = list(zip(*nodes))
        kind = np.int16 if np.abs(points).max(initial=0) < 2 ** 15 else np.int64
        return cls({"points": points[by].astype(kind), "ids": ids[by], "labels": labels[by],
                    "centre": place[list(table[0])], "radius": np.array(table[5]),
                    **{k: np.array(table[i], np.int32) for i, k in enumerate(("start", "end", "child", "child_end"), 1)}})

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        return cls(np.load(io.BytesIO(data)))

    def search(self, q: np.ndarray, own_id: int, own_label: int, same: bool, windows: list[tuple[int, int]], keep: int):
        """For each window (lowest and highest score) the ``keep`` best ``(scores, ids)`` of rows
        of the same label, or of others; also the number of leaves that were verified."""
        q = np.pad(q, (0, max(0, self.points.shape[1] - len(q))))[:self.points.shape[1]]
        square = float((q * q).sum())
        exact = self.norm * max(square, 1.0) < 2.0 ** 104      # then products and sums are under 2^53 in floats
        both = square + self.norm
        slack = 1e-9 * both + 1.0
        far = np.sqrt(np.maximum(both - 2 * (self.centres @ q), 0.0))
        reach = self.radius * (1 + 1e-9) + 1e-6 * np.sqrt(both)
        high = (both - np.maximum(far - reach, 0.0) ** 2) / 2 + slack
        low = (both - (far + reach) ** 2) / 2 - slack
        mine = (self.low_label <= own_label) & (own_label <= self.high_label) if same else \
            (self.low_label != own_label) | (self.high_label != own_label)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        least = [w[0] for w in windows]         # what a further row has to score
        heap, verified = [(-high[0], 0)] if mine[0] else [], 0
        while heap:
            bound, n = heapq.heappop(heap)
            if -bound < min(least):
                break
            if not any(-bound >= s and low[n] <= w[1] for s, w in zip(least, windows)):
                continue
            if self.child_end[n] > self.child[n]:
                for c in range(self.child[n], self.child_end[n]):
                    if mine[c]:
                        heapq.heappush(heap, (-high[c], c))
                continue
            verified += 1
            at = slice(self.start[n], self.end[n])
            scores = (self.real[at] @ q).astype(np.int64) if exact else self.points[at].astype(np.int64) @ q.astype(np.int64)
            fits = (self.labels[at] == own_label) == same
            fits &= (self.ids[at] != own_id) & (scores >= min(least))
            if not fits.any():
                continue
            scores, ids = scores[fits], self.ids[at][fits]
            for k, (lowest, highest) in enumerate(windows):
                good = (scores >= least[k]) & (scores <= highest)
                if good.any():
                    s, i = np.concatenate([found[k][0], scores[good]]), np.concatenate([found[k][1], ids[good]])
                    best = np.lexsort((i, -s))[:keep]
                    found[k] = (s[best], i[best])
                    if len(best) == keep:
                        least[k] = max(lowest, s[best[-1]])
        return found, verified


def index(rows: DataFrame, per_tree: int = ROWS) -> DataFrame:
    """``(shard, labels, tree)``: shards follow each other by label, so a label's are neighbours."""
    shards = max(1, -(-rows.count() // per_tree))
    dealt = rows.repartitionByRange(shards, F.col("label"), F.xxhash64("id")).sortWithinPartitions("label")

    def run(batches):
        shard, held, n = TaskContext.get().partitionId(), [], 0

        def out():
            t = pa.Table.from_batches(held)
            tree = Tree.build(matrix(t.column("v")), t.column("id").to_numpy(), t.column("label").to_numpy())
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int64()), pa.array([np.unique(tree.labels)], pa.list_(pa.int64())),
                pa.array([tree.to_bytes()], pa.binary())], names=["shard", "labels", "tree"])

        for b in batches:
            while len(b):
                take = b.slice(0, per_tree - n)
                b = b.slice(len(take))
                held.append(take)
                n += len(take)
                if n == per_tree:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return common.materialise(dealt.mapInArrow(run, "shard long, labels array<long>, tree binary"), "covertree")


def search(trees: DataFrame, queries: DataFrame, same: bool, keep: int, parts: int) -> DataFrame:
    """``queries``: ``(anchor, label, v, first, last, windows)``, ``first`` and ``last`` of the shards to
    search and windows of ``(of, low, high)``. Gives ``(anchor, of, id, score)``: of every group
    the ``keep`` best of each window."""
    # the stated queries against all rows, in blocks: a part of the queries for each shard
    asked = queries.withColumn("part", F.expr(f"pmod(xxhash64(anchor), {parts})")) \
        .withColumn("shard", F.explode(F.sequence("first", "last"))).drop("first", "last")
    held = trees.select("shard", "tree", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))

    def run(held, asked):
        out = []
        if len(held) and len(asked):
            asked_v = matrix(asked.column("v"))
            rows = list(zip(*[asked.column(c).to_pylist() for c in ("anchor", "label", "windows")]))
            for data in held.column("tree").to_pylist():
                tree = Tree.from_bytes(data)
                for q, (anchor, label, windows) in zip(asked_v, rows):
                    found, _ = tree.search(q, anchor, label, same, [(w["low"], w["high"]) for w in windows], keep)
                    for w, (scores, ids) in zip(windows, found):
                        out += [(anchor, w["of"], i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)],
                                    names=["anchor", "of", "id", "score"])

    return held.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")) \
        .applyInArrow(run, "anchor long, of long, id long, score long")


def ranked(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The ``keep`` best rows of each group with their rank; Spark cuts the groups of each task
    before it shuffles them."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: Column | str = "label",
                   vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST, highest: int = HIGHEST, per_tree: int = ROWS, part: int = PART) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each
    anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows
    of other labels that score ``lowest`` to ``highest`` percent of the positive. ``is_anchor`` is
    a condition on ``id``."""
    label = F.col(label) if isinstance(label, str) else label
    clean = common.materialise(vectors(rows, key, label, vector), "vectors")
    trees = index(clean, per_tree)
    least = clean.where(is_anchor).groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = common.materialise(least.select("anchor", "x.label", "x.v"), "anchors")
    parts = max(1, -(-anchors.count() // part))
    places = trees.select("shard", F.explode("labels").alias("label")).groupBy("label") \
        .agg(F.min("shard").alias("first"), F.max("shard").alias("last"))

    def window(of, low, high):
        return F.struct(of.cast("long").alias("of"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    everything = F.array(window(F.lit(0), F.lit(-2 ** 62), F.lit(2 ** 62)))
    near = search(trees, anchors.join(places, "label").withColumn("windows", everything), True, positives, parts)
    best = common.materialise(ranked(near, ["anchor"], positives).select(
        "anchor", F.col("id").alias("of"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    goals = best.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(window(
        F.col("of"), F.ceil(score * lowest / 100), F.floor(score * highest / 100))).alias("windows"))
    last = trees.agg(F.coalesce(F.max("shard"), F.lit(0)).alias("last")).first()["last"]
    asked = anchors.join(goals, "anchor").withColumn("first", F.lit(0).cast("long")).withColumn("last", F.lit(last))
    hard = ranked(search(trees, asked, False, negatives, parts), ["anchor", "of"], negatives)
    return hard.join(best, ["anchor", "of"]).select(
        F.col("anchor").alias("anchor_id"), F.col("of").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), F.expr("id % 100 = 0"), label=label)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same,
    CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
