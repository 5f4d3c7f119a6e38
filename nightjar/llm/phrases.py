"""Phrase collocations (operator 13) by set-oriented mining (SETM).

**Relations.** Level k holds the occurrences of k-word phrases as a relation (piece, position,
phrase), sorted by piece and position and kept in blocks of about ``BLOCK`` words. The relation of
a block is packed into one row: its places (whole numbers; neighbours within a piece differ by
one, pieces by more) and, for each place, the number of its phrase in the block's list of
distinct ones, which follows as a row each. Blocks are cut between pieces and never share one.

**A level.** Spark counts the blocks' lists by phrase and keeps the groups with at least
``least`` occurrences; these get numbers of their own in a written table. They are joined back
to the lists, so each block learns which of its phrases are frequent (the semi-join), drops the
other occurrences, and merges the rest with itself at adjacent places: two frequent phrases of
k words that overlap in all but their ends are an occurrence of k + 1 words, known by the pair
of their numbers. All counts are exact, as numbers are given out by Spark, not hashed. A very
frequent phrase has one row a block, its count is a partial aggregate, and the join back is
one that Spark splits.

**Scores** are joins between the tables of frequent phrases, which hold every part of a
candidate; floor(10^6 a^2 / (l r)) is computed in whole decimals.

Defined results: a null text counts as empty, a null language as ``und``; texts without words
add nothing; a text of any length is read in slices and its pieces may be of any length (a
piece is never cut, so one longer than a block makes a longer block); repeated rows count as
often as they occur; ties in score and count go by the phrase's UTF-8 bytes; empty tables
give an empty table. Extra columns are not used.
"""
from __future__ import annotations

import re
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 1 << 20         # words of a block
SLICE = 1 << 22         # bytes of a text that are split at a time
LEAST, LONGEST = 10, 3  # occurrences and words of a candidate
CONTAINED = 50          # percent of a candidate's occurrences that lie in one longer candidate
TOP = 2000
SCALE = 1_000_000

TOKEN = re.compile(rb"[^\x20\x09.,;:!?\n-\r]+|[.,;:!?\n-\r]")
CUT = re.compile(rb"[\x20\x09.,;:!?\n-\r]")
ENDS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]
BATCH = 1 << 16         # rows handed to Spark at a time
BROADCAST = 1_500_000   # frequent phrases that may be broadcast, if
BROADCAST_BYTES = 16 << 20      # their words have so many bytes at most


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2^32, the bytes of equal weight side by side: small ones compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, len(data) // 4).T.copy().view("<u4")[:, 0]


def slices(text: bytes):
    """The text in parts of about ``SLICE`` bytes, cut where no word is."""
    at = 0
    while len(text) - at > SLICE:
        end = CUT.search(text, at + SLICE)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def rows_of(block: int, places: np.ndarray, numbers: np.ndarray, lists: dict[str, pa.Array]) -> pa.Table:
    """A block: the relation in its first row (number -1), then its list."""
    n = len(lists["n"])
    columns = {"block": pa.array(np.full(n + 1, block, np.int64)), "number": pa.array(np.arange(-1, n, dtype=np.int32))}
    for name, data in (("places", np.diff(places, prepend=0)), ("numbers", numbers)):
        columns[name] = pa.concat_arrays([pa.array([pack(data)], pa.binary()), pa.nulls(n, pa.binary())])
    for name, values in lists.items():
        columns[name] = pa.concat_arrays([pa.nulls(1, values.type), values])
    return pa.Table.from_batches(pa.table(columns).to_batches(max_chunksize=BATCH))


class Words(dict):
    """word -> its number in the block; the ends of pieces have the number 0."""

    def __init__(self, numbers):
        super().__init__((e, 0) for e in ENDS)
        self.numbers = numbers

    def __missing__(self, word):
        self[word] = n = next(self.numbers)
        return n


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """Level 1: blocks with ``lang``, ``word`` and ``n`` of their distinct words."""
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                        common.text_of(text).cast("binary").alias("text"))

    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, count()
        vocabulary, numbers, parts, used = {}, count(1), [], 0

        def out():
            nonlocal vocabulary, numbers, parts, used
            ids = np.concatenate(parts)
            places = np.flatnonzero(ids)
            ids = ids[places] - 1
            last = ids.max() + 1            # higher numbers are words behind the block's end
            words = sorted((n, lang, w) for lang, held in vocabulary.items() for w, n in held.items() if 0 < n <= last)
            lists = {"lang": pa.array([x[1] for x in words], pa.string()), "word": pa.array([x[2] for x in words], pa.binary()),
                     "n": pa.array(np.bincount(ids, minlength=len(words)), pa.int64())}
            vocabulary, numbers, parts, used = {}, count(1), [], 0
            return rows_of(first + next(made), places, ids, lists).to_batches()

        end = np.zeros(1, np.int32)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in slices(text.lower()):       # bytes.lower() changes A to Z only
                    tokens = TOKEN.findall(part)
                    held = vocabulary.get(lang)
                    if held is None:
                        held = vocabulary[lang] = Words(numbers)
                    ids = np.fromiter(map(held.__getitem__, tokens), np.int32, len(tokens))
                    if used + len(ids) > block:
                        ends = np.flatnonzero(ids == 0)
                        if len(ends):       # the block may end within a long text, between two pieces
                            parts.append(ids[:ends[0]])
                            rest = tokens[ends[0]:]
                            if any(p.any() for p in parts):
                                yield from out()
                            held = vocabulary.setdefault(lang, Words(numbers))
                            ids = np.fromiter(map(held.__getitem__, rest), np.int32, len(rest))
                    parts.append(ids)
                    used += len(ids)
                parts.append(end)
                used += 1
                if used >= block and any(p.any() for p in parts):
                    yield from out()
        if any(p.any() for p in parts):
            yield from out()

    return given.mapInArrow(run, "block long, number int, places binary, numbers binary, lang string, word binary, n long")


def merge(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The relation joined with itself at adjacent places: places, left and right phrases."""
    at = np.flatnonzero(np.diff(places) == 1)
    return places[at], ids[at], ids[at + 1]


def numbered(groups: DataFrame, label: str) -> DataFrame:
    """The written table with a dense number ``id`` for each row."""
    pid = F.spark_partition_id()
    held = common.materialise(groups.withColumn("pid", pid).withColumn(
        "at", F.monotonically_increasing_id() - F.shiftleft(F.col("pid").cast("long"), 33)), label)
    sizes = sorted(map(tuple, held.groupBy("pid").count().collect()))       # one row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offset = held.sparkSession.createDataFrame(starts, "pid int, offset long")
    return common.materialise(held.join(F.broadcast(offset), "pid").withColumn("id", F.col("at") + F.col("offset"))
                              .drop("pid", "at", "offset"), label)


def extend(level: DataFrame, known: DataFrame) -> DataFrame:
    """The next level: blocks with ``left``, ``right`` and ``n`` of their distinct phrases.
    ``known``: ``(block, number, id)``, the frequent phrases of each block."""
    def run(blocks, known):
        if not len(blocks) or not len(known):
            return empty
        row = blocks.to_pylist()[0]
        id_of = known.column("id").to_numpy()
        own = np.full(int(unpack(row["numbers"]).max(initial=0)) + 1, -1, np.int32)
        own[known.column("number").to_numpy()] = np.arange(len(id_of), dtype=np.int32)
        ids = own[unpack(row["numbers"])]
        frequent = np.flatnonzero(ids >= 0)                 # the semi-join
        places, left, right = merge(np.cumsum(unpack(row["places"]), dtype=np.int64)[frequent], ids[frequent])
        pairs, number, n = np.unique(left.astype(np.int64) * len(id_of) + right, return_inverse=True, return_counts=True)
        left, right = id_of[pairs // len(id_of)], id_of[pairs % len(id_of)]
        return rows_of(row["of"], places, number, {"left": pa.array(left), "right": pa.array(right), "n": pa.array(n)})

    kinds = "block long, number int, places binary, numbers binary, left long, right long, n long"
    none = pa.array([], pa.int64())
    empty = rows_of(0, none.to_numpy(), none.to_numpy(), {"left": none, "right": none, "n": none}).slice(0, 0)
    relation = level.where("number < 0").select(F.col("block").alias("of"), "places", "numbers")
    return relation.groupBy("of") \
        .cogroup(known.groupBy("block")).applyInArrow(run, kinds)


def _small(known: DataFrame, key: list[str]) -> DataFrame:
    """The table, to be broadcast if it is small; else Spark splits the join where a key is hot."""
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(F.length(F.col(k).cast("string")) for k in key)), F.lit(0))).first()
    return F.broadcast(known) if n <= BROADCAST and size <= BROADCAST_BYTES else known


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
             block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, f)`` of all phrases of up to ``longest`` words with at least ``least``
    occurrences, and ``(lang, n)``, the count of all words of a language."""
    level = common.materialise(occurrences(docs, text, lang, block), "phrases-1", "zstd")
    rows = level.where("number >= 0").select("block", "number", "lang", "word", "n")
    counted = common.materialise(rows.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    known = numbered(counted.where(F.col("f") >= least), "frequent-1")
    tables = [known.select("id", "lang", F.array(F.col("word").cast("string")).alias("words"), "f")]
    key = ["lang", "word"]
    for k in range(2, longest + 1):
        back = rows.join(_small(known.select(*key, "id"), key), key).select("block", "number", "id")
        level = extend(level, back)
        if k < longest:                     # the last level is counted as it is made
            level = common.materialise(level, f"phrases-{k}", "zstd")
        rows = level.where("number >= 0").select("block", "number", "left", "right", "n")
        counted = rows.groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        known, key = numbered(counted, f"frequent-{k}"), ["left", "right"]
        parts = tables[-1]
        tables.append(common.materialise(
            known.join(parts.select(F.col("id").alias("left"), "lang", F.col("words").alias("head")), "left")
            .join(parts.select(F.col("id").alias("right"), F.element_at("words", -1).alias("tail")), "right")
            .select("id", "lang", F.concat("head", F.array("tail")).alias("words"), "f"), f"named-{k}"))
    every = tables[0].drop("id")
    for t in tables[1:]:
        every = every.unionByName(t.drop("id"))
    return every, totals


def phrase(words: Column | str) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 contained: int = CONTAINED, top: int | None = TOP, block: int = BLOCK) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` (None: all) of each
    language."""
    every, totals = frequent(docs, text, lang, least, longest, block)
    parts = every.select("lang", phrase("words").alias("part"), "f")
    candidates = every.where(F.size("words") > 1).select("lang", "words", phrase("words").alias("phrase"), F.col("f").alias("a"))
    inner = every.where(F.size("words") > 2).select("lang", "f", F.explode(F.expr(
        "filter(flatten(transform(sequence(1, size(words)), i -> transform(sequence(2, size(words)), k -> "
        "CASE WHEN i + k - 1 <= size(words) AND k < size(words) THEN slice(words, i, k) END))), x -> x IS NOT NULL)")).alias("x"))
    longer = inner.groupBy("lang", phrase("x").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left") \
        .where(F.coalesce(100 * F.col("longer") < contained * F.col("a"), F.lit(True))).drop("longer")
    cuts = kept.select("lang", "words", "phrase", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")) \
        .withColumn("head", phrase(F.expr("slice(words, 1, k)"))) \
        .withColumn("rest", phrase(F.expr("slice(words, k + 1, size(words) - k)")))
    heads, rests = (parts.select("lang", F.col("part").alias(c), F.col("f").alias(n)) for c, n in (("head", "l"), ("rest", "r")))

    def whole(c):
        return F.col(c).cast("decimal(15,0)")

    # a <= l and a <= r, so a quotient is at most SCALE; the dividend has up to 38 digits
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (whole("a") * whole("a")), whole("l") * whole("r"))
    least_cut = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score) \
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (
  SELECT doc, lang, generate_subscripts(x, 1) AS piece, unnest(x) AS s
  FROM (SELECT doc, lang, regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]') AS x FROM t)),
w AS (
  SELECT doc, lang, piece, generate_subscripts(x, 1) AS i, unnest(x) AS w1
  FROM (SELECT doc, lang, piece, regexp_extract_all(s, '[^\\x20\\x09]+') AS x FROM p)),
o AS (
  SELECT lang, w1, lead(w1) OVER win AS w2, lead(w1, 2) OVER win AS w3 FROM w WINDOW win AS (PARTITION BY doc, piece ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS phrase, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS f FROM o
  WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY lang, phrase),
c AS (
  SELECT f2.lang, f2.phrase, f AS a, 1 AS k, w1 AS head, w2 AS rest
  FROM f2 LEFT JOIN inside ON inside.lang = f2.lang AND inside.phrase = f2.phrase
  WHERE f >= 10 AND NOT coalesce(100 * longer >= 50 * f, false)
  UNION ALL SELECT lang, phrase, f, 1, w1, w2 || ' ' || w3 FROM f3
  UNION ALL SELECT lang, phrase, f, 2, w1 || ' ' || w2, w3 FROM f3),
part AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, f FROM f2),
s AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, e.f AS r,
    CAST(1000000::HUGEINT * a * a // (h.f::HUGEINT * e.f) AS BIGINT) AS score
  FROM c JOIN part h ON h.lang = c.lang AND h.phrase = head JOIN part e ON e.lang = c.lang AND e.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score
FROM s JOIN n ON n.lang = s.lang
QUALIFY rank <= 2000
"""
