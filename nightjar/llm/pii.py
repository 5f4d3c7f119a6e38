"""Personal data (operator 3) by bootstrapped contextual extraction, in DataFrame functions only.

Seed entities are what the base rules find: addresses, phone and card numbers by their form, and
strings that have the form of a key (long hexadecimal ones), which are seeds but no spans yet: a
digest may be harmless. The words around a seed make lexical patterns (the word before it; the
two words before it; the words on either side). Other identifier-like strings, of any length,
stand in patterns too. Patterns and the strings that stand in them are a bipartite graph, which
Spark scores in rounds. A pattern's score for a kind is c / (a + 1), where a is the number of its
distinct strings that are certain of something and c of those that are certain of the kind:
support counts through the 1, and strings that nobody knows are neutral, however many there
are. Patterns of at least ``CONFIDENT`` with ``SUPPORT`` certain strings make the strings in them
that have the kind's shape certain for the next round. Unknown strings in contexts that several
kinds share (a common word), and in no confident one, become certain of nothing. At the end
confident patterns name the strings in them that no rule found.

A word of a context is at most ``NEAR`` characters long; next to a longer run there is no pattern.

Positions come from cutting a text at the matches: the lengths of pieces and matches add up.
Each rule's pattern is written so that a run of characters is tried once, from its start or
from the end of the match before: the matches are those of the plain pattern in the comment,
but a run of any length takes linear time.

Defined results: a null text counts as empty; texts of any length are searched whole; equal
starts are ordered by kind as listed; repeated rows are found alike, and count as one string
in the graph; empty tables give empty results. Extra columns travel in ``row``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")        # of the base rules
NAMES = (*KINDS, "secret")
NONE = -2               # the kind of strings that are certain of nothing
RULES = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ (a digit alone, which this takes too, has too few digits to pass)
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    # the plain pattern
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like: digits with separators, or a run with a digit or an at sign. A run is tried
#: at its start alone.
LIKE = (r"(?<![A-Za-z0-9])[0-9]++(?:[\x20().-]{1,3}[0-9]++)*+(?![A-Za-z0-9])|"
        r"(?<![A-Za-z0-9._%+@:/-])(?=[A-Za-z._%+:/-]*+[0-9@])[A-Za-z0-9]++(?:[._%+@:/-]++[A-Za-z0-9]++)*+")
#: The form of a key, which makes a seed.
KEY = r"^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}$"
NEAR = 64
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 5             # distinct certain strings of a confident pattern
MIXED = 2               # certain strings of each of two kinds that make a context a shared one
BROADCAST = 100_000     # found spans (some 50 bytes each) that may be broadcast

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
BLOCK = 256


def _located(df: DataFrame, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: the pattern's matches in ``_t`` as structs of start, end and string.
    Starts are sums of lengths; those of whole blocks of matches are added up once."""
    m, p, lengths, sums = (f"_{out}_{x}" for x in ("m", "p", "len", "sum"))
    df = df.withColumn(m, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
    some = F.size(m) > 0
    df = df.withColumn(p, F.when(some, F.split("_t", pattern, -1)))
    df = df.withColumn(lengths, F.when(some, F.zip_with(F.slice(p, 1, F.size(m)), m,
                                                        lambda a, b: F.length(a) + F.length(b))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    df = df.withColumn(sums, F.when(some, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")),
        lambda k: total(F.slice(lengths, k * BLOCK + 1, BLOCK)))))

    def one(i):
        block = F.floor(i / BLOCK).cast("int")
        start = total(F.slice(sums, F.lit(1), block)) + total(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK)) \
            + F.length(F.element_at(p, i + 1))
        return F.struct(start.alias("start"), (start + F.length(F.element_at(m, i + 1))).alias("end"),
                        F.element_at(m, i + 1).alias("string"))

    found = F.when(some, F.transform(F.sequence(F.lit(0), F.size(m) - 1), one))
    return df.withColumn(out, F.coalesce(found, F.expr("cast(array() as array<struct<start:bigint,end:bigint,string:string>>)"))) \
        .drop(m, p, lengths, sums)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """Whether a match of a rule counts."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(s)).between(12, 19) & _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda x: passes(kind, x.string)


def _as_kind(n: int):
    return lambda x: F.struct(x.start.alias("start"), F.lit(n).alias("kind"), x.end.alias("end"),
                              x.string.alias("string"))


def _context(span: Column) -> Column:
    """The last two words before and the first one after a span, as they stand (lower case);
    empty where there is none or it is too long."""
    size = NEAR + 1         # a word that fills it all is too long
    words = lambda s: F.split(F.lower(s), r"\s+")
    at = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    cut = lambda w: F.when(F.length(w) <= NEAR, w).otherwise("")
    left = F.rtrim(F.substring("_t", F.greatest(span.start - 2 * size, F.lit(0)).cast("int") + 1,
                               F.least(span.start, F.lit(2 * size)).cast("int")))
    right = F.ltrim(F.substring("_t", span.end.cast("int") + 1, F.lit(size)))
    before, after = words(left), words(right)
    return F.struct(cut(at(before, -1)).alias("before"), cut(at(before, -2)).alias("twice"), cut(at(after, 1)).alias("after"))


def fits(kind: Column, s: Column) -> Column:
    """Whether a string has the shape that a kind's strings can have."""
    digits, letters = F.length(_digits(s)), s.rlike("[a-z]")
    return F.when(kind == 0, F.contains(s, F.lit("@"))) \
        .when(kind == 1, s.rlike(r"^[0-9a-f]*([.:][0-9a-f]+){3,}$")) \
        .when(kind == 2, ~letters & digits.between(8, 19)) \
        .when(kind == 3, ~letters & digits.between(5, 15)) \
        .when(kind == 4, letters & (digits > 0) & (F.length(s) >= 16)).otherwise(False)


def base(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, ``rid`` (one per row), ``base`` (the rules' spans, sorted), ``n_<kind>`` and
    ``seen``: seeds and other identifier-like strings (kind -1) with their contexts."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"),
                     common.text_of(text).alias("_t"))
    for kind in KINDS:
        df = _located(df, RULES[kind], kind)
        df = df.withColumn(kind, F.filter(kind, _passing(kind)))
    df = _located(df, LIKE, "like")
    tagged = [F.transform(k, _as_kind(n)) for n, k in enumerate(KINDS)]
    df = df.withColumn("_all", F.array_sort(F.concat(*tagged)))
    digits = lambda s: F.length(_digits(s))
    free = F.filter("like", lambda x: ((digits(x.string) >= 4) | F.contains(x.string, F.lit("@"))) & ~F.exists(
        "_all", lambda y: (y.start < x.end) & (x.start < y.end)))
    df = df.withColumn("_seen", F.concat("_all", F.transform(free, _as_kind(-1))))
    kind = lambda x: F.when((x.kind < 0) & F.lower(x.string).rlike(KEY), F.lit(NAMES.index("secret"))).otherwise(x.kind)
    seen = F.transform("_seen", lambda x: F.struct(x.start.alias("start"), kind(x).alias("kind"), x.end.alias("end"),
                                                   F.lower(x.string).alias("string"), _context(x).alias("c")))
    spans = F.transform("_all", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))
    return df.select("row", F.expr("uuid()").alias("rid"), spans.alias("base"),
                     *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], seen.alias("seen"))


def occurrences(found: DataFrame) -> DataFrame:
    """One row per string and pattern that it stands in."""
    one = found.select("rid", F.explode("seen").alias("s")).select("rid", "s.*", "s.c.*")
    patterns = F.array(F.concat("before", F.lit(" _")), F.concat_ws(" ", "twice", "before", F.lit("_")),
                       F.concat_ws(" ", "before", F.lit("_"), "after"))
    return one.where("before <> ''").select("rid", "start", "end", "kind", "string",
                                            F.explode(F.array_distinct(patterns)).alias("pattern"))


def confident_patterns(seen: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT,
                       support: int = SUPPORT, mixed: int = MIXED) -> DataFrame:
    """``(pattern, kind, score)`` of the patterns that end up confident, scored in ``rounds``."""
    edges = common.materialise(seen.select("pattern", "string").distinct(), "edges")
    seeds = common.materialise(seen.where("kind >= 0").select("string", "kind").distinct(), "seeds")
    unknown = edges.join(seeds.select("string").distinct(), "string", "left_anti")
    certain, good = seeds, None
    for _ in range(rounds):
        counts = common.materialise(edges.join(certain, "string").groupBy("pattern", "kind").agg(
            F.count(F.lit(1)).alias("c")), "counts")        # at most one row a pattern and kind
        totals = counts.groupBy("pattern").agg(
            F.sum("c").alias("a"), F.count_if((F.col("kind") >= 0) & (F.col("c") >= mixed)).alias("kinds"))
        scored = counts.join(totals, "pattern").withColumn("score", F.col("c") / (F.col("a") + 1))
        good = common.materialise(scored.where((F.col("kind") >= 0) & (F.col("c") >= support) & (F.col("score") >= confident))
                                  .select("pattern", "kind", "score"), "patterns")
        named = unknown.join(good, "pattern").where(fits(F.col("kind"), F.col("string"))).select("string", "kind").distinct()
        shared = unknown.join(totals.where("kinds > 1").select("pattern"), "pattern").select("string").distinct() \
            .join(named.select("string").distinct(), "string", "left_anti").withColumn("kind", F.lit(NONE))
        certain = common.materialise(seeds.unionByName(named).unionByName(shared), "certain")
    return good


def discover(found: DataFrame) -> DataFrame:
    """``(rid, added)``: the spans that confident patterns name, per row."""
    seen = occurrences(found)
    good = confident_patterns(seen)
    secret = NAMES.index("secret")
    open_ = seen.where((F.col("kind") < 0) | (F.col("kind") == secret)).withColumnRenamed("kind", "own")
    hits = open_.join(good, "pattern").where(F.when(F.col("own") == secret, F.col("kind") == secret)
                                             .otherwise(fits(F.col("kind"), F.col("string"))))
    best = hits.groupBy("rid", "start", "end").agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"))
    return best.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))


def personal_data(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, ``n_<kind>``, ``n_added``, ``base`` and ``spans`` (base and discovered) of each whole
    text."""
    found = common.materialise(base(docs, text, carry), "personal")
    added = common.materialise(discover(found), "discovered")
    if added.select(F.explode("added")).limit(BROADCAST + 1).count() <= BROADCAST:
        added = F.broadcast(added)
    more = F.coalesce("added", F.expr(f"cast(array() as {SPAN})"))
    return found.join(added, "rid", "left").select("row", *[f"n_{k}" for k in KINDS], F.size(more).cast("long").alias("n_added"),
                                                   "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def masked(text: Column, spans: str) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap, the
    first names them."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES])

    def piece(i):
        x = F.element_at(spans, i)
        reached = F.coalesce(F.array_max(F.transform(F.slice(spans, 1, i - 1), lambda y: y.end)), F.lit(0).cast("bigint"))
        between = F.substring(text, reached.cast("int") + 1, F.greatest(x.start - reached, F.lit(0)).cast("int"))
        return F.concat(between, F.when(x.start >= reached, F.element_at(marks, x.kind + 1)).otherwise(""))

    end = F.array_max(F.transform(spans, lambda y: y.end)).cast("int")
    tail = F.substring(text, end + 1, F.length(text))
    parts = F.transform(F.sequence(F.lit(1), F.size(spans)), piece)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), tail))


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"), "n_added")


def stage_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with personal data replaced by its kind."""
    found = personal_data(docs)
    return found.select(*[masked(F.col("row.text"), "spans").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
                          for c in docs.columns])
