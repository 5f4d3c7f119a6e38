"""Quality rules (operator 5): tokeniser fertility with rejection bands per language or script.

A text that public vocabularies cut into unusually short or long tokens, that falls back to
single bytes, or whose tokens repeat, is not prose of its language. ``measure`` takes, in one
pass over each whole text, simple word statistics, the script of most of its letters and the
fertility of two public vocabularies; ``bands`` derives a band per group and measure from all
rows; ``judge`` applies both. A group is a language with at least ``min_rows`` rows that pass
the base rules; the rows of the smaller languages are pooled by script, apart from the large
ones, as a vocabulary serves a language of its training better than others of its script.

Defined results: a null text counts as empty; a text without words has measures null, fails
the base rules and is never kept; a null language is one of its own; a pool with under
``min_rows`` rows that pass the base rules has no evidence and no band, and those rows are
kept; repeated rows are measured alike; empty tables give empty results. Extra columns travel
in ``row``.
"""
from __future__ import annotations

import base64
import functools
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Measures with a band, and the least width of a band on either side of the quartiles.
BANDED = {"piece_chars": 0.05, "byte_chars": 0.05, "fallback_share": 0.02, "entropy": 0.05}
WINDOW = 64       # tokens; entropy is that of windows, so that it doesn't depend on the length
SPREAD = 5.0      # a band reaches this many interquartile ranges beyond the quartiles
MIN_ROWS = 30
GROUPS = 20_000         # groups (200 bytes each) whose bands may be broadcast

#: First code points of the scripts' blocks; what follows a block that is none
#: of a script's letters is named "".
SCRIPTS = [(0x0, ""), (0x41, "Latin"), (0x2B0, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"),
           (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x750, "Arabic"), (0x780, "Thaana"), (0x7C0, "Nko"),
           (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"),
           (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"),
           (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
           (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
           (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Yi"),
           (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0xFB50, "Arabic"), (0xFE00, ""),
           (0x20000, "Han"), (0x32000, "")]
_STARTS = np.array([a for a, _ in SCRIPTS])

FIELDS = [common.field(n, T.LongType()) for n in
          ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + \
         [common.field(n, T.DoubleType()) for n in BANDED] + [common.field("script", T.StringType())]


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


@functools.lru_cache(maxsize=2)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens={})


def word_measures(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def window_entropy(ids: np.ndarray) -> float:
    """Mean entropy of the windows of ``WINDOW`` tokens that cover the text, over that of as
    many distinct ones. The last window ends with the text; a shorter text is one window."""
    rows = ids[:max(1, len(ids) // WINDOW) * WINDOW]
    rows = rows.reshape(-1, min(WINDOW, len(rows)))
    if len(ids) > WINDOW and len(ids) % WINDOW:
        rows = np.vstack([rows, ids[-WINDOW:]])
    rows = np.sort(rows, axis=1)
    first = np.ones(rows.shape, bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    counts = np.diff(np.append(np.flatnonzero(first), rows.size))
    most = math.log2(rows.shape[1])
    return (most - float((counts * np.log2(counts)).sum()) / rows.size) / max(1.0, most)


def fertility(text: str, chars: int, pieces: str, ranks: str):
    """Word characters per token of either vocabulary, share of byte fallback tokens, and
    entropy of the tokens. Null for a text without words."""
    if not chars:
        return None, None, None, None
    sp, is_byte = _pieces(pieces)
    ids = np.array(sp.encode(text), dtype=np.int64)
    other = len(_ranks(ranks).encode_ordinary(text))
    return (round(chars / len(ids), 3), round(chars / other, 3),
            round(float(is_byte[ids].mean()), 4), round(window_entropy(ids), 3))


def script_of(text: str) -> str:
    """The script of most of a text's letters; ties go to the one listed first."""
    if text.isascii():
        return "Latin"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(np.searchsorted(_STARTS, code, "right") - 1, minlength=len(SCRIPTS))
    sums: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, counts.tolist()):
        if name:
            sums[name] = sums.get(name, 0) + n
    return max(sums, key=sums.get)


def measure(docs: DataFrame, text: str = "text", pieces: str | None = None,
            ranks: str | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``) and the measures of each whole text."""
    pieces = pieces or common.vocabulary("piece_bpe_32k.model")
    ranks = ranks or common.vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(texts):
        out = []
        for t in texts:
            words = word_measures(t)
            out.append((*words, *fertility(t, words[1], pieces, ranks), script_of(t)))
        return [list(x) for x in zip(*out)] if out else [[] for _ in FIELDS]

    return common.add_columns(docs, {"text": common.text_of(text)}, run, FIELDS)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sizes(measured: DataFrame, group: str = "row.lang") -> DataFrame:
    """``(own, passing)``: the rows of each language that pass the base rules."""
    return measured.groupBy(F.col(group).alias("own")).agg(F.count_if(~base_failed()).alias("passing"))


def grouped(measured: DataFrame, languages: DataFrame, group: str, min_rows: int) -> DataFrame:
    """Adds ``grp``: the language of a row, or the script if the language is small."""
    joined = measured.join(_few(languages), F.col(group).eqNullSafe(F.col("own")))
    large = F.col("passing") >= min_rows
    return joined.withColumn("grp", F.struct(F.when(large, F.col("own")).alias("lang"), F.when(~large, F.col("script")).alias("script"),
                                             large.alias("large"))).drop("own", "passing")


def _few(table: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows, so that a language with most of the rows stays where
    it is; else joined."""
    return F.broadcast(table) if table.limit(GROUPS + 1).count() <= GROUPS else table


def bands(measured: DataFrame, group: str = "row.lang", spread: float = SPREAD,
          min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per group: ``<measure>_low`` and ``<measure>_high``, null for a pool with too
    few rows. The quartiles are exact; measures are rounded, so a group's aggregate holds a few
    thousand values at most."""
    rows = grouped(measured.where(~base_failed()), sizes(measured, group), group, min_rows).select("grp", *BANDED)
    quartiles = [F.count(F.lit(1)).alias("n"), *[F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m)
                                                 for m in BANDED]]
    per = rows.groupBy("grp").agg(*quartiles)
    edges = []
    for m, least in BANDED.items():
        q = F.when(F.col("n") >= min_rows, F.col(m))
        reach = F.greatest(spread * (q[1] - q[0]), F.lit(least))
        edges += [(q[0] - reach).alias(f"{m}_low"), (q[1] + reach).alias(f"{m}_high")]
    return per.select("grp", *edges)


def judge(measured: DataFrame, edges: DataFrame, group: str = "row.lang", min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds ``base_failed`` and ``kept``. A group has edges, if only null ones, as soon as one of
    its rows passes the base rules, so every row that can be kept finds them."""
    edges = common.materialise(edges, "bands")
    languages = common.materialise(sizes(measured, group), "languages")
    inside = F.lit(True)
    for m in BANDED:
        inside = inside & (F.col(f"{m}_low").isNull() | F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")))
    rows = grouped(measured, languages, group, min_rows).withColumnRenamed("grp", "mine")
    joined = rows.join(_few(edges), F.col("mine") == F.col("grp"), "left")
    return joined.select(*[F.col(c) for c in measured.columns], base_failed().alias("base_failed"),
                         (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))


def quality(docs: DataFrame, text: str = "text", group: str = "lang", label: str = "quality") -> DataFrame:
    """``measure``, ``bands`` over all rows and ``judge``; the measured rows are written once
    to the shared folder, as bands and verdicts both read them."""
    measured = common.materialise(measure(docs, text), label)
    return judge(measured, bands(measured, f"row.{group}"), f"row.{group}")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = measure(docs).withColumn("row", F.col("row").dropFields("text"))
    measured = common.materialise(measured, "quality")
    return judge(measured, bands(measured)).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", *BANDED)


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep."""
    return quality(docs).where("kept").select("row.*")
