"""Helpers shared by the corpus operators: shared folders, Arrow row maps, chunk caches."""
from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Vocabulary files by name; a caller may pass any other path instead.
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` once to the cluster's shared folder and reads it back: lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_bytes(spark: SparkSession, data: bytes, label: str) -> str:
    """Writes a small file to the shared folder and has every executor fetch a copy.
    Returns the name for ``SparkFiles.get``."""
    folder = scratch_path(spark, label)
    target = f"{folder}/{folder.rsplit('/', 1)[1]}.bin"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(str(fs.makeQualified(path).toString()))
    return target.rsplit("/", 1)[1]


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def add_columns(df: DataFrame, given: dict[str, Column], fn, fields: list[T.StructField],
                carry: list[str] | None = None) -> DataFrame:
    """Applies ``fn`` batch by batch: it gets one list per entry of ``given`` and returns one
    list per field. The result has the columns ``row`` (all columns of ``df`` or those in
    ``carry``, packed, so that no name can clash) and ``fields``."""
    packed = df.select(F.struct(*[df[f"`{c}`"] for c in carry or df.columns]).alias("row"),
                       *[c.alias(f"_in{i}") for i, c in enumerate(given.values())])
    kinds = [arrow_type(f.dataType) for f in fields]
    names, n = ["row", *[f.name for f in fields]], len(given)

    def run(batches):
        for b in batches:
            got = fn(*[b.column(i + 1).to_pylist() for i in range(n)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(v, t) for v, t in zip(got, kinds)]], names=names)

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *fields]))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


class ChunkCache(dict):
    """chunk -> value with two generations, so that its memory stays bounded while the chunks
    in use stay in it. ``make`` computes the value of an unseen chunk."""

    def __init__(self, make, size: int = 250_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = value
        return value


#: Unicode White_Space, as the public vocabularies' patterns have it
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(maxsize=1)
def chunk_pattern():
    """Cuts a text where no byte-level pre-token can cross: letters with the space before
    them up to plain punctuation, what else stands between white space, runs of white space."""
    return re.compile(rf" ?[^\W\d_]++(?=[.,;:!?{_WHITE}]|\Z)| ?[^{_WHITE}]++|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


@functools.lru_cache(maxsize=2)
def library_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Characters of texts whose chunks are held at a time; a longer text is held alone.
GROUP = 1 << 20


class TextEncoder:
    """text -> bytes, chunk by chunk. ``cut`` gives the chunks of a text and ``make`` the values of
    a list of chunks. Those that some texts need and that are not known are made together; known
    ones are kept in two generations, so that memory stays bounded while the chunks in use stay."""

    def __init__(self, cut, make, size: int = 250_000):
        self.cut, self.make, self.size = cut, make, size
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        return self._together([text])[0]

    def all(self, texts) -> list[bytes]:
        out, held, room = [], [], GROUP
        for t in texts:
            if held and len(t) > room:
                out += self._together(held)
                held, room = [], GROUP
            held.append(t)
            room -= len(t)
        return out + self._together(held)

    def _together(self, texts) -> list[bytes]:
        lists, now, old = list(map(self.cut, texts)), self.now, self.old
        unseen = set().union(*lists).difference(now)
        if unseen:
            fresh = []
            for c in unseen:
                if (value := old.get(c)) is None:
                    fresh.append(c)
                else:
                    now[c] = value
            now.update(zip(fresh, self.make(fresh)))
        out = [b"".join(map(now.__getitem__, chunks)) for chunks in lists]
        for c in unseen:
            if len(c) > 64:
                del now[c]
        if len(now) > self.size:
            self.old, self.now = now, {}
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _plain_byte_level(tokenizer) -> bool:
    """Whether a word of letters is one pre-token, whose bytes the BPE model gets as letters."""
    import json

    from tokenizers import models, pre_tokenizers

    cut = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(cut, pre_tokenizers.ByteLevel) \
            or not isinstance(tokenizer.model, models.BPE):
        return False
    how = json.loads(cut.__getstate__())
    return how.get("use_regex", True) and not how.get("add_prefix_space", True)


@functools.lru_cache(maxsize=2)
def library_encoder(path: str):
    """text -> ids (little-endian unsigned 32-bit) by the tokenizers library, chunk by chunk
    through a cache; a text with strings of special tokens is encoded in one piece. A word of
    letters that all versions of Unicode agree on is given to the library's model as it is."""
    from array import array

    tokenizer, findall = library_tokenizer(path), chunk_pattern().findall
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    letters, model = byte_letters(), tokenizer.model if _plain_byte_level(tokenizer) else None

    def ids(chunk):
        if model is not None and len(chunk) <= 64 and max(chunk) < "\u0530" and chunk.removeprefix(" ").isalpha():
            word = chunk.replace(" ", letters[32]) if chunk.isascii() \
                else chunk.encode("utf-8").decode("latin-1").translate(letters)
            return array("I", [t.id for t in model.tokenize(word)]).tobytes()
        return array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def cut(text):
        return [text] if text and any(s in text for s in special) else findall(text)

    return TextEncoder(cut, lambda chunks: map(ids, chunks))


class PieceEncoder:
    """Texts -> ids of all texts by ``library_encoder``, with Arrow and numpy. Texts are cut at their
    spaces; the ids of the pieces in use are kept, ``size`` pieces at most. Where a space stands
    before white space or at the end, or a special token in it, a text is not cut."""

    GROUP = 8 << 20                     # characters that are cut at a time; a longer text is cut alone

    def __init__(self, path: str, size: int = 1_000_000):
        special = [t.content for t in library_tokenizer(path).get_added_tokens_decoder().values()]
        whole = "|".join([f" (?=[{_WHITE}]|\\Z)", *map(re.escape, special)])
        self.encode, self.whole, self.size = library_encoder(path), re.compile(whole).search, size
        self.known = pa.array([], pa.string())
        self.ids, self.start, self.used = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.groups = 0

    def all(self, texts: list[str], end: bytes = b""):
        """For groups of texts: how many ids each text has, and the ids, with ``end`` after each text."""
        held, room = [], self.GROUP
        for t in texts:
            if held and len(t) > room:
                yield self._together(held, end)
                held, room = [], self.GROUP
            held.append(t)
            room -= len(t)
        if held:
            yield self._together(held, end)

    def _add(self, made: list[bytes]):
        """Where the ids begin that are put behind the known ones, and all ids."""
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        return np.append(self.start, self.start[-1] + np.cumsum(sizes)), \
            np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])

    def _together(self, texts, end):
        whole = [self.whole(t) is not None for t in texts]
        lists = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()), " ")
        edges, pieces = lists.offsets.to_numpy().astype(np.int64), lists.values.cast(pa.string())
        first = edges[:-1]              # has no space before it
        found = pc.index_in(pieces, self.known)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        at[first] = 0
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            other = pieces.take(pa.array(unseen)).dictionary_encode()
            at[unseen] = other.indices.to_numpy() + len(self.known)
            fresh = other.dictionary
            self.start, self.ids = self._add(self.encode.all([" " + p for p in fresh.to_pylist()]))
            self.known = pa.concat_arrays([self.known, fresh])
            self.used = np.append(self.used, np.zeros(len(fresh), np.int64))
        self.groups += 1
        self.used[np.delete(at, first)] = self.groups
        own = self.encode.all([t if w else t.split(" ", 1)[0] for t, w in zip(texts, whole)])
        start, ids = self._add([*own, end])
        at[first] = len(self.known) + np.arange(len(texts))
        at = np.insert(at, edges[1:], len(start) - 2)
        sizes = (start[1:] - start[:-1])[at]
        ends = np.cumsum(sizes)
        ids = ids[np.repeat(start[at] - ends + sizes, sizes) + np.arange(ends[-1])]
        if len(self.known) > self.size:
            self._forget()
        return np.diff(ends[edges[1:] + np.arange(len(texts))], prepend=0), ids

    def _forget(self):
        """Keeps the half of the pieces that was used last, but no long ones."""
        short = np.flatnonzero(pc.utf8_length(self.known).to_numpy() <= 64)
        kept = np.sort(short[np.argsort(-self.used[short], kind="stable")[:self.size // 2]])
        sizes = np.diff(self.start)[kept]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.start[kept] - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.start, self.used = np.append(0, ends), self.used[kept]
        self.known = self.known.take(pa.array(kept))


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str):
    return PieceEncoder(path)


def token_counter(path: str):
    encode = library_encoder(path)
    return lambda text: len(encode(text)) // 4
