"""Operators 1 and 7 against the tokenizers library, exact round trips, damaged blocks."""
from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import bpe, common, idfile

PATH = common.vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "a", "\n\n", "  x", "x  ", "\t a\n\n b  c", "it's we'll 'S 's don'test", "日本語 🙂", "a" * 500,
       "ab" * 300 + " " + "é" * 200, "\x1c\x1d x \x85 y\xa0z", "<|endoftext|>hi<|endoftext|>", "x<|endof text|>",
       "1234 56,78.9 -- ... ---", "\x00\x01", "a½ ½a ²³", "é à", "_a_b a.b.c a,b"]


def library_ids(text):
    return common.library_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    encode = bpe.encoder(PATH, None)
    rng = random.Random(3)
    mixed = ["".join(rng.choices("ab e'Ts1½ \n\t.,!é_-🙂", k=40)) for _ in range(500)]
    for text in ODD + mixed:
        assert np.frombuffer(encode(text), "<u4").tolist() == library_ids(text), repr(text)
        assert np.frombuffer(common.library_encoder(PATH)(text), "<u4").tolist() == library_ids(text), repr(text)


def test_transducer_finds_its_words_only(tmp_path):
    vocab = bpe.vocabulary(PATH)
    entries = {w: vocab.merge(w) for w in (b" the", b"the", b" thing", b"string", b" ring", b"a", "é".encode())}
    file = tmp_path / "lexicon"
    file.write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(file))
    assert {w: list(lexicon.ids(w)) for w in entries} == entries
    assert all(lexicon.ids(w) is None for w in (b"", b" th", b"thee", b"x", b"ing"))
    assert lexicon.states < 1 + sum(map(len, entries))          # suffixes are shared


def test_long_words_merge_like_short_ones():
    vocab = bpe.vocabulary(PATH)
    word = "".join(random.Random(5).choices("thean", k=300))
    assert vocab.merge(word.encode()) == library_ids(word)


def test_words_are_merged_and_walked_together(tmp_path):
    """op7: words that the lexicon lacks are handed on once and together, not one by one."""
    rng, vocab = random.Random(8), bpe.vocabulary(PATH)
    texts = [" ".join("".join(rng.choices("theand éж日", k=rng.randrange(1, 90))) for _ in range(40)) for _ in range(60)]
    words = [b"", *{p.encode() for t in texts for p in vocab.pretoken.findall(t)}]
    assert [np.frombuffer(i, "<u4").tolist() for i in vocab.merge_all(words)] == [vocab.merge(w) for w in words]
    file = tmp_path / "lexicon"
    file.write_bytes(bpe.compile_lexicon({w: vocab.merge(w) for w in words[1::3]}))
    lexicon = bpe.Lexicon(str(file))
    assert lexicon.indexes(words).tolist() == [-1 if (i := lexicon.index(w)) is None else i for w in words]
    for encode in (bpe.encoder(PATH, lexicon), common.library_encoder.__wrapped__(PATH)):
        calls, make = [], encode.make
        encode.make = lambda chunks: calls.append(len(chunks)) or make(chunks)
        assert [np.frombuffer(i, "<u4").tolist() for i in encode.all([*texts, *ODD])] == list(map(library_ids, [*texts, *ODD]))
        assert len(calls) == 1 and encode.all(texts) == [encode(t) for t in texts]


def test_known_chunks_stay_bounded():
    made = []
    encode = common.TextEncoder(str.split, lambda chunks: [made.append(c) or c.encode() for c in chunks], size=3)
    assert encode.all(["a b", "c " + "x" * 65, ""]) == [b"ab", b"c" + b"x" * 65, b""]
    assert sorted(encode.now) == ["a", "b", "c"] and encode("a d") == b"ad" and not encode.now
    assert encode("b a e") == b"bae" and sorted(encode.now) == ["a", "b", "e"] and sorted(made) == [*"abcde", "x" * 65]


def test_tokens_are_decoded_together(spark):
    ids = [library_ids(t) for t in ODD] + [[], library_ids("é")[:1], [0, 0]]
    rows = [np.array(i, "<u4").tobytes() for i in ids]
    want = [common.library_tokenizer(PATH).decode(i, skip_special_tokens=False) for i in ids]
    assert bpe._decoded(rows, bpe._token_bytes(PATH)) == want and bpe._decoded([], bpe._token_bytes(PATH)) == []


def test_encode_and_decode(odd_docs, no_docs):
    got = bpe.digests(odd_docs).collect()
    want = [(r.doc_id, len(library_ids(r.text)),
             hashlib.sha256(np.array(library_ids(r.text), "<u4").tobytes()).hexdigest(),
             hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digests(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 5, 1024, 1025, 9000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.zipf(1.3, n) % 50_257, np.zeros(n, np.int64)):
        back = idfile.decode_blocks(idfile.encode_blocks(ids))
        assert np.array_equal(np.concatenate(back), ids)


def test_blocks_stand_alone_and_notice_damage():
    ids = np.random.default_rng(0).integers(0, 3000, 5000)
    blocks = idfile.encode_blocks(ids)
    assert np.array_equal(idfile.decode_blocks(blocks[2:3])[0], ids[2048:3072])
    broken = bytearray(blocks[1])
    broken[len(broken) // 2] ^= 4
    with pytest.raises(ValueError):
        idfile.decode_blocks([bytes(broken)])
    with pytest.raises(ValueError):
        idfile.decode_blocks([blocks[0][:-1]])


def test_repetition_is_predicted():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 50), 80)
    assert 8 * sum(map(len, idfile.encode_blocks(ids))) < 3 * len(ids)


def test_blocks_of_any_length_and_size_of_ids():
    """op1: blocks of many lengths are decoded side by side, whatever the ids' size."""
    rng = np.random.default_rng(4)
    for digits in (1, 2, 5, 7):
        parts = [rng.zipf(1.2, n) % 16 ** digits for n in (1, 17, 1024, 1500, 4096, 70_000)]
        parts.append(rng.integers(0, 16 ** digits, 3000))
        blocks = [b for p in parts for b in idfile.encode_blocks(p, digits)]
        back = idfile.decode_blocks(blocks)
        assert np.array_equal(np.concatenate(back), np.concatenate(parts))
        assert [idfile.ids_in(b) for b in blocks] == list(map(len, back))


def test_carries_go_into_words_that_are_out():
    coder = idfile.Encoder(np.array([9]))
    one = [np.array([x], np.uint64) for x in (idfile.ONE - 1, 1, 0, 1, 1)]
    for _ in range(12):                                     # always the last part: low nears the top
        coder.narrow(slice(0, 1), *one)
    coder.out[:coder.at[0]] = 0xFFFFFFFF
    coder.out[0] = 7
    coder.low[0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    coder.narrow(slice(0, 1), *one)
    assert coder.out[0] == 8 and not coder.out[1:coder.at[0] - 1].any()


def test_damage_is_noticed_wherever_it_is():
    rng = np.random.default_rng(6)
    block, = idfile.encode_blocks(rng.zipf(1.3, 900) % 50_257)
    for _ in range(150):
        broken = bytearray(block)
        broken[rng.integers(len(block))] ^= int(rng.integers(1, 256))
        try:                            # an unused byte of the header or of the last word may go
            assert np.array_equal(idfile.decode_blocks([bytes(broken)])[0], idfile.decode_blocks([block])[0])
        except ValueError:
            pass


def test_an_id_is_spelled_once_and_then_coded_by_its_frequency():
    """op1: an id was spelled digit by digit whenever it was not predicted; 6.64 bits tell 100 ids apart."""
    rng = np.random.default_rng(5)
    ids = rng.choice(50_000, 100, replace=False)[rng.integers(0, 100, 4096 * 3)]
    blocks = idfile.encode_blocks(ids)
    assert np.array_equal(np.concatenate(idfile.decode_blocks(blocks)), ids)
    assert sum(idfile.HEADER.unpack_from(b)[2] for b in blocks) < 2.5 * 100 * len(blocks)
    blocks = idfile.encode_blocks(np.tile(ids, 300))        # blocks of 3,600
    assert 8 * sum(map(len, blocks)) < 7.8 * 300 * len(ids)


@pytest.mark.parametrize("size", [1_000_000, 50])
def test_pieces_are_encoded_as_the_library_does(size):
    """op1: texts are cut and looked up together by Arrow; few pieces are kept."""
    rng = random.Random(3)
    mixed = ["".join(rng.choices("ab e'Ts1½ \n\t.,!é_-🙂", k=40)) for _ in range(300)]
    mixed += [" ".join("".join(rng.choices("ab\n.e'é", k=3)) for _ in range(9)) for _ in range(300)]
    encode = common.PieceEncoder(PATH, size)
    encode.GROUP = 500
    for texts in ([*ODD, *mixed], mixed[::-1], ["x" * 900, "", "x y"], [""], []):
        got = [part.tolist() for counts, ids in encode.all(texts, np.array([7], "<u4").tobytes())
               for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library_ids(t) + [7] for t in texts]
    assert len(encode.known) <= 50 or size > 50


def test_shards_fill_their_lanes(spark, tmp_path):
    """op1: ids beyond full lanes wait for the next row of blocks, and none is lost."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["the", "of", "and", "cat"], k=rng.choice([0, 5, 700, 5000])))) for i in range(12)]
    folder = str(tmp_path / "ids")
    idfile.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, room=2048)
    shards = spark.read.parquet(folder).orderBy("shard", "block").collect()
    for r, after in zip(shards, shards[1:]):                # only a shard's last row of blocks is not full
        assert r.n_ids == 1024 or r.shard != after.shard
    got = idfile.starts(idfile.read(spark, folder)).orderBy("start").collect()
    at = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = library_ids(text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files(spark, odd_docs, no_docs, tmp_path):
    folder = str(tmp_path / "ids")
    idfile.write(odd_docs, folder)
    got = idfile.starts(idfile.read(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x or 0))
    at, texts = 0, odd_docs.select("doc_id", "text").collect()
    for r in rows:
        ids = [library_ids(t.text) + [0] for t in texts if t.doc_id == r.doc_id]
        sums = {(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids}
        assert r.start == at and (r.n_tokens, r.ids_crc32) in sums
        at += r.n_tokens
    assert len(rows) == len(texts)
    empty = str(tmp_path / "none")
    idfile.write(no_docs, empty)
    assert idfile.read(spark, empty).count() == 0
    blocks = spark.read.parquet(folder)
    assert blocks.agg(F.sum("n_ids")).first()[0] == at
