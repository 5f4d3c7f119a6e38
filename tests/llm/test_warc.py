"""Operator 11: round trips, revisits, framing and damage."""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from nightjar.llm import warc
from nightjar.session import scratch_path

from .conftest import prose


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    long = "<p>" + prose(rng, 60_000)
    rows = [(1, "http://a.example/", None), (2, None, ""), (3, "http://a.example/\r\nX: y z", "same"),
            (4, "http://b.example/ü", "same"), (4, "http://b.example/ü", "same"), (9, "x", "same"), (9, "x", "same"),
            (None, "n", "same"), (None, None, "alone, no key"), (None, "m", "twice, no key"), (None, "k", "twice, no key"),
            (5, "l", long), (6, "l", long), (-8, "u", "🙂 \r\n\r\nWARC/1.1\r\n\r\n <p>ünïcode")]
    rows += [(100 + i, "c", "a very common page") for i in range(200)]
    return spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id long, url string, html string, digest string, keep int")


def expected(rows, least=0):
    out = []
    for r in rows:
        data = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "").encode() == data and x.page_id is not None]
        keep = max(same, default=None) if len(data) >= least else None
        refers = keep if keep is not None and (r.page_id is None or r.page_id < keep) else None
        out.append((r.page_id, len(data), digest(data), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, file_bytes", [(0, 1 << 30), (5, 2_000)])
def test_round_trip(spark, pages, least, file_bytes):
    rows = pages.collect()
    manifest = warc.write(pages.repartition(3), scratch_path(spark, "warc"), least=least, file_bytes=file_bytes)
    found = warc.read(manifest)
    got = found.collect()
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == \
        expected(rows, least)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert manifest.count() > 3 if file_bytes < 1e6 else manifest.count() <= 8
    url = {None: None, "http://a.example/\r\nX: y z": "http://a.example/%0D%0AX:%20y%20z"}
    assert sorted(str((r.key, r.url)) for r in got) == sorted(str((r.page_id, url.get(r.url, r.url))) for r in rows)
    whole = warc.resolve(found).collect()
    assert sorted(((r.key, bytes(r.payload)) for r in whole), key=str) == \
        sorted(((r.page_id, (r.html or "").encode()) for r in rows), key=str)


def test_members_and_foreign_readers(spark, pages):
    """Each record is a gzip member of its own, the file as a whole plain gzip, and no
    record stands in a file that the manifest doesn't name."""
    folder = scratch_path(spark, "warc")
    manifest = warc.write(pages, folder).collect()
    assert {r.file.rsplit("/", 1)[1] for r in manifest} == {
        r.file.rsplit("/", 1)[1] for r in warc.archives(spark, folder).collect()}
    for r in manifest:
        with warc.open_file(r.file, "r") as f:
            data = f.read()
        members, rest = [], data
        while rest:
            z = zlib.decompressobj(31)
            members.append(z.decompress(rest) + z.flush())
            rest = z.unused_data
        assert b"".join(members) == gzip.decompress(data) and len(members) == r.records + 1
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)


class Drip(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_in_small_pieces(monkeypatch):
    data = b"".join(warc.page_record(i, "u", b"x" * i * 50, None, "d") for i in range(40))
    want = [(i, i * 50, digest(b"x" * i * 50)) for i in range(40)]
    for piece in (1, 3, 64):
        monkeypatch.setattr(warc, "PIECE", piece)
        got = list(warc.records(Drip(data), True))
        assert [(r[1], r[3], r[4]) for r in got] == want and all(len(r[6]) == r[3] for r in got)


def test_damage_is_found():
    good = warc.page_record(1, "u", b"payload", None, "d")
    plain = gzip.decompress(good)

    def fails(data, why):
        with pytest.raises((ValueError, zlib.error), match=why):
            list(warc.records(io.BytesIO(data), True))

    fails(good[:-9], "ends within")
    fails(good[:-6] + b"\0\0" + good[-4:], "incorrect data check")
    fails(gzip.compress(plain.replace(b"payload", b"paylaod")), "block doesn't match")
    fails(gzip.compress(plain[:-4]), "end where its member ends")
    fails(gzip.compress(plain[:-7]), "shorter than")
    fails(gzip.compress(plain + plain), "end where its member ends")
    fails(gzip.compress(b"x" * 100), "no end")
    other = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:" \
        + digest(b"a").encode() + b"\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbb\r\n\r\n"
    fails(gzip.compress(other), "payload doesn't match")
    assert list(warc.records(io.BytesIO(b""), True)) == []


def test_empty_table(spark, pages):
    folder = scratch_path(spark, "warc")
    assert warc.read(warc.write(pages.limit(0), folder)).count() == 0
