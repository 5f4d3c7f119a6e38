"""Operator 13 against brute force."""
from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import phrases

from .conftest import SYLLABLES


def slow(rows, least, longest, top, contained=50):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in held.items():
        if any(x[0] == lang and len(x) - 1 > len(w) and 100 * b >= contained * a
               and any(list(x[i:i + len(w)]) == w for i in range(1, len(x))) for x, b in held.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((10 ** 6 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out.append((lang, -s, -a, " ".join(w).encode(), left, right))
    out.sort()
    ranks = Counter()
    rows = []
    for lang, s, a, w, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], w.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)

    def text(n):
        words = rng.choices(SYLLABLES, [40 // (i + 1) + 1 for i in range(len(SYLLABLES))], k=n)
        return "".join(w + rng.choice((" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!? ", " \xa0")) for w in words)

    rows = [(text(rng.choice((3, 40, 200))), rng.choice(("xx", "yy", None))) for _ in range(150)]
    rows += [("New York City hall. " * 6 + "new york\x0bCITY\x0cHall Ünder die É", "xx")] * 5 + [("ha ha ha ha ha", "und")] * 9
    rows += [(None, "xx"), ("", None), (" \t\n", "zz"), (".,;:!?", "zz"), ("one", "ww"), (text(20_000), "xx")]
    rows += [("common pair " * 3 + text(5), "hot") for _ in range(60)]
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "text string, lang string, f long, words string")


@pytest.mark.parametrize("least, longest, block", [(10, 3, 1 << 21), (10, 3, 500), (4, 5, 3_000), (2, 2, 3_000)])
def test_equals_brute_force(spark, docs, monkeypatch, least, longest, block):
    rows = [(r.text, r.lang) for r in docs.collect()]
    want = slow(rows, least, longest, 40)
    assert len(want) > 90 and len({r[0] for r in want}) >= 4
    got = phrases.collocations(docs.repartition(3), least=least, longest=longest, top=40, block=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want


def test_slices_and_packing(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 5)
    text = b"abcdefgh ij\tkl.m n" * 20
    assert b"".join(phrases.slices(text)) == text
    assert [t for s in phrases.slices(text) for t in phrases.TOKEN.findall(s)] == phrases.TOKEN.findall(text)
    numbers = np.array([0, 1, 255, 256, 70_000, 2 ** 32 - 1])
    assert phrases.unpack(phrases.pack(numbers)).tolist() == numbers.tolist()
    assert phrases.unpack(phrases.pack(numbers[:0])).tolist() == []


def test_scores_are_exact_beyond_64_bits(spark):
    """The query's expression on counts whose products pass 64 bits."""
    big = 10 ** 12 + 7
    got = spark.range(1).select(F.call_function(
        "div", F.lit(phrases.SCALE).cast("decimal(7,0)") * (F.lit(big - 3).cast("decimal(15,0)") * F.lit(big - 3).cast("decimal(15,0)")),
        F.lit(big).cast("decimal(15,0)") * F.lit(big + 2).cast("decimal(15,0)")).alias("s")).first().s
    assert got == phrases.SCALE * (big - 3) ** 2 // (big * (big + 2))


def test_empty(spark, docs):
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("lang = 'zz'")).count() == 0
