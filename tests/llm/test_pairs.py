"""Operators 8 and 10 against brute force."""
from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from nightjar.llm import components, decontaminate, simhash

from .conftest import prose


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, most):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_copies(rng, n):
    """Texts with near copies of each other, and unrelated ones."""
    out = []
    while len(out) < n:
        text = prose(rng, 150).split(" ")
        for _ in range(rng.choice((1, 1, 3))):
            changed = text[:]
            changed[rng.randrange(len(text))] = "changed"
            out.append(" ".join(changed))
    return out


def test_fingerprints_and_classes(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(random.Random(2), 60))]
    docs = odd_docs.select("doc_id", "text", "row", "fp").unionByName(
        spark.createDataFrame(rows[odd_docs.count():], "doc_id long, text string").selectExpr("*", "'' as row", "0L as fp"))
    got = simhash.near_duplicates(docs).select("row.doc_id", "row.text", "fp", "component_id").collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    root = roots(prints, 4)
    least = {r: min((i for i, x in zip(ids, root) if x == r and i is not None), default=None) for r in root}
    want = sorted(str((i, p, least[r])) for i, p, r in zip(ids, prints, root))
    assert sorted(str((r.doc_id, r.fp % 2 ** 64, r.component_id)) for r in got) == want
    assert len(set(root)) < len(root) - 5
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_in_tiles_and_over_many_bits(spark):
    """A hot key of near fingerprints, cut into tiles, connects as one group would."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)} | set(base)
    values = sorted(values)
    rows = [((v - 2 ** 64 if v >= 2 ** 63 else v),) for v in values]
    table = simhash.distance_table(spark.createDataFrame(rows, "fp long"))
    want = roots(values, 4)
    for tile in (4, 4096):
        got = components.components(simhash.links(table, tile=tile)).collect()
        by = {r.node % 2 ** 64: r.root for r in got}
        classes: dict = {}
        for v, r in zip(values, want):
            classes.setdefault(r, set()).add(by.get(v, f"alone {v}"))
        assert all(len(c) == 1 for c in classes.values()) and len({c.pop() for c in classes.values()}) == len(set(want))


def test_stage_keeps_one_of_each_class(spark, odd_docs):
    out = simhash.stage_near_duplicates(spark, odd_docs, "")
    assert out.columns == odd_docs.columns
    texts = [r.text for r in odd_docs.collect()]
    root = roots([slow_fingerprint(t) for t in texts], 4)
    assert out.count() == len(set(root))
    assert 6 not in [r.doc_id for r in out.collect()]


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = components.components(spark.createDataFrame(chain, "u long, v long"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(41)} | {(1000 + i, 1000) for i in range(50)}


def slow_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if x == y else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    return int(table.max())


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(200):
        a = rng.choices(range(6), k=rng.randint(1, 15))
        b = rng.choices(range(6), k=rng.randint(1, 25))
        score, first, end = decontaminate.align(a, b)
        assert score == slow_alignment(a, b)
        assert slow_alignment(a, b[first:end]) == score


def test_matches_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(9)
    items = [prose(rng, 30) for _ in range(6)]
    edited = items[1].split()
    edited[5], edited[17] = "other", "words"
    del edited[22]
    texts = {50: prose(rng, 60) + " " + items[0] + " " + prose(rng, 60), 51: prose(rng, 40) + " " + " ".join(edited),
             52: prose(rng, 200), 53: items[2].upper(), 54: " ".join(items[3].split()[:5]) + prose(rng, 50)}
    texts |= {200 + i: prose(rng, 10) + " " + items[4] for i in range(30)}          # leaked into many
    docs = odd_docs.select("doc_id", "text", "row").unionByName(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("row", F.lit("")))
    table = spark.createDataFrame([*enumerate(items), (6, None), (7, "short pair")], "item_id long, text string")
    want = set()
    for r in docs.collect():
        words = decontaminate.words_of(r.text or "")
        for n, item in enumerate(items):
            its = decontaminate.words_of(item)
            if len(words) < 5000 and slow_alignment(its, words) >= len(its):
                want.add((r.doc_id, n))
    for chars in (4_000_000, 200):
        got = decontaminate.matches(docs, table, block_chars=chars)
        assert {(r.doc_id, r.item_id) for r in got.select("row.doc_id", "item_id").collect()} == want
    assert {(50, 0), (51, 1), (53, 2), (229, 4)} <= want
    assert decontaminate.matches(no_docs, table).count() == 0
    assert decontaminate.matches(docs, table.limit(0)) is None
