"""Operators do the whole job: no count, seed, band or text is cut short."""
from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import common, decontaminate, lm, quality

from .conftest import prose, words
from .test_pairs import slow_alignment


def test_bigrams_never_share_a_count(spark):
    """op6: 45,000 different bigrams and more, over many chunks, against exact counts."""
    rng = random.Random(31)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(2_000)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(8)], "doc_id long, quality int")
    path = common.vocabulary("byte_bpe_50k.json")
    encode, size = common.library_encoder(path), lm.vocabulary_size(path)
    ids = [np.frombuffer(encode(t), "<u4").tolist() for t in texts]
    pairs = [list(zip([size, *i], i)) for i in ids]
    assert len({p for x in pairs for p in x}) > 45_000
    for chunk in (5_000, lm.CHUNK):
        got = {r.doc_id: r for r in lm.score(docs, labels, chunk=chunk).select(
            "row.doc_id", "n_tokens", "target_loss", "background_loss").collect()}
        for k in range(len(texts)):
            goal = sum(len(i) for i in ids[:5])
            for own, loss in (range(5), got[k].target_loss), (range(12), got[k].background_loss):
                rest = [j for j in own if j != k]
                uni, ctx = Counter(w for j in rest for w in ids[j]), Counter(u for j in rest for u, _ in pairs[j])
                two, n = Counter(p for j in rest for p in pairs[j]), sum(len(ids[j]) for j in rest)
                s, want = goal / n, 0.0
                for u, w in pairs[k]:
                    low = (uni[w] * s + lm.ALPHA) / (n * s + lm.ALPHA * size)
                    want -= math.log2((two[u, w] * s + lm.MU * low) / (ctx[u] * s + lm.MU))
                assert loss == pytest.approx(want / len(ids[k]), rel=1e-9)


def test_edited_copies_keep_a_seed_beside_exact_ones(spark):
    """op10: every edited copy is found, however many there are and whatever else leaked."""
    rng = random.Random(12)
    item = [f"{w}{i}" for i, w in enumerate(words(rng, 40))]
    edited = [w if i % 6 else "other" for i, w in enumerate(item)]
    again = [w if i % 6 != 3 else "another" for i, w in enumerate(item)]
    rows = [(0, " ".join(words(rng, 30) + item + words(rng, 30)))]
    rows += [(100 + i, " ".join(words(rng, 30) + edited + words(rng, 30))) for i in range(40)]
    rows += [(200 + i, " ".join(words(rng, 30) + again + words(rng, 30))) for i in range(15)]
    rows += [(300 + i, " ".join(words(rng, 60) + item[:6] + words(rng, 60))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontaminate.matches(docs, table).select("row.doc_id", "n_seeds", "score", "first_word", "end_word").collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows if i < 300]
    for r in got:
        its, held = decontaminate.words_of(" ".join(item)), decontaminate.words_of(dict(rows)[r.doc_id])
        assert r.n_seeds > 0 and r.score == slow_alignment(its, held) / 80
        assert slow_alignment(its, held[r.first_word:r.end_word]) / 80 == r.score


def edits(rng, item):
    """Copies of an item with every 3rd to 8th word replaced, dropped or followed by others."""
    for step in range(3, 9):
        for at in range(step):
            yield [f"other{rng.randrange(99)}" if i % step == at else w for i, w in enumerate(item)]
            yield [w for i, w in enumerate(item) if i % step != at]
            yield [x for i, w in enumerate(item) for x in ([w, "so", "to"][:1 + (i % step == at) * rng.choice((1, 2))])]
    yield [x for w in item for x in (w, "and")]             # a word between any two
    yield [w for i, w in enumerate(item) if i % 3 or i % 2]


def test_recall_against_brute_force(spark):
    """op10: the documents of sf0.001 and edited items in real texts, whole tables against the
    alignment of every pair: recall 1.0, and nothing else is reported."""
    rng = random.Random(21)
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in common.table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text or "") for r in common.table(spark, sf, "benchmark").collect()]
    table = spark.createDataFrame(items, "item_id long, text string")
    hosts = [t.split() for _, t in docs if 40 < len(t.split()) < 300]
    for k, (n, text) in enumerate(items):
        for edited in rng.sample(list(edits(rng, text.split())), 8):
            host = rng.choice(hosts)
            cut = rng.randrange(len(host))
            docs.append((10_000 + len(docs), " ".join(host[:cut] + edited + host[cut:])))
    want = set()
    split = [(n, decontaminate.words_of(t)) for n, t in items]
    for i, text in docs:
        held = decontaminate.words_of(text)
        numbers: dict = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in held]
        for n, item in split:
            if sum(w in numbers for w in item) >= len(item) / 2:
                s, _, _ = decontaminate.align([numbers.get(w, -1) for w in item], ids)
                if s >= len(item):
                    want.add((i, n, s / (2 * len(item))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for chars in (4_000_000, 1_500):
        got = decontaminate.matches(frame, table, block_chars=chars).select("row.doc_id", "item_id", "score").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 280


def test_a_prompt_of_many_items_makes_no_candidates(spark):
    """op10: 20,000 items of 30 words share a prompt of seven; texts hold the prompt alone."""
    rng = random.Random(5)
    prompt = "choose the answer which fits best here"
    items = [(n, prompt + " " + " ".join(f"w{rng.randrange(60_000)}" for _ in range(23))) for n in range(20_000)]
    texts = [f"{' '.join(words(rng, 20))} {prompt} {' '.join(words(rng, 20))}" for _ in range(200)] + [items[77][1]]
    block = decontaminate.Block(items)
    counts = np.bincount(block.grams_of(block.ids(texts)[0])[1], minlength=block.grams)
    seeds = decontaminate.Seeds(block, counts, sum(len(t.split()) for t in texts))
    assert list(seeds.regions(*seeds.ids(texts[:-1], seeds.gap))) == []
    assert [[c["item"] for c in x] for x in seeds.passages(texts)] == [[]] * 200 + [[77]]


def test_stage_on_odd_rows(spark, odd_docs, no_docs):
    """op10, pipeline: null and empty texts, repeated rows and clashing names pass through."""
    sf = "/root/testdata/sf0.001"
    item = common.table(spark, sf, "benchmark").first().text
    leak = odd_docs.where("doc_id = 6").withColumn("text", F.lit("x " + item)).select(odd_docs.columns)
    docs = odd_docs.unionByName(leak).unionByName(leak)
    out = decontaminate.stage_decontaminate(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert decontaminate.stage_decontaminate(spark, no_docs, sf).count() == 0


def test_small_languages_are_not_judged_by_large_ones(spark):
    """op5, pipeline: 29 clean rows of a language that falls back to bytes are kept."""
    rng = random.Random(17)
    rows = [(i, prose(rng, 100), "xx") for i in range(150)]
    rows += [(160 + i, " ".join("".join(chr(rng.randrange(0x1200, 0x1240)) for _ in range(5)) for _ in range(80)), "am")
             for i in range(quality.MIN_ROWS - 1)]
    rows += [(200, "short", "am"), (201, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").select("row.doc_id").collect()}
    assert kept == {i for i, _, _ in rows if i < 200}


def test_small_languages_of_a_script_are_pooled(spark):
    """op5, pipeline: four languages of 20 rows in one script have a band together, apart from
    the large language of that script; what is no prose of the script goes."""
    rng = random.Random(18)

    def ethiopic(n):
        return " ".join("".join(chr(rng.randrange(0x1200, 0x1240)) for _ in range(5)) for _ in range(n))

    rows = [(i, prose(rng, 100), "xx") for i in range(150)]
    rows += [(200 + i, ethiopic(80), f"l{i % 4}") for i in range(80)]
    rows += [(300, "\u1200 " * 60 + ethiopic(1), "l1"), (301, " ".join("\u1200" * 40 for _ in range(55)), "l2"),
             (302, prose(rng, 90), "l3"), (303, ethiopic(90), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs).select("row.doc_id", "kept", "script", "base_failed").collect()}
    assert len(got) == len(rows) and got[200].script == "Ethiopic" and got[0].script == got[302].script == "Latin"
    assert all(got[i].kept for i, _, _ in rows if i < 300) and got[302].kept and got[303].kept
    assert not got[301].kept
    edges = quality.bands(quality.measure(docs)).collect()
    assert sorted((r.grp.lang or "", r.grp.script or "", r.entropy_low is None) for r in edges) == [
        ("", "Ethiopic", False), ("", "Latin", True), ("xx", "", False)]


def test_scripts():
    for text, want in (("", "Latin"), ("abc é", "Latin"), ("где a", "Cyrillic"), ("漢字かな漢", "Han"), ("1 ½ …", "Latin"),
                       ("한국어 ab", "Hangul")):
        assert quality.script_of(text) == want, text


def test_entropy_rejects_salads_of_any_length(spark):
    """op5, pipeline: neither few words over and over nor pieces that never repeat are prose."""
    rng = random.Random(23)
    rows = [(i, prose(rng, rng.choice((70, 200, 1_000, 4_000))), "xx") for i in range(60)]
    few = words(rng, 12)
    rows += [(100 + n, " ".join(rng.choices(few, k=n)), "xx") for n in (200, 3_000)]
    once = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(3_000)]
    rows += [(10_000, " ".join(dict.fromkeys(once)), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality.measure(docs)
    edges = quality.bands(found).first()
    got = {r.doc_id: r for r in quality.judge(found, quality.bands(found)).select(
        "row.doc_id", "base_failed", "kept", "entropy").collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept for i in (300, 3_100, 10_000))
    assert got[300].entropy < edges.entropy_low and not got[300].base_failed
    assert got[10_000].entropy > edges.entropy_high
