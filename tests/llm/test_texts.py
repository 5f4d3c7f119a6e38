"""Operators 3, 4, 5, 6 and 9 against brute force, and the pipeline."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import common, html, lm, pii, quality, toxicity

from .conftest import prose, words

# ---------------------------------------------------------------- quality


def slow_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("text", ["", "a b c", "a b c a b c a b", "x\nx\n \n\ny\nx", "## $ | a<b> é   z", "a a a a a a",
                                  "a b c d a b c e f g h a b"])
def test_word_measures(text):
    assert quality.word_measures(text) == slow_measures(text)


def test_fertility_is_that_of_the_vocabularies():
    import sentencepiece

    text = "A common sentence, and a ẞrare one \U0001F980."
    path = common.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sp.encode(text, out_type=str)
    counts = Counter(pieces)
    chars = slow_measures(text)[1]
    got = quality.fertility(text, chars, path, common.vocabulary("byte_bpe_multi_50k.tiktoken"))
    entropy = -sum(n / len(pieces) * math.log2(n / len(pieces)) for n in counts.values()) / math.log2(len(pieces))
    assert got[0] == round(chars / len(pieces), 3)
    assert got[2] == round(sum(p.startswith("<0x") for p in pieces) / len(pieces), 4) > 0
    assert got[3] == round(entropy, 3)


def test_bands_reject_what_is_no_prose(spark, odd_docs, no_docs):
    rng = random.Random(3)
    rows = [(1000 + i, prose(rng, 100), "xx") for i in range(60)]
    rows += [(2000, "".join(rng.choices("0123456789abcdef", k=6)) + " " + " ".join(
        "".join(rng.choices("xqzj$#%&*^", k=7)) for _ in range(90)), "xx"), (2001, "one two three " * 40, "xx")]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = quality.quality(docs).select("row.doc_id", "row.text", "row.n_words", F.col("n_words").alias("n"), "word_chars",
                                       "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == docs.count()
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(1000, 1060)) <= kept and not kept & {1, 2, 3, 2000, 2001}
    for r in got:
        want = slow_measures(r.text)
        assert (r.n, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality(no_docs).count() == 0
    assert quality.stage_quality(spark, docs, "").columns == docs.columns


# ---------------------------------------------------------------- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow_spans(text):
    def passes(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items())
                  for m in re.finditer(p, text or "") if passes(kind, m[0]))


def as_text(spans):
    return ",".join(f"{pii.NAMES[k]}:{a}:{b}" for a, k, b in spans)


HARD = ["a@b.c_d@e.f", "x@y", "a.b+c@d-e.f.g@h.i", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004 0001.2.3.4", "4111 1111 1111 1111",
        "4111-1111-1111-1111 4111 1111 1111 1112", "5 4111111111111111", "+1 (017) 555-7713, +44 20.7946.0958-", "+1+2 345 678 901",
        "é🙂 me@x.org 🙂 10.0.0.1", "1 2 3 4 5 6 7 8 9 0 1 2 3", "@@a@@b.c", "9" * 300, "a" * 5000 + "@x.y", "1." * 400, "--1-1--",
        "4111 1111", "+12345678" + "9" * 8, "a@b..c a@-.-"]


def test_base_rules_equal_the_plain_patterns(spark, odd_docs, no_docs):
    rng = random.Random(6)
    mixed = ["".join(rng.choices(["@", ".", "a", "b-", "1", "23", "255", " ", "+", "(", ")", "-", "é", "4111111111111111"], k=30))
             for _ in range(400)]
    rows = [(100 + i, t) for i, t in enumerate(HARD + mixed + ["7 1.1.1.1 a@b.c " * 700])]
    docs = odd_docs.select("doc_id", "text", "row").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(None).cast("string")))
    got = pii.personal_data(docs)
    for r in got.select("row.text", "n_email", "n_ip", "n_card", "n_phone", pii.joined("base").alias("b")).collect():
        want = slow_spans(r.text)
        assert r.b == as_text(want), r.text and r.text[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
    assert pii.personal_data(no_docs).count() == 0


def test_contexts_find_what_no_rule_does(spark):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng, 20)} Please call {'+1 202 555 %04d' % rng.randrange(10000)} or write to "
                f"mailbox{i}@mail.example.org today") for i in range(12)]
    rows += [(50, "You may call 202-555-0199 or write to someone_77(at)example today"), (51, "We the 4711-0815 saw"),
             (52, "the 1234-5678 one"), (53, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.personal_data(docs).select("row.doc_id", pii.joined("spans").alias("s")).collect()}
    text = dict(rows)[50]
    at = text.index("202-555")
    assert f"phone:{at}:{at + 12}" in got[50].split(",")
    assert got[51] == got[52] == got[53] == ""
    for i, t in rows[:12]:
        assert got[i] == as_text(slow_spans(t))


def slow_patterns(seen):
    """The scoring by its definition, over sets."""
    strings: dict = {}
    for r in seen:
        strings.setdefault(r.pattern, set()).add(r.string)
    seeds: dict = {}
    for r in seen:
        if r.kind >= 0:
            seeds.setdefault(r.string, set()).add(r.kind)

    def fits(kind, s):
        digits, letters = sum(c.isdigit() for c in s), re.search("[a-z]", s)
        return [bool("@" in s), bool(re.fullmatch(r"[0-9a-f]*([.:][0-9a-f]+){3,}", s)), not letters and 8 <= digits <= 19,
                not letters and 5 <= digits <= 15, bool(letters) and digits > 0 and len(s) >= 16][kind]

    certain, good = {s: set(k) for s, k in seeds.items()}, {}
    for _ in range(3):
        good, shared = {}, set()
        for p, held in strings.items():
            counts = Counter(k for s in held for k in certain.get(s, ()))
            total = sum(counts.values())
            if sum(c >= 2 for k, c in counts.items() if k >= 0) > 1:
                shared.add(p)
            good |= {(p, k): c / (total + 1) for k, c in counts.items() if k >= 0 and c >= 5 and c / (total + 1) >= 0.8}
        certain = {s: set(k) for s, k in seeds.items()}
        for p, k in good:
            for s in strings[p] - set(seeds):
                if fits(k, s):
                    certain.setdefault(s, set()).add(k)
        for s in {s for p in shared for s in strings[p]} - set(certain):
            certain[s] = {pii.NONE}
    return good


def test_pattern_graph_equals_brute_force(spark):
    """Unknown strings are neutral, shared contexts name nothing, names lead to names."""
    rng = random.Random(14)

    def number():
        return f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"

    local = [number() for _ in range(30)]
    rows = [f"{prose(rng, 9)} Tel: +49 30 {rng.randrange(10 ** 6, 10 ** 7)} now" for _ in range(70)]
    rows += [f"{prose(rng, 9)} Tel: {x} then" for x in local]
    rows += [f"{prose(rng, 5)} Durchwahl {x} und" for x in local[:8]] + [f"so Durchwahl {number()} und" for _ in range(3)]
    for i in range(12):
        rows += [f"we saw the {x} go" for x in (f"+44 20 {rng.randrange(10 ** 6, 10 ** 7)}", f"me{i}@mail.example.org",
                                                f"10.0.{i}.7", f"{rng.randrange(10 ** 4, 10 ** 5)} 4711")]
    rows += [f'{prose(rng, 4)} token = "{rng.getrandbits(160):040x}" {prose(rng, 3)}' for _ in range(9)]
    rows += ['set token = "Ab9-xx7-Qw31-kk20/zz" here', f"commit {rng.getrandbits(160):040x} is no secret",
             f"see {'z' * 90} 303-1234 and Tel: {'1' * 70} end", "Tel: " + "12-" * 40 + "5"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = common.materialise(pii.base(docs), "t")
    seen = pii.occurrences(found)
    got = {(r.pattern, r.kind): r.score for r in pii.confident_patterns(seen).collect()}
    want = slow_patterns(seen.collect())
    assert got == pytest.approx(want) and ("tel: _", 3) in got and ("durchwahl _", 3) in got and ("the _", 3) not in got
    spans = {r.doc_id: (r.s, r.n_added) for r in pii.personal_data(docs).select(
        "row.doc_id", pii.joined("spans").alias("s"), "n_added").collect()}
    for i, t in enumerate(rows):
        if "Tel: 2" in t or "Durchwahl" in t or re.search(r"Tel: \d{3}-\d{4} ", t):
            at = re.search(r"\d{3}-\d{4}", t)
            assert spans[i] == (f"phone:{at.start()}:{at.end()}", 1), t
        elif "token" in t:
            at = re.search('"(.*)"', t)
            assert spans[i] == (f"secret:{at.start(1)}:{at.end(1)}", 1), t
        else:
            assert spans[i] == (as_text(slow_spans(t)), 0), t


def test_masking(spark):
    text = "é a@b.cc, 10.0.0.1 and +1 202 555 0100 x"
    docs = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "none", "k")], "doc_id long, text string, row string")
    out = {r.doc_id: r.text for r in pii.stage_personal_data(spark, docs, "").collect()}
    assert out == {1: "é [EMAIL], [IP] and [PHONE] x", 2: None, 3: "none"}


# ---------------------------------------------------------------- toxicity


def test_misspellings_share_the_vectors():
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(300):
        w = words(rng, 60)
        if i % 3 == 0:
            w[rng.randrange(60)] = rng.choice(("blockhead", "numbskull"))
            w[rng.randrange(60)] = rng.choice(("blockhead", "numbskull"))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit_calibrated(texts, labels)
    clean = [model.score(prose(rng, 80)) for _ in range(40)]

    def with_word(x):
        return [model.score(prose(rng, 300) + f" you {x} there " + prose(rng, 300)) for _ in range(4)]

    assert min(with_word("blockhead") + with_word("Numbskull")) > 0.5 > max(clean)
    unseen = [s for x in ("blockheads", "Numbskulls", "blokhead", "numbskul") for s in with_word(x)]
    assert min(unseen) > max(clean)


def slow_score(model, text):
    """The most toxic window, by the definition, from the model's numbers."""
    w = []
    for run in re.findall(r"[^\W_]+", text.lower()):
        w += [run] if len(run) <= 32 else [run[i:i + 32] for i in range(0, len(run) - 16, 16)]
    if not w:
        return 1 / (1 + math.exp(-model.bias))

    def share(word):
        m = f"<{word}>"
        grams = {m[i:i + n] for n in (3, 4, 5, 6) for i in range(len(m) - n + 1)} | {m}
        return sum(model.vector[zlib.crc32(g.encode()) % len(model.vector)] for g in grams) / len(grams)

    best = max(sum(map(share, w[i:i + 8])) / len(w[i:i + 8]) for i in range(0, max(1, len(w) - 4), 4))
    return 1 / (1 + math.exp(-best - model.bias))


def test_scores_equal_brute_force():
    rng = random.Random(4)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 3, (500, 4)), np.random.default_rng(2).normal(0, 1, (4, 2)), np.zeros(2))
    texts = ["", " ... ", "one", "Ünï_códe x", "a" * 33, "ab" * 400, prose(rng, 3), prose(rng, 500)]
    texts += [" ".join("".join(words(rng, n)) for n in (1, 30, 2, 90)) for _ in range(5)]
    for t in texts:
        assert model.score(t) == pytest.approx(slow_score(model, t), rel=1e-9)


def test_no_part_of_a_text_is_left_out(spark):
    """Insults behind character 64 of a run, in joined words, and behind word 2,000 of both
    training and scored texts; scores of rows whose labels were never read."""
    rng = random.Random(9)
    long = "".join(words(rng, 40))
    model = toxicity.Model(np.random.default_rng(1).normal(0, 3, (5000, 4)), np.random.default_rng(2).normal(0, 1, (4, 2)), np.zeros(2))
    assert len(long) > 70 and model.score(long[:70] + "x") != model.score(long[:70] + "y")
    rows = []
    for i in range(400):
        text = prose(rng, 2_100 if i % 8 == 0 else 150)
        rows.append((i, text + (f" you {rng.choice(('blockhead', 'numbskull'))} there " if i % 4 == 0 else "") + prose(rng, 30)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).select("row.doc_id", "score").collect()}
    unread = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in unread]) > 0.95
    joined = [model.score("".join(words(rng, 30)) + x + "".join(words(rng, 30))) for x in ("blockhead", "numbskull", "nothing")]
    assert min(joined[:2]) > joined[2]


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    labels = odd_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(odd_docs, labels, epochs=5)
    got = toxicity.score(odd_docs, model).select("row.*", F.col("score").alias("s")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.s <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert all(r.score == pytest.approx(1e-6) for r in toxicity.score(odd_docs, none).collect())
    held = odd_docs.where("doc_id is not null").select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)


# ---------------------------------------------------------------- language models


def test_losses_equal_brute_force(spark, odd_docs, no_docs):
    path = common.vocabulary("byte_bpe_50k.json")
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (20, 1, 1), (20, 0, 0), (21, 1, 0), (None, 1, 0), (22, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = lm.score(odd_docs.where("doc_id is null or doc_id <> 4"), labels).select(
        "row.doc_id", "row.text", "n_tokens", "target_loss", "background_loss", F.col("score").alias("s")).collect()
    encode, size = common.library_encoder(path), lm.vocabulary_size(path)
    all_ids = [np.frombuffer(encode(r.text or ""), "<u4").tolist() for r in got]
    docs = [(r, ids, [size, *ids][:len(ids)]) for r, ids in zip(got, all_ids)]
    good = {5, 20, 21}

    def cell(a, b):
        return int(lm.cells(np.array([a]), np.array([b]))[0])

    for r, ids, before in docs:
        assert r.n_tokens == len(ids)
        if not ids:
            assert r.target_loss is r.background_loss is r.s is None
            continue
        losses, goal = [], sum(len(i) for d, i, _ in docs if d.doc_id in good)
        for target in (True, False):
            uni, ctx, two, left_out = Counter(), Counter(), Counter(), False
            for d, i, b in docs:
                if target and d.doc_id not in good:
                    continue
                if d.doc_id == r.doc_id and d.text == r.text and not left_out:
                    left_out = True                     # one of repeated rows
                    continue
                uni.update(i)
                ctx.update(b)
                two.update(cell(x, y) for x, y in zip(b, i))
            n = sum(uni.values())
            scale, loss = goal / n, 0.0
            for w, u in zip(ids, before):
                low = (uni[w] * scale + lm.ALPHA) / (n * scale + lm.ALPHA * size)
                loss -= math.log2((two[cell(u, w)] * scale + lm.MU * low) / (ctx[u] * scale + lm.MU))
            losses.append(loss / len(ids))
        assert r.target_loss == pytest.approx(losses[0]) and r.background_loss == pytest.approx(losses[1])
        assert r.s == pytest.approx(losses[0] - losses[1])
    assert lm.score(no_docs, labels).count() == 0
    assert {r.score for r in lm.score(odd_docs, labels.limit(0)).select("row.doc_id", "score").collect()} == {None}


def test_bigrams_are_looked_up_in_order():
    """op6: the keys that a document asks for come in ascending order, repeats and all."""
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 1 << 60, 5_000))
    found = rng.choice(key, 20_000)
    assert lm._places(key, found).tolist() == np.searchsorted(key, found).tolist() and not len(lm._places(key, key[:0]))


# ---------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="ad">Buy</div>
<article><header><h1>Title &amp; more</h1></header><p>One <b>two
 three<p>four&nbsp;five &lt;six&gt; caf&eacute;<br>seven<ul><li>x<li>y</ul><div class="cookie-notice">ok?</div>
<form><input><button>Send</button></form><blockquote>quote</blockquote><!-- <p>hidden</p> -->
<section class="comments"><p>first!</p></section></article>
<aside><p>side</p></aside><footer>&copy; all</footer></body></html>"""


def test_article_of_a_page():
    want = ["Title & more", "One two three", "four five <six> café seven", "x", "y", "quote"]
    assert html.extract(PAGE).split("\n\n") == want
    assert html.extract("") == "" and html.extract("<nav>x</nav>") == ""
    assert html.extract("plain & simple <b") == "plain & simple"
    assert html.extract("1 < 2 <") == "1 < 2 <"
    assert html.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.extract("<p>a &am") == "a &am"


def test_site_templates_go_and_articles_stay(spark):
    rng = random.Random(1)
    rows, quote = [], prose(rng, 12)
    for i in range(12):
        rows.append((i, f"https://One.example/{i}", f"<body><div><b>Our site</b> since 1999</div><div><p>{prose(rng, 30)}</p>"
                        f"<p>{prose(rng, 9)}</p></div><div>Call us</div></body>"))
        rows.append((100 + i, f"http://two.example/{i}", f"<body><article><p>{quote}</p><p>{prose(rng, 20)}</p></article></body>"))
    rows += [(200, None, "<p>alone</p>"), (201, "odd", None), (202, "https://three.example", "<div><b>Our site</b> since 1999</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")) \
        .withColumn("row", F.lit(1)).withColumn("hashes", F.lit("y"))
    got = {r.page_id: r.main for r in html.main_text(pages).select("row.page_id", "main").collect()}
    assert len(got) == len(rows)
    for i, _, page in rows:
        if i < 100:
            assert got[i].split("\n\n") == re.findall("<p>(.*?)</p>", page)
        elif i < 200:
            assert got[i].split("\n\n") == re.findall("<p>(.*?)</p>", page) and got[i].startswith(quote)
    assert (got[200], got[201], got[202]) == ("alone", "", "Our site since 1999")
    assert html.main_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    """Five copies among twelve pages, with and without an article; repeated rows."""
    rng = random.Random(2)
    copied = f"<h1>{prose(rng, 6)}</h1><p>{prose(rng, 40)}</p><div><p>{prose(rng, 30)}</p><ul><li>{prose(rng, 9)}</ul></div>"
    rows = [(i, f"https://plain.example/{i}", f"<body>{copied}</body>") for i in range(5)]
    rows += [(10 + i, f"https://framed.example/{i}", f"<body><article>{copied}</article><nav>{i}</nav></body>") for i in range(5)]
    rows += [(20 + i, f"https://{h}.example/x{i}", f"<body><p>{prose(rng, 30)}</p></body>")
             for h in ("plain", "framed") for i in range(7)]
    rows += [(40, "https://again.example/", f"<div>{prose(rng, 30)}</div>")] * 30
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html.templates(pages).count() == 0
    for r in html.main_text(pages).select("row.*", "main").collect():
        want = re.findall("<(?:h1|p|li|div)>([^<]+)<", r.html)
        assert r.main.split("\n\n") == want, r.page_id


def test_templates_of_part_of_a_host(spark):
    """A notice on a quarter of a large host, and a box of one section of it."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        note = "<div><b>We moved.</b> Read why</div>" if i % 4 == 0 else ""
        box = "<p>News of the day</p>" if 100 <= i < 120 else ""
        rows.append((i, f"https://big.example/{'news/' if 100 <= i < 120 else ''}{i}.html",
                     f"<body>{note}<div><p>{prose(rng, 30)}</p></div>{box}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html.main_text(pages).select("row.*", "main").collect():
        assert r.main == re.search("<div><p>(.*?)</p>", r.html)[1], r.page_id


def test_lists_that_recur_in_articles_stay(spark):
    """A list in a tenth of a host's articles is content."""
    rng = random.Random(4)
    rows = [(i, f"https://big.example/{i}", f"<body><article><p>{prose(rng, 20)}</p>{'<ul><li>one</li><li>two</li></ul>' * (i % 10 == 0)}"
             f"</article></body>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html.main_text(pages).select("row.*", "main").collect():
        assert r.main.split("\n\n") == re.findall("<(?:p|li)>([^<]+)<", r.html), r.page_id


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs, kept = common.table(spark, sf, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, sf), "t")
        assert docs.columns == before.columns and docs.count() <= before.count()
        kept = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    assert set(out) == {r.doc_id for r in kept} and 0 < len(out) < 200
    for r in kept:
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert not slow_spans(r.text)
