"""Every registered corpus query over the whole smallest tables, against brute force."""
from __future__ import annotations

import hashlib
import html as decode
import re
import zlib

import numpy as np
import pytest

from nightjar.llm import chat, common, decontaminate, registry

from .test_pairs import roots, slow_alignment, slow_fingerprint
from .test_texts import as_text, slow_measures, slow_spans
from .test_tokens import library_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = common.table(spark, SF, "documents").collect()
    return {r.doc_id: r.text or "" for r in rows}


def run(spark, name):
    query = next(q for k, q in registry.QUERIES.items() if k.startswith(name + "_"))
    return query(spark, SF).collect()


def test_op1(spark, docs):
    got, at = {r.doc_id: r for r in run(spark, "op1")}, 0
    for i in sorted(docs):
        ids = np.array(library_ids(docs[i]) + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_op2(spark):
    said: dict = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in common.table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in run(spark, "op2")}
    assert set(got) == set(said)
    for k, turns in said.items():
        r, spoken = got[k], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(spoken))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        once = sum(len(chat.head(a) + chat.escape(b) + chat.END) for a, b in turns)
        assert r.formatted_chars == once if r.n_windows == 1 else r.formatted_chars > once


def test_op3(spark, docs):
    for r in run(spark, "op3"):
        want = slow_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(as_text(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert set(as_text(want).split(",")) <= set(r.spans.split(","))


def test_op4(spark, docs):
    got = run(spark, "op4")
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_op5(spark, docs):
    got = run(spark, "op5")
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        want = slow_measures(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_op6(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op6")}
    good = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    assert set(got) == set(docs)
    by = [[got[i].score for i, q in good.items() if q == k and got[i].n_tokens > 200] for k in (0, 1)]
    assert np.median(by[0]) > np.median(by[1]) + 1


def test_op7(spark, docs):
    for r in run(spark, "op7"):
        ids = np.array(library_ids(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_op8(spark, docs):
    order = sorted(docs)
    prints = [slow_fingerprint(docs[i]) for i in order]
    want = {i: (f"{p:016x}", order[r]) for i, p, r in zip(order, prints, roots(prints, 4))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8")} == want


def test_op9(spark):
    pages = {r.page_id: r.html or "" for r in common.table(spark, SF, "pages").collect()}
    got = {r.page_id: r for r in run(spark, "op9")}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = (" ".join(decode.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[i].text == "\n\n".join(p for p in parts if p) and got[i].n_chars == len(got[i].text)


def test_op10(spark, docs):
    items = {r.item_id: decontaminate.words_of(r.text) for r in common.table(spark, SF, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in run(spark, "op10")}
    words = {i: decontaminate.words_of(t) for i, t in docs.items()}
    copies = {(i, n) for i, w in words.items() for n, item in items.items() if " ".join(item) in " ".join(w)}
    assert copies <= set(got)
    for (i, n), score in got.items():
        assert score >= 0.5
        if len(words[i]) < 400:
            assert score == slow_alignment(items[n], words[i]) / (2 * len(items[n]))
    assert len(got) < 3 * len(copies) + 5


def test_queries_with_sql(spark):
    """op11 to op13 against their SQL, which computes every row from the tables alone."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert set(registry.ORACLE) == {"op11_warc", "op12_hard_negatives", "op13_phrases"}
    for name, sql in registry.ORACLE.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = registry.QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall())), name
