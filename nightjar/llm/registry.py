"""Queries of the corpus operators, for the driver's contract."""
from __future__ import annotations

import functools

from ..session import configure
from . import bpe, chat, covertree, decontaminate, html, idfile, lm, phrases, pii, quality, simhash, toxicity, warc

_ALL = [quality.op5_quality_rules, bpe.op7_bpe, simhash.op8_simhash, html.op9_html, chat.op2_chat, decontaminate.op10_decontaminate,
        toxicity.op4_toxicity, pii.op3_personal_data, idfile.op1_token_ids, lm.op6_cross_entropy,
        warc.op11_warc, covertree.op12_hard_negatives, phrases.op13_phrases]


def pinned(fn):
    """The library's session settings, and Arrow batches small enough for long texts."""
    @functools.wraps(fn)
    def run(spark, *args):
        configure(spark)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")     # few keys can be hot in texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        return fn(spark, *args)
    return run


QUERIES = {f.__name__: pinned(f) for f in _ALL}
ORACLE: dict[str, str] = {"op11_warc": warc.SQL, "op12_hard_negatives": covertree.SQL,
                          "op13_phrases": phrases.SQL}
