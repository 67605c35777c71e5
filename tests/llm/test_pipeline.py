"""The pipeline and the registered queries on the smallest tables."""

import re

import numpy as np

import corpus_pipeline
from precis.llm import decontaminate, q_toxicity, toxicity
from precis.llm.common import settle
from precis.llm.queries import ORACLE, QUERIES

from .test_operators import brute_components, brute_print, brute_spans

SF001 = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001).cache()
        assert docs.columns == names, name
        assert docs.count() <= before
        before = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.pack(spark, docs, SF001)
    assert {r.doc_id for r in packed.collect()} == kept


def test_stages_on_an_empty_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (None, " ", "en", "s", 1, None)],
                                "doc_id long, text string, lang string, source string, n_chars long, _text string")
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF001)
            out.collect()
            if name != "pack":
                assert out.columns == table.columns, name


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def _worst_passage(model, text):
    """Score of one text, passage by passage."""
    words, scores, at = toxicity.split_words(text.encode()), [], 0
    for n in toxicity.passages(len(words), model.passage):
        part = words[at:at + n]
        scores.append(float(np.mean(model.word_logits(part))) if part else 0.0)
        at += n
    return float(model.probability(max(scores)))


def _contaminated(text, items):
    """Whether a stretch of a way to lay an item beside the text scores enough, without seeds."""
    at = {}
    for p, w in enumerate(w for w in re.split(decontaminate.NOT_WORD, text.lower()) if w):
        at.setdefault(w, []).append(p)
    for item in items:
        ways = {}
        for q, w in enumerate(item):
            for p in at.get(w, ()):
                ways.setdefault(p - q, []).append(q)
        for places in ways.values():
            now, before = 0, None
            for q in places:
                now = 1 + max(0, now - (q - before - 1)) if before is not None else 1
                before = q
                if now >= decontaminate.LEAST:
                    return True
    return False


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = q_toxicity.model(spark, SF001, docs)
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    n = [len(want)]
    want = {i: t for i, t in want.items() if _worst_passage(model, t) < q_toxicity.THRESHOLD}
    n.append(len(want))
    prints = {i: brute_print(t) for i, t in want.items()}
    roots, low = brute_components(prints.values()), {}
    for i in sorted(want):
        low.setdefault(roots[prints[i]], i)
    want = {i: want[i] for i in low.values()}
    n.append(len(want))
    raw = [t.encode() for t in want.values()]
    kept = [bytes(np.frombuffer(t, np.uint8)[~c]) for t, c in zip(raw, brute_spans(raw, 400))]
    assert kept != raw
    want = dict(zip(want, (t.decode("utf-8", "ignore") for t in kept)))
    items = [[w for w in re.split(decontaminate.NOT_WORD, (r.text or "").lower()) if w]
             for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    want = {i: t for i, t in want.items() if not _contaminated(t, items)}
    n.append(len(want))
    assert n == sorted(set(n), reverse=True)  # every stage that drops documents drops some
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = settle(stage(spark, got, SF001))
    assert {r.doc_id: r.text for r in got.collect()} == want
    places = {}
    for r in corpus_pipeline.run(spark, SF001).collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id))
    assert {d for rows in places.values() for _, _, d in rows} == set(want)
    for rows in places.values():
        at = 0
        for offset, length, _ in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
