"""Steps that read the corpus once, in slices, and at little cost a row."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.operators import abbreviations as A
from precis.operators import encode as E
from precis.operators import vocab as V
from precis.operators.batches import in_parts, in_slices

SF001 = "/root/testdata/sf0.001"


def _counted(spark, texts):
    """A corpus whose rows add to an accumulator whenever they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def note(t: pa.Array) -> pa.Array:
        seen.add(len(t))
        return t

    noted = F.arrow_udf(note, "string").asNondeterministic()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs.select("doc_id", noted("text").alias("text")), seen


def test_trainers_read_the_corpus_once(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", None, ""] * 10
    for model, settings in (("bpe", {}), ("unigram", {"seed_size": 50, "rounds": 1})):
        corpus, seen = _counted(spark, texts)
        V.train_vocab(corpus, model, 40, **settings).collect()
        assert seen.value == len(texts), model


def test_a_corpus_read_for_the_vocabulary_alone_is_not_written(spark, monkeypatch):
    from precis.plans import q_vocab
    written = []
    monkeypatch.setattr(q_vocab, "_corpus_saved", lambda *a: written.append(a) or q_vocab._corpus(*a))
    for name in ("prepare_input", "pretrain_records", "eval_decoded"):
        getattr(q_vocab, name)(spark, SF001)
    assert not written


def test_kernels_see_slices(spark):
    lists = pa.array([[1] * 7, None, [], [2], [3, 4], [5] * 3], pa.list_(pa.int32()))
    seen = []

    def kernel(part):
        seen.append(len(part.flatten()))
        return part

    assert in_slices(kernel, 4)(lists).to_pylist() == lists.to_pylist()
    assert seen == [7, 3, 3]
    assert in_slices(kernel, 4)(lists.slice(0, 0)).to_pylist() == []


def test_long_texts_encode_and_decode_in_slices(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 5, 120_000, 3, 90_000, 30_000, 2)] + [None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    vocab = V.train_vocab(docs, "unigram", 30, seed_size=50, rounds=1)
    whole = E.encode(docs, vocab, {"text": None}, "unigram")
    got = {r.doc_id: r.text for r in E.decode(whole, vocab, "text_ids", "unigram").collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    ids = {r.doc_id: r.text_ids for r in whole.collect()}
    short = {r.doc_id: r.text_ids for r in E.encode(docs, vocab, {"text": 8}, "unigram").collect()}
    assert short == {i: (x[:-1][:7] + [V.EOS] + [V.PAD] * 8)[:8] for i, x in ids.items()}


def test_a_step_that_does_not_apply_is_one_look_at_the_text(spark):
    corpus, seen = _counted(spark, ["see www.a-b.co/x now. 1.5 (y) - z", "plain words. more words", "", None, "..ab .. a.b.c - "] * 3)
    for step in (T.remove_links, T.empty_parens, lambda c: T.remove_headline(c, "- ")):
        plan = corpus.select(step(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" in plan
    got = corpus.select("doc_id", T.remove_links("text").alias("a"), T.remove_digit_dots("text").alias("b")).collect()
    rows = {r.doc_id: r for r in got}
    for r in corpus.collect():
        link, dots = T.LINK_RE.replace(r"\p{Nd}", "0-9").replace(r"\p{L}\p{N}", "a-zA-Z0-9"), T.DIGIT_DOT_RE
        want = (None, None) if r.text is None else (re.sub(link, "", r.text), re.sub(dots, "", r.text))
        assert (rows[r.doc_id].a, rows[r.doc_id].b) == want


def test_sentence_split_looks_at_the_last_word_alone(spark):
    rng = random.Random(5)
    pool = ["Dr.", "(Dr.", "e.g.", "\u0001", "mr.", "x", "No!", "\u2028", "\n", "\t", " ", "  ", "\u00a0", "etc.", ".", "why?"]
    texts = ["".join(w + rng.choice(["", " ", " ", "\n", "\u3000"]) for w in rng.choices(pool, k=rng.randint(0, 12))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t string")
    known = {"dr", "e.g", "mr"}
    split = A.split_after("t", sorted(known))
    got = {r.i: r.s for r in docs.select("i", split.alias("s")).collect()}

    def want(t):
        out = ""
        for p in re.split(r"(?<=[.!?])(?=\s)", t):
            last = re.search(r"(?:^|(?<=\s))(\S*)\.$", p) if p.endswith(".") else None
            out += p if last and last[1].strip(A.EDGE).lower() in known else p + "\u0001"
        return [s for s in re.split(r"\u0001(?:\s+|$)", out) if s.strip()]

    assert got == {**{i: want(t) for i, t in enumerate(texts)}, len(texts): None}
    assert "substring_index" in docs.select(split)._jdf.queryExecution().optimizedPlan().toString()
    plan = A.period_counts(docs, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [raw" in plan  # tokens are counted before they are trimmed


def test_cleaning_takes_one_pass_less_with_the_same_result(spark):
    rng = random.Random(4)
    marks = [chr(i) for i in range(128)] + list("  ..,,55##__\n\t\x1c") * 4
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 60))) for _ in range(3000)] + [None, "", " ", "."]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for commas in (False, True):
        chain = T.collapse_ws(T.remove_digit_dots(T.strip_punct("t", commas)))
        assert docs.where(~chain.eqNullSafe(T.ascii_punct_to_spaces("t", commas))).count() == 0
    plan = docs.select(T.clean_preset(F.col("t"), "module"))._jdf.queryExecution().optimizedPlan().toString()
    assert T.ASCII_RUN_RE in plan and T.PUNCT_RE not in plan


def test_kernels_give_freed_memory_back(monkeypatch):
    """A worker keeps nothing of a batch: of 40 MB of parts none is left to the pool once the batch is done."""
    given = []

    class Pool:
        def release_unused(self):
            given.append(pa.total_allocated_bytes())

    monkeypatch.setattr("precis.operators.batches.pa.default_memory_pool", Pool)
    before = pa.total_allocated_bytes()
    wide = lambda part: pa.array(np.zeros(len(part) * 1000))
    lists = pa.array([[1]] * 5000, pa.list_(pa.int32()))
    for run in (in_parts(wide), in_slices(wide, 512)):
        out = run(lists)
        assert len(out) == 5_000_000
        assert len(given) == 1 and given.pop() - before < 1.5 * out.nbytes  # the joined result, the parts are gone
        del out
