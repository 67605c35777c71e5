import pytest

from precis.operators.gsg import (count_without_sentences, gap_sentences, py_gsg, py_sentences, ranked_sentences,
                                  sentence_scores)
from precis.options import Options
from precis.plans import derived as D

EXAMPLE = "Pegasus is mythical . It is pure white . it names the model ."


def test_docstring_example_scores(spark):
    df = spark.createDataFrame([(1, EXAMPLE)], "doc_id bigint, text string")
    rows = {r.sid: r for r in sentence_scores(df).collect()}
    assert [rows[i].overlap for i in range(3)] == [1, 2, 1]
    assert rows[1].f1 == pytest.approx(4 / 11) and rows[0].f1 == pytest.approx(2 / 11)


@pytest.mark.parametrize("engine", ["native", "arrow"])
def test_docstring_example_pairs(spark, engine):
    df = spark.createDataFrame([(1, EXAMPLE)], "doc_id bigint, text string")
    r = gap_sentences(df, engine=engine).first()
    assert r.input == "Pegasus is mythical . <mask_1> it names the model ."
    assert r.labels == "It is pure white ."
    assert (r.m, r.k, r.n_masked) == (3, 1, 1)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, ""), (2, "One sentence only."), (3, "   ")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in gap_sentences(df).collect()}
    assert set(got) == {2}                        # empty / blank documents are dropped
    assert got[2].input == "<mask_1>" and got[2].labels == "One sentence only."


@pytest.mark.parametrize("mode", ["with_replacement", "all"])
def test_native_equals_arrow(spark, mode):
    docs = D.table(spark, "/root/testdata/sf0.001", "documents")
    a = sorted(map(tuple, gap_sentences(docs, mode=mode).collect()))
    b = sorted(map(tuple, gap_sentences(docs, mode=mode, engine="arrow").collect()))
    assert a == b and len(a) > 0


def test_mask_invariants(spark):
    docs = D.table(spark, "/root/testdata/sf0.001", "documents")
    opts = Options()
    for r in gap_sentences(docs).collect():
        u = r.k - max(0, int(r.k * opts.return_mask_rate))
        assert 1 <= r.n_masked <= max(u, 1)
        assert r.input.count("<mask_1>") == r.n_masked


def test_no_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (gap_sentences(docs), ranked_sentences(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1, plan


def test_deterministic_across_partitioning(spark):
    docs = D.table(spark, "/root/testdata/sf0.001", "documents")
    outs = [sorted(map(tuple, gap_sentences(docs.repartition(n)).collect())) for n in (1, 4, 16)]
    assert outs[0] == outs[1] == outs[2]


def test_ranked_matches_python(spark):
    docs = D.table(spark, "/root/testdata/sf0.001", "documents")
    got = {}
    for r in ranked_sentences(docs).where("selected").collect():
        got.setdefault(r.doc_id, set()).add(r.sid)
    for r in docs.collect():
        sents, expect = py_sentences(r.text or ""), py_gsg(r.doc_id, r.text or "")
        assert (expect is None) == (r.doc_id not in got)
        if expect:
            assert " ".join(sents[i] for i in sorted(got[r.doc_id])) == expect[1]
            assert len(got[r.doc_id]) == expect[3]


def test_repeated_string_and_null_ids_stay_apart(spark):
    two = "One two three. Four five six."
    df = spark.createDataFrame([("a", EXAMPLE), ("a", two), (None, two), ("b", None)], "doc_id string, text string")
    got = gap_sentences(df).collect()
    assert sorted((r.doc_id or "", r.m) for r in got) == [("", 2), ("a", 2), ("a", 3)]
    with_id = df.where("doc_id IS NOT NULL")
    assert sorted(map(tuple, gap_sentences(with_id).collect())) == sorted(
        map(tuple, gap_sentences(with_id, engine="arrow").collect()))
    assert tuple(count_without_sentences(df).first()) == (4, 1)
    assert gap_sentences(df.limit(0)).collect() == []


def test_abbreviations_in_both_engines(spark):
    from dataclasses import replace
    opts = replace(Options(), abbreviations=("dr", "e.g"))
    text = "Dr. Smith came home late. He said e.g. this. It is pure white . it names the model ."
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    a = gap_sentences(df, opts).first()
    b = gap_sentences(df, opts, engine="arrow").first()
    assert tuple(a) == tuple(b) and a.m == 4
