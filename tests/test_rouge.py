import random

import pytest
from hypothesis import given, settings, strategies as st

from precis.operators.rouge import lcs_dp, lcs_length, rouge_l, rouge_n, score_pairs
from precis.plans import derived as D

CASES = [("a b c d", "a b d c", 1.0, 1 / 3, 3 / 4), ("a a b", "a b b", 2 / 3, 1 / 2, 2 / 3),
         ("A, b!", "a b", 1.0, 1.0, 1.0), ("x", "x", 1.0, 0.0, 1.0), ("", "a", 0.0, 0.0, 0.0)]


def test_rouge_goldens(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, *_) in enumerate(CASES)], "id int, pred string, gold string")
    got = {r.id: r for r in score_pairs(df, "id").collect()}
    for i, (_, _, r1, r2, rl) in enumerate(CASES):
        assert got[i].rouge1 == pytest.approx(r1) and got[i].rouge2 == pytest.approx(r2)
        assert got[i].rougeL == pytest.approx(rl)
    r1 = {r.id: r.rouge1 for r in rouge_n(df, 1, "id").collect()}
    assert r1[1] == pytest.approx(2 / 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_lcs_bit_parallel_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_rougel_query_against_brute_force(spark):
    """ROUGE-L against the textbook dynamic programme."""
    import re
    pairs = D.conversation_pairs(D.table(spark, "/root/testdata/sf0.001", "conversations"))
    scored = {r.pair_id: r.rougeL for r in rouge_l(pairs, "pair_id").collect()}
    rows = pairs.select("pair_id", "pred", "gold").collect()
    assert rows
    for r in rows:
        a = re.findall("[a-z0-9]+", r.pred.lower())
        b = re.findall("[a-z0-9]+", r.gold.lower())
        expect = 2.0 * lcs_dp(a, b) / (len(a) + len(b)) if a or b else 0.0
        assert scored[r.pair_id] == pytest.approx(expect, abs=1e-12)


def test_long_text_lcs_is_whole():
    rng = random.Random(7)
    a = [rng.choice("abcdefgh") for _ in range(3000)]
    b = [rng.choice("abcdefgh") for _ in range(2500)]
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_pairs_that_repeat_a_key_stay_apart(spark):
    from precis.operators.rouge import score_pairs
    df = spark.createDataFrame([(1, "a b", "a b"), (1, "c d", "x y")], "id long, pred string, gold string")
    assert sorted(r.rouge1 for r in score_pairs(df).collect()) == [0.0, 1.0]


def test_scores_without_exchange_and_of_odd_pairs(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", ""), (3, "a b a b", "b a b a")], "id long, pred string, gold string")
    out = score_pairs(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    got = {r.id: (r.rouge1, r.rouge2, r.rougeL) for r in out.collect()}
    assert got == {1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (1.0, pytest.approx(2 / 3), 0.75)}
    assert score_pairs(df.limit(0)).collect() == []
