"""Learned abbreviations against a plain statement of the formula, and the split against a brute-force one."""
import math
import re
from collections import Counter

from precis.functions import text as T
from precis.operators import abbreviations as A

TEXTS = ["Dr. Lim came e.g. today. He met Dr. Oey (approx. 5 km). Gone!  Back? Yes.", "dr. Tan\tcalls. The end", "", " \n ", None,
         "Dr. A saw the dog. The dog saw approx. ten. 3.5 kg, 7. x", "dog cat the dog cat dog. Dr."] * 4


def _counts():
    n, dots = Counter(), Counter()
    for t in TEXTS:
        for raw in (t or "").split():
            token = raw.strip(A.EDGE).lower()
            word = (token[:-1] if token.endswith(".") else token) if re.search(r"[^\W\d_]", token) else ""
            n[word] += 1
            dots[word] += token.endswith(".")
    return n, dots


def test_scores_equal_the_formula(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    n, dots = _counts()
    counts = A.period_counts(df)
    assert {r.word: (r.n, r.n_period) for r in counts.collect()} == {w: (n[w], dots[w]) for w in n}
    p = sum(dots.values()) / sum(n.values())
    want = {}
    for w in n:
        if w and dots[w]:
            wo, inner = n[w] - dots[w], w.count(".")
            size = len(w) - inner
            ratio = dots[w] * math.log(p / 0.99) + wo * math.log((1 - p) / 0.01)
            want[w] = -2 * ratio * math.exp(-size) * size ** -wo * (inner + 1)
    got = {r.word: r.score for r in A.abbreviation_scores(counts).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)
    learned = {r.word for r in A.learn_abbreviations(df).collect()}
    assert {"dr", "e.g"} <= learned and "dog" not in learned
    assert A.learn_abbreviations(df.where("false")).count() == 0


def _split(text, known):
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+", text):
        word = text[:m.start()].split()[-1]
        if word.endswith(".") and word[:-1].strip(A.EDGE).lower() in known - {""}:
            continue
        out.append(text[start:m.start()])
        start = m.end()
    return [s for s in out + [text[start:]] if s.strip()]


def test_split_against_brute_force(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS[:7] + ["\u0001a. b\u0001c", " lead. Dr.  x", "Dr.", "a.. b"]], "text string")
    for known in (["dr", "e.g", "approx"], []):
        for text, got, plain in df.select("text", A.split_after("text", known), T.split_sentences("text")).collect():
            assert got == (None if text is None else _split(text, set(known))), text
            if text and not known and "\u0001" not in text:
                assert got == plain
