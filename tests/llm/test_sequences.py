"""MinHash near-duplicates, conversation repair and periodic runs against brute force: nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns with names the operators use themselves."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precis.llm import conversations, minhash, periodic, q_conversations, q_minhash, q_periodic
from precis.llm.words import codes, word_lists

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, node string, _id string, n int, _text string, root long, key int"


def prose(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


# ---- MinHash ------------------------------------------------------------------------------------------------------

def brute_sets(rows, width):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def brute_near(rows, width, percent):
    """(id, size, component id) of each row."""
    sets = brute_sets(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            root[find(a)] = find(b)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return [(rows[i][0], len(sets[i]), min(low[find(i)], default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    out = list(base)
    for t in base:
        w = t.split()
        for _ in range(rng.randint(0, 6)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(("new", "W1", "x"))
            out.append("  ".join(v))
    chain = prose(rng, 60).split()
    out += [" ".join(chain[i:i + 40]) for i in range(20)]  # neighbours link, the ends do not
    out += [None, "", " \n\t", None, "one", "ONE", "one two", "one two three", "a b c d", "a b c d e", "A b\x0bc d",
            "b\x1cc d", "é É", "É é", prose(rng, 20000, 9000), "same " * 3000, "same " * 50]
    rows = [(i * 7 % 997, t) for i, t in enumerate(out)]
    return rows + [rows[2], rows[2], (None, base[0]), (None, "alone and without any id"), (None, None)]


@pytest.mark.parametrize("width,percent", [(4, 80), (2, 50)])
def test_minhash_against_brute_force(spark, copies, width, percent):
    df = spark.createDataFrame([(*r, "x", "y", 1, "z", 2, 3) for r in copies], SCHEMA).repartition(3)
    got = minhash.near_duplicates(df, shingle=width, percent=percent).collect()
    want = brute_near(copies, width, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in q_minhash.op11_minhash_dedup(spark, SF).collect())
    assert got == sorted(brute_near(rows, 4, 80))


def test_minhash_drops_and_empty_tables(spark, copies):
    rows = [r for r in dict((r[0], r) for r in copies if r[0] is not None).values()]
    df = spark.createDataFrame([(*r, "x", "y", 1, "z", 2, 3) for r in rows], SCHEMA)
    kept = minhash.drop_near_duplicates(df, shingle=4)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute_near(rows, 4, 80) if c == d)
    nothing = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.drop_near_duplicates(nothing).count() == 0


def test_a_family_whose_members_only_meet_in_the_middle(spark):
    """Copies of one text with changes of their own: linked with it, hardly with each other."""
    rng = random.Random(8)
    text = prose(rng, 100, 5000).split()
    rows = [(0, " ".join(text))]
    for i in range(1, 60):
        v = list(text)
        for k in rng.sample(range(4, 96), 2):
            v[k] = f"own{i}"
        rows.append((i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect())
    assert got == sorted(brute_near(rows, 4, 80)) and len({c for *_, c in got}) < 5


def test_packed_signatures_estimate_the_similarity(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        own = [rng.integers(0, 2**63, n - len(both)).astype(np.uint64) for _ in range(2)]
        sets = [np.sort(np.concatenate((both, o))) for o in own]
        want.append(len(both) / (2 * n - len(both)))
        sig, _ = minhash.signatures(minhash.minima(np.concatenate(sets), np.array([0, n, 2 * n])), 6)
        rows.append((*sig.tolist(),))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r[0] for r in df.select(minhash.estimate(F.col("a"), F.col("b"))).collect()]
    assert np.abs(np.array(got) - want).max() < 0.13 and got[-1] == 1.0


def test_minima_of_blocks_equal_those_at_once():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 3, 70000, 0, 1, 40000, 5])
    offs = np.concatenate(([0], np.cumsum(sizes)))
    sets = rng.integers(0, 2**63, offs[-1]).astype(np.uint64)
    got = minhash.minima(sets, offs)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    for row, (a, b) in zip(got, [(a, b) for a, b in zip(offs, offs[1:]) if b > a]):
        for j in (0, 17, 255):
            assert row[j] == ((x[a:b] ^ minhash._HASH_XOR[j]) * minhash._HASH_MUL[j]).min()


# ---- conversation repair ------------------------------------------------------------------------------------------

def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        chars = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = ("blank" if not chars else "duplicate" if (role, text) in seen else
                 "truncated" if chars[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_repair(rows):
    """All repairs with at most two insertions before each row and at the end: (cost, audit, turns)."""
    def go(i, cost, audit, turns):
        for k in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=k):
                now = turns + [(r, "") for r in roles]
                c, a = cost + 3 * k, audit + "I" * k
                if not re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in now)):
                    continue
                if i == len(rows):
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in now)):
                        yield c, a, now
                    continue
                role, text, fault = rows[i]
                yield from go(i + 1, c + 4, a + "D", now)
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 if fault else 0
                yield from go(i + 1, c + more, a + "K", now + [(role, text)])
                for r in ("user", "assistant"):
                    yield from go(i + 1, c + more + 3, a + "R", now + [(r, text)])
    return go(0, 0, "", [])


def best_repair(rows):
    """The same by a plain table over rows and states that keeps whole strings."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def insert(table):
        for _ in range(2):
            for state, (c, a, t) in list(table.items()):
                for r in "ua":
                    to = after.get((state, r))
                    new = (c + 3, a + "I", t + ((names[r], ""),))
                    if to and new < table.get(to, (9e9,)):
                        table[to] = new
        return table

    for role, text, fault in rows:
        new = {}

        def offer(state, value):
            if value < new.get(state, (9e9,)):
                new[state] = value

        before = dict(best)
        for state, (c, a, t) in before.items():
            offer(state, (c + 4, a + "D", t))
        if fault not in ("blank", "duplicate"):
            more = 3 if fault else 0
            for state, (c, a, t) in insert(dict(best)).items():
                if (state, role[:1]) in after:
                    offer(after[state, role[:1]], (c + more, a + "K", t + ((role, text),)))
                for r in "ua":
                    if (state, r) in after:
                        offer(after[state, r], (c + more + 3, a + "R", t + ((names[r], text),)))
        best = new
    return min(insert(dict(best))[s] for s in ("", "a") if s in insert(dict(best)))


def brute_report(rows):
    """rows: (turn, role, text) of one conversation -> the columns of the report and the digests."""
    rows = sorted(((t is not None, t or 0), " " if r is None else r, " " if x is None else x) for t, r, x in rows)
    marked = faults([(r, x) for _, r, x in rows])
    turns = [t for (some, t), _, _ in rows if some]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [sum(f == kind for *_, f in marked) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, turns = best_repair(marked)
    text = "\n".join(f"{r}:{x}" for r, x in turns)
    return (gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def random_rows(rng, n):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why? ", "and", "So.", None]
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "tool", "", "assistant", "user", None]),
             rng.choice(texts)) for _ in range(n)]


def test_the_plain_table_equals_all_repairs():
    rng = random.Random(2)
    for _ in range(250):
        rows = faults([(r or " ", x or " ") for _, r, x in random_rows(rng, rng.randint(0, 3))])
        cost, audit, turns = min(every_repair(rows), key=lambda r: r[:2])
        assert best_repair(rows) == (cost, audit, tuple(turns))


def test_hirschberg_equals_the_plain_table():
    rng = random.Random(3)
    for _ in range(300):
        rows = faults([(r or " ", x or " ") for _, r, x in random_rows(rng, rng.randint(1, 40))])
        steps = [conversations.kind(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, _, f in rows]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=3))
        parts = [p for p in (steps[a:b] for a, b in zip([0, *cuts], [*cuts, len(steps)])) if p]
        walk = conversations.Chain()
        for p in parts:
            walk.add(*conversations.table(p))
        total, states = walk.states()
        edits = [e for p, a, b in zip(parts, [0, *states], states) for e in conversations.hirschberg(p, a, b)]
        want = best_repair(rows)
        assert (total, "".join(edits) + conversations._END[states[-1]][1]) == want[:2]


def solved(spark, rows, parts=3):
    df = spark.createDataFrame([(c, t, r, x, 1, 2) for c, t, r, x in rows],
                               "conv_id long, turn long, role string, text string, part int, n int").repartition(parts)
    report, out = conversations.repair_conversations(df)
    digests = {r[0]: tuple(r[1:]) for r in conversations.repaired_digests(out).collect()}
    return {r[0]: (*r[1:], *digests[r[0]]) for r in report.collect()}


@pytest.mark.parametrize("limit", [2, 4096])
def test_conversations_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(conversations, "PART_ROWS", limit)
    rng = random.Random(5)
    rows = [(c, *r) for c in [None, *range(40)] for r in random_rows(rng, rng.randint(1, 12))]
    rows += [(50, i, ("user", "assistant")[i % 2], f"text {i}" + "." * (i % 3)) for i in range(300)]
    rows += [(51, 0, "user", "again.")] * 7 + [(52, None, None, None)] + [(53, 0, "user", "x" * 200000)]
    got = solved(spark, rows)
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    assert got == {c: brute_report(r) for c, r in by.items()}
    assert solved(spark, []) == {}


def test_conversations_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for c, t, r, x in rows:
        h = zlib.crc32(f"{c}:{t}".encode()) % 20
        mine = by[c]
        if h:
            x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
            mine += [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    got = {r[0]: tuple(r[1:]) for r in q_conversations.op12_conversation_repair(spark, SF).collect()}
    assert got == {c: brute_report(r) for c, r in by.items()} and sum(v[5] for v in got.values()) > 0


def test_a_conversation_that_loses_all_rows_is_reported(spark, tmp_path):
    gone = next(c for c in range(10000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    hit = next(c for c in range(10000) if zlib.crc32(f"{c}: ".encode()) % 20 == 1)
    spark.createDataFrame([(gone, 0, "user", "x."), (hit, None, "user", "x."), (None, None, None, None)],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in q_conversations.op12_conversation_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert set(got) == {gone, hit, None}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert tuple(got[hit])[1:] == (0, 1, 0, 0, 0, 4, "D", empty)


# ---- periodic runs ------------------------------------------------------------------------------------------------

def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.add((s, i + q - s, q))
    return sorted(r for r in out if not any(r[2] % q == 0 and q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in out))


def periodic_text(rng):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH"[:rng.choice([1, 2, 2, 3, 5, 30])]
    w, n = [], rng.randint(0, 150)
    while len(w) < n:
        if rng.random() < 0.3:
            u = rng.choices(letters, k=rng.randint(1, 12))
            w += [u[i % len(u)] for i in range(rng.randint(1, 6 * len(u)))]
        elif w and rng.random() < 0.3:
            at = rng.randrange(len(w))
            w += w[at:at + rng.randint(1, 40)]
        else:
            w.append(rng.choice(letters))
    return w


def test_runs_against_brute_force():
    rng = random.Random(6)
    some = 0
    for _ in range(60):
        texts = [periodic_text(rng) for _ in range(20)]
        flat, offs = word_lists(pa.array([" ".join(t) for t in texts]), False)
        found = periodic.find_runs(*codes(flat), offs)
        for i, t in enumerate(texts):
            assert found.get(i, []) == brute_runs(t)
            some += len(found.get(i, []))
    assert some > 1000


def test_grammar_derives_the_text_and_no_pair_repeats():
    rng = random.Random(7)
    for _ in range(100):
        w = [ord(c) for c in periodic_text(rng)]
        pairs = defaultdict(list)
        for i, p in enumerate(zip(w, w[1:])):
            pairs[p].append(i)
        rules, starts = periodic.repair(w, {p: v for p, v in pairs.items() if len(v) > 1})
        for places, left, length in rules:
            assert len(places) > 1 and 0 < left < length and len({tuple(w[i:i + length]) for i in places}) == 1
            assert all(b - a >= length for a, b in zip(places, places[1:]))
        ends = [*starts[1:], len(w)]
        last = [tuple(w[a:b]) for a, b in zip(starts, ends)]
        places = defaultdict(list)
        for i, p in enumerate(zip(last, last[1:])):
            places[p].append(i)
        assert all(v[-1] - v[0] < 2 for v in places.values())  # only overlapping ones are left


def digests(words):
    runs = brute_runs(words)
    keep = [i for i in range(len(words)) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(words[i] for i in keep))))


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r[1:]) for r in q_periodic.op13_periodic_runs(spark, SF).collect()}
    assert got == {i: digests(planted(i, t)) for i, t in rows} and sum(v[0] > 0 for v in got.values()) > 5


def test_runs_on_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    hot = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n ", "x", "a " * 5000, "A a " * 40, "é\x0bé\té é\x0cé é", "b\x1cb " * 9, "$1 \\2 " * 8, prose(rng, 9000),
             " ".join(f"t{i % 700}" for i in range(3500)), *(" ".join(periodic_text(rng)) for _ in range(30))]
    rows = list(enumerate(texts)) + [(h, t) for h, t in zip(hot, texts)] + [(3, "x"), (None, "q " * 9), (None, None)]
    spark.createDataFrame([(*r, 1, "r", 5) for r in rows], "doc_id long, text string, runs int, collapsed string, _text int"
                          ).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, q_periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *digests(planted(i, t))) for i, t in rows), key=str)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int").where("doc_id < 0")
    assert periodic.periodic_runs(df).count() == 0
