"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns with names the operators use themselves."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from precis.llm import chat, decontaminate, lm, packing, sharding, simhash, suffix, topk, toxicity
from precis.llm.components import components
from precis.llm.decontaminate import contamination, drop_contaminated

SCHEMA = "doc_id long, text string, lang string, _id string, _text int, _key long"


def prose(rng, n):
    parts = ["the", "of", "an", "tion", "re", "st", "é", "ing", "ou", "ble"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    shared, base = prose(rng, 120), prose(rng, 200)
    out = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    out += [prose(rng, 30) + "\n" + shared + " " + prose(rng, 40) for _ in range(5)]
    out += [base, base, base.replace("the", "The", 1), base + " end", base.upper()]
    out += [None, "", "  \n ", "x", "x", "a" * 5000, "ab " * 900, prose(rng, 20000), "tab\tand\x0bmore", "É" * 500,
            "a <|endoftext|> b", "x<|startoftext|>Y<|ENDOFTEXT|>z"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "q", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", "en", None, None, None), (60, "second text of an id", "de", None, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- SimHash ------------------------------------------------------------------------------------------------------

def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    u = sorted(set(prints))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in u}


def test_simhash_against_brute_force(docs):
    data = rows_of(docs.select("doc_id", "text"))
    roots = brute_components([brute_print(t) for _, t in data])
    low = {}
    for i, t in data:
        r = roots[brute_print(t)]
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    want = sorted(((i, brute_print(t), low[roots[brute_print(t)]]) for i, t in data), key=str)
    got = sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(low.values(), key=str) == sorted((r.doc_id for r in kept.collect()), key=str)


def test_simhash_links_are_complete_and_single(spark):
    rng = random.Random(5)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    got = rows_of(simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long")))
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)] + [(120, 100), (100, 100)]
    got = dict(rows_of(components(spark.createDataFrame(chain + star, "u long, v long"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


# ---- packing ------------------------------------------------------------------------------------------------------

def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def test_pieces_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows_of(docs.select("doc_id", "text")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k // 512, k, len(ids[k:k + 512]), zlib.crc32(ids[k:k + 512].tobytes())) for k in range(0, len(ids), 512)]
    got = rows_of(packing.pieces(docs, tokenizer_path(), capacity=512))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_word_ids_on_odd_words():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    words = ["it's", "'s.", "x.y", "a...", "?!", "1.", "12,", "ÀÉ", "é", "İ", "ß.", "日本。", "<|endoftext|>", "\x1cab", "a b",
             "don't!", "ǅ", "ŉ", "ﬁ", "Σας", "--", ".'s", "\x01", "naïve,", "퟿", "ª", "º.", "Å"]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(200)]
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = packing.WordIds(f.read(), max_words=20)
    got = [x.tolist() for i in range(0, 200, 10) for x in own.encode(t.encode() for t in texts[i:i + 10])]  # forgets between
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_gapless_and_tight(docs, nothing):
    cut = packing.pieces(docs, tokenizer_path(), capacity=512, with_ids=True)
    rows = packing.pack(cut, 512).collect()
    assert len(rows) == cut.count() and all(len(r.ids) == r.length for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 512) + 1
    assert packing.pack(packing.pieces(nothing, tokenizer_path())).count() == 0


def test_plan_bins_places_every_length():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = np.zeros(65, np.int64)
        np.add.at(counts, rng.integers(1, 65, rng.integers(1, 400)), 1)
        left = counts.copy()
        for pattern, k in packing.plan_bins(counts):
            assert sum(n * m for n, m in pattern.items()) <= 64 and k > 0
            for n, m in pattern.items():
                left[n] -= m * k
        assert not left.any()


def test_replacement_fills_a_bin_better():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # 6 + 3 leaves 1; for 3, the two of 2 fill it
    assert packing.plan_bins(counts) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]


# ---- chat ---------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "[\\INST] \\ <\\\\s>", "<", "[", "<role>a</role>b</turn>", "é" * 40, "", None, "<sys>\n</sys>"]
    rows = [(c, i, r, t) for c in (1, 2, None) for i, (r, t) in enumerate(
        [(r, t) for r in ("user", "assistant", "system", "to<role>ol", None) for t in odd])]
    rows += [(3, None, "user", "no turn"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for size in (16, 1 << 20):
        parts = chat.format_chats(df, part_bytes=size)
        got = {r.conv_id: r for r in chat.chat_digests(parts).collect()}
        assert set(got) == {1, 2, 3, None}
        for c in got:
            mine = sorted(((t is not None, t or 0), r is not None, r or "", x is not None, x or "") for cc, t, r, x in rows if cc == c)
            turns = "".join(f"{r}\n{x}\n" for _, _, r, _, x in mine)
            loss = "".join(x for _, _, r, _, x in mine if r == "assistant")
            assert got[c].n_turns == len(mine)
            assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0


# ---- suffix arrays ------------------------------------------------------------------------------------------------

def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    """Words are no measure: what two texts share goes where it has 400 bytes, and stays where it has fewer."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice((2, 4, 5, 6, 8))))
    passages = [" ".join(word() for _ in range(n)) for n in range(51, 96, 2) for _ in range(2)]
    rows = [(2 * i + k, f"{word()}{k}[{p}]{k}{word()}") for i, p in enumerate(passages) for k in (0, 1)]
    left = {r.doc_id: r.text for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shared = [len(p) + 2 for p in passages]  # with the brackets
    assert min(shared) < 380 and max(shared) > 480
    for i, (p, n) in enumerate(zip(passages, shared)):
        for k in (0, 1):
            before = rows[2 * i + k][1]
            assert left[2 * i + k] == (before.replace(f"[{p}]", "") if n >= 400 else before), n


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for n in range(120):
        t = bytes(rng.choice(b"abc" if n % 2 else b"ab") for _ in range(rng.randint(1, 90))) * rng.randint(1, 3)
        got = suffix.suffix_array(np.frombuffer(t, np.uint8), max(8, len(t)))
        assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_of_wanted_suffixes_is_sorted():
    rng = random.Random(4)
    for n in range(120):
        t = bytes(rng.choice(b"abc\xff" if n % 2 else b"ab") for _ in range(rng.randint(1, 90))) * rng.randint(1, 3)
        wanted = np.array([rng.random() < n / 120 for _ in t])
        got = suffix.suffix_array(np.frombuffer(t, np.uint8), max(8, len(t)), wanted).tolist()
        assert [i for i in got if wanted[i]] == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: t[i:])
        assert len(got) == len(set(got))


def test_suffixes_that_start_no_window_are_not_sorted(monkeypatch):
    """Of regions with few windows little more than these is sorted directly, not half of all bytes."""
    rng = random.Random(4)
    regions = [prose(rng, 150).encode()[:440] for _ in range(50)]
    regions += [r[20:30] + regions[0][30:430] + r[:5] for r in regions[1:9]]
    sizes, direct = [], suffix._sorted_directly
    monkeypatch.setattr(suffix, "_sorted_directly", lambda w, pos, d: sizes.append(len(pos)) or direct(w, pos, d))
    got = suffix.repeated_windows(regions, 400)
    seen = collections.Counter(r[i:i + 400] for r in regions for i in range(len(r) - 399))
    assert [x.tolist() for x in got] == [[i for i in range(len(r) - 399) if seen[r[i:i + 400]] > 1] for r in regions]
    assert sum(sizes) < 1.2 * sum(len(r) - 399 for r in regions)


def brute_spans(data, length):
    seen = collections.Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = True
        out.append(cover[:-1])
    return out


def test_repeats_against_brute_force(docs, nothing):
    data = rows_of(docs.select("doc_id", "text"))
    raw = [(t or "").encode() for _, t in data]
    want = []
    for (i, _), t, c in zip(data, raw, brute_spans(raw, 400)):
        kept = bytes(np.frombuffer(t, np.uint8)[~c])
        want.append((i, len(t), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum()),
                     hashlib.sha256(kept).hexdigest()))
    assert sorted(rows_of(suffix.removal_report(docs)), key=str) == sorted(want, key=str)
    cleaned = suffix.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(data)
    assert suffix.removal_report(nothing).count() == 0 and suffix.remove_repeats(nothing).count() == 0


def test_anchors_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    inner = prose(rng, 300)
    rows = [(1, prose(rng, 900) + inner + prose(rng, 700)), (2, prose(rng, 5) + inner), (3, "ha" * 700)]
    monkeypatch.setattr(suffix, "_SLICE", 4096)  # slices with overlap
    data = [t.encode() for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix.removal_report(docs).collect()}
    assert got == {i: int(c.sum()) for (i, _), c in zip(rows, brute_spans(data, 400))}


def test_repeats_of_one_anchor_in_bounded_groups(spark, docs, monkeypatch):
    """A notice shorter than a window, each time between other text, some of that twice; also all fixtures."""
    rng = random.Random(10)
    rows, data = [], rows_of(docs.select("text"))
    for size in (200, 399):
        notice = prose(rng, 200)[:size]
        for i in range(60):
            before, after = prose(rng, 120)[-300:], prose(rng, 120)[:300]
            rows.append(before + notice + after)
            if i % 10 == 0:  # the notice with some more bytes, on one side or both
                rows.append(prose(rng, 50) + before[-90:] + notice + after[:150] + prose(rng, 50))
                rows.append(prose(rng, 50) + before[-(400 - size):] + notice + prose(rng, 50))
    rows += [t for t, in data] + rows[:3]
    whole = suffix.repeated_windows

    def bounded(regions, length):
        assert sum(map(len, regions)) < 40000
        return whole(regions, length)

    monkeypatch.setattr(suffix, "SHARE", 4000)
    monkeypatch.setattr(suffix, "repeated_windows", bounded)
    raw = [(t or "").encode() for t in rows]
    want = [(i, int(c.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~c])).hexdigest())
            for i, (t, c) in enumerate(zip(raw, brute_spans(raw, 400)))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = suffix.removal_report(df).select("doc_id", "n_removed", "kept_sha256")
    assert sorted(rows_of(got)) == want


# ---- Katz backoff -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [2000, 1 << 24])
def test_katz_against_brute_force(docs, chunk):
    trains = F.col("doc_id") % 3 != 0
    data = rows_of(docs.select("doc_id", "text"))
    token = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) + [" "] for _, t in data]
    learn = [i is not None and i % 3 != 0 for i, _ in data]
    uni, pair, start = collections.Counter(), collections.Counter(), collections.Counter()
    for t, yes in zip(token, learn):
        if yes:
            uni.update(t), pair.update(zip(["", *t], t)), start.update(["", *t][:-1])
    total, vocabulary = sum(uni.values()), len(uni)
    d1, d2 = (lm.discounts(np.array([sum(v == r for v in c.values()) for r in range(1, 7)])) for c in (uni, pair))
    taken = sum(c * (1 - d1[min(c, 6)]) for c in uni.values())

    def p1(w):
        return uni[w] * d1[min(uni[w], 6)] / total if uni[w] else taken / total

    follow = collections.defaultdict(list)
    for (a, b), c in pair.items():
        follow[a].append((b, c))

    def p2(a, b):
        if not start[a]:
            return p1(b)
        kept = sum(c * d2[min(c, 6)] for _, c in follow[a])
        div = start[a] + (kept >= start[a] * (1 - 1e-12))
        if pair[a, b]:
            return pair[a, b] * d2[min(pair[a, b], 6)] / div
        return (1 - kept / div) / (1 - sum(p1(w) for w, _ in follow[a])) * p1(b)

    for a in ("", "the", "a" * 5000, "never"):
        assert abs(sum(p2(a, w) for w in uni) + p2(a, "\0") - 1) < 1e-9
    got = {}
    for r in lm.scores(docs, trains, chunk_bytes=chunk).collect():
        got.setdefault((r.doc_id, r.n_tokens), r)
    for (i, _), t in zip(data, token):
        r = got[i, len(t)]
        if i == 3 or i == 60:
            continue  # repeated ids: more texts
        assert r.n_known == sum(uni[w] > 0 for w in t) and r.train_tokens == total
        assert math.isclose(r.base_score, sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p2(a, b)) for a, b in zip(["", *t], t)), rel_tol=1e-9)


def test_katz_without_rows_or_training(docs, nothing):
    assert lm.scores(nothing, F.lit(True)).count() == 0
    rows = lm.scores(docs, F.lit(False)).collect()
    assert len(rows) == docs.count() and all(r.score == 0 and r.n_known == 0 for r in rows)


# ---- the others ---------------------------------------------------------------------------------------------------

def test_sharding_keeps_the_limit(docs, nothing, spark):
    limit = 4000
    rows = rows_of(sharding.shards(docs, limit))
    assert sorted((i, n) for i, _, n in rows if i is not None) == sorted(
        (i, len((t or "").encode())) for i, t in rows_of(docs.select("doc_id", "text")) if i is not None)
    size, count = collections.Counter(), collections.Counter()
    for _, s, n in rows:
        size[s] += n
        count[s] += 1
    assert all(v <= limit or count[s] == 1 for s, v in size.items())
    for s in size:  # buckets are disjoint prefixes
        assert not any(o != s and o.startswith(s) for o in size)
    same = spark.createDataFrame([(1, "a" * 100)] * 50, "doc_id long, text string").repartition(4)
    paged = collections.Counter(r.shard for r in sharding.shards(same, 350).collect())
    assert sum(paged.values()) == 50 and max(paged.values()) == 3
    assert sharding.shards(nothing, limit).count() == 0


def test_decontamination_tolerates_substitutions(spark, nothing):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, "too short"), (7, None), (0, None)]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    clean = [prose(rng, 200) for _ in range(8)]
    changed = items[1][1].split()
    changed[6] = changed[17] = "changed"
    rows = [(i, t) for i, t in enumerate(clean)] + [
        (10, clean[0] + " " + items[0][1].upper().replace(" ", ", ") + "."), (11, clean[1] + " " + " ".join(changed)),
        (12, " ".join(items[2][1].split()[4:20])), (13, None), (14, ""), (15, "too short"), (None, items[3][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id int, overlap string")
    got = {r.doc_id: r for r in contamination(df, items_df).collect()}
    assert {i: r.item_id for i, r in got.items() if r.contaminated} == {10: 0, 11: 1, 12: 2, None: 3}
    assert got[10].overlap == 30 and got[11].overlap == 26 and got[12].overlap == 16
    kept = drop_contaminated(df, items_df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(8), 13, 14, 15]
    assert contamination(nothing, items_df).count() == 0
    assert not any(r.contaminated for r in contamination(df, items_df.limit(0)).collect())


def test_seeds_miss_no_pattern_of_substitutions():
    """All matches and substitutions, word by word: the last SPAN pairs and the score so far are all that counts."""
    span = decontaminate.SPAN
    seeds = [sum(1 << (span - 1 - o) for o in s) for s in decontaminate.SEEDS]
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        window, score = todo.pop()
        for match in (0, 1):
            state = (window << 1 | match) & ((1 << span) - 1), score + (1 if match else -1)
            if state[1] > 0 and state not in seen and not any(state[0] & s == s for s in seeds):
                assert state[1] < decontaminate.LEAST
                seen.add(state)
                todo.append(state)


def test_decontamination_against_scores_alone(spark):
    rng = random.Random(12)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (20, 30, 42)]
    rows = []
    for item in items:
        for phase in range(5):  # every fifth word
            rows.append([f"x{i}" if i % 5 == phase else w for i, w in enumerate(item)])
        for _ in range(60):
            rate = rng.choice((0.2, 0.3, 0.4))
            rows.append([f"x{i}" if rng.random() < rate else w for i, w in enumerate(item)])
    want = {}
    for i, text in enumerate(rows):
        for k, item in enumerate(items):
            best = 0
            for shift in range(-len(item), len(text)):  # every way to lay one beside the other
                now = 0
                for j, w in enumerate(item):
                    now = max(0, now + (1 if 0 <= j + shift < len(text) and text[j + shift] == w else -1))
                    best = max(best, now)
            if best >= decontaminate.LEAST:
                want[i] = (k, best)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.overlap) for r in contamination(docs, df).collect() if r.contaminated}
    assert got == want and 100 < len(want) < len(rows)


def test_decontamination_scores_whole_passages_and_takes_any_item_id(spark):
    rng = random.Random(13)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other = [w if i % 7 else f"y{i}" for i, w in enumerate(passage)]
    df = spark.createDataFrame([("b", " ".join(passage), 1), ("a", " ".join(passage), 1), ("c", " ".join(other), 1),
                                (None, " ".join(passage[:40]), 1)], "item_id string, text string, _h int")
    rows = [(1, "x " * 50 + " ".join(passage) + " x" * 50, 7), (2, " ".join(passage[150:]), 7), (3, "x " * 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int")
    got = {r.doc_id: (r.item_id, r.overlap, r.n_items) for r in contamination(docs, df).collect()}
    assert got == {1: ("a", 200, 4), 2: ("a", 50, 3), 3: (None, 0, 0)}


def test_decontamination_of_a_periodic_text(spark):
    """20,000 equal words beside 100 equal words: every way to lay them is scored once."""
    docs = spark.createDataFrame([(1, "w " * 20_000), (2, "v w " * 5_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w " * 100), (2, "v w " * 30)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.overlap, r.n_items) for r in contamination(docs, items).collect()}
    assert got == {1: (1, 100, 1), 2: (2, 60, 1)}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)] + [(300 + i, base[7].tolist(), "x") for i in range(40)]
    rows += [(900, None, "x"), (950, [float("nan")] * 8, "x"), (1000, [1.0, None] * 4, "x"), (1050, [2.0, 1.0], "x"),
             (1100, [1.0, 1.0], "x"), (1150, [], "x"), (None, base[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    valid = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows
             if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for i, v in valid:
        if i % 50 == 0:
            near = sorted((-int(v @ w), j) for j, w in valid if j != i and len(w) == len(v))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(near, 1)]
    assert sorted(rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0))) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 2.0])] * 6 + [(2, [1.0, 2.0]), (3, [1.0, 2.0])] + [(i, [0.5, 0.5]) for i in (50, 50, 60, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = rows_of(topk.top_k(df, F.col("vec_id") == 50))
    assert sorted(got) == [(50, 1, 1, 98304), (50, 2, 2, 98304), (50, 3, 3, 98304), (50, 4, 60, 32768)]


def test_cover_tree_covers():
    x = np.concatenate((np.random.default_rng(1).normal(size=(400, 3)), np.zeros((30, 3))))
    tree = topk.Tree(x, [[i] for i in range(len(x))])
    assert sorted(tree.ids.tolist()) == list(range(len(x))) and len(tree.radius) > 5
    for (a, b), c, r in zip(tree.span, tree.center, tree.radius):
        assert np.sqrt(((tree.x[a:b] - c) ** 2).sum(axis=1)).max() <= r + 1e-9


def test_toxicity_learns_words_and_misspellings(spark, nothing):
    rng = random.Random(6)
    bad = ["idiotic", "worthless", "disgusting", "pathetic"]
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, rng.choice((6, 30, 300))).split()
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, " ", 0.0), (None, "x", 0.0), (903, "you disgustingg man", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known, F.col("doc_id") % 5 != 0, per_class=300)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(0, 400, 5)]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[903] > 0.7 and max(got[900], got[901], got[902]) < 0.7
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}
    nobody = toxicity.fit(nothing, known, F.lit(True))
    assert toxicity.score(nothing, nobody).count() == 0 and toxicity.score(docs, nobody).count() == len(rows)


def test_license_scan(spark, nothing):
    from precis.llm import licenses
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) + "\n" + prose(rng, 20), "f") for i in range(30)]
    rows += [(100, "Licensed under the Apache License, Version 2.0.\n" + prose(rng, 10), "f"), (101, None, "f"), (102, "", "f"),
             (103, prose(rng, 10) + "\n\nReleased under the MIT License", "f"), (None, "ALL RIGHTS RESERVED!", "f"),
             (104, "the license of the driver was under the car", "f"), (103, prose(rng, 4), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string")
    model = licenses.fit(docs)
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs, model).collect()}
    assert got == {(100, 0, "apache"), (103, 2, "mit"), (None, 0, "reserved")}
    assert licenses.scan(nothing, licenses.fit(nothing)).count() == 0


def test_licenses_learn_from_every_paragraph(spark):
    """Paragraphs beyond the first 2,000 documents (or 6,000 paragraphs) in any order count, each as often as it occurs."""
    from precis.llm import licenses
    docs = spark.range(7000).selectExpr("id AS doc_id", "concat('the license of car ', id, '\nno ', id, ' part of it') AS text")
    seen = []
    plain = licenses.LogisticRegression.fit

    def fit(self, df, *args):
        seen.append({r.label: r.n for r in df.groupBy("label").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()})
        return plain(self, df, *args)

    licenses.LogisticRegression.fit = fit
    try:
        licenses.fit(docs)
    finally:
        licenses.LogisticRegression.fit = plain
    unknown = seen[0][float(len(licenses.TEMPLATES))]
    later = docs.selectExpr("explode(split(text, '\n')) AS t").selectExpr("xxhash64(split(t, ' ')) AS h").where("pmod(h, 3) = 0")
    assert unknown == 14000 - later.count() + 1 and unknown > 9000
