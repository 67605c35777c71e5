"""Periodic runs of words, found on a grammar.

Each text's words become a Re-Pair grammar: the pair of symbols that occurs most often (twice at least) becomes a new
symbol until no pair repeats. A run lies across the boundary of the smallest symbol that holds it, so runs are looked
for once at the boundary of each symbol, at its first place, and between the symbols of the sequence that is left; they
are then carried to all places of the symbol's derivation, and those of one period that overlap in a period or more
are merged.

At a boundary p, a run of period q with four periods has two of them on one side, so the q words after p repeat at
p + q (or the q before p repeat at p - q). Hashes of 1, 2, 4, .. words name candidates: for q in [g, 2g) the g words at
the boundary occur again q places on. Their square is compared through two such hashes, its extent word by word."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import codes, mix, salts, slices, word_lists

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def repair(seq: list[int], occurrences: dict[tuple[int, int], list[int]]) -> tuple[list[tuple[list[int], int, int]], list[int]]:
    """Re-Pair grammar of ``seq`` (symbols >= 0; ``occurrences``: places, ascending, of its pairs that occur twice or
    more). Returns the rules in order of making, as (all places where the symbol is derived, length of its left part, its
    length), and the places where a symbol of the final sequence starts.

    A pair's occurrences all arise when the younger of its symbols is made and only vanish later, so the recorded
    places are an upper bound; a pair is counted anew when it comes up, and goes back if it lost some."""
    n = len(seq)
    sym, nxt, prv = list(seq), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-len(p), p[0], pair) for pair, p in occurrences.items()]
    heapq.heapify(heap)
    rules, fresh = [], max(seq, default=0) + 1
    while heap:
        count, first, pair = heapq.heappop(heap)
        a, b = pair
        live, taken = [], -1
        for i in occurrences[pair]:
            if sym[i] == a and i != taken:
                j = nxt[i]
                if j < n and sym[j] == b:
                    live.append(i)
                    taken = j
        if len(live) < 2:
            continue
        if len(live) < -count:
            heapq.heappush(heap, (-len(live), live[0], pair))
            continue
        i = live[0]
        rules.append((live, nxt[i] - i, nxt[nxt[i]] - i))
        for i in live:
            j = nxt[i]
            k = nxt[j]
            sym[i], sym[j], nxt[i] = fresh, -1, k
            if k < n:
                prv[k] = i
        new = defaultdict(list)
        for i in live:
            p, k = prv[i], nxt[i]
            if p >= 0:
                new[sym[p], fresh].append(p)
            if k < n and sym[k] != fresh:
                new[fresh, sym[k]].append(i)
        for other, places in new.items():
            if len(places) > 1:
                occurrences[other] = places
                heapq.heappush(heap, (-len(places), places[0], other))
        fresh += 1
    return rules, [i for i in range(n) if sym[i] >= 0]


def _repeated(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of the places ``among`` whose values (hashes) occur there more than once, by value, then by place."""
    v = values[among]
    bits = max(10, int(len(v)).bit_length() + 1)
    bucket = (v >> np.uint64(64 - bits)).astype(np.int64)  # most values are alone in their bucket: no sort for them
    some = among[np.bincount(bucket, minlength=1 << bits)[bucket] > 1]
    some = some[np.argsort(values[some], kind="stable")]
    v = values[some]
    same = v[1:] == v[:-1]
    return some[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(some) else some


def _grammars(code: np.ndarray, pair_hash: np.ndarray, doubled: np.ndarray, offs: np.ndarray):
    """Boundaries of all texts (place, first, end of the symbol around it, rule number or -1) and the rules
    (text, places, length)."""
    by_text = defaultdict(dict)
    owner = (np.searchsorted(offs, doubled, side="right") - 1).tolist()
    groups = np.flatnonzero(np.concatenate(([True], pair_hash[doubled[1:]] != pair_hash[doubled[:-1]]))) if len(doubled) else []
    ends = np.append(groups[1:], len(doubled)).tolist() if len(doubled) else []
    place = doubled.tolist()
    for a, b in zip(list(groups), ends):
        at, text = place[a], owner[a]
        off = int(offs[text])
        by_text[text][int(code[at]), int(code[at + 1])] = [x - off for x in place[a:b]]
    is_start, rules, bounds = np.ones(len(code), bool), [], []
    for text, pairs in by_text.items():
        off, end = int(offs[text]), int(offs[text + 1])
        made, starts = repair(code[off:end].tolist(), pairs)
        mask = np.zeros(end - off, bool)
        mask[starts] = True
        is_start[off:end] = mask
        for places, left, length in made:
            if length >= MIN_LENGTH:
                bounds.append((off + places[0] + left, off + places[0], off + places[0] + length, len(rules)))
                rules.append((text, places, length))
    is_start[offs[:-1][np.diff(offs) > 0]] = False  # no boundary before the first word
    p = np.flatnonzero(is_start)
    text = np.searchsorted(offs, p, side="right") - 1
    whole = np.stack([p, offs[text], offs[text + 1], np.full(len(p), -1)])
    inner = np.array(bounds, np.int64).reshape(-1, 4).T
    return np.concatenate((inner, whole), axis=1), rules


def _squares(h: np.ndarray, g: int, repeated: np.ndarray, bounds: np.ndarray):
    """(boundary number, q, start) by q in [g, 2g): the q words on one side of the boundary stand there twice, the
    first time at ``start``. One square of each stretch comes out."""
    p, lo, hi, _ = bounds
    hits = [np.zeros((3, 0), np.int64)]
    rank = np.full(len(h), -1, np.int64)
    rank[repeated] = np.arange(len(repeated))
    for right in (True, False):
        use = np.flatnonzero((p + 2 * g <= hi) if right else (p - 2 * g >= lo))
        x = p[use] if right else p[use] - g
        at = rank[x]
        use, x, at = use[at >= 0], x[at >= 0], at[at >= 0]
        step = 1 if right else -1
        while len(use):
            at = at + step
            inside = (at >= 0) & (at < len(repeated))
            use, x, at = use[inside], x[inside], at[inside]
            y = repeated[at]
            q = (y - x) * step
            near = (h[y] == h[x]) & (q < 2 * g) & (4 * q <= hi[use] - lo[use])
            use, x, at, q = use[near], x[near], at[near], q[near]
            fits = (q >= g) & (p[use] + 2 * q <= hi[use] if right else p[use] - 2 * q >= lo[use])
            b, d = use[fits], q[fits]
            first, last = (p[b], p[b] + d - g) if right else (p[b] - 2 * d, p[b] - d - g)
            equal = (h[first] == h[first + d]) & (h[last] == h[last + d])
            hits.append(np.stack([b[equal], d[equal], first[equal]]))
    b, d, first = np.concatenate(hits, axis=1)
    order = np.lexsort((first, d, bounds[3][b], bounds[1][b]))  # squares that overlap in a period are one stretch
    b, d, first = b[order], d[order], first[order]
    new = np.ones(len(b), bool)
    new[1:] = ((bounds[3][b[1:]] != bounds[3][b[:-1]]) | (bounds[1][b[1:]] != bounds[1][b[:-1]]) | (d[1:] != d[:-1])
               | (first[1:] > first[:-1] + d[1:]))
    order = np.argsort(d[new], kind="stable")
    return list(zip(b[new][order].tolist(), d[new][order].tolist(), first[new][order].tolist()))


def _extent(code: np.ndarray, at: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The longest stretch of period q within [lo, hi) that holds the square [at, at + 2q)."""
    a, b, size = at, at + q, 64  # code[i] == code[i + q] for i in [a, b)
    while b + q < hi:
        k = min(size, hi - q - b)
        same = code[b:b + k] == code[b + q:b + q + k]
        good = k if same.all() else int(same.argmin())
        b, size = b + good, size * 2
        if good < k:
            break
    size = 64
    while a > lo:
        k = min(size, a - lo)
        same = (code[a - k:a] == code[a - k + q:a + q])[::-1]
        good = k if same.all() else int(same.argmin())
        a, size = a - good, size * 2
        if good < k:
            break
    return a, b + q


def find_runs(code: np.ndarray, hashes: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Text number -> its runs (start, length, period) by start and period, for texts that have any. ``code``: word numbers
    of all texts, ``hashes``: of the numbered words, ``offs``: n + 1 offsets."""
    n = len(code)
    sizes = np.diff(offs)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = mix(hashes[code] + salts(len(sizes), 21)[owner]) if n else np.zeros(0, np.uint64)
    ends = offs[1:][owner]
    m1, m2 = salts(2, 22)

    alone = salts(n, 23)

    def twice(h, g, among):  # hashes of 2g words at some places; elsewhere a value that no other place has
        out = alone.copy()
        fits = among[among + 2 * g <= ends[among]]
        out[fits] = mix(h[fits] * m1 + h[fits + g] * m2)
        return out, _repeated(out, fits)

    pairs, repeated = twice(h, 1, np.arange(n))
    bounds, rules = _grammars(code, pairs, repeated, offs)
    p, lo, hi, rule = bounds
    found = defaultdict(list)  # (text, rule) -> (start, end, period), smaller periods first

    def add(i, q, at):
        text = int(owner[p[i]])
        mine = found[text, int(rule[i])]
        if any(q % d == 0 and s <= at and at + 2 * q <= e for s, e, d in mine):
            return  # part of a known run, or of one with a smaller period
        mine.append((*_extent(code, at, q, int(lo[i]), int(hi[i])), q))

    for right in (True, False):  # period 1
        x = p if right else p - 2
        ok = np.flatnonzero((x >= lo) & (x + 2 <= hi))
        for i in ok[code[x[ok]] == code[x[ok] + 1]].tolist():
            add(i, 1, int(x[i]))
    g, h = 2, pairs
    while len(repeated):
        for square in _squares(h, g, repeated, bounds):
            add(*square)
        h, repeated = twice(h, g, repeated)
        g *= 2

    spread = defaultdict(lambda: defaultdict(list))  # text -> period -> intervals, from 0
    for (text, number), mine in found.items():
        off = int(offs[text])
        for s, e, q in mine:
            if e - s < max(MIN_LENGTH, MIN_EXPONENT * q):
                continue
            if number < 0:
                spread[text][q].append((s - off, e - off))
            else:
                places = rules[number][1]
                base = off + places[0]
                spread[text][q] += [(s - base + x, e - base + x) for x in places]
    out = {}
    for text, by_period in spread.items():
        runs = []
        for q, parts in by_period.items():
            parts.sort()
            start, end = parts[0]
            for s, e in parts[1:]:
                if s <= end - q:
                    end = max(end, e)
                else:
                    runs.append((start, end - start, q))
                    start, end = s, e
            runs.append((start, end - start, q))
        out[text] = sorted(runs, key=lambda r: (r[0], r[2]))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``runs`` (array of start, length, period; by start, then period)
    and ``collapsed`` (the words kept, joined by one space).

    A run is a stretch of words of smallest period q, 4q words long at least and no less than 6, that no neighbouring
    word extends; a word goes if a run holds it beyond its first q words. Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``; repeated rows are rows of their own, null ids stay, an empty table gives an empty
    result; columns beside the two named are not looked at."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
                           T.StructField("collapsed", T.StringType())])
    schema = T.StructType([T.StructField("_id", schema[0].dataType), *schema.fields[1:]])

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                flat, offs = word_lists(b.column(1), lower=False)
                code, hashes = codes(flat)
                runs = find_runs(code, hashes, offs)
                keep = np.ones(len(code), bool)
                for text, mine in runs.items():
                    for s, size, q in mine:
                        keep[offs[text] + s + q:offs[text] + s + size] = False
                upto = np.concatenate(([0], np.cumsum(keep)))[offs].astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(upto), flat.filter(pa.array(keep)))
                rows = [runs.get(t, []) for t in range(b.num_rows)]
                cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                table = np.array([r for mine in rows for r in mine], np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T],
                                                    names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(cuts), fields),
                     pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=schema.names)

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)
