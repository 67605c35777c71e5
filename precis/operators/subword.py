"""Subword segmentation and the statistics of a unigram model, word by word.

The pieces are a prefix trie (nested dictionaries), which drivers build once and share by broadcast: a walk from each
character meets all pieces that start there and stops where none goes on, so the cost follows the matches, not the
longest piece. Scores are whole millionths of a natural logarithm: sums are exact, and paths that are equal are equal on
every machine. Of equal paths the one with the shortest last piece counts, then the one before it, and so on."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MICRO = 1_000_000
UNKNOWN = -1_000 * MICRO  # a character that no piece covers
_END = ""                 # trie key of a node's own value
_NONE = -(1 << 62)


def micro(logp: float) -> int:
    """A log-probability in whole millionths."""
    return round(logp * MICRO)


def trie(values: Iterable[tuple[str, object]]) -> dict:
    """Prefix trie of (piece, value)."""
    root: dict = {}
    for piece, value in values:
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[_END] = value
    return root


def viterbi(word: str, pieces: dict, whole: bool = True) -> tuple[int, list[int]]:
    """(score, piece ends) of the best segmentation. ``whole=False`` leaves the word itself out as a piece."""
    n = len(word)
    best, back = [_NONE] * (n + 1), [0] * (n + 1)
    best[0] = 0
    for i in range(n + 1):
        if i and best[i] == _NONE:
            best[i], back[i] = best[i - 1] + UNKNOWN, i - 1
        here, node, e = best[i], pieces, i
        while e < n:
            node = node.get(word[e])
            if node is None:
                break
            e += 1
            score = node.get(_END)
            if score is not None and here + score >= best[e] and (whole or e - i < n):
                best[e], back[e] = here + score, i
    ends, at = [], n
    while at:
        ends.append(at)
        at = back[at]
    return best[n], ends[::-1]


def segment(word: str, pieces: dict) -> list[str]:
    ends = viterbi(word, pieces)[1]
    return [word[a:b] for a, b in zip([0, *ends], ends)]


class Segmenter:
    """``segment`` for many words at once: the trie as a table of successors (node by character), and the words side by
    side, so that a step from one character to the next is one look into the table for all of them.

    ``scores`` and ``ids`` belong to the pieces; a character that no piece covers has the id ``unknown``. Words longer than
    LONGEST, and all words where the table would have more than CELLS cells, go one by one."""

    LONGEST = 32
    CELLS = 4_000_000

    def __init__(self, scores: dict[str, int], ids: dict[str, int], unknown: int, prefix: str = ""):
        self.ids, self.unknown, self.prefix, self.scores = ids, unknown, prefix, scores
        self.tree = None  # made for the first word that goes by itself
        nodes = {"": 0}
        for piece in scores:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        letters = sorted({ord(n[-1]) for n in nodes if n} | {ord(c) for c in prefix})
        self.table = None
        if len(nodes) * (len(letters) + 1) > self.CELLS:
            return
        self.letter = np.zeros(max(letters, default=0) + 2, np.int32)  # 0: in no piece
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.table = np.zeros(len(nodes) * self.width, np.int32)
        self.score = np.full(len(nodes), _NONE)
        self.piece = np.full(len(nodes), unknown, np.int32)
        for name, node in nodes.items():
            if name:
                self.table[nodes[name[:-1]] * self.width + self.letter[ord(name[-1])]] = node
            if name in scores:
                self.score[node], self.piece[node] = scores[name], ids.get(name, unknown)
        self.deepest = max(map(len, scores), default=0)

    def alone(self, word: str) -> list[int]:
        if self.tree is None:
            self.tree = trie(self.scores.items())
        return [self.ids.get(x, self.unknown) for x in segment(self.prefix + word, self.tree)]

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many pieces each word has, ids of all pieces word by word). No word is null."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        short = size <= self.LONGEST if self.table is not None else np.zeros(len(size), bool)
        single = {int(i): self.alone(words[i].as_py()) for i in np.flatnonzero(~short)}
        count = np.zeros(len(size), np.int64)
        at = np.flatnonzero(short)
        at = at[np.argsort(-size[at], kind="stable")]  # the longest first: those that go on stand in front
        found = self._together(words, size, at) if len(at) else np.zeros((0, 0), np.int32)
        ends = found >= 0
        count[at] = ends.sum(axis=1)
        for i, x in single.items():
            count[i] = len(x)
        ids = np.empty(count.sum(), np.int32)
        first = np.cumsum(count) - count
        n = count[at]
        ids[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())] = found[ends]
        for i, x in single.items():
            ids[first[i]:first[i] + len(x)] = x
        return count, ids

    def _together(self, words: pa.Array, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For the words ``at``, the longest first: the id of the piece that ends behind each character, or -1."""
        text = "".join(words.to_pylist()) if len(at) == len(words) else "".join(words.take(pa.array(np.sort(at))).to_pylist())
        code = self.letter[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(self.letter) - 1)]
        held = np.zeros(len(size), np.int64)
        held[at] = size[at]
        start = (np.cumsum(held) - held)[at]
        head = len(self.prefix)
        long = size[at] + head
        n, top = len(at), int(long[0])
        going = np.searchsorted(-long, -np.arange(top + 2), side="right")  # how many words have that many characters
        letters = np.zeros((top, n), np.int32)
        for i, c in enumerate(self.prefix):
            letters[i] = self.letter[ord(c)]
        for i in range(head, top):
            letters[i, :going[i + 1]] = code[start[:going[i + 1]] + i - head]
        best, back = np.full((top + 1, n), _NONE), np.zeros((top + 1, n), np.int32)
        piece = np.full((top + 1, n), self.unknown, np.int32)
        best[0] = 0
        for i in range(top + 1):
            if i:
                lost = np.flatnonzero(best[i, :going[i]] == _NONE)
                best[i, lost], back[i, lost] = best[i - 1, lost] + UNKNOWN, i - 1
            if i == top:
                break
            some, node = np.arange(going[i + 1]), np.zeros(going[i + 1], np.int32)
            for e in range(i + 1, min(i + self.deepest, top) + 1):
                if e > i + 1:
                    more = np.searchsorted(some, going[e])
                    some, node = some[:more], node[:more]
                node = self.table[node * self.width + letters[e - 1, some]]
                on = np.flatnonzero(node)
                some, node = some[on], node[on]
                if not len(some):
                    break
                score = self.score[node]
                total = best[i, some] + score
                win = np.flatnonzero((score != _NONE) & (total >= best[e, some]))
                won = some[win]
                best[e, won], back[e, won], piece[e, won] = total[win], i, self.piece[node[win]]
        out = np.full((n, top + 1), -1, np.int32)
        row, end = np.arange(n), long.copy()
        while len(row):
            row, end = row[end > 0], end[end > 0]
            out[row, end] = piece[end, row]
            end = back[end, row]
        return out[:, 1:]


def expected_counts(word: str, pieces: dict) -> dict[str, float]:
    """How often each piece occurs in the word, over all segmentations by their probability (forward-backward over the
    lattice); nothing for a word that the pieces do not cover."""
    n = len(word)
    arcs: list[list[tuple[int, float]]] = []
    for i in range(n):
        node, e, out = pieces, i, []
        while e < n:
            node = node.get(word[e])
            if node is None:
                break
            e += 1
            score = node.get(_END)
            if score is not None:
                out.append((e, score / MICRO))
        arcs.append(out)

    def add(a: float, b: float) -> float:
        low, high = (a, b) if a < b else (b, a)
        return high if low == -math.inf else high + math.log1p(math.exp(low - high))

    ahead = [-math.inf] * (n + 1)
    ahead[0] = 0.0
    for i in range(n):
        for e, p in arcs[i]:
            ahead[e] = add(ahead[e], ahead[i] + p)
    if ahead[n] == -math.inf:
        return {}
    rest = [-math.inf] * (n + 1)
    rest[n] = 0.0
    for i in reversed(range(n)):
        for e, p in arcs[i]:
            rest[i] = add(rest[i], p + rest[e])
    out: dict[str, float] = defaultdict(float)
    for i in range(n):
        for e, p in arcs[i]:
            weight = ahead[i] + p + rest[e] - ahead[n]
            if weight > -700:
                out[word[i:e]] += math.exp(weight)
    return out


def bpe(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The word's symbols after all merges in the order of their ranks, leftmost first. Symbols are a linked list, open
    pairs a heap, so a word of n characters costs n log n."""
    symbols: list[str | None] = list(word)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two was merged meanwhile
        k = after[j]
        symbols[i], symbols[j], after[i] = a + b, None, k
        if k < n:
            before[k] = i
            if (a + b, symbols[k]) in ranks:
                heapq.heappush(heap, (ranks[a + b, symbols[k]], i, a + b, symbols[k]))
        p = before[i]
        if p >= 0 and (symbols[p], a + b) in ranks:
            heapq.heappush(heap, (ranks[symbols[p], a + b], p, symbols[p], a + b))
    return [s for s in symbols if s is not None]
