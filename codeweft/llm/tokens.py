"""Byte-level BPE ids of whole texts by speculation and verification.

Each word is first cut by greedy longest match. A sequence of tokens is what BPE itself would
give exactly when every token encodes to itself and every adjacent pair is compatible, that is,
when merging would never have crossed the border between the two. All new adjacent pairs of a
batch are tested together with array operations that undo merges on both sides of the border;
only words with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how a text is cut into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids by each worker.
MAX_WORDS = 1_000_000
_FAR = np.int64(1) << 40


def merge_exactly(word: bytes, ranks: dict[bytes, int], below: int = 1 << 40) -> list[int]:
    """BPE of one word: again and again the adjacent pair of least rank, leftmost first, is joined.

    Pairs wait in a heap by (rank, place) over a linked list of the parts, so a long word takes
    n log n steps; a pair whose parts have changed meanwhile is passed over.
    """
    n = len(word)
    end = list(range(1, n + 1))  # part i is word[i:end[i]]; end[i] is where the next one begins
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], below)) < below]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if j <= i or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]], below)) < below:
                heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0 and (r := ranks.get(word[p:stop], below)) < below:
            heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks, the two halves of every token, and the pairs that merge; of bounded size, that of the vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n = max(self.ranks.values()) + 1
        self.size = n
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.whole = np.ones(n, dtype=bool)
        keys, made = [], []
        for token, t in self.ranks.items():
            if len(token) > 1:
                halves = merge_exactly(token, self.ranks, t)
                if len(halves) == 2:
                    self.left[t], self.right[t] = halves
                    keys.append(halves[0] * n + halves[1])
                    made.append(t)
                else:
                    self.whole[t] = False
        order = np.argsort(keys)
        self.keys, self.made = np.asarray(keys, dtype=np.int64)[order], np.asarray(made, dtype=np.int64)[order]
        self.longest = max(map(len, self.ranks))

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token each pair merges to, or a value beyond all ranks."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.made[at], _FAR)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between each pair of tokens alone.

        Merges are undone from the latest back on whichever side was made later. If at some
        stage the two pieces at the border could merge before the merge just undone, BPE would
        have crossed it.
        """
        ok = np.ones(len(first), dtype=bool)
        live = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(a), _FAR)
        while len(live):
            crossed = self.merged(a, b) < limit
            ok[live[crossed]] = False
            # undo the later merge; on a tie the right one, as merging runs from the left
            from_left = a > b
            done_a, done_b = self.left[a] == a, self.left[b] == b
            undo_left = np.where(from_left, ~done_a, done_b & ~done_a)
            undo_right = np.where(from_left, done_a & ~done_b, ~done_b)
            limit = np.where(undo_left, a, b + 1)
            keep = ~crossed & (undo_left | undo_right)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_right, self.left[b], b)
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return ok

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        out, i, n, ranks = [], 0, len(word), self.ranks
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = ranks.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out


class Encoder:
    """Ids of texts; remembers words and pairs."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.exact = 0

    def learn(self, new: list[str]) -> None:
        v, guesses, wanted = self.v, [], set()
        for w in new:
            g = v.greedy(w.encode("utf-8", "surrogatepass"))
            guesses.append(g)
            for a, b in zip(g, g[1:]):
                if (k := a * v.size + b) not in self.pairs:
                    wanted.add(k)
        if wanted:
            k = np.fromiter(wanted, dtype=np.int64, count=len(wanted))
            self.pairs.update(zip(k.tolist(), v.compatible(k // v.size, k % v.size).tolist()))
        for w, g in zip(new, guesses):
            if not (all(v.whole[t] for t in g) and all(self.pairs[a * v.size + b] for a, b in zip(g, g[1:]))):
                g = merge_exactly(w.encode("utf-8", "surrogatepass"), v.ranks)
                self.exact += 1
            self.words[w] = g
        if len(self.pairs) > 4 * MAX_WORDS:
            self.pairs.clear()

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        new = {w for ws in cut for w in ws if w not in self.words}
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, ws))) for ws in cut]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary(path), pattern)
    return _ENCODERS[path, pattern]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row: the ids of the whole, unchanged text without special tokens.

    An empty or null text gives an empty list; rows repeat as often as they come; a map-side
    pass without a shuffle. ``path`` is a vocabulary file of ranks on every executor.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, pattern)
        for b in batches:
            ids = e.encode_batch(b.column(1).to_pylist())
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
