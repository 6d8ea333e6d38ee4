"""Evaluation passages inside training documents.

Containment search with hash-threshold MinHash sketches: of the five-word shingles of an item
those whose hash falls below a threshold are its sketch. The sampling rate follows from the
fewest shingles that a passage worth finding leaves intact, so that a passage is missed with a
stated probability. A document whose shingles meet
enough of an item's sketch is then checked exactly: around the shared shingles the words are
aligned by edit distance, from every word of the item at which a passage can begin.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The shortest passage that counts, in words of the item, and one edit is allowed in so many words.
MIN_WORDS, ONE_EDIT_IN = 22, 8
SHINGLE = 5
#: Words of items that are sent to the executors at once; more are taken in blocks.
BLOCK_WORDS = 1_000_000
#: Probability with which the sketch may miss the passage that its edits leave the fewest shingles.
MISS = 1e-6
#: Cells of the alignments that are worked on at once, and a distance beyond any.
CELLS, FAR = 1 << 20, 1 << 20
_SEED = 3

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*+>|&(?:[a-zA-Z][a-zA-Z0-9]*+|#[0-9]++|#[xX][0-9a-fA-F]++);|\]\((?:[^()\s]|\([^()\s]*+\))*+(?:[ \t]+\"[^\"\n]*+\")?\)")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text without letter case, punctuation, markup, quoting marks and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text or "&" in text or "](" in text:
        text = _MARKUP.sub(" ", text)
    return _WORDS.findall(text.casefold())


def intact_shingles(n_words: int, edits: int, shingle: int = SHINGLE) -> int:
    """The fewest shingles of a passage that so many edits leave intact."""
    return max(0, n_words - shingle + 1 - edits * shingle)


def least_intact(size: int, min_words: int, one_edit_in: int) -> int:
    """The fewest shingles that the edits allowed leave intact in a passage of any length from ``min_words`` up to the size of its item."""
    # eight (one_edit_in) words more allow one edit more, so the remainders of one period hold the least when a period gains shingles
    longest = min_words + one_edit_in if one_edit_in > SHINGLE else 8 * min_words
    return min(intact_shingles(n, n // one_edit_in) for n in range(min_words, min(longest, size + 1)))


def size_class(size: int, min_words: int, one_edit_in: int, miss: float) -> tuple[float, int]:
    """(sampling rate, sketch entries to be met) of items of a size: a passage is no longer than its item.

    Where fewer than three of the intact shingles would be left by sampling more often than
    ``miss`` allows, nothing is left to chance: all shingles are kept and all intact ones must be met.
    """
    intact = least_intact(size, min_words, one_edit_in)
    least = max(1, min(3, intact))
    rate = sketch_rate(intact, least, miss)
    return (rate, least) if rate < 1.0 else (1.0, max(1, intact))


def sketch_rate(intact: int, least: int, miss: float = MISS) -> float:
    """The least sampling rate, in hundredths, at which fewer than ``least`` of ``intact`` shingles are kept with probability ``miss`` at most."""
    for percent in range(1, 101):
        p = percent / 100
        if sum(comb(intact, k) * p**k * (1 - p) ** (intact - k) for k in range(min(least, intact + 1))) <= miss:
            return p
    return 1.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every shingle of a sequence of word numbers."""
    n = len(ids) - SHINGLE + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(SHINGLE):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1))
    return h


class Items:
    """A block of items with their sketches, partitioned by size; of bounded size itself."""

    def __init__(self, rows: list[tuple], min_words: int, one_edit_in: int, miss: float = MISS) -> None:
        self.min_words, self.one_edit_in = min_words, one_edit_in
        self.ids, self.words, self.shingles, self.vocabulary = [], [], [], {}
        pairs: list[tuple[int, int]] = []
        self.least: list[int] = []
        classes: dict[int, tuple[float, int]] = {}
        for key, text in rows:
            w = words(text)
            if len(w) < min_words:
                continue
            i = len(self.ids)
            self.ids.append(key)
            size = min(len(w), min_words + one_edit_in)  # from here on all sizes are alike
            if size not in classes:
                classes[size] = size_class(size, min_words, one_edit_in, miss)
            rate, least = classes[size]
            limit = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))
            self.least.append(least)
            numbers = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w])
            kept = _hashes(numbers)
            self.words.append(numbers)
            self.shingles.append(kept)
            # a shingle that an item repeats counts each time
            pairs += [(int(h), i) for h in kept[kept <= limit]]
        ordered = sorted(pairs)
        self.hashes = np.array([h for h, _ in ordered], dtype=np.uint64)
        self.owners = np.array([i for _, i in ordered], dtype=np.int64)

    def numbers(self, w: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of a document as numbers (-1: in no item), and places and hashes of its shingles of known words, by hash."""
        get = self.vocabulary.get
        numbers = np.fromiter((get(x, -1) for x in w), dtype=np.int64, count=len(w))
        known = numbers >= 0
        whole = known[: max(0, len(known) - SHINGLE + 1)].copy()
        for j in range(1, SHINGLE):
            whole &= known[j : j + len(whole)]
        at = np.flatnonzero(whole)
        if not len(at):
            return numbers, at, np.zeros(0, dtype=np.uint64)
        h = _hashes(numbers)[at]
        order = np.argsort(h, kind="stable")
        return numbers, at[order], h[order]

    def candidates(self, sorted_hashes: np.ndarray) -> list[int]:
        """The items of whose sketch the shingles of a document meet enough."""
        if not len(sorted_hashes) or not len(self.hashes):
            return []
        h = np.unique(sorted_hashes)
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        met: dict[int, int] = defaultdict(int)
        for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
            for i in self.owners[a:b].tolist():
                met[i] += 1
        return [i for i, n in met.items() if n >= self.least[i]]

    def longest(self, i: int, numbers: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[int, int, int]:
        """(words of the item covered, edits, place in the document) of the longest passage within the edits allowed.

        A passage begins and ends with a word that item and document share.
        """
        item = self.words[i]
        size = len(item)
        slack = len(item) // self.one_edit_in
        low, high = np.searchsorted(hashes, self.shingles[i], "left"), np.searchsorted(hashes, self.shingles[i], "right")
        # an edit breaks so many shingles at most, so a stretch with more broken ones cannot be a passage
        broken = np.concatenate([[0], np.cumsum(high == low)])
        a, b = np.arange(size)[:, None], np.arange(size + 1)[None, :]
        may = (b - a >= max(self.min_words, SHINGLE)) & (broken[np.clip(b - SHINGLE + 1, 0, size - SHINGLE + 1)] - broken[np.minimum(a, size - SHINGLE + 1)] <= SHINGLE * ((b - a) // self.one_edit_in))
        reach = np.where(may, b, 0).max(axis=1)
        if not reach.any():
            return 0, 0, 0
        spans = []
        for q in np.flatnonzero(high > low).tolist():
            for p in at[low[q] : high[q]].tolist():
                spans.append((max(0, p - q - slack), min(len(numbers), p - q + len(item) + slack)))
        best, end = (0, 0, 0), -1
        parts: list[list[int]] = []
        for a, b in sorted(set(spans)):
            if a > end:
                parts.append([a, b])
            else:
                parts[-1][1] = max(parts[-1][1], b)
            end = parts[-1][1]
        for a, b in parts:
            n, e, p = self._aligned(item, numbers[a:b], reach, best[0])
            if n > best[0]:
                best = (n, e, a + p)
        return best

    def _aligned(self, item: np.ndarray, text: np.ndarray, reach: np.ndarray, beat: int) -> tuple[int, int, int]:
        """The longest passage in one stretch of a document, when it has more than ``beat`` words; ``reach`` bounds where one from each word of the item can end."""
        size, width = len(item), len(text)
        best, where = (max(beat, self.min_words - 1), 0), None
        same = item[:, None] == text[None, :] if size * width <= 4 * CELLS else None
        row = (lambda q: same[q]) if same is not None else (lambda q: text == item[q])
        steps = np.arange(width + 1, dtype=np.int32)
        per = max(1, min(16, CELLS // (width + 1)))
        order = np.argsort(np.arange(size) - reach, kind="stable")  # those that can be longest first
        for n in range(0, size, per):
            starts = np.sort(order[n : n + per])
            starts = starts[reach[starts] - starts > best[0]]
            if not len(starts):
                break
            # cost[s, j]: edits between the item from starts[s] on and the text up to its word j
            cost = np.full((len(starts), width + 1), FAR, dtype=np.int32)
            for q in range(int(starts[0]), int(reach[starts].max())):
                hit = row(q)
                before, new = cost, cost + 1
                new[:, 1:] = np.minimum(new[:, 1:], cost[:, :-1] + ~hit)
                begun = np.flatnonzero(starts == q)
                new[begun] = FAR
                new[begun, 1:] = np.where(hit, 0, FAR)
                cost = np.minimum.accumulate(new - steps, axis=1) + steps
                if hit.any():
                    ends = np.flatnonzero(hit) + 1
                    tail = before[:, ends - 1]  # the passage ends with this word
                    fewest = tail.min(axis=1)
                    for s in np.flatnonzero((starts <= q) & (fewest * self.one_edit_in <= q + 1 - starts) & (q + 1 - starts > best[0])).tolist():
                        if q + 1 - starts[s] > best[0]:
                            best = (int(q + 1 - starts[s]), int(fewest[s]))
                            where = (int(starts[s]), q, int(ends[tail[s].argmin()]))
                alive = ((starts > q) | (cost.min(axis=1) * self.one_edit_in <= reach[starts] - starts)) & (reach[starts] - starts > best[0])
                if not alive.all():
                    starts, cost = starts[alive], cost[alive]
                    if not len(starts):
                        break
        if where is None:
            return 0, 0, 0
        return *best, self._begin(item[where[0] : where[1] + 1], text[: where[2]], best[1])

    def _begin(self, part: np.ndarray, text: np.ndarray, edits: int) -> int:
        """Where the passage begins that ends with the text and differs from the part by so many edits."""
        back, part = text[::-1][: len(part) + edits], part[::-1]
        steps = np.arange(len(back) + 1, dtype=np.int32)
        cost = steps.copy()
        for x in part:
            new = cost + 1
            hit = back == x
            new[1:] = np.minimum(new[1:], cost[:-1] + ~hit)
            last, cost = new, np.minimum.accumulate(new - steps) + steps
        return len(text) - 1 - int(np.flatnonzero(hit & (last[1:] == edits))[-1])


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_words: int = MIN_WORDS, one_edit_in: int = ONE_EDIT_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits, at_word) of each document that holds a passage of an item.

    A passage has at least ``min_words`` consecutive words of the item with at most one edit in
    ``one_edit_in`` words, the first and the last of them in both texts; the longest is reported. Documents are scanned whole, without a
    shuffle, once for each block of at most about ``block_words`` words of items, which bounds
    what is sent to the executors. Null and short texts hold nothing; repeated rows repeat.
    """
    total = items.select(F.sum(F.size(F.split(F.col(item_text), r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_words))
    keyed = items.filter(F.col(item_text).isNotNull()).select(item_id, item_text)
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    spark = documents.sparkSession
    out = None
    for b in range(blocks):
        part = keyed.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b) if blocks > 1 else keyed
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        found = documents.filter(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(_scanner(sent, min_words, one_edit_in, doc_id, item_id, items.schema[item_id].dataType), f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, n_words int, n_edits int, at_word int")
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(sent, min_words: int, one_edit_in: int, doc_id: str, item_id: str, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(sent.value, min_words, one_edit_in)
        for batch in batches:
            take, rows = [], []
            for n, t in enumerate(batch.column(1).to_pylist()):
                w = words(t)
                if len(w) < SHINGLE:
                    continue
                known = block.numbers(w)
                for i in block.candidates(known[2]):
                    covered, edits, at = block.longest(i, *known)
                    if covered >= min_words:
                        take.append(n)
                        rows.append((block.ids[i], covered, edits, at))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], kind), *[pa.array(c, pa.int32()) for c in cols[1:]]], names=[doc_id, item_id, "n_words", "n_edits", "at_word"])

    return run


def item_texts(eval_items: DataFrame) -> DataFrame:
    """(item_id, item_text): question and answer of each item as one text."""
    return eval_items.select("item_id", F.concat_ws(" ", "question", "answer").alias("item_text"))


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(item_id, n_documents): how many documents each leaked item occurs in."""
    return leaks(documents, item_texts(eval_items)).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"))
