"""Statistics of text quality, and a model that tells prose from the rest.

Gradient-boosted trees over the statistics of each document are trained on weak labels: texts
that plain rules take for prose against texts that rules take for structural junk, and against
shuffled and reversed copies of the prose, as those differ from it in order alone. Pairs of words,
limits of the bins and trees come from all documents. The margin is turned into a probability by
a logistic curve fitted to a hand-checked holdout.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.boosting import BINS, Block, Boosted, in_memory
from codeweft.llm.prose_holdout import HOLDOUT
from codeweft.llm.prose_seed import SEED
from codeweft.session import cut, discard, seen

#: Up to so many training rows the trees grow in the driver, beyond in a job a level; the trees are the same.
DRIVER_ROWS = 2_000_000
TREES, DEPTH = 30, 4
#: A statistic is kept as one of so many cells of equal width between 0 and 1.
CELLS = 4096
FEATURES = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation", "common_share", "common_pairs", "known_pairs", "prose_block_share", "known_block_share",
    "words_per_line", "distinct_share", "repeated_trigrams", "identifier_share", "upper_share", "bullet_share", "space_ratio", "sentence_rate",
)
#: How the statistics that are no shares get between 0 and 1: x / width, or x / (x + half) where they have no end.
_WIDTH, _HALF = {"common_pairs": 5.0, "identifier_share": 2.0}, {"log_words": 5.0, "mean_word_length": 5.0, "words_per_line": 10.0}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: words of running text: no parts of names, paths and calls
_RUNNING = re.compile(r"(?<![\w/\\$@#.>])[^\W\d_]+(?:['’][^\W\d_]+)*(?![\w/\\(]|\.\w|->|::)")
_IDENTIFIER = re.compile(r"\b(?:[a-z]+[A-Z]\w*|\w+_\w+|[A-Z][a-z]+[A-Z]\w*)\b")
_LINES = re.compile(r"\r\n|\r|\n")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)]|\[[ x]\]|\||#\d|[\w]+:|/)")
_ENDS = (".", "!", "?", "…", ":", ".\"", ".)", "”", "»", ".'", "。")
_SENTENCE = re.compile(r"(?:^|[.!?]['\")»”]?\s+)(?:[>#*/|\s]*)[A-ZÀ-ÖØ-ÞА-ЯЁ¿¡]", re.M)


class Lexicon:
    """Frequent words by language, and the pairs of words that are known.

    A pair is known to a text if two other texts have it: ``pairs`` are known to the texts that were not
    counted, ``firm``, which a third text has, also to those that were.
    """

    def __init__(self, common: list[tuple[str, str]], pairs: frozenset[tuple[str, str]] = frozenset(), firm: frozenset[tuple[str, str]] = frozenset()) -> None:
        langs = sorted({lang for lang, _ in common})
        self.n = len(langs)
        self.mask: dict[str, int] = {}
        for lang, word in common:
            w = word.lower()
            self.mask[w] = self.mask.get(w, 0) | (1 << langs.index(lang))
        self.pairs, self.firm = pairs, firm

    def with_pairs(self, pairs: frozenset[tuple[str, str]], firm: frozenset[tuple[str, str]]) -> Lexicon:
        other = Lexicon([], pairs, firm)
        other.n, other.mask = self.n, self.mask
        return other

    def thin(self) -> Lexicon:
        """With a third of the pairs, as a text about something else would know them."""
        kept = frozenset(p for p in self.pairs if crc32(" ".join(p).encode()) % 3 == 0)
        return self.with_pairs(kept, kept & self.firm)

    def common(self, words: list[str]) -> np.ndarray:
        """Whether each word is frequent in the language with most frequent words in the text."""
        get = self.mask.get
        m = np.array([get(w, 0) for w in words], dtype=np.int64)
        if not len(m) or not self.n:
            return np.zeros(len(m), dtype=bool)
        by = (m >> np.arange(self.n)[:, None]) & 1
        return by[by.sum(axis=1).argmax()].astype(bool)


class _Tokens(dict):
    """What a piece of text without white space adds: (running words, words, letters, identifiers, capital words, digits), remembered.

    No pattern here can match or look across white space, so a text is the sum of its pieces, and
    most pieces of a corpus recur.
    """

    def __missing__(self, t: str) -> tuple:
        if len(self) > 300_000:
            self.clear()
        raw = _WORD.findall(t)
        value = tuple(w.lower() for w in _RUNNING.findall(t)), len(raw), sum(map(len, raw)), len(_IDENTIFIER.findall(t)), sum(w.isupper() and len(w) > 1 for w in raw), sum(map(str.isdigit, t))
        if len(t) <= 100:
            self[t] = value
        return value


_TOKENS = _Tokens()


def running_words(text: str) -> list[str]:
    """The words of running text, in lower case."""
    return [w for t in text.split() for w in _TOKENS[t][0]]


def statistics(text: str, lex: Lexicon) -> list[float]:
    """The FEATURES of one text that is not blank and was not counted for the pairs."""
    return _knowing(*_plain(text, lex), lex.pairs)


def _plain(text: str, lex: Lexicon) -> tuple[list[float], list[str], list[tuple[int, int, int]], int]:
    """The FEATURES of a text without known pairs, and for :func:`_knowing` its words, its lines of prose as (first word, words, letters), and its length."""
    chars = len(text)
    lines = [x for x in _LINES.split(text) if x.strip()] or [""]
    words: list[str] = []
    per_line = []
    n_raw_ = letters = idents = upper = digits = 0
    for line in lines:
        before = len(words)
        for run, k, size, i, u, d in map(_TOKENS.__getitem__, line.split()):
            words += run
            n_raw_ += k
            letters += size
            idents += i
            upper += u
            digits += d
        per_line.append(len(words) - before)
    n, n_raw = len(words), max(1, n_raw_)
    spaces = sum(map(text.count, " \t\r\n"))
    solid = max(1, chars - spaces)
    common = lex.common(words)
    c = float(common.mean()) if n else 0.0
    cc = float((common[:-1] & common[1:]).mean()) if n > 1 else 0.0
    # blocks: the words of each run of lines, cut where a line has hardly a frequent word
    at = prose = 0
    blocks = []
    upto = [0, *common.cumsum().tolist()]
    for line, k in zip(lines, per_line):
        if k >= 3 and upto[at + k] - upto[at] >= 0.2 * k:
            prose += len(line)
            if k > 3:
                blocks.append((at, k, len(line)))
        at += k
    total = sum(map(len, lines)) or 1
    repeated = max(0, n - 2) - len(set(zip(words, words[1:], words[2:])))
    x = [
        math.log1p(n_raw_), letters / n_raw, (solid - letters - digits) / solid, digits / solid, sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines), c,
        min(5.0, cc / (c * c)) if c > 0 else 0.0, 0.0, prose / total, 0.0, min(200.0, n / len(lines)),
        len(set(words)) / n if n else 0.0, repeated / max(1, n - 2), min(2.0, idents / n_raw), upper / n_raw,
        sum(_BULLET.match(x) is not None for x in lines) / len(lines), spaces / max(1, chars), min(1.0, 10 * len(_SENTENCE.findall(text)) / max(1, n)),
    ]
    return x, words, blocks, total


_AT = {f: i for i, f in enumerate(FEATURES)}


def _knowing(x: list[float], words: list[str], blocks: list[tuple[int, int, int]], total: int, pairs: frozenset[tuple[str, str]]) -> list[float]:
    known = np.fromiter(map(pairs.__contains__, zip(words, words[1:])), dtype=bool, count=max(0, len(words) - 1))
    upto = [0, *known.cumsum().tolist()]
    out = list(x)
    out[_AT["known_pairs"]] = float(known.mean()) if len(known) else 0.0
    out[_AT["known_block_share"]] = sum(size for at, k, size in blocks if upto[at + k - 1] - upto[at] >= 0.15 * (k - 1)) / total
    return out


def cells(x: list[list[float]]) -> np.ndarray:
    """The cell of each statistic; it grows with the statistic, so a limit between cells is one between values."""
    u = np.array(x, dtype=float).reshape(-1, len(FEATURES))
    for f, w in _WIDTH.items():
        u[:, _AT[f]] /= w
    for f, h in _HALF.items():
        u[:, _AT[f]] /= u[:, _AT[f]] + h
    return (np.clip(u, 0, 1) * (CELLS - 1)).astype(np.uint16)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint16).reshape(-1, len(FEATURES))


def looks_like_prose(x: list[float]) -> bool:
    """A rule without pairs of words: running sentences of frequent words with ends and beginnings."""
    g = lambda f: x[_AT[f]]
    # a long text comes back to its words and phrases
    varied = (g("distinct_share") > 0.25 and g("repeated_trigrams") < 0.5) or (g("distinct_share") * math.expm1(g("log_words")) > 60 and g("repeated_trigrams") <= 0.8)
    return g("common_share") >= 0.24 and g("prose_block_share") >= 0.8 and g("symbol_ratio") < 0.12 and g("sentence_rate") >= 0.35 and g("log_words") > 2.5 and varied


def looks_like_junk(x: list[float]) -> bool:
    """A rule for structure without sentences."""
    g = lambda f: x[_AT[f]]
    return g("common_share") < 0.1 or g("symbol_ratio") > 0.35 or g("repeated_trigrams") > 0.8


def disordered(text: str, seed: int) -> str:
    """A copy of a text that nobody reads: words shuffled or spelled backwards, or a few of them over and over."""
    r = random.Random(seed)
    words = text.split()
    kind = seed % 5
    if kind == 4:
        few = words[: 2 + seed % 4]
        return r.choice((" ", "\n")).join([" ".join(few)] * max(4, len(words) // max(1, len(few))))
    if kind == 3:
        words = [w[::-1] for w in words]
    if kind == 2:
        words = [w.strip(".,;:!?").lower() for w in words]
    r.shuffle(words)
    return " ".join(words)


def _text_rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?U)\S"))  # white space of Unicode is blank too


def document_statistics(documents: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word_count, mean_word_length, symbol_ratio, end_punctuation, common_share) of every document.

    Words are runs of letters; the symbol ratio is that of characters other than letters, digits
    and white space to all but white space; common words are those of the language with most of
    them. Null and blank texts have no words: zero everywhere.
    """
    lex = Lexicon([tuple(r) for r in common_words.select("lang", "word").na.drop().collect()])
    names = ["mean_word_length", "symbol_ratio", "end_punctuation", "common_share"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                x = statistics(t, lex) if t and not t.isspace() else [0.0] * len(FEATURES)
                rows.append((round(math.expm1(x[0])), *[x[_AT[f]] for f in names]))
            out = pd.DataFrame(rows, columns=["word_count", *names])
            out.insert(0, doc_id, b[doc_id].values)
            yield out

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id), F.col(text).alias("text")).mapInPandas(run, f"`{doc_id}` {kind}, word_count long, " + ", ".join(f"{n} double" for n in names))


class ProseModel:
    """The lexicon, the trees over cells, the two numbers of the logistic curve, and its Brier score on texts it was not fitted to."""

    def __init__(self, lex: Lexicon, trees: Boosted, slope: float, shift: float, brier: float) -> None:
        self.lex, self.trees, self.slope, self.shift, self.brier = lex, trees, slope, shift, brier

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of rows of cells."""
        return _curve(self.trees.margins(x), self.slope, self.shift)

    def score(self, table: DataFrame, doc_id: str) -> DataFrame:
        """(doc_id, probability) of the documents of a table of :func:`_measured`, in one map-side pass."""
        one = ProseModel(Lexicon([]), self.trees, self.slope, self.shift, self.brier)  # the pairs are in the cells already

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({doc_id: b[doc_id].values, "probability": one.probabilities(_unpacked(b"".join(b["cells"])))})

        kind = table.schema[doc_id].dataType.simpleString()
        return table.filter("labels is null").select(doc_id, "cells").mapInPandas(run, f"`{doc_id}` {kind}, probability double")


def _curve(margins: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margins + shift, -40, 40)))


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and labels, by damped Newton steps with smoothed targets."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(v: np.ndarray) -> float:
        p = _curve(margins, *v)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 5e-4 * (v @ v))

    v = np.array([0.0, 0.0])
    for _ in range(100):
        p = _curve(margins, *v)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * margins).sum(), (p - y).sum()]) + 1e-3 * v
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step, t = np.linalg.solve(h, g), 1.0
        while t > 1e-6 and loss(v - t * step) > loss(v):
            t /= 2
        v = v - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return max(float(v[0]), 0.05), float(v[1])


def cross_fitted(margins: np.ndarray, labels: np.ndarray, folds: int = 5) -> float:
    """The Brier score of the curve, each part of the texts judged by a curve fitted to the others."""
    part = np.arange(len(margins)) % folds
    p = np.zeros(len(margins))
    for k in range(folds):
        a, b = _platt(margins[part != k], labels[part != k])
        p[part == k] = _curve(margins[part == k], a, b)
    return float(((p - labels) ** 2).mean())


def train(documents: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> ProseModel:
    """Fits the model on all documents and a few texts written by hand.

    Two passes over the texts: the first counts the pairs of words of the prose, the second gives the
    training rows. The pairs that two texts have come to the driver and go to every task. The
    texts written by hand see to it that both classes are there whatever the documents hold.
    """
    model, table = _fit(documents, common_words, doc_id, text)
    discard(table)
    return model


def _fit(documents: DataFrame, common_words: DataFrame, doc_id: str, text: str) -> tuple[ProseModel, DataFrame]:
    """The model, and the table of :func:`_measured` it was fitted to."""
    rows = _text_rows(documents, doc_id, text)
    lex = _lexicon(rows, common_words)
    table = _measured(rows, lex, doc_id)
    hand, said = cells([statistics(t, lex) for t, _ in SEED]), np.array([float(y) for _, y in SEED])
    n, positive = seen(table, "n") or 0, seen(table, "positive") or 0
    if n <= DRIVER_ROWS:
        got = table.filter("labels is not null").select("cells", "labels").toPandas()
        x, y = np.concatenate([_unpacked(b"".join(got["cells"])), hand]), np.concatenate([_labels(b"".join(got["labels"])), said])
        limits = _limits(_cell_counts(x, y))
        sums = in_memory([Block(_binned(x, limits), y)])
    else:
        limits = _limits(_summed(table, _cell_counts, hand, said))
        sums = lambda *tree: _summed(table, lambda x, y: Block(_binned(x, limits), y).histograms(*tree), hand, said)
    trees = Boosted(TREES, DEPTH).boost(limits, float((positive + said.sum()) / (n + len(said))), sums)
    margins, labels = trees.margins(cells([statistics(t, lex) for t, _ in HOLDOUT])), np.array([float(y) for _, y in HOLDOUT])
    return ProseModel(lex, trees, *_platt(margins, labels), cross_fitted(margins, labels)), table


def _lexicon(rows: DataFrame, common_words: DataFrame) -> Lexicon:
    """The frequent words, and the pairs of words in the documents that look like prose and in those written by hand."""
    plain = Lexicon([tuple(r) for r in common_words.select("lang", "word").na.drop().collect()])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                x, words, *_ = _plain(t, plain)
                if looks_like_prose(x):
                    count.update(set(zip(words, words[1:])))
                if len(count) > 500_000:
                    yield pd.DataFrame([(*p, k) for p, k in count.items()], columns=["a", "b", "n"])
                    count.clear()
        yield pd.DataFrame([(*p, k) for p, k in count.items()], columns=["a", "b", "n"])

    counted = rows.mapInPandas(pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    got = counted.filter("n > 1").toPandas()
    known = set(zip(got["a"], got["b"]))
    firm = {p for p, n in zip(zip(got["a"], got["b"]), got["n"]) if n > 2}
    for t, prose in SEED:
        if prose:
            w = running_words(t)
            known.update(zip(w, w[1:]))
            firm.update(zip(w, w[1:]))
    return plain.with_pairs(frozenset(known), frozenset(firm))


def _measured(rows: DataFrame, lex: Lexicon, doc_id: str) -> DataFrame:
    """(doc_id, cells, labels, n, positive), written once: a row with null labels for every text, and rows without a key that pack the training rows of many.

    ``n`` and ``positive`` count training rows and those labelled as prose; their sums are taken along.
    """
    sent = rows.sparkSession.sparkContext.broadcast((lex, lex.thin()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full, thin = sent.value
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                own, training = [], []
                for t in part["text"]:
                    x, labelled = _weak_labels(t, full, thin)
                    own.append(x)
                    training += labelled
                yield pd.DataFrame({doc_id: part[doc_id].values, "cells": [r.tobytes() for r in cells(own)], "labels": None, "n": 0, "positive": 0})
                if training:
                    y = np.array([y for _, y in training], dtype=np.uint8)
                    yield pd.DataFrame({doc_id: [None], "cells": [cells([x for x, _ in training]).tobytes()], "labels": [y.tobytes()], "n": [len(y)], "positive": [int(y.sum())]})

    kind = rows.schema[doc_id].dataType.simpleString()
    out = rows.mapInPandas(run, f"`{doc_id}` {kind}, cells binary, labels binary, n int, positive int")
    return cut(out, "measured", n=F.sum("n"), positive=F.sum("positive"))


def _labels(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint8).astype(float)


def _cell_counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows by feature and cell."""
    return np.stack([np.bincount(x[:, j], minlength=CELLS) for j in range(x.shape[1])]).astype(float)


def _limits(counts: np.ndarray) -> list[np.ndarray]:
    """The quantiles of each feature over all counted rows, as cells."""
    return [np.unique(np.searchsorted(c.cumsum(), np.arange(1, BINS) / BINS * c.sum())) for c in counts]


def _binned(x: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(limit, np.arange(CELLS), "left").astype(np.uint8)[x[:, j]] for j, limit in enumerate(limits)], axis=1)


def _summed(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``of`` the rows (x, y) plus that of every packed row of the table. All are whole numbers, so no order matters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = 0
        for b in batches:
            for c, labels in zip(b["cells"], b["labels"]):
                out = out + of(_unpacked(c), _labels(labels)).ravel()
        at = np.flatnonzero(out) if np.ndim(out) else np.zeros(0, dtype=int)
        yield pd.DataFrame({"place": at, "n": out[at] if len(at) else np.zeros(0)})

    parts = table.filter("labels is not null").select("cells", "labels").mapInPandas(run, "place int, n double")
    got = parts.groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = of(x, y)
    total = out.ravel()
    total[got["place"].to_numpy(dtype=int)] += got["n"].to_numpy(dtype=float)
    return total.reshape(out.shape)


def _weak_labels(t: str, lex: Lexicon, thin: Lexicon) -> tuple[list[float], list[tuple[list[float], int]]]:
    """The FEATURES of one text, and its training rows with labels: itself where a rule is sure of it, and copies of prose that are prose or junk for sure.

    Each counts once more with a third of the pairs, as a text about something else would know them.
    A text that looks like prose was counted for the pairs, so it and its copies know firm pairs only.
    """
    plain = _plain(t, lex)
    if not looks_like_prose(plain[0]):
        x = _knowing(*plain, lex.pairs)
        return x, [(x, 0), (_knowing(*plain, thin.pairs), 0)] if looks_like_junk(x) else []
    copies = [(plain, 1)]
    bad = disordered(t, len(t))
    if bad.strip():
        copies.append((_plain(bad, lex), 0))
    # prose may be short, without capitals and ends, or in one line
    bare = [" ".join(_WORD.findall(line)).lower() for line in _LINES.split(t)]
    for other in (" ".join(bare), "\n".join(bare), _LINES.split(t)[0]):
        if other.strip():
            copies.append((_plain(other, lex), 1))
    return _knowing(*plain, lex.firm), [(_knowing(*c, known.firm), y) for c, y in copies for known in (lex, thin)]


def prose_scores(documents: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, probability): of being natural prose, for every text that is not blank.

    Whole texts are read twice, once for the pairs of words and once for their statistics and the
    training rows. Repeated rows repeat.
    """
    model, table = _fit(documents, common_words, doc_id, text)
    return model.score(table, doc_id)


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id) of the non-blank texts that are not natural prose."""
    return prose_scores(documents, common_words).filter("probability < 0.5").select("doc_id")
