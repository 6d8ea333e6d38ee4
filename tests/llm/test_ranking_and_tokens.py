import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import ranking, tokens

HITS = "query_id long, node_id string, bm25_score double, vector_score double, fuzzy_score double, score double, rank string"


def brute_heads(rows):
    best = {}
    for q, n, *s, _, _ in rows:
        if q is None or n is None:
            continue
        b = best.setdefault(q, {}).setdefault(n, [None] * 3)
        for i, v in enumerate(s):
            if v is not None and not math.isnan(v) and v != 0.0:
                b[i] = v if b[i] is None else max(b[i], v)
    out = set()
    for q, hits in best.items():
        for n, s in hits.items():
            if all(v is not None and sum(o[i] is not None and o[i] > v for o in hits.values()) <= 1 for i, v in enumerate(s)):
                out.add((q, n))
    return out


def random_hits(seed):
    r = random.Random(seed)
    some = lambda top: r.choice([None, 0.0, float("nan"), -0.5, round(r.random() * top, 1), round(r.random() * top, 1), 1e9])
    return [(r.choice([1, 2, 3, None]), r.choice([f"n{i}" for i in range(9)] + [None]), some(50), some(1), some(100), 1.0, "clash") for _ in range(150 if seed < 3 else 40)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_heads_are_those_of_brute_force(spark, seed):
    rows = random_hits(seed)
    got = [tuple(r) for r in ranking.heads(spark.createDataFrame(rows, HITS)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_heads(rows)


def test_ranking_is_not_ruled_by_the_widest_scale(spark):
    rows = [(1, "even", 40.0, 0.9, 90.0, None, ""), (1, "one", 50.0, 0.1, 10.0, None, ""), (1, "low", 1.0, 0.2, 20.0, None, ""), (2, "only", None, None, 5.0, None, ""), (3, "bare", None, float("nan"), 0.0, None, "")]
    df = spark.createDataFrame(rows, HITS)
    got = {(r["query_id"], r["node_id"]): r for r in ranking.ranking(df).collect()}
    assert got[1, "even"]["rank"] == 1 and got[2, "only"]["closeness"] == 0.5 and got[3, "bare"]["n_above"] is None
    scaled = df.withColumn("fuzzy_score", df["fuzzy_score"] * 1000)
    assert {k: r["rank"] for k, r in got.items()} == {(r["query_id"], r["node_id"]): r["rank"] for r in ranking.ranking(scaled).collect()}
    assert ranking.ranking(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.Vocabulary(tokens.VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "\n\n  x\t", "Don't stop: it's 10,000.5 km!!", "naïve café ß/ẞ 👩‍💻 ​ Ω≈", "<|endoftext|> a<|endoftext|>", "  leading   and trailing  ", "Если вызвать дважды", "日本語のテキスト", "x" * 3000, "ab" * 2000 + "!" * 500, "﻿a b c\r\nd", "'s 'll're've'd 'M", "١٢٣ ½ ²", "\x00\x01\x7f"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_public_tokenizer(encoder, reference, text):
    assert encoder.encode_batch([text])[0] == reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(encoder, reference, text):
    ids = encoder.encode_batch([text])[0]
    assert ids == reference.encode(text, add_special_tokens=False).ids
    names = {v: k for k, v in encoder.v.ranks.items()}
    assert b"".join(names[i] for i in ids).decode() == text


def test_compatible_pairs_are_those_that_merging_leaves(encoder):
    import numpy as np

    r = random.Random(4)
    v = encoder.v
    names = {i: k for k, i in v.ranks.items()}
    a, b = [np.array([r.randrange(v.size) if r.random() < 0.5 else r.randrange(2000) for _ in range(3000)]) for _ in range(2)]
    keep = v.whole[a] & v.whole[b]
    a, b = a[keep], b[keep]
    want = [tokens.merge_exactly(names[x] + names[y], v.ranks) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert v.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_long_words_are_merged_as_short_ones(encoder):
    def plainly(word, ranks):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    r = random.Random(5)
    for _ in range(300):
        word = bytes(r.choice(b"aabehtn ") for _ in range(r.randint(1, 40)))
        assert tokens.merge_exactly(word, encoder.v.ranks) == plainly(word, encoder.v.ranks)
    word = bytes(r.choice(b"abcdefgh") for _ in range(8000))
    began = time.time()
    tokens.merge_exactly(word, encoder.v.ranks)
    assert time.time() - began < 1


def test_encoding_a_table(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "a b", "c"), (1, "a b", "c"), (1, "a b", "c")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), list(r["ids"])) for r in tokens.encode(df).collect())
    assert got[0][1] == got[3][1] == got[2][1] != [] and (1, []) in got and (2, []) in got
    assert tokens.encode(df.limit(0)).count() == 0
