import random

import pytest

from codeweft.llm import leaks, prose
from codeweft.llm.prose_holdout import HOLDOUT

R = random.Random(8)
VOCABULARY = [f"{a}{b}" for a in ("tor", "mel", "qui", "bras", "fen", "lor", "sti", "wex") for b in ("an", "ock", "ish", "ute", "ary", "ond", "elf", "ump")]
ITEMS = [(i, " ".join(R.choice(VOCABULARY) for _ in range(60))) for i in range(30)]
FILL = ["the", "list", "was", "sorted", "again", "after", "a", "while", "and", "nobody", "knew", "why"]


def noise(n, r):
    return " ".join(r.choice(FILL) for _ in range(n))


def passage(i, n, edits, r):
    w = ITEMS[i][1].split()
    a = r.randrange(len(w) - n + 1)
    part = w[a : a + n]
    # edits lie inside, spread out
    for k in range(edits):
        at = (k + 1) * n // (edits + 1)
        part[at] = r.choice(["zzz", "", "zz " + part[at]])
    return " ".join(x for x in part if x)


def test_planted_passages_are_found_and_short_ones_are_not(spark):
    r = random.Random(1)
    docs, want = [], set()
    for n in range(240):
        i = r.randrange(len(ITEMS))
        kind = n % 4
        if kind == 0:
            p = passage(i, 24, 2, r)
            want.add((n, i))
        elif kind == 1:
            p = passage(i, 48, 5, r)
            want.add((n, i))
        elif kind == 2:
            p = passage(i, 16, 0, r)
        else:
            p = ""
        if n % 3 == 0:
            p = ", ".join(p.split()).upper()
        if n % 5 == 0:
            p = "\n> ".join(f"<b>{x}</b>" for x in p.split())
        if n % 7 == 0:
            p = p.replace("a", "​a")
        docs.append((n, noise(r.randrange(60), r) + " " + p + " " + noise(r.randrange(60), r), "clash"))
    docs += [(1000, None, ""), (1001, "", ""), (1002, ITEMS[3][1], ""), (1002, ITEMS[3][1], "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, "too short"), (97, "")], "item_id long, item_text string")
    got = [(x["doc_id"], x["item_id"]) for x in leaks.leaks(df, items).collect()]
    assert set(got) == want | {(1002, 3)} and got.count((1002, 3)) == 2
    blocks = {(x["doc_id"], x["item_id"]) for x in leaks.leaks(df, items, block_words=500).collect()}
    assert blocks == set(got)
    assert leaks.leaks(df.limit(0), items).count() == 0 and leaks.leaks(df, items.limit(0)).count() == 0


def test_the_sketch_misses_as_seldom_as_stated():
    intact = leaks.intact_shingles(22, 2)
    assert intact == 8
    p = leaks.sketch_rate(intact, 3)
    from math import comb

    assert sum(comb(8, k) * p**k * (1 - p) ** (8 - k) for k in range(3)) <= leaks.MISS < sum(comb(8, k) * (p - 0.01) ** k * (1.01 - p) ** (8 - k) for k in range(3))
    assert leaks.sketch_rate(100, 3) < 0.3 and leaks.sketch_rate(2, 3) == 1.0


def test_words_ignore_form():
    assert leaks.words("“Half-SETTLED”  <em>row</em> &amp; **b​old** [x](http://y.z)") == ["half", "settled", "row", "b" + "old", "x"]
    assert leaks.words(f"a [b](http://y.z/{'q/' * 300}) <i class='{'x' * 300}'>c</i> [d](u_(v) \"t\") a < b") == ["a", "b", "c", "d", "a", "b"]


def test_sketches_find_nearly_all_that_the_exact_check_finds():
    """Recall of the sketch, at a far higher chance of a miss than is used, against the exact check of every pair."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([22, 23, 26, 40, 90])))) for i in range(60)]
    exact, sketched = leaks.Items(items, 22, 8), leaks.Items(items, 22, 8, miss=0.02)
    hits = found = 0
    for i, text in items:
        w = text.split()
        n = r.randint(22, len(w))
        at = r.randrange(len(w) - n + 1)
        part = w[at : at + n]
        for _ in range(r.randint(0, n // 8)):
            part[r.randrange(1, n - 1)] = r.choice(vocabulary)
        doc = [r.choice(vocabulary) for _ in range(30)] + part + [r.choice(vocabulary) for _ in range(30)]
        known = exact.numbers(doc)
        true = {j for j in range(len(items)) if exact.longest(j, *known)[0] >= 22}
        hits += len(true)
        found += len(true & set(sketched.candidates(sketched.numbers(doc)[2])))
    assert hits >= 55 and found >= 0.99 * hits
    assert {len(sketched.shingles[i]) - int((sketched.owners == i).sum()) > 0 for i in range(60) if len(items[i][1].split()) < 24} == {True}


COMMON = [("en", w) for w in "the of and to a in is that it for on with as are this by be from or not have but which when they we was if can all its only so after before no may must into their other than then one each out up".split()] + [("de", w) for w in "der die das und in zu den ist nicht von mit dem ein eine auf es sich wird auch nur noch sie wir".split()]
SUBJECTS = ["The nightly job", "A reviewer", "Each branch", "The new page", "Our import", "This class", "The old list"]
VERBS = ["reads the rows in order", "sends a message to the desk", "keeps a copy of the table", "waits for the other step", "writes the sum into the report", "must not run before the feed"]
ENDS = ["when the month is over", "if the field is empty", "because it was so before", "after the last row has come", "and then it stops", "so that no one has to wait"]


def make_prose(r):
    return " ".join(f"{r.choice(SUBJECTS)} {r.choice(VERBS)}, {r.choice(ENDS)}." for _ in range(r.randrange(3, 12)))


def make_junk(r):
    words = [r.choice(["order", "branch", "rate", "label", "open", "sealed", "ledger", "total"]) for _ in range(40)]
    return r.choice([" ".join(words), "\n".join(f"- {w} {w}_id" for w in words), ";".join(words), "\n".join(f"| {a} | {r.randrange(99)} |" for a in words), "{\n" + "\n".join(f'  "{w}": {r.randrange(9)},' for w in words) + "\n}"])


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    rows, truth = [], {}
    for n in range(400):
        kind = n % 5
        t = make_prose(r)
        if kind == 3:
            t = make_junk(r)
        elif kind == 4:
            w = t.replace(".", "").replace(",", "").lower().split()
            r.shuffle(w)
            t = " ".join(w)
        rows.append((n, t, "x"))
        truth[n] = int(kind < 3)
    rows += [(900, None, "x"), (901, " \n ", "x"), (902, "", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, probability string"), spark.createDataFrame(COMMON, "lang string, word string"), truth


def test_prose_is_told_from_junk(corpus):
    docs, common, truth = corpus
    got = {r["doc_id"] for r in prose.not_prose(docs, common).collect()}
    assert not got & {900, 901, 902}
    wrong = [n for n, y in truth.items() if (n not in got) != bool(y)]
    assert len(wrong) <= 8


def test_statistics_of_documents(spark, corpus):
    _, common, _ = corpus
    df = spark.createDataFrame([(1, "The cat is here.\nYes!", 0), (2, None, 0), (3, "  ", 0), (4, "x" * 100_000, 0)], "doc_id long, text string, word_count int")
    got = {r["doc_id"]: r for r in prose.document_statistics(df, common).collect()}
    assert got[1]["word_count"] == 5 and got[1]["end_punctuation"] == 1.0 and got[1]["mean_word_length"] == pytest.approx(15 / 5) and got[1]["common_share"] == pytest.approx(0.4)
    assert got[2]["word_count"] == got[3]["word_count"] == 0 and got[4]["word_count"] == 1


def test_nothing_to_learn_from(spark, corpus):
    _, common, _ = corpus
    none = spark.createDataFrame([], "doc_id long, text string")
    assert prose.not_prose(none, common).count() == 0
    junk = spark.createDataFrame([(1, "a;b;c"), (2, "|x|")], "doc_id long, text string")
    assert prose.not_prose(junk, common).count() == 2


def test_the_holdout_is_balanced_and_distinct():
    assert len({t for t, _ in HOLDOUT}) == len(HOLDOUT) and 0.4 < sum(y for _, y in HOLDOUT) / len(HOLDOUT) < 0.6


@pytest.mark.parametrize("n,edits", [(22, 1), (22, 2), (24, 3), (40, 5)])
def test_edits_anywhere_inside_a_passage_are_found(n, edits):
    r = random.Random(n + edits)
    block = leaks.Items(ITEMS, 22, 8)
    for _ in range(100):
        i = r.randrange(len(ITEMS))
        w = ITEMS[i][1].split()
        a = r.randrange(len(w) - n + 1)
        part = [[x] for x in w[a : a + n]]
        for k in r.sample(range(1, n - 1), edits):
            part[k] = r.choice([["zzz"], [], ["zzz", *part[k]]])
        doc = ["filler"] * 7 + [x for p in part for x in p] + ["filler"] * 7
        known = block.numbers(doc)
        assert i in block.candidates(known[2])
        covered, e, at = block.longest(i, *known)
        assert covered >= n and e * 8 <= covered and 7 <= at < 10


def test_a_passage_with_too_many_edits_is_none():
    w = ITEMS[4][1].split()[5:29]
    for k in (3, 8, 13, 18):
        w[k] = "zzz"
    block = leaks.Items(ITEMS, 22, 8)
    assert block.longest(4, *block.numbers(w))[0] == 0
    assert leaks.least_intact(40, 22, 8) == 5 and leaks.least_intact(23, 22, 8) == 8
    assert leaks.size_class(22, 22, 8, 1e-6)[0] < 1 and leaks.size_class(60, 22, 8, 1e-6) == (1.0, 5)


def test_probabilities_hold_for_texts_the_curve_was_not_fitted_to(spark):
    docs, common = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "common_words"))
    assert prose.train(docs, common).brier < 0.15


def test_trees_learn_what_a_line_cannot_and_repeat_themselves():
    import numpy as np

    from codeweft.llm.boosting import Boosted

    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    a, b = Boosted(40, 3).fit(x[:1500], y[:1500]), Boosted(40, 3).fit(x[:1500], y[:1500])
    assert ((a.margins(x[1500:]) > 0) == y[1500:]).mean() > 0.97 and np.array_equal(a.margins(x), b.margins(x))
    assert Boosted(3, 2).fit(np.zeros((4, 2)), np.array([0.0, 1.0, 1.0, 1.0])).margins(np.zeros((1, 2)))[0] > 0


def test_unicode_blanks_are_blank(spark):
    docs = spark.createDataFrame([(1, "\xa0"), (2, " \n"), (3, "a;b\n1;2\n3;4\n5;6")], "doc_id long, text string")
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    assert {r["doc_id"] for r in prose.prose_scores(docs, common).collect()} == {3}


def test_pairs_come_from_all_documents(spark, corpus):
    _, common, _ = corpus
    names = [(f"heron{a}", f"gravel{a}") for a in "abcdefghij"]
    r = random.Random(8)
    rare = [f"{make_prose(r)} The {a} {b} waits for the other step, and then it stops." for a, b in names for _ in range(3)]
    rare += [f"{make_prose(r)} The osprey pebble waits for the other step, and then it stops." for _ in range(2)]
    docs = spark.createDataFrame([(n, rare[n // 200] if n % 200 == 0 and n // 200 < len(rare) else ";;") for n in range(8_400)], "doc_id long, text string")
    lex = prose.train(docs, common).lex
    assert set(names) <= lex.pairs and set(names) <= lex.firm
    assert ("osprey", "pebble") in lex.pairs - lex.firm


def test_trees_are_the_same_in_jobs_and_in_the_driver(corpus, monkeypatch):
    docs, common, _ = corpus
    monkeypatch.setattr(prose, "TREES", 3)
    here = {r["doc_id"]: r["probability"] for r in prose.prose_scores(docs.repartition(2), common).collect()}
    monkeypatch.setattr(prose, "DRIVER_ROWS", 0)
    assert here == {r["doc_id"]: r["probability"] for r in prose.prose_scores(docs.repartition(5), common).collect()} and len(here) == 400


def test_sums_over_blocks_do_not_depend_on_the_blocks():
    import numpy as np

    from codeweft.llm.boosting import Block, Boosted, bins, in_memory

    r = np.random.default_rng(2)
    x, y = r.random((900, 4)), (r.random(900) < 0.4).astype(float)
    limits = [np.linspace(0, 1, 20)] * 4
    one, many = (Boosted(9, 4).boost(limits, float(y.mean()), in_memory(Block(bins(a, limits), b) for a, b in parts)) for parts in ([(x, y)], [(x[k::7], y[k::7]) for k in range(7)]))
    assert np.array_equal(one.margins(x), many.margins(x))


def test_long_prose_comes_back_to_its_words():
    lex = prose.Lexicon(COMMON)
    r = random.Random(3)
    text = " ".join(make_prose(r) for _ in range(5))
    x = prose.statistics(text, lex)
    assert x[prose.FEATURES.index("distinct_share")] < 0.25 and prose.looks_like_prose(x)
    assert not prose.looks_like_prose(prose.statistics("The nightly job reads the rows in order. " * 100, lex))
