import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import mixing, reading, tokenize
from kinweave.llm.bpe import TOKENIZER_DIR, BatchEncoder, PrefixEncoding, batch_encoder
from kinweave.llm.lookalike import LookAlikes, Rewriter, plain_rewriter, same_looking_pairs
from kinweave.llm.prose import prose

tokenizers = pytest.importorskip("tokenizers")
TRICKY = " \n\t'sStdmrevlLé中1２ा́_-<>=😀　\x1c ª½ x\U000105c0​A"


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(theirs, texts):
    counts, ids = batch_encoder().encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == theirs.encode(t or "", add_special_tokens=False).ids, repr(t)
        at += n
    assert at == len(ids) and batch_encoder().encode(texts, counts_only=True)[0].tolist() == counts.tolist()


def test_every_token_and_odd_texts(theirs):
    v = batch_encoder().v
    texts = [b.decode() for b in v.ranks if b.isascii()]
    check(theirs, [*texts, "", None, " ", "\n\n ", "<|endoftext|>", "x" * 5000, "=" * 3000, "don't I'LL we've'd", "a" * 60 + "b" * 60])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(TRICKY), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_encoder_against_the_library(theirs, texts):
    check(theirs, texts)


def test_long_texts_are_cut_without_a_trace(theirs, monkeypatch):
    monkeypatch.setattr(BatchEncoder, "CHUNK", 64)
    rng = random.Random(3)
    check(theirs, ["".join(rng.choice("ab1 2'ss\n_-é") for _ in range(n)) for n in (10, 200, 900, 64, 129)])


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=24), st.binary(max_size=6), st.integers(0, 24), st.integers(0, 24))
def test_appends_and_edits(data, new, i, j):
    v = batch_encoder().v
    i, j = sorted((min(i, len(data)), min(j, len(data))))
    assert PrefixEncoding(v, data).ids() == v.merged(data)
    assert PrefixEncoding(v, data).append(new).ids() == v.merged(data + new)
    assert PrefixEncoding(v, data).replace(i, j, new).ids() == v.merged(data[:i] + new + data[j:])


def test_ids_of_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", None), (1, "hello world", "x")], "doc_id bigint, text string, ids string")
    got = tokenize.encode_corpus(df).collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert tokenize.encode_corpus(df.where("false")).count() == 0


def test_look_alike_classes():
    f = plain_rewriter()
    assert f("Ｐｌａｙеr  ​ﬁne\xa0é") == f("Player fine é") == "Player fine é"
    assert f("е́") == f("é") and f("ﬃ") == "ffi" and f("I l 1 O 0") == "I l 1 O 0" and f("A") != f("a") and f(None) == ""
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aаｅеééﬁfi ​-‑ΝNsſt") for _ in range(8))
        assert f(f(t)) == f(t)
    for x, y in (("a\u0323\u0301", "a\u0301\u0323"), ("ạ\u0301", "а\u0301\u0323"), ("ᎪᏢꓑ", "APP"), ("Ⲟⲟα", "Ooa"), ("ӏ", "l"), ("𝐀𝑏𝟑", "Ab3"), ("a−b", "a-b"), ("ℌ", "H"), ("ё", "ë")):
        assert f(x) == f(y), (x, y)
    often = Rewriter(LookAlikes({"ﬁ": 9, "fi": 1, "ﬃ": 1, "і": 5}).rewrites)
    assert often("fin") == often("ﬁn") == "fіn" and often("oﬃce") == often("office") == often("oﬀice") == often("ofﬁce")
    counts = {"а": 9, "a": 1}
    assert Rewriter(LookAlikes(counts).rewrites)("a") == "а"  # the more frequent one stands for the class


def test_same_looking_pairs(spark):
    rows = [("S1-1", "Acme", "1 Elm", "q"), ("S1-2", "Aсme", "1 Elm", "q"), ("S1-3", "Acme", None, "q"), ("S1-3", "Acme", None, "q"), ("S1-4", "ACME", " ", "q"), ("S1-5", None, "N／A", "q"), ("S1-6", "", "N/A", "q"), (None, "Acmе", "x", "q")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, raw string")
    assert {tuple(r) for r in same_looking_pairs(df).collect()} == {("S1-1", "S1-2", "business_name"), ("S1-2", "S1-3", "business_name")}
    assert same_looking_pairs(df.where("false")).count() == 0


def brute_sums(counts, budget):
    sums = {0}
    for size, n in counts:
        sums = {s + size * k for s in sums for k in range(n + 1) if s + size * k <= budget}
    return max(sums)


def test_knapsack_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = [(s, rng.randint(0, 4)) for s in rng.sample(range(0, 15), 4)]
        budget = rng.randint(0, 60)
        got = mixing.bounded_knapsack(counts, budget)
        limit = dict(counts)
        assert all(0 <= n <= limit[s] for s, n in got.items()) and sum(s * n for s, n in got.items()) == brute_sums([c for c in counts if c[0]], budget)
        repeats = rng.randint(1, 3)
        room = [(s, n * repeats) for s, n in counts if s]
        taken = mixing.plan_source(dict(counts), budget, repeats, window=8)
        used = sum(s * n for s, n in taken.items())
        assert all(n <= dict(room)[s] for s, n in taken.items()) and used == brute_sums(room, budget)


def test_budgets_are_met_by_documents_longer_than_any_window():
    assert sum(k * n for k, n in mixing.plan_source({100_000: 10, 60_000: 10}, 300_000, 3).items()) == 300_000
    rng = random.Random(5)
    for _ in range(40):
        counts = {rng.choice((1, 7, 100, 1000)) * rng.randint(1, 120): rng.randint(1, 6) for _ in range(rng.randint(2, 5))}
        repeats = rng.randint(1, 2)
        room = [(s, n * repeats) for s, n in counts.items()]
        budget = rng.randint(1, sum(s * n for s, n in room) + 10)
        for window in (16, mixing.WINDOW):
            assert sum(s * n for s, n in mixing.plan_source(counts, budget, repeats, window).items()) == brute_sums(room, budget), (counts, budget, repeats)
    many = {100: 10**9, 37: 3}
    for budget in (10**10 + 1, 10**10 + 36, 10**10 + 37, 10**10 + 76):
        used = sum(s * n for s, n in mixing.plan_source(many, budget, 1).items())
        assert used == max(x for x in (a * 37 + (budget - a * 37) // 100 * 100 for a in range(4)) if x <= budget)


def test_lengths_are_taken_in_proportion():
    counts = {k: 1 for k in range(1000, 5000)}  # no length has a second document
    for share in (0.2, 0.5, 0.8):
        taken = mixing.plan_source(counts, int(sum(counts) * share), 1)
        assert len(taken) == pytest.approx(4000 * share, rel=0.02) and sum(k for k in taken if k >= 4000) == pytest.approx(share * sum(range(4000, 5000)), abs=mixing.WINDOW + 5000)  # the last window is filled as it fits


def test_mixture(spark):
    docs = [(i, "word " * (1 + i % 7), "A" if i % 3 else " a ") for i in range(300)] + [(1000 + i, "tok " * 5, "b") for i in range(10)] + [(2000, None, "b"), (2001, "", "a"), (2002, "x", None), (2003, "x", "zzz"), (1, "word " * 2, "A")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 5)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(df, targets)
    rows = mix.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["repeats"] <= (1 if r["source"] == "a" else 3) for r in rows)
    got = {r["source"]: r for r in report.collect()}
    assert got["none"]["tokens"] == 0 and got["a"]["share"] == pytest.approx(0.625, abs=0.01) and got["b"]["share"] == pytest.approx(0.375, abs=0.01)
    mix, report = mixing.mixture(df, targets, total=10_000)
    assert {r["source"]: r["most_repeats"] for r in report.collect()} == {"a": 1, "b": 3, "none": 0}
    assert mixing.mixture(df.where("false"), targets)[0].count() == 0


def test_prose():
    text = "# Copyright (c) 2020 the x contributors. All rights reserved.\n# This file is made available under the Y Licence; no person may convey it.\n" + "# The map of the town shows every road, and the river runs to the sea. It is old.\n" * 9 + "import os\ndef f(x):\n    return x\n"
    p = prose(text)
    assert p.n_sentences == 18 and "copyright" not in p.words and "import" not in p.words and p.words["map"] == 9 and p.n_commas == 9 and p.n_letters == sum(len(w) * k for w, k in p.words.items())
    assert prose(None) is None and prose("  ") is None and prose("x = 1\n" * 500) is None and prose("El mapa de la ciudad muestra cada calle. " * 40) is None
    assert prose("The map shows the old road. " * 100).n_words == 600 and prose("the road " * 3) is None
    assert prose("x" * 50_000 + "\n" + "The map shows the old road. " * 100).n_words == 600


def test_levels(spark):
    easy, hard = "The dog runs to the box and then the cat sees the ball. ", "The ergodicity of the functor attenuates every tenet, notwithstanding that the torus belies its crux, inasmuch as the stasis begets one qualia. "
    docs = [(1, easy * 10, "x"), (2, hard * 6, "x"), (3, easy * 2, "x"), (4, None, "x"), (5, "", "x"), (1, easy * 10, "x"), (6, hard * 3000, "x")]
    samples = [(i, easy * 9, " Basic") for i in range(3)] + [(9 + i, hard * 5, "expert") for i in range(3)] + [(50, None, "plain"), (51, easy, None)]
    got = reading.levels(spark.createDataFrame(docs, "doc_id bigint, text string, band string"), spark.createDataFrame(samples, "sample_id bigint, text string, band string"))
    assert sorted((r["doc_id"], r["band"]) for r in got.collect()) == [(1, "basic"), (2, "expert"), (6, "expert")]
    assert reading.levels(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(samples, "sample_id bigint, text string, band string")).count() == 0


def test_word_ranks_follow_frequency(spark):
    counted = spark.createDataFrame([(1, ["a", "b"], [5, 2]), (2, ["a", "c", "d"], [1, 2, 1])], "id int, words array<string>, counts array<int>")
    assert {r["word"]: r["rank"] for r in reading.word_ranks(counted).collect()} == {"a": 1, "b": 3, "c": 3, "d": 4}


def test_mixture_holds_only_its_documents(spark):
    df = spark.createDataFrame([(i, "one two three", s) for i, s in enumerate(["a"] * 40 + ["b"] * 4)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mixture(df, targets)[0].collect()
    assert sorted(r["source"] for r in rows) == ["a"] * 4 + ["b"] * 4 and all(r["repeats"] == 1 for r in rows)


def test_prose_may_begin_a_line_like_a_statement():
    from kinweave.llm.prose import paragraphs

    wrapped = ["The old member keeps the", "package alongside the implementation, and a recent dog updates any box.", "public day connects any member while the writer removes one step."]
    assert paragraphs("\n".join(wrapped)) == [" ".join(wrapped)]
    for line in ("import numpy as np", "from os import path as p", "return a if b else c", "package org.acme.tools", "public static void main", "return the[0]", "let x be the.value", "using the thing;", "return not found"):
        assert paragraphs(line) == [], line


def test_words_of_one_hash_are_told_apart():
    from kinweave.llm.bpe import BatchEncoder, batch_encoder

    texts = ["the cat sat on the mat", "dog dot dog", "", None, "cat " * 50, "x" * 200 + " the"]
    want = batch_encoder().encode(texts)
    clash = BatchEncoder(batch_encoder().v)
    clash._base = 0
    clash._powers = lambda n: setattr(clash, "_up", np.zeros(n, np.uint64)) or setattr(clash, "_down", np.zeros(n, np.uint64))  # every word has hash 0
    for _ in range(2):
        got = clash.encode(texts)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
