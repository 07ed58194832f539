"""Tokens, frequent items, term statistics and mixing against brute force."""

import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.llm import mixing, termstats, tokens, topitems

TEXTS = [None, "", "a", " ", "\n\n", "Hello world's  end\n\n\n x", "<|endoftext|>", "日本語のテキスト", "नमस्ते", "é  　 x", "\U0001f600 ok", "a" * 5000, "word " * 40_000, " " * 70_000, "x" + "\n" * 30_000 + "y", ("ab " * 30 + "\t" * 2000) * 20, " " * 3000 + "z", "中" * 50_000]


def whole(text):
    return tokens.encoding().encode_ordinary(text)


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_tokens_round_trip(i):
    ids = tokens.encode(TEXTS[i])
    assert tokens.decode(ids) == (TEXTS[i] or "")


def test_tokens_equal_the_whole():
    for t in TEXTS[2:13] + TEXTS[17:]:
        if t:
            assert tokens.encode(t) == whole(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t\r'.,é中  s"), max_size=300), st.integers(1, 20))
def test_chunks_never_change_ids(text, size):
    assert "".join(tokens.chunks(text, size)) == text
    assert [x for c in tokens.chunks(text, size) for x in whole(c)] == whole(text)


def test_tokens_equal_the_other_library():
    tk = pytest.importorskip("tokenizers")
    import os

    path = os.path.join(os.path.dirname(tokens.RANK_FILE), "byte_bpe_50k.json")
    t = tk.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for x in TEXTS[2:11]:
        assert t.encode(x, add_special_tokens=False).ids == tokens.encode(x)


def test_encode_documents(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    enc = tokens.encode_documents(df)
    assert enc.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = {r.doc_id: r.ids for r in enc.collect()}
    assert rows[0] == [] and rows[1] == [] and len(rows) == len(TEXTS)
    assert {r.doc_id: r.text for r in tokens.decode_documents(enc).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()} == {i: len(v) for i, v in rows.items()}
    assert tokens.encode_documents(df.limit(0)).count() == 0


def items_frame(spark, values, n=4):
    return spark.createDataFrame([(v, 1, 2) for v in values], "v string, n int, item int").repartition(n)


def test_summaries_hold_their_bounds(spark):
    rng = random.Random(1)
    values = [f"r{rng.randrange(3000)}" for _ in range(4000)] + ["hot"] * 2500 + ["warm"] * 300 + [""] * 200 + [None] * 500
    true = collections.Counter(v for v in values if v is not None)
    n = sum(true.values())
    for m in (3, 20, 200):
        rows = topitems.heavy_hitters(items_frame(spark, values, 7), ["v"], m).collect()
        held = {r.item: r for r in rows}
        assert len(held) == len(rows) <= m
        for r in rows:
            assert r.n == n and r.lower_count <= true[r.item] <= r.upper_count
        assert {k for k, c in true.items() if c > n / (m + 1)} <= set(held)


def test_frequent_is_exact(spark):
    values = ["a"] * 6 + ["b"] * 5 + [f"x{i}" for i in range(989)] + [None] * 100 + ["é"] * 0
    got = {tuple(r) for r in topitems.frequent(items_frame(spark, values), ["v"], 6, 300).collect()}
    assert got == {("v", "a", 6, 1000)}  # exactly at the threshold is in
    assert topitems.frequent(items_frame(spark, []), ["v"], 6).count() == 0
    assert topitems.frequent(items_frame(spark, [None, None]), ["v"], 6).count() == 0
    with pytest.raises(ValueError, match="guarantee"):
        topitems.frequent(items_frame(spark, values), ["v"], 6, 100)


def test_ties_and_two_columns(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), (None, "y"), ("", "x")], "k string, v string")
    got = {tuple(r) for r in topitems.frequent(df, ["k", "v"], 200).collect()}
    assert got == {("k", "a", 1, 3), ("k", "b", 1, 3), ("k", "", 1, 3), ("v", "x", 2, 3), ("v", "y", 1, 3)}


TAGS = "kind tinyint, id bigint, k string, v string, term string, h bigint"


@pytest.mark.parametrize("max_bytes", [1 << 26, 1500])
def test_term_counts(spark, max_bytes):
    """Small limits make the radix partitions split again, down to one term's rows by record."""
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(60), rng.choice(["hot"] * 5 + ["", "é", "b\x1fc", f"t{rng.randrange(40)}", None]), "v", "z", 1) for _ in range(1500)]
    rows += rows[:50] + [(None, 1, "hot", "v", "z", 1), (0, None, "hot", "v", "z", 1), (0, 999, None, "v", "z", 1)] + [(0, 5, "long" * 5000, "v", "z", 1)]
    got = {r.term: (r.row_count, r.record_count) for r in termstats.term_counts(spark.createDataFrame(rows, TAGS), "k", ["kind", "id"], max_bytes).collect()}
    want = {}
    for kind, i, k, *_ in rows:
        if k is not None:
            c = want.setdefault(k, [0, set()])
            c[0] += 1
            c[1].add((kind, i))
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}


def test_marks(spark):
    rows = [(0, i, "all", "v", "z", 1) for i in range(100)] + [(0, i, "edge", "v", "z", 1) for i in range(12)] + [(0, i, "over", "v", "z", 1) for i in range(13)] + [(0, i, "two", "v", "z", 1) for i in range(2)] * 3 + [(0, i, "three", "v", "z", 1) for i in range(3)]
    got = {r.term: r.mark for r in termstats.marked_terms(spark.createDataFrame(rows, TAGS), "k", ["kind", "id"]).collect()}
    assert got == {"all": "common", "over": "common", "edge": None, "two": "rare", "three": None}
    assert termstats.marked_terms(spark.createDataFrame([], TAGS), "k", ["kind", "id"]).count() == 0


def test_fit_reaches_the_best_sum():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 7)
        size, free, budget = rng.choice(np.arange(1, 30), n, replace=False), rng.integers(0, 4, n), int(rng.integers(0, 60))
        took = mixing.fit(size, free, budget)
        assert (took >= 0).all() and (took <= free).all()
        sums = {0}
        for s, k in zip(size.tolist(), free.tolist()):
            sums = {x + s * i for x in sums for i in range(k + 1)}
        assert (took * size).sum() == max(x for x in sums if x <= budget)


def test_long_documents_only():
    """A copy longer than the programme's usual reach is taken where it fits."""
    import pandas as pd

    for lengths, docs, budget, want in (([20_000], [10], 27_000, [1]), ([15_000, 40_000], [2, 3], 75_000, [2, 1]), ([20_000, 23_000], [9, 9], 66_500, [1, 2])):
        pdf = pd.DataFrame({"source": "a", "n_tokens": lengths, "docs": docs, "budget": budget, "max_repeats": 1})
        assert mixing._choose(pdf)["copies"].tolist() == want


def mix(spark, docs, targets, total=None):
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    plan = mixing.plan(counted, t, total)
    rows = mixing.select(counted, plan).collect()
    return {r.doc_id: r.repeats for r in rows}, {r.source: r for r in mixing.report(counted, plan, t).collect()}, len(rows)


def test_mixing(spark):
    rng = random.Random(3)
    docs = [(i, "big", rng.randint(1, 400)) for i in range(3000)] + [(5000 + i, "small", rng.randint(1, 50)) for i in range(60)] + [(6000 + i, "unwanted", 10) for i in range(20)] + [(7000, "big", 0)]
    docs += [(8000 + i, "even", 100) for i in range(700)]
    size = {d: n for d, _, n in docs}
    uses, report, n = mix(spark, docs, [(" Big", 0.5, 1), ("small", 0.1, 4), ("even", 0.2, 1), ("nobody", 0.1, 3), ("unwanted", 0.0, 5), (None, 1.0, 1), ("null", None, None)])
    assert len(uses) == n and max(v for d, v in uses.items() if d < 3000) == 1 and 7000 not in uses and not any(6000 <= d < 6020 for d in uses)
    small = {uses.get(d, 0) for d, s, _ in docs if s == "small"}
    assert max(small) <= 4 and max(small) - min(small) <= 1
    tokens_of = collections.Counter()
    for d, v in uses.items():
        tokens_of["big" if d < 3000 else "small" if d < 6000 else "even"] += v * size[d]
    whole = sum(tokens_of.values())
    for s, w in (("big", 0.5), ("small", 0.1), ("even", 0.2)):
        assert report[s].tokens == tokens_of[s]
        assert abs(tokens_of[s] / whole - w / 0.8) < 0.003
    assert report["nobody"].tokens == 0 and report["unwanted"].tokens == 0 and abs(report["big"].wanted_share - 0.5 / 0.9) < 1e-9
    again, _, _ = mix(spark, docs[::-1], [(" Big", 0.5, 1), ("small", 0.1, 4), ("even", 0.2, 1), ("nobody", 0.1, 3)])
    assert again == uses


def test_mixing_to_a_total(spark):
    docs = [(i, "a", 1 + i % 90) for i in range(2000)] + [(9000 + i, "b", 7) for i in range(100)]
    _, report, _ = mix(spark, docs, [("a", 0.9, 1), ("b", 0.1, 1)], 5000)
    assert report["a"].tokens == 4500 and report["b"].tokens == 497


def test_mixing_of_crowded_lengths(spark):
    """Ranks by parts are the ranks of a whole length: how many bits part it changes nothing."""
    counted = spark.createDataFrame([(i, "a", 5 if i % 3 else 7, "x") for i in range(2000)], "doc_id bigint, source string, n_tokens bigint, part string").drop("part")
    plan = mixing.plan(counted, spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int"), 4001)
    take = lambda crowd: sorted(tuple(r) for r in mixing.select(counted, plan, crowd=crowd).collect())
    assert take(100) == take(1 << 14) and sum(r[2] * r[3] for r in take(100)) == 4001


def test_mixing_nothing(spark):
    assert mix(spark, [], [("a", 1.0, 1)])[0] == {}
    assert mix(spark, [(1, "a", 5)], [])[0] == {}


def test_source_names(spark):
    df = spark.createDataFrame([(" Fanhub ",), ("",), (None,), ("  ",)], "s string").select(mixing.source_name(F.col("s")).alias("s"))
    assert [r.s for r in df.collect()] == ["fanhub", None, None, None]
