"""Resampling, periodic runs and quality rules against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsight.llm import _lexicon, periodic_runs, quality_rules, resampling
from shopsight.llm.queries import QUERIES, turned
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_llm import CLASH, EDGE

LOOP = " ".join(f"loop{k % 7}" for k in range(60))
ROWS = [*EDGE, (None, None), (None, "Ab" * 30 + " ab-AB_ab9 ÄÖ ä " * 9), (11, LOOP), (11, LOOP), (12, "x " * 5), (13, "x " * 6), (14, "a b " * 3 + "a"), (15, "a b " * 4),
        (16, "* *\n*   *\n* *\n\n \n"), (17, "same line here\n" * 40), (2**62, f"{LOOP} {LOOP} tail")]


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").select("*", *(F.lit(None).cast("int").alias(c) for c in [*CLASH, "runs", "counts", "n_words", "before", "copies"]))


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_number_words_is_exact_and_cuts_no_word():
    texts = [b"", b" \t\n", b"one two one", b"x" * 100 + b" y", "é é é".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    numbers, first, words = _lexicon.number_words(data, offsets)
    assert [[words[n] for n in numbers[a:b]] for a, b in zip(first, first[1:])] == [t.split() for t in texts]
    long = b"word " * 50 + b"z" * 70 + b" end"
    cut = list(_lexicon.pieces(np.frombuffer(long, np.uint8), 32))
    assert b"".join(cut) == long and [w for c in cut for w in c.split()] == long.split()


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_equal_every_period_tried(exponent):
    rng = random.Random(exponent)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
            t = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, n - a)
                t = [t[a + (i - a) % p] if i >= a else t[i] for i in range(n)]
            texts.append(t)
        first = np.cumsum([0, *map(len, texts)])
        got = periodic_runs.find_runs(np.array(sum(texts, []), np.int64), first, min_length=6, exponent=exponent)
        want = [(s + int(first[k]), n, q) for k, t in enumerate(texts) for s, n, q in brute.periodic(t, 6, exponent)]
        assert list(zip(*(x.tolist() for x in got))) == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_of_a_long_text():
    """About 6 MB of words, longer than a slice: one long loop inside noise."""
    rng = np.random.default_rng(3)
    noise = [f"n{x}" for x in rng.integers(0, 10**6, 400_000)]
    words = [*noise, *(f"p{k % 1000}" for k in range(300_000)), *noise[:100_000]]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    numbers, first, _ = _lexicon.number_words(data, np.array([0, len(data)]))
    start, length, period = periodic_runs.find_runs(numbers, first)
    assert (400_000, 300_000, 1000) in set(zip(start.tolist(), length.tolist(), period.tolist()))


def test_periodic_runs_query(spark, rows):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = found(QUERIES["op12_periodic_runs"](spark, SF_SMALL), *columns)
    assert got == sorted(((i, *brute.periodic_digest(brute.turned(i, t))) for i, t in rows), key=repr)
    assert any(g[1] for g in got)


def test_periodic_runs_of_edge_cases(edge):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = found(periodic_runs.run_digests(periodic_runs.periodic_runs(edge)), *columns)
    assert got == sorted(((i, *brute.periodic_digest((t or "").encode().split())) for i, t in ROWS), key=repr)
    searched = edge.select("doc_id", turned(edge["doc_id"], edge["text"]).alias("text"))
    assert sorted((t or "").encode().split() for _, t in found(searched, "doc_id", "text")) == sorted(brute.turned(i, t) for i, t in ROWS)
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(edge.where("false"))).count() == 0


def test_resampling_query(spark, rows):
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("text").collect()]
    got = found(QUERIES["op11_resampling"](spark, SF_SMALL), "doc_id", "n_features", "weight", "score", "rank")
    assert got == sorted(brute.resampled(rows, items), key=repr)
    assert sum(g[4] is not None for g in got) > 5


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 3), (2, 2)])
def test_resampling_of_edge_cases(spark, edge, ngrams):
    target = spark.createDataFrame([("loop1 loop2, w1x1",), (None,), ("",)], "text string")
    got = found(resampling.resample(edge, target, ngrams=ngrams, percent=50), "doc_id", "n_features", "weight", "score", "rank")
    assert got == sorted(brute.resampled(ROWS, [r[0] for r in target.collect()], ngrams, percent=50), key=repr)
    assert resampling.resample(edge.where("false"), target).count() == 0
    assert resampling.resample(edge, target.where("false")).count() == len(ROWS)


def test_equal_rows_get_ranks_of_their_own(spark):
    rows = [(None, "one two three " * 9)] * 500 + [(k, f"own{k} " * 30) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    target = spark.createDataFrame([("one",)], "text string")
    got = found(resampling.resample(df, target, ngrams=(1, 1), percent=90), "doc_id", "n_features", "weight", "score", "rank")
    assert got == sorted(brute.resampled(rows, ["one"], percent=90), key=repr)
    assert sorted(g[4] for g in got if g[4]) == list(range(1, 541))


def test_grams_of_long_texts_are_cut_and_met_twice_by_no_piece(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 64)
    text = " ".join(f"w{k % 13}{'y' * (k % 40)}" for k in range(500)) + " " + "v" * 300
    for n in (1, 2, 3):
        words, key, number = resampling.gram_buckets(text.encode(), [(n, resampling.gram_pattern(n))], 10_000)
        assert (words, int(number.sum())) == (501, 501 - n + 1)


def test_quality_counts(spark, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r["doc_id"]: r for r in QUERIES["op13_quality_rules"](spark, SF_SMALL).collect()}
    assert {i: tuple(r[c] for c in names) for i, r in got.items()} == {i: brute.quality_counts(t) for i, t in rows}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())


def test_quality_of_edge_cases(spark, edge):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    labels = spark.createDataFrame([(1, 0), (5, 1), (7, 1), (17, 0), (17, 1), (8, None), (None, 1)], "doc_id bigint, quality int")
    got = quality_rules.quality(edge, labels)
    assert found(got, "doc_id", *names) == sorted(((i, *brute.quality_counts(t)) for i, t in ROWS), key=repr)
    alone = quality_rules.quality(edge, labels.where("false"))
    assert {(r["score"], r["kept"] != r["base_failed"]) for r in alone.collect()} == {(1.0, True)}
    assert quality_rules.quality(edge.where("false"), labels).count() == 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op13_quality_rules"](spark, folder).join(labels, "doc_id").select("doc_id", "kept", "base_failed", "quality").collect()
    held = [r for r in got if brute.remainder(r["doc_id"], 5) == 0 and not r["base_failed"]]
    assert sum(r["kept"] == (r["quality"] == 1) for r in held) >= 0.95 * len(held)


def _fitted(trend):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(3000, 2))
    # the first feature helps in the middle only, so that an unconstrained forest is not monotonic
    good = rng.uniform(size=3000) < 0.1 + 0.8 * ((x[:, 0] > 0.3) & (x[:, 0] < 0.6)) * (x[:, 1] > 0.2)
    return quality_rules.fit_forest(x, good, trend), x, good


@pytest.mark.parametrize("sign", [-1, 1])
def test_forest_keeps_its_constraints_everywhere(sign):
    forest, x, _ = _fitted((sign, 0))
    grid = np.linspace(-0.5, 1.5, 400)
    for other in np.linspace(0, 1, 25):
        margins = forest.margins(np.stack([grid, np.full(400, other)], axis=1))
        assert (np.diff(margins) * sign >= -1e-12).all()
    free, _, _ = _fitted((0, 0))
    margins = free.margins(np.stack([grid, np.full(400, 0.5)], axis=1))
    assert (np.diff(margins) > 0.01).any() and (np.diff(margins) < -0.01).any()


def test_forest_walks_like_single_trees_and_learns():
    forest, x, good = _fitted((0, 0))
    def walk(row):
        total = forest.base
        for node in forest.roots.tolist():
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total
    assert forest.margins(x[:200]) == pytest.approx([walk(r) for r in x[:200]])
    s = forest.scores(x)
    assert np.mean((s >= 0.5) == good) > 0.85
    constant = quality_rules.fit_forest(x, np.ones(len(x), bool), (0, 0))
    assert (constant.scores(x) >= 0.999).all()
