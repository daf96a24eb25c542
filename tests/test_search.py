"""Nearest neighbours, best matches and leak audits against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.operators import dense, similarity, vectors
from missive.sources import sinks


def plain_topk(queries, corpus, k):
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1.0)
    rows = []
    for i, v in queries:
        scored = sorted(((-round(float(unit(v) @ unit(w)), 6) + 0.0, j) for j, w in corpus))[:k]
        rows += [(i, j, round(-s, 4) + 0.0, r + 1) for r, (s, j) in enumerate(scored)]
    return sorted(rows)


@pytest.mark.parametrize("cell,first", [(16, 1), (64, 3), (4096, 3)])
def test_searched_lists_give_the_exact_neighbours(spark, monkeypatch, cell, first):
    monkeypatch.setattr(dense, "CELL", cell)
    monkeypatch.setattr(dense, "FIRST", first)
    rng = np.random.default_rng(3)
    spots = rng.standard_normal((6, 8))
    corpus = [(k, (spots[k % 6] + 0.2 * rng.standard_normal(8)).tolist()) for k in range(300)] + [(300, [0.0] * 8), (301, [1.0] + [0.0] * 7), (302, [2.0] + [0.0] * 7)]
    queries = [(1000 + k, (spots[k % 6] + 0.3 * rng.standard_normal(8)).tolist()) for k in range(40)] + [(2000, [0.0] * 8), (2001, [3.0] + [0.0] * 7)]
    schema = "id int, vector array<double>"
    q, c = spark.createDataFrame([*queries, (3000, None)], schema), spark.createDataFrame([*corpus, (400, None)], schema)
    for k in (1, 7, 400):
        got = sorted((r["id"], r["match"], round(r["score"], 4) + 0.0, r["rank"]) for r in dense.exact_topk(q, c, k).collect())
        assert got == plain_topk(queries, corpus, k)
    assert dense.exact_topk(q, c.where("id < 0"), 3).count() == 0 and dense.exact_topk(q.where("id < 0"), c, 3).count() == 0


def test_lists_are_left_out_by_bounds():
    """Far apart spots: a query's second round visits no list at all."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    lists = dense.Lists(centres, np.full(9, 5), np.append(np.full(8, 0.1), 0.0))
    x = centres + 0.01 * rng.standard_normal((8, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert lists.visits(x, None).sum() == 8 * dense.FIRST
    assert lists.visits(x, np.full(8, 0.9)).sum() == 0 and lists.visits(x, np.full(8, -1.0)).sum() == 8 * (9 - dense.FIRST)


def test_large_corpora_are_searched_by_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 20)
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(4).tolist()) for k in range(50)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    got = sorted((r["id"], r["match"], round(r["score"], 4) + 0.0, r["rank"]) for r in vectors.dense_topk(df, df, 3).collect())
    assert got == plain_topk(rows, rows, 3)


def test_blocks_that_cannot_win_are_not_joined(spark):
    rng = np.random.default_rng(2)
    common = "your order has been sent and will come soon thank you for it".split()
    rare = [f"item{k}" for k in range(300)]
    bodies = [" ".join([*rng.choice(common, 8), *rng.choice(rare, 4)]) for _ in range(400)]
    df = spark.createDataFrame([(str(k), b) for k, b in enumerate(bodies)], "id string, body string")
    index = similarity.Index(df.where("cast(id as int) % 2 = 0"), F.col("body"), similarity.word_terms)
    left = index.transform(df.where("cast(id as int) % 2 = 1"), F.col("body"))
    want = similarity.top_k(similarity.cosine_pairs(left, index.vectors), 2).select("left_id", "right_id", "score", "rank")
    got = similarity.best_pairs(left, index.vectors, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    lists = similarity.blocked(similarity.postings(index.vectors))
    floors = got.where("rank = 2").select(F.col("left_id").alias("id"), F.col("score").alias("floor"))
    met = similarity.candidates(similarity.postings(left).join(floors, "id"), lists)
    assert met.count() < 0.25 * similarity.cosine_pairs(left, index.vectors).count()
    assert got.join(met, ["left_id", "right_id"], "left_anti").count() == 0


@pytest.mark.parametrize("least", [1, 5, 10])
def test_leaks_equal_plain_search(spark, least):
    rng = np.random.default_rng(least)
    word = lambda n: "".join(rng.choice(list("abé ☃"), n))
    sources = [word(int(n)) for n in rng.integers(1, 14, 60)] + ["", None, "same text here", "same text here", "☃" * 12]
    out = [word(int(n)) for n in rng.integers(1, 200, 60)] + [f"x{s}y" for s in sources[:5] if s] + ["xx same text here yy", "☃" * 40, None, "", "short"]
    df, corpus = spark.createDataFrame([(o,) for o in out], "s string"), spark.createDataFrame([(t,) for t in sources], "body string")
    want = {o for o in out if o and any(t and len(t) >= least and t in o for t in sources)}
    assert {r["s"] for r in sinks.leaks(df, "s", corpus, "body", least).collect()} == want and want
    assert sinks.leak_count(df, "s", corpus.where("body = 'none'"), "body", least).first()[0] == 0
