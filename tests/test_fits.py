"""Batched fits against plain solvers, in a session that also holds an observation."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from missive.operators import fits, learn, splits
from missive.operators.fits import Problem

DIM, N = 9, 160


def table(seed=1, dim=DIM, n=N):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, dim)) < 0.5, 0, rng.standard_normal((n, dim)))
    x[0] = 0
    y = (x @ rng.standard_normal(dim) + rng.standard_normal(n) > 0.7).astype(float)
    return x, y, rng.integers(0, 3, n), rng.integers(0, 2, n)


def rows_of(spark, x, y, fold, inner):
    rows = [(float(t), [int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]], int(a), int(b)) for r, t, a, b in zip(x, y, fold, inner)]
    return spark.createDataFrame(rows, "y double, idx array<int>, val array<double>, fold int, inner int").repartition(3)


def plain_fit(x, y, p):
    """Newton's method with halved steps, on dense rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    counts = [max(1, (y == k).sum()) for k in (0, 1)]
    weight = np.array([len(y) / (2 * counts[int(t)]) for t in y]) if p.balanced else np.ones(len(y))
    ridge = np.ones(x1.shape[1])
    ridge[-1] = p.penalized_bias
    s = 2 * y - 1

    def value(w):
        m = s * (x1 @ w)
        loss = np.logaddexp(0, -m) if p.loss == "logistic" else np.maximum(0, 1 - m) ** 2
        return p.c * (weight * loss).sum() + (ridge * w * w).sum() / 2

    w = np.zeros(x1.shape[1])
    for _ in range(200):
        m = s * (x1 @ w)
        if p.loss == "logistic":
            q = 1 / (1 + np.exp(m))
            slope, bend = -s * q, q * (1 - q)
        else:
            slope, bend = -2 * s * np.maximum(0, 1 - m), 2.0 * (m < 1)
        g = p.c * x1.T @ (weight * slope) + ridge * w
        h = p.c * (x1 * (weight * bend)[:, None]).T @ x1 + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step, t = np.linalg.solve(h, g), 1.0
        while value(w - t * step) > value(w) and t > 1e-9:
            t /= 2
        w = w - t * step
        if np.abs(g).max() < 1e-9:
            break
    return w


PROBLEMS = [
    Problem(), Problem(c=0.3, balanced=False), Problem("squared_hinge", 1.0, False, penalized_bias=True), Problem("squared_hinge", 3.0, True, penalized_bias=True),
    Problem(left_out=(("fold", 1),)), Problem(c=3.0, left_out=(("fold", 2), ("inner", 0))), Problem("squared_hinge", left_out=(("fold", 0),)),
]


@pytest.mark.parametrize("direct", [fits.DIRECT_BYTES, 0])
def test_one_batch_equals_plain_fits(spark, monkeypatch, direct):
    monkeypatch.setattr(fits, "DIRECT_BYTES", direct)
    monkeypatch.setattr(fits, "BLOCK", 16)
    x, y, fold, inner = table()
    found = fits.fit(rows_of(spark, x, y, fold, inner), PROBLEMS, DIM).weights
    for k, p in enumerate(PROBLEMS):
        keep = np.ones(N, bool)
        for column, out in p.left_out:
            keep &= (fold if column == "fold" else inner) != out
        want = plain_fit(x[keep], y[keep], p)
        assert np.abs(found[:, k] - want).max() < 1e-3, p


def test_sigmoids_are_fitted_on_the_fold_left_out(spark):
    x, y, fold, inner = table(3)
    rows = rows_of(spark, x, y, fold, inner)
    problems = [Problem(left_out=(("fold", k),)) for k in range(3)] + [Problem(left_out=(("fold", 0), ("inner", 1)))]
    models = fits.fit(rows, problems, DIM)
    found = fits.fit_sigmoids(rows, models, problems)
    for k, p in enumerate(problems):
        held = fold == k if k < 3 else (fold != 0) & (inner == 1)
        m = x[held] @ models.weights[:-1, k] + models.weights[-1, k]
        n1, n0 = (y[held] == 1).sum(), (y[held] == 0).sum()
        target = np.where(y[held] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 0.0, 0.0
        for _ in range(100):
            q = 1 / (1 + np.exp(-(a * m + b)))
            g = np.array([((q - target) * m).sum(), (q - target).sum()])
            v = q * (1 - q)
            step = np.linalg.solve([[(v * m * m).sum(), (v * m).sum()], [(v * m).sum(), v.sum()]], g)
            a, b = a - step[0] / 2, b - step[1] / 2
        assert found[k] == pytest.approx([a, b], abs=1e-3)


def test_fits_of_one_class_and_of_nothing(spark):
    x, y, fold, inner = table(4)
    weights = fits.fit(rows_of(spark, x, np.ones(N), fold, inner), [Problem(), Problem("squared_hinge", penalized_bias=True)], DIM).weights
    assert np.isfinite(weights).all()
    empty = rows_of(spark, x, y, fold, inner).where("y > 5")
    assert np.abs(fits.fit(empty, [Problem()], DIM).weights).max() == 0


def test_singular_values_and_projection(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((200, 40)) < 0.7, 0, rng.random((200, 40)))
    ids = [(str(k), [int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for k, r in enumerate(x)]
    df = spark.createDataFrame(ids, "id string, idx array<int>, val array<double>").repartition(4)
    latent = learn.Latent(df, 8)
    want = np.linalg.svd(x)
    assert np.abs(latent.values / want[1][:8] - 1).max() < 0.01
    held = rng.random((5, 40))
    rows = spark.createDataFrame([(k, list(range(40)), r.tolist()) for k, r in enumerate(held)], "k int, idx array<int>, val array<double>")
    got = np.array([r["vector"] for r in latent.transform(rows).orderBy("k").collect()])
    plane = held @ want[2][:8].T
    plane /= np.linalg.norm(plane, axis=1, keepdims=True)
    assert np.abs(np.linalg.norm(got, axis=1) - 1).max() < 1e-9
    assert np.abs(np.abs(got @ got.T) - np.abs(plane @ plane.T)).max() < 0.05  # signs and rotations of near-equal values are free
    same = learn.lsa(df, 8).collect()
    assert len(same) == 200 and all(len(r["vector"]) == 8 for r in same)


def test_fit_and_score_beside_an_observation(spark):
    """A session that has observed anything must still fit and score."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    x, y, fold, inner = table(8)
    rows = rows_of(spark, x, y, fold, inner).withColumn("family", F.col("fold").cast("string")).drop("fold")
    for model in (learn.fit_logistic(rows), learn.fit_svm(rows), learn.Calibrated(rows.withColumn("family", F.monotonically_increasing_id().cast("string")), 3)):
        assert model.transform(rows).count() == N
    assert seen.get["n"] == 3


def test_sublinear_features_and_standardized_counts(spark):
    texts = [("1", "a1 red red red blue"), ("2", "red green"), ("3", "blue blue")]
    df = spark.createDataFrame([(i, "", b, "", "", "UTILITY") for i, b in texts], "id string, header string, body string, footer string, buttons string, meta_category string")
    f = learn.Featurizer(learn.text_columns(df), "structure")
    terms = {r["place"]: r["term"] for r in f.terms(spark).collect()}
    rows = {r["id"]: dict(zip(r["idx"], r["val"])) for r in f.transform(learn.text_columns(df)).collect()}
    weights = {terms[i]: v for i, v in rows["1"].items() if i in terms}
    idf = lambda n: np.log(4 / (1 + n)) + 1
    assert weights["red"] / weights["blue"] == pytest.approx((1 + np.log(3)) * idf(2) / idf(2))
    assert sum(v * v for v in weights.values()) == pytest.approx(1)
    counts = np.array([[v for i, v in sorted(r.items()) if i not in terms] for r in rows.values()])
    assert counts.shape == (3, len(learn.FEATURES)) and np.abs(counts.mean(axis=0)).max() < 1e-9


def test_validation_falls_back_to_labels(spark):
    rows = [(f"f{k}", "UTILITY" if k % 2 else "MARKETING", "UTILITY" if k else "UNKNOWN") for k in range(80)]
    df = spark.createDataFrame(rows, "family string, meta_category string, requested_category string")
    held = {r["family"] for r in splits.grouped_holdout(df, 0.25, "s0").where("holdout").collect()}
    if "f0" in held:
        pytest.skip("the rare row is held out")
    parts = {r["family"]: r["part"] for r in splits.fixed_split(df).collect()}
    for label in ("UTILITY", "MARKETING"):
        rest = [f for f, m, _ in rows if m == label and f not in held]
        assert sum(parts[f] == "validation" for f in rest) == len(rest) // 4
