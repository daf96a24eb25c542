"""Vector geometry: normalization, direction, displacement, nearest centres, forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.operators.dense import exact_topk

MIN_PER_CLASS, SHRINKAGE = 20, 0.1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), x.cast("double")))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def class_means(df: DataFrame, label: str = "category") -> DataFrame:
    """label, place, mean: one row per class and dimension."""
    return df.select(label, F.posexplode("vector").alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))


class Direction:
    """A discriminant direction with its two class means on it."""

    def __init__(self, vector: np.ndarray, low: float, high: float):
        self.vector, self.low, self.high = vector, low, high

    def score(self, v: Column) -> Column:
        """0 at the MARKETING mean, 1 at the UTILITY mean."""
        return (dot(v, literal(self.vector)) - self.low) / ((self.high - self.low) or 1.0)


def fit_direction(df: DataFrame, label: str = "category", shrinkage: float = SHRINKAGE) -> Direction:
    """Linear discriminant: sums and products by class in one distributed pass, a d x d solve here."""
    rows = df.select(label, F.transform("vector", lambda x: x.cast("double")).alias("v"))
    means = {r[label]: np.array([m for _, m in sorted(r["m"])]) for r in class_means(df, label).groupBy(label).agg(F.collect_list(F.struct("place", "mean")).alias("m")).collect()}
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get("UTILITY", 0), counts.get("MARKETING", 0)) < MIN_PER_CLASS:
        raise ValueError(f"a direction needs {MIN_PER_CLASS} vectors of each class")
    d, total = len(means["UTILITY"]), sum(counts.values())

    def products(batches):
        import pandas as pd

        out = np.zeros((d, d))
        for pdf in batches:
            for name, group in pdf.groupby(label):
                x = np.stack(group["v"].to_numpy()) - means[name]
                out += x.T @ x
        yield pd.DataFrame({"row": np.repeat(np.arange(d), d), "col": np.tile(np.arange(d), d), "x": out.ravel()})

    cells = rows.mapInPandas(products, "row int, col int, x double").groupBy("row", "col").agg(F.sum("x").alias("x")).collect()  # d * d numbers
    scatter = np.zeros((d, d))
    for c in cells:
        scatter[c["row"], c["col"]] = c["x"]
    within = scatter / max(1, total - 2)
    within = (1 - shrinkage) * within + shrinkage * np.eye(d) * np.trace(within) / d
    w = np.linalg.solve(within, means["UTILITY"] - means["MARKETING"])
    w /= np.linalg.norm(w)
    return Direction(w, float(means["MARKETING"] @ w), float(means["UTILITY"] @ w))


def displacement(direction: Direction, before: Column, after: Column) -> list[Column]:
    """before, after and moved, rounded first so that they add up."""
    a, b = F.round(direction.score(before), 4), F.round(direction.score(after), 4)
    return [a.alias("before"), b.alias("after"), F.round(b - a, 4).alias("moved")]


def cohens_d(df: DataFrame, value: str, label: str = "category") -> DataFrame:
    """Difference of class means over the pooled deviation; 0 if that is degenerate."""
    s = lambda f, c: f(F.when(F.col(label) == c, F.col(value)))
    n1, n0 = (F.count(F.when(F.col(label) == c, F.col(value))) for c in ("UTILITY", "MARKETING"))
    pooled = F.sqrt(((n1 - 1) * s(F.var_samp, "UTILITY") + (n0 - 1) * s(F.var_samp, "MARKETING")) / (n1 + n0 - 2))
    return df.agg(F.round(F.coalesce(F.try_divide(s(F.avg, "UTILITY") - s(F.avg, "MARKETING"), pooled), F.lit(0.0)), 4).alias("cohens_d"))


#: Corpus rows that may be sent to every task.
BROADCAST_ROWS = 10_000


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """id, match, score, rank: the k most similar corpus rows, exact for a corpus of any size.

    Up to BROADCAST_ROWS (centres, exemplars) go to every task; a larger corpus is searched by lists.
    """
    if corpus.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return exact_topk(queries, corpus, k)
    small = corpus.select(F.col("id").alias("match"), l2_normalize(F.col("vector")).alias("b"))
    pairs = queries.select("id", l2_normalize(F.col("vector")).alias("a")).crossJoin(F.broadcast(small)).select("id", "match", F.round(dot(F.col("a"), F.col("b")), 6).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "match")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_centre(df: DataFrame, centres: DataFrame) -> DataFrame:
    """id, form, score: the centre of largest dot product; centres (form, centre) are few."""
    pairs = df.crossJoin(F.broadcast(centres)).select("id", "form", F.round(dot(F.col("vector"), F.col("centre")), 6).alias("score"))
    return pairs.groupBy("id").agg(F.max_by("form", F.struct("score", (-F.col("form")).alias("f"))).alias("form"), F.max("score").alias("score"))


def form_stats(assigned: DataFrame) -> DataFrame:
    """form, approved, downgraded, approval_rate, expected at the base rate."""
    by = assigned.groupBy("form").agg(F.count_if(F.col("category") == "UTILITY").alias("approved"), F.count_if(F.col("category") == "MARKETING").alias("downgraded"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per form
    n = F.col("approved") + F.col("downgraded")
    base = F.sum("approved").over(whole) / F.sum(n).over(whole)
    return by.select("form", "approved", "downgraded", F.round(F.try_divide("approved", n), 4).alias("approval_rate"), F.round(base * n, 4).alias("expected"))


def choose_form(df: DataFrame, centres: DataFrame, minimum: float = 0.60) -> DataFrame:
    """id, form, value: largest similarity times approval rate, among forms approved often enough."""
    good = centres.where(F.col("approval_rate") >= minimum)
    pairs = df.crossJoin(F.broadcast(good)).select("id", "form", F.round(dot(l2_normalize(F.col("vector")), l2_normalize(F.col("centre"))) * F.col("approval_rate"), 6).alias("value"))
    return pairs.groupBy("id").agg(F.max_by("form", F.struct("value", (-F.col("form")).alias("f"))).alias("form"), F.max("value").alias("value"))


def exemplar_centres(exemplars: DataFrame, k: int = 3) -> DataFrame:
    """form, centre: the mean of the first k vectors of each form, by id."""
    cells = _first(exemplars, k).select("form", F.posexplode("vector").alias("place", "x")).groupBy("form", "place").agg(F.avg("x").alias("m"))
    means = cells.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("c"))
    return means.select("form", F.col("c.m").alias("centre"))


def _first(exemplars: DataFrame, k: int) -> DataFrame:
    """The k rows of least id of each form; ranked per form after a rank within hashed parts, so no task holds a whole form."""
    part = exemplars.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = part.withColumn("__n", F.row_number().over(Window.partitionBy("form", "__part").orderBy("id"))).where(F.col("__n") <= k)
    return some.withColumn("__n", F.row_number().over(Window.partitionBy("form").orderBy("id"))).where(F.col("__n") <= k).drop("__n", "__part")


def classify_draft(df: DataFrame, centres: DataFrame, minimum: float = 0.60) -> DataFrame:
    """id, form, similarity: the nearest form among those approved often enough."""
    good = centres.where(F.col("approval_rate") >= minimum)
    pairs = df.crossJoin(F.broadcast(good)).select("id", "form", F.round(dot(l2_normalize(F.col("vector")), l2_normalize(F.col("centre"))), 6).alias("similarity"))
    return pairs.groupBy("id").agg(F.max_by("form", F.struct("similarity", (-F.col("form")).alias("f"))).alias("form"), F.max("similarity").alias("similarity"))


def form_evidence(similarity: Column, rate: Column) -> Column:
    return F.when(similarity >= 0.40, rate)


def rank_candidates(df: DataFrame) -> DataFrame:
    """rank in each group: eligible first, then the furthest moved, then the first."""
    w = Window.partitionBy("group").orderBy(F.desc("eligible"), F.desc("moved"), "candidate")
    return df.withColumn("rank", F.row_number().over(w))


def label_terms(weights: DataFrame, forms: DataFrame, k: int = 5) -> DataFrame:
    """form, term, lift: mean weight inside a form less mean weight outside; the k largest."""
    rows = weights.join(forms.select("id", "form"), "id")
    inside = rows.groupBy("form", "term").agg(F.sum("w").alias("inside"))
    totals = rows.groupBy("term").agg(F.sum("w").alias("total"))
    sizes = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    n_all = forms.agg(F.count(F.lit(1)).alias("n_all"))
    out = inside.join(totals, "term").join(sizes, "form").crossJoin(F.broadcast(n_all)).where("n < n_all")
    out = out.withColumn("lift", F.round(F.col("inside") / F.col("n") - (F.col("total") - F.col("inside")) / (F.col("n_all") - F.col("n")), 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy(F.desc("lift"), "term"))).where(F.col("rank") <= k).select("form", "term", "lift", "rank")
