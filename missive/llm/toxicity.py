"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017), in numpy.

Only confirmed toxic rows teach the positive class; everything else is unlabelled text, a
share ``prior`` of which is toxic too. With logistic loss the risk of a classifier is

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

where the second part estimates the risk on the negatives and may not turn negative. Several
linear classifiers are trained on different samples, one to a task, and averaged.

A quarter of each sample takes no part in the training; there the cut is placed where the
unbiased estimate of the share of errors, 2 * prior * missed(p) + flagged(u) - prior, is least.
Labels of 0 serve for nothing but the prior: labels are given to documents without regard to
what is in them, so the toxic share of the labelled rows estimates that of all.

A text's features are its distinct words: each word whole, and its first 4, 5 and 6 letters, hashed.
A word's weight is the sum over its features, so scoring looks each distinct word up once.
Sample sizes are the documented bounds POSITIVES and UNLABELLED (rows) and SAMPLE_BYTES (text, as
expected); every text is scored whole.

Held out are the doc_ids whose CRC-32 mod 5 is 0 (as text; a null id counts as empty); their labels
are never read. Defined results: null and empty texts get the score of the bias alone; repeated rows get equal
scores and are learnt from once; a label counts if any of its rows says toxic; with no toxic label
to learn from every score is prior-like 0; an empty table gives no rows; other columns are kept, but
for one of the score's name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import prepare, table, written

DIM_BITS, PREFIXES = 18, (4, 5, 6)
#: Bounds of one classifier's training sample.
POSITIVES, UNLABELLED, MODELS = 4000, 8000, 3
SAMPLE_BYTES = 64 << 20
#: One in so many rows of a sample is left to place the cut.
CUT_ROWS = 4
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 256, 0.02, 1e-5, 11
#: Features kept: those of the largest |z|, at least LEAST_Z, between positives and unlabelled text.
KEPT_FEATURES, LEAST_Z = 1000, 5.0
_WORD = re.compile(r"[^\W\d_]+")
WORD_CACHE = 200_000


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[int]:
    forms = [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) >= k]
    return [zlib.crc32(f.encode()) >> (32 - DIM_BITS) for f in forms]


def _scale(n: int) -> float:
    """A text's weights are damped by its number of distinct words, less than in proportion."""
    return 1.0 / np.sqrt(max(n, 1) / 100.0 + 1.0)


def train(features: list[np.ndarray], scales: np.ndarray, positive: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Weights of a linear classifier, the bias last."""
    rng, dim = np.random.default_rng(seed), 1 << DIM_BITS
    w, m, v = (np.zeros(dim + 1) for _ in range(3))
    w[-1] = -1.0
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(pos) or not len(unl):
        return w
    # features whose document frequency tells positives from unlabelled text
    freq = [np.zeros(dim, np.int64), np.zeros(dim, np.int64)]
    for count, side in zip(freq, (pos, unl)):
        for r in side:
            count[np.unique(features[r])] += 1
    pooled = (freq[0] + freq[1] + 1.0) / (len(pos) + len(unl) + 2.0)
    z = (freq[0] / len(pos) - freq[1] / len(unl)) / np.sqrt(pooled * (1 - pooled) * (1 / len(pos) + 1 / len(unl)))
    telling = np.zeros(dim, bool)
    telling[np.argsort(-np.abs(z), kind="stable")[:KEPT_FEATURES]] = True
    telling &= np.abs(z) >= LEAST_Z
    features = [f[telling[f]] for f in features]  # the others keep weight 0
    step = 0
    batches = max(1, -(-len(unl) // BATCH))
    for _ in range(EPOCHS):
        rng.shuffle(pos), rng.shuffle(unl)
        for k in range(batches):
            p, u = pos[k * len(pos) // batches : (k + 1) * len(pos) // batches], unl[k * BATCH : (k + 1) * BATCH]
            if not len(p):
                p = rng.choice(pos, 8)
            rows = np.concatenate([p, u])
            idx = [features[r] for r in rows]
            sizes = np.array([len(x) for x in idx])
            flat = np.concatenate(idx) if sizes.sum() else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(rows)), sizes)
            z = np.bincount(owner, weights=w[flat], minlength=len(rows)) * scales[rows] + w[-1]
            z = np.clip(z, -30, 30)
            sig, soft = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)  # loss(z, -1) = soft, loss(z, +1) = soft - z
            is_p = np.arange(len(rows)) < len(p)
            negative = soft[~is_p].mean() - prior * soft[is_p].mean()
            if negative >= 0:
                g = np.where(is_p, (prior * (sig - 1) - prior * sig) / len(p), sig / len(u))
            else:  # the non-negative correction: step back on the negative part alone
                g = np.where(is_p, prior * sig / len(p), -sig / len(u))
            grad = np.append(np.bincount(flat, weights=(g * scales[rows])[owner], minlength=dim), g.sum())
            grad[:-1] += DECAY * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def threshold(z: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The cut of the least unbiased positive-unlabelled error; of equally good cuts the highest.

    A cut lies midway between two scores, so equal scores stay on one side.
    """
    if not positive.any() or positive.all():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, positive = z[order], positive[order]
    missed = np.concatenate([[0], np.cumsum(positive)]) / positive.sum()
    flagged = 1 - np.concatenate([[0], np.cumsum(~positive)]) / (~positive).sum()
    cost = 2 * prior * missed + flagged
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    apart = np.concatenate([[True], z[1:] > z[:-1], [True]])
    cuts, cost = cuts[apart], cost[apart]
    return float(cuts[cost <= cost.min() + 1e-12][-1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text, the last column, by its features and scale."""
    for batch in batches:
        found = [words(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        features = [np.array([f for w in sorted(ws) for f in word_features(w)], dtype="<i4").tobytes() for ws in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(features, pa.binary()), pa.array([float(_scale(len(ws))) for ws in found])], names=[*batch.schema.names[:-1], "features", "scale"])


def _fit(prior: float):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["positive", "doc_id", "scale"], kind="stable")
        features = [np.frombuffer(f, "<i4") for f in group.pop("features")]
        scales, positive = group["scale"].to_numpy(), group["positive"].to_numpy(bool)
        number = SEED + int(group["model"].iloc[0])
        apart = np.random.default_rng(number).permutation(len(group)) % CUT_ROWS == 0
        w = train([f for f, x in zip(features, apart) if not x], scales[~apart], positive[~apart], prior, number)
        z = np.array([w[f].sum() * s + w[-1] for f, s in zip(features, scales)])
        w[-1] -= threshold(z[apart], positive[apart], prior)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at.astype("<i4").tobytes()], "w": [w[at].astype("<f8").tobytes()]})

    return fit


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The averaged weights. Samples are drawn by hashes of ids; no more than the bounds reach the training tasks."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null")
    known = written(known, "toxic-labels")
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("toxic")).first()
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if not stats["toxic"] or not size["n"]:
        w = np.zeros((1 << DIM_BITS) + 1)
        w[-1] = -10.0
        return w
    prior = min(0.9, stats["toxic"] / stats["n"])
    share = lambda most, n: min(most, SAMPLE_BYTES * size["n"] / max(1, size["bytes"])) / n
    spot = lambda model, salt, key: F.pmod(F.xxhash64(F.lit(SEED), F.lit(model), F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)
    chosen = lambda salt, part, key: F.filter(F.array(*[F.when(spot(m, salt, key) < part, F.lit(m)) for m in range(MODELS)]), lambda m: m.isNotNull())
    texts = docs.where(~held_out()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("own"))
    # at most MODELS * POSITIVES ids or so; an id may stand for many rows, of which as many are drawn
    ids = known.where("toxic = 1").select("doc_id", chosen("p", POSITIVES / stats["toxic"], F.col("doc_id")).alias("models")).where(F.size("models") > 0)
    ids = written(ids, "toxic-ids")
    n_rows = max(1, texts.select("doc_id").join(F.broadcast(ids), "doc_id").agg(F.sum(F.size("models"))).first()[0] or 0)
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "own"), F.lit(1 << 30)) / float(1 << 30) < MODELS * share(POSITIVES, n_rows)
    marked = texts.where(drawn).join(F.broadcast(ids), "doc_id").select("doc_id", F.lit(True).alias("positive"), "models", "text")
    free = texts.select("doc_id", F.lit(False).alias("positive"), chosen("u", share(UNLABELLED, size["n"]), F.col("own")).alias("models"), "text").where(F.size("models") > 0)
    sample = marked.unionByName(free).mapInArrow(_extract, "doc_id bigint, positive boolean, models array<int>, features binary, scale double")
    sample = written(sample.dropDuplicates(["doc_id", "positive", "features"]), "toxicity-sample").withColumn("model", F.explode("models")).drop("models")
    out = np.zeros((1 << DIM_BITS) + 1)
    fitted = sample.groupBy("model").applyInPandas(_fit(prior), "at binary, w binary").collect()  # MODELS rows of at most KEPT_FEATURES weights
    for row in fitted:
        out[np.frombuffer(row["at"], "<i4")] += np.frombuffer(row["w"], "<f8") / len(fitted)
    return out


def _score(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        w = np.zeros(1 << DIM_BITS)
        w[at] = values
        known: dict[str, float] = {}
        for batch in batches:
            z = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ws = words(text)
                total = 0.0
                for x in sorted(x for x in ws if x not in known or known[x]):
                    weight = known.get(x)
                    if weight is None:
                        if len(known) > WORD_CACHE:
                            known.clear()
                        weight = known[x] = float(w[word_features(x)].sum())
                    total += weight
                z.append(total * _scale(len(ws)) + bias)
            score = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return run


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with the score, from 0 to 1, in a column of this name."""
    w = learn(docs, labels)
    at = np.flatnonzero(w[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((at, w[at], float(w[-1])))
    frame = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (name, "text")], "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + f", `{name}` double"
    return frame.mapInArrow(_score(shared, name), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
