"""Category classifiers on text: features, balanced and calibrated fits, evaluation jobs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import IDF, CountVectorizer, NGram
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.text import normalized_content, record_content, structural_features
from missive.operators import metrics as M
from missive.operators.fits import Models, Problem, fit, fit_sigmoids, n_features, singular
from missive.operators.similarity import WORDS_CAP, Index, best_pairs, word_terms
from missive.operators.splits import folds, grouped_holdout_with_both
from missive.operators.vectors import MIN_PER_CLASS, cohens_d, fit_direction, l2_normalize
from missive.sources.scratch import written

FEATURES = [
    "placeholder_count", "distinct_placeholders", "button_count", "has_header", "has_footer", "body_length",
    "emoji_count", "exclamation_count", "symbol_count", "uppercase_ratio", "number_count", "url_count",
]


def text_columns(df: DataFrame, normalize: bool = True) -> DataFrame:
    """y (1 for UTILITY), words, chars: tokens for the vectorizers, of normalized or of plain lower-case text."""
    text = normalized_content(record_content()) if normalize else F.lower(record_content())
    words = F.filter(F.split(text, " ") if normalize else F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    padded = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(F.sequence(F.lit(3), F.least(F.lit(5), F.length(w))), lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, n))))))
    return df.withColumns({"y": (F.col("meta_category") == "UTILITY").cast("double"), "words": words, "chars": grams})


class Featurizer:
    """Fitted TF-IDF of unit length: transform adds idx and val, the places and values of a row's features.

    structure appends the twelve counts of a message, each standardized on the fitted rows.
    """

    SOURCES = {"word": ["words"], "char": ["chars"], "both": ["words", "chars"], "structure": ["words"]}

    def __init__(self, train: DataFrame, kind: str = "word", cap: int = 25_000, char_cap: int | None = None, char_min_df: int = 1, sublinear: bool = True):
        self.sublinear, self.models, self.size = sublinear, [], 0
        for source in self.SOURCES[kind]:
            data = self._grams(train, source)
            chars = source == "chars"
            counts = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=char_cap or cap if chars else cap, minDF=char_min_df if chars else 1).fit(data)
            idf = IDF(inputCol="tf", outputCol="x").fit(counts.transform(data)).idf.toArray() + 1.0  # one is added so that no weight vanishes
            self.models.append((source, counts, idf.tolist(), self.size))
            self.size += len(idf)
        self.scale = None
        if kind == "structure":
            rows = structural_features(train)
            self.scale = rows.agg(*[F.avg(c).alias(f"{c}_m") for c in FEATURES], *[F.stddev_pop(c).alias(f"{c}_s") for c in FEATURES]).first().asDict()
            self.counts_at, self.size = self.size, self.size + len(FEATURES)

    @staticmethod
    def _grams(df: DataFrame, source: str) -> DataFrame:
        if source == "chars":
            return df.withColumn("grams", F.col("chars"))
        return NGram(n=2, inputCol="words", outputCol="pairs").transform(df).withColumn("grams", F.concat("words", "pairs")).drop("pairs")

    def terms(self, spark: SparkSession) -> DataFrame:
        """place, source, term: what the places of text features stand for."""
        rows = [(at + k, source, term) for source, counts, _, at in self.models for k, term in enumerate(counts.vocabulary)]  # bounded by the caps
        return spark.createDataFrame(rows, "place int, source string, term string")

    def transform(self, df: DataFrame) -> DataFrame:
        columns, parts = df.columns, []
        for source, counts, idf, at in self.models:
            weights = df.sparkSession.createDataFrame([(idf,)], f"idf_{source} array<double>")  # one row, bounded by the cap
            df = counts.transform(self._grams(df, source)).crossJoin(F.broadcast(weights)).withColumn("tf", F.unwrap_udt("tf"))
            tf = (lambda v: 1 + F.log(v)) if self.sublinear else (lambda v: v)
            raw = F.zip_with("tf.indices", "tf.values", lambda i, v: tf(v) * F.element_at(f"idf_{source}", i + 1))
            df = df.withColumn("x", raw).withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)))
            df = df.withColumns({f"i_{source}": F.transform("tf.indices", lambda i: i + at), f"v_{source}": F.transform("x", lambda x: x / F.col("n"))})
            df = df.drop("tf", "x", "n", "grams", f"idf_{source}")
            parts.append((f"i_{source}", f"v_{source}"))
        if self.scale is not None:
            own = [c for c in FEATURES if c not in columns]
            df = structural_features(df)
            values = [(F.col(c) - (self.scale[f"{c}_m"] or 0.0)) / (self.scale[f"{c}_s"] or 1.0) for c in FEATURES]
            places = F.sequence(F.lit(self.counts_at), F.lit(self.counts_at + len(FEATURES) - 1))
            df = df.withColumns({"i_counts": places, "v_counts": F.array(*values)}).drop(*own)
            parts.append(("i_counts", "v_counts"))
        return df.select(*columns, F.concat(*[i for i, _ in parts]).alias("idx"), F.concat(*[v for _, v in parts]).alias("val"))


class Latent:
    """Rows in the space of the largest singular vectors of fitted features, of unit length."""

    def __init__(self, rows: DataFrame, k: int = 100):
        n = rows.count()
        self.k = max(1, min(k, n - 1, n_features(rows) - 1))
        self.values, vectors = singular(rows, self.k)
        self.map = Models(np.vstack([vectors, np.zeros((1, vectors.shape[1]))]))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with vector, and with idx and val of that vector in place of its features."""
        out = self.map.margins(df, "vector").withColumn("vector", l2_normalize(F.col("vector")))
        return out.withColumns({"idx": F.sequence(F.lit(0), F.lit(self.k - 1)), "val": F.col("vector")})


class Linear:
    """One fitted model: margin, p (of class 1) and prediction for rows with idx and val."""

    def __init__(self, models: Models):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.models.margins(df, "margin").withColumn("margin", F.col("margin")[0])
        return rows.withColumns({"p": 1 / (1 + F.exp(-F.col("margin"))), "prediction": (F.col("margin") > 0).cast("double")})


def fit_logistic(df: DataFrame, c: float = 1.0, weighted: bool = True) -> Linear:
    return Linear(fit(written(df.select("y", "idx", "val")), [Problem("logistic", c, weighted)]))


def fit_svm(df: DataFrame, c: float = 1.0, weighted: bool = True) -> Linear:
    """Squared hinge loss; the bias counts as a weight."""
    return Linear(fit(written(df.select("y", "idx", "val")), [Problem("squared_hinge", c, weighted, penalized_bias=True)]))


class Ensemble:
    """The mean of some models' sigmoids."""

    def __init__(self, models: Models, sigmoids: np.ndarray):
        self.models, self.sigmoids = models, sigmoids.tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.models.margins(df, "__m")
        each = [1 / (1 + F.exp(-(a * F.col("__m")[k] + b))) for k, (a, b) in enumerate(self.sigmoids)]
        return rows.withColumn("p", sum(each, F.lit(0.0)) / len(each)).select(*df.columns, "p")


def _left_out(n: int, column: str = "fold") -> list[tuple[str, int]]:
    return [(column, k) for k in range(n)]


class Calibrated(Ensemble):
    """An average over folds of a classifier and its sigmoid, the latter fitted on the fold left out; all folds in one batch."""

    def __init__(self, df: DataFrame, n_folds: int = 5, c: float = 1.0):
        rows = written(folds(df, n_folds).select("y", "idx", "val", "fold"))
        problems = [Problem(c=c, left_out=(out,)) for out in _left_out(n_folds)]
        models = fit(rows, problems)
        super().__init__(models, fit_sigmoids(rows, models, problems))


def out_of_fold(df: DataFrame, n_folds: int = 5, c: float = 1.0) -> DataFrame:
    """Every row with a probability from a model that did not see its family; all folds are fitted in one batch."""
    rows = written(folds(df, n_folds))
    models = fit(rows, [Problem(c=c, left_out=(out,)) for out in _left_out(n_folds)])
    own = models.margins(rows, "__m").withColumn("p", 1 / (1 + F.exp(-F.element_at("__m", F.col("fold") + 1))))
    return own.select(*df.columns, "p")


def calibrated_out_of_fold(df: DataFrame, n_folds: int = 5, c: float = 1.0) -> tuple[DataFrame, Ensemble]:
    """Out-of-fold probabilities of calibrated models, and a calibrated model of all rows.

    Each outer fold leaves n_folds models of its own, one for each inner fold; those and the n_folds models
    of all rows are fitted in one batch.
    """
    rows = written(folds(folds(df, n_folds), n_folds, "g", name="inner"))
    nested = [Problem(c=c, left_out=(outer, inner)) for outer in _left_out(n_folds) for inner in _left_out(n_folds, "inner")]
    plain = [Problem(c=c, left_out=(inner,)) for inner in _left_out(n_folds, "inner")]
    models = fit(rows, nested + plain)
    sigmoids = fit_sigmoids(rows, models, nested + plain)
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in sigmoids[: len(nested)]])
    each = F.zip_with(F.slice("__m", 1, len(nested)), pairs, lambda m, s: 1 / (1 + F.exp(-(s.a * m + s.b))))
    own = F.slice("__p", F.col("fold") * n_folds + 1, F.lit(n_folds))
    scored = models.margins(rows, "__m").withColumn("__p", each)
    scored = scored.withColumn("p", F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / n_folds).select(*df.columns, "p")
    return scored, Ensemble(Models(models.weights[:, len(nested) :]), sigmoids[len(nested) :])


def predictions(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.select("id", "family", F.col("meta_category").alias("recorded_category"), "requested_category", F.when(F.col("p") >= 0.5, "UTILITY").otherwise("MARKETING").alias("prediction"), F.round("p", 6).alias("utility_probability"), M.band(F.col("p"), low, high).alias("band"))


@dataclass
class Trained:
    """What a training job leaves: scores and predictions of the holdout, the thresholds, and a model of all rows for serving."""

    report: DataFrame
    holdout: DataFrame
    low: float
    high: float
    features: Featurizer
    model: Ensemble
    rows: DataFrame


def train_and_evaluate(clean: DataFrame, target: float = 0.85, n_folds: int = 5) -> Trained:
    """Thresholds come from calibrated out-of-fold training probabilities only; the serving model is fitted anew on everything."""
    rows = written(text_columns(grouped_holdout_with_both(written(clean))))
    train, test = rows.where("not holdout"), rows.where("holdout")
    features = Featurizer(train)
    x_train = written(features.transform(train))
    tuning, evaluation = calibrated_out_of_fold(x_train, n_folds)
    scored = written(tuning.select("p", F.col("meta_category").alias("recorded_category")))
    high = M.operating_point(scored, "p", target).first()[0]
    low = 1 - M.operating_point(scored.withColumn("q", 1 - F.col("p")), "q", target, "MARKETING").first()[0]
    held = written(predictions(evaluation.transform(features.transform(test)), low, high))
    serving = Featurizer(rows)
    return Trained(M.slice_metrics(held), held, low, high, serving, Calibrated(written(serving.transform(rows)), n_folds), rows)


def predict(records: DataFrame, trained: Trained, k: int = 4) -> DataFrame:
    """A row for every record: category, probability, band, thresholds, up to k neighbours, seen_family; or a reason why not.

    Only TEXT records with known vocabulary are available; neighbours are training families of cosine above 0.
    """
    rows = text_columns(records)
    index = Index(trained.rows, record_content(), word_terms, WORDS_CAP, True)
    vectors = index.transform(rows, record_content())
    known = vectors.select("id").distinct().withColumn("known", F.lit(True))
    near = best_pairs(vectors, index.vectors, k)
    names = trained.rows.select(F.col("id").alias("right_id"), F.col("meta_category").alias("label"))
    near = near.join(names, "right_id").groupBy(F.col("left_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("right_id").alias("match"), "label", F.round("score", 3).alias("similarity")))).alias("neighbors"))
    own = normalized_content(F.col("body"))
    key = F.when(own != "", F.sha2(own, 256))  # blank bodies have no key, so that they aren't one hot key
    bodies = trained.rows.select(key.alias("own")).where("own is not null").distinct().withColumn("seen", F.lit(True))
    blank = trained.rows.agg(F.count_if(own == "") > 0).first()[0]
    scored = trained.model.transform(trained.features.transform(rows)).withColumn("own", key)
    scored = scored.join(known, "id", "left").join(near, "id", "left").join(bodies, "own", "left")
    scored = scored.withColumn("seen", F.when(F.col("own").isNull(), F.lit(blank)).otherwise(F.col("seen")))
    reason = F.when(F.col("format") != "TEXT", "not_text").when(F.col("known").isNull(), "no_known_vocabulary").otherwise("")
    only = lambda c: F.when(F.col("reason") == "", c)
    p = F.col("p")
    return scored.withColumn("reason", reason).select(
        "id", (F.col("reason") == "").alias("available"), "reason", only(F.when(p >= 0.5, "UTILITY").otherwise("MARKETING")).alias("category"),
        only(F.round(p, 4)).alias("utility_probability"), only(M.band(p, trained.low, trained.high)).alias("band"), F.lit(trained.low).alias("low"), F.lit(trained.high).alias("high"),
        only(F.coalesce("neighbors", F.array().cast("array<struct<rank:int,match:string,label:string,similarity:double>>"))).alias("neighbors"),
        only(F.coalesce("seen", F.lit(False))).alias("seen_family"),
    )


ARMS = ("word", "char", "latent", "structure", "both", "sentence_encoder")


def compare_arms(train: DataFrame, test: DataFrame, overlapping: DataFrame | None = None, arms=ARMS) -> DataFrame:
    """arm, status, dimensions and scores on one split; an arm that cannot run here is recorded as skipped.

    overlapping: ids of test rows that are near to training rows; the lower-overlap accuracy leaves them out.
    All arms have sublinear term frequencies; latent is word features in up to 100 singular dimensions.
    Without both labels in training, or without a test row, every arm is skipped.
    """
    out, session, word = None, train.sparkSession, None
    near = (overlapping if overlapping is not None else session.createDataFrame([], "id string")).select("id").distinct().withColumn("near", F.lit(True))
    marked = written(test.join(near, "id", "left").withColumn("apart", F.col("near").isNull()))
    scores = ["accuracy", "macro_f1", "utility_precision", "utility_recall", "lower_overlap_accuracy"]
    able = train.select("y").distinct().count() == 2 and marked.limit(1).count() == 1
    for arm in arms:
        if arm == "sentence_encoder" or not able:
            absent = [F.lit(None).cast("bigint").alias(c) for c in ("dimensions", "samples")] + [F.lit(None).cast("double").alias(c) for c in scores]
            row = session.range(1).select(F.lit(arm).alias("arm"), F.lit("skipped").alias("status"), *absent)
        else:
            f = word if arm == "latent" and word else Featurizer(train, "word" if arm == "latent" else arm)
            word = f if arm in ("word", "latent") else word
            x, dimensions = written(f.transform(train).select("id", "y", "idx", "val")), f.size
            held = f.transform(marked)
            if arm == "latent":
                latent = Latent(x)
                x, held, dimensions = written(latent.transform(x)), latent.transform(held), latent.k
            scored = fit_logistic(x).transform(held)
            scored = written(scored.select("apart", F.col("meta_category").alias("recorded_category"), F.when(F.col("prediction") == 1.0, "UTILITY").otherwise("MARKETING").alias("prediction")))
            right = (F.col("prediction") == F.col("recorded_category")).cast("double")
            row = scored.agg(*M.score_columns(), F.round(F.avg(F.when(F.col("apart"), right)), 6).alias("lower_overlap_accuracy"))
            f1 = M.classification_report(scored).agg(F.max("macro_f1").alias("macro_f1"))
            row = row.crossJoin(F.broadcast(f1)).select(F.lit(arm).alias("arm"), F.lit("run").alias("status"), F.lit(dimensions).cast("bigint").alias("dimensions"), "samples", *scores)
        out = row if out is None else out.unionByName(row)
    return out


# The settings that are searched.
SEARCH_KINDS, SEARCH_C, SEARCH_MODELS = ("word", "char", "both"), (0.3, 1.0, 3.0), ("svm", "logistic")
SEARCH_WORDS, SEARCH_CHARS = 50_000, 80_000
# End of fixed values.


def search(train: DataFrame, valid: DataFrame, requested_only: bool = False, kinds=SEARCH_KINDS, cs=SEARCH_C, models=SEARCH_MODELS) -> DataFrame:
    """setting, name, requested-UTILITY and overall accuracy, ranked; the first of equals leads.

    requested_only: fitted on requested UTILITY alone, with and without class weights, and what was
    requested as MARKETING is MARKETING. Settings that share features are fitted and scored together.
    """
    found = []
    losses = {"svm": "squared_hinge", "logistic": "logistic"}
    asked = F.col("requested_category") == "UTILITY"
    for kind in kinds:
        for normalize in (True, False):
            rows = text_columns(train, normalize)
            f = Featurizer(rows, kind, SEARCH_WORDS, SEARCH_CHARS, 2)
            x = written(f.transform(rows.where("requested_category = 'UTILITY'") if requested_only else rows).select("y", "idx", "val"))
            settings = [(c, name, w) for c in cs for name in models for w in ((False, True) if requested_only else (False,))]
            fitted = fit(x, [Problem(losses[name], c, w, penalized_bias=True) for c, name, w in settings], f.size)
            scored = fitted.margins(f.transform(text_columns(valid, normalize)).select("y", "requested_category", "idx", "val"))
            scores = []
            for k in range(len(settings)):
                guess = (F.col("margins")[k] > 0).cast("double")
                guess = F.when(~asked, 0.0).otherwise(guess) if requested_only else guess
                right = (guess == F.col("y")).cast("double")
                scores += [F.round(F.avg(F.when(asked, right)), 4).alias(f"a{k}"), F.round(F.avg(right), 4).alias(f"b{k}")]
            row = scored.agg(*scores).first()
            for k, (c, name, w) in enumerate(settings):
                text = "/".join([kind, "normalized" if normalize else "plain", name, str(c)] + (["balanced" if w else "plain"] if requested_only else []))
                found.append((len(found), text, row[f"a{k}"], row[f"b{k}"]))
    ranked = sorted(found, key=lambda r: (-(r[2] or 0.0), -(r[3] or 0.0), r[0]))  # one row for each setting
    rows = [(*r, k + 1) for k, r in enumerate(ranked)]
    return train.sparkSession.createDataFrame(rows, "setting int, name string, requested_accuracy double, accuracy double, rank int")


def lsa(df: DataFrame, k: int = 50) -> DataFrame:
    """id, vector: rows of unit length in the space of the largest singular vectors (signs are free)."""
    rows = written(df.select("id", "idx", "val"))
    return Latent(rows, k).transform(rows).select("id", "vector")


def compare_texts(records: DataFrame, dimensions: int = 100) -> DataFrame:
    """Methods on text vectors made here, and TF-IDF, on one grouped holdout: method, slice, scores, direction_auc, separation.

    embedding: calibrated logistic regression on the vectors; tfidf: the same on TF-IDF; direction: the discriminant at its midpoint.
    The vectors are the latent ones of the training rows' words, so no test row takes part in them.
    With too few training rows of a label for a direction, its scores are null.
    """
    rows = written(text_columns(grouped_holdout_with_both(written(records))))
    f = Featurizer(rows.where("not holdout"))
    x = written(f.transform(rows).select("id", "family", "holdout", "y", "requested_category", F.col("meta_category").alias("recorded_category"), "idx", "val"))
    latent = Latent(x.where("not holdout"), dimensions)
    v = written(latent.transform(x))
    few = v.where("not holdout").agg(F.count_if(F.col("y") == 1) < MIN_PER_CLASS, F.count_if(F.col("y") == 0) < MIN_PER_CLASS).first()
    direction = None if any(few) else fit_direction(v.where("not holdout"), "recorded_category")
    named = lambda df, p, name: df.select(
        F.lit(name).alias("method"), "recorded_category", "requested_category", F.when(p >= 0.5, "UTILITY").otherwise("MARKETING").alias("prediction"), p.alias("s"))
    held = named(v.where("holdout"), direction.score(F.col("vector")) if direction else F.lit(None).cast("double"), "direction")
    held = written(held.unionByName(named(Calibrated(v.where("not holdout")).transform(v.where("holdout")), F.col("p"), "embedding"))
                   .unionByName(named(Calibrated(x.where("not holdout")).transform(x.where("holdout")), F.col("p"), "tfidf")))
    slices = F.array(F.lit("all"), F.when(F.col("requested_category") == "UTILITY", F.lit("requested_utility")))
    scores = held.withColumn("slice", F.explode(slices)).where("slice is not null").groupBy("method", "slice").agg(*M.score_columns())
    if direction is None:
        scores = scores.withColumns({c: F.when(F.col("method") != "direction", F.col(c)) for c in ("accuracy", "utility_precision", "utility_recall")})
        return scores.withColumns({c: F.lit(None).cast("double") for c in ("direction_auc", "separation")})
    own = held.where("method = 'direction'")
    apart = M.roc_auc(own, "s").withColumnRenamed("auc", "direction_auc").crossJoin(cohens_d(own, "s", "recorded_category").withColumnRenamed("cohens_d", "separation"))
    return scores.crossJoin(F.broadcast(apart))


def to_vector(df: DataFrame, column: str = "vector") -> DataFrame:
    """df with a dense vector as features: idx and val."""
    return df.withColumns({"idx": F.sequence(F.lit(0), F.size(column) - 1), "val": F.transform(column, lambda x: x.cast("double"))})


def fit_forms(approved: DataFrame, k: int = 24, restarts: int = 10):
    """The k-means model of least cost over some restarts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = written(approved.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double")))))
    return min((KMeans(k=k, seed=seed, maxIter=20).fit(rows) for seed in range(restarts)), key=lambda m: m.summary.trainingCost)


def minimal_pairs(pairs: DataFrame, least: float = 0.15) -> DataFrame:
    """pairs (id, clean_p, contaminated_p): does the promotional rider lower the probability enough?"""
    return pairs.withColumn("drop", F.round(F.col("clean_p") - F.col("contaminated_p"), 4)).withColumn("holds", F.col("drop") >= least)
