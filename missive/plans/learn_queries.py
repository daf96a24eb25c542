"""Queries that fit models: features have SQL, fitted models are checked by tests against plain solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators import learn as L
from missive.operators import metrics as M
from missive.operators import records as O
from missive.operators import rules as U
from missive.operators import similarity as Y
from missive.operators import splits as S
from missive.operators import vectors as V
from missive.operators.replies import fill_by_rule
from missive.plans import duck as D
from missive.plans.fixtures import TV, T, fixture
from missive.plans.metric_queries import FIXED
from missive.plans.similarity_queries import fit_sql, terms_sql, weight_sql
from missive.plans.text_queries import _FEATURES as STRUCTURE_SQL
from missive.plans.vector_queries import e
from missive.sources.scratch import written

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def clean(s: SparkSession, d: str) -> DataFrame:
    """The training families, worked out once for all that reads them."""
    return written(O.training_families(fixture(s, d, TV)))


def split(s: SparkSession, d: str, families: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    families = clean(s, d) if families is None else families
    rows = written(L.text_columns(families.join(S.fixed_split(families), "family")))
    return rows.where("part = 'train'"), rows.where("part = 'validation'")


SIDES = "trn AS (SELECT c.* FROM clean c JOIN parts USING (family) WHERE part = 'train'), val AS (SELECT c.* FROM clean c JOIN parts USING (family) WHERE part = 'validation')"


def _weights(name: str, kind: str, cap: int) -> list[str]:
    """Weights of the validation rows' terms, fitted on the training rows."""
    return [terms_sql(f"t{name}", "trn", D.content(), kind), fit_sql(f"t{name}", "trn", cap), terms_sql(f"v{name}", "val", D.content(), kind), weight_sql(f"w{name}", f"v{name}", f"t{name}", True)]


SQL["m3_combined_tfidf"] = f"""{D.ctes('tv', D.clean_cte(), FIXED, SIDES, *_weights('w', 'word', 25000), *_weights('c', 'char', 80000))}
SELECT id, 'words' AS source, term, round(w, 6) AS w FROM ww UNION ALL SELECT id, 'chars', term, round(w, 6) FROM wc"""


@query
def m3_combined_tfidf(s, d):
    """Words and characters side by side, each of unit length: the features by name."""
    train, valid = split(s, d)
    f = L.Featurizer(train, "both", char_cap=80_000)
    each = f.transform(valid).select("id", F.explode(F.arrays_zip("idx", "val")).alias("x")).select("id", F.col("x.idx").alias("place"), F.col("x.val").alias("w"))
    return each.join(F.broadcast(f.terms(s)), "place").select("id", "source", "term", F.round("w", 6).alias("w"))


_EXACT = STRUCTURE_SQL.replace("round(coalesce(", "(coalesce(").replace("0), 6) AS uppercase_ratio", "0)) AS uppercase_ratio")
SQL["m4_structure"] = f"""{D.ctes('tv', D.clean_cte(), FIXED, SIDES)},
ft AS (UNPIVOT (SELECT {_EXACT} FROM trn) ON {', '.join(L.FEATURES)} INTO NAME feature VALUE x),
fv AS (UNPIVOT (SELECT id, {_EXACT} FROM val) ON {', '.join(L.FEATURES)} INTO NAME feature VALUE x),
scale AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM ft GROUP BY feature)
SELECT id, feature, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS x FROM fv JOIN scale USING (feature)"""


@query
def m4_structure(s, d):
    """The standardized counts that the structure arm appends."""
    train, valid = split(s, d)
    f = L.Featurizer(train, "structure")
    own = F.transform(F.slice("val", -len(L.FEATURES), len(L.FEATURES)), lambda x, i: F.struct(F.element_at(F.array(*map(F.lit, L.FEATURES)), i + 1).alias("feature"), F.round(x, 5).alias("x")))
    return f.transform(valid).select("id", F.explode(own).alias("c")).select("id", "c.feature", "c.x")


@query
def m5_logistic(s, d):
    train, valid = split(s, d)
    f = L.Featurizer(train)
    return L.fit_logistic(f.transform(train)).transform(f.transform(valid)).select("id", "y", "prediction", F.round("p", 4).alias("p"))


@query
def m6_svm(s, d):
    train, valid = split(s, d)
    f = L.Featurizer(train)
    return L.fit_svm(f.transform(train)).transform(f.transform(valid)).select("id", "y", "prediction", F.round("margin", 3).alias("margin"))


@query
def m7_calibrated(s, d):
    train, valid = split(s, d)
    f = L.Featurizer(train)
    return L.Calibrated(f.transform(train)).transform(f.transform(valid)).select("id", "y", F.round("p", 4).alias("p"))


@query
def m8_out_of_fold(s, d):
    train, _ = split(s, d)
    return L.out_of_fold(L.Featurizer(train).transform(train)).select("id", "family", "y", F.round("p", 4).alias("p"))


@query
def m10_predict(s, d):
    """Every record, of whatever format, by the serving model: category, probability, band, neighbours, or why it has none."""
    trained = L.train_and_evaluate(clean(s, d))
    out = L.predict(fixture(s, d, T), trained)
    return out.withColumn("neighbors", F.to_json("neighbors"))


@query
def m12_train(s, d):
    return L.train_and_evaluate(clean(s, d)).report


@query
def m14_compare_arms(s, d):
    rows = written(L.text_columns(clean(s, d).join(S.chronological_split(fixture(s, d, TV)), "family")))
    train, test = rows.where("side = 'train'"), rows.where("side = 'test'")
    return L.compare_arms(train, test, Y.near_duplicates(train, test))


@query
def m16_search(s, d):
    return L.search(*split(s, d))


@query
def m16_requested_search(s, d):
    return L.search(*split(s, d), requested_only=True)


@query
def m18_lsa(s, d):
    train, _ = split(s, d)
    return L.lsa(L.Featurizer(train).transform(train), 100)


@query
def m18_project(s, d):
    """Rows that took no part in the decomposition, in its space."""
    train, valid = split(s, d)
    f = L.Featurizer(train)
    return L.Latent(written(f.transform(train).select("idx", "val"))).transform(f.transform(valid)).select("id", "vector")


@query
def m19_forms(s, d):
    rows = e(s, d)
    model = L.fit_forms(rows.where("category = 'UTILITY'"))
    centres = s.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "form int, centre array<double>")
    return V.nearest_centre(rows, centres)


@query
def m21_reward(s, d):
    rows = L.to_vector(e(s, d)).withColumn("y", (F.col("category") == "UTILITY").cast("double"))
    model = L.fit_logistic(rows.where("id % 4 <> 0"))
    return model.transform(rows.where("id % 4 = 0")).select("id", "y", F.round("p", 4).alias("reward"))


@query
def m28_compare_embedding(s, d):
    """Direction at its midpoint and logistic regression on given vectors, on one split: scores, AUC and Cohen's d."""
    rows = e(s, d)
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    direction = V.fit_direction(train)
    named = lambda df, p, name: df.select(F.lit(name).alias("method"), F.col("category").alias("recorded_category"), F.when(p >= 0.5, "UTILITY").otherwise("MARKETING").alias("prediction"), p.alias("s"))
    a = named(test, direction.score(F.col("vector")), "direction")
    model = L.fit_logistic(L.to_vector(train).withColumn("y", (F.col("category") == "UTILITY").cast("double")))
    b = named(model.transform(L.to_vector(test)), F.col("p"), "logistic")
    both = a.unionByName(b)
    out = both.groupBy("method").agg(*M.score_columns())
    apart = [M.roc_auc(x, "s").crossJoin(V.cohens_d(x, "s", "recorded_category")).withColumn("method", F.lit(name)) for name, x in (("direction", a), ("logistic", b))]
    return out.join(apart[0].unionByName(apart[1]), "method")


@query
def m28_compare_texts(s, d):
    """Calibrated logistic regression and direction on text vectors made here, and calibrated TF-IDF, on the same families."""
    return L.compare_texts(clean(s, d))


def _with_probability(s, d, families: DataFrame, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """rows with p, by a model of the families' training part."""
    train, _ = split(s, d, families)
    f = L.Featurizer(train)
    model = L.fit_logistic(f.transform(train))
    return {k: model.transform(f.transform(L.text_columns(x))) for k, x in rows.items()}


@query
def m29_minimal_pairs(s, d):
    families = clean(s, d)
    base = families.where("meta_category = 'UTILITY'")
    out = _with_probability(s, d, families, {"clean": base, "spoilt": base.withColumn("body", F.concat("body", F.lit(" Shop now.")))})
    return L.minimal_pairs(out["clean"].select("id", F.col("p").alias("clean_p")).join(out["spoilt"].select("id", F.col("p").alias("contaminated_p")), "id")).select("id", "drop", "holds")


@query
def p8_ratify(s, d):
    """Edited messages that the classifier reads as UTILITY."""
    families = clean(s, d)
    edited = U.split_promotional(families).where(F.size("removed") > 0).withColumn("body", F.col("kept_body"))
    return _with_probability(s, d, families, {"x": edited})["x"].select("id", (F.col("p") >= 0.5).alias("ratified"))


@query
def p14_accept_fill(s, d):
    """Bodies with sample values by rule, where they stay clean and still read as UTILITY; else unfilled."""
    families = clean(s, d)
    filled = families.withColumn("body", fill_by_rule(F.col("body")))
    out = _with_probability(s, d, families, {"x": filled})["x"]
    return out.select("id", F.when((F.col("p") >= 0.5) & ~U.is_promotional(F.col("body")), F.col("body")).alias("accepted"))
