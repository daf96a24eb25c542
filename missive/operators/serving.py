"""Stored models: versions in a folder that jobs and streams share, read again whenever a batch begins.

A version's terms and weights are written first and its entry in ``meta`` last, so that readers see
whole versions only. All of it is bounded by the vocabulary's cap and the number of folds.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators import metrics as M
from missive.operators.fits import Models
from missive.operators.learn import Ensemble, Featurizer, Trained, text_columns

TERMS, WEIGHTS = "source string, place int, term string, idf double", "model int, place int, w double"
META = "version int, about string"


class Served:
    """A version ready to score: its number, features, model and thresholds."""

    def __init__(self, version: int, features: Featurizer, model: Ensemble, low: float, high: float):
        self.version, self.features, self.model, self.low, self.high = version, features, model, low, high

    def score(self, records: DataFrame) -> DataFrame:
        """id, version, category, utility_probability, band of each record."""
        rows = self.model.transform(self.features.transform(text_columns(records)))
        return rows.select(
            "id", F.lit(self.version).alias("version"), F.when(F.col("p") >= 0.5, "UTILITY").otherwise("MARKETING").alias("category"),
            F.round("p", 4).alias("utility_probability"), M.band(F.col("p"), self.low, self.high).alias("band"))


def save_model(spark: SparkSession, path: str, version: int, trained: Trained) -> None:
    """Adds a version; a text model only (its structure counts, if any, aren't stored)."""
    f, model = trained.features, trained.model
    if f.scale is not None:
        raise ValueError("only text features are stored")
    terms = [(source, k, t, idf[k]) for source, counts, idf, _ in f.models for k, t in enumerate(counts.vocabulary)]
    spark.createDataFrame(terms, TERMS).write.parquet(f"{path}/terms/version={version}")
    w = model.models.weights
    weights = [(j, int(i), float(w[i, j])) for j in range(w.shape[1]) for i in np.flatnonzero(w[:, j])]
    spark.createDataFrame(weights, WEIGHTS).write.parquet(f"{path}/weights/version={version}")
    about = {"size": f.size, "sublinear": f.sublinear, "sources": [[s, at] for s, _, _, at in f.models], "sigmoids": model.sigmoids, "low": trained.low, "high": trained.high}
    spark.createDataFrame([(version, json.dumps(about))], META).write.mode("append").parquet(f"{path}/meta")


def load_latest(spark: SparkSession, path: str) -> Served:
    """The version of the highest number."""
    version, about = spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.desc("version")).first()
    about = json.loads(about)
    terms = spark.read.schema(TERMS).parquet(f"{path}/terms/version={version}").orderBy("source", "place").collect()
    f = Featurizer.__new__(Featurizer)
    f.sublinear, f.models, f.size, f.scale = about["sublinear"], [], about["size"], None
    for source, at in about["sources"]:
        own = [t for t in terms if t["source"] == source]
        counts = CountVectorizerModel.from_vocabulary([t["term"] for t in own], inputCol="grams", outputCol="tf")
        f.models.append((source, counts, [t["idf"] for t in own], at))
    weights = np.zeros((f.size + 1, len(about["sigmoids"])))
    for r in spark.read.schema(WEIGHTS).parquet(f"{path}/weights/version={version}").collect():
        weights[r["place"], r["model"]] = r["w"]
    return Served(version, f, Ensemble(Models(weights), np.array(about["sigmoids"])), about["low"], about["high"])
