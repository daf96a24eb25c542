"""Registered queries that fit models, in one session with an observation before them."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from missive.operators import learn
from missive.operators import rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return lambda name: entry.queries()[name](spark, SF)


def test_arms_share_a_split(rows):
    out = {r["arm"]: r for r in rows("m14_compare_arms").collect()}
    assert set(out) == set(learn.ARMS) and out.pop("sentence_encoder")["status"] == "skipped"
    assert len({r["samples"] for r in out.values()}) == 1 and out["latent"]["dimensions"] <= 100
    for r in out.values():
        assert r["status"] == "run" and 0.5 < r["accuracy"] <= 1 and 0 <= r["macro_f1"] <= 1 and 0 <= r["lower_overlap_accuracy"] <= 1


def test_methods_meet_on_the_same_families(rows):
    out = rows("m28_compare_texts").collect()
    assert {(r["method"], r["slice"]) for r in out} == {(m, s) for m in ("direction", "embedding", "tfidf") for s in ("all", "requested_utility")}
    for s in ("all", "requested_utility"):
        assert len({r["samples"] for r in out if r["slice"] == s}) == 1
    assert all(0.5 < r["direction_auc"] <= 1 and r["separation"] > 0 and r["accuracy"] > 0.5 for r in out)
    given = {r["method"]: r for r in rows("m28_compare_embedding").collect()}
    assert set(given) == {"direction", "logistic"} and all(0 <= r["auc"] <= 1 for r in given.values())


def test_riders_lower_the_probability(rows):
    out = rows("m29_minimal_pairs").collect()
    assert out and all(r["holds"] == (r["drop"] >= 0.15) for r in out) and sum(r["drop"] > 0 for r in out) > len(out) / 2


def test_ratified_and_filled(rows, spark):
    ratified = rows("p8_ratify").collect()
    assert ratified and all(r["ratified"] in (True, False) for r in ratified)
    filled = rows("p14_accept_fill").where("accepted is not null")
    assert filled.count() and filled.where(F.col("accepted").contains("{{") | rules.is_promotional(F.col("accepted"))).count() == 0


def test_rewards_are_probabilities_of_rows_left_out(rows, spark):
    out = rows("m21_reward").collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 4 = 0").count()
    assert len(out) == n and all(0 <= r["reward"] <= 1 and r["id"] % 4 == 0 for r in out)
