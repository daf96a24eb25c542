"""Import, report and learning queries: against SQL where there is some, else against plain versions."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from missive.functions.text import date_value
from missive.operators import learn, metrics, ranges, records, replies, similarity, splits
from missive.plans import import_queries, learn_queries, report_queries
from missive.plans.fixtures import T, fixture

SF = "/root/testdata/sf0.001"
TABLES = "part labels events embeddings conversations documents benchmark".split()
CALLERS = [
    "g5_all_neighbors", "k6_leaked_passages", "b3_parse_responses", "b4_parse_rewrites", "b5_parse_components", "t1_import_by_state", "t3_counters_by_id",
    "s6_load_done", "k5_publish", "k6_leak_audit", "b8_select_candidate", "j13_paired", "w12_check_bad_partitions", "l1_revision", "a20_roc_auc", "w6_cutoff", "m22_fixed_split", "m23_stratified_sample", "m24_cohort_sample", "j6_neighbors",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", [*import_queries.SQL, *report_queries.SQL, *learn_queries.SQL, *CALLERS])
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want)) and want


FILLED = [
    ("Hi {{name}}", "Hi Rahul"),
    ("Pay ₹{{Amount}} now", "Pay ₹4,250 now"),
    ("Rs. {{amount}}, {{price}}, {{fee}}, {{amount}}", "Rs. 4,250, ₹1,890, ₹12,400, ₹4,250"),
    ("{{link}} {{url}} {{x_link}} {{href}}", "https://example.com/p/8c31fa https://example.com/b/47dd10 https://example.com/t/9ba2e5 https://example.com/p/8c31fa"),
    ("Your plan {{type}} is {{status}}", "Your plan Home is confirmed"),
    ("{{x}}{{y}}{{z}}", "842133755309127104468"),
    ("due on {{v}}", "due on 12 October"),
    ("due on " + "z" * 30 + "{{v}}", "due on " + "z" * 30 + "8421337"),
    ("{{percent}}% off", "10% off"),
    ("Dear {{1}}", "Dear Rahul"),
    ("no marks", "no marks"),
    ("", ""),
]


def test_samples_by_rule(spark):
    df = spark.createDataFrame(FILLED, "t string, want string")
    assert [(r["t"], r["f"]) for r in df.select("t", "want", replies.fill_by_rule(F.col("t")).alias("f")).collect()] == FILLED
    bodies = fixture(spark, SF, T).select("body", replies.fill_by_rule(F.col("body")).alias("f")).collect()
    for r in bodies:
        pattern = "(?:.*?)".join(re.escape(part) for part in re.split(r"\{\{[^}]+\}\}", r["body"]))
        assert "{{" not in r["f"] and re.fullmatch(pattern, r["f"], re.S)


def test_running_sums_and_ranks_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    values = sorted(set(rng.integers(0, 10_000, 1500).tolist()))
    rows = [(float(v), int(n), float(n) / 4) for v, n in zip(values, rng.integers(0, 50, len(values)))]
    df = spark.createDataFrame(rows, "x double, n bigint, w double").repartition(3)
    for descending in (False, True):
        ordered = sorted(rows, reverse=descending)
        got = {r["x"]: (r["before_n"], r["before_w"]) for r in ranges.before(df, "x", ["n", "w"], descending).collect()}
        for k, (x, _, _) in enumerate(ordered):
            assert got[x] == (sum(r[1] for r in ordered[:k]), pytest.approx(sum(r[2] for r in ordered[:k])))
    assert ranges.before(df.where("x < 0"), "x", ["n"]).count() == 0
    people = spark.createDataFrame([(str(k), None if k % 5 == 0 else "ab"[k % 2]) for k in range(400)], "id string, s string")
    ranked = ranges.hash_ranked(people, ["s"], F.sha2("id", 256), "id").select("s", "id", F.sha2("id", 256).alias("h"), "__rank", "__n").collect()
    for s in (None, "a", "b"):
        part = sorted((r["h"], r["__rank"]) for r in ranked if r["s"] == s)
        assert [k for _, k in part] == list(range(1, len(part) + 1)) and {r["__n"] for r in ranked if r["s"] == s} == {len(part)}


def test_best_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    bodies = [" ".join(rng.choice("order case invoice plan today get new visit pay now for your the".split(), 6)) for _ in range(120)] + ["zzz", ""]
    df = spark.createDataFrame([(str(k), b) for k, b in enumerate(bodies)], "id string, body string")
    index = similarity.Index(df.where("cast(id as int) % 2 = 0"), F.col("body"))
    left = index.transform(df.where("cast(id as int) % 2 = 1"), F.col("body"))
    for k in (1, 7):
        want = similarity.top_k(similarity.cosine_pairs(left, index.vectors), k).select("left_id", "right_id", "score", "rank")
        got = similarity.best_pairs(left, index.vectors, k).select("left_id", "right_id", "score", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dates_are_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        texts = ["2024-03-01T10:00:00", "2024-03-01T10:00:00Z", "2024-03-01 15:30:00+05:30", "2024-03-01", "x", None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in df.select(F.unix_timestamp(date_value(F.col("t")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1709287200, 1709287200, 1709287200, 1709251200, None, None]


def test_revision_has_more_levels_for_more_ids(spark, monkeypatch):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    plain = records.revision(ids).first()[0]
    assert plain == records.revision(ids.repartition(7)).first()[0] != records.revision(ids.limit(2999)).first()[0]
    monkeypatch.setattr(records, "GROUP_HASHES", 1)
    deep = records.revision(ids).first()[0]
    assert deep == records.revision(ids.repartition(7)).first()[0] != plain


def test_stored_splits_and_single_assessments(spark, tmp_path):
    df = spark.createDataFrame([(f"f{k}", "UTILITY" if k % 2 else "MARKETING", "UTILITY") for k in range(80)], "family string, meta_category string, requested_category string")
    first = splits.persisted_split(df, str(tmp_path / "split"))
    assert sorted(first.collect()) == sorted(splits.persisted_split(df, str(tmp_path / "split"), seed="other").collect())
    with pytest.raises(ValueError):
        splits.persisted_split(df.where("family <> 'f3'"), str(tmp_path / "split"))
    ids = df.select(F.col("family").alias("id"))
    report = spark.createDataFrame([("text", 0.5)], "model string, accuracy double")
    with pytest.raises(ValueError):
        metrics.assess_once(report, ids.where("id <> 'f3'"), ids, str(tmp_path / "report"))
    assert metrics.assess_once(report, ids, ids, str(tmp_path / "report")).collect() == report.collect()
    with pytest.raises(Exception, match="(?i)exist"):
        metrics.assess_once(report, ids, ids, str(tmp_path / "report"))


def test_training_job_and_serving(spark):
    trained = learn.train_and_evaluate(learn_queries.clean(spark, SF), n_folds=3)
    held = trained.holdout.collect()
    right = np.mean([r["prediction"] == r["recorded_category"] for r in held])
    share = np.mean([r["recorded_category"] == "UTILITY" for r in held])
    assert right > max(share, 1 - share) and all(0 <= r["utility_probability"] <= 1 for r in held) and 0 <= trained.low <= 1 and 0 <= trained.high <= 1
    train_families = {r["family"] for r in trained.rows.where("not holdout").select("family").collect()}
    assert not train_families & {r["family"] for r in held}
    odd = spark.createDataFrame([("x", "", "¿¡", "", "", "UTILITY", "UTILITY", "TEXT", "")], "id string, header string, body string, footer string, buttons string, meta_category string, requested_category string, format string, created_at string")
    records_ = fixture(spark, SF, T).select(odd.columns).unionByName(odd)
    out = {r["id"]: r for r in learn.predict(records_, trained).collect()}
    assert len(out) == records_.count() and out["x"]["reason"] == "no_known_vocabulary" and not out["x"]["available"]
    for r in out.values():
        if r["available"]:
            assert 0 <= r["utility_probability"] <= 1 and len(r["neighbors"]) <= 4 and r["category"] == ("UTILITY" if r["utility_probability"] >= 0.5 else "MARKETING")
            assert [n["similarity"] for n in r["neighbors"]] == sorted((n["similarity"] for n in r["neighbors"]), reverse=True)
    assert any(r["seen_family"] for r in out.values())


def test_out_of_fold_rows_come_once(spark):
    train, _ = learn_queries.split(spark, SF)
    x = learn.Featurizer(train).transform(train)
    scored = learn.out_of_fold(x, 3)
    assert scored.count() == train.count() == scored.select("id").distinct().count() and scored.where("p < 0 or p > 1").count() == 0


def test_search_ranks_all_settings(spark):
    train, valid = learn_queries.split(spark, SF)
    rows = learn.search(train, valid, True, kinds=("word",), cs=(1.0,)).collect()
    assert len(rows) == 8 and sorted(r["rank"] for r in rows) == list(range(1, 9))
    best = min(rows, key=lambda r: r["rank"])
    assert best["requested_accuracy"] == max(r["requested_accuracy"] for r in rows)
