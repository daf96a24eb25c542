"""What must hold on larger tables: rows spread over tasks, rare labels, hashes of fixed depth, small intermediate tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from missive.functions import text
from missive.llm import buckets, spelling
from missive.operators import dense, learn, records, reports, similarity, splits
from missive.plans import fixtures
from missive.sources import sinks

SF = "/root/testdata/sf0.001"


def families(spark, utility, marketing=60):
    rows = [(f"f{k}", "UTILITY" if k < utility else "MARKETING", "UTILITY") for k in range(utility + marketing)]
    return spark.createDataFrame(rows, "family string, meta_category string, requested_category string")


def messages(spark, utility, marketing=60):
    rows = families(spark, utility, marketing).withColumns({"id": F.col("family"), "format": F.lit("TEXT"), "status": F.lit("ACTIVE")})
    body = F.concat(F.when(F.col("meta_category") == "UTILITY", "Your order has shipped ").otherwise("Get our new offer "), "family")
    return rows.withColumns({"body": body, **{c: F.lit("") for c in ("header", "footer", "buttons")}})


def test_tables_of_one_split_are_worked_on_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 50)
    df = fixtures.fixture(spark, SF, fixtures.TV)
    assert df.rdd.getNumPartitions() >= 4 and df.count() == 3 * spark.read.parquet(f"{SF}/part.parquet").count()


def test_families_are_worked_out_by_methods_that_the_jvm_compiles(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else no stage has code before it runs
    try:
        records.training_families(fixtures.fixture(spark, SF, fixtures.TV)).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000, sizes


def test_family_keys_equal_those_of_plain_columns(spark):
    rows = [("", "Your order {{1}} has shipped", "", ""), (None, "Visit https://a.b/c or a@b.cd, 20% off", None, "x\ny"), ("", "", "", ""), (None, None, None, None), ("!", "?", "", ""), ("Grüße", "ÄÖ_1 \u0967", "www.x.y", "")]
    df = spark.createDataFrame(rows, "header string, body string, footer string, buttons string")
    plain = text.short_hash(F.coalesce(F.nullif(text.normalized_content(text.record_content()), F.lit("")), text.normalized_content(F.coalesce("body", F.lit("")))))
    got = df.select(text.family_key().alias("family"), plain.alias("plain"), text.family_key(F.lit(" own ")).alias("own")).collect()
    assert all(r["family"] == r["plain"] and len(r["family"]) == 24 and r["own"] == hashlib.sha256(b"own").hexdigest()[:24] for r in got)


@pytest.mark.parametrize("utility", [0, 1, 2, 3])
def test_rare_labels_are_held_out_where_they_can_be(spark, utility):
    for tries in (0, 10):
        rows = splits.grouped_holdout_with_both(families(spark, utility), tries=tries).groupBy("meta_category").agg(F.count_if("holdout").alias("h"), F.count_if(~F.col("holdout")).alias("t")).collect()
        found = {r["meta_category"]: r for r in rows}
        assert found["MARKETING"]["h"] > 0 and found["MARKETING"]["t"] > 0
        if utility:
            assert found["UTILITY"]["t"] > 0 and (found["UTILITY"]["h"] > 0) == (utility > 1)


def test_training_goes_on_with_one_family_of_a_label(spark):
    report = {r["slice"]: r for r in learn.train_and_evaluate(messages(spark, 1), n_folds=2).report.collect()}
    assert report["all"]["samples"] > 0 and report["all"]["recorded_utility"] == 0


def test_methods_without_enough_families_have_no_scores(spark):
    out = {r["method"]: r for r in learn.compare_texts(messages(spark, 3), 5).where("slice = 'all'").collect()}
    assert set(out) == {"direction", "embedding", "tfidf"} and len({r["samples"] for r in out.values()}) == 1
    assert out["direction"]["accuracy"] is None and out["tfidf"]["accuracy"] is not None and all(r["direction_auc"] is None for r in out.values())


def test_arms_without_both_labels_are_skipped(spark):
    rows = learn.text_columns(messages(spark, 3))
    out = learn.compare_arms(rows.where("meta_category = 'MARKETING'"), rows).collect()
    assert [r["arm"] for r in out] == list(learn.ARMS) and {r["status"] for r in out} == {"skipped"}


def test_revisions_of_fixed_depth(spark, monkeypatch):
    monkeypatch.setattr(records, "GROUP_HASHES", 1)
    ids = [str(k) for k in range(3000)]
    groups = defaultdict(list)
    for h in sorted(hashlib.sha256(i.encode()).hexdigest() for i in ids):
        groups[h[:2]].append(h)
    want = hashlib.sha256("".join(sorted(hashlib.sha256("".join(g).encode()).hexdigest() for g in groups.values())).encode()).hexdigest()
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    assert records.revision(df, digits=2).first()[0] == want
    deep = records.revision(df).first()[0]
    got = entry.queries()["l1_revision"](spark, SF).first()[0]
    parts = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"))
    assert deep != want and got == records.revision(parts, digits=2).first()[0]


def test_totals_of_tenths_are_exact(spark):
    tenths = [0.1, 2.3, 2.3, 2.8]  # added as doubles they stay below 7.5, in any order
    report = spark.createDataFrame([(x, 1) for x in tenths], "expected_at_base_rate double, service_messages bigint").coalesce(1)
    assert reports.form_totals(report, spark.range(10)).first()["floor"] == 8


def test_leaks_keep_only_grams_that_are_looked_up(spark, monkeypatch):
    kept = []
    plain = sinks.written
    monkeypatch.setattr(sinks, "written", lambda df: kept.append(plain(df)) or kept[-1])
    published = spark.range(200).select(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512)).alias("s")).unionByName(spark.createDataFrame([("xx a secret passage yy",)], "s string"))
    corpus = spark.createDataFrame([("a secret passage",), ("not there at all",)], "body string")
    assert [r["s"] for r in sinks.leaks(published, "s", corpus).collect()] == ["xx a secret passage yy"]
    held = next(df for df in kept if df.columns == ["value", "gram"])
    assert held.count() < 200


@pytest.mark.parametrize("name", ["p8_ratify", "p14_accept_fill", "m29_minimal_pairs"])
def test_families_that_are_fitted_and_scored_are_worked_out_once(spark, monkeypatch, name):
    calls, plain = [], records.training_families
    monkeypatch.setattr(records, "training_families", lambda df: calls.append(1) or plain(df))
    entry.queries()[name](spark, SF)
    assert len(calls) == 1


def test_a_vocabulary_moves_no_terms_by_document(spark, monkeypatch):
    rows = [("a", "one two two three"), ("a", "two one"), ("b", "one two"), (None, "three three one two"), (None, "two"), ("c", None), ("d", ""), ("e", "solo x")]
    df = spark.createDataFrame(rows, "id string, text string")
    want = [similarity.vocabulary(similarity.word_terms(df, F.col("text")), cap).collect() for cap in (3, 100)]
    plain = similarity.word_terms(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), F.col("text"))
    same = similarity.vocabulary(plain, 8000).collect()
    monkeypatch.setattr(similarity, "word_terms", None)
    assert [similarity.word_vocabulary(df, F.col("text"), cap).collect() for cap in (3, 100)] == want
    assert entry.queries()["w11_vocabulary"](spark, SF).collect() == same


@pytest.mark.parametrize("floor", [-2.0, 0.1])
def test_the_best_of_a_part_are_those_of_a_full_sort(floor):
    x = np.random.default_rng(3).standard_normal((40, 6)).round(1)
    x[5], x[10:30] = 0, x[10]  # a zero vector, and more copies than are asked for
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    s, want = x @ x.T, []
    rounded = np.round(s, 6) + 0.0
    for row, order in enumerate(np.argsort(-rounded, axis=1, kind="stable")[:, :5]):
        want += [(row, c, rounded[row, c]) for c in order if rounded[row, c] >= floor]
    assert list(zip(*(a.tolist() for a in dense.best_of(s, 5, np.full(40, floor))))) == want


def test_tables_of_words_and_repeated_rows_are_never_broadcast(spark, tmp_path):
    """Spark sizes exploded rows by their file, so a file just under its bound became a table of many times that in the driver."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark.range(300).selectExpr("cast(id as string) AS word", "cast(id % 7 as string) AS root").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    joined = buckets.spread_join(words, words.selectExpr("word AS root", "root AS next"), "root", "word", "left")
    assert "Broadcast" not in plan(joined) and joined.count() == 300 and joined.where("next is null").count() == 0
    docs = spark.createDataFrame([(k, "colour colour colour colour colour colour color color color planet planet planet") for k in range(3)], "doc_id long, text string")
    got = spelling.spelling_groups(docs)
    assert "Broadcast" not in plan(got) and {r["word"]: r["root"] for r in got.collect()} == {"colour": "colour", "color": "colour", "planet": "planet"}
    pairs = spelling.near_words(got.select("word", "n"))
    pairs.collect()
    assert not re.search(r"BroadcastHashJoin \[[^\]]*part", plan(pairs))


def shuffled_rows(spark, after=-1):
    """Rows that the session's queries have shuffled since a query's number; the last query's number."""
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList()
    for run in (found.apply(k) for k in range(found.size())):
        if (number := run.executionId()) > after:
            values, metrics, last = store.executionMetrics(number), run.metrics(), max(last, number)
            for m in {m.accumulatorId(): m for m in (metrics.apply(k) for k in range(metrics.size()))}.values():
                if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total, last


def test_all_pairs_are_searched_without_moving_rows_for_each_list(spark, monkeypatch):
    """Vectors without order, so that every query visits nearly all of the 38 lists."""
    monkeypatch.setattr(dense, "CELL", 16)
    x = np.random.default_rng(7).standard_normal((600, 16))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vector array<double>")
    _, before = shuffled_rows(spark)
    got = {r["id"]: r["match"] for r in dense.exact_topk(df, df, 2).where("rank = 2").collect()}
    moved, _ = shuffled_rows(spark, before)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate(np.argsort(-(x @ x.T), axis=1)[:, 1].tolist()))
    assert 600 < moved < 10 * 600, moved


def test_a_block_keeps_the_best_of_all_parts_whatever_comes_first(monkeypatch):
    monkeypatch.setattr(dense, "STEP", 8)
    x = np.random.default_rng(9).standard_normal((30, 4)).round(1)
    x[3], x[10:25] = 0, x[10]
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    want = np.lexsort((np.broadcast_to(np.arange(30), (30, 30)), -(np.round(x @ x.T, 6) + 0.0)), axis=1)[:, :5]
    for names in (np.arange(30), np.array([f"n{k:02}" for k in range(30)], dtype=object)):
        best = dense.Best(x, 5)
        for part in (slice(20, 30), slice(0, 3), slice(3, 20)):
            best.meet(np.arange(30), x[part], names[part])
        assert (best.match == names[want]).all()


def test_very_many_equal_scores_are_thinned_out_first():
    s = np.tile(np.where(np.arange(500) % 3 == 0, 0.5, 0.50000004), (7, 1))
    row, column, score = dense.best_of(s, 2, np.full(7, 0.5))
    assert column.tolist() == [0, 1] * 7 and row.tolist() == sorted([*range(7)] * 2) and set(score.tolist()) == {0.5}
