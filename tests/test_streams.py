"""Streams with state and with stored models."""

import pyarrow as pa
from pyspark.sql import functions as F

from missive.operators import learn, serving
from missive.plans import learn_queries
from missive.plans.fixtures import T, fixture
from missive.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_revisions_and_replays_count_once(spark, tmp_path):
    schema = "id string, ingest_seq bigint, created_at string, meta_category string"
    batches = [
        [("a", 1, "2024-01-05T00:00:00Z", "UTILITY"), ("b", 2, "2024-01-05T00:00:00Z", "UTILITY"), ("c", 3, "never", "MARKETING")],
        [("a", 1, "2024-01-05T00:00:00Z", "UTILITY"), ("b", 9, "2024-01-05T00:00:00Z", "MARKETING"), ("b", 4, "2024-01-05T00:00:00Z", "AUTHENTICATION")],
        [("b", 5, "2024-03-20T00:00:00Z", "UTILITY"), ("a", 7, "2024-03-20T00:00:00Z", "UTILITY")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.record_stream(spark, f"{tmp_path}/in", schema)
        jobs.resumable(stream, jobs.changes, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["start"], r["meta_category"]): r["n"] for r in jobs.counts_of(spark.read.schema(jobs.CHANGE).parquet(f"{tmp_path}/out")).collect()}
    month = 30 * 86400
    first, last = 1704412800 // month * month, 1710892800 // month * month
    assert got == {(last, "UTILITY"): 1, (first, "MARKETING"): 1, (None, "MARKETING"): 1}


def test_stream_takes_up_a_new_model(spark, tmp_path):
    """A stored model scores as the fitted one does, and a version saved between runs scores what comes after."""
    clean = learn_queries.clean(spark, SF)
    trained = learn.train_and_evaluate(clean, n_folds=2)
    records = fixture(spark, SF, T)
    models = f"{tmp_path}/models"
    for version, part in ((1, "ingest_seq % 3 = 0"), (4, "ingest_seq % 3 <> 0")):
        serving.save_model(spark, models, version, trained)
        records.where(part).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.predicted(jobs.record_stream(spark, f"{tmp_path}/in", records.schema), models, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = trained.model.transform(trained.features.transform(learn.text_columns(records))).select("id", "ingest_seq", F.round("p", 4).alias("p")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r["id"]]["version"] == (1 if r["ingest_seq"] % 3 == 0 else 4) and abs(got[r["id"]]["utility_probability"] - r["p"]) < 2e-4


def test_ids_share_states_and_calls(spark, tmp_path, monkeypatch):
    """A state and a call for each of millions of ids took hours; null ids, times, categories and numbers count too."""
    monkeypatch.setattr(jobs, "GROUPS", 8, raising=False)
    schema = "id string, ingest_seq bigint, created_at string, meta_category string"
    first = [(f"i{k}", k, "2024-01-05T00:00:00Z", ["UTILITY", "MARKETING", None][k % 3]) for k in range(90)] + [(None, 1, "never", None), ("x", None, "never", "UTILITY")]
    then = [(f"i{k}", k + 100, "2024-03-20T00:00:00Z", "UTILITY") for k in range(0, 90, 2)] + first[:30] + [(None, 2, "2024-03-20T00:00:00Z", None), ("x", -5, "never", "MARKETING")]
    for rows in (first, then):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        query = jobs.resumable(jobs.record_stream(spark, f"{tmp_path}/in", schema), jobs.changes, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8
    newest = {}
    for key, seq, at, category in [*first, *then]:
        if key not in newest or (seq or -(2**63)) > newest[key][0]:
            newest[key] = (-(2**63) if seq is None else seq, at, category)
    month, want = 30 * 86400, {}
    for _, at, category in newest.values():
        start = {"2024-01-05T00:00:00Z": 1704412800 // month * month, "2024-03-20T00:00:00Z": 1710892800 // month * month}.get(at)
        want[(start, category)] = want.get((start, category), 0) + 1
    assert {(r["start"], r["meta_category"]): r["n"] for r in jobs.counts_of(spark.read.schema(jobs.CHANGE).parquet(f"{tmp_path}/out")).collect()} == want


def test_old_ids_leave_a_shared_state_one_by_one():
    def rows(*entries):
        return pa.Table.from_pylist([dict(zip(jobs.ENTRY.names, e)) for e in entries], jobs.ENTRY)

    kept, changed = jobs._newest(jobs.ENTRY.empty_table(), rows(("a", 1, 0, "U", 10), ("b", 1, 0, "U", 50), ("a", 1, 5, "M", 10), ("c", 2, 0, "M", 10)), 0, 100)
    assert kept.to_pylist() == rows(("a", 1, 0, "U", 10), ("b", 1, 0, "U", 50), ("c", 2, 0, "M", 10)).to_pylist()
    assert {(r["start"], r["meta_category"]): r["n"] for r in changed.to_pylist()} == {(0, "U"): 2, (0, "M"): 1}
    kept, changed = jobs._newest(kept, rows(("c", 1, 7, "U", 120)), 120, 100)  # a replay keeps c, nothing came of a
    assert [(r["id"], r["seq"], r["seen"]) for r in kept.to_pylist()] == [("b", 1, 50), ("c", 2, 120)] and changed.num_rows == 0
    kept, changed = jobs._newest(kept, jobs.ENTRY.empty_table(), 300, 100)
    assert kept.num_rows == 0 and changed.num_rows == 0
