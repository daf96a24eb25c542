"""Reading exports of every shape, writing them, and replaying streams."""

import json

from pyspark.sql import functions as F

from missive.operators import similarity as Y
from missive.sources import files as S
from missive.sources import sinks as K

NESTED = {"_id": "1", "templateName": "n", "authorEmail": "x@y.z", "messageBody": {"type": "TEXT", "templateCategory": "UTILITY", "header": "h", "body": " b ", "footer": "f", "interactionConfiguration": {"buttonConfiguration": {"qrButtons": [{"text": "Q"}], "ctaButtons": [{"text": "C"}, {"text": ""}]}}}, "metaTemplateCategory": "UTILITY", "revisedMetaTemplateCategory": "MARKETING", "verificationStatus": "", "status": "active", "whatsAppLanguage": "EN", "createdAt": {"$date": "2024-01-01"}, "updatedAt": "2024-02-01"}


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_export_shapes(spark, tmp_path):
    one, two = NESTED, NESTED | {"_id": "2"}
    shapes = {"array": json.dumps([one, two]), "envelope": json.dumps({"templates": [one, two]}), "data": json.dumps({"data": [one, two]}), "double": json.dumps(json.dumps([one, two]))}
    for name, text in shapes.items():
        good, bad = S.read_export(spark, put(tmp_path, name, text))
        assert [r["_id"] for r in good.orderBy("_id").collect()] == ["1", "2"] and bad.count() == 0
    good, _ = S.read_export(spark, put(tmp_path, "single", json.dumps(one)))
    (r,) = S.normalize_nested(good, "f").collect()
    assert (r["body"], r["buttons"], r["meta_category"], r["original_meta_category"], r["status"], r["created_at"], r["revised"]) == ("b", "Q\nC", "MARKETING", "UTILITY", "ACTIVE", "2024-01-01", True)
    assert "x@y.z" not in str(r)
    for text, reason in ((" \n", "empty input"), ("nonsense", "not a list of records"), ("[1, 2]", "row is not an object")):
        good, bad = S.read_export(spark, put(tmp_path, "bad", text))
        assert good.count() == 0 and {x["reason"] for x in bad.collect()} == {reason}


def test_lines_and_delimited(spark, tmp_path):
    good, bad = S.read_jsonl(spark, put(tmp_path, "l.jsonl", '{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n{"id": "c", "n'), "id string, n int")
    assert sorted(r["id"] for r in good.collect()) == ["a", "b"] and bad.count() == 1
    df = S.read_delimited(spark, put(tmp_path, "d.csv", '﻿name,text,category\nx,"two\nlines",UTILITY\n'))
    assert df.columns == ["name", "text", "category"] and df.first()["text"] == "two\nlines"
    assert S.suggest_mapping(df.columns) == {"name": "name", "body": "text", "requested_category": "category"}
    (r,) = S.normalize_flat(df).collect()
    assert (r["meta_category"], r["requested_category"], r["status"]) == ("UNKNOWN", "UTILITY", "UNKNOWN")
    assert len(S.with_record_id(S.normalize_flat(df)).first()["id"]) == 32
    done = S.load_done(spark, put(tmp_path, "log", '{"id": "a", "v": 1}\n{"id": "a", "v": 2}\n{"id": "b", "v'), "id string, v int")
    assert [tuple(r) for r in done.collect()] == [("a", 2)]


def test_sinks(spark, tmp_path):
    row = {c: "x" for c in K.EXPORT_COLUMNS} | {"id": "1", "name": "=1+1", "body": "+formula"}
    df = spark.createDataFrame([tuple(row[c] for c in K.EXPORT_COLUMNS)], ", ".join(f"{c} string" for c in K.EXPORT_COLUMNS))
    K.export_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part-*.csv"))
    assert text.startswith("﻿") or text.startswith('"﻿')
    assert "'=1+1" in text and "'+formula" in text
    store = df.selectExpr("*", "1L AS ingest_seq")
    assert tuple(K.append_new(store, str(tmp_path / "store")).first()) == (1, 0)
    assert tuple(K.append_new(store, str(tmp_path / "store")).first()) == (0, 1)
    published = spark.createDataFrame([("all fine",), ("secret body text here",)], "s string")
    corpus = spark.createDataFrame([("body text here",), ("absent message",)], "body string")
    assert K.leak_count(published, "s", corpus).first()[0] == 1


def test_prefix_filter_loses_no_pair(spark):
    texts = [(str(k), " ".join(f"w{(k * j) % 17} item{j % 5}" for j in range(1, 9))) for k in range(40)]
    df = spark.createDataFrame(texts, "id string, body string")
    v = Y.Index(df, df["body"], Y.word_terms, 1000).vectors
    every = {(r["left_id"], r["right_id"]): r["score"] for r in Y.cosine_pairs(v, v).collect()}
    found = {(r["left_id"], r["right_id"]): r["score"] for r in Y.cosine_pairs(v, v, 0.6).collect()}
    assert found == {k: s for k, s in every.items() if s >= 0.6} and found


def test_counters_lose_no_late_row(spark):
    """25 files are three batches, and the latest dates come first."""
    from missive.plans.stream_queries import counted

    rows = [(f"2024-{1 + k // 8:02d}-{1 + k % 28:02d}T00:00:00Z", "UTILITY" if k % 3 else "MARKETING") for k in range(96)] + [("invalid", "UTILITY")]
    df = spark.createDataFrame(rows, "created_at string, meta_category string").repartitionByRange(25, F.desc("created_at"))
    want = df.groupBy((F.floor(F.unix_timestamp(F.try_to_timestamp("created_at")) / 2592000) * 2592000).alias("start"), "meta_category").agg(F.count(F.lit(1)).alias("n"))
    got = counted(spark, df)
    assert sorted(map(repr, map(tuple, got.select("start", "meta_category", "n").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert got.agg(F.sum("n")).first()[0] == len(rows)


def test_counters_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.sql("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    got = entry.queries()["t3_counters"](spark, "/root/testdata/sf0.001")
    want = con.sql(f"SELECT start, meta_category, n FROM ({entry.oracle_sql()['t3_counters']})").fetchall()
    assert sorted(map(tuple, got.select("start", "meta_category", "n").collect())) == sorted(want)
