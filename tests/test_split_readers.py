"""Files read in many parts give the rows of files read whole."""

import csv
import json
import random

import pytest

from missive.sources import arrays, files, quoted


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(rng):
    return "".join(rng.choice(["a", "b", ",", '"', "\n", "é", " ", "\t", "}", "{", "[", "]", "\\", "☃"]) for _ in range(rng.randrange(0, 60)))


@pytest.mark.parametrize("sep,limit", [(",", quoted.BROADCAST_RANGES), ("\t", 0)])
def test_quoted_cells_across_ranges(spark, small_ranges, tmp_path, monkeypatch, sep, limit):
    monkeypatch.setattr(quoted, "BROADCAST_RANGES", limit)
    rng = random.Random(2)
    rows = [[str(k), *(cell(rng) for _ in range(3))] for k in range(150)]
    for name, part in (("a", rows[:100]), ("b", rows[100:]), ("c", [])):
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8", newline="") as f:
            f.write("﻿")
            out = csv.writer(f, delimiter=sep, quoting=csv.QUOTE_ALL, lineterminator="\n")
            out.writerow(["id", "x", 'y "q"', ""])
            out.writerows(part)
    df = files.read_delimited(spark, str(tmp_path), sep)
    assert df.columns == ["id", "x", 'y "q"', "_c3"] and quoted.lines(spark, str(tmp_path)).select("block").distinct().count() > 20
    assert sorted(([v or "" for v in r] for r in df.collect()), key=lambda r: int(r[0])) == rows


RECORD = "id bigint, text string, list array<struct<a:string>>, inner struct<b:string>"


@pytest.mark.parametrize("limit", [arrays.BROADCAST_RANGES, 0])
def test_arrays_across_ranges(spark, small_ranges, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(arrays, "BROADCAST_RANGES", limit)
    rng = random.Random(4)
    rows = [{"id": k, "text": cell(rng), "list": [{"a": cell(rng)} for _ in range(rng.randrange(3))], "inner": {"b": cell(rng)}} for k in range(120)]
    odd = [17, "a, {string}", None, [1, {"id": 5}], []]
    mixed = rows[:60]
    for k, o in enumerate(odd):
        mixed = [*mixed[: 7 * k], o, *mixed[7 * k :]]
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("array.json", "﻿ " + json.dumps(mixed, ensure_ascii=False))
    put("pretty.json", json.dumps({"templates": rows[60:90], "data": [{"id": 1}], "more": {"x": [{"id": 2}]}}, indent=2))
    put("data.json", json.dumps({"note": "x", "data": rows[90:100]}))
    put("string.json", json.dumps(json.dumps(rows[100:110])))
    put("tail.json", json.dumps(rows[110:]) + "\n\n")
    put("none.json", "[]")
    put("one.json", json.dumps({"id": 1000, "text": "alone", "list": [], "inner": {"b": "c"}}))
    put("torn.json", json.dumps(rows[:20])[:-1])
    put("torn2.json", json.dumps(rows[:20])[:-700])
    put("blank.json", "  \n ")
    put("words.json", "no json at all")
    good, bad = files.read_export(spark, str(tmp_path), RECORD)
    got = sorted((json.loads(json.dumps(r.asDict(recursive=True))) for r in good.collect()), key=lambda r: r["id"])
    assert got == [*rows, {"id": 1000, "text": "alone", "list": [], "inner": {"b": "c"}}]
    reasons = sorted((r["file"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect())
    assert reasons == sorted([("array.json", "row is not an object")] * len(odd) + [("torn.json", "not a list of records"), ("torn2.json", "not a list of records"), ("blank.json", "empty input"), ("words.json", "not a list of records")])
    assert arrays.pieces(spark, str(tmp_path)).select("block").distinct().count() > 20


def test_a_malformed_record_is_rejected_alone(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1}, {"id": }, {"id": 3}]')
    good, bad = files.read_export(spark, str(tmp_path), "id bigint")
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and [r["reason"] for r in bad.collect()] == ["malformed JSON"]
