"""Import queries: files that Spark writes from the given tables, read back by the operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators import metrics as M
from missive.plans import duck as D
from missive.plans.fixtures import P, T, fixture
from missive.sources import files as S
from missive.sources import sinks as K
from missive.sources.scratch import folder

QUERIES: dict = {}
SQL: dict = {}
#: Records of one export file.
PER_FILE = 200
BUCKET = f"ingest_seq // {PER_FILE}"


def query(name: str, sql: str) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def labels(*places: int) -> Column:
    """Buttons of the nested shape: of the lines, those at these places (from the end if below zero)."""
    lines = F.filter(F.split("buttons", "\n"), lambda b: b != "")
    some = F.slice(lines, F.lit(places[0]), F.lit(1)) if places[0] > 0 else F.slice(lines, F.lit(2), F.lit(9))
    return F.transform(some, lambda b: F.struct(b.alias("text")))


def nested(rows: DataFrame) -> Column:
    """A record as the nested export has it; every 13th has a revised category."""
    config = F.struct(F.struct(labels(-1).alias("qrButtons"), labels(1).alias("ctaButtons")).alias("buttonConfiguration"))
    message = F.struct(
        F.lit("text").alias("type"), F.lower("requested_category").alias("templateCategory"), "header", F.concat(F.lit(" "), "body", F.lit("\n")).alias("body"), "footer",
        config.alias("interactionConfiguration"),
    )
    revised = F.when(F.col("ingest_seq") % 13 == 0, "Marketing").otherwise("")
    return F.to_json(F.struct(
        F.col("id").alias("_id"), F.col("name").alias("templateName"), message.alias("messageBody"), F.col("meta_category").alias("metaTemplateCategory"),
        revised.alias("revisedMetaTemplateCategory"), F.lower("status").alias("verificationStatus"), F.col("language").alias("whatsAppLanguage"),
        F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), F.lit("secret").alias("internalNote"),
    ))


def export_files(spark: SparkSession, sf_dir: str, shape: Callable[[Column, Column], Column]) -> str:
    """One file for every PER_FILE records; shape makes its text from the bucket and the list of JSON records."""
    rows = fixture(spark, sf_dir, T)
    bucket = F.floor(F.col("ingest_seq") / PER_FILE).alias("bucket")
    files = rows.select(bucket, nested(rows).alias("row")).groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("rows"))
    path = f"{folder(spark)}/export"
    files.select(shape(F.col("bucket"), F.col("rows")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def wrapped(bucket: Column, rows: Column) -> Column:
    """An array, an object with templates or data, or the array as a JSON string, in turn."""
    array = F.concat(F.lit("["), rows, F.lit("]"))
    quoted = F.regexp_replace(F.to_json(F.struct(array.alias("v"))), r'(?s)^\{"v":|\}$', "")
    kind = bucket % 4
    return F.when(kind == 0, array).when(kind == 1, F.concat(F.lit('{"templates": '), array, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"data": '), array, F.lit("}"))).otherwise(quoted)


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalize_nested(S.read_export(spark, export_files(spark, sf_dir, wrapped))[0], "export")


REVISED = "ingest_seq % 13 = 0"
BUTTONS = "CASE ingest_seq % 3 WHEN 0 THEN concat('Shop now', chr(10), 'View details') WHEN 1 THEN 'Track order' ELSE '' END"


@query("s1_json_export", f"{D.ctes('t')} SELECT id AS external_id, name, header, body, footer, requested_category, status, language, created_at, updated_at, format FROM (SELECT * REPLACE ('TEXT' AS format) FROM t)")
def s1_json_export(s: SparkSession, d: str) -> DataFrame:
    """Exports of four shapes: every record comes back, and only the record's own fields."""
    return imported(s, d).select("external_id", "name", "header", "body", "footer", "requested_category", "status", "language", "created_at", "updated_at", "format")


@query("n4_button_labels", f"{D.ctes('t')} SELECT id AS external_id, {BUTTONS} AS buttons FROM t")
def n4_button_labels(s: SparkSession, d: str) -> DataFrame:
    """Quick replies come before calls to action."""
    return imported(s, d).select("external_id", "buttons")


@query("n10_normalize_nested", f"""{D.ctes('t')} SELECT id AS external_id, CASE WHEN {REVISED} THEN 'MARKETING' ELSE meta_category END AS meta_category, {REVISED} AS revised,
 meta_category AS original_meta_category, CASE WHEN {REVISED} THEN 'revisedMetaTemplateCategory' ELSE 'metaTemplateCategory' END AS label_source, status FROM t""")
def n10_normalize_nested(s: SparkSession, d: str) -> DataFrame:
    return imported(s, d).select("external_id", "meta_category", "revised", "original_meta_category", "label_source", "status")


@query("s4_rejected", f"""{D.ctes('t')}, b AS (SELECT DISTINCT {BUCKET} AS bucket FROM t)
 SELECT CASE bucket % 4 WHEN 1 THEN 'row is not an object' WHEN 2 THEN 'not a list of records' ELSE 'empty input' END AS reason, count(*) AS n FROM b WHERE bucket % 4 > 0 GROUP BY 1
 UNION ALL SELECT 'accepted', count(*) FROM t WHERE {BUCKET} % 4 < 2""")
def s4_rejected(s: SparkSession, d: str) -> DataFrame:
    """Files that are blank or no JSON, and rows that are no objects, by reason; the good rows beside them are accepted."""

    def shape(bucket: Column, rows: Column) -> Column:
        kind = bucket % 4
        array = F.concat(F.lit("["), rows, F.when(kind == 1, ", 17").otherwise(""), F.lit("]"))
        return F.when(kind < 2, array).when(kind == 2, F.concat(F.lit("[{"), rows)).otherwise("  \t ")

    good, bad = S.read_export(s, export_files(s, d, shape))
    accepted = good.agg(F.lit("accepted").alias("reason"), F.count(F.lit(1)).alias("n"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(accepted)


@query("s2_json_lines", f"{D.ctes('t')} SELECT id, body, '' AS reason FROM t WHERE ingest_seq % 7 <> 0 UNION ALL SELECT NULL, substr(name, 1, 6), 'malformed JSON' FROM t WHERE ingest_seq % 7 = 0")
def s2_json_lines(s: SparkSession, d: str) -> DataFrame:
    """Blank lines are skipped, and torn ones set aside."""
    rows = fixture(s, d, T)
    line = F.when(F.col("ingest_seq") % 7 == 0, F.substring("name", 1, 6)).otherwise(F.to_json(F.struct("id", "body")))
    path = f"{folder(s)}/lines"
    rows.select(F.explode(F.when(F.col("ingest_seq") % 10 == 0, F.array(line, F.lit("  "), F.lit(""))).otherwise(F.array(line))).alias("value")).write.text(path)
    good, torn = S.read_jsonl(s, path, "id string, body string")
    return good.select("id", "body", F.lit("").alias("reason")).unionByName(torn.select(F.lit(None).cast("string").alias("id"), F.col("line").alias("body"), "reason"))


@query("s3_delimited", f"{D.ctes('t')} SELECT id, name, body, buttons, status, sep FROM t, (SELECT ',' AS sep UNION ALL SELECT chr(9))")
def s3_delimited(s: SparkSession, d: str) -> DataFrame:
    """The delimited export, by comma and by tab: mark before the header, quotes and line breaks inside cells."""
    base, columns, out = folder(s), ["id", "name", "body", "buttons", "status"], None
    for sep in (",", "\t"):
        path = f"{base}/{ord(sep)}"
        first, *rest = columns
        fixture(s, d, T).select(columns).toDF("﻿" + first, *rest).write.csv(path, header=True, sep=sep, quoteAll=True, escape='"')
        read = S.read_delimited(s, path, sep)
        read = read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns], F.lit(sep).alias("sep"))
        out = read if out is None else out.unionByName(read)
    return out


def flat(s: SparkSession, d: str) -> DataFrame:
    """Flat rows under other names: two of them stand for the body, and a plain category for what was requested."""
    rows = fixture(s, d, T)
    return rows.select(
        F.col("id"), F.col("name").alias("templateName"), F.concat(F.lit(" "), "body").alias("text"), F.lit("not this").alias("message"), "footer",
        F.lower("requested_category").alias("category"), F.when(F.col("ingest_seq") % 3 == 0, F.lit(None)).otherwise(F.lower("status")).alias("verificationStatus"),
        F.to_json(F.struct(F.col("created_at").alias("$date"))).alias("createdAt"), "format",
    )


@query("s5_alias_mapping", f"{D.ctes('t')} SELECT id AS external_id, name, body, '' AS header, footer, created_at FROM t")
def s5_alias_mapping(s: SparkSession, d: str) -> DataFrame:
    """The first alias that is present is the field's column; fields without one are empty."""
    return S.normalize_flat(flat(s, d)).select("external_id", "name", "body", "header", "footer", "created_at")


@query("n11_normalize_flat", f"{D.ctes('t')} SELECT id AS external_id, requested_category, 'UNKNOWN' AS meta_category, CASE WHEN ingest_seq % 3 = 0 THEN 'UNKNOWN' ELSE status END AS status, format, 'not supplied' AS label_source, 'upload' AS source FROM t")
def n11_normalize_flat(s: SparkSession, d: str) -> DataFrame:
    """A plain category is what was requested, never what was recorded."""
    return S.normalize_flat(flat(s, d), source="upload").select("external_id", "requested_category", "meta_category", "status", "format", "label_source", "source")


FIELDS = ["body", "buttons", "footer", "header", "meta_category", "name"]


@query("n13_record_id", f"""{D.ctes('t')} SELECT name, substr(sha256(CAST(json_object({', '.join(f"'{c}', {c}" for c in FIELDS)}) AS VARCHAR)), 1, 32) AS id, source
 FROM t, (SELECT 'a' AS source UNION ALL SELECT 'b')""")
def n13_record_id(s: SparkSession, d: str) -> DataFrame:
    """Equal records of two sources have one id."""
    rows = fixture(s, d, T).select(*FIELDS)
    both = rows.withColumn("source", F.lit("a")).unionByName(rows.withColumn("source", F.lit("b")))
    return S.with_record_id(both).select("name", "id", "source")


@query("k8_export_errors", f"{D.ctes('p')} SELECT id, recorded_category, prediction, CASE WHEN prediction = 'UTILITY' THEN 'false_utility' ELSE 'false_marketing' END AS direction FROM p WHERE prediction <> recorded_category")
def k8_export_errors(s: SparkSession, d: str) -> DataFrame:
    """The error queue as JSON rows; no label of the source changes."""
    path = f"{folder(s)}/errors"
    K.export_errors(M.error_rows(fixture(s, d, P)).select("id", "recorded_category", "prediction", "direction"), path)
    return s.read.schema("id string, recorded_category string, prediction string, direction string").json(path)
