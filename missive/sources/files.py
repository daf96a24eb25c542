"""Exports of message records: nested or flat JSON, JSON Lines, delimited text, result logs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.text import as_text, category, stripped, timestamp_text
from missive.sources.arrays import elements, shapes
from missive.sources.quoted import read_quoted
from missive.sources.scratch import written

# Input column names by field; the first that is present wins.
ALIASES = {
    "name": ["name", "templateName", "template_name"],
    "body": ["body", "text", "message", "content", "template_text"],
    "header": ["header"], "footer": ["footer"], "buttons": ["buttons"],
    "meta_category": ["meta_category", "metaTemplateCategory", "meta_category_decision"],
    "requested_category": ["requested_category", "templateCategory", "category"],
    "status": ["status", "verificationStatus", "verification_status"],
    "language": ["language", "whatsAppLanguage"],
    "created_at": ["created_at", "createdAt"], "family_id": ["family_id"],
}
# End of fixed values.

NESTED = """_id string, templateName string, messageBody struct<type:string,templateCategory:string,header:string,body:string,footer:string,
interactionConfiguration:struct<buttonConfiguration:struct<qrButtons:array<struct<text:string>>,ctaButtons:array<struct<text:string>>>>>,
metaTemplateCategory string, revisedMetaTemplateCategory string, verificationStatus string, status string, whatsAppLanguage string, createdAt string, updatedAt string"""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines): blank lines are skipped, torn ones rejected."""
    lines = spark.read.text(path).where(stripped(F.col("value")) != "")
    parsed = F.from_json("value", f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    rows = lines.select("value", parsed.alias("r"))
    torn = rows.where("r.__corrupt is not null").select(F.col("value").alias("line"), F.lit("malformed JSON").alias("reason"))
    return rows.where("r.__corrupt is null").select("r.*").drop("__corrupt"), torn


def read_export(spark: SparkSession, path: str, schema: str = NESTED) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): an array, an object with templates or data, one object, or any of these as a JSON string.

    Arrays, bare or as an object's first key ``templates``, are read in parts of each file; files of the other
    shapes are read whole. Blank input is rejected; a file of no bytes has nothing to reject, since Spark reads no
    row from it.
    """
    shape = written(shapes(spark, path))
    files = shape.groupBy("file").agg(F.min("base").alias("base"), F.min("balanced").alias("balanced"))
    torn = files.where("base > 0 and not balanced").select("file", F.lit("not a list of records").alias("reason"))
    rows = elements(spark, path, shape).select("file", stripped(F.col("text")).alias("raw")).where("raw <> ''")
    others = [unquote(r["file"]) for r in files.where("base = 0").select("file").collect()]  # file names, which the driver lists anyhow
    bad = torn
    if others:
        more, rejected = _read_whole(spark, others)
        rows, bad = rows.unionByName(more), torn.unionByName(rejected)
    rows = written(rows)
    is_object = rows["raw"].startswith("{")
    unread = F.try_parse_json("raw").isNull()
    odd = rows.where(~is_object | unread).select("file", F.when(is_object, "malformed JSON").otherwise("row is not an object").alias("reason"))
    return rows.where(is_object & ~unread).select(F.from_json("raw", schema).alias("r")).select("r.*"), bad.unionByName(odd)


def _read_whole(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, raw of each record; file, reason) of files that are read whole."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace(stripped(F.col("value")), "^\\x{FEFF}", "").alias("v"))
    # a string that holds JSON is unpacked once
    files = files.withColumn("v", F.when(F.col("v").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "v", F.lit("}")), "v string")["v"]).otherwise(F.col("v")))
    inner = F.coalesce(F.get_json_object("v", "$.templates"), F.get_json_object("v", "$.data"), F.col("v"))
    files = files.withColumn("v", F.when(F.col("v").startswith("{"), inner).otherwise(F.col("v")))
    files = files.withColumn("v", F.when(F.col("v").startswith("{"), F.concat(F.lit("["), "v", F.lit("]"))).otherwise(F.col("v")))
    items = written(files.select("file", (F.col("v") == "").alias("blank"), F.from_json("v", "array<string>").alias("items")))
    bad = items.where("items is null OR blank").select("file", F.when(F.col("blank"), "empty input").otherwise("not a list of records").alias("reason"))
    return items.where("not blank").select("file", F.explode("items").alias("raw")).withColumn("raw", F.ltrim("raw")), bad


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; a byte-order mark before the first header goes. Files are read in parts, quoted line ends or not."""
    return read_quoted(spark, path, sep)


def suggest_mapping(columns: list[str]) -> dict[str, str]:
    """field -> input column, by exact case."""
    return {field: next(a for a in aliases if a in columns) for field, aliases in ALIASES.items() if any(a in columns for a in aliases)}


def normalize_flat(df: DataFrame, mapping: dict[str, str] | None = None, source: str = "") -> DataFrame:
    """Flat rows by mapping; a plain category is what was requested, never what was recorded."""
    mapping = suggest_mapping(df.columns) if mapping is None else mapping
    text = lambda f: as_text(F.col(mapping[f])) if f in mapping else F.lit("")
    upper = lambda c, default: F.coalesce(F.nullif(F.upper(c), F.lit("")), F.lit(default))
    own = lambda c, default: upper(as_text(F.col(c)), default) if c in df.columns else F.lit(default)
    return df.select(
        (as_text(F.col("id")) if "id" in df.columns else F.lit("")).alias("external_id"), *[text(f).alias(f) for f in ("name", "header", "body", "footer", "buttons", "language", "family_id")],
        category(text("meta_category")).alias("meta_category"), category(text("requested_category")).alias("requested_category"), upper(text("status"), "UNKNOWN").alias("status"),
        timestamp_text(text("created_at")).alias("created_at"), (timestamp_text(as_text(F.col("updated_at"))) if "updated_at" in df.columns else F.lit("")).alias("updated_at"),
        own("format", "TEXT").alias("format"), F.lit(mapping.get("meta_category", "not supplied")).alias("label_source"), F.lit(source).alias("source"))


def normalize_nested(df: DataFrame, source: str = "") -> DataFrame:
    """Nested rows; a revised category supersedes the first; other fields of the export do not survive."""
    m = F.col("messageBody")
    config = m["interactionConfiguration"]["buttonConfiguration"]
    empty = F.array().cast("array<struct<text:string>>")
    buttons = F.filter(F.concat(F.coalesce(config["qrButtons"], empty), F.coalesce(config["ctaButtons"], empty)), lambda b: F.coalesce(b["text"], F.lit("")) != "")
    revised = F.coalesce(F.nullif(as_text(F.col("revisedMetaTemplateCategory")), F.lit("")), F.lit(""))
    upper = lambda c: F.nullif(F.upper(as_text(c)), F.lit(""))
    return df.select(
        as_text(F.col("_id")).alias("external_id"), as_text(F.col("templateName")).alias("name"), *[as_text(m[c]).alias(c) for c in ("header", "body", "footer")],
        F.array_join(F.transform(buttons, lambda b: stripped(b["text"])), "\n").alias("buttons"),
        category(F.coalesce(F.nullif(revised, F.lit("")), "metaTemplateCategory")).alias("meta_category"), category(m["templateCategory"]).alias("requested_category"),
        F.coalesce(upper(F.col("verificationStatus")), upper(F.col("status")), F.lit("UNKNOWN")).alias("status"), as_text(F.col("whatsAppLanguage")).alias("language"),
        timestamp_text(F.col("createdAt")).alias("created_at"), timestamp_text(F.col("updatedAt")).alias("updated_at"), F.coalesce(upper(m["type"]), F.lit("UNKNOWN")).alias("format"), F.lit("").alias("family_id"),
        F.when(revised != "", "revisedMetaTemplateCategory").otherwise("metaTemplateCategory").alias("label_source"), (revised != "").alias("revised"), category(F.col("metaTemplateCategory")).alias("original_meta_category"), F.lit(source).alias("source"))


def with_record_id(df: DataFrame) -> DataFrame:
    """id from the row's content; the source does not take part."""
    fields = sorted(c for c in df.columns if c not in ("source", "id"))
    return df.withColumn("id", F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 32))


def load_done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result log, resumable: torn lines are skipped and the last row of an id wins, by file name and place in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    place = F.struct("file", "block", F.monotonically_increasing_id().alias("line"))  # ids rise within a block
    parsed = F.from_json("value", f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    rows = lines.select(place.alias("place"), parsed.alias("r")).where("r.id is not null AND r.__corrupt is null")
    return rows.groupBy("r.id").agg(F.max_by("r", "place").alias("r")).select("r.*").drop("__corrupt")
