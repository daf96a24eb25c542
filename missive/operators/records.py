"""Message records: candidates, cohorts, families, summaries, lookup and lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.patterns import COMPLETED
from missive.functions.text import family_key, record_content, stripped

MAX_BODY, MAX_CONTENT, MIN_BODY = 20_000, 40_000, 10


def is_candidate() -> Column:
    return F.col("status").isin(COMPLETED) & (F.col("format") == "TEXT") & F.col("meta_category").isin("MARKETING", "UTILITY") & (F.length(stripped(F.col("body"))) >= MIN_BODY)


def candidates(df: DataFrame) -> DataFrame:
    return df.where(is_candidate())


def is_mismatch() -> Column:
    return (F.col("requested_category") == "UTILITY") & (F.col("meta_category") == "MARKETING")


def cohorts(df: DataFrame) -> DataFrame:
    """Rows that asked for UTILITY, with cohort approved or downgraded."""
    cohort = F.when(F.col("meta_category") == "UTILITY", "approved").when(F.col("meta_category") == "MARKETING", "downgraded")
    return df.where("requested_category = 'UTILITY'").withColumn("cohort", cohort).where("cohort is not null")


def length_guard(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("accepted", (F.length(body) <= MAX_BODY) & (F.length(record_content() if body == "body" else body) <= MAX_CONTENT))


def browse(df: DataFrame, q: str = "", category: str = "", status: str = "", mismatch: bool = False, page: int = 1, size: int = 10) -> DataFrame:
    """One page, newest first, of the rows that contain q in any of five fields, and the number of all of them."""
    found = df
    if q:
        hit = [F.contains(F.lower(c), F.lit(q.lower())) for c in ("name", "header", "body", "footer", "buttons")]
        found = found.where(reduce(lambda a, b: a | b, hit))
    if category:
        found = found.where(F.col("meta_category") == category)
    if status:
        found = found.where(F.col("status") == status)
    if mismatch:
        found = found.where(is_mismatch())
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc("ingest_seq")).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def lookup(df: DataFrame, record_id: str) -> DataFrame:
    return df.where(F.col("id") == record_id)


def with_family(df: DataFrame) -> DataFrame:
    return df.withColumn("family", family_key())


def latest_per_family(df: DataFrame) -> DataFrame:
    """The newest record of each family: an aggregate, so it combines on the map side."""
    rank = F.struct(F.coalesce(F.nullif("updated_at", F.lit("")), "created_at").alias("at"), "ingest_seq")
    columns = [c for c in df.columns if c != "family"]
    return df.groupBy("family").agg(F.max_by(F.struct(*columns), rank).alias("r")).select("family", "r.*")


def family_labels(df: DataFrame) -> DataFrame:
    """family, n, labels over the candidates."""
    return with_family(candidates(df)).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("meta_category").alias("labels"))


def training_families(df: DataFrame) -> DataFrame:
    """The newest candidate of each family whose candidates all have one label."""
    rows = with_family(candidates(df))
    rank = F.struct(F.coalesce(F.nullif("updated_at", F.lit("")), "created_at").alias("at"), "ingest_seq")
    columns = [c for c in rows.columns if c != "family"]
    kept = rows.groupBy("family").agg(F.max_by(F.struct(*columns), rank).alias("r"), F.min("meta_category").alias("a"), F.max("meta_category").alias("z")).where("a = z")
    return kept.select("family", "r.*")


def conflicting_families(df: DataFrame) -> DataFrame:
    return family_labels(df).where("labels > 1").select("family", "n")


def summary_counts(df: DataFrame) -> DataFrame:
    """field, value, n: one scan for all the value counts, by grouping sets."""
    fields = ["meta_category", "requested_category", "status", "format", "language"]
    rows = df.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("UNKNOWN")))
    exploded = rows.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    which = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (len(fields) - 1 - i)) == 0, F.lit(f)) for i, f in enumerate(fields)])
    return exploded.select(which.alias("field"), F.coalesce(*fields).alias("value"), "n")


def source_and_label_counts(df: DataFrame) -> DataFrame:
    """field, value, n: records by source, and training families by label."""
    by = lambda rows, c, name: rows.groupBy(F.lit(name).alias("field"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by(df, "source", "source").unionByName(by(training_families(df), "meta_category", "training_category"))


def summary_totals(df: DataFrame) -> DataFrame:
    """One row of totals over records and families."""
    rows = with_family(df).withColumn("candidate", is_candidate())
    families = rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("candidate").alias("c"), F.count_distinct(F.when(F.col("candidate"), F.col("meta_category"))).alias("labels"),
        F.count_if(is_mismatch()).alias("mismatches"), F.count_if(stripped(F.col("body")) == "").alias("blank"))
    return families.agg(
        F.sum("n").alias("total"), F.sum("mismatches").alias("category_mismatches"), F.count(F.lit(1)).alias("families"), F.sum(F.col("n") - 1).alias("duplicate_records"),
        F.count_if(F.col("labels") > 1).alias("conflicting_families"), F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("c"))), F.lit(0)).alias("conflicting_records"),
        F.sum("c").alias("candidate_records"), F.count_if(F.col("labels") == 1).alias("training_families"), F.sum("blank").alias("missing_bodies"))


def pool_sizes(df: DataFrame) -> DataFrame:
    """Candidates, families, and clean families per cohort."""
    pool = cohorts(candidates(df)).groupBy("cohort").agg(F.count(F.lit(1)).alias("records"))
    clean = cohorts(training_families(df)).groupBy("cohort").agg(F.count(F.lit(1)).alias("clean_families"))
    return pool.join(clean, "cohort", "left").withColumn("clean_families", F.coalesce("clean_families", F.lit(0)))


#: Hashes that one group of ``revision`` may hold on average.
GROUP_HASHES = 4096


def _bucket_hashes():
    """bucket, h in order -> the hash of each bucket's hashes, which pass by one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        put = lambda: pa.RecordBatch.from_pydict({"bucket": [now], "h": [digest.hexdigest()]})
        for batch in batches:
            for bucket, h in zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist()):
                if bucket != now:
                    if digest is not None:
                        yield put()
                    now, digest = bucket, hashlib.sha256()
                digest.update(h.encode())
        if digest is not None:
            yield put()

    return run


def revision(df: DataFrame, column: str = "id", digits: int | None = None) -> DataFrame:
    """An order-independent hash of all ids, in levels: a group is the hashes that share their first digits.

    There are two digits, and one more for each factor of 16 beyond 256 * GROUP_HASHES ids, unless digits fixes
    their number; the groups' hashes are grouped by one digit less at each level, and the last two digits at once.
    The first level's hashes are sorted in their tasks and hashed as they pass, so no group is held as a whole.
    """
    if digits is None:
        digits, n = 2, df.count()
        while n > GROUP_HASHES * 16**digits:
            digits += 1
    h = F.sha2(F.col(column), 256)
    rows = df.select(F.substring(h, 1, digits).alias("bucket"), h.alias("h")).where("h is not null")
    tasks = max(1, min(16**digits, df.sparkSession.sparkContext.defaultParallelism * 4))
    level = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "h").mapInArrow(_bucket_hashes(), "bucket string, h string")
    joined = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h")
    for left in range(digits - 1, 1, -1):
        level = level.groupBy(F.substring("bucket", 1, left).alias("bucket")).agg(joined)
    return level.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("revision"))


def fingerprint(df: DataFrame, fields: list[str], digits: int | None = None) -> DataFrame:
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
    return revision(df.select(row.alias("id")), digits=digits)


def import_records(incoming: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one row of counts): each new id once; the rest count as present."""
    first = incoming.groupBy("id").agg(F.min_by(F.struct(*incoming.columns), "ingest_seq").alias("r")).select("r.*")
    new = first if stored is None else first.join(stored.select("id"), "id", "left_anti").select(incoming.columns)
    counts = incoming.agg(F.count(F.lit(1)).alias("n")).crossJoin(new.agg(F.count(F.lit(1)).alias("added")))
    return new, counts.select("added", (F.col("n") - F.col("added")).alias("present"))
