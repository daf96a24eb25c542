"""Streaming queries run to completion over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators.learn import train_and_evaluate
from missive.operators.records import training_families
from missive.operators.serving import save_model
from missive.plans import duck as D
from missive.plans.fixtures import TV, T, fixture
from missive.sources.scratch import folder
from missive.streaming import jobs as J

QUERIES: dict = {}
SQL: dict = {}


#: Files of a micro-batch: with fixtures' TASK_ROWS, some two million records.
BATCH_FILES = 200


def staged(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    base = folder(spark)
    df.write.parquet(f"{base}/in")
    return J.record_stream(spark, f"{base}/in", df.schema, BATCH_FILES), base


def t1_continuous_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, base = staged(spark, fixture(spark, sf_dir, TV))
    for _ in range(2):  # the replay adds nothing
        J.continuous_import(stream, f"{base}/store", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/store").select("id")


def t2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, base = staged(spark, fixture(spark, sf_dir, T))
    J.resumable(stream, J.scored, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def counted(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The counts after the last of as many batches as ``df`` has files for."""
    stream, base = staged(spark, df)
    counts = J.counters(stream).select(F.col("window.start").alias("start"), "meta_category", "n")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(f"{base}/out").groupBy("start", "meta_category").agg(F.max_by("n", "batch").alias("n"))
    return latest.select(F.unix_timestamp("start").alias("start"), "meta_category", "n")


def t3_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, fixture(spark, sf_dir, T))


def t4_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, base = staged(spark, fixture(spark, sf_dir, T))
    for _ in range(2):
        J.resumable(stream, lambda s: s.select("id", F.upper("name").alias("name")), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def t1_import_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of all records twice: files that come again after the first run add nothing."""
    df = fixture(spark, sf_dir, TV)
    stream, base = staged(spark, df)
    for _ in range(2):
        J.import_by_state(stream, f"{base}/store", f"{base}/state").awaitTermination()
        df.write.mode("append").parquet(f"{base}/in")
    return spark.read.parquet(f"{base}/store").select("id")


def t2_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records scored by the model of the day: a second version appears between two runs of one stream."""
    records = fixture(spark, sf_dir, T)
    first = records.where("ingest_seq % 2 = 0")
    stream, base = staged(spark, first)
    trained = train_and_evaluate(training_families(fixture(spark, sf_dir, TV)), n_folds=3)
    for version, later in ((1, records.where("ingest_seq % 2 = 1")), (2, None)):
        save_model(spark, f"{base}/models", version, trained)
        J.predicted(stream, f"{base}/models", f"{base}/out", f"{base}/state").awaitTermination()
        if later is not None:
            later.write.mode("append").parquet(f"{base}/in")
    return spark.read.parquet(f"{base}/out").drop("batch")


def t3_counters_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by window and category of each record's newest version, though all versions come, and come twice."""
    df = fixture(spark, sf_dir, TV)
    stream, base = staged(spark, df)
    for _ in range(2):
        J.resumable(stream, J.changes, f"{base}/out", f"{base}/state").awaitTermination()
        df.write.mode("append").parquet(f"{base}/in")
    return J.counts_of(spark.read.schema(J.CHANGE).parquet(f"{base}/out"))


QUERIES |= {"t1_import_by_state": t1_import_by_state, "t2_predicted": t2_predicted, "t3_counters_by_id": t3_counters_by_id}
QUERIES |= {"t1_continuous_import": t1_continuous_import, "t2_scored": t2_scored, "t3_counters": t3_counters, "t4_resumable": t4_resumable}
_PUR = f"({D.purpose('body')})"
_FOUND = " + ".join(f"{D.hit(c, p)}::INT" for c in D.R.COMPONENTS for p in D.R.PROMOTIONS.values())
_START = "CAST(floor(epoch(try_cast(replace(created_at, 'Z', '+00:00') AS TIMESTAMPTZ)) / 2592000) * 2592000 AS BIGINT)"
SQL |= {
    "t1_import_by_state": f"{D.ctes('tv')} SELECT DISTINCT id FROM tv",
    "t3_counters_by_id": f"{D.ctes('tv')} SELECT {_START} AS start, meta_category, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) AS k FROM tv) WHERE k = 1 GROUP BY 1, 2",
    "t1_continuous_import": f"{D.ctes('tv')} SELECT DISTINCT id FROM tv",
    "t2_scored": f"{D.ctes('t')} SELECT id, {_PUR} AS purpose, {D.assess(_PUR, 'true')} AS verdict, CAST({_FOUND} AS INT) AS findings FROM t",
    "t3_counters": f"{D.ctes('t')} SELECT CAST(floor(epoch(try_cast(replace(created_at, 'Z', '+00:00') AS TIMESTAMPTZ)) / 2592000) * 2592000 AS BIGINT) AS start, meta_category, count(*) AS n FROM t GROUP BY 1, 2",
    "t4_resumable": f"{D.ctes('t')} SELECT id, upper(name) AS name FROM t",
}
