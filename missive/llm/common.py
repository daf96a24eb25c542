"""What the operators share: the folder for intermediate tables, batch sizes, and input columns."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that go to Python at once; texts may be long, so far fewer than Spark's own bounds.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4 << 20
#: Bytes of one range of a range partitioning.
RANGE_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or (local masters only) one of our own."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("missive.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="missive-")
        spark.conf.set("missive.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def prepare(spark: SparkSession) -> None:
    """Makes the checkpoint folder known and keeps Arrow batches of long texts small."""
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors.

    ``metrics`` are aggregates over it, read from the written table, in the result's ``metrics``; a count
    reads no column.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    out.metrics = out.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict() if metrics else {}
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def range_count(spark: SparkSession, nbytes: int) -> int:
    """Ranges for so many bytes: no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nbytes / RANGE_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def row_key(docs: DataFrame, salt: int = 0) -> Column:
    """SHA-256 of all columns; only rows that are equal throughout share it."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    head = F.to_json(F.struct(F.lit(salt).alias("_salt"), F.struct(*others).alias("_row"), F.col("text").isNull().alias("_no_text")))
    return F.unhex(F.sha2(F.concat(head.cast("binary"), F.lit("\n").cast("binary"), text_or_empty().cast("binary")), 256))
