"""Writing records, published aggregates and error queues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.operators.records import import_records
from missive.operators.rules import safe_cell
from missive.sources.scratch import written

# Columns of the delimited export, in order.
EXPORT_COLUMNS = ["id", "name", "header", "body", "footer", "buttons", "meta_category", "requested_category", "status", "language", "created_at", "updated_at"]
# End of fixed values.


def append_new(df: DataFrame, path: str) -> DataFrame:
    """Insert-or-ignore by id into a Parquet store; returns the counts added and present."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:  # Spark's own class for this differs between modes
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = None
    new, counts = import_records(df, stored)
    out = spark.createDataFrame(counts.collect(), "added bigint, present bigint")
    new.write.mode("append").parquet(path)
    return out


def export_csv(df: DataFrame, path: str) -> None:
    """Delimited text with the fixed columns; a byte-order mark leads, and no cell is a formula."""
    cells = df.select(*[safe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in EXPORT_COLUMNS])
    first, *rest = EXPORT_COLUMNS
    cells.toDF("﻿" + first, *rest).write.csv(path, header=True, quoteAll=True, escape='"')


def publish(report: DataFrame, fields: list[str], path: str) -> None:
    """Only the named fields leave."""
    report.select(*fields).write.json(path)


#: Grams that a source text is looked up by.
PROBES = 8
#: Most bits of the filter of looked-up grams (32 MB); it has 32 bits a gram, 2^20 at least, up to there, and lets more pass beyond.
FILTER_BITS = 1 << 28


def _filter(probes: DataFrame):
    """(broadcast words of the filter of probes' grams, by how much a gram is shifted to its bit)."""
    n = probes.count()
    bits = min(FILTER_BITS, 1 << max(20, (32 * n).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    at = F.shiftrightunsigned("gram", shift)
    marks = probes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # FILTER_BITS at most
    words = np.zeros(bits >> 6, np.uint64)
    words[marks["word"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    return probes.sparkSession.sparkContext.broadcast(words), shift


def _grams(width: int, probes: int | None, words=None, shift: int = 0):
    """(key, text) -> key, gram: hashes of the text's runs of ``width`` bytes, some evenly spread, or all distinct ones that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
                n, gram = len(raw) - width + 1, np.uint64(0)
                for j in range(width):
                    gram = gram * np.uint64(0x9E3779B97F4A7C15) + raw[j : j + n] + np.uint64(1)
                if probes is not None:
                    gram = gram[np.linspace(0, n - 1, probes).astype(np.int64)]
                if words is not None:
                    at = gram >> np.uint64(shift)
                    gram = gram[(words.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                gram = np.unique(gram).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), key, np.int64)), pa.array(gram)], names=[batch.schema.names[0], "gram"])

    return run


def leaks(published: DataFrame, column: str, corpus: DataFrame, text: str = "body", least: int = 10) -> DataFrame:
    """The distinct published strings that hold a source text of at least ``least`` characters, both of any number.

    A string that holds a text holds all its grams of so many bytes. A text is looked up by up to PROBES of its
    grams, evenly spread: if one is in no published string it is done with, else it meets the strings
    that hold the rarest of them, and is searched for there. Of the strings' grams only those that some text is
    looked up by are kept, by a filter, so what is written grows with the hits and not with every byte.
    """
    width = max(least, 1)
    values = written(published.select(F.col(column).alias("s")).where(F.length("s") >= width).distinct().withColumn("value", F.monotonically_increasing_id()))
    texts = written(corpus.select(F.col(text).alias("t")).where(F.length("t") >= width).distinct().withColumn("source", F.monotonically_increasing_id()))
    probes = written(texts.select("source", "t").mapInArrow(_grams(width, PROBES), "source bigint, gram bigint"))
    held = written(values.select("value", "s").mapInArrow(_grams(width, None, *_filter(probes)), "value bigint, gram bigint"))
    counts = probes.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rarest = counts.groupBy("source").agg(F.min_by("gram", F.col("n")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all_held")).where("all_held")
    met = rarest.join(held, "gram").select("source", "value").join(texts, "source").join(values, "value")
    return met.where(F.contains("s", "t")).select("s").distinct()


def leak_count(published: DataFrame, column: str, corpus: DataFrame, text: str = "body", least: int = 10) -> DataFrame:
    """How many distinct published strings hold a source text."""
    return leaks(published, column, corpus, text, least).agg(F.count(F.lit(1)).alias("leaks"))


def export_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").json(path)
