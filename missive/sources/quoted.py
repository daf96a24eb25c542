"""Delimited text whose quoted cells may hold line ends, read in parts of each file.

Spark hands out a file's lines by byte ranges. Whether a line begins a record depends on the number of
quotes before it: each range is summed up first (its quotes modulo two, and the records that begin in it for either
state at its start), prefix sums over the ranges of a file give each range its state and its first
record's number, and a second scan puts the lines of each record together. Only records that go on beyond a
range are grouped; all others are whole within a task.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.sources.scratch import written

#: Ranges whose states may be sent to every task; beyond that they are joined.
BROADCAST_RANGES = 100_000
PLACE = "file string, block bigint"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its range begins), value: in the order of the file within a task."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each range in a batch."""
    file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield (batch.column(0)[a].as_py(), int(block[a])), batch.slice(a, b - a)


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, odd, begun0, begun1 of each range: the records that begin in it, by its state at the start."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for place, part in runs(batch):
            quotes = _quotes(part.column(2))
            sums = found.setdefault(place, [0, 0, 0])
            before = (np.cumsum(quotes) - quotes + sums[0]) % 2
            sums[0] = (sums[0] + int(quotes.sum())) % 2
            sums[1] += int((before == 0).sum())
            sums[2] += int((before == 1).sum())
    rows = [{"file": f, "block": b, "odd": s[0], "begun0": s[1], "begun1": s[2]} for (f, b), s in found.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("begun0", pa.int64()), ("begun1", pa.int64())]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, value, state, first) -> file, record, block, whole, text: the records of each range, its first and last maybe in part."""
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
    place, odd, number, held, begun_here = None, 0, 0, [], False

    def row(whole: bool) -> dict:
        return {"file": place[0], "record": number, "block": place[1], "whole": whole and begun_here, "text": "\n".join(held)}

    for batch in batches:
        out = []
        for now, part in runs(batch):
            if now != place:
                if held:
                    out.append(row(odd == 0))
                place, odd, number, held, begun_here = now, part.column(3)[0].as_py(), part.column(4)[0].as_py() - 1, [], False
            for value, quotes in zip(part.column(2).to_pylist(), _quotes(part.column(2)).tolist()):
                if odd == 0:
                    if held:
                        out.append(row(True))
                    number, held, begun_here = number + 1, [], True
                held.append(value)
                odd = (odd + quotes) % 2
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([row(odd == 0)], schema=schema)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (its number in the file), text: the records of delimited files, blank lines too."""
    sums = lines(spark, path).mapInArrow(_summed, f"{PLACE}, odd bigint, begun0 bigint, begun1 bigint").groupBy("file", "block")
    sums = written(sums.agg(F.sum("odd").alias("odd"), F.sum("begun0").alias("begun0"), F.sum("begun1").alias("begun1")))  # one row each: a range is one task's
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the ranges of one file
    states = sums.withColumn("state", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2)
    states = states.withColumn("begun", F.when(F.col("state") == 0, F.col("begun0")).otherwise(F.col("begun1")))
    states = written(states.select("file", "block", "state", F.coalesce(F.sum("begun").over(ahead), F.lit(0)).alias("first")))
    text = lines(spark, path)
    if states.count() <= BROADCAST_RANGES:
        text = text.join(F.broadcast(states), ["file", "block"])
    else:
        text = text.withColumn("at", F.monotonically_increasing_id()).join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    parts = written(text.select("file", "block", "value", "state", "first").mapInArrow(_joined, "file string, record bigint, block bigint, whole boolean, text string"))
    pieces = parts.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))  # the parts of one record
    return parts.where("whole").select("file", "record", "text").unionByName(pieces.select("file", "record", F.array_join("p.text", "\n").alias("text")))


def read_quoted(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, by the first file's header; every file's first record is its header, and a byte-order mark before it goes."""
    rows = written(records(spark, path).withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''"))
    heads = rows.groupBy("file").agg(F.min("record").alias("record"))
    top = rows.join(heads, ["file", "record"]).orderBy("file").limit(1).select(F.regexp_replace("text", "^\\x{FEFF}", "").alias("text")).first()
    if top is None:
        return spark.createDataFrame([], "_c0 string")
    names = [n.removeprefix("\ufeff") or f"_c{k}" for k, n in enumerate(next(csv.reader(io.StringIO(top["text"], newline=""), delimiter=sep)))]
    cells = ", ".join(f"c{k} string" for k in range(len(names)))
    options = {"sep": sep, "escape": '"', "quote": '"', "multiLine": "true"}
    body = rows.join(heads.withColumnRenamed("record", "top"), "file").where("record > top")
    return body.select(F.from_csv("text", cells, options).alias("r")).select("r.*").toDF(*names)
