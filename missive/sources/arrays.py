"""JSON arrays of records, read in parts of each file.

Spark hands out pieces of a file that end in a closing brace, by byte ranges. Whether a character stands in a
string depends on all quotes before it, and whether it parts two records on the depth before it. A first scan sums
up each range for either state at its start (quotes modulo two, change of depth), prefix sums over a file's ranges
give each range its state and depth, a second scan counts the records that begin in it, and a third cuts them
out. Only records that go on beyond a range are grouped; all others are whole within a task.

A file whose strings or brackets don't close at its end is known before the third scan, and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.sources.quoted import BROADCAST_RANGES, runs
from missive.sources.scratch import written

#: Bytes of a file's beginning that tell its shape.
HEAD = 200
QUOTE, SLASH, COMMA, OPEN, CLOSE = 34, 92, 44, 91, 93
DEPTH = np.zeros(256, np.int8)
DEPTH[[123, 91]], DEPTH[[125, 93]] = 1, -1


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, size, value: text up to each closing brace, without it, in the order of the file within a task."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _bytes(values: pa.Array) -> np.ndarray:
    """The pieces, each with its brace."""
    return np.frombuffer(b"}".join(values.to_pylist()) + b"}", np.uint8)


def _in_strings(b: np.ndarray, state: int) -> np.ndarray:
    """Does each byte stand behind an odd number of quotes? A quote after an odd number of backslashes is none."""
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != SLASH, at, -1))
    run = np.concatenate([[0], (at - plain)[:-1]])
    quotes = (b == QUOTE) & (run % 2 == 0)
    return (np.cumsum(quotes) - quotes + state) % 2 == 1, quotes


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], dict] = {}
    for batch in batches:
        for place, part in runs(batch):
            s = found.setdefault(place, {"file": place[0], "block": place[1], "size": part.column(2)[0].as_py(), "odd": 0, "depth0": 0, "depth1": 0, "nbytes": 0, "head": ""})
            b = _bytes(part.column(3))
            inside, quotes = _in_strings(b, s["odd"])
            steps = DEPTH[b].astype(np.int64)
            s["depth0"] += int(steps[~inside].sum())
            s["depth1"] += int(steps[inside].sum())
            s["odd"] = (s["odd"] + int(quotes.sum())) % 2
            s["nbytes"] += len(b)
            if place[1] == 0 and len(s["head"]) < HEAD:
                s["head"] = (s["head"] + b[:HEAD].tobytes().decode(errors="ignore"))[:HEAD]
    yield pa.RecordBatch.from_pylist(list(found.values()), schema=pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("odd", pa.int64()), ("depth0", pa.int64()), ("depth1", pa.int64()), ("nbytes", pa.int64()), ("head", pa.string())]))


class Cutter:
    """Walks a range: where records are parted, and whether the list has ended."""

    def __init__(self, state: int, depth: int, base: int, open_: bool, ended: bool):
        self.state, self.depth, self.base, self.open, self.ended = state, depth, base, open_, ended

    def cuts(self, b: np.ndarray) -> tuple[np.ndarray, int]:
        """Places of the bytes that begin a record after them, and that of the list's end (the length if it isn't there)."""
        inside, quotes = _in_strings(b, self.state)
        steps = np.where(inside, 0, DEPTH[b]).astype(np.int64)
        depth = self.depth + np.cumsum(steps)
        self.state, self.depth = (self.state + int(quotes.sum())) % 2, int(depth[-1])
        if self.ended:
            return np.zeros(0, np.int64), 0
        parts = ~inside & (((b == COMMA) & (depth == self.base)) | ((b == OPEN) & (depth == self.base)))
        if not self.open:
            first = np.flatnonzero(~inside & (b == OPEN) & (depth == self.base))
            if not len(first):
                return np.zeros(0, np.int64), len(b)
            parts[: first[0]] = False
            self.open = True
        ends = np.flatnonzero(~inside & (b == CLOSE) & (depth == self.base - 1))
        end = int(ends[0]) if len(ends) else len(b)
        self.ended = bool(len(ends))
        cut = np.flatnonzero(parts)
        return cut[cut < end], end



def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, begun, ended: records that begin in a range, if no list has ended before it."""
    cutters, found = {}, {}
    for batch in batches:
        for place, part in runs(batch):
            if place not in cutters:
                cutters[place] = Cutter(*(part.column(k)[0].as_py() for k in (4, 5, 6)), open_=place[1] > 0, ended=False)
                found[place] = [0, False]
            cut, _ = cutters[place].cuts(_bytes(part.column(3)))
            found[place][0] += len(cut)
            found[place][1] = cutters[place].ended
    rows = [{"file": f, "block": b, "begun": n, "ended": e} for (f, b), (n, e) in found.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("begun", pa.int64()), ("ended", pa.bool_())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, record, block, whole, text: the records of each range, its first and last maybe in part."""
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary())])
    place, cutter, number, held, here = None, None, 0, [], False

    def row(whole: bool) -> dict:
        return {"file": place[0], "record": number, "block": place[1], "whole": whole and here, "text": b"".join(held)}

    for batch in batches:
        out = []
        for now, part in runs(batch):
            if now != place:
                if held:
                    out.append(row(False))
                state, depth, base, first, ended = (part.column(k)[0].as_py() for k in (4, 5, 6, 7, 8))
                place, cutter, number, held, here = now, Cutter(state, depth, base, now[1] > 0, ended), first - 1, [], False
            b = _bytes(part.column(3))
            was_open, was_ended = cutter.open, cutter.ended
            cut, end = cutter.cuts(b)
            if was_ended:
                continue
            at = 0
            for c in cut.tolist():
                if was_open or here:
                    held.append(b[at:c].tobytes())
                    out.append(row(True))
                number, held, here, at = number + 1, [], True, c + 1
            if cutter.open:
                held.append(b[at:end].tobytes())
            if cutter.ended:
                out.append(row(True))
                held = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([row(False)], schema=schema)


def _with(text: DataFrame, states: DataFrame) -> DataFrame:
    """text with its range's state, in the order of the file."""
    if states.count() <= BROADCAST_RANGES:
        return text.join(F.broadcast(states), ["file", "block"])
    text = text.withColumn("at", F.monotonically_increasing_id()).join(states, ["file", "block"])
    return text.repartition("file", "block").sortWithinPartitions("file", "block", "at").drop("at")


def shapes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, state, depth, base, balanced: of each range; base is the depth of the file's records, 0 if it is no list."""
    sums = pieces(spark, path).mapInArrow(_summed, "file string, block bigint, size bigint, odd bigint, depth0 bigint, depth1 bigint, nbytes bigint, head string")
    sums = written(sums)
    whole = Window.partitionBy("file")  # the ranges of one file
    ahead = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("state", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2)
    rows = rows.withColumn("change", F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1")))
    # a brace was added after the last piece: one too many unless the file ends in one; Spark may have left out a mark of three bytes
    added = (F.sum("nbytes").over(whole) - F.col("size")).isin(1, -2).cast("int")
    closed = (F.sum("odd").over(whole) % 2 == 0) & (F.sum("change").over(whole) + added == 0)
    head = F.regexp_replace(F.first("head").over(whole.orderBy("block")), "^\\x{FEFF}", "")
    base = F.when(head.rlike(r"^\s*\["), 1).when(head.rlike(r'^\s*\{\s*"templates"\s*:\s*\['), 2).otherwise(0)
    return rows.select("file", "block", "state", F.coalesce(F.sum("change").over(ahead), F.lit(0)).alias("depth"), base.alias("base"), closed.alias("balanced"))


def elements(spark: SparkSession, path: str | list[str], shape: DataFrame) -> DataFrame:
    """file, record (its number), text: the elements of the lists in files of base 1 or 2; shape as ``shapes`` gives it."""
    states = written(shape.where("base > 0 and balanced").select("file", "block", "state", "depth", "base"))
    columns = ["file", "block", "size", "value", "state", "depth", "base"]
    counted = _with(pieces(spark, path), states).select(columns).mapInArrow(_counted, "file string, block bigint, begun bigint, ended boolean")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbers = states.join(written(counted), ["file", "block"]).select(
        "file", "block", "state", "depth", "base", F.coalesce(F.sum("begun").over(ahead), F.lit(0)).alias("first"), F.coalesce(F.bool_or("ended").over(ahead), F.lit(False)).alias("over"))
    cut = _with(pieces(spark, path), written(numbers)).select(*columns, "first", "over")
    parts = written(cut.mapInArrow(_cut, "file string, record bigint, block bigint, whole boolean, text binary"))
    joined = parts.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", F.base64("text").alias("text")))).alias("p"))  # the parts of one record
    # ranges are cut after braces, never inside a character
    text = F.array_join(F.transform("p", lambda x: F.decode(F.unbase64(x["text"]), "UTF-8")), "")
    return parts.where("whole").select("file", "record", F.decode("text", "UTF-8").alias("text")).unionByName(joined.select("file", "record", text.alias("text")))
