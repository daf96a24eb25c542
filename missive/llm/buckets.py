"""Comparing the members of hash buckets, with hot buckets dealt out in bounded parts.

A bucket of more than ``cap`` members is split by a hash into g chunks, and every pair of
chunks (also a chunk with itself) becomes a group of its own. All pairs of members still
meet, in tasks of bounded size, and no pair is emitted here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import written


#: Hot buckets that may be broadcast (table, key and count of each).
BROADCAST_BUCKETS = 100_000
#: Parts of a hot key in ``spread_join``.
PARTS = 16


def spread_join(big: DataFrame, small: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """big joined with small, which has one row for each value of ``on`` and far fewer rows.

    A value that most of big has is dealt out by a hash of ``by`` over PARTS tasks. The repeated rows are
    never broadcast: Spark sizes them by what they are exploded from, a sixteenth of them.
    """
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")
    repeated = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return big.withColumn("__part", part).join(repeated.hint("merge"), [on, "__part"], how).drop("__part")


def dealt(rows: DataFrame, by: str, cap: int) -> DataFrame:
    """rows (table, key, ...) with chunk, i, j, partitioned and sorted by table, key, i, j.

    Hot buckets are few, at most one in cap rows: they are broadcast up to BROADCAST_BUCKETS, else joined.
    """
    hot = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > cap)
    hot = written(hot, "hot-buckets", n=F.count(F.lit(1)))
    if hot.metrics["n"] <= BROADCAST_BUCKETS:
        hot = F.broadcast(hot)
    parts = F.coalesce(F.ceil(F.col("__n") / cap), F.lit(1)).cast("int")
    out = rows.join(hot, ["table", "key"], "left").withColumn("__g", parts).withColumn("chunk", F.pmod(F.xxhash64(by), "__g").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__g") - 1), lambda x: F.struct(F.least("chunk", x).alias("i"), F.greatest("chunk", x).alias("j")))
    # a member of an ordinary bucket has the one group (0, 0); only the others are multiplied
    out = out.withColumn("__p", F.explode(pairs)).select(*rows.columns, "chunk", F.col("__p.i").alias("i"), F.col("__p.j").alias("j"))
    return out.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")


def groups(batches: Iterator[pa.RecordBatch], handle: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Calls handle(table, starts) on runs of whole groups of about so many rows."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts_of(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for name in ("table", "key", "i", "j"):
            v = t.column(name).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts, n = starts_of(t), 0
        if len(starts) > 1:
            yield from handle(t.slice(0, starts[-1]), starts[:-1])
        held = t.slice(starts[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            yield from handle(t, starts_of(t))
