"""Structured Streaming: continuous import, scoring and counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from missive.operators.rules import assess, detect_purpose, findings
from missive.operators.serving import load_latest
from missive.sources.sinks import append_new


def record_stream(spark: SparkSession, path: str, schema, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def continuous_import(stream: DataFrame, store: str, checkpoint: str):
    """Every record once, by id, whatever is replayed; runs over what there is and ends."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_by_state(stream: DataFrame, store: str, checkpoint: str, ttl: str = "30 days"):
    """Every record once, by id, without reading the store: ids are state for ``ttl`` after they came.

    A record replayed later than that is imported again; ``continuous_import`` looks at the store instead.
    """
    once = stream.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", ttl).dropDuplicatesWithinWatermark(["id"]).drop("seen_at")
    return once.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def predicted(stream: DataFrame, models: str, out: str, checkpoint: str):
    """Each record's prediction by the model version that was the latest when its batch began.

    A batch has a folder of its own, so one that runs again after a failure replaces what it left.
    """

    def put(batch: DataFrame, number: int) -> None:
        load_latest(batch.sparkSession, models).score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGE, COUNTED = "start bigint, meta_category string, n bigint", "entries binary"
#: Groups of ids that share a state and a call in Python: the ids of some groups would be millions of calls. Fixed for a checkpoint.
GROUPS = 512
#: Stands for a null window in states, and for a null ``ingest_seq``, which is lower than all others.
NONE = -(2**63)
ENTRY = pa.schema([("id", pa.string()), ("seq", pa.int64()), ("start", pa.int64()), ("category", pa.string()), ("seen", pa.int64())])


def _packed(entries: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ENTRY, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write_table(entries)
    return out.getvalue().to_pybytes()


def _newest(old: pa.Table, rows: pa.Table, now: int, ttl: int) -> tuple[pa.Table, pa.Table]:
    """The entries (one for each id) after these rows, and by how much counts change; of equal seqs the first stays.

    Entries of which nothing came since ``now`` less ``ttl`` are left out.
    """
    both, n = pa.concat_tables([old, rows]).combine_chunks(), old.num_rows
    code = pd.factorize(both["id"].to_pandas(), use_na_sentinel=False)[0]  # an old entry's code is its place
    seq, seen = both["seq"].to_numpy(), both["seen"].to_numpy()
    order = np.lexsort((-np.arange(len(code)), seq, code))
    best = order[np.append(code[order][1:] != code[order][:-1], True)]
    latest = np.full(len(best), NONE)
    np.maximum.at(latest, code, seen)
    category = pd.factorize(both["category"].to_pandas(), use_na_sentinel=False)[0]
    start = both["start"].to_numpy()
    was = np.arange(n)
    moved = (start[best[:n]] != start[was]) | (category[best[:n]] != category[was])
    plus, minus = np.append(best[:n][moved], best[n:]), was[moved]
    # one row for each window and category, not one for each id
    places = np.append(plus, minus)
    _, first, of = np.unique(np.stack([start[places], category[places]]), axis=1, return_index=True, return_inverse=True)
    sums = np.bincount(of.ravel(), np.append(np.ones(len(plus)), -np.ones(len(minus))), len(first)).astype(np.int64)
    some = both.take(pa.array(places[first[sums != 0]], pa.int64()))
    changed = pa.table({"start": some["start"], "meta_category": some["category"], "n": sums[sums != 0]})
    kept = both.take(pa.array(best)).set_column(4, "seen", pa.array(latest))
    touched = np.zeros(len(best), bool)
    touched[code[n:]] = True
    return kept.filter(pa.array(touched | (latest + ttl >= now))), changed


def changes(stream: DataFrame, at: str = "created_at", days: int = 30, ttl_days: int = 400) -> DataFrame:
    """start, meta_category, n: by how much each record's newest version changes the counts by window and category.

    What is kept of an id is the version that counts (the highest ingest_seq): a replay changes nothing, a revision
    takes the old version back. Ids of which nothing comes for ``ttl_days`` leave the state, and count anew
    if they ever return. Rows without a valid time have a null window. Ids are dealt by a hash into GROUPS states.
    """
    width, ttl = days * 86400, ttl_days * 86_400_000
    time = F.unix_timestamp(F.try_to_timestamp(F.col(at)))
    start = F.coalesce((F.floor(time / width) * width).cast("bigint"), F.lit(NONE))
    rows = stream.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", "1 hour")
    seen, seq = F.unix_millis("seen_at"), F.coalesce(F.col("ingest_seq").cast("bigint"), F.lit(NONE))
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(GROUPS)).cast("int").alias("group"), F.col("id").cast("string").alias("id"), seq.alias("seq"), start.alias("start"), F.col("meta_category").cast("string").alias("category"), seen.alias("seen"), "seen_at")

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, timed_out = state.getCurrentWatermarkMs(), state.hasTimedOut
        old = pa.ipc.open_stream(bytes(state.get[0])).read_all() if state.exists else ENTRY.empty_table()
        come = [] if timed_out else [pa.Table.from_pandas(rows_[ENTRY.names], ENTRY, preserve_index=False) for rows_ in batches]
        come = pa.concat_tables([ENTRY.empty_table(), *come])
        kept, changed = _newest(old, come.set_column(4, "seen", pa.array(np.maximum(come["seen"].to_numpy(), now), pa.int64())), now, ttl)
        if kept.num_rows:
            state.update((_packed(kept),))
            state.setTimeoutTimestamp(max(int(kept["seen"].to_numpy().min()) + ttl, now + 1))
        elif state.exists:
            state.remove()
        if changed.num_rows:
            yield pd.DataFrame({"start": changed["start"].to_pandas().astype("Int64").replace(NONE, pd.NA), "meta_category": changed["meta_category"].to_pandas(), "n": changed["n"].to_pandas()})

    return rows.groupBy("group").applyInPandasWithState(newest, CHANGE, COUNTED, "append", GroupStateTimeout.EventTimeTimeout)


def counts_of(changed: DataFrame) -> DataFrame:
    """start, meta_category, n: the counts that a log of changes adds up to."""
    return changed.groupBy("start", "meta_category").agg(F.sum("n").alias("n")).where("n <> 0")


def scored(stream: DataFrame) -> DataFrame:
    """Rule readings of each record; no state."""
    purpose = detect_purpose(F.col("body"))
    return stream.select("id", purpose.alias("purpose"), assess(purpose, F.lit(True)).alias("verdict"), F.size(findings()).alias("findings"))


def counters(stream: DataFrame, at: str = "created_at", window: str = "30 days") -> DataFrame:
    """Records by window and category, however late they come; those without a valid time have a null window.

    For update mode. Without a watermark the state holds one row for each window and category there is: few.
    """
    time = F.try_to_timestamp(F.col(at))
    timed = stream.withColumn("__timed", time.isNotNull()).withColumn("__at", F.coalesce(time, F.timestamp_seconds(F.lit(0))))
    counts = timed.groupBy(F.window("__at", window), "__timed", "meta_category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.when(F.col("__timed"), F.col("window")).alias("window"), "meta_category", "n")


def resumable(stream: DataFrame, convert, out: str, checkpoint: str):
    """Converts what is pending and ends; a second run adds nothing."""
    return convert(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
