"""SimHash near-duplicates by pigeonhole blocks.

A document's 64-bit fingerprint has a bit set where more than half of its shingles' XXH64
hashes do. Of b blocks of bits, fingerprints within 4 bits agree in at least b - 4, so every
close pair meets in one of the buckets keyed by b - 4 blocks; b grows with the number of
distinct fingerprints so that buckets stay small. Members of a bucket are linked by a
search that removes whom it has reached: a bucket gives a spanning forest, not its pairs.

Only distinct fingerprints take part, so copies cost nothing. Buckets over a cap are dealt
out as pairs of chunks. Defined results: a null, empty or blank text has fingerprint zero
and links like others; fewer words than a shingle make one shingle; a null doc_id never is a
component's id unless all its ids are null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.buckets import dealt, groups, spread_join
from missive.llm.common import discard, fresh, prepare, row_key, table, written
from missive.llm.components import connected_components

SHINGLE, DISTANCE, XXH_SEED = 4, 4, 42
#: Members of a bucket that are compared in one task.
BUCKET_CAP = 20_000
#: Groups up to this size are compared by shifts of the sorted rows.
SMALL = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], XXH_SEED) for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint")


def block_count(n: int, distance: int = DISTANCE) -> int:
    """Blocks so that a key of all but ``distance`` of them has about as many values as there are fingerprints."""
    blocks = distance + 2
    while 64 * (blocks - distance) // blocks < n.bit_length() - 1 and blocks < 2 * distance:
        blocks += 1
    return blocks


def block_keys(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """table, key, fp: one row per choice of blocks that may agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.table", "k.key", "fp")


def spanning_edges(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps."""
    todo, out_a, out_b = fps.copy(), [], []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            some, front = front[:64], front[64:]
            near = np.bitwise_count(some[:, None] ^ todo[None, :]) <= distance
            hit = near.any(axis=0)
            if hit.any():
                out_a.append(todo[hit])
                out_b.append(some[near[:, hit].argmax(axis=0)])
                front = np.concatenate([front, todo[hit]])
                todo = todo[~hit]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (fps[:0], fps[:0])


def _linked(distance: int):
    def handle(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = t.column("fp").to_numpy().view(np.uint64)
        ends = np.append(starts[1:], len(fps))
        sizes = ends - starts
        last = np.repeat(np.where(sizes <= SMALL, ends, 0), sizes)
        where = np.arange(len(fps))
        pairs = []
        for shift in range(1, SMALL):
            i = where[:-shift][where[:-shift] + shift < last[:-shift]]
            i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= distance]
            pairs.append((fps[i], fps[i + shift]))
        pairs += [spanning_edges(fps[a:b], distance) for a, b in zip(starts[sizes > SMALL], ends[sizes > SMALL])]
        a, b = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return lambda batches: groups(batches, handle)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within ``distance`` bits."""
    distinct = written(fps.select("fp").distinct(), "simhash-distinct", n=F.count(F.lit(1)))
    keyed = block_keys(distinct, block_count(distinct.metrics["n"], distance), distance)
    return dealt(keyed, "fp", BUCKET_CAP).select("table", "key", "i", "j", "fp").mapInArrow(_linked(distance), "a bigint, b bigint")


def _rooted(least: DataFrame, distance: int) -> DataFrame:
    """``least`` (one row per fp) with root: the same for all fps of a component, null without links."""
    roots = connected_components(links(least, distance))
    return written(least.join(roots, least["fp"] == roots["node"], "left").select(*least.columns, "root"), "simhash-roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over links."""
    fps = written(fingerprints(docs, shingle), "simhash")
    rooted = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), distance)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    ids = spread_join(rooted, least, "root", "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the group's least doc_id.

    Ids may be null or repeated: nulls come last, and of several rows of an id that with the
    least key stays. Rows that are equal throughout share a key; only where a chosen row has
    such copies are rows compared by key once more.
    """
    prepare(docs.sparkSession)
    key, n = fresh(docs, "key", "n_same")
    keyed = docs.withColumn(key, row_key(docs))
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col(key).alias("key"))
    rows = keyed.select(order.alias("row"), "text").mapInArrow(_fingerprints(shingle), "row struct<null: boolean, doc_id: bigint, key: binary>, fp bigint")
    fps = written(rows, "simhash")
    same = fps.groupBy("fp", "row").agg(F.count(F.lit(1)).alias("n"))
    rooted = _rooted(same.groupBy("fp").agg(F.min(F.struct("row", "n")).alias("first")), distance)
    linked = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("first"))
    chosen = linked.select("first").union(rooted.where("root is null").select("first"))
    chosen = written(chosen.select(F.col("first.row.key").alias(key), F.col("first.n").alias(n)), "simhash-chosen")
    discard(fps, rooted)
    # the chosen keys are hashed, so the texts need no sort
    kept = keyed.join(chosen.hint("shuffle_hash"), key)
    copies = kept.where(F.col(n) > 1).dropDuplicates([key])
    return kept.where(F.col(n) == 1).unionByName(copies).select(*[f"`{c}`" for c in docs.columns])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
