"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. A source's target is first met by whole
rounds of all its documents; the remaining budget is spread over the sizes in proportion,
and what rounding leaves is fitted by a bounded-knapsack dynamic program over the sizes
still available. So many documents of each size are then taken by the order of a seeded
hash of their ids.

Only (source, size, count) rows meet in one task: at most one per distinct size. A group of
equal source and size is ranked in parts by ranges of the hash, so no task holds a whole hot
group. A document's hash is that of its whole row, so the order is the same in every run; the
last hash that is taken of a group decides about the texts themselves, which never shuffle.
Defined results: null texts have size 0 and take 0; a null source is a source, last; null or
repeated doc_ids are rows like others; rows equal throughout are interchangeable; an empty table
gives no rows; other columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.llm.common import fresh, prepare, row_key, table, written

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 42
#: Budget left to the dynamic program at most.
DP_BUDGET = 1 << 15
#: Documents of one source and size that are ranked together.
RANK_GROUP = 4096
#: Rows of the plan (one for each source and size) that may be broadcast.
BROADCAST_SIZES = 200_000


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def knapsack(sizes: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each size to take so that their sum is as near to budget as can be (ties: below).

    The set of reachable sums is a bitset; counts are split into powers of two.
    """
    if budget <= 0:
        return {}
    mask = (1 << (2 * budget + 1)) - 1
    reach, layers = 1, []
    for size, count in sorted(zip(sizes, counts), reverse=True):
        if size <= 0 or size > 2 * budget:
            continue
        step = 1
        while count and not reach >> budget & 1:
            n = min(step, count)
            layers.append((size, n, reach))
            reach |= (reach << (size * n)) & mask
            count, step = count - n, step * 2
        if reach >> budget & 1:
            break
    low = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    best = budget + (above & -above).bit_length() if above and (above & -above).bit_length() < budget - low else low
    taken: dict[int, int] = {}
    for size, n, before in reversed(layers):
        if not before >> best & 1:
            best -= size * n
            taken[size] = taken.get(size, 0) + n
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each size to take, each at most once, for a sum near budget."""
    take = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= DP_BUDGET:
            break
        n = min(int(counts[i] - take[i]), max(0, (left - DP_BUDGET // 2) // max(1, int(sizes[i])))) if sizes[i] > 0 else 0
        take[i] += n
        left -= n * int(sizes[i])
    extra = knapsack([int(s) for s in sizes], [int(c) for c in counts - take], left)
    return take + np.array([extra.get(int(s), 0) for s in sizes], dtype=np.int64)


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source_key, source_size -> and target: share of all sizes by weight, at most cap times the size.

    One row per source is all that its windows see. With sources in order of cap/weight, the
    level at which the excess of the capped ones is reshared is closed form.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("budget", share * F.sum("source_size").over(everything)).withColumn("top", cap * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("top") / F.col("w"))
    order = Window.orderBy("ratio", "source_key")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    ranked = ranked.withColumn("fair", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return ranked.select("source_key", "source_size", F.least("top", F.coalesce(F.col("fair") * F.col("w"), F.col("top"))).alias("target"))


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    source_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    base = int(target // source_size) if source_size else 1
    extra = fit(sizes, counts, int(round(target - base * source_size)))
    return group.assign(base=np.int64(base), extra=extra)[["source_key", "size", "n", "source_size", "target", "base", "extra"]]


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))


def _fitted(sized: DataFrame, weights, share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Of sized (source_key, size, order): the plan by source and size, and the ranks where part of a group is taken."""
    counts = sized.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    schema = "source_key string, size bigint, n bigint, source_size bigint, target double, base bigint, extra bigint"
    plan = written(counts.join(targets, "source_key").groupBy("source_key").applyInPandas(_plan, schema), "mixing-plan", n=F.count(F.lit(1)))
    rows = sized.join(plan.where("extra > 0 and extra < n"), ["source_key", "size"])
    first = F.conv(F.hex(F.substring("order", 1, 4)), 16, 10).cast("long")  # 32 bits, in the order of the whole
    rows = rows.withColumn("part", F.shiftright(first * (F.lit(1) + F.floor(F.col("n") / RANK_GROUP)), 32))
    parts = rows.groupBy("source_key", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    ahead = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_key", "size", "part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("source_key", "size", "part").orderBy("order"))
    return plan, rows.join(parts, ["source_key", "size", "part"]).withColumn("rank", F.col("ahead") + rank)


def _joined(rows: DataFrame, plan: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their plan, which has a row for each source and size and is broadcast up to BROADCAST_SIZES of them."""
    return rows.join(F.broadcast(plan) if plan.metrics["n"] <= BROADCAST_SIZES else plan, on)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of docs.

    The texts are read once, for their sizes and hashes; later shuffles carry ids and numbers only.
    """
    prepare(docs.sparkSession)
    sized = docs.select("doc_id", "source", _source_key().alias("source_key"), word_count().alias("size"), row_key(docs, seed).alias("order"))
    sized = written(sized, "mixing-sizes")
    plan, ranked = _fitted(sized, weights, share, cap)
    settled = _joined(sized, plan, ["source_key", "size"]).where("extra = 0 or extra = n").withColumn("copies", F.col("base") + (F.col("extra") > 0).cast("long"))
    ranked = ranked.withColumn("copies", F.col("base") + (F.col("rank") <= F.col("extra")).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return settled.select(columns).unionByName(ranked.select(columns)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of docs.

    Of a group of which a part is taken, the hash of the last one taken is the cut. Only rows
    of that very hash, copies of one row, are counted among themselves.
    """
    prepare(docs.sparkSession)
    sized = written(docs.select(_source_key().alias("source_key"), word_count().alias("size"), row_key(docs, seed).alias("order")), "mixing-sizes")
    plan, ranked = _fitted(sized, weights, share, cap)
    cuts = ranked.where("rank = extra").select("source_key", "size", F.col("order").alias("cut"))
    same = ranked.join(cuts, ["source_key", "size"]).where("order = cut").groupBy("source_key", "size")
    cuts = same.agg(F.first("cut").alias("cut"), F.count(F.lit(1)).alias("n_cut"), F.sum((F.col("rank") <= F.col("extra")).cast("long")).alias("taken_cut"))
    k, z, o, decided = fresh(docs, "source_key", "size_", "order_", "plan_")
    plan_of = plan.join(cuts, ["source_key", "size"], "left").select(F.col("source_key").alias(k), F.col("size").alias(z), F.struct("n", "base", "extra", "cut", "n_cut", "taken_cut").alias(decided))
    plan_of = written(plan_of, "mixing-cuts", n=F.count(F.lit(1)))
    rows = docs.withColumns({k: _source_key(), z: word_count(), o: row_key(docs, seed)})
    rows = _joined(rows, plan_of, [k, z])
    p = lambda name: F.col(f"{decided}.{name}")
    at_cut = p("cut").isNotNull() & (F.col(o) == p("cut"))
    below = F.when(p("cut").isNull(), p("extra") > 0).otherwise(F.col(o) < p("cut"))
    columns = [f"`{c}`" for c in docs.columns]
    times = lambda frame, n: frame.withColumn(o, F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*columns)
    plain = rows.where(~at_cut).withColumn(z, p("base") + below.cast("long")).where(F.col(z) > 0)
    copies = rows.where(at_cut).dropDuplicates([k, z, o])
    copies = copies.withColumn(z, p("base") * p("n_cut") + p("taken_cut")).where(F.col(z) > 0)
    return times(plain, F.col(z)).unionByName(times(copies, F.col(z)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
