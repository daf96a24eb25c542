"""Vector codes: product quantization in whole numbers, over lexicographic tries of distinct parts.

Vectors are scaled to whole numbers and cut into PARTS runs of components. All distinct parts and
their counts form one table, dealt out in lexicographic ranges, so a task holds a sorted run: a
trie whose levels are the components. The trie is walked depth-first, STEP leaves at a time; a
node's vector of distances to all entries, summed up to its component, is worked out once for all
leaves below it, and the path to the last leaf stays for the next leaves. A leaf's vector gives
its nearest entry, and the leaf adds its count and count times its part to that entry's sums. Only
those sums (PARTS x ENTRIES rows) leave the tasks and reach the driver, which makes the next
codebooks; these (PARTS x ENTRIES x components) go to every task. At last each task assigns the
vectors it reads over tries of its own parts, so vectors never shuffle.

Defined results: a vector that is null or holds a null, infinite or NaN component is dropped, and
so is one of another length than most (of equally frequent lengths the longer counts); parts differ by
one component where the length isn't a multiple of PARTS; scaled components beyond LIMIT count as LIMIT, so
that no distance overflows; null ids come last in the order of ids, and rows of one id are ordered by
their vectors; fewer than ENTRIES vectors make fewer entries; an empty table gives no rows; columns
other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.buckets import BROADCAST_BUCKETS, spread_join
from missive.llm.common import prepare, range_count, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 24
#: Leaves of a trie that are walked at once; rows that a task gathers for a trie.
STEP, TRIE_ROWS = 1024, 1 << 15


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: the whole-number components of vectors that count."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    whole = F.transform(e, lambda v: F.least(F.lit(LIMIT), F.greatest(F.lit(-LIMIT), F.floor(v.cast("double") * SCALE))).cast("int"))
    return vectors.where(e.isNotNull() & fine).select("vec_id", "label", whole.alias("x"))


def bounds(dim: int) -> list[int]:
    """Where the parts of a vector begin, and its length."""
    return [i * dim // PARTS for i in range(PARTS + 1)]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (of equals the first) and its squared distance, of distinct rows in lexicographic order."""
    n, width = rows.shape
    reach = int(np.abs(rows).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.int32 if width * reach * reach < 1 << 31 else np.int64
    rows, book = rows.astype(kind), book.astype(kind)
    shared = np.zeros(n, np.int64)  # components that a row has in common with the row before
    if n > 1:
        differs = rows[1:] != rows[:-1]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else 0
    codes, distances = np.zeros(n, np.int64), np.zeros(n, np.int64)
    path = np.zeros((width + 1, len(book)), kind)
    for a in range(0, n, STEP):
        some, common = rows[a : a + STEP], shared[a : a + STEP]
        sums, node = path[:1], np.zeros(len(some), np.int64)
        for d in range(width):
            first = common <= d  # the row begins a node at this level; else it is in the row before's
            heads = np.flatnonzero(first)
            gap = some[heads, d][:, None] - book[:, d]
            gap *= gap
            gap += sums[node[heads]]
            if not first[0]:
                gap = np.concatenate([path[d + 1][None], gap])
            sums, node = gap, np.cumsum(first) - int(first[0])
            path[d + 1] = sums[-1]
        best = sums.argmin(axis=1)
        codes[a : a + STEP] = best[node]
        distances[a : a + STEP] = sums[np.arange(len(sums)), best][node]
    return codes, distances


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and the place of each row among them."""
    if not rows.shape[1]:
        return rows[:1], np.zeros(len(rows), np.int64)
    order = np.lexsort(rows.T[::-1])
    by = rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (by[1:] != by[:-1]).any(axis=1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(first) - 1
    return by[first], place


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TRIE_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sums(books: list[np.ndarray]):
    """(part, values, n) -> part, entry, place, total: sums of the task's parts for each entry; place -1 has the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for t in gathered(batches):
            part, n = t.column("part").to_numpy(), t.column("n").to_numpy()
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                rows, place = ordered(matrix(t.column("values").take(pa.array(mine)).combine_chunks(), books[p].shape[1]))
                counts = np.zeros(len(rows), np.int64)
                np.add.at(counts, place, n[mine])
                codes, _ = nearest(rows, books[p])
                np.add.at(totals[p], codes, np.concatenate([counts[:, None], rows * counts[:, None]], axis=1))
        for p, total in enumerate(totals):
            entry, place = np.nonzero(total[:, :1] + np.zeros_like(total))
            if len(entry):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array((place - 1).astype(np.int32)), pa.array(total[entry, place])], names=["part", "entry", "place", "total"])

    return run


def codebooks(rows: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks of all parts (entries x components) after some rounds over the distinct parts of rows (vec_id, x)."""
    spark = rows.sparkSession
    cut = bounds(dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # the entries at the start
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), dim)
    books = [start[:, a:b].copy() for a, b in zip(cut, cut[1:])]
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("x", a + 1, b - a).alias("values")) for p, (a, b) in enumerate(zip(cut, cut[1:]))])
    distinct = rows.select(F.explode(parts).alias("p")).groupBy("p.part", "p.values").agg(F.count(F.lit(1)).alias("n"))
    distinct = written(distinct, "vector-parts", n=F.count(F.lit(1)))
    ranges = range_count(spark, distinct.metrics["n"] * (4 * cut[1] + 16))
    distinct = written(distinct.repartitionByRange(ranges, "part", "values").sortWithinPartitions("part", "values"), "vector-tries")
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books), "part int, entry int, place int, total bigint").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for r in sums.collect():  # as many rows as the codebooks have components
            totals[r["part"]][r["entry"], r["place"] + 1] = r["total"]
        for book, total in zip(books, totals):
            used = total[:, 0] > 0
            book[used] = total[used, 1:] // total[used, :1]
    return books


def _coded(books: list[np.ndarray]):
    cut = np.cumsum([0, *[b.shape[1] for b in books]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            x = matrix(t.column("x").combine_chunks(), int(cut[-1]))
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                rows, place = ordered(x[:, cut[p] : cut[p + 1]])
                code, distance = nearest(rows, book)
                codes[:, p] = code[place]
                error += distance[place]
            named = [c.tobytes().hex() for c in codes]
            for batch in pa.Table.from_arrays([t.column("vec_id"), t.column("label"), pa.array(named, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]).to_batches():
                yield batch

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """vectors (vec_id, embedding, label) -> vec_id, label, code, error, label_error; and the codebooks."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(scaled(vectors), "scaled-vectors")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.where(F.size("x") == dim)
    books = codebooks(rows, dim)
    kinds = dict(rows.dtypes)
    coded = written(rows.mapInArrow(_coded(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "vector-codes")
    named = coded.withColumn("same", F.to_json(F.struct("label")))
    sums = written(named.groupBy("same").agg(F.sum("error").alias("label_error")), "label-errors", n=F.count(F.lit(1)))
    out = named.join(F.broadcast(sums), "same") if sums.metrics["n"] <= BROADCAST_BUCKETS else spread_join(named, sums, "same", "vec_id")
    return out.select("vec_id", "label", "code", "error", "label_error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The codebooks of each round after the last, then the codes; floors go down for negative sums too."""
    near = """near{r} AS MATERIALIZED (
    SELECT vec_id, label, p, any_value(x) AS x, min((list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k)) AS best
    FROM parts JOIN book{r} USING (p) GROUP BY vec_id, label, p
)"""
    book = """sum{r} AS (
    SELECT p, best[2] AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL
),
book{n} AS MATERIALIZED (
    SELECT p, k, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{r} GROUP BY p, k) m USING (p, k)
)"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(r=r), book.format(r=r, n=r + 1)]
    steps.append(near.format(r=ROUNDS))
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) AS r(p)
),
book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM parts QUALIFY k < {ENTRIES}
),
{(',' + chr(10)).join(steps)},
coded AS (
    SELECT vec_id, label, string_agg(lower(printf('%02x', best[2])), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""


OP13_SQL = _sql()
