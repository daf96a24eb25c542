"""Exact nearest neighbours of dense vectors, by an inverted file whose lists are left out by triangle bounds.

Centres come from a bounded sample of the corpus (SAMPLE rows, at most CENTRES centres), so they shape only
the work, never the result. A corpus vector lies in the list of its nearest centre. By the triangle
inequality of angles, a vector of a list is no nearer to a query than the query's angle to the centre less
the list's greatest angle. Each query first visits its FIRST most promising lists; its k-th best score
there then rules out all lists whose bound is lower, and of the others all vectors that score lower. Lists are
files in the shared folder, opened through pyarrow by its URI (any store that it can open on all executors).
A task has queries of neighbouring lists, BLOCK at a time, reads the lists that any of them visits in parts
of CELL rows, and keeps their k best. So pairs may be all there are, but only rows and results are written
or shuffled, in proportion to their number, and a task holds a block and a part at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.sources.scratch import folder, written

SAMPLE, CENTRES, CELL, FIRST = 20_000, 1024, 4096, 3
#: Scores are rounded to so many places, and bounds are loosened by as much.
PLACES, SLACK = 6, 2e-6
#: Queries whose visits or products are worked out at once, and queries that a task holds while it reads their lists.
STEP, BLOCK = 128, 8192


def _units(name: str):
    """(name, vector) -> name, unit: the bytes of the vector at length 1; a zero vector stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            units = [u.tobytes() for u in x / np.where(norm == 0, 1.0, norm)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], names=[name, "unit"])

    return run


def unit_rows(df: DataFrame, name: str) -> DataFrame:
    kind = dict(df.dtypes)[name]
    return df.where(F.col("vector").isNotNull()).select(name, "vector").mapInArrow(_units(name), f"{name} {kind}, unit binary")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def centres_of(corpus: DataFrame, n: int) -> np.ndarray:
    """Centres of unit length, by a few rounds over a sample of bounded size."""
    wanted = min(CENTRES, max(1, math.ceil(n / CELL)))
    sample = corpus.orderBy(F.xxhash64("match", "unit")).limit(min(SAMPLE, 64 * wanted)).select("unit").collect()
    x = np.stack([np.frombuffer(r["unit"]) for r in sample])
    centres = x[:wanted].copy()
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            mean = x[near == c].sum(axis=0)
            if np.linalg.norm(mean) > 1e-9:
                centres[c] = mean / np.linalg.norm(mean)
    return centres


def _listed(centres: np.ndarray, name: str):
    """(name, unit) -> name, unit, cell, angle; zero vectors have a list of their own, the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            s = np.clip(x @ centres.T, -1, 1)
            cell = s.argmax(axis=1)
            angle = np.arccos(s[np.arange(len(s)), cell])
            zero = ~x.any(axis=1)
            cell[zero], angle[zero] = len(centres), 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[name, "unit", "cell", "angle"])

    return run


class Lists:
    """The lists' centres, sizes and greatest angles: at most CENTRES + 1 of them."""

    def __init__(self, centres: np.ndarray, sizes: np.ndarray, reach: np.ndarray):
        self.centres, self.sizes, self.reach = centres, sizes, reach

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """queries x lists: no vector of the list has a higher cosine; empty lists have -2."""
        angle = np.arccos(np.clip(x @ self.centres.T, -1, 1))
        out = np.cos(np.maximum(0, angle - self.reach[:-1]))
        out[~x.any(axis=1)] = 0.0
        out = np.concatenate([out, np.zeros((len(x), 1))], axis=1)  # zero vectors: cosine 0
        out[:, self.sizes == 0] = -2
        return out

    def visits(self, x: np.ndarray, floor: np.ndarray | None) -> np.ndarray:
        """queries x lists: is the list visited? Without floor, in the first round; else in the second."""
        bounds = self.bounds(x)
        first = np.zeros(bounds.shape, bool)
        order = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
        np.put_along_axis(first, order, True, axis=1)
        first &= bounds > -2
        return first if floor is None else ~first & (bounds > -2) & (bounds >= floor[:, None] - SLACK)

    def stripe(self, k: int, of: int) -> Lists:
        """Every ``of``-th list from the k-th; the others count as empty."""
        return Lists(self.centres, np.where(np.arange(len(self.sizes)) % of == k, self.sizes, 0), self.reach)


def best_of(s: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of each row's k best scores of its floor and more, ties to lower columns.

    Only scores that may be among them are rounded and ordered; of very many equal ones the first are taken out before.
    """
    least = floor if s.shape[1] <= k or (floor > -1).all() else np.fmax(floor, -np.partition(-s, k - 1, axis=1)[:, k - 1])
    row, column = np.nonzero(s >= least[:, None] - 2 * 10.0**-PLACES)
    if len(row) > 16 * k * len(s) and s.shape[1] > k:
        places = np.arange(s.shape[1]) - np.rint(s * 10.0**PLACES).astype(np.int64) * s.shape[1]
        row, column = np.repeat(np.arange(len(s)), k), np.argpartition(places, k - 1, axis=1)[:, :k].ravel()
    score = np.round(s[row, column], PLACES) + 0.0
    keep = score >= floor[row]
    row, column, score = row[keep], column[keep], score[keep]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first], score[first]


class Best:
    """The k best of each query of a block so far; ``floor`` is the k-th best score, -2 before there are k."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k, self.match = x, k, None
        self.score = np.full((len(x), k), -np.inf)
        self.floor = np.full(len(x), -2.0)

    def meet(self, rows: np.ndarray, y: np.ndarray, names: np.ndarray) -> None:
        """These queries and a part of a list, whose names are in order: ties go to the least."""
        found = []
        for a in range(0, len(rows), STEP):
            some = rows[a : a + STEP]
            s = self.x[some] @ y.T
            hit = np.flatnonzero(s.max(axis=1) >= self.floor[some] - 2 * 10.0**-PLACES)
            if len(hit):
                row, column, score = best_of(s[hit], self.k, self.floor[some[hit]])
                found.append((some[hit[row]], names[column], score))
        if not found:
            return
        row, match, score = (np.concatenate(c) for c in zip(*found))
        if self.match is None:
            self.match = np.full(self.score.shape, names[0], names.dtype)
        own, at = np.unique(row, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(own)), self.k), at])
        score, match = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.match[own].ravel(), match])
        order = np.lexsort((np.unique(match, return_inverse=True)[1] if match.dtype == object else match, -score, at))
        order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < self.k]
        self.score[own], self.match[own] = score[order].reshape(-1, self.k), match[order].reshape(-1, self.k)
        self.floor[own] = np.maximum(self.score[own, -1], -2.0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of their stripes, up to BLOCK of one stripe at a time."""
    held, n = [], 0
    for batch in batches:
        stripes = batch.column(batch.schema.get_field_index("stripe")).to_numpy()
        edges = [0, *(np.flatnonzero(stripes[1:] != stripes[:-1]) + 1).tolist(), len(stripes)]
        for a, b in zip(edges, edges[1:]):
            while a < b:
                if held and (n == BLOCK or held[0]["stripe"][0].as_py() != stripes[a]):
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                some = batch.slice(a, min(b - a, BLOCK - n))
                held.append(some)
                a, n = a + some.num_rows, n + some.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _names(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist() + [None], dtype=object)[:-1] if column.null_count else column.to_numpy(zero_copy_only=False)


def _nearest(lists: Lists, path: str, stripes: int, k: int):
    """(id, unit, stripe), in the order of stripes -> id, match, score: the k best of each among its stripe's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, list[str]] = {}
        for block in _blocks(batches):
            if not files:
                fs, root = FileSystem.from_uri(path)
                for f in fs.get_file_info(FileSelector(root, recursive=True)):
                    if f.is_file and f.base_name.endswith(".parquet"):
                        files.setdefault(f.path.split("/")[-2], []).append(f.path)
            own, best = lists.stripe(block["stripe"][0].as_py(), stripes), Best(matrix(block["unit"]), k)
            for second in (False, True):
                seen = np.concatenate([own.visits(best.x[a : a + STEP], best.floor[a : a + STEP] if second else None) for a in range(0, len(best.x), STEP)])
                visitors = seen.sum(axis=0)
                for cell in np.argsort(-visitors, kind="stable")[: np.count_nonzero(visitors)]:
                    rows = np.flatnonzero(seen[:, cell])
                    for file in files[f"cell={cell}"]:
                        with fs.open_input_file(file) as source:
                            for part in pq.ParquetFile(source).iter_batches(batch_size=CELL, columns=["match", "unit"], use_threads=False):
                                names = _names(part.column(0))
                                order = np.argsort(names, kind="stable")
                                best.meet(rows, matrix(part.column(1))[order], names[order])
            if best.match is not None:
                row, place = np.nonzero(best.score > -np.inf)
                found = pa.array(best.match[row, place], part.schema.field("match").type)
                yield from pa.table({"id": block["id"].take(pa.array(row)), "match": found, "score": best.score[row, place]}).to_batches()

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("score"), "match")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """id, match, score, rank: the k most similar corpus rows (id, vector) of each query (id, vector), ids distinct.

    Rows without a vector take no part; a zero vector has cosine 0 with everything.
    """
    spark, rows, asked = corpus.sparkSession, written(unit_rows(corpus.select(F.col("id").alias("match"), "vector"), "match")), unit_rows(queries, "id")
    kind, n = {**dict(rows.dtypes), **dict(asked.dtypes)}, rows.count()
    if not n:
        return spark.createDataFrame([], f"id {kind['id']}, match {kind['match']}, score double, rank int")
    centres, path = centres_of(rows, n), folder(spark)
    schema = f"match {kind['match']}, unit binary, cell int, angle double"
    listed = rows.mapInArrow(_listed(centres, "match"), schema).repartitionByRange(math.ceil(n / (4 * CELL)), "cell", F.xxhash64("match"))
    listed.sortWithinPartitions("cell", "match").write.partitionBy("cell").parquet(path)
    sizes, reach = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres) + 1)
    for r in spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect():  # a row for each list
        sizes[r["cell"]], reach[r["cell"]] = r["n"], r["a"]
    asked = written(asked.mapInArrow(_listed(centres, "id"), f"id {kind['id']}, unit binary, cell int, angle double"))
    # several blocks for each core; where queries are too few for that, several tasks share a block, each with some of the lists
    cores, most = spark.sparkContext.defaultParallelism, asked.count()
    blocks = math.ceil(most / min(BLOCK, max(STEP, math.ceil(most / (4 * cores))))) or 1
    stripes = min(math.ceil(2 * cores / blocks), int((sizes > 0).sum()))
    shared = asked.select("id", "unit", "cell", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    shared = shared.repartitionByRange(blocks * stripes, "stripe", "cell", F.xxhash64("id")).sortWithinPartitions("stripe", "cell")
    found = shared.select("id", "unit", "stripe").mapInArrow(_nearest(Lists(centres, sizes, reach), path, stripes, k), f"id {kind['id']}, match {kind['match']}, score double")
    return _top(found, k)
