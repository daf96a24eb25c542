"""Near-duplicate vectors by randomised-rotation binary codes (RaBitQ, Gao and Long 2024).

A unit vector o is rotated by a random orthogonal matrix and stored as the signs of its
components, the code o', with the correction factor c = <o', o>. For a query q, <o', q> / c
estimates <o, q> without bias; its error is about sqrt((1 - c^2) / (d - 1)) / c times a standard
normal. As in the paper, q is stored too, with four bits a component. Pairs whose estimate lies
more than CONFIDENCE such errors below the threshold, in either direction, are left out. So are
pairs whose inner product of four-bit components, in that rotation too, lies as far below it:
rounding by steps of w has an error of w / sqrt(12), about 0.017 for a pair of 64 dimensions where
the codes' is 0.09. All others are recomputed exactly in double precision from the vectors, which
only rows with such a pair fetch. Codes, factors, four-bit components and the keys of earlier tables are what moves
through the hash tables: for 64 dimensions 52 bytes, and at most three more for each table before.

Candidate pairs come from the codes too: runs of code bits of several rotations are the keys
of hash tables, so many that a pair at the threshold shares a key with probability RECALL or
more, by the sign-flip rate angle / pi. A pair that shares several keys counts at the first.
Buckets hold some BUCKET rows if vectors are spread evenly: comparing codes within a bucket is
cheap, and short keys need few tables (13 for 10^5 vectors, 22 for 10^6, 73 for 10^9).
With recall=1 and confidence=inf all vectors meet in blocks and every pair is recomputed: exact,
and quadratic. Equal vectors are one class from the start (by 128 bits of a hash). Buckets over a
cap are dealt out as pairs of chunks; a task gives link counts and a spanning forest, never pairs.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component
has no links and is its own component; a null vec_id never is a component's id unless all its
ids are null; vectors of different lengths do not link; rows of equal vectors link with each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from missive.llm.buckets import dealt, groups, spread_join
from missive.llm.common import prepare, table, written
from missive.llm.components import connected_components

THRESHOLD, RECALL, CONFIDENCE, SEED = 0.95, 0.9999, 5.0, 7
BUCKET_CAP = 4096
#: Rows of a bucket of evenly spread vectors, at most; a power of two.
BUCKET = 1024
#: Rows of a block of pairs; pairs that are recomputed at once.
STEP, EXACT_PAIRS = 512, 1 << 14
#: Rows of a bucket up to which its pairs are listed.
SMALL = 64


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key, and tables, for n distinct vectors: buckets of up to BUCKET rows if they were spread evenly."""
    if recall >= 1:
        return 0, 1
    bits = min(28, max(4, n.bit_length() - BUCKET.bit_length() + 1))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _checked(kind: str):
    """vec_id, a hash of the vector, and its components as bytes of this kind of number; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = pc.fill_null(column.values.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
            offsets, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            same, raw = [], []
            for k in range(batch.num_rows):
                v = values[offsets[k] : offsets[k + 1]] if known[k] else values[:0]
                if not len(v) or not np.isfinite(v).all() or not v.any():
                    same.append(None), raw.append(None)
                    continue
                same.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest())
                raw.append(v.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "same", "raw"]
            )

    return run


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, from their bytes, at length 1 in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(x: np.ndarray, plan: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors (n, dim): records with code, factor and four-bit components; and the keys (n, tables)."""
    (n, dim), (bits, tables) = x.shape, plan
    turned = x @ rotation(dim, 0).T
    signs = turned > 0
    out = np.zeros(n, record(dim))
    out["code"] = np.packbits(signs, axis=1)
    out["factor"] = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    low = turned.min(axis=1)
    width = np.maximum((turned.max(axis=1) - low) / 15, 1e-12)
    four = np.clip(np.rint((turned - low[:, None]) / width[:, None]), 0, 15).astype(np.uint8)
    if dim % 2:
        four = np.concatenate([four, np.zeros((n, 1), np.uint8)], axis=1)
    out["four"], out["low"], out["width"] = four[:, ::2] | four[:, 1::2] << 4, low, width
    keys = np.zeros((n, tables), "<i4")
    if bits:
        run = min(bits, dim)
        per = max(1, dim // run)
        turns = (x @ rotation(dim, r).T > 0 for r in range(1, -(-tables // per)))
        flags = np.concatenate([f[:, : per * run] for f in (signs, *turns)], axis=1)
        weights = 1 << np.arange(run, dtype=np.int64)
        keys = np.stack([flags[:, t * run : (t + 1) * run] @ weights for t in range(tables)], axis=1).astype("<i4")
    return out, keys


def record(dim: int) -> np.dtype:
    """What stands for a vector in the hash tables."""
    code, four = -(-dim // 8), -(-dim // 2)
    return np.dtype([("code", "u1", (code,)), ("four", "u1", (four,)), ("factor", "<f4"), ("low", "<f4"), ("width", "<f4")])


def key_bytes(plan: tuple[int, int]) -> int:
    return max(1, -(-plan[0] // 8))


def _keyed(plan: tuple[int, int], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(u) for u in batch.column(1).to_pylist()])
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = units(part.column(1).to_pylist(), kind)
                records, keys = coded(x, plan)
                packed = np.ascontiguousarray(keys[:, :, None].view("u1")[:, :, : key_bytes(plan)])
                arrays = [
                    part.column(0),
                    pa.array([x.shape[1]] * len(keys), pa.int32()),
                    pa.array([r.tobytes() for r in records], pa.binary()),
                    pa.array([k.tobytes() for k in packed], pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "dim", "record", "keys", "key_list"])

    return run


class Coded:
    """The records of some buckets, vectors of one length, unpacked once.

    ``numbers`` are the rows' tables and ``before`` their keys of the tables before.
    """

    def __init__(
        self,
        raw: list[bytes],
        dim: int,
        plan: tuple[int, int],
        threshold: float,
        confidence: float,
        numbers: np.ndarray | None = None,
        before: list[bytes] | None = None,
    ):
        self.r = np.frombuffer(b"".join(raw), record(dim))
        numbers = np.zeros(len(raw), int) if numbers is None else numbers
        size = key_bytes(plan)
        known = np.zeros((len(raw), int(numbers.max(initial=0)), 4), np.uint8)
        for t in np.unique(numbers[numbers > 0]):
            rows = np.flatnonzero(numbers == t)
            known[rows, :t, :size] = np.frombuffer(b"".join(before[k] for k in rows), np.uint8).reshape(len(rows), t, size)
        self.keys = known.view("<u4")[:, :, 0]
        self.exact = not math.isfinite(confidence)
        if self.exact:
            return
        self.signs = np.unpackbits(self.r["code"], axis=1, count=dim).astype(np.float32) * 2 - 1
        four = np.stack([self.r["four"] & 15, self.r["four"] >> 4], axis=2).reshape(len(self.r), -1)[:, :dim]
        self.values = (four * self.r["width"][:, None] + self.r["low"][:, None]) / np.float32(math.sqrt(dim))
        self.dim, self.least, self.steps = dim, threshold, (confidence * 0.3 * self.r["width"].astype(np.float64)) ** 2
        c = self.r["factor"].astype(np.float64)
        error = np.sqrt(np.maximum(0, 1 - c * c) / max(dim - 1, 1e-9))
        # estimate / c >= threshold - confidence * error / c, and the standard error of components in steps of width
        self.floor, self.rounding = c * threshold - confidence * error, confidence * 0.3 * self.r["width"]

    def block(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs i < j of the rows a and b that may reach the threshold, by estimates in both directions."""
        maybe = np.ones((a.stop - a.start, b.stop - b.start), bool)
        if not self.exact:
            for rows, columns, turn in ((a, b, False), (b, a, True)):  # codes of rows, components of columns
                fits = self.signs[rows] @ self.values[columns].T
                fits = fits >= self.floor[rows][:, None] - self.rounding[columns][None, :]
                maybe &= fits.T if turn else fits
            if maybe.any():
                maybe &= self.rounded(self.values[a] @ self.values[b].T, self.steps[a][:, None], self.steps[b][None, :])
        i, j = np.nonzero(maybe)
        i, j = i + a.start, j + b.start
        return i[i < j], j[i < j]

    def rounded(self, products: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """May pairs of these products of scaled components, with these squared errors, reach the threshold?"""
        return products * self.dim >= self.least - np.sqrt(one + two)

    def listed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs i, j that may reach the threshold."""
        for turn in () if self.exact else (False, True):
            rows, columns = (j, i) if turn else (i, j)
            keep = np.einsum("ij,ij->i", self.signs[rows], self.values[columns]) >= self.floor[rows] - self.rounding[columns]
            i, j = i[keep], j[keep]
        if not self.exact:
            keep = self.rounded(np.einsum("ij,ij->i", self.values[i], self.values[j]), self.steps[i], self.steps[j])
            i, j = i[keep], j[keep]
        return i, j

    def new(self, i: np.ndarray, j: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Do i and j share no key of an earlier table than number?"""
        out = np.ones(len(i), bool)
        for t in range(int(number.max()) if len(number) else 0):
            out &= (self.keys[i, t] != self.keys[j, t]) | (number <= t)
        return out


def undecided(t: pa.Table, starts: np.ndarray, plan: tuple[int, int], threshold: float, confidence: float):
    """Per length of vectors: their rows in t, and lists of pairs (places in those rows) to be recomputed.

    Small buckets are compared all at once, by shifts of the sorted rows; large ones by blocks.
    """
    dims, number, chunk = (t.column(c).to_numpy() for c in ("dim", "table", "chunk"))
    apart = t.column("i").to_numpy() != t.column("j").to_numpy()
    bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        raw, before = (t.column(c).take(pa.array(at)).to_pylist() for c in ("record", "before"))
        codes = Coded(raw, int(dim), plan, threshold, confidence, number[at], before)
        own, tables, chunks, dealt_out = bucket[at], number[at], chunk[at], apart[at]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ends = np.append(first[1:], len(at))
        sizes = ends - first
        last = np.repeat(np.where(sizes <= SMALL, ends, 0), sizes)

        def fresh_pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = ~dealt_out[i] | (chunks[i] != chunks[j])
            i, j = i[keep], j[keep]
            keep = codes.new(i, j, tables[i])
            return i[keep], j[keep]

        def pairs():
            for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
                i = np.flatnonzero(np.arange(len(at)) + shift < last)
                for k in range(0, len(i), EXACT_PAIRS):
                    yield fresh_pairs(*codes.listed(i[k : k + EXACT_PAIRS], i[k : k + EXACT_PAIRS] + shift))
            for a, b in zip(first[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist()):
                for p in range(a, b, STEP):
                    for q in range(p, b, STEP):
                        yield fresh_pairs(*codes.block(slice(p, min(b, p + STEP)), slice(q, min(b, q + STEP))))

        yield at, pairs()


def forest(i: np.ndarray, j: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (i, j) that join two trees of parent, in which they are entered.

    All links are tested at once; only the first of each pair of trees goes on.
    """
    out = []
    while len(i):
        while True:  # flatten
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        high, low = np.maximum(a, b), np.minimum(a, b)
        first = np.unique(high, return_index=True)[1]  # each root hooks once, to a lower root: no cycle
        parent[high[first]] = low[first]
        out += zip(i[first].tolist(), j[first].tolist())
    return out


def _flagged(plan: tuple[int, int], threshold: float, confidence: float):
    """The rows that are in an undecided pair of their bucket."""

    def handle(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        some = np.zeros(t.num_rows, bool)
        for at, pairs in undecided(t, starts, plan, threshold, confidence):
            for i, j in pairs:
                some[at[i]] = some[at[j]] = True
        yield from t.filter(pa.array(some)).to_batches()

    return lambda batches: groups(batches, handle, rows=1 << 15)


def _compared(plan: tuple[int, int], kind: str, threshold: float, confidence: float):
    """Link counts (a, count) and a spanning forest (a, b) of each bucket."""

    def handle(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        out_a, out_b, kinds = [], [], []
        for at, pairs in undecided(t, starts, plan, threshold, confidence):
            node, n = (t.column(c).to_numpy()[at] for c in ("node", "n"))
            x = units(t.column("raw").take(pa.array(at)).to_pylist(), kind)
            parent, got, links = np.arange(len(at)), np.zeros(len(at)), []
            for i, j in pairs:
                near = np.zeros(len(i), bool)
                for k in range(0, len(i), EXACT_PAIRS):
                    some = slice(k, k + EXACT_PAIRS)
                    near[some] = np.einsum("ij,ij->i", x[i[some]], x[j[some]]) >= threshold
                i, j = i[near], j[near]
                if len(i):
                    for one, two in ((i, j), (j, i)):
                        got += np.bincount(one, weights=n[two], minlength=len(at))
                    links += forest(i, j, parent)
            known, which = np.unique(node, return_inverse=True)
            sums = np.bincount(which, weights=got)
            out_a += node[[u for u, _ in links]].tolist() if links else []
            out_b += node[[v for _, v in links]].tolist() if links else []
            kinds += [True] * len(links) + [False] * int((sums > 0).sum())
            out_a += known[sums > 0].tolist()
            out_b += sums[sums > 0].astype(np.int64).tolist()
        if kinds:
            arrays = [pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "is_edge"])

    return lambda batches: groups(batches, handle, rows=1 << 14)


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, confidence: float = CONFIDENCE) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == FloatType() else "<f8"
    rows = vectors.select("vec_id", "embedding").mapInArrow(_checked(kind), "vec_id bigint, same binary, raw binary")
    rows = written(rows, "vectors")
    classes = rows.where("same is not null").groupBy("same")
    classes = classes.agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes", n=F.count(F.lit(1)))
    plan = table_plan(classes.metrics["n"], threshold, recall)
    fields = "node bigint, dim int, record binary, keys binary, key_list array<int>"
    keyed = written(classes.select("node", "raw").mapInArrow(_keyed(plan, kind), fields), "vector-codes")
    keyed = keyed.select("node", "dim", "record", "keys", F.posexplode("key_list").alias("table", "bits"))
    before = F.substring("keys", F.lit(1), F.col("table") * key_bytes(plan)).alias("before")
    key = (F.col("dim").cast("long") * (1 << 32) + F.col("bits")).alias("key")
    near = dealt(keyed.select("node", "dim", "record", before, "table", key), "node", BUCKET_CAP)
    near = written(near.mapInArrow(_flagged(plan, threshold, confidence), near.schema), "vector-candidates")
    place = ["table", "key", "i", "j"]
    full = near.join(classes.select("node", "raw", "n"), "node").repartition(*place).sortWithinPartitions(*place)
    compared = full.mapInArrow(_compared(plan, kind, threshold, confidence), "a bigint, b bigint, is_edge boolean")
    found = written(compared, "vector-links")
    counts = found.where("not is_edge").groupBy("a").agg(F.sum("b").alias("others"))
    roots = connected_components(found.where("is_edge").select("a", "b"))
    known = classes.select("node", "same", "n", "first").join(counts.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    known = written(known.select("node", "same", "n", "first", "others", "root"), "vector-roots")
    least = known.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    known = spread_join(known, least, "root", "node", "left")
    linked = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least"))
    known = known.select("same", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), linked.alias("component_id"))
    out = rows.select("vec_id", "same").join(known, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))
