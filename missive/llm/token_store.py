"""Token-ID output as directly addressable codes (Brisaboa, Ladra, Navarro 2009).

Ids are split into byte chunks. Level 0 holds each id's low byte and a bitmap that tells
which ids go on; level 1 holds the next byte of those, and so on. Each level is a run of
blocks of 512 entries: the ones before the block, its 64 bytes of bitmap, its low bytes; the last
level has low bytes only. An id is read by one block per level, found by its offset, without
decoding its neighbours.

A store is a folder. Each task that writes appends the codes of its shards (runs of whole
documents in ascending doc_id order) to a code file of its own under ``codes``; ``shards`` is
a Parquet table with each shard's file, offset, size, documents and counts. A file's name is
new for each attempt of a task and only attempts that Spark commits are named in ``shards``, so a lost
executor or a second attempt leaves at most a file that nothing reads. Code files are opened
through pyarrow by the folder's URI: any store that pyarrow can open on all executors.

Defined results: a null text is an empty one and yields just the end id; null doc_ids come
first; equal doc_ids are ordered by a hash of the text, then by the text; an empty table gives
an empty store; columns other than doc_id and text are ignored; a position outside the store
has no token.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.llm.common import new_path, prepare, range_count, table, text_bytes, text_or_empty, written
from missive.llm.tokens import WordCachedTokenizer

MAGIC = b"DAC2"
#: Entries of a block; bytes that hold the header of up to four levels.
BLOCK, HEADER = 512, 13 + 4 * 16
INNER = np.dtype([("rank", "<u4"), ("more", "u1", (BLOCK // 8,)), ("low", "u1", (BLOCK,))])
LAST = np.dtype([("low", "u1", (BLOCK,))])
#: A shard is closed when it holds so many ids.
SHARD_IDS = 1 << 18
#: Shards whose starts (20 bytes each) may be broadcast: some 26 billion ids; else they are joined.
BROADCAST_SHARDS = 100_000


def encode_codes(ids: np.ndarray) -> bytes:
    """ids (non-negative, below 2**32) as magic, count, level count, each level's entries and offset, then the blocks."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        low, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        inner, n = bool(more.any()), len(low)
        pad = -n % BLOCK
        blocks = np.zeros((n + pad) // BLOCK, INNER if inner else LAST)
        blocks["low"] = np.pad(low, (0, pad)).reshape(-1, BLOCK)
        levels.append((n, blocks))
        if not inner:
            break
        flags = np.pad(more, (0, pad)).reshape(-1, BLOCK)
        blocks["more"] = np.packbits(flags, axis=1, bitorder="little")
        ones = flags.sum(axis=1)
        blocks["rank"] = np.cumsum(ones) - ones
        rest = rest[more]
    at, places = 13 + 16 * len(levels), []
    for n, blocks in levels:
        places.append(struct.pack("<QQ", n, at))
        at += blocks.nbytes
    return b"".join([MAGIC, struct.pack("<QB", len(ids), len(levels)), *places, *(blocks.tobytes() for _, blocks in levels)])


class Codes:
    """Codes opened without decoding them: bytes, or a file (with ``read_at``) in which they begin at ``base``."""

    def __init__(self, source, base: int = 0):
        if isinstance(source, bytes):
            self.read = lambda at, n: source[base + at : base + at + n]
        else:
            self.read = lambda at, n: source.read_at(n, base + at)
        head = self.read(0, HEADER)
        if head[:4] != MAGIC:
            raise ValueError("not directly addressable codes")
        self.n, n_levels = struct.unpack_from("<QB", head, 4)
        self.levels = [struct.unpack_from("<QQ", head, 13 + 16 * k) for k in range(n_levels)]

    def blocks(self, level: int, begin: int, end: int) -> np.ndarray:
        kind = LAST if level == len(self.levels) - 1 else INNER
        raw = self.read(self.levels[level][1] + begin * kind.itemsize, (end - begin) * kind.itemsize)
        return np.frombuffer(raw, kind, end - begin) if end > begin else np.zeros(0, kind)

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, where = np.zeros(self.n, np.uint32), slice(None)
        for level, (n, _) in enumerate(self.levels):
            blocks = self.blocks(level, 0, -(-n // BLOCK))
            out[where] |= blocks["low"].ravel()[:n].astype(np.uint32) << np.uint32(8 * level)
            if level < len(self.levels) - 1:
                go = np.flatnonzero(np.unpackbits(blocks["more"].ravel(), count=n, bitorder="little"))
                where = go if level == 0 else where[go]
        return out

    def get(self, positions) -> np.ndarray:
        """The ids at these positions; reads one block per level and position, neighbouring blocks at once."""
        pos = np.atleast_1d(np.asarray(positions, dtype=np.int64))
        if len(pos) and (pos.min() < 0 or pos.max() >= self.n):
            raise IndexError("position outside the codes")
        out, active = np.zeros(len(pos), np.uint32), np.arange(len(pos))
        for level in range(len(self.levels)):
            if not len(pos):
                break
            wanted, which = np.unique(pos // BLOCK, return_inverse=True)
            runs = np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1)
            blocks = np.concatenate([self.blocks(level, int(run[0]), int(run[-1]) + 1) for run in runs])
            at = pos % BLOCK
            out[active] |= blocks["low"][which, at].astype(np.uint32) << np.uint32(8 * level)
            if level == len(self.levels) - 1:
                break
            more = blocks["more"][which]
            own = more[np.arange(len(at)), at >> 3]
            go = (own >> (at & 7)) & 1 == 1
            ones = np.where(np.arange(BLOCK // 8) < (at >> 3)[:, None], np.bitwise_count(more), 0).sum(axis=1, dtype=np.int64)
            ones = ones + np.bitwise_count(own & ((1 << (at & 7)) - 1).astype(np.uint8))
            active, pos = active[go], (blocks["rank"][which].astype(np.int64) + ones)[go]
        return out


SHARD_SCHEMA = "part int, seq int, file string, at bigint, size bigint, doc_ids array<bigint>, counts array<bigint>, n_ids bigint"


def code_folder(path: str) -> tuple[FileSystem, str]:
    fs, root = FileSystem.from_uri(path)
    return fs, f"{root}/codes"


def _shards(path: str, tokenizer_path: str, end_id: int):
    numbers = [(n, pa.int64()) for n in ("at", "size", "n_ids")]
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), *numbers[:2], ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), numbers[2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq, at = WordCachedTokenizer.at(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4")
        name, out = f"{part:07d}-{uuid.uuid4().hex}.dac", None
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                fs, folder = code_folder(path)
                out = fs.open_output_stream(f"{folder}/{name}")
            values = np.concatenate(ids)
            codes = encode_codes(values)
            out.write(codes)
            row = {"part": part, "seq": seq, "file": name, "at": at, "size": len(codes), "doc_ids": docs, "counts": [len(x) for x in ids], "n_ids": len(values)}
            at += len(codes)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1).to_pylist())):
                docs.append(doc)
                ids.append(np.concatenate([raw, end]))
                held += len(raw) + 1
                if held >= SHARD_IDS:
                    yield shard()
                    ids, docs, held, seq = [], [], 0, seq + 1
        if docs:
            yield shard()
        if out is not None:
            out.close()  # before the task ends, so that no committed row names an open file

    return run


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Writes the ids of all texts, in ascending doc_id order, to a new folder (absolute path or URI); one shuffle, by doc_id range."""
    prepare(docs.sparkSession)
    fs, folder = code_folder(path)
    fs.create_dir(folder, recursive=True)
    n = range_count(docs.sparkSession, text_bytes(docs))
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ranged.mapInArrow(_shards(path, tokenizer_path, end_id), SHARD_SCHEMA).write.parquet(f"{path}/shards")


def _read_ids(path: str, with_ids: bool):
    """Whole documents from each shard; the last id of each is read by its position, without decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = code_folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{row['file']}") as f:
                    codes = Codes(f.read_at(row["size"], row["at"]))
                counts = np.asarray(row["counts"], dtype=np.int64)
                ids, ends = codes.all().astype("<u4"), np.cumsum(counts)
                raw, begins = memoryview(ids.tobytes()), ends - counts
                docs = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(begins + row["start"]), "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in docs], pa.int64()), "last_id": pa.array(codes.get(ends - 1).astype(np.int64)),
                }
                if with_ids:
                    columns["ids"] = pa.array([bytes(x) for x in docs], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, n_ids, start: the ids before each shard, summed over parts, then within each part."""
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", "n_ids", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part")).join(parts, "part")
    return starts.select("part", "seq", "n_ids", (F.col("part_start") + F.col("in_part")).alias("start"))


def read_token_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, last_id, and ids (little-endian 32 bit).

    Shards are dealt out to tasks by their number, as the table that names them is far smaller than the codes.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    starts = written(shard_starts(shards), "shard-starts", n=F.count(F.lit(1)), ids=F.coalesce(F.sum("n_ids"), F.lit(0)))
    n, tasks = starts.metrics["n"], range_count(spark, 4 * starts.metrics["ids"])
    starts = starts.drop("n_ids")
    if n <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    full = shards.join(starts, ["part", "seq"]).repartition(tasks, "part", "seq").select("file", "at", "size", "doc_ids", "counts", "start")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, last_id bigint" + ", ids binary" * with_ids
    return full.mapInArrow(_read_ids(path, with_ids), schema)


def _looked_up(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = code_folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                at = np.asarray(row["places"], dtype=np.int64)
                with fs.open_input_file(f"{folder}/{row['file']}") as f:
                    found = Codes(f, row["at"]).get(at).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at + row["start"]), pa.array(found)], names=["position", "id"])

    return run


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position -> position, id, for distinct positions within the store, read by seeking in the code files.

    Shards and positions meet by stretches of SHARD_IDS positions; of a code file only headers and the blocks asked for are read.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").select("part", "seq", "file", "at", "n_ids")
    spans = shard_starts(shards).where("n_ids > 0")
    stretch = lambda c: F.floor(c / SHARD_IDS)
    spans = spans.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_ids") - 1))))
    asked = positions.select(F.col("position").cast("long")).where("position is not null").distinct().withColumn("stretch", stretch(F.col("position")))
    met = asked.join(spans, "stretch").where("position >= start and position < start + n_ids")
    wanted = met.groupBy("part", "seq", "start").agg(F.collect_list(F.col("position") - F.col("start")).alias("places"))  # at most a shard's ids
    return shards.join(wanted, ["part", "seq"]).select("file", "at", "start", "places").mapInArrow(_looked_up(path), "position bigint, id bigint")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    write_token_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_store(spark, path, with_ids=False)
