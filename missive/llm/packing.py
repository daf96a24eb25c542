"""Packing in the order of a space-filling curve.

A document's hashed vector (its token counts) is projected to four dimensions by random
signs; the direction of the projection, on a grid of 2**12 steps per axis, gives a Hilbert
key. Documents are range-partitioned and sorted by that key, so neighbours share
vocabulary, and each range is filled into sequences along the curve. A range's last
sequence is cut into powers of two, which need no padding.

Equal texts have equal keys; a hash of the id follows the key, so that a large group of
copies is still split over ranges. Defined results: a null text is an empty one and gives
just the end id; null and repeated doc_ids are packed like others; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import prepare, range_count, table, text_or_empty, written
from missive.llm.tokens import WordCachedTokenizer

DIMS, BITS, SEED = 4, 12, 20240501
MAX_TOKENS = 2048
#: Ids that are projected at once.
ROOM = 1 << 16


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of grid (n, dims), by Skilling's transpose (2004), on columns."""
    x = [grid[:, i].astype(np.uint64) for i in range(grid.shape[1])]
    n, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p, qq = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            hit = (x[i] & qq) != 0
            t = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros(len(grid), np.uint64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros(len(grid), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | ((v >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def _tokenized(tokenizer_path: str, end_id: int):
    """doc_id, text -> doc_id, Hilbert key, ids (16 bits each where the vocabulary allows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordCachedTokenizer.at(tokenizer_path)
        size = max(len(tok.token_bytes), end_id + 1)
        # whole numbers, whose sums are exact: equal texts have equal keys wherever they stand
        signs = np.rint(np.random.default_rng(SEED).standard_normal((DIMS, size)) * 256)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.concatenate([x, end]) for x in tok.encode(batch.column(1).to_pylist())]
            flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
            way = np.zeros((len(ids), DIMS))
            for at in range(0, len(flat), ROOM):
                some = slice(at, at + ROOM)
                for d in range(DIMS):
                    way[:, d] += np.bincount(owner[some], weights=signs[d, flat[some]], minlength=len(ids))
            way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-12)
            grid = np.clip((way + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.uint64)
            raws = pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert_keys(grid, BITS)), raws], names=["doc_id", "key", "ids"])

    return run


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(max_tokens: int, width: int):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        open_pieces: list[tuple] = []  # of the sequence that is being filled: doc_id, start, ids, doc_tokens
        held = 0
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                total, at = len(raw) // 4, 0
                while at < total:
                    n = min(total - at, max_tokens - held)
                    open_pieces.append((doc, at, raw[4 * at : 4 * (at + n)], total))
                    at, held = at + n, held + n
                    if held == max_tokens:
                        close(open_pieces)
                        open_pieces, held = [], 0
                if len(rows) >= 2000:
                    yield flush()
        for size in powers(held):
            part, got = [], 0
            while got < size:
                doc, start, ids, total = open_pieces.pop(0)
                n = min(len(ids) // 4, size - got)
                part.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    open_pieces.insert(0, (doc, start + n, ids[4 * n :], total))
                got += n
            close(part)
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32 bit), doc_tokens, sequence_id, offset, per piece.

    The tokens are written once to the shared folder, since a range partitioning samples its
    input and would else tokenize twice; they then shuffle once.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokens = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_tokenized(tokenizer_path, end_id), "doc_id bigint, key bigint, ids binary")
    tokens = written(tokens, "packing-tokens", nbytes=F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)))
    width = 2 if max(len(WordCachedTokenizer.at(tokenizer_path).token_bytes), end_id + 1) <= 1 << 16 else 4
    n = range_count(spark, tokens.metrics["nbytes"])
    ranged = tokens.withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", "doc_id", "ids")
    pieces = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranged.select("doc_id", "ids").mapInArrow(_pack(max_tokens, width), pieces)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
