"""Line deduplication with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. A task adds the
keys of its documents to a once-seen filter, and those of two documents or more to a
twice-seen one; merging two tasks' filters also passes on to the twice-seen one the bits
that both once-seen ones have. A key in two documents is thus always in the twice-seen
filter. Only keys found there shuffle, as 128-bit digests, to be counted exactly.

The filters are sized by the number of lines, BITS_PER_LINE for each, and merged in segments,
so no task holds more than its own keys' bits or some segments. The merged filter goes to
the executors, so it is at most MOST_BITS; a corpus of more lines fills it gradually, which
makes more keys suspects (16 bytes each to shuffle), never a wrong result. Repeated keys are
broadcast if there are at most BROADCAST_KEYS, else joined by digest: the suspects of each
distinct text move in that join, and then the texts once.

Defined results: a null or empty text has one empty line, which stays (keys of no code
point are never dropped); null or repeated doc_ids are documents like others; an empty
table gives no rows; other columns pass through, and input columns named like the results
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import fresh, prepare, table, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Bits of each filter: for each line, and at least and at most (128 MB).
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 30
SEGMENT_BITS, PROBES = 1 << 16, 3
#: Hashes that a task holds before it passes on what it has.
HASHES_HELD = 1 << 22
#: Digests of repeated keys (16 bytes each) that may be broadcast.
BROADCAST_KEYS = 1 << 21
_WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    strip = _WHITE
    return [line.strip(strip) for line in text.lower().split(b"\n")]


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each 64-bit hash, by double hashing; bits is a power of two."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _distinct(text: str | None, min_chars: int) -> set[bytes]:
    keys = set(line_keys((text or "").encode()))
    keys.discard(b"")
    return {k for k in keys if len(k.decode()) >= min_chars} if min_chars > 1 else keys


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _add(packed: np.ndarray, at: np.ndarray) -> None:
    """Sets distinct bits: eight rounds, none of which meets a byte twice."""
    byte, bit = (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)
    for b in range(8):
        packed[byte[bit == b]] |= np.uint8(1 << b)


def _segments(positions: np.ndarray) -> dict[int, np.ndarray]:
    """Sorted places in each segment."""
    positions = np.unique(positions)
    segment = (positions // SEGMENT_BITS).astype(np.int64)
    cuts = np.flatnonzero(np.diff(segment)) + 1
    return {int(s[0]): (p % SEGMENT_BITS).astype("<u2") for s, p in zip(np.split(segment, cuts), np.split(positions, cuts)) if len(s)}


def _filters(bits: int, min_chars: int):
    """A task's two filters by segment, as sorted places of the bits."""

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)  # a document gives each key once
        once, twice = _segments(_positions(hashes, bits).ravel()), _segments(_positions(hashes[n > 1], bits).ravel())
        rows = [{"segment": k, "once": v.tobytes(), "twice": twice[k].tobytes() if k in twice else b""} for k, v in once.items()]
        for at in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_pylist(rows[at : at + 1024])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            hashes = [xxhash.xxh3_64_intdigest(k) for text in batch.column(0).to_pylist() for k in _distinct(text, min_chars)]
            if not hashes:
                continue
            held.append(np.array(hashes, dtype=np.uint64))
            n += len(hashes)
            if n > HASHES_HELD:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            once, twice = np.frombuffer(row["once"], "<u2").astype(np.uint64), np.frombuffer(row["twice"], "<u2").astype(np.uint64)
            if row["segment"] not in held:
                held[row["segment"]] = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
            seen, again = held[row["segment"]]
            _add(again, np.union1d(twice, once[_has(seen, once)]))
            _add(seen, once)
    for segment, (_, twice) in held.items():
        if twice.any():
            yield pa.RecordBatch.from_pylist([{"segment": segment, "twice": twice.tobytes()}])


def filter_bits(docs: DataFrame) -> int:
    """Bits for the lines of docs: a power of two."""
    lines = F.lit(1) + F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n = docs.agg(F.sum(lines)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_LINE * n - 1).bit_length() if n else 0))


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged twice-seen filter as bytes; at most bits / 8 of them come to the driver."""
    parts = docs.select("text").mapInArrow(_filters(bits, min_chars), "segment bigint, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(_merged, "segment bigint, twice binary")
    size = SEGMENT_BITS // 8
    out = np.zeros(max(bits, SEGMENT_BITS) // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most bits / 8 bytes, a partition at a time
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["twice"], np.uint8)
    return out


def _hits(keys: list[bytes], seen: np.ndarray, bits: int) -> np.ndarray:
    """Which keys are in the filter."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.flatnonzero(_has(seen, _positions(hashes, bits)).all(axis=1))


def _suspects(shared, bits: int, min_chars: int, with_text: bool = False):
    """key: digests of the distinct keys of each text that are in the filter; with the text's own digest if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [list(_distinct(text, min_chars)) for text in texts]
            keys = [k for ks in found for k in ks]
            hit = _hits(keys, seen, bits)
            columns = {"key": pa.array([_digest(keys[i]) for i in hit], pa.binary())}
            if with_text:
                owner = np.repeat(np.arange(len(texts)), [len(ks) for ks in found])[hit]
                own = {i: hashlib.sha256(texts[i].encode()).digest() for i in set(owner.tolist())}
                columns["text_key"] = pa.array([own[i] for i in owner.tolist()], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int, shared, bits: int) -> DataFrame:
    """key (16-byte digest): the keys in at least min_docs (2 or more) documents, exactly."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    suspects = docs.select("text").mapInArrow(_suspects(shared, bits, min_chars), "key binary")
    return suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("key")


def _rewritten(texts: list[str | None], bad_of) -> tuple[list[str], list[int], list[int]]:
    """Texts without their bad lines, their numbers of lines before, and of lines dropped.

    bad_of: the keys of all lines -> which of them are bad.
    """
    lines = [(text or "").encode().split(b"\n") for text in texts]
    keys = [k for text in texts for k in line_keys((text or "").encode())]
    bad = bad_of(keys)
    kept, dropped, at = [], [], 0
    for own in lines:
        gone = bad[at : at + len(own)]
        at += len(own)
        dropped.append(int(gone.sum()))
        kept.append(b"\n".join([line for line, g in zip(own, gone) if not g] if dropped[-1] else own).decode())
    return kept, [len(own) for own in lines], dropped


def _with_result(batch: pa.RecordBatch, columns: int, result: tuple[list[str], list[int], list[int]], counts: tuple[str, str]) -> pa.RecordBatch:
    arrays, names = batch.columns[:columns], batch.schema.names[:columns]
    arrays[names.index("text")] = pa.array(result[0], pa.string())
    return pa.RecordBatch.from_arrays([*arrays, pa.array(result[1], pa.int64()), pa.array(result[2], pa.int64())], names=[*names, *counts])


def _drop(seen_by_all, bits: int, listed, counts: tuple[str, str]):
    """Drops lines whose digests are in ``listed``: two sorted columns of 64 bits. Only suspects get a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, digests = seen_by_all.value, listed.value

        def bad_of(keys: list[bytes]) -> np.ndarray:
            bad = np.zeros(len(keys), bool)
            hit = _hits(keys, seen, bits)
            hit = hit[[keys[i] != b"" for i in hit]] if len(hit) else hit
            if len(hit) and len(digests):
                own = np.frombuffer(b"".join(_digest(keys[i]) for i in hit), "<u8").reshape(-1, 2)
                first, last = (np.searchsorted(digests[:, 0], own[:, 0], side=side) for side in ("left", "right"))
                bad[hit] = [(digests[a:b, 1] == low).any() for a, b, low in zip(first, last, own[:, 1])]
            return bad

        for batch in batches:
            yield _with_result(batch, batch.num_columns, _rewritten(batch.column("text").to_pylist(), bad_of), counts)

    return run


def _drop_listed(counts: tuple[str, str]):
    """The last column holds each text's own bad digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for text, listed in zip(batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                own = set(listed or ())
                one = _rewritten([text], lambda keys: np.array([bool(own) and k != b"" and _digest(k) in own for k in keys]))
                for column, part in zip(out, one):
                    column += part
            yield _with_result(batch, batch.num_columns - 1, out, counts)

    return run


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, bits: int | None = None,
    broadcast_keys: int = BROADCAST_KEYS, counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """docs with text rewritten, and the number of lines before and of those dropped, in columns named by counts."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*counts)
    bits = bits or filter_bits(docs)
    seen = spark.sparkContext.broadcast(twice_seen(docs, bits, min_chars))
    bad = written(repeated_keys(docs, min_docs, min_chars, seen, bits), "repeated-lines", n=F.count(F.lit(1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + "".join(f", `{c}` bigint" for c in counts)
    if bad.metrics["n"] <= broadcast_keys:
        digests = np.frombuffer(b"".join(bytes(r["key"]) for r in bad.toLocalIterator()), "<u8").reshape(-1, 2)
        listed = spark.sparkContext.broadcast(digests[np.argsort(digests[:, 0], kind="stable")])
        return docs.mapInArrow(_drop(seen, bits, listed, counts), schema)
    own, keys = fresh(docs, "text_key", "keys")
    pairs = docs.where("text is not null").select("text").mapInArrow(_suspects(seen, bits, min_chars, True), "key binary, text_key binary").distinct()
    lists = pairs.join(bad, "key", "left_semi").groupBy(F.col("text_key").alias(own)).agg(F.collect_list("key").alias(keys))  # at most a text's lines
    joined = docs.withColumn(own, F.unhex(F.sha2("text", 256))).join(lists, own, "left")
    return joined.select(*[f"`{c}`" for c in docs.columns], keys).mapInArrow(_drop_listed(counts), schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.i FROM documents,
    LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i) u),
keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
bad AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.doc_id, k.i, k.line, b.key IS NOT NULL AS gone FROM keyed k LEFT JOIN bad b USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
