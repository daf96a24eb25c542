"""Document fingerprints by MinHash, and near-duplicates by signature bands.

Words are cut at ASCII white space after lower-casing A-Z; a shingle is five words (fewer
words: all of them; none: no shingle). Shingles are hashed to 64 bits and go through
PERMUTATIONS universal hash functions (multiply-shift with odd random multipliers); the
minimum of each is one place of the signature, all in vectorised numpy. The fingerprint is
the low 16 bits of each place in hexadecimal. The likeness of two fingerprints is the share of equal
places, an estimate of the Jaccard similarity of the shingle sets.

``near_duplicates`` joins bands of signatures in Spark. Members of a band's bucket give a
spanning forest of pairs whose signatures are alike enough; the shingle sets of the groups
so found are then compared exactly, in bounded blocks, and only pairs of Jaccard similarity
0.8 or more link.

Defined results: a null text is an empty one; empty or blank texts have the fingerprint of
the empty set, equal to each other; documents are ordered by doc_id, nulls first, repeated
ids by a hash of the text, then by text; a lone document is its own next one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.llm.buckets import dealt, groups, spread_join
from missive.llm.common import prepare, range_count, table, text_bytes, text_or_empty, written
from missive.llm.components import connected_components

SHINGLE, PERMUTATIONS, SEED = 5, 128, 5
JACCARD, BANDS, BAND_ROWS = 0.8, 25, 5
#: Estimated similarity from which pairs are compared exactly: the threshold less four standard errors.
MAYBE = JACCARD - 4 * (JACCARD * (1 - JACCARD) / PERMUTATIONS) ** 0.5
BUCKET_CAP, EXACT_CAP = 4096, 512
_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint64)


def split_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ words[j : j + n]) * _MIX[j]
        h ^= h >> np.uint64(29)
    return h


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima, 32 bits each, of the universal hashes over the shingles."""
    out = _NONE.copy()
    for at in range(0, len(shingles), 1024):
        part = _A[:, None] * shingles[None, at : at + 1024]
        part += _B[:, None]
        part >>= np.uint64(32)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def packed(sig: np.ndarray) -> bytes:
    return (sig & np.uint64(0xFFFF)).astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")))


class Document:
    """A text with what its own and its edited text's fingerprint share."""

    def __init__(self, text: str):
        self.text = text
        self.cut = len(text) // 4
        self.head = text[: len(text) - self.cut]
        self.words = hash_words(split_words(text))
        # words of the head but its last, which the edit may change, are words of both texts
        self.shared = max(0, len(split_words(self.head)) - 1)
        n = max(0, self.shared - SHINGLE + 1) if len(self.words) >= SHINGLE else 0
        shingles = shingle_hashes(self.words)
        self.shared_sig, self.n_shared = signature(shingles[:n]), n
        self.sig = np.minimum(self.shared_sig, signature(shingles[n:]))
        self.fingerprint = packed(self.sig)

    def row(self, following: "Document") -> dict:
        edited = self.head + following.text[: self.cut]
        words = split_words(edited)
        hashes = np.concatenate([self.words[: self.shared], hash_words(words[self.shared :])])
        shingles = shingle_hashes(hashes)
        sig = np.minimum(self.shared_sig, signature(shingles[self.n_shared :])) if len(hashes) >= SHINGLE else signature(shingles)
        after = packed(sig)
        return {"n_chars": len(self.text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": self.fingerprint, "edited_fingerprint": after, "near_edited": likeness(self.fingerprint, after), "near_next": likeness(self.fingerprint, following.fingerprint)}


_RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SQL = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition but its last; the texts at both of its ends, marked first and last."""
    schema = pa.schema([("doc_id", pa.int64()), *_RESULT, ("part", pa.int64()), ("end", pa.string()), ("text", pa.string())])
    part, before, before_id = TaskContext.get().partitionId(), None, None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            now = Document(text)
            if before is None:
                rows.append({"doc_id": doc_id, "part": part, "end": "first", "text": text})
            else:
                rows.append({"doc_id": before_id, **before.row(now)})
            before, before_id = now, doc_id
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if before is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": before_id, "part": part, "end": "last", "text": before.text}], schema=schema)


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *_RESULT])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([{"doc_id": d, **Document(a).row(Document(b))} for d, a, b in zip(*(c.to_pylist() for c in batch.columns))], schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts shuffle once, by ranges of doc_id and, within an id, of the text's hash, so that no id is one task; only the two texts at each range's ends move again.
    """
    prepare(docs.sparkSession)
    n = range_count(docs.sparkSession, text_bytes(docs))
    order = ["doc_id", F.xxhash64("text")]  # the hash is worked out anew, not moved
    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    found = written(ordered.mapInArrow(_in_order, f"doc_id bigint, {_SQL}, part bigint, end string, text string"), "minhash")
    ends = found.where("end is not null")
    parts = ends.where("end = 'first'").select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    parts = parts.select("part", following.alias("next_part"))
    heads = ends.where("end = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    last = ends.where("end = 'last'").select("doc_id", "text", "part").join(parts, "part").join(heads, "next_part")
    columns = ["doc_id", *(c for c, _ in _RESULT)]
    rows = found.where("end is null").select(columns).unionByName(last.select("doc_id", "text", "next_text").mapInArrow(_at_ends, f"doc_id bigint, {_SQL}"))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(hash_words(split_words(t)))) for t in batch.column(1).to_pylist()]
        sigs = [signature(s).astype("<u4") for s in sets]
        bands = [[xxhash.xxh3_64_intdigest(s[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)] for s in sigs]
        same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        columns = {
            "doc_id": batch.column(0), "same": pa.array(same, pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
            "sig": pa.array([s.tobytes() for s in sigs], pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _forest(alike):
    """Spanning forests of each group, by a search that removes whom it has reached."""

    def handle(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, payload = t.column("node").to_numpy(), t.column("payload").to_pylist()
        out_a, out_b = [], []
        for a, b in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist()):
            if b - a < 2:
                continue
            match = alike(payload[a:b])
            todo = np.arange(b - a)
            while len(todo):
                front, todo = [int(todo[0])], todo[1:]
                while front and len(todo):
                    one = front.pop()
                    near = match(one, todo)
                    out_a += node[a + todo[near]].tolist()
                    out_b += [int(node[a + one])] * int(near.sum())
                    front += todo[near].tolist()
                    todo = todo[~near]
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b)], names=["a", "b"])

    return lambda batches: groups(batches, handle, rows=1 << 13)


def _by_signature(payload: list[bytes]):
    sigs = np.frombuffer(b"".join(payload), "<u4").reshape(len(payload), -1)
    return lambda one, todo: (sigs[todo] == sigs[one]).mean(axis=1) >= MAYBE


def _by_jaccard(payload: list[bytes]):
    sets = [np.frombuffer(p, np.uint64) for p in payload]

    def match(one: int, todo: np.ndarray) -> np.ndarray:
        flat, sizes = np.concatenate([sets[i] for i in todo]), np.array([len(sets[i]) for i in todo])
        where = np.minimum(np.searchsorted(sets[one], flat), max(0, len(sets[one]) - 1))
        same = sets[one][where] == flat if len(sets[one]) else np.zeros(len(flat), bool)
        common = np.bincount(np.repeat(np.arange(len(todo)), sizes), weights=same, minlength=len(todo))
        total = sizes + len(sets[one]) - common
        return common >= JACCARD * total

    return match


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: the least doc_id reachable over pairs of Jaccard similarity 0.8 or more."""
    prepare(docs.sparkSession)
    signed = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_signatures, "doc_id bigint, same binary, shingles binary, sig binary, bands array<bigint>")
    rows = written(signed, "minhash-sets")
    sets = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    banded = sets.select("node", F.col("sig").alias("payload"), F.posexplode("bands").alias("table", "key"))
    maybe = connected_components(dealt(banded, "node", BUCKET_CAP).mapInArrow(_forest(_by_signature), "a bigint, b bigint"))
    grouped = sets.join(maybe, "node").select(F.lit(0).alias("table"), F.col("root").alias("key"), "node", F.col("shingles").alias("payload"))
    sure = connected_components(dealt(grouped, "node", EXACT_CAP).mapInArrow(_forest(_by_jaccard), "a bigint, b bigint"))
    rooted = sets.select("node", "same", "first").join(sure, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "same").join(spread_join(rooted, least, "root", "node").select("same", "component_id"), "same").select("doc_id", "component_id")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
