"""Exact removal of repeated byte strings, by merging Burrows-Wheeler transforms.

Which documents could share a string of LENGTH bytes is found first, without loss. Every such
string contains the seed that is least by hash among its SEED-byte strings, and equal strings
contain the same one at the same place. Seeds found in one document only cannot lie in a repeated
string. Around each other seed there is a snippet, all LENGTH-byte strings that contain it; equal
snippets are one row with their least doc_id, so hot passages shrink before they meet. A seed
around which all documents have one and the same snippet has no second string to compare.

All other snippets meet by seed. As they are aligned at it, their transform is the positional one
(Durbin 2014) with letters of eight bytes: for each letter column the letters in the order of what
follows them, once reading from the seed to the right and once to the left. Shards of snippets are
transformed by themselves and merged by refining their interleave (Holt and McMillan 2014): starting
from all of shard 0, then shard 1 and so on, each round reorders the interleave stably by the next
column of the shards' letters, until it is the order of all; no string is sorted again.
Neighbours in that order give the common prefixes, and runs of common prefixes of r bytes or more
are the repeated intervals. A window is repeated where snippets share its part on the left in one
order and its part on the right in the other. The least doc_id of such a class decides.

A seed with too many distinct snippets is dealt out as pairs of chunks. Repeated seeds go to the
executors as a Bloom filter of at most FILTER_BITS. Beyond that, seeds and places alone are joined
with them, and snippets are cut from the texts after that.

Defined results: a null text is an empty one; documents shorter than LENGTH stay as they are; a null
doc_id is neither smaller nor larger than any, nor are equal doc_ids; what is left may split
characters, so it is binary; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.buckets import dealt, groups
from missive.llm.common import discard, prepare, table, text_bytes, written
from missive.llm.line_dedup import _add, _has, _positions

LENGTH, SEED = 50, 20
WINDOWS = LENGTH - SEED + 1  # windows of LENGTH bytes that contain a seed
SNIPPET = LENGTH + WINDOWS - 1
WIDTH = SNIPPET + 2  # a snippet's row: then its first window, and the end of its windows
#: The filter over repeated seeds: 6 to 12 bits a seed, up to 128 MB.
FILTER_BITS = 1 << 30
#: Distinct snippets of one seed that meet in one task; snippets of a shard; of a merge.
SEED_CAP, SHARD, MERGE = 8192, 8192, 32_768
#: Seeds that a task of the first pass holds; seeds of a bucket there.
SEEDS_HELD, BUCKET_SEEDS = 1 << 22, 1 << 20
#: Bytes of text that are hashed at once: arrays that fit a core's cache.
CHUNK = 1 << 16
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_C32 = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2C1B3C6D)]


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """take over each run of width entries, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = take(x[:-step], x[step:])
        span += step
    return x


def seeds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: seed hash, text number, place in its text; the seeds of all windows."""
    texts_at = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    out: list[tuple] = []
    at = 0
    while at < len(texts_at):
        end, size = at, 0
        while end < len(texts_at) and (size == 0 or size + len(texts[texts_at[end]]) <= CHUNK):
            size += len(texts[texts_at[end]])
            end += 1
        some = texts_at[at:end]
        at = end
        lens = np.array([len(texts[i]) for i in some])
        ends = np.cumsum(lens)
        buf = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
        x = buf.astype(np.uint32)
        for step in (1, 2):
            x = x[:-step] | (x[step:] << np.uint32(8 * step))
        n = len(buf) - SEED + 1
        h = x[:n] * _C32[0]
        for k in range(1, SEED // 4):
            h += x[4 * k : 4 * k + n] * _C32[k]
        h ^= h >> np.uint32(15)
        h *= _C32[5]
        h ^= h >> np.uint32(13)
        h |= np.uint32(1)  # 0 stands for no seed
        least = _slide(h, WINDOWS, np.minimum)
        for e in ends[:-1]:  # windows over two texts choose nothing
            least[max(0, e - LENGTH + 1) : e] = 0
        pad = np.zeros(WINDOWS - 1, np.uint32)
        place = np.flatnonzero(h == _slide(np.concatenate([pad, least, pad]), WINDOWS, np.maximum))
        words = np.lib.stride_tricks.sliding_window_view(buf, SEED)[place]
        parts = [np.ascontiguousarray(words[:, k : k + 8]).view("<u8").ravel() for k in (0, 8, SEED - 8)]
        full = parts[0] * _C[0] + parts[1] * _C[1] + parts[2] * _C[2]
        full ^= full >> np.uint64(32)
        full *= _C[3]
        full ^= full >> np.uint64(29)
        number = np.searchsorted(ends, place, side="right")
        out.append((full, np.asarray(some)[number], place - (ends - lens)[number]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _raw(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in batch.column(column).to_pylist()]


def _spread(v: np.ndarray) -> np.ndarray:
    v = v * _C[3]
    return v ^ (v >> np.uint64(31))


def _counted(bits: int):
    """Seeds of a task's documents in buckets by their first bits; the next 32 bits of those met once, and of others."""

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket, rest = (values >> np.uint64(32)).astype(np.int64), (values & np.uint64(0xFFFFFFFF)).astype("<u4")
        edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            part, many = rest[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]] > 1
            rows.append({"bucket": k, "once": part[~many].tobytes(), "more": part[many].tobytes()})
        for k in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[k : k + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            texts = [t if d is not None else b"" for d, t in zip(batch.column(0).to_pylist(), _raw(batch, 1))]
            h, number, _ = seeds(texts)
            if not len(h):
                continue
            h = h >> np.uint64(32 - bits)
            order = np.lexsort((h, number))
            h, number = h[order], number[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (number[1:] != number[:-1])
            held.append(h[new])
            n += len(held[-1])
            if n > SEEDS_HELD:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of each bucket that are in two documents or more."""
    once: dict[int, list[bytes]] = {}
    more: dict[int, list[bytes]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            once.setdefault(row["bucket"], []).append(row["once"])
            more.setdefault(row["bucket"], []).append(row["more"])
    for k in once:
        single = np.sort(np.frombuffer(b"".join(once[k]), "<u4"))
        both = np.unique(np.concatenate([single[1:][single[1:] == single[:-1]], np.frombuffer(b"".join(more[k]), "<u4")]))
        both = both.astype(np.uint64) | np.uint64(k << 32)
        for at in range(0, len(both), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(both[at : at + (1 << 16)].view(np.int64))], names=["seed"])


def _bloom(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                _add(packed, np.unique(_positions(_spread(batch.column(0).to_numpy().view(np.uint64)), bits)))
        step = 1 << 16
        for k in range(0, len(packed), step):
            if packed[k : k + step].any():
                yield pa.RecordBatch.from_pylist([{"segment": k, "bits": packed[k : k + step].tobytes()}])

    return run


def _or_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            new = np.frombuffer(row["bits"], np.uint8)
            held[row["segment"]] = held[row["segment"]] | new if row["segment"] in held else new
    for k, v in held.items():
        yield pa.RecordBatch.from_pylist([{"segment": k, "bits": v.tobytes()}])


def seed_filter(found: DataFrame, n: int, most_bits: int):
    """(broadcast Bloom filter over the n seeds of found, its bits), or (None, 0) if it would be too large."""
    bits = 1 << max(16, (6 * n - 1).bit_length())
    if bits > most_bits:
        return None, 0
    parts = found.select("seed").mapInArrow(_bloom(bits), "segment bigint, bits binary").repartition("segment").mapInArrow(_or_bits, "segment bigint, bits binary")
    packed = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():  # at most the bytes of the filter, a partition at a time
        packed[row["segment"] : row["segment"] + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return found.sparkSession.sparkContext.broadcast(packed), bits


def text_key(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def snippet_keys(snippets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each snippet (rows of WIDTH bytes)."""
    padded = np.zeros((len(snippets), -(-WIDTH // 8) * 8), np.uint8)
    padded[:, :WIDTH] = snippets
    words = padded.view("<u8")
    a, b = np.full(len(words), _C[0]), np.full(len(words), _C[1])
    for k in range(words.shape[1]):
        a = (a ^ words[:, k]) * _C[3]
        a ^= a >> np.uint64(32)
        b = (b + words[:, k]) * _C[2]
        b ^= b >> np.uint64(29)
    a, b = a + b * _C[1], b
    return (a ^ (a >> np.uint64(31))).view(np.int64), b.view(np.int64)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column, without a Python object for each."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def cut(texts: list[bytes], number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The snippets (rows of WIDTH bytes: the bytes, then the first and the end of its windows) and where they begin."""
    begin = place - (WINDOWS - 1)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    gap = b"\0" * SNIPPET
    buf = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    at = SNIPPET + np.cumsum(lens + SNIPPET) - (lens + SNIPPET)
    out = np.empty((len(number), WIDTH), np.uint8)
    out[:, :SNIPPET] = np.lib.stride_tricks.sliding_window_view(buf, SNIPPET)[at[number] + begin]
    out[:, SNIPPET] = np.maximum(0, -begin)
    out[:, SNIPPET + 1] = np.minimum(WINDOWS, lens[number] - LENGTH - begin + 1)
    return out, begin


NARROW = "seed bigint, key_a bigint, key_b bigint, doc_id bigint, text_key bigint, begin int, mask bigint"
WIDE = "seed bigint, snippet binary, doc_id bigint"


def _rows(seed: np.ndarray, ids: list, texts: list[bytes], number: np.ndarray, place: np.ndarray, with_text: bool) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(seed), 1 << 16):
        some = slice(k, k + (1 << 16))
        snippets, begin = cut(texts, number[some], place[some])
        ids_at = pa.array(ids, pa.int64()).take(pa.array(number[some]))
        if with_text:
            yield pa.RecordBatch.from_arrays([pa.array(seed[some].view(np.int64)), _fixed(snippets), ids_at], names=["seed", "snippet", "doc_id"])
            continue
        a, b = snippet_keys(snippets)
        keys = {n: text_key(texts[n]) for n in set(number[some].tolist())}
        low, high = snippets[:, SNIPPET].astype(np.int64), snippets[:, SNIPPET + 1].astype(np.int64)
        columns = [seed[some].view(np.int64), a, b, ids_at, [keys[n] for n in number[some].tolist()], begin.astype(np.int32), (1 << high) - (1 << low)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "key_a", "key_b", "doc_id", "text_key", "begin", "mask"])


def _snippets(bucket_bits: int, shared, bits: int, with_text: bool):
    """Occurrences of the seeds in the filter: with their snippets, or with documents and places and the snippets' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _raw(batch, 1)
            h, number, place = seeds([t if d is not None else b"" for d, t in zip(ids, texts)])
            h = h >> np.uint64(32 - bucket_bits)
            if len(h):
                hit = np.flatnonzero(_has(seen, _positions(_spread(h), bits)).all(axis=1))
                yield from _rows(h[hit], ids, texts, number[hit], place[hit], with_text)

    return run


def _all_places(bucket_bits: int):
    """Every seed with its document and place, and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _raw(batch, 1)
            h, number, place = seeds([t if d is not None else b"" for d, t in zip(ids, texts)])
            h = h >> np.uint64(32 - bucket_bits)
            keys = {n: text_key(texts[n]) for n in set(number.tolist())}
            columns = [h.view(np.int64), pa.array(ids, pa.int64()).take(pa.array(number)), pa.array([keys[n] for n in number.tolist()], pa.int64()), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["seed", "doc_id", "text_key", "place"])

    return run


def _cut_listed(with_text: bool):
    """doc_id, text, spots (seed, place) -> as _snippets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spots = batch.column(0).to_pylist(), _raw(batch, 1), batch.column(2).to_pylist()
            number = np.repeat(np.arange(len(ids)), [len(x) for x in spots])
            seed, place = (np.array([p[c] for x in spots for p in x], dtype=np.int64) for c in ("seed", "place"))
            yield from _rows(seed.view(np.uint64), ids, texts, number, place, with_text)

    return run


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys below 2**32: one counting sort for each 16 bits in use."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and int(keys.max()) >> 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def letters(group: np.ndarray, strings: np.ndarray) -> list[np.ndarray]:
    """The columns of the strings' letters, numbered by rank: the group first, then eight bytes each."""
    padded = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    padded[:, : strings.shape[1]] = strings
    words = padded.view(">u8").astype(np.uint64)
    return [group.astype(np.uint32), *(np.unique(words[:, k], return_inverse=True)[1].astype(np.uint32) for k in range(words.shape[1]))]


class Transform:
    """The positional transform of a shard: its strings in order, and of each column the letters in the order of what follows."""

    def __init__(self, columns: list[np.ndarray], begin: int, end: int):
        order, self.columns = np.arange(begin, end), []
        for column in reversed(columns):
            self.columns.append(column[order])
            order = order[_stable_order(self.columns[-1])]
        self.order = order


def merge(shards: list[Transform]) -> np.ndarray:
    """The order of the strings of all shards, from their letters alone."""
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.order) for s in shards])
    for column in zip(*(s.columns for s in shards)):
        rows = np.argsort(interleave, kind="stable")  # merged places of shard 0's rows in order, then of shard 1's
        here = np.empty(len(rows), np.uint32)
        here[rows] = np.concatenate(column)
        interleave = interleave[_stable_order(here)]
    merged = np.empty(len(interleave), np.int64)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate([s.order for s in shards])
    return merged


def common_prefixes(group: np.ndarray, strings: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the strings by group and bytes, and the bytes each shares with the one before it (-1: other group)."""
    columns = letters(group, strings)
    order = merge([Transform(columns, k, min(k + shard, len(strings))) for k in range(0, len(strings), shard)])
    there = strings[order]
    differ = np.concatenate([there[1:] != there[:-1], np.ones((len(there) - 1, 1), bool)], axis=1)
    shared = np.concatenate([[-1], differ.argmax(axis=1)])
    shared[1:][group[order][1:] != group[order][:-1]] = -1
    return order, shared


def least_documents(group: np.ndarray, snippets: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """(snippets, WINDOWS): the least doc_id of the group in which each window occurs; windows outside low..high have none."""
    n, middle = len(snippets), WINDOWS - 1
    right, shared_right = common_prefixes(group, snippets[:, middle:SNIPPET], shard)
    left, shared_left = common_prefixes(group, snippets[:, middle - 1 :: -1], shard)
    out = np.full((n, WINDOWS), np.iinfo(np.int64).max)
    at_right, at_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for w in range(WINDOWS):  # the window's bytes: middle - w to the left of the seed, the seed, and w to the right
        at_right[right] = np.cumsum(shared_right < SEED + w)
        at_left[left] = np.cumsum(shared_left < middle - w)
        rows = np.flatnonzero((low <= w) & (w < high))
        if not len(rows):
            continue
        kind = at_right[rows] * (n + 1) + at_left[rows]
        order = np.argsort(kind)
        kind, rows = kind[order], rows[order]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        out[rows, w] = np.repeat(np.minimum.reduceat(doc[rows], starts), np.diff(np.append(starts, len(rows))))
    return out


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key_a, key_b, least, mask: windows (bits of mask) of the snippet that document ``least`` has first."""

    def handle(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, most = t.column("doc_id").to_numpy(), t.column("last").to_numpy()
        whole = np.frombuffer(b"".join(t.column("snippet").to_pylist()), np.uint8).reshape(-1, WIDTH)
        low, high = whole[:, SNIPPET].astype(np.int64), whole[:, SNIPPET + 1].astype(np.int64)
        edges = np.append(starts, len(whole))
        group = np.repeat(np.arange(len(starts)), np.diff(edges))
        begin = 0
        while begin < len(starts):  # groups stay whole; a dealt one is bounded
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + MERGE, side="right")) - 1)
            part = slice(int(edges[begin]), int(edges[end]))
            begin = end
            first = least_documents(group[part] - group[part.start], whole[part, :SNIPPET], low[part], high[part], doc[part])
            first[first >= most[part][:, None]] = np.iinfo(np.int64).max
            # one row for each snippet and least document: its windows as bits
            rows, w = np.nonzero(first < np.iinfo(np.int64).max)
            if not len(rows):
                continue
            least = first[rows, w]
            order = np.lexsort((least, rows))
            rows, w, least = rows[order], w[order], least[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (least[1:] != least[:-1])]))
            masks = np.add.reduceat(np.int64(1) << w, new)
            a, b = snippet_keys(whole[part][rows[new]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(least[new]), pa.array(masks)], names=["key_a", "key_b", "least", "mask"])

    return groups(batches, handle, rows=2 * MERGE)


def removed_spans(n: int, begins: list[int], masks: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that start at begin + bit."""
    if not begins:
        return []
    bits = (np.array(masks, dtype=np.int64)[:, None] >> np.arange(WINDOWS)) & 1
    at = np.unique((np.array(begins, dtype=np.int64)[:, None] + np.arange(WINDOWS))[bits == 1])
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.append(cut, len(at) - 1)] + LENGTH).tolist()))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, spots in zip(_raw(batch, 1), batch.column(2).to_pylist()):
            spans = removed_spans(len(raw), [s["begin"] for s in spots or ()], [s["mask"] for s in spots or ()])
            edges = [0, *(x for span in spans for x in span), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(raw), len(raw) - len(kept), len(spans), kept))
        counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _occurrences(docs: DataFrame, of: DataFrame, bucket_bits: int, filter_bits: int, with_text: bool) -> DataFrame:
    """Where the seeds of ``of`` (a written table of n rows) occur: NARROW, or WIDE with the snippets."""
    shared, bits = seed_filter(of, of.metrics["n"], filter_bits)
    schema = WIDE if with_text else NARROW
    if shared is not None:
        return docs.mapInArrow(_snippets(bucket_bits, shared, bits, with_text), schema)
    places = docs.mapInArrow(_all_places(bucket_bits), "seed bigint, doc_id bigint, text_key bigint, place int").join(of.select("seed"), "seed", "left_semi")
    spots = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("seed", "place")).alias("spots"))  # at most a text's own
    keyed = docs.where("doc_id is not null").mapInArrow(_with_key, "doc_id bigint, text string, text_key bigint")
    return keyed.join(spots, ["doc_id", "text_key"]).select("doc_id", "text", "spots").mapInArrow(_cut_listed(with_text), schema)


def remove_repeats(docs: DataFrame, filter_bits: int = FILTER_BITS, seed_cap: int = SEED_CAP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    bucket_bits = min(31, max(4, (2 * text_bytes(docs) // (WINDOWS + 1) // BUCKET_SEEDS).bit_length()))
    seen = docs.mapInArrow(_counted(bucket_bits), "bucket bigint, once binary, more binary").repartition("bucket")
    repeated = written(seen.mapInArrow(_repeated, "seed bigint"), "repeated-seeds", n=F.count(F.lit(1)))
    places = _occurrences(docs, repeated, bucket_bits, filter_bits, False)
    key = F.struct("key_a", "key_b")
    ends = [F.min(key).alias("key"), F.max(key).alias("other"), F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.min("mask").alias("mask")]
    by_seed = written(places.groupBy("seed").agg(*ends).where("least < last").drop("last"), "seeds")
    one = by_seed.where("key = other").select("key.key_a", "key.key_b", "least", "mask")
    several = written(by_seed.where("key <> other").select("seed"), "compared-seeds", n=F.count(F.lit(1)))
    distinct = _occurrences(docs, several, bucket_bits, filter_bits, True).groupBy("seed", "snippet").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    distinct = written(distinct.select(F.lit(0).alias("table"), F.col("seed").alias("key"), "snippet", "doc_id", "last"), "snippets")
    decided = written(dealt(distinct, "snippet", seed_cap).mapInArrow(_decided, "key_a bigint, key_b bigint, least bigint, mask bigint"), "repeats")
    discard(several, distinct)
    spots = places.select("key_a", "key_b", "doc_id", "text_key", "begin").join(decided.unionByName(one), ["key_a", "key_b"]).where("least < doc_id")
    spots = spots.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "mask")).alias("spots"))
    keyed = docs.mapInArrow(_with_key, "doc_id bigint, text string, text_key bigint")
    joined = keyed.join(spots, ["doc_id", "text_key"], "left").select("doc_id", "text", "spots")
    return joined.mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_key(t) for t in _raw(batch, 1)], pa.int64())], names=["doc_id", "text", "text_key"])


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
