"""Token ids of whole texts by the ``tokenizers`` library, with a cache of words bounded in bytes.

A byte-level BPE with the usual pre-tokenizer never merges across a blank that is
followed by a non-blank: each such blank begins a new pre-token. Texts are cut there,
each distinct cut is encoded once by the library, and a text's ids are the ids of its
cuts in order, equal to the ids of the whole text. Texts that contain one of the file's
added tokens are encoded whole, since those tokens are found before any cut.

Cuts are counted and looked up as Arrow arrays, and ids are gathered by numpy, so the
cache holds plain buffers: a word's bytes, its ids and three numbers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the cached words and their ids in one Python worker; the least lately used half goes beyond it.
CACHE_BYTES = 24 << 20
#: Longer cuts aren't kept. Characters of text that are cut and gathered at once.
LONGEST_CACHED, BLOCK_CHARS = 64, 4 << 20
_GAP, _CUT = re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class WordCachedTokenizer:
    """Ids as little-endian unsigned 32-bit integers; one instance per Python worker and file."""

    _open: dict[str, "WordCachedTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], dtype=np.int64)
        self.turn = 0
        self._keep(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int32))

    @classmethod
    def at(cls, path: str) -> "WordCachedTokenizer":
        if path not in cls._open:
            cls._open.clear()  # a worker serves one file at a time
            cls._open[path] = cls(path)
        return cls._open[path]

    def _keep(self, words: pa.Array, starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray, used: np.ndarray) -> None:
        """Makes these the cached words, less the half that was used least lately if they are too many bytes."""
        nbytes = lambda w, s: w.nbytes + 4 * int(s.sum()) + 20 * len(w)
        while len(words) and nbytes(words, sizes) > CACHE_BYTES:
            stay = np.sort(np.argsort(-used, kind="stable")[: len(used) // 2])
            words, starts, sizes, used = words.take(pa.array(stay)), starts[stay], sizes[stay], used[stay]
        pool = pool[_spread(starts, sizes)]
        self.words, self.starts, self.sizes, self.pool, self.used = words, np.cumsum(sizes) - sizes, sizes, pool, used

    def _has_added(self, text: str) -> bool:
        return any(content in text for content in self.added)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of cuts; a cut that begins with a blank is a text's first, the others follow a blank.

        Many of the others are encoded as one text, whose ids are cut at their byte lengths.
        """
        heads = np.asarray(pc.starts_with(cuts, " ").to_numpy(zero_copy_only=False), dtype=bool)
        sizes, pieces = np.zeros(len(cuts), np.int64), []
        first = self._whole([c[1:] for c in cuts.filter(pa.array(heads)).to_pylist()])
        sizes[heads] = [len(x) for x in first]
        later = np.flatnonzero(~heads)
        for at in range(0, len(later), 4000):
            some = later[at : at + 4000]
            part = cuts.take(pa.array(some))
            text = " " + " ".join(part.to_pylist())
            if self._has_added(text):  # made by joining: no text has it
                each = self._whole([" " + c for c in part.to_pylist()])
                sizes[some] = [len(x) for x in each]
                pieces += each
                continue
            ids = self._whole([text])[0]
            ends = np.cumsum(pc.binary_length(part).to_numpy().astype(np.int64) + 1)
            marks = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
            sizes[some] = np.diff(marks, prepend=0)
            pieces.append(ids)
        # pieces hold the later cuts in order, first the heads: bring both into the order of cuts
        flat = np.concatenate([*first, *pieces]) if first or pieces else np.zeros(0, "<u4")
        order = np.concatenate([np.flatnonzero(heads), later])
        starts = np.zeros(len(cuts), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, flat[_spread(starts, sizes)]

    def _cuts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The cuts of all texts, one text after the other, and how many each has."""
        if any(map(_GAP.search, texts)):
            rows = []
            for text in texts:
                parts = text.split(" ")
                cut = [" " + parts[0]]
                for w in parts[1:]:
                    if not w or w[0].isspace():
                        cut[-1] += " " + w
                    else:
                        cut.append(w)
                rows.append(cut)
            return pa.array([c for row in rows for c in row], pa.string()), np.array([len(row) for row in rows])
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        flat = lists.flatten()
        first = np.zeros(len(flat), bool)
        first[np.cumsum(counts) - counts] = True
        heads = pa.array([" " + t for t in flat.filter(pa.array(first)).to_pylist()], pa.string())
        return pc.replace_with_mask(flat, pa.array(first), heads), counts

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        cuts, counts = self._cuts(texts)
        coded = cuts.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        found = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy()
        self.turn += 1
        new = np.flatnonzero(found < 0)
        learnt = distinct.take(pa.array(new))
        sizes_new, ids_new = self._learn(learnt)
        known = found >= 0
        self.used[found[known]] = self.turn
        starts, sizes = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        starts[known], sizes[known] = self.starts[found[known]], self.sizes[found[known]]
        starts[new], sizes[new] = len(self.pool) + np.cumsum(sizes_new) - sizes_new, sizes_new
        pool = np.concatenate([self.pool, ids_new])
        ids = pool[_spread(starts[which], sizes[which])]
        per_text = np.add.reduceat(sizes[which], np.cumsum(counts) - counts) if len(counts) else counts
        short = pc.binary_length(learnt).to_numpy() <= LONGEST_CACHED
        new = new[short]
        self._keep(
            pa.concat_arrays([self.words, learnt.filter(pa.array(short))]), np.concatenate([self.starts, starts[new]]), np.concatenate([self.sizes, sizes[new]]),
            pool, np.concatenate([self.used, np.full(len(new), self.turn, np.int32)]),
        )
        return np.split(ids, np.cumsum(per_text)[:-1])

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        parts: list[str] = []
        owner: list[int] = []  # long texts are several parts, cut where the library cuts too
        texts = list(texts)
        whole = {}
        for i, text in enumerate(texts):
            if self._has_added(text):
                whole[i] = self._whole([text])[0]
                continue
            at = 0
            while len(text) - at > BLOCK_CHARS and (m := _CUT.search(text, at + BLOCK_CHARS)):
                parts.append(text[at : m.start()])
                owner.append(i)
                at = m.start()
            parts.append(text[at:])
            owner.append(i)
        found: dict[int, list[np.ndarray]] = {}
        begin = 0
        while begin < len(parts):
            end, size = begin, 0
            while end < len(parts) and (end == begin or size + len(parts[end]) <= BLOCK_CHARS):
                size += len(parts[end])
                end += 1
            for i, ids in zip(owner[begin:end], self._by_words(parts[begin:end])):
                found.setdefault(i, []).append(ids)
            begin = end
        pa.default_memory_pool().release_unused()
        return [whole[i] if i in whole else found[i][0] if len(found[i]) == 1 else np.concatenate(found[i]) for i in range(len(texts))]
