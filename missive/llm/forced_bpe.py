"""Byte-pair encoding by forced boundaries, and decoding.

A pair of bytes that stands side by side in no token of the vocabulary can never come to stand
inside one, so there is a certain cut between the two, in any text. No token holds a blank, so
texts are first cut at blanks and line ends: each distinct piece is worked out once by a worker
and kept in a cache of bounded bytes. A new piece goes through the file's normalizer and
pre-tokenizer (neither looks beyond a blank); each of its words is cut at all certain cuts, and
the distinct fragments are encoded one by one by the file's merges. A fragment that ends a word
bears the file's end-of-word mark, any other fragment has none. A piece's ids are those of its
fragments in order, a text's ids those of its pieces, equal to the library's ids of the whole text.

Pieces that hold one of the file's added tokens (which the library finds before all else) are cut
there, and the parts between are worked out as other pieces are.

Documents never shuffle: a task encodes the texts of its own rows. Defined results: a null text
is an empty one and has no ids; a text of blanks has none; rows of repeated or null ids are
encoded each for itself; columns other than doc_id and text are ignored; an empty table gives no rows;
a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import prepare, table, text_or_empty
from missive.llm.tokens import WordCachedTokenizer

#: Characters of text that a worker cuts and gathers at once.
BLOCK_CHARS = 1 << 20
#: White space that pieces are cut at; the rest is left to the file's normalizer.
CUTS = re.compile(r"[ \n\t\r]+")


class ForcedBoundaries:
    """The certain cuts of a vocabulary, and its merges with and without the end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = set()
        for token in model["vocab"]:
            token = token.removesuffix(self.suffix) if self.suffix else token
            pairs.update(a + b for a, b in zip(token, token[1:]))
        self.letters = {c: i for i, c in enumerate(sorted({c for p in pairs for c in p}))}
        n = len(self.letters) + 1  # the last letter stands in no pair
        self.forced = np.ones((n, n), bool)
        for a, b in pairs:
            self.forced[self.letters[a], self.letters[b]] = False
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        same = {"vocab": model["vocab"], "merges": merges, "unk_token": model["unk_token"], "fuse_unk": model["fuse_unk"], "byte_fallback": model["byte_fallback"]}
        self.last = BPE(**same, end_of_word_suffix=self.suffix or None)
        self.inner = BPE(**same)

    def cuts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The fragments of all words, one word after the other, and how many each has."""
        text, none = "".join(words), len(self.letters)
        codes = np.fromiter((self.letters.get(c, none) for c in text), np.int32, len(text))
        ends = np.cumsum([len(w) for w in words])
        cut = self.forced[codes[:-1], codes[1:]]
        cut[ends[:-1] - 1] = True
        places = np.append(np.flatnonzero(cut) + 1, len(text))
        fragments = [text[a:b] for a, b in zip([0, *places[:-1].tolist()], places.tolist())]
        return fragments, np.diff(np.searchsorted(places, ends, side="right"), prepend=0)

    def ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (non-empty, in the file's byte letters): of its fragments, each encoded once."""
        if not words:
            return []
        fragments, counts = self.cuts(words)
        last = np.zeros(len(fragments), bool)
        last[np.cumsum(counts) - 1] = True
        known: dict[tuple[str, bool], list[int]] = {}
        found = []
        for key in zip(fragments, last.tolist()):
            if key not in known:
                known[key] = [t.id for t in (self.last if key[1] else self.inner).tokenize(key[0])]
            found.append(known[key])
        out, at = [], 0
        for n in counts.tolist():
            out.append([i for part in found[at : at + n] for i in part])
            at += n
        return out


class ForcedTokenizer(WordCachedTokenizer):
    """Ids of whole texts by forced boundaries; the cache of pieces is that of its base."""

    _open: dict[str, "ForcedTokenizer"] = {}

    def __init__(self, path: str):
        super().__init__(path)
        self.bounds = ForcedBoundaries(path)
        self.added_ids = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        self.added_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added_ids, key=len, reverse=True))) + ")") if self.added_ids else None

    def _has_added(self, text: str) -> bool:
        return False  # pieces are cut at added tokens

    def _cuts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        plain = pc.replace_substring_regex(pa.array(texts, pa.string()), r"[\n\t\r]", " ")
        lists = pc.split_pattern(plain, " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)

    def _learn(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of pieces; all their words are cut and encoded together."""
        parts: list[list[int] | slice] = []  # ids of an added token, or a run of words
        owner, words = [], []
        for k, piece in enumerate(cuts.to_pylist()):
            for part in self.added_cut.split(piece) if self.added_cut else [piece]:
                if part in self.added_ids:
                    parts.append([self.added_ids[part]])
                elif part:
                    ready = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
                    parts.append(slice(len(words), len(words) + len(ready)))
                    words += ready
                else:
                    continue
                owner.append(k)
        ids = self.bounds.ids(words)
        rows: list[list[int]] = [[] for _ in range(len(cuts))]
        for k, part in zip(owner, parts):
            rows[k] += part if isinstance(part, list) else [i for w in ids[part] for i in w]
        return np.array([len(r) for r in rows], dtype=np.int64), np.array([i for r in rows for i in r], dtype="<u4")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a long one is cut at blanks, so that only its ids are held whole."""
        parts: list[str] = []
        ends: list[int] = []
        for text in texts:
            at = 0
            while len(text) - at > BLOCK_CHARS and (m := CUTS.search(text, at + BLOCK_CHARS)):
                parts.append(text[at : m.start()])
                at = m.end()
            parts.append(text[at:])
            ends.append(len(parts))
        held, begin, text, size = [], 0, 0, 0
        for k, part in enumerate(parts):
            size += len(part)
            if size < BLOCK_CHARS and k + 1 < len(parts):
                continue
            held += self._by_words(parts[begin : k + 1])
            begin, size = k + 1, 0
            while text < len(ends) and ends[text] <= begin:
                n = ends[text] - (ends[text - 1] if text else 0)
                yield held[0] if n == 1 else np.concatenate(held[:n])
                held, text = held[n:], text + 1
            pa.default_memory_pool().release_unused()


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ForcedTokenizer.at(path)
        for batch in batches:
            ids = list(tok.encode(batch.column(1).to_pylist()))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (array of int)."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_encoded(path), "doc_id bigint, ids array<int>")


class Decoder:
    """Texts of ids, for files without a decoder: their tokens, special ones too, joined by blanks."""

    _open: dict[str, "Decoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer = tokenizer if tokenizer.decoder is not None else None
        size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.tokens = pa.array([tokenizer.id_to_token(i) for i in range(size)], pa.string())

    @classmethod
    def at(cls, path: str) -> "Decoder":
        if path not in cls._open:
            cls._open.clear()
            cls._open[path] = cls(path)
        return cls._open[path]

    def texts(self, ids: pa.ListArray) -> pa.Array:
        if self.tokenizer is not None:
            return pa.array([self.tokenizer.decode(row or [], skip_special_tokens=False) for row in ids.to_pylist()], pa.string())
        flat = ids.flatten()
        known = pc.less(flat, len(self.tokens))
        if not pc.all(known, min_count=0).as_py():  # ids of no token are left out, as by the library
            return pa.array([" ".join(t for t in self.tokens.take(pa.array([i for i in row or [] if i < len(self.tokens)], pa.int32())).to_pylist() if t) for row in ids.to_pylist()], pa.string())
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.tokens.take(flat)), " ")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.at(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], batch.column(batch.num_columns - 1), decoder.texts(batch.column(batch.num_columns - 1))], names=[*batch.schema.names, "decoded"])

    return run


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows, of which the last column is ids, with decoded: the text of these ids."""
    prepare(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_decoded(path), f"{fields}, decoded string")


def op12_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    numbers = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
