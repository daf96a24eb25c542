"""Spelling groups, forced-boundary BPE and vector codes against brute force, on messy and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from missive.llm import forced_bpe, spelling, vector_codes

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, word string, n string, ids string, form string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 11


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    near = defaultdict(list)
    by_size = defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    for w in counts:
        for other in [o for k in (-1, 0, 1) for o in by_size[len(w) + k]]:
            if one_edit(w, other):
                near[w].append(other)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def groups_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


MESSY = [
    (1, None), (2, ""), (3, " \n\t "), (None, "colour colour colour color color color"), (4, "Colour colours colour colour " * 4), (5, "color, colr colr colr"), (5, "color, colr colr colr"),
    (6, "aaaaaa " * 9 + "aaaaaaa " * 4 + "aaaaa " * 3 + "aaaabaa " * 3), (7, "Élégant élégant ÉLÉGANT elegant elegant elegant élegant " * 3), (8, "x" * 5000 + " " + "x" * 4999 + " "), (8, ("x" * 5000 + " " + "x" * 4999 + " ") * 3),
    (9, "ab×cd÷ef ab×cd÷ef ab×cd÷ef ab×cd÷eg ab×cd÷eg ab×cd÷eg"), (10, "naïve naive naive naive Ωmega Ωmega Ωmega"), (11, "word " * 3 + "words " * 9 + "swords " * 20 + "swordss " * 3),
]


@pytest.mark.parametrize("cap", [2000, 2])
def test_spelling_groups_equal_brute_force(spark, cap):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(40)]
    extra = [(100 + k, " ".join(rng.choice(stems) for _ in range(60))) for k in range(20)]
    rows = MESSY + extra
    assert groups_of(spelling.spelling_groups(docs_of(spark, rows), cap=cap)) == brute_groups(rows)


def test_spelling_groups_of_real_texts(spark, real):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    assert groups_of(spelling.spelling_groups(real)) == brute_groups(rows)


def test_spelling_groups_empty(spark):
    assert spelling.spelling_groups(docs_of(spark, [])).collect() == []
    assert spelling.spelling_groups(docs_of(spark, MESSY[:3])).collect() == []


def test_chunks_and_grams_meet_for_every_edit(spark):
    """Each word one edit away shares a key, on whichever side it stands."""
    word = "abcdefg"
    edits = {word[:i] + word[i + 1 :] for i in range(7)} | {word[:i] + "z" + word[i + 1 :] for i in range(7)} | {word[:i] + "z" + word[i:] for i in range(8)}
    pairs = spelling.near_words(spark.createDataFrame([(w, 3) for w in {word} | edits], "word string, n bigint")).collect()
    met = {r["other"] for r in pairs if r["word"] == word} | {r["word"] for r in pairs if r["other"] == word}
    assert met == edits
    assert len({(r["word"], r["other"]) for r in pairs}) == len(pairs)


# 12


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


TEXTS = [None, "", "   ", "qzqx jxq it's don't 'S 12½ ９", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "x" * 30_000, "İ Σας ẛ̣ é é　日本語 😀‍\0\x1c\x85", "<|endoftext", "a\n\r\tb  c", "word " * 5000]


def test_forced_bpe_equals_the_library(spark, plain, real, monkeypatch):
    monkeypatch.setattr(forced_bpe, "BLOCK_CHARS", 500)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")] + [tuple(r) for r in real.select("doc_id", "text").collect()]
    found = forced_bpe.decoded(forced_bpe.encoded(docs_of(spark, rows), BPE), BPE).collect()
    want = []
    for doc, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        want.append((doc, ids, plain.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert forced_bpe.encoded(docs_of(spark, []), BPE).collect() == []


def test_query_digests(spark, plain):
    found = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in __import__("missive.llm.queries", fromlist=["QUERIES"]).QUERIES["op12_forced_bpe"](spark, SF).collect():
        ids = plain.encode(found[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["qz", "'s", "'re", " ", "\n", "<|endoftext|>", "hello", "Don't", "́", "　", "ﬁ", "日", "9"]), st.text(max_size=6)), max_size=20).map("".join))
def test_forced_boundaries_equal_the_library(text):
    from tokenizers import Tokenizer

    tok, plain = forced_bpe.ForcedTokenizer.at(BPE), Tokenizer.from_file(BPE)
    assert next(iter(tok.encode([text]))).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_fragments_are_cut_where_no_token_goes_on():
    bounds = forced_bpe.ForcedBoundaries(BPE)
    fragments, counts = bounds.cuts(["abqzcd", "the"])
    assert "".join(fragments) == "abqzcdthe" and counts.sum() == len(fragments) and counts[0] == 2 and fragments[0] == "abq"


def test_decoder_leaves_out_unknown_ids(plain):
    ids = [[320, 49407], [], [320, 60_000, 49406], None]
    found = forced_bpe.Decoder(BPE).texts(pa.array(ids, pa.list_(pa.int32()))).to_pylist()
    assert found == [plain.decode(x or [], skip_special_tokens=False) for x in ids]


# 13


def brute_codes(rows, entries=256, rounds=4):
    """Plain loops over whole numbers."""
    kept = []
    for vec, x, label in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec, [max(-(1 << 24), min(1 << 24, math.floor(1024 * float(v)))) for v in x], label))
    sizes = Counter(len(x) for _, x, _ in kept)
    dim = max(sizes, key=lambda d: (sizes[d], d), default=0)
    kept = sorted((k for k in kept if len(k[1]) == dim), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    cut = [p * dim // 4 for p in range(5)]
    part = lambda x, p: x[cut[p] : cut[p + 1]]
    books = [[part(x, p) for _, x, _ in kept[:entries]] for p in range(4)]

    def best(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(x, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            at = defaultdict(list)
            for _, x, _ in kept:
                at[best(x, p)[1]].append(part(x, p))
            books[p] = [[sum(c) // len(at[k]) for c in zip(*at[k])] if at[k] else e for k, e in enumerate(books[p])]
    found = [(vec, [best(x, p) for p in range(4)], label) for vec, x, label in kept]
    sums = Counter()
    for _, b, label in found:
        sums[label] += sum(d for d, _ in b)
    text = ",".join(str(v) for book in books for e in book for v in e)
    return sorted(((vec, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), sums[label]) for vec, b, label in found), key=repr), hashlib.sha256(text.encode()).hexdigest()


VECTORS = "vec_id bigint, embedding array<double>, label int, x string, code string, part string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)


def messy_vectors(dim, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.integers(-3, 4, dim) / 2.0 ** rng.integers(0, 9)).tolist(), int(rng.integers(0, 3)) if k % 5 else None) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * dim, 1), (n + 2, [math.nan] * dim, 1), (n + 3, [math.inf] + [0.0] * (dim - 1), None), (n + 4, [1.0] * (dim + 1), 2), (n + 5, [], 2)]
    rows += [(None, [0.25] * dim, None), (3, [0.25] * dim, 7), (3, [-0.25] * dim, 7), (n + 6, [1e300] * dim, 8), (n + 7, [-1e300] * dim, 8)] + [(n + 8 + k, [0.5] * dim, 9) for k in range(40)]
    return rows


@pytest.mark.parametrize("dim,n,step", [(8, 300, 1024), (6, 40, 3), (3, 270, 16), (64, 60, 1024)])
def test_vector_codes_equal_brute_force(spark, monkeypatch, dim, n, step):
    monkeypatch.setattr(vector_codes, "STEP", step)
    rows = messy_vectors(dim, n, dim)
    found, books = vector_codes.vector_codes(vectors_of(spark, rows))
    want, digest = brute_codes(rows)
    assert sorted(map(tuple, found.select("vec_id", "code", "error", "label_error").collect()), key=repr) == want
    assert vector_codes.digest(books) == digest


def test_vector_codes_of_nothing(spark):
    found, books = vector_codes.vector_codes(vectors_of(spark, []))
    assert found.collect() == [] and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert vector_codes.vector_codes(vectors_of(spark, [(1, None, 1)]))[0].collect() == []


def test_hot_labels_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_BUCKETS", 0)
    rows = messy_vectors(8, 50, 2)
    found, _ = vector_codes.vector_codes(vectors_of(spark, rows))
    assert sorted(map(tuple, found.select("vec_id", "code", "error", "label_error").collect()), key=repr) == brute_codes(rows)[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(1, 40), st.integers(1, 9), st.integers(0, 10**6))
def test_trie_walk_is_the_nearest_entry(n, width, k, spread, seed):
    rng = np.random.default_rng(seed)
    rows, place = vector_codes.ordered(rng.integers(-spread, spread + 1, (n, width)))
    book = rng.integers(-spread, spread + 1, (k, width))
    held, vector_codes.STEP = vector_codes.STEP, 7
    try:
        codes, distances = vector_codes.nearest(rows, book)
    finally:
        vector_codes.STEP = held
    d = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (codes == d.argmin(axis=1)).all() and (distances == d.min(axis=1)).all() and len(place) == n
