"""The numbered operators against brute force, on small fixtures and on messy rows."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from missive.llm import bwt_dedup, chat, embedding_dedup, line_dedup, minhash, mixing, packing, simhash, token_store, toxicity
from missive.llm.tokens import WordCachedTokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, score string, size string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "x", "y", "z") for d, t, s in rows], SCHEMA)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


BASE = words(120, 1)
MESSY = [
    (1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one", "b"), (5, BASE, "b"), (6, BASE, "b"), (7, BASE.replace("a", "a", 1) + " tail end", "a"),
    (8, words(90, 2) + " " + BASE[:200] + " " + words(40, 3), None), (9, "x" * 30_000, "c"), (10, words(8000, 4), "c"), (None, BASE, None), (11, "Ünïcödé ñandú 日本 " * 40, "b"), (11, "Ünïcödé ñandú 日本 " * 40, "b"), (12, "a\n\nB \n a\na", "a"),
    (13, "head " + "\0" * 90 + " one", "b"), (14, "\0" * 75 + " tail", "b"),
]


@pytest.fixture(scope="module")
def messy(spark):
    return docs_of(spark, MESSY)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1


def brute_links(rows, t=0.95):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            a = np.asarray(v, dtype=np.float64)
            unit[k] = a / np.linalg.norm(a)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for a, b in itertools.combinations(unit, 2):
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= t:
            n[a] += 1
            n[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {(i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("cap, small", [(4096, 64), (20, 64), (4096, 4)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, cap, small):
    monkeypatch.setattr(embedding_dedup, "BUCKET_CAP", cap)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 64))
    rows = []
    for k in range(400):
        c = centres[k % 30] if k % 3 else centres[0]
        rows.append((k, [float(x) for x in (c + rng.standard_normal(64) * 0.2 * (k % 4))]))
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, None), (403, [0.0] * 64), (404, [float("nan")] + [1.0] * 63), (405, [None] + [1.0] * 63), (406, [1.0, 0.0]), (407, [2.0, 0.0]), (408, []), (409, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in embedding_dedup.linked_vectors(df).collect()}
    assert got == brute_links(rows)
    assert {r["vec_id"]: r["component_id"] for r in embedding_dedup.linked_vectors(df, recall=1, confidence=float("inf")).collect()} == {i: c for i, _, c, _ in got}


def test_embedding_exact_mode_and_null_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.standard_normal(5)]) for k in range(300)] + [(None, [1.0] * 5), (7, [2.0] * 5), (None, None), (301, [3.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"]) for r in embedding_dedup.linked_vectors(df, recall=1, confidence=float("inf")).collect())
    assert got == sorted((str(i), n) for i, n in brute_counts(rows))


def brute_counts(rows, t=0.95):
    unit = [np.asarray(v) / np.linalg.norm(v) if v and None not in v and np.any(v) else None for _, v in rows]
    for k, (i, _) in enumerate(rows):
        yield i, sum(1 for m, u in enumerate(unit) if m != k and u is not None and unit[k] is not None and len(u) == len(unit[k]) and u @ unit[k] >= t)


@pytest.mark.parametrize("bits, skewed", [(4, False), (6, True), (8, False), (12, True), (17, True), (20, False), (24, True), (28, False)])
def test_embedding_candidates_at_the_threshold(bits, skewed):
    """Pairs of cosine 0.9501 share a key and pass the estimates; skewed: most of a vector's length in two places."""
    rng, n, dim = np.random.default_rng(bits), 20_000, 64
    x = rng.standard_normal((n, dim)) * (np.array([9.0, 9.0, *[0.3] * (dim - 2)]) if skewed else 1.0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((n, dim))
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * other
    plan = bits, math.ceil(math.log(1 - embedding_dedup.RECALL) / math.log(1 - (1 - math.acos(0.95) / math.pi) ** bits))
    a, keys_a = embedding_dedup.coded(x, plan)
    b, keys_b = embedding_dedup.coded(y, plan)
    assert (keys_a == keys_b).any(axis=1).mean() > 0.999
    lost = 0
    for k in range(400):
        pair = embedding_dedup.Coded([a[k].tobytes(), b[k].tobytes()], dim, plan, 0.95, embedding_dedup.CONFIDENCE)
        one, two = pair.block(slice(0, 2), slice(0, 2)), pair.listed(np.array([0]), np.array([1]))
        assert [x.tolist() for x in one] == [x.tolist() for x in two]
        lost += not len(one[0])
    assert lost == 0


def test_embedding_empty(spark):
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(1, 120))
def test_knapsack_is_nearest(items, budget):
    taken = mixing.knapsack([s for s, _ in items], [c for _, c in items], budget)
    sums = {sum(s * k for (s, _), k in zip(items, ks)) for ks in itertools.product(*[range(c + 1) for _, c in items])}
    assert all(0 <= taken.get(s, 0) <= c for s, c in items)
    assert abs(sum(s * k for s, k in taken.items()) - budget) == min(abs(x - budget) for x in sums)


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixed_documents_are_the_rows_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_GROUP", 8)
    schema = "doc_id bigint, text string, source string, size string, order_ string, plan_ string, copies int"
    rows = [(k % 9 if k % 4 else None, words(3 + k % 2, k % 50), "ab"[k % 2] if k % 5 else None, "s", "o", "p", k % 2) for k in range(400)]
    rows += [(1, "one two three", "a", "s", "o", "p", 0)] * 60 + [(2, None, "a", "s", "o", "p", 0)]
    docs = spark.createDataFrame(rows, schema)
    want = {}
    for r in mixing.mix(docs).collect():
        key = r["doc_id"], r["source"], r["size"]
        want[key] = want.get(key, 0) + r["copies"]
    for most in (200_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SIZES", most)
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        got = {}
        for r in mixed.collect():
            key = r["doc_id"], r["source"], len((r["text"] or "").split())
            got[key] = got.get(key, 0) + 1
        assert got == {k: n for k, n in want.items() if n}
        assert set(map(tuple, mixed.collect())) <= set(rows)
    again = mixing.mixed_documents(docs.orderBy(F.rand(3)))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixed.collect()))


def test_mixing(spark, real, messy, empty):
    for df in (real, messy):
        rows = mixing.mix(df).collect()
        sizes = {}
        for r in rows:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        want, taken = brute_targets(sizes), {}
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert len(rows) == df.count()
        if df is real:
            assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in want)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df).collect()))
        assert mixing.mixed_documents(df).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


# 3


def brute_lines(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    count = {}
    for _, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {b""}:
            count[k] = count.get(k, 0) + 1
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) == b"" or count[key(x)] < least]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(map(str, out))


@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 0}, {"bits": 1 << 12}])
def test_line_dedup(spark, messy, empty, how):
    rows = MESSY + [(100 + k, f"Shared line \n own {k}\n  SHARED LINE", "a") for k in range(12)]
    got = line_dedup.drop_repeated_lines(docs_of(spark, rows), min_docs=3, **how).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_lines(rows, 3)
    assert line_dedup.drop_repeated_lines(empty, **how).count() == 0


# 4


def test_toxicity_learns_from_positives_and_unlabelled_text(spark):
    rng = np.random.default_rng(0)
    bad = ["grubble", "snarkix", "vilepot"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        text = words(60, k) + (" " + " ".join(rng.choice(bad, 3)) if toxic else "")
        rows.append((k, text, "a"))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    rows += [(2000, None, "a"), (2001, "", "a"), (None, "grubble", "a")]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = np.mean([(got[k] >= 0.5) == (k % 6 == 0) for k in held])
    assert right > 0.97 and all(0 <= s <= 1 for s in got.values()) and got[2000] == got[2001] < 0.5


def test_toxicity_without_labels(spark, messy, empty):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.scored(messy, labels).where("score >= 0.5").count() == 0 and toxicity.scored(empty, labels).count() == 0


def test_cut_is_the_least_positive_unlabelled_error():
    rng = np.random.default_rng(8)
    for k in range(40):
        n = int(rng.integers(2, 60))
        z, positive, prior = rng.integers(-9, 9, n) / (1 + k % 3), rng.random(n) < 0.3, float(rng.uniform(0.02, 0.5))
        cut = toxicity.threshold(z, positive, prior)
        if not positive.any() or positive.all():
            assert cut == 0.0
            continue
        error = lambda c: 2 * prior * (z[positive] < c).mean() + (z[~positive] >= c).mean()
        every = [z.min() - 1, *((a + b) / 2 for a, b in zip(np.unique(z), np.unique(z)[1:])), z.max() + 1]
        least = min(map(error, every))
        assert error(cut) == pytest.approx(least) and cut == pytest.approx(max(c for c in every if error(c) <= least + 1e-12))


def test_training_reaches_the_risk_of_plain_gradient_descent(monkeypatch):
    """The non-negative risk over all rows, dense and full-batch, against the sparse training by batches."""
    monkeypatch.setattr(toxicity, "EPOCHS", 800)  # both run until little changes
    rng, prior = np.random.default_rng(9), 0.2
    hot = [toxicity.word_features(w)[0] for w in ("grubble", "snarkix", "vilepot")]
    cold = [toxicity.word_features(f"w{k}")[0] for k in range(40)]
    features, positive = [], []
    for k in range(900):
        toxic = k < 200 or rng.random() < prior
        features.append(np.array([*rng.choice(cold, 12, replace=False), *(rng.choice(hot, 2, replace=False) if toxic else [])], np.int64))
        positive.append(k < 200)
    positive, scales = np.array(positive), np.full(900, 0.9)
    x = np.zeros((900, 44))
    columns = {f: i for i, f in enumerate([*hot, *cold])}
    for i, row in enumerate(features):
        x[i, [columns[f] for f in row]] = 0.9
    x[:, 3:43] = 0  # words that tell nothing take no part
    x[:, 43] = 1

    def risk(w):
        z = np.clip(x @ w, -30, 30)
        loss = lambda side, y: np.logaddexp(0, -y * z[side]).mean()
        return prior * loss(positive, 1) + max(0.0, loss(~positive, -1) - prior * loss(positive, -1))

    plain = np.zeros(44)
    for _ in range(3000):
        s = 1 / (1 + np.exp(-np.clip(x @ plain, -30, 30)))
        p, u = x[positive], x[~positive]
        negative = np.logaddexp(0, x @ plain)[~positive].mean() - prior * np.logaddexp(0, x @ plain)[positive].mean()
        g_negative = u.T @ s[~positive] / len(u) - prior * p.T @ s[positive] / len(p)
        plain -= 0.3 * (prior * p.T @ (s[positive] - 1) / len(p) + g_negative if negative >= 0 else -g_negative)
    w = toxicity.train(features, scales, positive, prior, 3)
    mine = np.array([*(w[f] for f in hot), *(w[f] for f in cold), w[-1]])
    assert risk(mine) <= risk(plain) + 0.05 and risk(mine) < risk(np.zeros(44)) / 10


def test_toxicity_of_repeated_rows_and_one_hot_id(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 7 if k % 3 == 0 else k, words(40, k) + (" grubble snarkix" if k % 6 == 0 else ""), "a") for k in range(600)] + [(3, "twice grubble", "a")] * 200
    labels = [(k, int(k % 6 == 0)) for k in range(0, 600, 2)] * 2 + [(None, 1), (5, None)]
    got = toxicity.scored(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == 800 and len({r["score"] for r in got if r["text"] == "twice grubble"}) == 1 and all(0 <= r["score"] <= 1 for r in got) and rng is not None


# 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2000), st.integers(0, 2**31))
def test_codes_round_trip_and_random_access(ids, seed):
    codes = token_store.Codes(token_store.encode_codes(np.array(ids, dtype=np.uint32)))
    assert codes.all().tolist() == ids
    if ids:
        at = np.random.default_rng(seed).integers(0, len(ids), 50)
        assert codes.get(at).tolist() == [ids[k] for k in at]


HARD = ["", "a", "  ", "a  b", "don't  stop", "x's 't  \n\n y", "foo\n\nBar", "½ a½b", "12 3a4 'll", "日本 語", "a \n b\t c", "end \n", "<|endoftext|> hi", "🙂 🙂🙂a", "x\x1cy \x1c z", " lead"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab '.\n\tÀ½日1🙂", max_size=40), max_size=5))
def test_cached_tokenizer_equals_the_library(texts):
    tok = WordCachedTokenizer.at(BPE)
    want = [e.ids for e in tok.tokenizer.encode_batch(texts + HARD, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts + HARD)] == want


def expected_ids(rows, end):
    from tokenizers import Tokenizer

    return [[*e.ids, end] for e in Tokenizer.from_file(BPE).encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False)]


def test_added_tokens_have_the_ids_of_the_plain_library(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    texts = [*HARD, "abc <|endoftext|> def", "<|endoftext|>", "a <|endoftext|><|endoftext|>b  c", "abc <|endoftext| > def", "def"]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in want[len(HARD)]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordCachedTokenizer(BPE).encode(texts)] == want
    docs = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])
    token_store.write_token_store(docs, str(tmp_path / "a"), BPE)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read_token_store(spark, str(tmp_path / "a")).collect()}
    assert got == {k: [*ids, 2] for k, ids in enumerate(want)}
    pieces = packing.pack(docs, BPE).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == {k: len(ids) + 1 for k, ids in enumerate(want)}


def test_tokens_by_position(spark, real, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 700)
    token_store.write_token_store(real.repartition(5), str(tmp_path / "s"), BPE)
    broadcast = sorted(map(tuple, token_store.read_token_store(spark, str(tmp_path / "s")).collect()))
    monkeypatch.setattr(token_store, "BROADCAST_SHARDS", 0)
    assert broadcast == sorted(map(tuple, token_store.read_token_store(spark, str(tmp_path / "s")).collect()))
    flat = [i for r in sorted(token_store.read_token_store(spark, str(tmp_path / "s")).collect(), key=lambda r: r["start"]) for i in np.frombuffer(r["ids"], "<u4").tolist()]
    at = sorted({0, 1, 699, 700, 701, len(flat) - 1, *np.random.default_rng(2).integers(0, len(flat), 300).tolist()})
    asked = spark.createDataFrame([(p,) for p in [*at, at[0], len(flat), -1]] + [(None,)], "position bigint")
    assert {r["position"]: r["id"] for r in token_store.tokens_at(spark, str(tmp_path / "s"), asked).collect()} == {p: flat[p] for p in at}


def test_store_order_of_repeated_ids_is_that_of_their_texts(spark, tmp_path):
    rows = [(1, words(30, k), "a") for k in range(40)] + [(None, "x", "a"), (None, "y", "a")]
    for k, seed in enumerate((1, 2)):
        token_store.write_token_store(docs_of(spark, rows).orderBy(F.rand(seed)), str(tmp_path / str(k)), BPE)
    one, two = (sorted((r["start"], r["doc_id"] or 0, r["ids_crc32"]) for r in token_store.read_token_store(spark, str(tmp_path / str(k))).collect()) for k in (0, 1))
    assert one == two


def test_token_store(spark, messy, empty, tmp_path):
    token_store.write_token_store(messy, str(tmp_path / "a"), BPE)
    got = sorted(((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) for r in token_store.read_token_store(spark, str(tmp_path / "a")).collect()))
    rows = sorted(MESSY, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (s, d, ids, n), (want_d, *_), want in zip(got, rows, expected_ids(rows, 2)):
        assert (s, d, n) == (start, want_d, len(want)) and ids == want
        start += n
    token_store.write_token_store(empty, str(tmp_path / "b"), BPE)
    assert token_store.read_token_store(spark, str(tmp_path / "b")).count() == 0


class CountedFile:
    """A file in memory that notes what is read."""

    def __init__(self, raw):
        self.raw, self.reads = raw, []

    def read_at(self, n, at):
        self.reads.append((at, n))
        return self.raw[at : at + n]


def test_one_token_is_read_by_a_block_per_level():
    ids = np.random.default_rng(3).choice([5, 300, 70_000, 1 << 30], 100_000)
    file = CountedFile(b"before" + token_store.encode_codes(ids) + b"after")
    codes = token_store.Codes(file, 6)
    file.reads.clear()
    for at in (0, 511, 512, 77_777, 99_999):
        assert codes.get(at).tolist() == [ids[at]]
    assert len(file.reads) <= 5 * 4 and max(n for _, n in file.reads) == token_store.INNER.itemsize
    file.reads.clear()
    assert codes.get([600, 513, 600, 1100]).tolist() == ids[[600, 513, 600, 1100]].tolist()
    assert file.reads[0][1] == 2 * token_store.INNER.itemsize  # neighbouring blocks at once


def test_tokens_are_read_by_seeking_and_lost_attempts_are_not_read(spark, real, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 2000)
    path = f"file://{tmp_path}/s"
    token_store.write_token_store(real, path, BPE)
    files = sorted((tmp_path / "s" / "codes").iterdir())
    named = spark.read.parquet(f"{path}/shards").groupBy("file").agg(F.sum("size").alias("size")).collect()
    assert {r["file"]: r["size"] for r in named} == {f.name: f.stat().st_size for f in files}
    want = sorted(map(tuple, token_store.read_token_store(spark, path).collect()))
    flat = np.concatenate([np.frombuffer(r[-1], "<u4") for r in sorted(want, key=lambda r: r[1])])
    (tmp_path / "s" / "codes" / f"{files[0].name[:8]}0.dac").write_bytes(files[0].read_bytes()[:40])  # of an attempt that was lost
    assert sorted(map(tuple, token_store.read_token_store(spark, path).collect())) == want
    at = np.random.default_rng(1).integers(0, len(flat), 300).tolist()
    asked = spark.createDataFrame([(p,) for p in [*at, -1, len(flat), None]], "position bigint")
    assert {r["position"]: r["id"] for r in token_store.tokens_at(spark, path, asked).collect()} == {p: flat[p] for p in at}


# 6


def test_chat_paths_are_the_best_branches(spark):
    rows = [("c", 1, None, "user", "q", 0.1), ("c", 2, 1, "assistant", "bad", 0.0), ("c", 3, 1, "assistant", "good </s>[INST] \\</s>", 0.9), ("c", 4, 3, "user", "thanks", 0.5), ("c", 5, 4, "assistant", "bye", 0.5), ("d", 9, None, None, None, None)]
    messages = spark.createDataFrame(rows, "conv_id string, node bigint, parent bigint, role string, text string, score double").na.fill("", ["role", "text"])
    paths = {(r["conv_id"], r["branch"]): [] for r in chat.best_paths(messages, 2).collect()}
    for r in chat.best_paths(messages, 2).orderBy("depth").collect():
        paths[r["conv_id"], r["branch"]].append(r["node"])
    assert paths == {("c", 1): [1, 3, 4, 5], ("c", 2): [1, 2], ("d", 1): [9]}
    text = {r["conv_id"]: r for r in chat.read_back(chat.formatted(messages)).collect()}
    assert [(t["role"], t["text"], t["loss"]) for t in text["c"]["turns"]] == [("user", "q", False), ("assistant", "good </s>[INST] \\</s>", True), ("user", "thanks", False), ("assistant", "bye", True)]
    assert text["c"]["text"].count("</s>") == 2 and [tuple(t) for t in text["d"]["turns"]] == [("", "", False)]


def test_chat_long_and_messy_chains(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k} <s>") for k in range(77)] + [(None, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, None, "user", "first")]
    read = chat.read_back(chat.formatted(chat.chains(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read.collect()}
    assert got["1"] == [(r, t) for _, _, r, t in rows[:77]] and got[""] == [("user", "")] and got["2"] == [("user", "first"), ("", "x"), ("", "x")]
    plan = read._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<s>/[INST]\\ a", max_size=30), min_size=20, max_size=40))
def test_chat_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escaped(df["t"]).alias("e"), chat.unescaped(chat.escaped(df["t"])).alias("b")).collect():
        assert r["b"] == r["t"] and not any(m in r["e"] for m in ("<s>", "</s>", "[INST]", "[/INST]"))


# 7


@pytest.mark.parametrize("cap", [20_000, 4])
def test_simhash_components(spark, real, messy, empty, monkeypatch, cap):
    monkeypatch.setattr(simhash, "BUCKET_CAP", cap)
    for df in (real, messy):
        rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(range(len(rows)), 2):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
        least = {}
        for k, (d, _) in enumerate(rows):
            if d is not None:
                least[find(k)] = min(least.get(find(k), d), d)
        want = sorted((str(d), fp, least.get(find(k))) for k, (d, fp) in enumerate(rows))
        got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
        assert got == want
        assert simhash.one_per_group(df).count() == len({find(k) for k in range(len(rows))})
    assert simhash.near_duplicates(empty).count() == 0


def test_one_per_group_with_null_and_repeated_ids(spark):
    texts = [words(60, 100 + k) for k in range(6)]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "b"), (None, texts[2], "a"), (5, texts[3], "a"), (5, texts[4], "a"), (5, texts[4], "a"), (7, texts[4], "a"), (None, texts[4], "a"), (5, None, "a"), (6, "", "a"), (8, texts[5], "a")]
    kept = simhash.one_per_group(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([*[("None", t) for t in texts[:3]], ("5", texts[3]), ("5", texts[4]), ("5", ""), ("8", texts[5])])
    again = simhash.one_per_group(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, kept))


def test_simhash_fingerprint_by_hand():
    import xxhash

    text = "A b  C d e"
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c d", "b c d e")]
    assert simhash.fingerprint(text) == h[0] & h[1] and simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_close_fingerprints_share_a_bucket(spark, blocks):
    rng = np.random.default_rng(blocks)
    a = rng.integers(-(2**63), 2**63, 40)
    b = [int(x) ^ sum(1 << int(i) for i in rng.choice(63, 4, replace=False)) for x in a]
    keys = {}
    for r in simhash.block_keys(spark.createDataFrame([(int(x),) for x in [*a, *b]], "fp bigint"), blocks, 4).collect():
        keys.setdefault(r["fp"], set()).add((r["table"], r["key"]))
    assert all(keys[int(x)] & keys[y] for x, y in zip(a, b))


# 8


def test_packing(spark, real, messy, empty):
    for df in (real, messy):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        pieces = packing.pack(df, BPE).collect()
        sequences, by_doc = {}, {}
        for r in pieces:
            assert 0 < r["length"] == len(r["ids"]) // 4
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_doc.setdefault(r["doc_id"], []).append(r)
        padding = 0
        for spans in sequences.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding == 0
        want = {}
        for (d, _), ids in zip(rows, expected_ids(rows, 1)):
            want.setdefault(d, []).append(ids)
        for d, lists in want.items():
            assert sum(r["length"] for r in by_doc[d]) == sum(map(len, lists))
            if len(lists) == 1:
                assert np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted(by_doc[d], key=lambda r: r["start"])), "<u4").tolist() == lists[0]
                assert {r["doc_tokens"] for r in by_doc[d]} == {len(lists[0])}
    assert packing.pack(empty, BPE).count() == 0


def test_hilbert_curve_visits_neighbours():
    side = np.array(list(itertools.product(range(8), repeat=3)))
    order = side[np.argsort(packing.hilbert_keys(side, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# 9


def test_minhash_edits_and_likeness(spark, real, messy, empty):
    for df in (real, messy):
        tied = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()
        rows = [(r["doc_id"], r["t"]) for r in sorted(tied, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["t"]))]
        fp = lambda x: minhash.Document(x).fingerprint.hex()
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
        found = minhash.fingerprints(df).collect()
        got, want = sorted((repr([r[c] for c in columns]), r["near_next"], r["near_edited"]) for r in found), []
        for k, (d, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            cut = len(t) // 4
            edited = t[: len(t) - cut] + nxt[:cut]
            alike = float(np.mean([fp(t)[i : i + 4] == fp(nxt)[i : i + 4] for i in range(0, 512, 4)]))
            want.append((repr([d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp(t), fp(edited)]), alike, t, edited))
        want.sort()
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
        for (_, _, near), (_, _, t, edited) in zip(got, want):
            if len(t) < 5000:
                assert fp(t) == plain_fingerprint(t) and fp(edited) == plain_fingerprint(edited)
                true = jaccard(t, edited)
                assert abs(near - true) <= 5 * (true * (1 - true) / 128) ** 0.5 + 0.02
    assert minhash.fingerprints(empty).count() == 0
    (lone,) = minhash.fingerprints(docs_of(spark, [(5, BASE, "a")])).collect()
    assert lone["near_next"] == 1.0


def plain_shingles(text):
    words_ = text.encode().lower().split()
    size = min(5, len(words_))
    return {tuple(words_[i : i + size]) for i in range(len(words_) - size + 1)} if words_ else set()


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_fingerprint(text):
    """The minima of multiply-shift hashes, in whole numbers of Python."""
    import xxhash

    mask, minima = (1 << 64) - 1, [0xFFFFFFFF] * 128
    for shingle in plain_shingles(text):
        h = len(shingle)
        for j, word in enumerate(shingle):
            h = ((h ^ xxhash.xxh3_64_intdigest(word)) * int(minhash._MIX[j])) & mask
            h ^= h >> 29
        minima = [min(m, ((int(a) * h + int(b)) & mask) >> 32) for m, a, b in zip(minima, minhash._A, minhash._B)]
    return "".join(f"{m & 0xFFFF:04x}" for m in minima)


@pytest.mark.parametrize("cap", [4096, 5])
def test_minhash_near_duplicates_equal_exact_jaccard(spark, real, monkeypatch, cap):
    monkeypatch.setattr(minhash, "BUCKET_CAP", cap)
    monkeypatch.setattr(minhash, "EXACT_CAP", cap)
    rows = [(r["doc_id"], set(minhash.shingle_hashes(minhash.hash_words(minhash.split_words(r["text"] or ""))).tolist())) for r in real.collect()]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if x == y or (x | y and len(x & y) / len(x | y) >= 0.8):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert {tuple(r) for r in minhash.near_duplicates(real).collect()} == {(d, find(d)) for d, _ in rows}


# 10


def brute_repeats(rows):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        if d is not None:
            for i in range(len(raw) - 49):
                w = raw[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, np.int8)
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                gone[i : i + 50] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(d), len(raw), int(gone.sum()), int((np.diff(gone[:-1], prepend=0) == 1).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"filter_bits": 0}, {"seed_cap": 3}])
def test_repeats_equal_brute_force(spark, real, messy, empty, how):
    for df in (real, messy) if not how else (messy,):
        got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in bwt_dedup.remove_repeats(df, **how).collect()]
        assert sorted(got) == brute_repeats([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert bwt_dedup.remove_repeats(empty, **how).count() == 0


def test_merged_transforms_are_the_order_of_all_strings():
    rng = np.random.default_rng(5)
    strings = rng.integers(97, 99, (60, 30)).astype(np.uint8)
    strings[30:] = strings[:30]
    strings[40:, 20:] = 120
    group = np.sort(rng.integers(0, 4, 60))
    order, shared = bwt_dedup.common_prefixes(group, strings, shard=16)
    rows = [(int(group[k]), strings[k].tobytes()) for k in order]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(60))
    for (g, a), (h, b), n in zip(rows, rows[1:], shared[1:]):
        assert n == (-1 if g != h else next((k for k in range(30) if a[k] != b[k]), 30))


def test_windows_of_merged_transforms_equal_brute_force():
    rng = np.random.default_rng(6)
    n, middle = 300, bwt_dedup.WINDOWS - 1
    group = np.sort(rng.integers(0, 12, n))
    snippets = rng.integers(97, 99, (n, bwt_dedup.SNIPPET)).astype(np.uint8)
    snippets[:, :25] = 97
    snippets[:, 56:] = 98
    snippets[:, middle : middle + bwt_dedup.SEED] = group[:, None]
    low, high, doc = rng.integers(0, 9, n), rng.integers(20, 32, n), rng.integers(0, 99, n)
    first = {}
    for k in range(n):
        for w in range(low[k], high[k]):
            key = (group[k], w, snippets[k, w : w + 50].tobytes())
            first[key] = min(first.get(key, 1 << 60), doc[k])
    got = bwt_dedup.least_documents(group, snippets, low, high, doc, shard=64)
    for k in range(n):
        for w in range(bwt_dedup.WINDOWS):
            assert got[k, w] == (first[group[k], w, snippets[k, w : w + 50].tobytes()] if low[k] <= w < high[k] else np.iinfo(np.int64).max)
