"""The pipeline's stages, each on its own input, against plain versions."""

import itertools
import shutil
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from missive.llm import simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, score string, n_lines int, row string, key string, order_ string"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


def messy_rows():
    rows = [(k % 40 if k % 3 else None, f"{words(30, k)}\nShared LINE \n{words(9, 1000 + k)}" + (" grubble snarkix vilepot" if k % 8 == 0 else ""), "ab"[k % 2] if k % 5 else None) for k in range(150)]
    rows += [rows[4], rows[4], (500, rows[7][1], "b"), (501, None, "a"), (502, "", "a"), (None, "  ", None), (503, "x" * 20_000, "b"), (504, words(3000, 7), "a")]
    return [(*r, "s", 7, "r", "k", "o") for r in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with documents of null and repeated ids and clashing columns, and labels of some."""
    base = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(messy_rows(), SCHEMA).write.parquet(str(base / "documents.parquet"))
    labels = [(k, int(any(r[0] == k and "grubble" in (r[1] or "") for r in messy_rows()))) for k in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base)


def groups(texts):
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            root[find(a)] = find(b)
    return [find(k) for k in range(len(fps))]


def lines_dropped(texts, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")} - {b""}:
            count[k] = count.get(k, 0) + 1
    return ["\n".join(x for x in (t or "").split("\n") if count.get(key(x), 0) < least) for t in texts]


def mix_targets(sizes):
    """150 % of all words by weights 5, 2, 1; what a source can't take in twice goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left = {}, 1.5 * sum(sizes.values())
    while len(out) < len(order):
        rest = [s for s in order if s not in out]
        total = sum(weight[s] for s in rest)
        full = [s for s in rest if left * weight[s] / total > 2 * sizes[s]]
        for s in full:
            out[s] = 2 * sizes[s]
        if not full:
            out |= {s: left * weight[s] / total for s in rest}
        left -= sum(2 * sizes[s] for s in full)
    return out


def check_mix(before, after):
    """No row more than twice as often as it was there; each source's words within a document of its target."""
    n_words = lambda r: len((r["text"] or "").encode().split())
    assert set(map(tuple, after)) <= set(map(tuple, before))
    had, got = Counter(map(repr, before)), Counter(map(repr, after))
    assert all(n <= 2 * had[r] for r, n in got.items())
    sizes, taken, own = {}, {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + n_words(r)
        own.setdefault(r["source"], []).append(n_words(r))
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + n_words(r)
    for source, target in mix_targets(sizes).items():
        if not sizes[source]:
            continue
        rounds = min(1, int(target // sizes[source]))
        sums = 1  # bit k: k words can be taken beside the whole rounds
        for n in own[source]:
            sums |= sums << n
        best = min(abs(rounds * sizes[source] + k - target) for k in range(sizes[source] + 1) if sums >> k & 1)
        # the fit spreads over sizes before it fills exactly: it may miss the best sum by less than the longest document
        assert abs(taken.get(source, 0) - target) <= max(best + 1, max(own[source])), source


def check_sequences(pieces, texts):
    """Sequences are gapless, and full or a power of two; the pieces of each id hold its documents' tokens, in their places."""
    for _, own in itertools.groupby(sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    got, want = {}, {}
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        got.setdefault((r["doc_id"], r["doc_tokens"]), Counter()).update(zip(itertools.count(r["start"]), ids))
    for doc, ids in texts:
        want.setdefault((doc, len(ids)), Counter()).update(enumerate(ids))
    assert got == want


def check_run(spark, sf):
    """Each stage on what the one before it kept, against a plain version of it."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == columns
        after = kept.collect()
        if name == "toxicity":
            scores = toxicity.scored(docs, spark.read.parquet(f"{sf}/labels.parquet"), "own_score").collect()
            want = [tuple(r[c] for c in columns) for r in scores if r["own_score"] < 0.5]
            assert sorted(map(repr, map(tuple, after))) == sorted(map(repr, want))
        elif name == "line_dedup":
            rest = [c for c in columns if c != "text"]
            want = [(*[r[c] for c in rest], t) for r, t in zip(before, lines_dropped([r["text"] for r in before]))]
            assert sorted(map(repr, ((*[r[c] for c in rest], r["text"]) for r in after))) == sorted(map(repr, want))
        elif name == "simhash":
            least = {}
            for r, g in zip(before, groups([r["text"] for r in before])):
                least[g] = min(least.get(g, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted(least.values())
            assert set(map(tuple, after)) <= set(map(tuple, before))
        else:
            check_mix(before, after)
        docs, before = kept.checkpoint(), after
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in before]
    check_sequences(C.run(spark, sf).collect(), want)


def test_run_equals_plain_versions(spark):
    assert [name for name, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"] and C.ORACLE_SQL is None
    check_run(spark, SF)


def test_run_on_null_and_repeated_ids_and_clashing_columns(spark, sf):
    check_run(spark, sf)


def test_toxic_documents_go_and_clean_ones_stay(spark, sf):
    kept = [r["text"] or "" for r in C.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()]
    clean = [r for r in messy_rows() if "grubble" not in (r[1] or "")]
    assert sum("grubble" not in t for t in kept) >= 0.9 * len(clean)


def test_run_on_empty_tables(spark, sf, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copytree(f"{sf}/labels.parquet", tmp_path / "labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
