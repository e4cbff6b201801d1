"""Vectors, fingerprints and graphs against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import curves, epsilon, golay, graph, simhash

VECS = "vec_id long, embedding array<float>, label int, part string, block string"


def rows_of(x, labels, ids=None):
    return [(int(i), [float(a) for a in v] if v is not None else None, None if lab is None else int(lab), "x", "y") for i, v, lab in zip(range(len(x)) if ids is None else ids, x, labels, strict=True)]


def components(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 60)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = components(400, pairs)
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def clustered(rng, n, dims=8):
    centres = rng.normal(size=(n // 6, dims))
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(scale=0.05, size=(n, dims))
    x[5] = x[3]
    x[6] = 3 * x[3]
    return x.astype(np.float32)


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    x = clustered(rng, 700)
    labels = [int(v) for v in rng.integers(0, 3, 700)]
    labels[3] = labels[5] = labels[6] = 1
    extra = [None, np.zeros(8), np.full(8, np.nan), np.array([np.inf] + [1.0] * 7), x[3], x[3]]
    rows = rows_of([*x, *extra], [*labels, 1, 1, 1, 1, None, 1])
    got = {r["vec_id"]: r for r in epsilon.near_vectors(spark.createDataFrame(rows, VECS)).collect()}
    assert len(got) == 706
    y = np.array([*x, *[np.zeros(8)] * 5, x[3]], np.float64)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    lab = np.array([*labels, -1, -2, -3, -4, -5, 1])
    hit = (y @ y.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    comp = components(706, zip(*np.nonzero(hit), strict=True))
    for i in range(706):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (hit[i].sum(), comp[i], comp[i] == i), i


def test_near_vectors_small(spark):
    assert epsilon.near_vectors(spark.createDataFrame([], VECS)).count() == 0
    one = epsilon.near_vectors(spark.createDataFrame(rows_of([np.ones(8)], [0]), VECS)).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in one] == [(0, 0, True)]
    same = epsilon.near_vectors(spark.createDataFrame(rows_of([np.ones(8)] * 300, [0] * 300), VECS)).collect()
    assert {(r["n_links"], r["component_id"]) for r in same} == {(299, 0)}


def test_interval_recursion_finds_all():
    rng = np.random.default_rng(2)
    x = np.sort(rng.normal(size=(900, 3)), axis=0)
    found = set()
    epsilon.join_sequences((0, x), (0, x), 0.3, True, lambda a, b, c, d: found.update((min(i, j), max(i, j)) for i in range(a, b) for j in range(c, d) if i != j and np.linalg.norm(x[i] - x[j]) <= 0.3))
    assert found == {(i, j) for i in range(900) for j in range(i + 1, 900) if np.linalg.norm(x[i] - x[j]) <= 0.3}


def brute_nearest(x, ids, valid, k):
    out = {}
    for q in np.flatnonzero(valid & (ids % 100 == 0)):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[~valid] = np.inf
        far[q] = np.inf
        order = np.lexsort((ids, far))[:k]
        out[int(ids[q])] = [(int(ids[i]), far[i]) for i in order if np.isfinite(far[i])]
    return out


@pytest.mark.parametrize(("n", "least"), [(3, 1.0), (800, 0.9), (6000, 0.9)])
def test_search(spark, n, least):
    rng = np.random.default_rng(3)
    x = clustered(rng, max(n, 12), 16)[:n].astype(np.float64)
    if n > 100:
        x[200:260] = x[200]  # many equal vectors: ties go to the smaller id
    vecs = [*x.astype(np.float32), None, np.zeros(16), np.full(16, np.nan)]
    ids = np.arange(len(vecs))
    got = {}
    for r in curves.search(spark.createDataFrame(rows_of(vecs, [0] * len(vecs)), VECS), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    full = np.array([*x.astype(np.float32), *[np.zeros(16)] * 3], np.float64)
    want = brute_nearest(full, ids, ids < n, 10)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= least * sum(map(len, want.values()))
    for q, found in got.items():
        assert len(found) == len(want[q]) and q not in dict(found)
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        assert all(abs(s - np.sqrt(((full[i] - full[q]) ** 2).sum())) < 1e-12 for i, s in found)


def test_search_empty(spark):
    assert curves.search(spark.createDataFrame([], VECS), F.col("vec_id") % 100 == 0).count() == 0


def test_hilbert_neighbours_touch():
    """The curve visits every cell once, each step to a cell beside."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = curves.hilbert_keys(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_golay_keys_meet_within_two_bits():
    """All words stand for one per syndrome: the code is linear."""
    words = np.array([w for w in range(1 << 11)])
    flips = [0, *(1 << a for a in range(23)), *(1 << a | 1 << b for a in range(23) for b in range(a))]
    own = golay.keys(words)
    for f in flips:
        other = golay.keys(words ^ f)
        meet = ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any((1, 2))
        assert meet.all()


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{k}" for k in range(400)], size=n)) for n in (120, 300, 600, 900)]
    texts = []
    for k in range(300):
        w = base[k % 4].split()
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, " \n ", "one", "One", "one two", "ÉTÉ été", "x " * 3000, "long " * 2000 + "tail"] + ["a b c d"] * 60
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "no id", "c", 1), (3, "other text of one id", "c", 1)], "doc_id long, text string, fp string, rep int")
    rows = simhash.near_duplicates(df).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] != 3}
    prints = [plain_fingerprint(t or "") for t in texts]
    assert all(got[k]["fp"][0] & (2**64 - 1) == prints[k] for k in got)
    comp = components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert all(got[k]["component_id"] == comp[k] for k in got)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_are_walked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_GROUP", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(6)
    prints = sorted({int(f) for f in rng.integers(0, 2**63, 20)} | {(12345 << 20) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (300, 3))})
    reps = spark.createDataFrame([(k, [f]) for k, f in enumerate(prints)], "rep long, fp array<long>")
    edges = [(r["u"], r["v"]) for r in simhash.fingerprint_links(reps, simhash.EXACT).collect()]
    assert all((prints[u] ^ prints[v]).bit_count() <= 2 for u, v in edges)
    want = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert components(len(prints), edges) == want


def test_similar_catches_near_copies_and_leaves_others(spark):
    """Copies that keep 0.8 or more of their five-word shingles go; documents with other words stay."""
    rng = np.random.default_rng(7)
    vocabulary = [f"v{k}" for k in range(3000)]
    texts, near = {}, {}
    for d in range(150):
        w = list(rng.choice(vocabulary, size=int(rng.integers(150, 600))))
        texts[2 * d] = " ".join(w)
        cut = w[:]
        for k in rng.choice(len(w), size=max(1, int(len(w) * 0.015)), replace=False):
            cut[k] = "new"
        if d < 100:
            texts[2 * d + 1] = " ".join(cut)

            def grams(ws):
                return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

            a, b = grams(w), grams(cut)
            near[2 * d + 1] = len(a & b) / len(a | b)
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert {2 * d for d in range(150)} <= kept
    due = [k for k, j in near.items() if j >= 0.8]
    caught = sum(k not in kept for k in due) / len(due)
    assert caught >= 0.9, caught
