"""The pipeline's stages against brute force, each on its own input."""

import collections

import numpy as np
import pytest

import corpus_pipeline


from test_text_ops import brute_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = [f"word{k}" for k in range(800)]
    make = lambda n: " ".join(rng.choice(vocabulary, size=n))
    rows, labels = [], []
    for k in range(260):
        text = "\n".join(make(int(rng.integers(9, 60))) for _ in range(int(rng.integers(1, 5))))
        if k % 7 == 0:
            text += " worthless idiot"
        rows.append([k, text, "en", f"s{k % 4}", None])
        labels.append((k, 1, int(k % 7 == 0)))
    for k in range(40):
        rows.append([1000 + k, rows[k + 1][1], "en", "s0", None])  # exact copies
    for k in range(40):
        w = rows[100 + k][1].replace("\n", " ").split(" ")
        w[len(w) // 2] = "altered"
        rows.append([2000 + k, " ".join(w), "en", None, None])
    shared = make(60)
    rows += [[3000 + k, f"{make(20)}\n{shared}\n{make(20)}", "en", "s1", None] for k in range(30)]
    rows += [[4000, None, "en", "s1", None], [4001, "", None, "s1", None], [4002, " ".join(rng.choice(vocabulary, size=9000)), "en", "s2", None]]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"documents": docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()

    first = {r["doc_id"]: r["text"] for r in seen["documents"]}
    toxic = {i for i, t in first.items() if t and ("worthless" in t)}
    assert {r["doc_id"] for r in seen["toxicity"]} == set(first) - toxic

    before = [(r["doc_id"], r["text"]) for r in seen["toxicity"]]
    gone = brute_lines(before)
    want = {}
    for i, t in before:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if not (kept is not None and not kept.strip() and any(g[0] == i for g in gone)):
            want[i] = kept
    assert {r["doc_id"]: r["text"] for r in seen["line_dedup"]} == want
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in seen["line_dedup"])

    left = {r["doc_id"] for r in seen["simhash_near_dedup"]}
    sets = {i: grams(t) for i, t in want.items()}
    ids = sorted(sets)
    similar = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(max(p) in left and min(p) in left for p in similar) <= 0.1 * max(1, len(similar))
    loose = {i for i in ids if not any(i in p for p in similar) and sets[i] and not any(len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) for j in ids if j != i)}
    assert loose <= left

    copies = collections.Counter(r["doc_id"] for r in seen["mixing"])
    assert set(copies) <= left and max(copies.values()) <= 2
    assert len(seen["mixing"]) > 0.8 * len(left)

    placed = seen["packing"]
    assert {r["doc_id"] for r in placed} == set(copies)
    once = [r for r in placed]
    total = sum(r["length"] for r in once)
    assert len({r["sequence_id"] for r in placed}) == -(-total // 1024)
    singles = {i for i, c in copies.items() if c == 1}
    check = [r for r in placed if r["doc_id"] in singles]
    assert sum(r["length"] for r in check) <= total
    texts = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    per_doc = collections.Counter(r["doc_id"] for r in placed if r["piece"] == 0)
    assert per_doc == copies and set(texts) == set(copies)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in spans.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 1024




def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
