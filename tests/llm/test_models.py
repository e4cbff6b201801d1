"""Toxicity and quality: held-out accuracy, the model's arithmetic, edge cases."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, term string, __id long"
WORDS = "the river runs along a quiet valley where people farm small fields and trade bread cloth stone timber every market day under open skies".split()


def corpus(seed=0, n=600):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for k in range(n):
        w = list(rng.choice(WORDS, size=int(rng.integers(20, 120))))
        toxic = k % 6 == 0
        if toxic:
            for _ in range(int(rng.integers(1, 4))):
                bad = ["idiot", "worthless", "grolb" + "abcdef"[int(rng.integers(6))] * 2, "snarfquet"][int(rng.integers(4))]
                w.insert(int(rng.integers(len(w))), bad)
        rows.append((k, " ".join(w), "en", "clash", 1))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    rows += [(9000, None, "en", "c", 1), (9001, "", "en", "c", 1), (9002, "quiet valley " * 20_000, "en", "c", 1), (None, "no id", "en", "c", 1), (9003, "quiet valley " * 5000 + "worthless idiot", "en", "c", 1)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    held = {r[0] for r in df.where(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    truth = {k: t for k, _, t in labels}
    tp = sum(scores[k] >= 0.7 and truth[k] for k in held if k in truth)
    fp = sum(scores[k] >= 0.7 and not truth[k] for k in held if k in truth)
    assert fp == 0 and tp >= 0.9 * sum(truth[k] for k in held if k in truth)
    assert scores[9003] >= 0.7 and scores[9000] == scores[9001] < 0.7 and scores[9002] < 0.7
    kept = {r["doc_id"] for r in toxicity.without_toxic(df, lab).collect()}
    assert kept == {k for k, s in scores.items() if s < 0.7}


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "you worthless idiot, pathetic scum", "en", "c", 1), (2, "a quiet valley", "en", "c", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.train(df, none)).collect()}
    assert scores[1] >= 0.7 > scores[2]
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), none)).count() == 0


def test_labels_of_the_held_out_third_are_not_used(spark):
    rows, labels = corpus(1)
    df = spark.createDataFrame(rows, DOCS)
    schema = "doc_id long, quality int, toxic int"
    held = {r[0] for r in df.where(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    swapped = [(k, q, 1 - t if k in held else t) for k, q, t in labels]
    one = toxicity.train(df, spark.createDataFrame(labels, schema))
    two = toxicity.train(df, spark.createDataFrame(swapped, schema))
    assert np.allclose(one.weights, two.weights) and one.voters == two.voters


def test_disguised_words():
    assert toxicity.disguised("you 1d10t, w0rthless! and fine in 2024").split() == ["idiot", "worthless"]
    assert "idiot" in toxicity.disguised("such an i d i o t indeed").split()


def patterns_of(votes, known):
    """Patterns of votes with their rows, and those known to be of either class."""
    rows = collections.defaultdict(lambda: [0, 0, 0])
    for v, y in zip(votes.tolist(), known, strict=True):
        rows[tuple(v)][0] += 1
        if y is not None:
            rows[tuple(v)][1 if y else 2] += 1
    return np.array(list(rows), np.int8), *np.array(list(rows.values()), float).T


def test_correlated_voters_count_once():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    a, b, twin = vote(0.8), vote(0.85), vote(0.7)
    votes = np.stack([a, b, twin, twin, twin], 1).astype(np.int8)
    patterns, count, toxic, clean = patterns_of(votes, [bool(v) if k < 300 else None for k, v in enumerate(y)])
    post, estimates = toxicity.tuned_label_model(patterns, count, toxic, clean)
    assert sum(estimates["parent"][k] in (2, 3, 4) for k in (2, 3, 4)) == 2  # the twins hang on each other
    said = dict(zip(map(tuple, patterns.tolist()), post, strict=True))
    right = np.mean([(said[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), y, strict=True)])
    assert right > ((votes.sum(1) > 0) == y).mean() + 0.08  # the majority, which the three twins decide
    assert abs(estimates["share"] - 0.3) < 0.06


def test_label_model_against_brute_force():
    """One pattern after the other, row by row: the fixed point repeats itself under EM written out."""
    rng = np.random.default_rng(5)
    y = rng.random(1500) < 0.25
    votes = np.stack([np.where(rng.random(1500) < p, np.where(y, 1, -1), rng.integers(-1, 2, 1500)) for p in (0.7, 0.5, 0.6)], 1).astype(np.int8)
    known = [bool(v) if k % 5 == 0 else None for k, v in enumerate(y)]
    patterns, count, toxic, clean = patterns_of(votes, known)
    post, estimates = toxicity.label_model(patterns, count, toxic, clean, tie=2.0, rounds=2000)
    belief = {tuple(v): p for v, p in zip(patterns.tolist(), post, strict=True)}
    weight = [collections.Counter(), collections.Counter()]
    for v, k in zip(votes.tolist(), known, strict=True):
        p = belief[tuple(v)]
        for c in (0, 1):
            weight[c][tuple(v)] += 2.0 * (k == bool(c)) if k is not None else (p if c else 1 - p)
    share = (sum(weight[1].values()) + 1) / (sum(weight[0].values()) + sum(weight[1].values()) + 2)
    assert math.isclose(share, estimates["share"], rel_tol=1e-4)

    def chance(v, c):
        out = 1.0
        for j, up in enumerate(estimates["parent"]):
            alone = [sum(w for x, w in weight[c].items() if x[j] == s) + 0.5 for s in (-1, 0, 1)]
            alone = [a / sum(alone) for a in alone]
            if up < 0:
                out *= alone[v[j] + 1]
            else:
                row = [sum(w for x, w in weight[c].items() if x[j] == s and x[up] == v[up]) + 2 * alone[s + 1] for s in (-1, 0, 1)]
                out *= row[v[j] + 1] / sum(row)
        return out

    for v, p in belief.items():
        toxic_odds = share * chance(v, 1)
        assert math.isclose(p, toxic_odds / (toxic_odds + (1 - share) * chance(v, 0)), abs_tol=1e-4)


def test_toxicity_of_the_query_and_of_the_stage_agree(spark):
    rows, labels = corpus(3, 300)
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = {r["doc_id"]: r["score"] for r in toxicity.train_and_score(df, lab).collect()}
    twice = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.train(df, lab)).collect()}
    assert once.keys() == twice.keys() and all(math.isclose(once[k], twice[k], abs_tol=1e-9) for k in once)
    assert toxicity.train_and_score(df.limit(0), lab.limit(0)).count() == 0


def brute_kneser_ney(texts):
    """The same model from dictionaries, n-gram by n-gram."""
    n = quality.ORDER
    counts = {n: collections.Counter()}
    for t in texts:
        s = quality.START * (n - 1) + t
        for i in range(n - 1, len(s)):
            counts[n][s[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    v = len(counts[1]) + 1
    cuts = {}
    for k in counts:
        seen = collections.Counter(counts[k].values())
        n1, n2, n3, n4 = (max(1, seen[j]) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[k] = [min(max(j - (j + 1) * y * above / here, 0.05), j - 0.05) for j, here, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / v
        rest = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
        if not rest:
            return p(gram[1:])
        cut = lambda c: cuts[k][min(c, 3) - 1]
        c = counts[k][gram]
        return ((c - cut(c)) if c else 0) / sum(rest) + sum(map(cut, rest)) / sum(rest) * p(gram[1:])

    return p


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_perplexity_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(quality, "HEAD", head)
    monkeypatch.setattr(quality, "CHUNK", 7)
    monkeypatch.setattr(quality, "SHARED", 3)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS[:9], size=6)) for _ in range(12)] + ["é", ""]
    model = quality.kneser_ney(quality.count_grams(spark.createDataFrame([(t,) for t in texts], "text string")))
    probe = [texts[0], "THE river", "the  zzz 12!", "é😀", "the river zzz the river zzz"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*probe, "", None])], "k long, text string")
    got = {r["k"]: r for r in quality.perplexity(df, model).collect()}
    p = brute_kneser_ney(texts)
    n = quality.ORDER
    for k, t in enumerate(probe):
        s = quality.START * (n - 1) + t
        logs = [math.log(p(s[i - n + 1 : i + 1])) for i in range(n - 1, len(s))]
        assert math.isclose(got[k]["perplexity"], math.exp(-sum(logs) / len(logs)), rel_tol=1e-5)
        assert got[k]["symbols"] == len(t)
    assert got[5]["perplexity"] is None and got[6]["perplexity"] is None
    symbols = sorted({c for t in texts for c in t} | {"never"})
    assert all(math.isclose(sum(p(h + w) if len(w) == 1 else p(h + "?") for w in symbols), 1, rel_tol=1e-9) for h in ["    ", "rive"])


def test_quality(spark):
    rows, labels = corpus(4)
    rows += [(5000 + k, "!!%% ZXQJ ##" * 30, "en", "c", 1) for k in range(20)] + [(6000, None, "en", "c", 1), (6001, "", "en", "c", 1), (6002, WORDS[0], None, "c", 1), (None, "a quiet valley", "xx", "c", 1)]
    df = spark.createDataFrame(rows, DOCS)
    trusted = spark.createDataFrame([(k,) for k, _, _ in labels] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality.classify(df, trusted).collect()}
    assert len(got) == len(rows)
    assert sum(not got[k]["kept"] for k, _, _ in labels) <= 0.02 * len(labels)
    assert not any(got[5000 + k]["kept"] for k in range(20)) and not got[6000]["kept"] and not got[6001]["kept"]
    assert got[None]["threshold"] is not None and got[None]["kept"]
    # A document is kept if it does not exceed its language's quantile of trusted text held out.
    held = {r[0] for r in df.where(quality.held_out(F.col("doc_id"))).select("doc_id").collect()} & {k for k, _, _ in labels}
    steady = sorted(got[k]["steady"] for k in held)
    assert got[1]["threshold"] == steady[math.ceil(0.995 * len(steady)) - 1] == got[None]["threshold"]
    assert all(r["kept"] == (r["steady"] is not None and r["steady"] <= r["threshold"]) for r in got.values())
    nothing = {r["doc_id"]: r["kept"] for r in quality.classify(df, trusted.limit(0)).collect()}
    assert nothing[1] and not nothing[6000]
    assert quality.classify(df.limit(0), trusted).count() == 0
