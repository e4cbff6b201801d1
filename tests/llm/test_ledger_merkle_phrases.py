"""The rule ledger, the Merkle manifest and phrase mining against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import ledger, merkle, phrases

SPACES = r"[\x20\x09-\x0D]+"


# ---- the ledger


def measures_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}),
    }


def failed_by_hand(m):
    n = m["n_words"]
    tests = (n < 50, 100 * m["n_repeat_words"] > 50 * n, 100 * m["n_symbols"] > 10 * n, m["n_lines"] >= 5 and 100 * m["n_dup_lines"] > 40 * m["n_lines"])
    tests += (10 * m["word_chars"] < 25 * n or 10 * m["word_chars"] > 120 * n, 100 * m["n_capitals"] > 40 * m["word_chars"])
    return sum(1 << k for k, t in enumerate(tests) if t)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["a", "bb", "ccc", "dd#", "Éé", "GROß", "<x>", "word", "𝒳"]
    out = [None, "", " \n\t ", "a", "a a a", "a a a a", "one\ntwo\none\n\none \n", "x " * 60, "\x0b\x0c".join(["a", "b", "c"] * 30), "AAA BBB CCC " * 40, "#" * 500]
    for _ in range(60):
        n = rng.randrange(1, 120)
        out.append("".join(rng.choice(vocabulary[: rng.randrange(2, 10)]) + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(n)))
    return out


def test_measurements_and_bits(spark, texts):
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, kept string, failed int")
    rows = ledger.ledger(docs)
    assert rows.columns == ["doc_id", "kept", *ledger.MEASURES[:1], "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "failed"]
    got = sorted((r["doc_id"] or -1, *[r[m] for m in ledger.MEASURES], r["failed"]) for r in rows.collect())
    want = sorted((k if k % 7 and k else -1, *[m[x] for x in ledger.MEASURES], failed_by_hand(m)) for k, m in enumerate(map(measures_by_hand, texts)))
    assert got == want


def test_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    words[1000:1010] = words[2000:2010]
    text = " ".join(words)
    row = ledger.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == measures_by_hand(text)["n_repeat_words"] >= 20


def test_policies_and_ablations(spark, texts):
    rows = ledger.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    bits = {k: failed_by_hand(measures_by_hand(t)) for k, t in enumerate(texts)}
    for policy in ledger.POLICIES:
        m = ledger.mask(policy)
        assert {r["doc_id"]: r["kept"] for r in ledger.apply_policy(rows, policy).collect()} == {k: not b & m for k, b in bits.items()}
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in ledger.ablation(rows, policy).collect()}
        for k, rule in enumerate(ledger.RULES):
            if rule.name in ledger.POLICIES[policy]:
                only = sum(b & m == 1 << k for b in bits.values())
                assert got.pop(rule.name) == (sum(b >> k & 1 for b in bits.values()), only, only + sum(not b & m for b in bits.values()))
        assert not got
    # A policy of two rules by name is the same as its mask.
    assert ledger.mask(("symbols", "few_words")) == 5


def test_empty_ledger(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ledger.ledger(none).count() == 0 and ledger.ablation(ledger.ledger(none), "v2").count() == 0


# ---- the manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(nodes):
    """The root of nodes and each one's siblings, level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, i in enumerate(at):
            run, k = runs[i // 16], i % 16
            paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[leaf] = i // 16
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def manifest_by_hand(rows):
    """{(source, leaf): sorted paths} and {source: subroot} and the root of rows (doc_id, source, leaf)."""
    groups = collections.defaultdict(list)
    for doc_id, source, leaf in rows:
        groups[source].append((doc_id is not None, doc_id or 0, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_by_hand([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = tree_by_hand([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        out += [(str(s), *x, tuple(p + top), trees[s][0], root) for x, p in zip(sorted(groups[s]), trees[s][1])]
    return sorted(out)


def leaf(k):
    return h(f"leaf{k}")


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {None: 1, "a": 16, "b": 17, "é": 2}, {"hot": 700, "b": 257, None: 256, "c": 255, "d": 1}, {f"s{k}": 1 + k % 3 for k in range(300)}],
    ids=["one", "runs", "blocks", "many-groups"],
)
def test_manifest_by_hand(spark, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for i in range(n):
            rows.append((None if i == 3 else i // 2 - 5, source, leaf(k // 2)))  # ties, repeated rows, null and negative ids
            k += 1
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, leaf string, path string, root string")
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "source", "leaf", "path", "subroot", "root"]
    rows_got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("said", merkle.siblings_digest(F.col("path"))).collect()
    out = sorted((str(r["source"]), r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], tuple((p["left"], p["right"]) for p in r["path"]), r["subroot"], r["root"]) for r in rows_got)
    assert out == manifest_by_hand(rows)
    assert all(r["folded"] == r["root"] for r in rows_got)
    assert {r["said"] for r in rows_got} == {h(*[x for p in r[4] for x in p]) for r in out}


def test_leaf_encoding_and_tampering(spark):
    row = spark.createDataFrame([(7, None, "é", ""), (None, "a", None, "b")], "i long, s string, t string, u string")
    got = [r[0] for r in row.select(merkle.leaf_of(*[F.col(c) for c in row.columns])).collect()]
    assert got == [h("1:7", "-", "2:é", "0:"), h("-", "1:a", "-", "1:b")]
    rows = spark.createDataFrame([(k, "s", leaf(k)) for k in range(40)], "doc_id long, source string, leaf string")
    proved = merkle.manifest(rows).withColumn("other", merkle.fold(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("path")))
    assert proved.where("other = root").count() == 0


def test_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, leaf string")).count() == 0


# ---- phrases


def phrases_by_hand(docs, least=3, most=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    cands = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    dropped = set()
    for (lang, long_), f in cands.items():
        for m in range(2, len(long_)):
            for i in range(len(long_) - m + 1):
                if 100 * f >= 80 * counts[lang, long_[i : i + m]]:
                    dropped.add((lang, long_[i : i + m]))
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if (lang, p) not in dropped:
            cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most]))


def some_texts(seed=0, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "of", "ab", "a\x01", "a", "a\x00", "é", "É", "x\x1fy", "z", "lo", "ng", "\x01\x01", "q-r", "𝒳"] + [f"rare{k}" for k in range(200)]
    weights = [9, 9, 8, 5, 2, 5, 2, 3, 2, 2, 3, 3, 3, 1, 2, 1] + [0.05] * 200
    docs = [(None, None), (None, ""), ("en", "...,,,\n\n"), ("en", "\x0b\x0c\r"), ("und", "of the of the of the")]
    for _ in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b"]) for w in rng.choices(words, weights, k=rng.randrange(0, 60)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("en", "lo ng pass age")] * 10 + docs[20:30]


@pytest.mark.parametrize("least, most, hot, bits, held", [(3, 2000, 256, 1 << 24, 400_000), (2, 25, 8, 64, 30), (5, 10, 1000, 1 << 24, 7)], ids=["plain", "divided-words-full-filter", "small-lots"])
def test_phrases_by_hand(spark, monkeypatch, least, most, hot, bits, held):
    for name, value in (("HOT_SHARE", hot), ("FILTER_BITS", bits), ("HELD", held)):
        monkeypatch.setattr(phrases, name, value)
    docs = some_texts()
    df = spark.createDataFrame([(k, t, lang, "x", 5) for k, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n string, rank int").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, most=most).collect())
    assert got == phrases_by_hand(docs, least, most) and len(got) > 20


def test_scores_are_exact(spark):
    # Counts whose products pass 64 bits, from a table of counts alone.
    big = 6 * 10**12
    score = spark.sql(f"select (cast({big} as decimal(19,0)) * 2000000) div (cast({big} as decimal(19,0)) + cast({big + 7} as decimal(19,0)))").first()[0]
    assert score == 2_000_000 * big // (2 * big + 7)


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0
