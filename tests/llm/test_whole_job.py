"""Operators against brute force where a part of the job is easily left out."""

import numpy as np
import pytest

from tidemill.llm import packing, simhash, tokens, toxicity


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def altered(rng, words, n):
    """words with n of them replaced, evenly spread so that each replaces five shingles."""
    out = list(words)
    for k in np.linspace(5, len(out) - 6, n).astype(int) if n else []:
        out[k] = f"other{rng.integers(1 << 40)}"
    return " ".join(out)


def test_near_duplicates_by_exact_similarity(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(120):  # one word in fifty replaced gives 0.82, five in two hundred and twenty 0.79
        words = [f"w{k}" for k in rng.integers(0, 5000, 220)]
        texts += [" ".join(words), altered(rng, words, int(rng.integers(1, 9)))]
    words = [f"w{k}" for k in rng.integers(0, 5000, 220)]
    texts += [altered(rng, words, int(n)) for n in rng.integers(0, 7, 90)]  # a key of more than PAIR_GROUP
    texts += ["", None, "one two three four", "one two three", "one two three four", "a a a a", "a a a"]
    sets = [grams(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, kind=simhash.SIMILAR).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_encoding_as_the_json_by_default():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("end<|endoftext|>next", "<|endoftext|>", " a  <|endoftext|>  b ", "x<|endoftext|><|endoftext|>\n\n<|endoftext", "<|endof<|endoftext|>text|>", "don't\t日本語 😀<|endoftext|>\r\nÉté"):
        assert tokens.encode(t) == other.encode(t, add_special_tokens=False).ids


def test_packing_of_added_tokens(spark):
    df = spark.createDataFrame([(1, "end<|endoftext|>next")], "doc_id long, text string")
    assert packing.pack_documents(df).first()["ids"] == [437, 50256, 19545, 2]


def test_capitals_of_the_whole_text():
    voter = toxicity.Voters({})
    at = voter.NAMES.index("outcry")
    quiet, loud = "some plain words here " * 300, "YOU WORTHLESS IDIOT AND MORON " * 1000
    assert voter(quiet + loud)[0][at] == 1  # shouted beyond the first 4,096 characters
    assert voter(loud[:6000] + quiet * 10)[0][at] == 0  # a shouted head of a quiet text
    assert voter("1234 5678 " * 20 + "IDIOT")[0][at] == 1  # digits are no letters


def test_scores_do_not_depend_on_the_order_of_halves():
    voter = toxicity.Voters({" grolb": (0, 0), " snarf ": (1, 1)})
    calm, rude = "some plain words here " * 4000, "YOU GROLBAX and SNARF !! "
    one, two = voter(calm + rude), voter(rude + calm)
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
