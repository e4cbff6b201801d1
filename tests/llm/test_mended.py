"""Long runs of white space, single vectors, lines at the border of words and characters, shared ids, clashing columns."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat, curves, lines, packing, sharding, tokens

RUN = 2_000_000


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r", " ", " ", "　", " \n"])
def test_long_runs_of_white_space(plain, blank):
    run = blank * (RUN // len(blank) // 8)
    for text in (run, f"word{run}", f"{run}word", f"one{run} two <|endoftext|>"):
        assert tokens.encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_runs_about_the_limit(plain):
    for n in (tokens.LONG_RUN - 1, tokens.LONG_RUN, tokens.LONG_RUN + 1):
        for text in ("x" + " " * n + "y", "\n" * n, "a" + "\n " * (n // 2) + "<|endoftext|>"):
            assert tokens.encode(text) == plain.encode(text, add_special_tokens=False).ids
            said = tokens.encode(text, ordinary=True)
            assert tokens.encoder().decode(said) == text and 50_256 not in said


def test_packing_and_chat_of_long_runs(spark):
    text = "x" + " " * RUN + "y"
    rows = spark.createDataFrame([(1, text), (2, "\n" * RUN), (3, "short")], "doc_id long, text string")
    placed = packing.pack_documents(rows, keep_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in placed} == {k: len(tokens.encode(t)) + 1 for k, t in ((1, text), (2, "\n" * RUN), (3, "short"))}
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text + "<|endoftext|>")], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(turns)).first()
    assert back["loss_chars"] == len(text) + len("<|endoftext|>")


def test_chat_chunks_in_any_order(spark):
    turns = spark.createDataFrame([(c, k, "assistant" if k % 2 else "user", f"turn {k} " * 30) for c in range(5) for k in range(40)], "conv_id long, turn long, role string, text string")
    chunks = chat.format_conversations(turns, chunk_tokens=300)
    straight = sorted(map(tuple, chat.read_back(chunks).collect()))
    assert sorted(map(tuple, chat.read_back(chunks.withColumn("x", F.rand(3)).orderBy("x").repartition(6)).collect())) == straight and len(straight) == 5


def test_search_of_one_and_two_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (100, None, 1), (200, [0.0, 0.0], 1), (300, [float("nan"), 1.0], 1)], schema)
    assert curves.search(one, F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [1.0, 0.0], 2)], schema)
    assert [tuple(r) for r in curves.search(two, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 7, 2.0)]


def near_by_hand(a, b):
    """Within one word if either line has eight words or more, else within one character of lines of 16 or more."""
    wa, wb = a.lower().split(" "), b.lower().split(" ")
    if max(len(wa), len(wb)) < lines.WORDS:
        if min(len(a), len(b)) < lines.CHARACTERS:
            return False
        wa, wb = list(a.lower()), list(b.lower())
    if abs(len(wa) - len(wb)) > 1:
        return False
    short, long_ = sorted((wa, wb), key=len)
    if len(short) == len(long_):
        return sum(x != y for x, y in zip(short, long_)) <= 1
    return any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))


def test_lines_at_the_border(spark):
    rng = random.Random(6)
    words = "alpha bravo charlie delta echo foxtrot golf hotel india a b".split()
    texts = ["alpha bravo charlie delta echo foxtrot golf hotel", "alpha bravo charlie delta echo foxtrot golf", "a b c d e f g", "a b c d e f g h", "a b c d e f X"]
    for _ in range(150):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 10))]
        texts.append(" ".join(base))
        other = list(base)
        at = rng.randrange(len(other))
        match rng.randrange(3):
            case 0: other[at] = rng.choice(words)
            case 1: del other[at]
            case 2: other.insert(at, rng.choice(words))
        texts.append(" ".join(other))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in lines.dedup_lines(rows).collect() if r["n_removed"]}
    want = {k for k, t in enumerate(texts) if any(t.lower() == u.lower() or near_by_hand(t, u) for u in texts[:k])}
    assert got == want and {1, 3} <= got


def test_rows_that_share_an_id(spark):
    """Each of a shared or null id's rows loses its own lines, and takes its own time."""
    same = "this very line stands in all of the documents of this test"
    rows = [(None, f"{same}\nonly document {k} says {k * 7919} here and no other") for k in range(300)] + [(5, f"first {k} of its kind {k * 104729}\n{same}") for k in range(3)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 303
    by_id = {i: sorted((r["n_removed"], r["text"]) for r in got if r["doc_id"] == i) for i in (None, 5)}
    # Order is by id, nulls last, then line: rows of id 5 share the earliest place and keep theirs.
    assert [n for n, _ in by_id[5]] == [0, 0, 0] and all(n == 1 and t.startswith("only document") for n, t in by_id[None])


def test_pipeline_stage_keeps_clashing_columns(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "one line\none line", "en", "s", 17, "mine", 7)], "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_removed int")
    row = corpus_pipeline.drop_repeated_lines(spark, docs, "").first()
    assert (row["n_lines"], row["n_removed"], row["text"], row["n_chars"]) == ("mine", 7, "one line", 8)


def test_shards_of_shared_ids_agree(spark):
    rows = [(k % 3, f"text {k}") for k in range(200)]
    place = lambda df: {r["text"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(df, shards=5).collect()}
    a, b = (place(spark.createDataFrame(x, "doc_id long, text string").repartition(n)) for x, n in ((rows, 2), (rows[::-1], 7)))
    assert a == b and len(a) == 200 and zlib.crc32(b"") == 0
