"""Scalars, folds and streams on literals, against plain Python."""

import datetime as dt
import uuid

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import text as x
from tidemill.functions import values as fn
from tidemill.operators import clusters as c
from tidemill.operators import knowledge as k
from tidemill.operators import messages as m
from tidemill.operators import pages as p
from tidemill.operators import sequences as s
from tidemill.operators import tables as t
from tidemill.operators import threads
from tidemill.sources import store
from tidemill.streaming import streams


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first())


def test_sanitize(spark):
    v = F.col("v")
    for raw, want in [("a\nb", "ab"), ("x  y", "x y"), ("see https://a.b/c now", "see now"), ("@name hi #tag", "hi"), ("ＡＢ ①", "AB 1"), ("ok 😀!", "ok !"), (None, ""), ("कि", "क")]:
        assert one(spark, raw, x.sanitize(v)) == (want,)


def test_text_scalars(spark):
    v = F.col("v")
    assert one(spark, "```json\n[1]\n```", x.strip_fence(v)) == ("[1]",)
    assert one(spark, "a😀", x.utf16_len(v)) == (3,)
    assert one(spark, "Жёлтый дом, 2!", x.slug(v)) == ("zheltyy-dom-2",)
    assert one(spark, "日本", x.slug(v), x.slug(v, "tema")) == (None, "tema")
    assert [one(spark, u, x.url_handle(v))[0] for u in ("@Name", "https://t.me/s/abc", "tg://resolve?domain=qq", "https://x.org/a")] == ["name", "abc", "qq", None]
    head = "Сорок знаков без точки, потом ещё немного 1. Не тут"
    assert one(spark, head + ". Тут", x.lead(v))[0] == (head + ".", "Тут")
    assert one(spark, "{{t}} [[a|b]] '''c''' <i>d</i> [http://e f]", x.plain_wiki(v)) == ("b c d f",)
    assert one(spark, "br, RU;zz/any", x.geo_codes(v, ["br", "ru"])) == (["br", "ru", "any"],)
    assert one(spark, "br, zz", x.names_of(v, {"br": "Brazil"})) == ("Brazil, ZZ",)
    assert one(spark, "Карта Nubank и PIX", x.subject(v), x.tags(v)) == ("banking_access", ["pix", "банк", "карта"])
    assert one(spark, "Costs 335 at Sber", x.ungrounded(v, F.array(F.lit("costs 300 at bank"))))[0] == ["335", "Sber"]
    assert one(spark, "User is asking about visas", m.is_junk(v)) == (True,)
    assert one(spark, "information on visas", m.is_junk(v)) == (False,)  # openers keep their case
    assert one(spark, "Brain, where is it?", x.question_prefix(v, "brain")) == ("where is it?",)
    assert one(spark, "Ёлка!", x.bad_label(v, ["елка"])) == ("junk",)
    assert one(spark, "как дела", m.is_question(v)) == (True,)


def test_lemmas_with_a_lemmatizer(spark):
    assert one(spark, "cats cat a dogs", x.lemmas(F.col("v"), lambda w: w.str.rstrip("s"))) == (["cat", "dog"],)


def test_values(spark):
    v = F.col("v")
    assert one(spark, "abc", fn.uuid5(v)) == (str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc")),)
    assert one(spark, 'rows: [{"q": 1, "a": {"b": 2}}, {"x": 1}, {"q": 2', fn.salvage(v, "q")) == (['{"q": 1, "a": {"b": 2}}'],)
    assert one(spark, '{"rows": [{"q": "1"}, {"q": "2"}], "bad": oops}', fn.salvage(v, "q")) == (['{"q": "1"}', '{"q": "2"}'],)
    assert one(spark, '```json\n{"patterns": [{"t": "a"}]}\n```', fn.patterns_of(v, "struct<t:string>"))[0][0]["t"] == "a"
    assert one(spark, "not json", fn.patterns_of(v, "struct<t:string>")) == ([],)
    assert one(spark, "Please retry in 12.5s", fn.retry_after(v)) == (12.5,)
    assert one(spark, "[1", fn.from_json_list(v)) == ([],)
    assert one(spark, "2024-05-06_x.txt", F.date_format(fn.file_day(v), "yyyy-MM-dd HH")) == ("2024-05-06 12",)
    assert one(spark, dt.datetime(2024, 1, 2, 3), fn.quota_day(F.col("v")), kind="timestamp") == (dt.date(2024, 1, 1),)


def test_keyword_expression(spark):
    assert m.keyword_expression(["war", " ", "drone*"]) == "war OR drone*"
    assert m.keyword_expression([]) is None and m.matches("foo-bar", [F.col("v")]) is None
    got = [one(spark, w, m.matches("war OR drone*", [F.col("v")]))[0] for w in ("the WAR.", "warm", "drones!", "adrone")]
    assert got == [True, False, True, False]


def test_fallbacks(spark):
    rows = spark.createDataFrame([("1", "c", dt.datetime(2024, 1, 1), "war"), ("2", "c", dt.datetime(2024, 1, 2), "peace")], "id string, channel string, ts timestamp, text string")
    ids = lambda words: [r["id"] for r in m.relevant(rows, words).collect()]
    assert (ids(["war"]), ids(["none"]), ids(["foo-bar"]), ids([]), ids(["2024"])) == (["1"], ["1", "2"], ["1", "2"], ["1", "2"], ["1", "2"])


@given(st.text("ab \n😀", max_size=80), st.integers(2, 12))
@settings(max_examples=150, deadline=None)
def test_line_chunks(text, most):
    parts = s.line_chunks(text, most)
    assert parts and all(s.utf16_units(q) <= most for q in parts)
    assert "".join(parts).replace("\n", "") == text.replace("\n", "")


@given(st.text("ab. \n", max_size=400), st.integers(5, 30))
@settings(max_examples=150, deadline=None)
def test_overlapping_pieces(text, tokens):
    parts = s.overlapping_pieces(text, tokens, 10)
    assert all(len(q) <= 3 * tokens or len(parts) == 1 for q in parts)
    assert parts[0] == text[: len(parts[0])] and text.rstrip().endswith(parts[-1].rstrip())


def test_pack(spark):
    sizes = [3, 4, 9, 20, 1, 1, 1, 1, 9]
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate(sizes)], "key string, i int, size int")
    assert [r["part"] for r in s.pack(df, "key", ["i"], "size", 10, 3).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 3, 4, 4]


def span_twin(flags):
    """Spans of one chain of (useful, question, noise), written as a walk over index lists."""
    spans, start, held, good, idle = [], [0], [0], 0, 0
    for i, (use, ask, dull) in enumerate(flags[1:], 1):
        held = [*held, i]
        if use:
            good, idle = good + 1, 0
        elif not dull and ask and good >= 1 and len(held) >= 3:
            spans.append(held[:-1])
            held, good, idle = [i], 0, 0
            continue
        else:
            idle += 1
        if idle >= 2 and good >= 1:
            spans.append(held[:-1])
            held, good, idle = [*start], 0, 0
    if len(held) >= 2 and good >= 1:
        spans.append(held)
    return [x for x in spans if len(x) >= 2 and any(flags[i][0] for i in x[1:])]


def test_spans(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for root in range(60):
        flags = [tuple(map(bool, rng.integers(0, 2, 3))) for _ in range(int(rng.integers(1, 14)))]
        rows += [(str(root), f"{i:03}", dt.datetime(2024, 1, 1, 0, i), "".join("uqn"[j] for j in range(3) if f[j])) for i, f in enumerate(flags)]
        want[str(root)] = [[f"{i:03}" for i in x] for x in span_twin(flags)]
    df = spark.createDataFrame(rows, "root string, id string, ts timestamp, text string")
    t_ = F.col("text")
    got = threads.spans(df, useful=t_.contains("u"), question=t_.contains("q"), noise=t_.contains("n")).orderBy("root", "span", "place").collect()
    out = {r: [] for r in want}
    for r in got:
        if len(out[r["root"]]) <= r["span"]:
            out[r["root"]].append([])
        out[r["root"]][r["span"]].append(r["id"])
    assert out == want


def test_claims(spark):
    base = dt.datetime(2024, 1, 1)
    msgs = ["где банк?", "можно в itau", "ок", "дают карту за 5 дней", "нужен cpf", "нужен паспорт"]
    df = spark.createDataFrame([("r", f"{i}", base + dt.timedelta(minutes=i), q) for i, q in enumerate(msgs)], "root string, id string, ts timestamp, text string")
    got = threads.claims(threads.default_spans(df)).collect()
    assert [r["claim_type"] for r in got] == ["qa", "fact", "fact", "fact"]
    assert got[0]["answer"] == "можно в itau дают карту за 5 дней" and got[0]["category"] == "finance" and got[0]["source_msgs"] == list("01234")


def test_reply_roots_with_cycles_and_depth(spark):
    rows = [(f"a{i}", f"a{i - 1}" if i else None, i) for i in range(300)] + [("x", "y", 1), ("y", "z", 2), ("z", "x", 3), ("lost", "gone", 4), ("late", "later", 5), ("later", None, 6)]
    df = spark.createDataFrame([(i, r, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)) for i, r, n in rows], "id string, reply_to string, ts timestamp")
    got = {r["id"]: r["root"] for r in threads.reply_roots(df).collect()}
    assert {got[f"a{i}"] for i in range(300)} == {"a0"} and got["lost"] == "lost" and got["late"] == "later"
    assert {got["x"], got["y"], got["z"]} == {"x"}
    forward = {r["id"]: r["root"] for r in threads.reply_roots(df, forward_only=True).collect()}
    assert forward["late"] == "late" and forward["a299"] == "a0"


def test_gap_is_inclusive(spark):
    at = [0, 600, 1201]
    df = spark.createDataFrame([("c", str(i), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)) for i, n in enumerate(at)], "channel string, id string, ts timestamp")
    assert [r["session"] for r in threads.gap_sessions(df, ["channel"], 10).orderBy("id").collect()] == [1, 1, 2]


def average_link_twin(sim, thr):
    cl = [[i] for i in range(len(sim))]
    while len(cl) > 1:
        scored = [(np.mean([sim[a][b] for a in cl[i] for b in cl[j]]), -i, -j) for i in range(len(cl)) for j in range(i + 1, len(cl))]
        best = max(scored)
        if best[0] < thr:
            break
        cl[-best[1]] += cl.pop(-best[2])
    return {frozenset(x) for x in cl}


def test_average_link():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.normal(size=(14, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        label = c.average_link(v @ v.T, 0.6)
        assert {frozenset(np.flatnonzero(label == g).tolist()) for g in set(label.tolist())} == average_link_twin((v @ v.T).tolist(), 0.6)


def test_merge_claims(spark):
    rows = [(1, "br", "c", "where is the bank office", "here", ["a"], ["m1"], 1), (2, "br", "c", "bank office where", "over there now", ["b"], ["m2"], 2), (3, "br", "c", "visa rules", "x", [], ["m3"], 1), (4, "br", "c", " ", "x", [], [], 1)]
    df = spark.createDataFrame(rows, "id int, country string, category string, question string, answer string, tags array<string>, source_msgs array<string>, count int")
    got = {r["id"]: r for r in k.merge_claims(df).collect()}
    assert set(got) == {1, 3} and got[1]["count"] == 3 and got[1]["answer"] == "over there now" and got[1]["tags"] == ["a", "b"]
    assert (got[1]["confidence"], got[3]["confidence"]) == ("high", "low")


def merge_claims_twin(rows, threshold):
    """All stored rows compared with each claim: (id, count, newest of the answers of the greatest length, sources) of each."""
    stored = []
    for stamp, (i, category, question, answer) in enumerate(sorted(rows)):
        mine = set(question.split())
        near = [(len(mine & s["words"]) / min(len(mine), len(s["words"])), s["stamp"], s) for s in stored if s["category"] == category and mine & s["words"]]
        best = max(near, key=lambda x: x[:2], default=(0, 0, None))
        if best[2] and best[0] >= threshold:
            best[2].update(stamp=stamp, answer=max(best[2]["answer"], answer, key=len), sources=best[2]["sources"] + [i])
        else:
            stored.append({"id": i, "category": category, "words": mine, "answer": answer, "stamp": stamp, "sources": [i]})
    return sorted((s["id"], str(s["category"]), s["answer"], len(s["sources"]), s["sources"]) for s in stored)


def test_merge_claims_meets_few_stored_rows(spark):
    rng = np.random.default_rng(11)
    word = lambda: f"w{int(rng.zipf(1.3)) % 300}"
    rows = [(int(k), rng.choice(["a", "b", "c", None]), " ".join(word() for _ in range(rng.integers(1, 13))), "x" * int(rng.integers(1, 9))) for k in rng.permutation(600)]
    df = spark.createDataFrame([(*r, [], [r[0]], 1, "br") for r in rows], "id long, category string, question string, answer string, tags array<string>, source_msgs array<long>, count int, country string").repartition(5)
    for threshold in (0.6, 0.34, 1.0):
        merged = k.merge_claims(df, threshold)
        assert sorted((r["id"], str(r["category"]), r["answer"], r["count"], r["source_msgs"]) for r in merged.collect()) == merge_claims_twin(rows, threshold)
    # Categories are not put together into one task.
    assert "REPARTITION_BY_NUM" in merged._jdf.queryExecution().executedPlan().toString()
    # Words that all have lead to no stored row, if the rare ones differ.
    stored = k._Stored({f"common{n}": n for n in range(4)}, 0.6)
    for n in range(500):
        stored.fold({"id": n, "words": [f"common{m}" for m in range(4)] + [f"own{n}-{m}" for m in range(8)], "tags": [], "source_msgs": [], "count": 1, "question": "", "answer": ""})
    assert len(stored.rows) == 500 and max(map(len, stored.by_first.values())) == 1
    assert all(len(stored.by_word[w]) == 1 for w in stored.by_first)


def test_carry_forward(spark):
    new = spark.createDataFrame([("n1", [1, 2, 3, 4]), ("n2", [5, 6, 7]), ("n3", [9])], "key string, ids array<int>")
    old = spark.createDataFrame([("o1", [1, 2, 3, 4]), ("o2", [5, 6, 7, 8]), ("o3", [1, 2, 3])], "key string, ids array<int>")
    assert {(r["new_key"], r["old_key"]) for r in k.carry_forward(new, old).collect()} == {("n1", "o1"), ("n2", "o2")}


def test_unique_names_pass_over_taken(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a")], "id int, name string")
    assert [r["unique_name"] for r in p.unique_names(df.withColumn("geo", F.lit("g")), ["geo"], "name", ["id"]).orderBy("id").collect()] == ["a", "a-3", "a-2", "a-4"]


def test_rotation(spark):
    df = spark.createDataFrame([(1, "br", 5), (2, "br", 3), (3, "de", 9), (4, "lk", 1)], "id int, country string, stamp int")
    take = lambda recent: p.rotation(df, recent).first()["id"]
    assert (take([]), take(["br"]), take(["br", "de"]), take(["lk"]), take(["br", "lk", "de"])) == (2, 3, 4, 2, 4)


def test_points_of_a_wrong_size_fail(spark, tmp_path):
    import pytest

    good = spark.createDataFrame([("c", [1.0, 2.0])], "collection string, v array<double>")
    store.write_points(good, f"{tmp_path}/p", 2)
    with pytest.raises(Exception, match="components"):
        store.write_points(good, f"{tmp_path}/q", 3)


def test_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"question": "q", "answer": "long enough answer"}\n\nbroken\n{"question": "q", "answer": "short"}\n')
    rows = store.claims_file(spark, f"{tmp_path}/c.jsonl", "br").cache()
    assert (rows.count(), rows.where("_corrupt is not null").count()) == (2, 1)
    (tmp_path / "s" / "br").mkdir(parents=True)
    (tmp_path / "s" / "br" / "one.txt").write_text("x\ny")
    (tmp_path / "s" / "br" / "two.txt").write_text("z")
    got = store.sample_files(spark, f"{tmp_path}/s", spark.createDataFrame([("two.txt",)], "name string")).collect()
    assert [(r["name"], r["country"], r["text"]) for r in got] == [("one.txt", "br", "x\ny")]
    store.write_shards(spark.createDataFrame([("en", "/b"), ("en", "/a"), ("de", "/c")], "lang string, url string"), f"{tmp_path}/w")
    assert spark.read.text(f"{tmp_path}/w/lang=en").count() == 2


def test_penalty_ladder():
    *_, out = streams.climb(0, False, 0.0, [(1000 + at, status) for at, status in [(0, 429), (10, 429), (80, 429), (400, 429), (2300, 429), (8400, 429), (8500, 200), (8600, 429)]])
    assert [v for _, v, _ in out] == ["mark", "wait", "wait", "wait", "wait", "day_ban", "mark"]
    *_, out = streams.climb(0, False, 0.0, [(1000, 429), (1100, 429)])
    assert [v for _, v, _ in out] == ["mark", "mark"]  # a minute of quiet forgets the mark


def test_penalty_stream_equals_replay(spark, tmp_path):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"key": rng.choice(["a", "b"], 200), "at": np.cumsum(rng.exponential(90, 200)), "status": rng.choice([200, 429, 429], 200)})
    df = spark.createDataFrame(pdf)
    for n, (lo, hi) in enumerate([(0, 100), (100, 200)]):
        spark.createDataFrame(pdf.iloc[lo:hi]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    got = []
    for n in range(2):
        spark.read.parquet(f"{tmp_path}/in{n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = streams.read_files(spark, f"{tmp_path}/in", df.schema)
        q = streams.each_batch(streams.penalty_stream(source), lambda b, _: got.extend(map(tuple, b.collect())), f"{tmp_path}/state")
        q.awaitTermination()
    assert sorted(got) == sorted(map(tuple, streams.penalties(df).collect()))


def test_table_semantics(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 4), (2, "d", 5), (3, "e", 0), (3, "f", 1)], "k int, v string, n int")
    assert {tuple(r) for r in t.upsert(old, new, ["k"], F.col("n")).collect()} == {(1, "a", 1), (2, "d", 5), (3, "f", 1)}
    assert {tuple(r) for r in t.insert_if_absent(old, new, ["k"], [F.asc("n")]).collect()} == {(3, "e", 0)}
    assert {tuple(r) for r in t.patch(old.withColumn("v", F.when(F.col("k") == 1, F.col("v"))), new.where("n > 3").dropDuplicates(["k"]).select("k", F.lit("z").alias("v")), ["k"], only_nulls=True).collect()} == {(1, "a", 1), (2, "z", 5)}


def test_external_maps(spark):
    from tidemill.operators import external as e

    df = spark.createDataFrame([(1, "good morning"), (2, None), (3, " ")], "id int, text string")
    got = df.select("id", e.embed(F.col("text"), e.HashEmbedder(8)).alias("v"), e.ask_rows(F.col("text"), e.echo, "patterns", "struct<patterns:array<struct<title:string>>>").alias("r")).orderBy("id").collect()
    assert len(got[0]["v"]) == 8 and got[1]["v"] is None and got[2]["v"] is None
    assert got[0]["r"][0]["patterns"][0]["title"] == "good" and not got[1]["r"]


def test_sample_targets(spark):
    df = spark.createDataFrame([(1, "https://t.me/+abc", 7), (2, "@name", 8), (3, None, 9), (4, "https://x.org", None)], "id int, url string, chat_id long")
    assert {tuple(r) for r in p.sample_targets(df).collect()} == {(1, "7"), (2, "name"), (3, "9")}
