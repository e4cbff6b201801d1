"""Wiki rows, node trees, the index, runs with state, the pump, timers, pages: edge cases and brute force."""

import collections
import json
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import assembly, nodes, postings, projection, ranking, tagging, upkeep, wiki
from tidemill.streaming import pump as pumping
from tidemill.streaming import streams as st

# ---- wiki pages


def templates_by_hand(text):
    """Closed templates by matching braces from the inside out, one pair at a time."""
    found, taken = [], list(text)
    while m := re.search(r"\{\{(?:(?!\{\{|\}\}).)*\}\}", "".join(taken), re.S):
        found.append((m.start(), text[m.start() : m.end()]))
        taken[m.start() : m.end()] = "\0" * (m.end() - m.start())
    return sorted(found)


def test_templates_nest_and_stay_open():
    text = "{{see|name=A {{small|x=1|y}} b|content=[[L|label]] and more|name=Last}} {{eat|name=never closed {{do|alt=D|price = 5 = 6}} ]] [[cut {{buy|a|b}}"
    got = [(at, name) for at, name, _ in wiki.templates(text)]
    assert got == [(at, re.match(r"\{\{\s*([^|}\0]*)", t)[1].strip().lower()) for at, t in templates_by_hand(text)]
    fields = {name: f for _, name, f in wiki.templates(text)}
    assert fields["see"] == {"name": "Last", "content": "[[L|label]] and more"}
    assert fields["do"] == {"alt": "D", "price": " 5 = 6"} and fields["buy"] == {"1": "a", "2": "b"} and fields["small"] == {"x": "1", "2" if "2" in fields["small"] else "1": "y"}
    assert "eat" not in fields
    # A link that a template's end cuts off does not hide bars.
    assert next(wiki.templates("{{see|content=[[open|name=N}}"))[2] == {"content": "[[open", "name": "N"}
    assert not list(wiki.templates("{{" * 5000)) and len(list(wiki.templates("{{a}}" * 20_000))) == 20_000


def test_templates_random():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["{{", "}}", "x", "|", "=", "n"]) for _ in range(30))
        if "{{{" in text or "}}}" in text:
            continue
        assert [t[0] for t in wiki.templates(text)] == [t[0] for t in templates_by_hand(text)]


def test_wiki_pages(spark):
    long = "This paragraph is long enough to be kept, as it has over sixty characters."
    page = f"""A lead that is not read, however long it may be, since no heading comes before it at all.
== Get in ==
{long}

short

=== By plane ===
{long} Deeper headings belong to their section. {{{{see|name=Tower|content=A tall tower that is worth the climb|hours=9-17}}}}
==Odd one==
'''{long}''' [[Place|here]]
=Top=
{long} Not in a section of level two.
{{{{sleep|alt=Inn|address=[[Main Street|Main St]]|phone=555}}}} {{{{sleep|name=Skeleton|hours=always}}}} {{{{drink|content=has no name but much to say about itself}}}}"""
    rows = spark.createDataFrame([("br", "Town", page), ("br", "Empty", ""), ("br", "Null", None), (None, "Only", f"==See==\n{long}")], "country string, title string, text string")
    got = wiki.wiki_patterns(rows).orderBy("source_title", "idx").collect()
    assert [(r["source_title"], r["idx"], r["title"], r["tag"]) for r in got] == [
        ("Only", 0, "Only: See", "Travel"), ("Town", 0, "Tower", "Travel"), ("Town", 1, "Inn", "Accommodation"), ("Town", 2, "Town: Get in", "Bureaucracy"),
        ("Town", 4, "Town: Get in", "Bureaucracy"), ("Town", 5, "Town: Odd one", "Travel"),
    ]
    assert got[1]["instruction"] == "A tall tower that is worth the climb Hours: 9-17." and got[2]["instruction"] == "Address: Main St. Phone: 555."
    assert len({r["id"] for r in got}) == len(got) and all(len(r["id"]) == 24 for r in got)


# ---- nodes


def test_node_trees(spark):
    html = 'a<b href="x">c<i>d</b></i> &amp; e<br>f\n\n\n<p>g\nh</p><img src="y" alt>\n\n   '
    assert nodes.tree_of(html) == [
        {"tag": "p", "children": ["a", {"tag": "b", "attrs": {"href": "x"}, "children": ["c", {"tag": "i", "children": ["d"]}, " & e", {"tag": "br"}, "f"]}]},
        {"tag": "p", "children": [{"tag": "p", "children": ["g", {"tag": "br"}, "h"]}, {"tag": "img", "attrs": {"src": "y"}}]},
    ]
    assert nodes.tree_of(" \n ") == [{"tag": "p", "children": ["(empty)"]}]
    deep = "<div>" * 3000 + "x"
    assert json.dumps(nodes.tree_of(deep))
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, deep)], "page long, html string").select("page", nodes.html_nodes(F.col("html")).alias("tree"))
    each = nodes.walked(rows.where("page <> 4"))
    got = sorted((r["page"], tuple(r["path"]), r["tag"], r["text"]) for r in each.collect())

    def walk(children, path=()):
        for k, x in enumerate(children):
            yield (*path, k), x
            if isinstance(x, dict):
                yield from walk(x.get("children", []), (*path, k))

    want = [(p, path, x.get("tag") if isinstance(x, dict) else None, x if isinstance(x, str) else None) for p, h in ((1, html), (3, "")) for path, x in walk(nodes.tree_of(h))]
    assert got == sorted(want, key=lambda r: r[:2]) and {r["attrs"]["href"] for r in each.where("tag = 'b'").collect()} == {"x"}
    assert rows.where("page = 4 and tree is not null").count() == 1


def test_references_without_a_semicolon_stay_as_they_are():
    text = lambda html: "".join(x if isinstance(x, str) else "".join(x["children"]) for p in nodes.tree_of(html) for x in p["children"])
    assert text("<h1>and&amp</h1>a&lt b &copyx; &amp;lt; &#65; &#66 &notit; <i>R&amp;D</i> & &&nbsp;.") == "and&ampa&lt b &copyx; &lt; A &#66 &notit; R&D & &\xa0."
    # In scripts nothing is a reference; in attributes the same holds as in texts; what a text breaks off with waits.
    assert text('<script>if (a&b && c&amp;d) x="&amp";</script>') == 'if (a&b && c&amp;d) x="&amp";'
    assert nodes.tree_of('<a href="?a=1&copy=2&amp;b">x</a>')[0]["children"][0]["attrs"] == {"href": "?a=1&copy=2&b"}
    assert text("<b>x</b>y &amp") == "x"


def test_rental_words_begin_at_ascii_borders(spark):
    said = ["für fürentztz", "PARENTAL leave", "a Studios", "currentrent", None, "x_rent", "новrent", "depoſit"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").select("k", upkeep.is_rental(F.col("t")).alias("r")).collect()
    want = duckdb.execute("select k, regexp_matches(t, '(?i)\\b(?:rent|rental|lease|apartment|condo|landlord|deposit|studio|tenant)\\w*') from (select unnest(range(8)) as k, unnest(?::varchar[]) as t)", [said]).fetchall()
    assert {r["k"]: r["r"] for r in got} == dict(want) and dict(want)[0] and dict(want)[4] is None


# ---- the index


def test_index_reads_only_its_terms(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "alps", "al", "a", "beta", "übung", "überall", "1st", "10", "日本", "b-c"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 12))), k % 3) for k in range(200)] + [(200, None, 0), (201, "", 1)]
    texts = spark.createDataFrame(rows, "id long, text string, part int")
    path = str(tmp_path / "index")
    postings.write_index(texts, postings.words_of([F.col("text")]), path, carry=["part"])
    split = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t, _ in rows}
    for expression in ("alpha", "al*", "a*", "über*", "ü*", "日本 OR 10", "b OR c", "none*", "Alpha OR be*"):
        terms = expression.lower().split(" or ")
        hit = lambda w: any(w == t or (t.endswith("*") and w.startswith(t[:-1])) for t in terms)
        want = sorted((k, w, ws.count(w), len(set(ws))) for k, ws in split.items() for w in set(ws) if hit(w))
        found = postings.postings(spark, path, expression)
        assert sorted((r["id"], r["term"], r["n"], r["total"]) for r in found.collect()) == want, expression
    assert postings.postings(spark, path, None) is None and postings.postings(spark, path, "bad term") is None
    for expression, folders in (("alpha", {"t-al"}), ("al*", {"t-al"}), ("beta OR 10", {"t-be", "t-10"})):
        files = postings.postings(spark, path, expression).select(F.input_file_name().alias("f")).distinct().collect()
        plan = postings.postings(spark, path, expression)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and {re.search(r"folder=([^/]+)", r["f"])[1] for r in files} <= folders


def test_a_texts_words_are_told_once(spark, tmp_path, monkeypatch):
    """No step above the explosion counts a text's words again, none below it splits the text twice, and the postings are shuffled once."""
    from pyspark.sql import DataFrameWriter

    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (plans.append(self._df._jdf.queryExecution()), real(self, path, *a, **b))[1])
    texts = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "id long, text string")
    path = str(tmp_path / "index")
    postings.write_index(texts, postings.words_of([F.col("text")]), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("term", "id", "n", "total").collect())) == [("a", 1, 1, 2), ("b", 1, 2, 2)]
    above, below = plans[0].optimizedPlan().toString().split("Generate ")
    assert "array_distinct" not in above and "Filter" not in below
    assert plans[0].executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_a_text_is_split_once_and_large_folders_are_dealt_out(spark, tmp_path):
    """No sample of ranges splits each text a second time; words are counted in linear time where the text lies; a hot folder has several files."""
    rows = [(k, [*(["common"] * (k % 3)), "cold", f"co{k}", None if k % 5 else "übung"]) for k in range(3000)] + [(3000, []), (3001, None), (3002, [f"w{i % 60000}" for i in range(80000)])]
    texts, splits = spark.createDataFrame(rows, "id long, said array<string>").repartition(8), spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(said):
        splits.add(1)
        return said

    path, size = str(tmp_path / "index"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "8k")
    try:
        postings.write_index(texts, words("said"), path)
    finally:
        spark.conf.unset(size)
    assert splits.value == len(rows)
    counts = {k: collections.Counter(w for w in said or () if w) for k, said in rows}
    want = sorted((w, k, n, len(each)) for k, each in counts.items() for w, n in each.items())
    index = spark.read.parquet(path)
    assert sorted(map(tuple, index.select("term", "id", "n", "total").collect())) == want
    assert index.where("folder = 't-co'").select(F.input_file_name()).distinct().count() > 1


# ---- runs with state


def test_tagging_can_be_repeated(spark, tmp_path):
    rows = spark.range(40).toDF("id")
    state = str(tmp_path / "tags")
    good = lambda todo: todo.select("id", F.when(F.col("id") % 4 > 0, F.array(F.lit("x"))).alias("labels"))
    nothing = lambda todo: todo.select("id", F.lit(None).cast("array<string>").alias("labels"))
    assert tagging.tag_run(rows, good, state, 0, 10) == (7, 33, False)
    assert tagging.tag_run(rows, nothing, state, 1, 10) == (0, 33, True)
    assert tagging.tag_run(rows, lambda todo: good(todo).where("id <> 39"), state, 2) == (22, 11, False)
    first = sorted(map(tuple, tagging.tag_state(rows, state, 3).collect()))
    # A run that is done again, after it was killed, say, writes the same state.
    assert tagging.tag_run(rows, lambda todo: good(todo).where("id <> 39"), state, 2) == (22, 11, False)
    assert sorted(map(tuple, tagging.tag_state(rows, state, 3).collect())) == first
    assert {r[0]: r[3] for r in first if r[3]} == {0: 2, 4: 2, 8: 2} | {k: 1 for k in range(12, 40, 4)} | {39: 1}
    # Two failures of all that is left blame the rows: it takes three to see a fault of the run's own.
    assert tagging.tag_run(rows.where("id < 8"), nothing, state, 3) == (0, 0, False)
    dead = tagging.tag_state(rows, state, 4).where("dead").collect()
    assert sorted(r["id"] for r in dead) == [0, 4]


def test_pump_survives_kills(spark, tmp_path):
    """Killed after the first of a batch's writes, and after the last, before the checkpoint knows."""
    rows = [(k, None if k == 3 else f"text {k}") for k in range(24)]
    parts = [rows[:9], rows[9:18] + rows[:2], rows[18:], [(None, None)], [(None, None)]]

    def embed(due):
        return due.withColumn("v", F.when(F.col("id") % 5 > 0, F.array(F.col("id").cast("double"))))

    def pumped(name, killed):
        home = tmp_path / name
        for k, part in enumerate(parts):
            spark.createDataFrame(part, "id long, text string").coalesce(1).write.mode("append").parquet(f"{home}/in")
            handle = pumping.pump(embed, f"{home}/state", f"day {k // 3}", 7, junk=lambda todo: todo.where("id % 11 = 10"), strikes=3)

            def broken(df, batch, handle=handle, at={1: "points", 3: "waiting"}.get(k)):
                # As much of the batch is done as was written before the kill.
                from pyspark.sql import DataFrameWriter

                real = DataFrameWriter.parquet

                def write(self, path, *a, **b):
                    real(self, path, *a, **b)
                    if f"/{at}/batch=" in path:
                        raise RuntimeError("killed")

                DataFrameWriter.parquet = write
                try:
                    handle(df, batch)
                finally:
                    DataFrameWriter.parquet = real

            source = lambda: st.read_files(spark, f"{home}/in", "id long, text string")
            if killed and k in (1, 3):
                with pytest.raises(Exception, match="killed"):
                    st.each_batch(source(), broken, f"{home}/checkpoint").awaitTermination()
            st.each_batch(source(), handle, f"{home}/checkpoint").awaitTermination()
        return sorted(map(tuple, pumping.pumped(spark, f"{home}/state", "bigint", len(parts)).collect()))

    whole = pumped("whole", False)
    assert len(whole) == 24 and {r[1] for r in whole} == {"embedded", "skipped", "dropped", "waiting"}
    assert sum(r[1] == "embedded" for r in whole) <= 14 and (3, "dropped", 3, 2) in whole
    assert pumped("killed", True) == whole


def test_pump_moves_texts_once(spark, tmp_path, monkeypatch):
    """A batch writes a text as new, tried and done or waiting; whose turn it is goes through no single task."""
    from pyspark.sql import DataFrameWriter

    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (plans.append(self._df._jdf.queryExecution()), real(self, path, *a, **b))[1])
    embed = lambda due: due.withColumn("v", F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0))))
    state = str(tmp_path / "state")
    for batch, rows in enumerate(([(k, f"t{k}" if k % 4 else " ") for k in range(20)], [(k, f"t{k}") for k in range(15, 30)])):
        pumping.pump(embed, state, "day", 10, junk=lambda todo: todo.where("id % 10 = 9"))(spark.createDataFrame(rows, "id long, text string"), batch)
    found = {r["id"]: (r["status"], r["failures"], r["batch"]) for r in pumping.pumped(spark, state, "bigint", 2).collect()}
    first = [k for k in range(20) if k % 4 and k % 10 != 9][:10]
    for k in range(30):
        if k % 10 == 9:
            assert found[k] == ("skipped", 0, 0 if k < 20 else 1)
        elif k < 20 and k % 4 == 0:
            assert found[k] == ("waiting", 2, 0)
        elif k in first:
            assert found[k] == (("embedded", 0, 0) if k % 3 else ("waiting", 1, 0))
        else:
            assert found[k] == ("waiting", 0, 0 if k < 20 else 1)
    schemas = [p.optimizedPlan().schema().fieldNames() for p in plans]
    assert sum("text" in list(names) for names in schemas) == 2 * 5
    assert not any("Limit" in p.optimizedPlan().toString() for p in plans)


def test_forgiveness_by_hand():
    ladder = st.fixed.PENALTY_LADDER
    # Marked at 0: forgiven a step later, at 60; a refusal before that goes on the ladder.
    assert st.after_quiet((0, True, 10.0), 10.0 + ladder[0]) == ((0, True, 10.0), [])
    assert st.after_quiet((0, True, 10.0), 10.1 + ladder[0]) == ((0, False, 0.0), [(10.0 + ladder[0], "forgiven", 10.0)])
    assert st.after_quiet((2, False, 100.0), 100.0 + ladder[1] + 1)[1] == [(100.0 + ladder[1], "forgiven", 100.0)]
    assert st.after_quiet((0, False, 0.0), float("inf")) == ((0, False, 0.0), [])


def test_requests_of_one_time_go_by_id_and_others_move_nothing(spark):
    rng = random.Random(6)
    rows = [("ab"[rng.randrange(2)], float(rng.randrange(400) * 40), rng.choice([0, 0, 200, 429, 429]), k) for k in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at double, status int, id long").repartition(5)
    for replay, quiet in ((st.forgiving_penalties, True), (st.penalties, False)):
        want = []
        for key in "ab":
            state = (0, False, 0.0)
            for _, at, status, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
                state, said = st.after_quiet(state, at) if quiet else (state, [])
                *state, out = st.climb(*state, [(at, status)])
                state, want = tuple(state), want + [(key, *o) for o in said + out]
            want += [(key, *o) for o in (st.after_quiet(state, float("inf"))[1] if quiet else [])]
        got = replay(df)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        # What moves nothing stays out of the shuffle, and keys are not put together into one task.
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Filter .*status.* IN \(200,429\)", got._jdf.queryExecution().optimizedPlan().toString())


# ---- pages


def test_numbered_spreads_one_group(spark):
    rng = random.Random(8)
    rows = [("a" if k % 10 else None, rng.randrange(50), k) for k in range(3000)] + [("b", None, 5), ("b", None, 5)]
    df = spark.createDataFrame(rows, "g string, x int, id long").repartition(7)
    got = ranking.numbered(df, ["g"], ["x", "id"])
    assert got.columns == ["g", "x", "id", "position"]
    found = sorted((str(r["g"]), r["position"], r["x"] is not None, r["x"] or 0, r["id"]) for r in got.collect())
    want = []
    for g in ("None", "a", "b"):
        own = sorted((x is not None, x or 0, i) for h, x, i in rows if str(h) == g)
        want += [(g, k + 1, *r) for k, r in enumerate(own)]
    assert found == sorted(want)
    assert ranking.numbered(df.limit(0), ["g"], ["x"]).count() == 0


def test_titles_read_the_beginning_of_a_text_only(spark):
    from tidemill.plans.site import first_letters

    texts = ["", "12", "  ab", "Über a\nb-c D", "x" * 30, "1" * 50_000 + "abc", "日本 a1b2c3d4e5f6g7h8i9j0k1l2m3", None, "é" * 9 + " twelve letters on", "a\r\n\u2028b"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", first_letters(F.col("t"), 12).alias("title"))
    assert [r["title"] for r in df.orderBy("n").collect()] == [None if t is None else re.sub("[^A-Za-z ]", "", t)[:12] for t in texts]
    assert not re.search(r"regexp_replace\(t#", df._jdf.queryExecution().optimizedPlan().toString())


def test_account_is_whole(spark):
    items = spark.createDataFrame(
        [("ru", "br", "view", "Деньги", None, "money", k, "t") for k in range(5)] + [("ru", "br", "view", "Прочее", None, "money", 10 + k, None if k == 0 else "t") for k in range(4)]
        + [("ru", "br", "shelf", "Прочие деньги", "money", "money", 20 + k, "t") for k in range(3)] + [("en", "br", "view", "Деньги", "cash", None, 30 + k, "t") for k in range(4)]
        + [("ru", "br", "view", None, None, None, None, "t")] * 4 + [("ru", "lk", "view", "Мало", None, None, 40, "t")] * 2,
        "lang string, geo string, kind string, label string, key string, theme string, id long, text string",
    )
    names = spark.createDataFrame([("ru", "money", "Деньги и банки")], "lang string, theme string, name string")
    site = assembly.assemble(items, names, junk=["прочее"])
    assert site.placed.count() + site.unplaced.count() == items.count()
    assert {(r["path"], r["role"]): r["n"] for r in site.placed.groupBy("path", "role").agg(F.count("*").alias("n")).collect()} == {("/ru/br/dengi/", "item"): 5, ("/ru/br/s/money/", "rescued"): 3, ("/ru/br/s/money/", "item"): 3}
    assert {r["reason"]: r["n"] for r in site.unplaced.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"no text": 1, "not translated": 4, "no address": 4, "few": 2}
    assert [(r["on"], r["title"], r["n"]) for r in site.tiles.orderBy("on", "place").collect()] == [("/ru/br/", "Деньги и банки", 8), ("/ru/br/s/money/", "Деньги", 5)]
    assert {r["path"] for r in site.pages.where("kind = 'hub'").collect()} == {"/ru/br/"}
    empty = assembly.assemble(items.limit(0), names)
    assert not any(x.count() for x in empty)


def test_projection_carries_what_is_unchanged(spark):
    nodes_ = spark.createDataFrame([("br", "view", "n", "Деньги", k) for k in range(5)], "geo string, kind string, node string, label string, id long")
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(5)], "id long, text string")
    none = spark.createDataFrame([], "geo string, kind string, node string, src string, label string, id long, text string, h string")
    first = projection.project(nodes_, texts, none, lambda t: F.concat(t, F.lit(" one")), lambda x: F.lit("Money")).drop("carried")
    assert {(r["id"], r["text"], r["label"]) for r in first.collect()} == {(k, f"text {k} one", "Money") for k in range(5)}
    changed = texts.withColumn("text", F.when(F.col("id") == 1, "new").when(F.col("id") == 2, "gone").otherwise(F.col("text")))
    second = projection.project(nodes_, changed, first, lambda t: F.when(t != "gone", F.concat(t, F.lit(" two"))), lambda x: F.lit(None).cast("string"))
    assert {(r["id"], r["text"], r["carried"], r["label"]) for r in second.collect()} == {(0, "text 0 one", True, "Money"), (1, "new two", False, "Money"), (3, "text 3 one", True, "Money"), (4, "text 4 one", True, "Money")}
    third = projection.project(nodes_, changed.where("id > 1"), first, lambda t: F.when(t != "gone", t), lambda x: x)
    assert third.count() == 0  # two of five texts are left
    a, b = projection.signature(nodes_, texts), projection.signature(nodes_, changed)
    assert projection.stale(a, a).count() == 0 and [r["geo"] for r in projection.stale(b, a).collect()] == ["br"]


# ---- average link in rounds


def test_average_link_in_rounds(spark, monkeypatch):
    import numpy as np

    from tidemill.operators import clusters

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    x = np.repeat(centres, 16, axis=0) + rng.normal(scale=0.8, size=(80, 16))
    x = np.concatenate([x, x[:10], x[:3]])  # copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(int(k), x[k].tolist(), int(k * 7919 % 100)) for k in range(len(x))] + [(1000, None, 5)], "id long, v array<double>, length long")
    in_tasks = {r["id"]: (r["component"], r["rep"], r["n"]) for r in clusters.near_groups(rows, 0.55).collect()}
    monkeypatch.setattr(clusters, "ONE_TASK", 2)
    monkeypatch.setattr(clusters, "BLOCK", 24)
    in_rounds = {r["id"]: (r["component"], r["rep"], r["n"]) for r in clusters.near_groups(rows, 0.55).collect()}
    assert in_rounds == in_tasks and len(in_tasks) == len(x) + 1
    # By hand: merging over all rows at once, copies and all.
    label = clusters.average_link(x @ x.T, 0.55)
    by_hand = {}
    for c in np.unique(label):
        members = np.flatnonzero(label == c).tolist()
        rep = min(members, key=lambda k: (-(k * 7919 % 100), k))
        by_hand |= {k: (rep, len(members)) for k in members}
    assert {k: v[1:] for k, v in in_tasks.items() if k < 1000} == by_hand and in_tasks[1000] == (1000, 1000, 1)
    assert len({v[1] for v in in_tasks.values()}) < len(x) / 3


def test_blocks_of_vectors_meet_in_many_tasks(spark, monkeypatch):
    """Ranks with ties, all links, and a part of many clusters whose last merges are one by one, over blocks of a few rows."""
    import numpy as np

    from tidemill.operators import clusters

    monkeypatch.setattr(clusters, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 8))
    x[60:75] = x[:15]  # copies tie
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(int(k), x[k].tolist()) for k in range(90)], "id long, v array<double>")
    dot = lambda a, b: float(sum(p * q for p, q in zip(x[a].tolist(), x[b].tolist())))
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in clusters.nearest(rows.where("id % 5 = 0"), rows, 7, 0.3).collect()}
    want = {}
    for q in range(0, 90, 5):
        near = sorted((-dot(q, k), k) for k in range(90) if k != q and dot(q, k) >= 0.3)[:7]
        want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(near)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    links = {(a, b) for a in range(90) for b in range(a + 1, 90) if dot(a, b) >= 0.7}
    assert {(r["a"], r["b"]) for r in clusters.similar_pairs(rows, 0.7).collect()} == links
    # One pair that was tiled by part took a part of any size in one task; edges are no more than two a row and partition.
    edges = clusters.linking_edges(rows, 0.7)
    smallest = lambda e: {r["id"]: r["component"] for r in clusters.components(rows, e).collect()}
    assert edges.count() <= 2 * clusters.DEAL * 90 and smallest(edges) == smallest(spark.createDataFrame(sorted(links), "a long, b long"))
    parted = rows.withColumn("part", F.lit(0)).withColumn("n", F.lit(1))
    pairs = clusters.best_partners(parted.select("part", F.col("id").alias("cluster"), F.col("v").alias("m")), 0.3)
    best = {k: min((-dot(k, j), j) for j in range(90) if j != k) for k in range(90)}
    assert {r["cluster"]: r["partner"] for r in pairs.collect()} == {k: j for k, (s, j) in best.items() if -s >= 0.3}


def test_the_end_of_linking_takes_no_round_for_each_pair(spark, monkeypatch):
    import numpy as np

    from tidemill.operators import clusters

    # Each vector joins the one cluster there is: mutual best pairs are one a round.
    angle = np.cumsum(0.02 * 1.12 ** np.arange(18))
    rows = spark.createDataFrame([(k, [float(np.cos(a)), float(np.sin(a))], 1) for k, a in enumerate(angle)], "id long, v array<double>, n long").withColumn("part", F.lit(0))
    calls, plain = [], clusters.best_partners
    monkeypatch.setattr(clusters, "best_partners", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(clusters, "ONE_TASK", 17)
    got = {r["id"]: r["cluster"] for r in clusters.linked_in_rounds(rows, 0.5).collect()}
    x = np.column_stack([np.cos(angle), np.sin(angle)])
    assert got == dict(enumerate(clusters.average_link(x @ x.T, 0.5).tolist())) and len(calls) == 1


def test_texts_are_split_and_embedded_in_lots(spark):
    """A batch of texts is never held as pieces at once: what was split leaves before the rest becomes strings."""
    from tidemill.operators import external, sequences

    rows = spark.createDataFrame([(k, None if k % 7 == 0 else "ab " * k) for k in range(40)], "id long, t string")
    split = lambda t: [t[:9], t[9:]] if len(t) > 9 else [t]
    df = sequences.split_rows(rows, "id", "t", split)
    got = {(r["id"], r["piece"]): (r["pieces"], r["text"]) for r in df.collect()}
    assert got == {(k, n): (len(split("ab " * k)), p) for k in range(40) if k % 7 for n, p in enumerate(split("ab " * k))}
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    sizes = spark.createDataFrame([(k, [None, " ", "x y"][k % 3]) for k in range(2000)], "id long, t string").coalesce(1)
    model = lambda texts: [[float(len(texts)), 1.0]] * len(texts)
    calls = {(r["id"] % 3, r["v"] is None or r["v"][0] <= external.LOT) for r in sizes.select("id", external.embed(F.col("t"), model).alias("v")).collect()}
    assert calls == {(0, True), (1, True), (2, True)}
