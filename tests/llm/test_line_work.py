"""Line dedup: what its steps cost, lines as said, and the plan without broadcasts."""

import random

from test_text_ops import brute_lines

from tidemill.llm import common, lines

#: Bytes of code beyond which the JVM leaves a method to its interpreter (its option HugeMethodLimit).
HUGE_METHOD = 8000


def rows_of(n):
    """Lines of 1 to 30 words with one word or character changed here and there, and white space of all kinds."""
    rng = random.Random(n)
    words = "Alpha bravo ÇELIK delta Σίσυφος foxtrot golf 日本語 i İx".split()
    base = [[rng.choice(words) for _ in range(k)] for k in (1, 3, 5, 6, 7, 7, 8, 8, 9, 16, 17, 30)]
    out = []
    for i in range(n):
        said = []
        for _ in range(3):
            w = list(rng.choice(base))
            at, op = rng.randrange(len(w)), rng.randrange(6)
            w[at : at + 1] = {0: [], 1: ["zz"], 2: [w[at], "yy"], 3: [w[at][:-1] or "q"]}.get(op, [w[at].upper()])
            said.append(rng.choice(["", " ", "\t ", " " * 40]) + rng.choice([" ", "  ", "\x0b", " \r\x0c"]).join(w) + rng.choice(["", " ", "\r"]))
        out.append((i, "\n".join(said)))
    return [*out, (n, " \n\t\n"), (n + 1, "a" + " " * 100_000 + "b\nA B"), (n + 2, None), (n + 3, ""), (None, "a b")]


def test_lines_in_other_white_space_and_case(spark, monkeypatch):
    rows = rows_of(150)
    # İ in lower case is two characters in Python and in Spark alike; a final sigma, too, follows one rule.
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    got = lambda: {(r["doc_id"], r["line_no"]) for r in lines.duplicate_lines(df).collect()}
    assert got() == want and (151, 1) in want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert got() == want
    texts = dict(rows)
    for r in lines.dedup_lines(df).collect():
        parts = None if texts[r["doc_id"]] is None else texts[r["doc_id"]].split("\n")
        assert r["n_lines"] == len(parts or []) and r["n_removed"] == sum((r["doc_id"], k) in want for k in range(len(parts or [])))
        assert r["text"] == (None if parts is None else "\n".join(x for k, x in enumerate(parts) if (r["doc_id"], k) not in want))


def test_no_step_is_left_to_the_interpreter(spark, monkeypatch):
    """The code that Spark makes of each step is such as the JVM compiles, and tokens are not shuffled one by one ahead of the window."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan())
        return common.materialize(df)

    monkeypatch.setattr(lines, "materialize", seen)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan before the run is the one that runs
    try:
        df = spark.createDataFrame(rows_of(20), "doc_id long, text string")
        plans.append(lines.dedup_lines(df)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = []
    for plan in plans:
        made = debug.codegenStringSeq(plan)
        sizes += [made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())]
    assert len(sizes) > 20 and max(sizes) <= HUGE_METHOD
    window = [str(p.toString()) for p in plans if "Window" in p.toString()]
    assert len(window) == 1
    below = window[0][window[0].index("Window") :]
    assert below.index("Generate posexplode") < below.index("Exchange hashpartitioning(place")
