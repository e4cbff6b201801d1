"""Threads, sessions, spans and claims of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import messages as m


def gap_sessions(rows: DataFrame, keys: Sequence[str], minutes: float, ts: str = "ts", tie: str = "id") -> DataFrame:
    """WIN-01: rows with `session`, numbered from 1 in each key; a gap of exactly the limit does not divide."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return rows.withColumn("__new", F.coalesce((gap > int(minutes * 60_000_000)).cast("int"), F.lit(1))).withColumn("session", F.sum("__new").over(w)).drop("__new")


def reply_roots(rows: DataFrame, *, forward_only: bool = False) -> DataFrame:
    """WIN-02, WIN-03, GRF-02: rows (id, reply_to, ts) with `root`, the first message of their reply chain.

    A reply to a message that is not there is a root; with forward_only, so is a
    reply to a later one. Roots are found by pointer jumping: each round doubles the
    distance, so n rows are done in log2(n) joins; every round is cut off
    by a checkpoint. What still moves then runs in a circle, whose members end at its smallest id.
    """
    from tidemill.sources.store import cut_lineage

    parent = rows.select(F.col("id").alias("__pid"), F.col("ts").alias("__pts"))
    ok = F.col("__pid").isNotNull()
    if forward_only:
        ok = ok & ((F.col("__pts") < F.col("ts")) | ((F.col("__pts") == F.col("ts")) & (F.col("__pid") < F.col("id"))))
    up = rows.join(parent, rows["reply_to"] == F.col("__pid"), "left").select("id", F.when(ok, F.col("__pid")).otherwise(F.col("id")).alias("up"))
    up = cut_lineage(up.withColumn("least", F.least("id", "up")))
    for _ in range(rows.count().bit_length() + 1):
        over = up.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("least").alias("__least"))
        jumped = up.join(over, "up").select("id", F.col("__up").alias("up"), F.least("least", "__least").alias("least"), (F.col("up") != F.col("__up")).alias("moved"))
        jumped = cut_lineage(jumped)
        moved = jumped.where("moved").limit(1).count()
        up = jumped.drop("moved")
        if not moved:
            break
    roots = up.alias("a").join(up.select(F.col("id").alias("rid"), F.col("up").alias("rup")), F.col("a.up") == F.col("rid")).select(
        "id", F.when(F.col("rup") == F.col("rid"), F.col("rid")).otherwise(F.col("a.least")).alias("root")
    )
    return rows.join(roots, "id")


def batch_threads(rows: DataFrame, minutes: float = 10) -> DataFrame:
    """WIN-01 and WIN-02 together: thread of each message: its reply chain, or, if it has none, its session in time.

    thread is 'r:' and the root, or 't:' and the session's number.
    """
    rooted = reply_roots(rows)
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select(F.col("root").alias("__root"))
    chained = rooted.join(sizes, F.col("root") == F.col("__root"), "left")
    replies = chained.where("__root is not null").withColumn("thread", F.concat(F.lit("r:"), F.col("root")))
    rest = gap_sessions(chained.where("__root is null"), ["channel"], minutes).withColumn("thread", F.concat_ws(":", F.lit("t"), "channel", "session")).drop("session")
    return replies.unionByName(rest).drop("__root", "root")


def spans(chains: DataFrame, *, useful: Column, question: Column, noise: Column) -> DataFrame:
    """WIN-04: spans of useful talk in chains (root, id, ts, text): (root, span, id, place, ts, text, useful, question).

    A chain's first message opens its spans, and does not count as useful itself. What ends a span lies within two
    messages of a useful one, so lags find it: a question that follows it, at once or after
    one idle message, begins the next span; the second of two idle messages is in none, and what comes after it
    opens with the chain's first message again. Spans without a useful message do not count.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    order = Window.partitionBy("root").orderBy("ts", "id")
    rows = chains.select("root", "id", "ts", "text", flag(useful).alias("useful"), flag(question).alias("question"), flag(noise).alias("noise"))
    message = F.struct("id", "ts", "text", "useful", "question")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("opener", F.first(message).over(order))
    counts = F.col("useful") & (F.col("n") > 1)
    asks = F.col("question") & ~F.col("useful") & ~F.col("noise") & (F.col("n") > 1)
    rows = rows.withColumn("kind", F.when(counts, "u").when(asks, "q").otherwise("i"))
    last, before = F.lag("kind", 1, "").over(order), F.lag("kind", 2, "").over(order)
    soon = (last == "u") | ((last == "i") & (before == "u"))
    rows = rows.withColumn("begins", (F.col("kind") == "q") & soon).withColumn("ends", (F.col("kind") == "i") & (last == "i") & (before == "u"))
    rows = rows.withColumn("span", F.sum((F.col("begins") | F.col("ends")).cast("int")).over(order)).where(~F.col("ends") & (F.col("n") > 1))
    whole = Window.partitionBy("root", "span")
    rows = rows.withColumn("good", F.max(F.col("kind") == "u").over(whole)).withColumn("asked", F.max("begins").over(whole)).withColumn("k", F.row_number().over(whole.orderBy("ts", "id")))
    place = F.col("k") - F.when(F.col("asked"), 1).otherwise(0)
    own = F.struct(place.alias("place"), message.alias("m"))
    opened = F.when((F.col("k") == 1) & ~F.col("asked"), F.array(F.struct(F.lit(0).alias("place"), F.col("opener").alias("m")), own)).otherwise(F.array(own))
    found = rows.where("good").select("root", F.col("span").cast("int").alias("span"), F.explode(opened).alias("x"))
    return found.select("root", "span", "x.m.id", F.col("x.place").cast("int").alias("place"), "x.m.ts", "x.m.text", "x.m.useful", "x.m.question")


def claims(span_rows: DataFrame) -> DataFrame:
    """WIN-05: claims of spans: one question with its first two useful answers, if the span begins with one, and up to three facts."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "id", "ts", "text", "useful", "question")))
    s = span_rows.groupBy("root", "span").agg(ordered.alias("ms"))
    full = F.array_join(F.transform("ms", lambda x: x["text"]), " ")
    s = s.select(
        "root", "span", F.col("ms")[0]["text"].alias("opener"), F.col("ms")[0]["question"].alias("asks"), full.alias("full"), F.size("ms").alias("chain_size"),
        F.transform(F.filter(F.slice("ms", F.lit(2), F.size("ms")), lambda x: x["useful"]), lambda x: x["text"]).alias("answers"),
        F.transform(F.slice("ms", 1, 5), lambda x: x["id"]).alias("source_msgs"), F.col("ms")[0]["ts"].alias("first_seen"), F.element_at("ms", -1)["ts"].alias("last_seen"),
    )
    question = F.when(F.col("asks"), F.col("opener")).otherwise(F.lit(""))
    qa = F.when(F.col("asks"), F.array(F.struct(F.lit("qa").alias("claim_type"), question.alias("question"), F.array_join(F.slice("answers", 1, 2), " ").alias("answer"))))
    facts = F.transform(F.slice("answers", 1, 3), lambda a: F.struct(F.lit("fact").alias("claim_type"), question.alias("question"), a.alias("answer")))
    out = s.withColumn("claim", F.explode(F.concat(F.coalesce(qa, F.array().cast("array<struct<claim_type:string,question:string,answer:string>>")), facts)))
    return out.select("root", "span", "claim.*", text.subject(F.col("full")).alias("subject"), text.category(F.col("full")).alias("category"), text.tags(F.col("full")).alias("tags"), "source_msgs", "first_seen", "last_seen", "chain_size")


def default_spans(chains: DataFrame) -> DataFrame:
    return spans(chains, useful=m.is_useful(F.col("text")), question=m.is_question(F.col("text")), noise=m.is_noise(F.col("text")))


def reply_history(rows: DataFrame) -> DataFrame:
    """JON-18: two steps up from each reply: (id, answer, question)."""
    by = rows.select(F.col("id").alias("pid"), F.col("text").alias("ptext"), F.col("reply_to").alias("pup"))
    gp = rows.select(F.col("id").alias("gid"), F.col("text").alias("gtext"))
    return rows.join(by, F.col("reply_to") == F.col("pid")).join(gp, F.col("pup") == F.col("gid")).select("id", F.col("ptext").alias("answer"), F.col("gtext").alias("question"))


def trailing_count(rows: DataFrame, keys: Sequence[str], seconds: int, ts: str = "ts") -> DataFrame:
    """WIN-07, WIN-08: rows with n, those of the key within so many seconds before and at theirs."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("n", F.count("*").over(w))


