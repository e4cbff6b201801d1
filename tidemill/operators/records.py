"""Knowledge, source and quota records: writes, lookups, orders and small reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import clusters, messages, tables


def questions(patterns: DataFrame, text: str = "body") -> DataFrame:
    """SRC-14: what src13 leaves out: rows whose text narrates a question or nothing."""
    return patterns.where(messages.is_junk(F.col(text)))


def with_bans(counts: DataFrame, bans: DataFrame) -> DataFrame:
    """SNK-07: counts (key_hash, model, day, n, banned) after bans (key_hash, model, day): a pair's day is banned once; pairs without a count begin at 0."""
    keys = ["key_hash", "model", "day"]
    both = counts.unionByName(bans.select(*keys, F.lit(0).cast("long").alias("n"), F.lit(True).alias("banned")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.bool_or("banned").alias("banned"))


def quota_states(pairs: DataFrame, counts: DataFrame, day: str) -> DataFrame:
    """MSC-05: pairs (key_hash, model) with the day's count and ban; 0 and false without a row."""
    today = counts.where(F.col("day") == day).select("key_hash", "model", "n", "banned")
    return pairs.join(today, ["key_hash", "model"], "left").select("key_hash", "model", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("banned", F.lit(False)).alias("banned"))


def exhausted_models(states: DataFrame, cap: int) -> DataFrame:
    """MSC-06: (model, exhausted): whether no key of the model has capacity left."""
    return states.groupBy("model").agg(F.bool_and(F.col("banned") | (F.col("n") >= cap)).alias("exhausted"))


def with_caps(consumers: DataFrame, caps: DataFrame, default: int) -> DataFrame:
    """MSC-17: consumers (consumer) with their cap, or the default."""
    return consumers.join(caps, "consumer", "left").withColumn("cap", F.coalesce("cap", F.lit(default)))


def new_knowledge(rows: DataFrame, now: Column, lemmas: Callable[[Column], Column]) -> DataFrame:
    """SNK-08: rows (question, answer, tags) as stored: lemmas of question, answer and tags, both timestamps, not outdated."""
    said = F.concat_ws(" ", "question", "answer", F.array_join("tags", " "))
    return rows.withColumn("lemmas", lemmas(said)).withColumn("created", now).withColumn("last_updated", now).withColumn("is_outdated", F.lit(0))


def with_lemmas(rows: DataFrame, lemmas: Callable[[Column], Column]) -> DataFrame:
    """TXT-09: rows whose lemmas are missing get them; the others keep theirs."""
    return rows.withColumn("lemmas", F.coalesce("lemmas", lemmas(F.concat_ws(" ", "question", "answer", F.array_join("tags", " ")))))


def searchable(entries: DataFrame, country: str | None = None) -> DataFrame:
    """TOP-01's filter: entries that are not outdated, of one country if one is given."""
    live = entries.where(F.coalesce(F.col("is_outdated"), F.lit(0)) == 0)
    return live if country is None else live.where(F.col("country") == country)


def marked(rows: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """SNK-11: rows with a column set for the given ids (id)."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, "id", "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit")


def source_changes(sources: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """SNK-17: sources (country, url, name, active) after changes: a new url enters once, one that is there stays as it is; removed ones (url) are switched off."""
    off = removed.select("url").distinct().withColumn("__off", F.lit(1))
    have = sources.unionByName(tables.insert_if_absent(sources, added, ["url"], [F.asc("name")]).select(*sources.columns))
    return have.join(off, "url", "left").withColumn("active", F.when(F.col("__off") == 1, 0).otherwise(F.col("active"))).select(*sources.columns)


def active_sources(sources: DataFrame, country: str) -> DataFrame:
    """MSC-03: active sources of a country, by name."""
    return sources.where((F.col("active") == 1) & (F.col("country") == country)).orderBy("name", "url")


def url_countries(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """MSC-04: urls (url) with the country of the source of smallest id that has the url, or null."""
    first = sources.groupBy("url").agg(F.min_by("country", "id").alias("country"))
    return urls.join(first, "url", "left")


def done_and_dead(tries: DataFrame, least: int = 3) -> DataFrame:
    """FLT-22: (id, state) of tries (id, ok): done after a success, dead after so many failures and none."""
    sums = tries.groupBy("id").agg(F.bool_or("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    return sums.where(F.col("done") | (F.col("failed") >= least)).select("id", F.when(F.col("done"), "done").otherwise("dead").alias("state"))


def leftovers(items: DataFrame, placed: DataFrame, stalled: DataFrame) -> DataFrame:
    """SET-07: items (id) that are neither on a page (id) nor stalled (id)."""
    return items.join(placed.select("id").unionByName(stalled.select("id")).distinct(), "id", "left_anti")


def kept_views(views: DataFrame) -> DataFrame:
    """FLT-19: views (key, label, address, collective) with the reason why they are left out, or null."""
    reason = F.when(F.col("address").isNull(), "no address").when(F.coalesce(F.trim("label"), F.lit("")) == "", "untranslated").when(F.col("collective"), "collective")
    return views.withColumn("reason", reason)


def addressed(rows: DataFrame, label: str, slug: Callable[[Column], Column]) -> DataFrame:
    """PG-04, MSC-25: rows with an address: their key, else the slug of their label; rows without either go."""
    return rows.withColumn("address", F.coalesce(F.nullif(F.trim("key"), F.lit("")), slug(F.col(label)))).where("address is not null")


def shelves(facts: DataFrame, least: int = 3) -> DataFrame:
    """PG-03: (shelf, n) of facts (shelf, id) with enough items."""
    return facts.groupBy("shelf").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least)


def carved_views(tagged: DataFrame, least: int = 3) -> DataFrame:
    """VEC-16: (id, view): tagged (id, shelf, deal) by shelf and deal; thin views and ids without a deal go to the shelf's tail."""
    view = F.concat_ws("/", "shelf", "deal")
    sized = tagged.withColumn("__n", F.count("*").over(Window.partitionBy("shelf", "deal")))
    return sized.select("id", F.when(F.col("deal").isNotNull() & (F.col("__n") >= least), view).otherwise(F.concat_ws("/", "shelf", F.lit("tail"))).alias("view"))


def context_matches(queries: DataFrame, collections: Sequence[tuple[str, DataFrame, int]], least: float = 0.55) -> DataFrame:
    """TOP-06, MSC-12: (query, source, id, rank, score): each collection's nearest rows (id, v) to queries (id, v), at or above a similarity, with the collection's name."""
    out = None
    for name, rows, limit in collections:
        part = clusters.nearest(queries, rows, limit, least).withColumn("source", F.lit(name)).select("query", "source", "id", "rank", "score")
        out = part if out is None else out.unionByName(part)
    return out


def grounded(matches: DataFrame, queries: DataFrame, near: float = 0.9) -> DataFrame:
    """EXT-10: (query, decision) by the best match: 'known' from `near` on, 'grounded' with any, else 'none'."""
    best = matches.groupBy("query").agg(F.max("score").alias("best"))
    return queries.select(F.col("id").alias("query")).join(best, "query", "left").select("query", F.when(F.col("best") >= near, "known").when(F.col("best").isNotNull(), "grounded").otherwise("none").alias("decision"))


def retrieval_eval(ranked: DataFrame, relevant: DataFrame, top: int = 10, least: int = 5) -> DataFrame:
    """AGG-22: (query, hits, passed): relevant (query, id) rows among the first of ranked (query, id, rank)."""
    first = ranked.where(F.col("rank") <= top)
    hit = first.join(relevant.select("query", "id").distinct().withColumn("__hit", F.lit(1)), ["query", "id"], "left")
    return hit.groupBy("query").agg(F.count("__hit").alias("hits")).withColumn("passed", F.col("hits") >= least)


def paced(requests: DataFrame, per_minute: int) -> DataFrame:
    """WIN-14: requests (key, at, tokens) with `next_at`, in seconds, the earliest time of the key's next, and whether it was kept to."""
    after = F.col("at") + F.col("tokens") / per_minute * 60
    before = F.lag("next_at").over(Window.partitionBy("key").orderBy("at", "tokens"))
    return requests.withColumn("next_at", after).withColumn("in_time", F.coalesce(F.col("at") >= before, F.lit(True)))


def strict_rows(rows: DataFrame, roles: Sequence[str]) -> DataFrame:
    """FN-06: rows (id, raw): raw is a JSON list of six: three texts, a role, and two numbers. (id, a, b, c, role, x, y); anything else is null."""
    parts = F.from_json("raw", "array<string>")
    number = lambda k: F.when(F.get(parts, F.lit(k)).rlike(r"^-?\d+(\.\d+)?$"), F.get(parts, F.lit(k))).try_cast("double")
    texts = [F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")) for k in range(3)]
    role = F.get(parts, F.lit(3))
    good = (F.size(parts) == 6) & role.isin(*roles) & number(4).isNotNull() & number(5).isNotNull()
    for t in texts:
        good = good & t.isNotNull()
    pick = lambda c: F.when(F.coalesce(good, F.lit(False)), c)
    return rows.select("id", *(pick(t).alias(n) for t, n in zip(texts, "abc", strict=True)), pick(role).alias("role"), pick(number(4)).alias("x"), pick(number(5)).alias("y"))


def payload(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """FN-08: (id, payload): all columns but the vector as JSON; times in ISO form."""
    kept = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes if c != vector]
    return rows.select("id", F.to_json(F.struct(*kept)).alias("payload"))


def day_window(now: Column, zone: str) -> tuple[Column, Column]:
    """DT-06: first and last moment, exclusive, of the day before `now` in a zone, as UTC."""
    today = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    return F.to_utc_timestamp(today - F.expr("INTERVAL 1 DAY"), zone), F.to_utc_timestamp(today, zone)


def prompt_sizes(parsed: DataFrame, hit: Column, text: str = "text") -> DataFrame:
    """AGG-23: (parsed, relevant, chars): rows, those that count, and the length of their texts."""
    return parsed.agg(F.count("*").alias("parsed"), F.count_if(hit).alias("relevant"), F.coalesce(F.sum(F.when(hit, F.length(text))), F.lit(0)).alias("chars"))
