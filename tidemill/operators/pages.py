"""Pages: links, readiness, shelves, rotation, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href): link targets of html."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def local_path(url: Column) -> Column:
    """Path of a URL without host, query, fragment and closing slash."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(path, r"/+$", ""), F.lit("")), F.lit("/"))


def broken_links(pages: DataFrame) -> DataFrame:
    """JON-17: (page_id, path): local links to no page."""
    inner = links(pages).where(F.col("href").startswith("/")).select("page_id", local_path(F.col("href")).alias("path")).distinct()
    return inner.join(pages.select(local_path(F.col("url")).alias("path")), "path", "left_anti").select("page_id", "path")


def readiness(pages: DataFrame) -> DataFrame:
    """PG-09: (page_id, text_chars, thin, mojibake): thin pages have under 400 characters of text or no h1."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " "))
    plain = F.regexp_replace(plain, r"\s+", " ")
    return pages.select("page_id", F.length(plain).alias("text_chars"), ((F.length(plain) < 400) | ~F.col("html").contains("<h1")).alias("thin"), F.col("html").rlike("Ã|â€|�").alias("mojibake"))


def bad_geos(pages: DataFrame) -> DataFrame:
    """PG-10: (geo, bad, n): pages (geo, html) by geo, and whether any has broken characters or lacks a heading."""
    bad = F.col("html").rlike("Ã|â€|�") | ~F.col("html").contains("<h1")
    return pages.groupBy("geo").agg(F.bool_or(bad).alias("bad"), F.count("*").alias("n"))


def crawl(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """GRF-03, GRF-05, SRC-08: (node, depth): nodes reached from start (node) along edges (src, dst), with their least number of steps."""
    from tidemill.sources.store import cut_lineage

    seen = cut_lineage(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut_lineage(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def sitemap_gaps(listed: DataFrame, existing: DataFrame) -> DataFrame:
    """GRF-04, SNK-29: (path, status): 'dead' if listed only, 'orphan' if existing only, 'ok' if both."""
    a, b = listed.select("path").distinct().withColumn("l", F.lit(1)), existing.select("path").distinct().withColumn("e", F.lit(1))
    return a.join(b, "path", "full").select("path", F.when(F.col("e").isNull(), "dead").when(F.col("l").isNull(), "orphan").otherwise("ok").alias("status"))


def coverage_status(demand: DataFrame, pages: DataFrame, least: int = 25) -> DataFrame:
    """JON-16: (geo, topic, status, n): live if there is a page, soon if demand reaches `least`, else none."""
    j = demand.join(pages.select("geo", "topic").distinct().withColumn("p", F.lit(1)), ["geo", "topic"], "full")
    return j.select("geo", "topic", F.when(F.col("p") == 1, "live").when(F.col("n") >= least, "soon").otherwise("none").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def unique_names(rows: DataFrame, scope: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """WIN-15: name made unique in its scope by -2, -3, ... in order, passing over names that are taken.

    The n-th repeat takes the n-th suffix that no name of the scope has. Suffixes in use are numbers that follow a
    repeated name: a join finds them, and each passes the repeats behind it on by one.
    """
    n = F.row_number().over(Window.partitionBy(*scope, name).orderBy(*order))
    numbered = rows.withColumn("__n", n)
    repeated = numbered.where("__n = 2").select(*scope, F.col(name).alias("__base"))
    suffix = F.regexp_extract(name, r"-([2-9]|[1-9][0-9]{1,8})$", 1)
    ended = rows.select(*scope, name).distinct().withColumn("__k", suffix).where("__k <> ''").select(*scope, F.regexp_replace(name, r"-[0-9]+$", "").alias("__base"), F.col("__k").cast("int").alias("__k"))
    used = ended.join(repeated, [*scope, "__base"], "left_semi")
    # The j-th suffix in use, k, leaves k - 1 - j free below it: later repeats pass it over.
    place = F.row_number().over(Window.partitionBy(*scope, "__base").orderBy("__k"))
    passed = used.withColumn("__free", F.col("__k") - 1 - place).groupBy(*scope, "__base").agg(F.array_sort(F.collect_list("__free")).alias("__frees"))
    met = numbered.join(passed.withColumnRenamed("__base", name), [*scope, name], "left")
    behind = F.coalesce(F.size(F.filter("__frees", lambda f: f < F.col("__n") - 1)), F.lit(0))
    number = F.col("__n") + F.greatest(behind, F.lit(0))
    return met.withColumn("unique_name", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), number.cast("string")))).select(*rows.columns, "unique_name")


def rotation(candidates: DataFrame, recent: Sequence[str]) -> DataFrame:
    """WIN-09: the next candidate (id, country, stamp): countries take turns by name after the last of `recent`; those in it come last; the oldest of a country first."""
    w = Window.partitionBy("country").orderBy("stamp", "id")
    oldest = candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    last = F.lit(recent[-1] if recent else None).cast("string")
    known = F.max(F.col("country") == last).over(Window.partitionBy())
    behind = F.coalesce(known & (F.col("country") <= last), F.lit(False))
    again = F.col("country").isin(*recent) if recent else F.lit(False)
    return oldest.withColumn("__behind", behind).orderBy(again, "__behind", "country").limit(1).drop("__behind")


def unposted(patterns: DataFrame, posts: DataFrame, channel: str, limit: int, excluded: Sequence[str] = ()) -> DataFrame:
    """JON-03: patterns (id, country, stamp) not posted to a channel, oldest first; countries are excluded after the limit."""
    left = patterns.join(posts.where(F.col("channel") == channel).select(F.col("pattern_id").alias("id")), "id", "left_anti").orderBy("stamp", "id").limit(limit)
    return left.where(~F.col("country").isin(*excluded)) if excluded else left


def first_assignment(rows: DataFrame, least: int) -> DataFrame:
    """VEC-17, PG-12: rows (id, theme, place): each id in its first theme; themes under `least` go to 'rest'."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("place", "theme"))).where("__n = 1").drop("__n")
    sizes = first.groupBy("theme").agg(F.count("*").alias("__c"))
    return first.join(sizes, "theme").withColumn("theme", F.when(F.col("__c") >= least, F.col("theme")).otherwise("rest")).drop("__c")


def siblings(pages: DataFrame, most: int = 6) -> DataFrame:
    """TOP-11: (key, sibling, place): up to six siblings (key, geo, theme) of the same geo, of the same theme if there are any.

    A page's siblings are among the first most + 1 of its theme or geo, so each page meets no more than these.
    """
    theme, geo = Window.partitionBy("geo", "theme"), Window.partitionBy("geo")
    alone = F.count("*").over(theme) == 1
    ranked = pages.select("key", "geo", "theme", alone.alias("alone"), F.row_number().over(theme.orderBy("key")).alias("in_theme"), F.row_number().over(geo.orderBy("key")).alias("in_geo"))
    of_theme = ranked.where(F.col("in_theme") <= most + 1).select("geo", "theme", F.col("key").alias("sibling"))
    of_geo = ranked.where(F.col("in_geo") <= most + 1).select("geo", F.col("key").alias("sibling"))
    near = ranked.where("not alone").join(of_theme, ["geo", "theme"]).select("key", "sibling").unionByName(ranked.where("alone").join(of_geo, "geo").select("key", "sibling"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("sibling"))
    return near.where("key <> sibling").withColumn("place", place).where(F.col("place") <= most).select("key", "sibling", "place")


def redirects(rules: DataFrame) -> DataFrame:
    """FN-13: (src, dst, prefix, conflicts): rules (line, src, dst) by source, the first wins; other targets are counted; /* is a prefix."""
    clean = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace("src", r"/\*$", ""), "/+$", ""), F.lit("")), F.lit("/"))
    keyed = rules.select("line", "dst", clean.alias("src"), F.col("src").endswith("/*").alias("prefix"))
    return keyed.groupBy("src", "prefix").agg(F.min_by("dst", "line").alias("dst"), (F.count_distinct("dst") - 1).alias("conflicts"))


def slots(day: Column, n: int) -> Column:
    """WIN-10: evenly spaced times of a day."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + F.floor(k * F.lit(86_400 / n))))


def resolve_country(queries: DataFrame, countries: DataFrame) -> DataFrame:
    """TXT-28: (query, code): a code, else a name, else the only name that the query begins; null if none or several. countries (code, name) is a dimension."""
    q = queries.select("query", F.lower(F.trim("query")).alias("q"))
    from tidemill.sources.store import dimension

    c = dimension(countries.select("code", F.lower("code").alias("lc"), F.lower("name").alias("ln")))
    j = q.join(c, (F.col("q") == F.col("lc")) | (F.col("q") == F.col("ln")) | ((F.col("q") != "") & F.col("ln").startswith(F.col("q"))), "left")
    by_code, by_name = F.max(F.when(F.col("q") == F.col("lc"), F.col("code"))), F.max(F.when(F.col("q") == F.col("ln"), F.col("code")))
    only = F.when(F.count_distinct("code") == 1, F.max("code"))
    return j.groupBy("query").agg(F.coalesce(by_code, by_name, only).alias("code"))


def sample_targets(sources: DataFrame) -> DataFrame:
    """MSC-01: (id, target): the chat id of an invite link, else the handle, else the chat id; sources without any go."""
    from tidemill.functions.text import url_handle

    invite = F.coalesce(F.col("url").rlike(r"(?:/\+|joinchat/)"), F.lit(False))
    chat = F.col("chat_id").cast("string")
    return sources.select("id", F.when(invite, chat).otherwise(F.coalesce(url_handle(F.col("url")), chat)).alias("target")).where("target is not null")


def mature(items: DataFrame, done: DataFrame, dead: DataFrame) -> DataFrame:
    """AGG-20: (geo, left, mature): items (geo, id) neither done (id) nor dead (id); geos with none left are mature."""
    live = items.join(done.select("id").unionByName(dead.select("id")).distinct().withColumn("__d", F.lit(1)), "id", "left")
    return live.groupBy("geo").agg(F.count_if(F.col("__d").isNull()).alias("left")).withColumn("mature", F.col("left") == 0)


def skeleton(rows: DataFrame, categories: DataFrame, size: int, least: int = 4, coherent: float = 0.55) -> DataFrame:
    """PG-07: (category, n, coherence, hash, open): rows (id, v, h) by nearest category; a page opens with enough rows that lie close together."""
    from tidemill.functions.values import topic_hash
    from tidemill.operators.clusters import assign, coherence

    placed = rows.join(assign(rows, categories).select("id", "category"), "id")
    sums = coherence(placed, "category", size).select("category", "coherence")
    pages = placed.groupBy("category").agg(F.count("*").alias("n"), topic_hash(F.col("h")).alias("hash"))
    return pages.join(sums, "category").withColumn("open", (F.col("n") >= least) & (F.col("coherence") >= coherent))
