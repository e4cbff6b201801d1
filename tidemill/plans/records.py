"""Records: writes, lookups, orders and small reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemill.functions import text as x
from tidemill.operators import records as r

from .adapters import MESSAGES, PATTERNS, UNITS, messages, patterns, table, units
from .catalog import query

#: Texts that narrate, and some that do not, beside what the tables hold; stated as the SQL states them.
SAID = [(-1, "Information about visas", True), (-2, "User is asking about rent", True), (-3, "Seeking a flat", True), (-4, "The bank opens at nine", False), (-5, "Details on prices", True), (-6, "information about visas", False), (-7, "Inquiries about schools", True)]
SAID_SQL = ", ".join(f"({i}, '{t}', {str(y).lower()})" for i, t, y in SAID)


@query("src14_questions", f"select id from (values {SAID_SQL}) v(id, body, junk) where junk")
def src14(spark, sf_dir):
    said = spark.createDataFrame([(i, t) for i, t, _ in SAID], "id long, body string")
    return r.questions(patterns(spark, sf_dir).select("id", "body").unionByName(said)).select("id")


def quota(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("key_hash"), F.col("event_type").alias("model"), F.to_date("ts").cast("string").alias("day"))
    return e.groupBy("key_hash", "model", "day").agg(F.count("*").alias("n")).withColumn("banned", F.lit(False))


QUOTA = "(select user_id % 9 as key_hash, event_type as model, ts::date::varchar as day, count(*) as n from events group by all)"
BANS = "(select distinct user_id % 9 as key_hash, 'search' as model, ts::date::varchar as day, true as hit from events where event_type = 'error')"


def banned(spark, sf_dir):
    bans = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 9).alias("key_hash"), F.lit("search").alias("model"), F.to_date("ts").cast("string").alias("day"))
    return r.with_bans(quota(spark, sf_dir), bans)


BANNED = f"(select key_hash, model, day, coalesce(q.n, 0) as n, coalesce(b.hit, false) as banned from {QUOTA} q full join {BANS} b using (key_hash, model, day))"


@query("snk07_bans", f"select * from {BANNED}")
def snk07(spark, sf_dir):
    return banned(spark, sf_dir)


@query("msc05_quota_states", f"select p.key_hash, p.model, coalesce(c.n, 0)::bigint as n, coalesce(c.banned, false) as banned from (select k.range as key_hash, m.model from range(12) k, (values ('click'), ('search')) m(model)) p left join (select * from {BANNED} where day = '2024-01-06') c on c.key_hash = p.key_hash and c.model = p.model")
def msc05(spark, sf_dir):
    pairs = spark.range(12).select(F.col("id").alias("key_hash"), F.explode(F.array(F.lit("click"), F.lit("search"))).alias("model"))
    return r.quota_states(pairs, banned(spark, sf_dir), "2024-01-06")


@query("msc06_exhausted", f"select model, bool_and(banned or n >= 20) as exhausted from {BANNED} where day = '2024-01-06' group by 1")
def msc06(spark, sf_dir):
    return r.exhausted_models(banned(spark, sf_dir).where("day = '2024-01-06'"), 20)


@query("msc17_caps", "select s_suppkey as consumer, case when s_suppkey % 3 = 0 then s_suppkey * 2 else 50 end::bigint as cap from supplier")
def msc17(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("consumer"))
    return r.with_caps(s, s.where("consumer % 3 = 0").withColumn("cap", F.col("consumer") * 2), 50).withColumn("cap", F.col("cap").cast("long"))


LEMMAS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(source || ' ' || text || ' ' || lang), '[а-яёa-z0-9]+'), v -> length(v) >= 2)))"


def claims(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("question"), F.col("text").alias("answer"), F.array("lang").alias("tags"))


@query("snk08_insert_knowledge", f"select doc_id as id, len({LEMMAS})::int as lemmas, '2024-02-01' as created, 0 as is_outdated from documents".replace("v ->", "lambda v:"))
def snk08(spark, sf_dir):
    got = r.new_knowledge(claims(spark, sf_dir), F.lit("2024-02-01"), lambda t: F.array_sort(x.lemmas(t)))
    return got.select("id", F.size("lemmas").alias("lemmas"), "created", "is_outdated")


@query("txt09_missing_lemmas", f"select doc_id as id, case when doc_id % 2 = 0 then 1 else len({LEMMAS}) end::int as lemmas from documents".replace("v ->", "lambda v:"))
def txt09(spark, sf_dir):
    rows = claims(spark, sf_dir).withColumn("lemmas", F.when(F.col("id") % 2 == 0, F.array(F.lit("kept"))))
    return r.with_lemmas(rows, x.lemmas).select("id", F.size("lemmas").alias("lemmas"))


@query("top01_live_entries", "select doc_id as id from documents where doc_id % 5 <> 0 and lang = 'de'")
def top01_live(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.when(F.col("doc_id") % 5 == 0, 1).when(F.col("doc_id") % 5 == 1, 0).alias("is_outdated"))
    return r.searchable(rows, "de").select("id")


@query("snk11_mark_embedded", "select doc_id as id, case when doc_id in (select doc_id from labels where quality = 1) then 'now' when doc_id % 4 = 0 then 'before' end as embedded_at from documents")
def snk11(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "before").alias("embedded_at"))
    return r.marked(rows, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "embedded_at", F.lit("now"))


def feeds(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey")).alias("id"), F.concat(F.lit("c"), (F.col("n_regionkey")).cast("string")).alias("country"), F.concat(F.lit("u"), (F.col("n_nationkey") % 20).cast("string")).alias("url"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 6 == 0, 0).otherwise(1).alias("active"))


FEEDS = "(select n_nationkey as id, 'c' || n_regionkey::varchar as country, 'u' || (n_nationkey % 20)::varchar as url, n_name as name, case when n_nationkey % 6 = 0 then 0 else 1 end as active from nation)"


@query("snk17_source_changes", f"with have as (select * from {FEEDS} where id < 12), new as (select country, url, name, active from {FEEDS} where id >= 8), fresh as (select country, url, name, active from (select *, row_number() over (partition by url order by name) as n from new where url not in (select url from have)) where n = 1), both_ as (select country, url, name, active from have union all select * from fresh) select country, url, name, (case when url in ('u3', 'u15') then 0 else active end)::int as active from both_")
def snk17(spark, sf_dir):
    f = feeds(spark, sf_dir)
    columns = ["country", "url", "name", "active"]
    return r.source_changes(f.where("id < 12").select(*columns), f.where("id >= 8").select(*columns), spark.createDataFrame([("u3",), ("u15",)], "url string"))


@query("msc03_active_sources", f"select name, url from {FEEDS} where active = 1 and country = 'c1'")
def msc03(spark, sf_dir):
    return r.active_sources(feeds(spark, sf_dir), "c1").select("name", "url")


@query("msc04_url_countries", f"select u.url, (select min_by(country, id) from {FEEDS} f where f.url = u.url) as country from (select 'u' || range::varchar as url from range(25)) u")
def msc04(spark, sf_dir):
    return r.url_countries(spark.range(25).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url")), feeds(spark, sf_dir))


@query("flt22_done_dead", "select user_id::varchar || '/' || ts::date::varchar as id, case when bool_or(event_type = 'purchase') then 'done' else 'dead' end as state from events group by 1 having bool_or(event_type = 'purchase') or count(*) >= 3")
def flt22(spark, sf_dir):
    return r.done_and_dead(table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("id"), (F.col("event_type") == "purchase").alias("ok")))


@query("set07_leftovers", "select doc_id as id from documents where doc_id not in (select doc_id from labels) and doc_id not in (select vec_id from embeddings where label = 0)")
def set07(spark, sf_dir):
    ids = lambda name, col, where="true": table(spark, sf_dir, name).where(where).select(F.col(col).alias("id"))
    return r.leftovers(ids("documents", "doc_id"), ids("labels", "doc_id"), ids("embeddings", "vec_id", "label = 0"))


@query("flt19_skipped_views", "select coalesce(reason, 'kept') as reason, count(*) as n from (select case when doc_id % 7 = 0 then 'no address' when doc_id % 5 = 0 then 'untranslated' when source = 'src1' then 'collective' end as reason from documents) group by 1")
def flt19(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    views = d.select(F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("address"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("lang")).alias("label"), (F.col("source") == "src1").alias("collective"))
    return r.kept_views(views).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("pg04_addresses", "select p_partkey, case when p_partkey % 3 = 0 then 'k' || p_partkey::varchar else nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')[1:40], '') end as address from part where p_partkey % 4 <> 1 or p_partkey % 3 = 0")
def pg04(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("k"), F.col("p_partkey").cast("string"))).otherwise(" ").alias("key"), F.when(F.col("p_partkey") % 4 == 1, "!?").otherwise(F.col("p_name")).alias("label"))
    return r.addressed(rows, "label", x.slug).select("p_partkey", "address")


@query("pg03_shelves", "select lang || source as shelf, count(distinct doc_id) as n from documents group by 1 having count(distinct doc_id) >= 3")
def pg03(spark, sf_dir):
    return r.shelves(table(spark, sf_dir, "documents").select(F.concat("lang", "source").alias("shelf"), F.col("doc_id").alias("id")))


@query("vec16_carved_views", "select doc_id as id, case when doc_id % 13 <> 0 and count(*) over (partition by lang, case when doc_id % 13 <> 0 then source end) >= 9 then lang || '/' || source else lang || '/tail' end as view from documents")
def vec16(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return r.carved_views(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("shelf"), F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("deal")), 9)


DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"


def matched(spark, sf_dir):
    u = units(spark, sf_dir).select("id", "v")
    return r.context_matches(u.where("id % 20 = 0"), [("wisdom", u.where("id % 2 = 1"), 40), ("wiki", u.where("id % 2 = 0"), 20)], 0.3)


MATCHED = " union all ".join(
    f"select query, '{name}' as source, id, rank, score from (select a.id as query, b.id as id, {DOT} as score, row_number() over (partition by a.id order by {DOT} desc, b.id) as rank from {UNITS} a join {UNITS} b on a.id <> b.id where a.id % 20 = 0 and b.id % 2 = {odd}) where rank <= {limit} and score >= 0.3"
    for name, odd, limit in (("wisdom", 1, 40), ("wiki", 0, 20))
)


@query("top06_context", f"select query, source, id, round(score, 9) as score from ({MATCHED})")
def top06(spark, sf_dir):
    return matched(spark, sf_dir).select("query", "source", "id", F.round("score", 9).alias("score"))


@query("ext10_decisions", f"select q.vec_id as query, case when max(score) >= 0.6 then 'known' when max(score) is not null then 'grounded' else 'none' end as decision from (select vec_id from embeddings where vec_id % 20 = 0) q left join ({MATCHED}) m on m.query = q.vec_id group by 1")
def ext10(spark, sf_dir):
    return r.grounded(matched(spark, sf_dir), units(spark, sf_dir).where("id % 20 = 0").select("id"), 0.6)


@query("agg22_retrieval_eval", f"select query, count(*) filter (where b.label = a.label) as hits, count(*) filter (where b.label = a.label) >= 2 as passed from ({MATCHED}) m join embeddings a on a.vec_id = query join embeddings b on b.vec_id = m.id where source = 'wiki' and rank <= 10 group by 1")
def agg22(spark, sf_dir):
    m = matched(spark, sf_dir).where("source = 'wiki'")
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    relevant = m.join(label, "id").join(label.select(F.col("id").alias("query"), F.col("label").alias("of")), "query").where("label = of")
    return r.retrieval_eval(m, relevant, 10, 2)


@query("win14_pacing", "select event_id, round(next_at, 6) as next_at, coalesce(sent >= lag(next_at) over (partition by key order by sent, tokens), true) as in_time from (select event_id, user_id as key, epoch(ts) as sent, event_id % 5000 as tokens, epoch(ts) + (event_id % 5000) / 30.0::double * 60 as next_at from events)")
def win14(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_id") % 5000).alias("tokens"))
    return r.paced(e, 30).select("event_id", F.round("next_at", 6).alias("next_at"), "in_time")


@query("fn06_strict_rows", "select p_partkey as id, case when p_partkey % 4 = 0 then p_name end as a, case when p_partkey % 4 = 0 then 'buyer' end as role, case when p_partkey % 4 = 0 then p_size::double end as x from part")
def fn06(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    six = F.to_json(F.array("p_name", F.lit("b"), F.lit("c"), F.when(F.col("p_partkey") % 4 == 1, "stranger").otherwise("buyer"), F.when(F.col("p_partkey") % 4 == 2, "many").otherwise(size), F.lit("1.5")))
    raw = F.when(F.col("p_partkey") % 4 == 3, F.to_json(F.array("p_name", F.lit("b")))).otherwise(six)
    return r.strict_rows(p.select(F.col("p_partkey").alias("id"), raw.alias("raw")), ["buyer", "seller"]).select("id", "a", "role", "x")


@query("fn08_payloads", "select event_id as id, '{\"id\":' || event_id::varchar || ',\"kind\":\"' || event_type || '\",\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\"}' as payload from events")
def fn08(spark, sf_dir):
    return r.payload(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.array(F.col("value")).alias("embedding")))


@query("dt06_yesterday", f"select id from {MESSAGES} where ts >= timestamp '2024-01-09' - interval 3 hours + interval 6 hours and ts < timestamp '2024-01-10' + interval 3 hours")
def dt06(spark, sf_dir):
    start, end = r.day_window(F.to_timestamp(F.lit("2024-01-10 12:00:00")), "America/Sao_Paulo")  # three hours behind UTC
    ts = F.col("ts").cast("timestamp")
    return messages(spark, sf_dir).where((ts >= start) & (ts < end)).select("id")


@query("dt09_epoch", "select event_id, floor(epoch(ts))::bigint as seconds, ts::date::varchar as day, ts >= timestamp '2024-02-01' - interval 365 days as recent from events")
def dt09(spark, sf_dir):
    since = dt.datetime(2024, 2, 1) - dt.timedelta(days=365)
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("ts") >= F.lit(since)).alias("recent"))


@query("agg23_prompt_sizes", f"select count(*) as parsed, count(*) filter (where contains(text, 'click')) as relevant, coalesce(sum(length(text)) filter (where contains(text, 'click')), 0)::bigint as chars from {MESSAGES} where ts::date = '2024-01-06'")
def agg23(spark, sf_dir):
    from tidemill.operators.messages import on_day

    return r.prompt_sizes(on_day(messages(spark, sf_dir), "2024-01-06"), F.col("text").contains("click"))


@query("set02_set03_words", "select doc_id, len(list_filter(w, lambda v: v not in ('the', 'and', 'de')))::int as rest, len(list_filter(w, lambda v: v in ('the', 'de')))::int as common from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) as w from documents)")
def set02(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", x.word_set(F.col("text")).alias("w"))
    words = lambda *names: F.array(*[F.lit(n) for n in names])
    return w.select("doc_id", F.size(F.array_except("w", words("the", "and", "de"))).alias("rest"), F.size(F.array_intersect("w", words("the", "de"))).alias("common"))


@query("top04_newest", f"select id, stamp from {PATTERNS} where tag = 'src2' order by stamp desc, id limit 60")
def top04(spark, sf_dir):
    return patterns(spark, sf_dir).where("tag = 'src2'").orderBy(F.desc("stamp"), "id").limit(60).select("id", "stamp")
