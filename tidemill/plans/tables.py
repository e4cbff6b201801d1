"""Joins, aggregates, sets and write semantics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import values as fn
from tidemill.operators import knowledge as k
from tidemill.operators import pages as p
from tidemill.operators import tables as t
from tidemill.operators import threads

from .adapters import MESSAGES, PATTERNS, POSTS, messages, patterns, posts, table
from .catalog import query


@query("jon02_recent_countries", f"select n, country from (select row_number() over (order by posted_at desc, pattern_id desc) as n, country from {POSTS} join {PATTERNS} on pattern_id = id where channel = 'b') where n <= 12")
def jon02(spark, sf_dir):
    rows = posts(spark, sf_dir).where("channel = 'b'").join(patterns(spark, sf_dir), F.col("pattern_id") == F.col("id")).orderBy(F.desc("posted_at"), F.desc("pattern_id")).limit(12)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("posted_at"), F.desc("pattern_id"))).alias("n"), "country")


@query("jon03_unposted", f"select id, country from (select * from {PATTERNS} where id not in (select pattern_id from {POSTS} where channel = 'b') order by stamp, id limit 150) where country not in ('fr')")
def jon03(spark, sf_dir):
    return p.unposted(patterns(spark, sf_dir), posts(spark, sf_dir), "b", 150, ["fr"]).select("id", "country")


SOURCES = "(select n_nationkey as id, n_nationkey as chat_id, n_name as name, 'h' || (n_nationkey % 20)::varchar as handle, r_name as country from nation join region on n_regionkey = r_regionkey)"


def sources(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("chat_id"), F.col("n_name").alias("name"), F.concat(F.lit("h"), (F.col("n_nationkey") % 20).cast("string")).alias("handle"), F.col("r_name").alias("country")
    )


@query("jon04_channel_countries", f"select key, country from (select key, country, row_number() over (partition by key order by id, kind) as n from (select id, country, 0 as kind, chat_id::varchar as key from {SOURCES} union all select id, country, 1, name from {SOURCES} union all select id, country, 2, handle from {SOURCES})) where n = 1")
def jon04(spark, sf_dir):
    return t.alternate_keys(sources(spark, sf_dir))


@query("jon06_channel_values", f"select distinct key from (select chat_id::varchar as key from {SOURCES} where country = 'ASIA' union all select name from {SOURCES} where country = 'ASIA' union all select handle from {SOURCES} where country = 'ASIA')")
def jon06(spark, sf_dir):
    s = sources(spark, sf_dir).where("country = 'ASIA'")
    return s.select(F.explode(F.array(F.col("chat_id").cast("string"), "name", "handle")).alias("key")).distinct()


@query("snk15_backfill_country", f"select count(*) as n, count(country) as matched, count(*) filter (where country is null) as unmatched from (select coalesce(m.country, s.country) as country from {MESSAGES} m left join (select distinct name, country from {SOURCES}) s on s.name = 'NATION_' || (m.sender_id % 30)::varchar)")
def snk15(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("channel", F.concat(F.lit("NATION_"), (F.col("sender_id") % 30).cast("string")))
    filled = t.with_country(m, sources(spark, sf_dir))
    return filled.agg(F.count("*").alias("n"), F.count("country").alias("matched"), F.count_if(F.col("country").isNull()).alias("unmatched"))


@query("jon07_taxonomy_group", "select e.label, d.source as section, count(*) as n, sum(length(d.text))::bigint as chars from embeddings e join documents d on e.vec_id = d.doc_id join labels l on l.doc_id = d.doc_id where l.quality = 1 group by all")
def jon07(spark, sf_dir):
    e, d, lab = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    j = e.select(F.col("vec_id").alias("doc_id"), "label").join(d, "doc_id").join(lab, "doc_id")
    return j.groupBy("label", F.col("source").alias("section")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("jon13_carry_translations", "select doc_id as id, length(text) as n, case when doc_id % 3 = 0 or doc_id % 3 = 1 then 'T' || doc_id::varchar end as translation from documents")
def jon13(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    h = F.substring(F.sha1(F.col("text").cast("binary")), 1, 8)
    old = new.select("id", F.when(F.col("id") % 3 == 0, h).when(F.col("id") % 3 == 2, F.lit("00000000")).alias("src_hash"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("translation"))
    return k.carry_translations(new, old).select("id", F.length("text").alias("n"), "translation")


@query("jon15_alternate_languages", "with langs as (select distinct lang from documents), tails as (select distinct source, lang from documents) select t.source, t.lang, l.lang as other from tails t, langs l where l.lang <> t.lang and exists (select 1 from tails x where x.source = t.source and x.lang = l.lang)")
def jon15(spark, sf_dir):
    tails = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return tails.alias("t").join(tails.alias("x"), (F.col("t.source") == F.col("x.source")) & (F.col("t.lang") != F.col("x.lang"))).select("t.source", "t.lang", F.col("x.lang").alias("other"))


@query("jon16_coverage", "with demand as (select lang as geo, source as topic, count(*) as n from documents group by all), live as (select distinct lang as geo, source as topic from documents where doc_id % 50 = 0 union select 'xx', 'extra') select coalesce(d.geo, l.geo) as geo, coalesce(d.topic, l.topic) as topic, case when l.geo is not null then 'live' when d.n >= 25 then 'soon' else 'none' end as status, coalesce(d.n, 0)::bigint as n from demand d full join live l on d.geo = l.geo and d.topic = l.topic")
def jon16(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("geo"), F.col("source").alias("topic"))
    live = d.where("doc_id % 50 = 0").select("geo", "topic").unionByName(spark.createDataFrame([("xx", "extra")], "geo string, topic string"))
    return p.coverage_status(d.groupBy("geo", "topic").agg(F.count("*").alias("n")), live)


@query("agg01_stats", "select coalesce(lang, 'total') as lang, count(*) as n, count(*) filter (where quality = 1)::bigint as good, count(*) filter (where quality is null)::bigint as pending from documents left join labels using (doc_id) group by rollup (lang)")
def agg01(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = j.rollup("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("pending"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("total")))


TOPIC = {"src0": "money", "src1": "money", "src2": "papers", "src3": "papers", "src4": "travel"}


@query("agg02_demand", "select country, topic, sum(n)::bigint as n from (select lang as country, case when source in ('src0', 'src1') then 'money' when source in ('src2', 'src3') then 'papers' when source = 'src4' then 'travel' else 'other' end as topic, count(*) as n from documents where length(text) > 140 group by all) group by all")
def agg02(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 140).groupBy(F.col("lang").alias("country"), "source").agg(F.count("*").alias("n"))
    return d.groupBy("country", fn.mapped(F.col("source"), TOPIC, "other").alias("topic")).agg(F.sum("n").alias("n"))


@query("agg03_broker_counts", "select user_id, event_type, count(*) as n from events where ts > timestamp '2024-01-20' - interval 48 hours and ts <= timestamp '2024-01-20' group by all")
def agg03(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    return e.where((F.col("ts") > now - F.expr("INTERVAL 48 HOURS")) & (F.col("ts") <= now)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("agg04_geos", "select source, count(*) as n, max(doc_id) as newest from documents group by 1 having count(*) >= 30 order by n desc, source")
def agg04(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest")).where("n >= 30").orderBy(F.desc("n"), "source")


@query("agg05_progress", "select lang, count(*) as corpus, count(quality) as tagged, floor(100.0 * count(quality) / count(*))::bigint as percent from documents left join labels using (doc_id) group by 1")
def agg05(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("corpus"), F.count("quality").alias("tagged"))
    return j.withColumn("percent", F.floor(100 * F.col("tagged") / F.col("corpus")))


@query("agg06_brain_stats", "select event_type, count(*) as n, coalesce(round(sum(value), 4), 0) as total, coalesce(max(value), 0) as largest, count(*) filter (where ts > timestamp '2024-01-20' - interval 1 hour) as last_hour from events where ts <= timestamp '2024-01-20' group by 1")
def agg06(spark, sf_dir):
    now = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    e = table(spark, sf_dir, "events").where(F.col("ts") <= now)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum("value"), 4), F.lit(0.0)).alias("total"), F.coalesce(F.max("value"), F.lit(0.0)).alias("largest"), F.count_if(F.col("ts") > now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"))


@query("agg08_active_countries", f"select distinct country from {MESSAGES} where country is not null")
def agg08(spark, sf_dir):
    return messages(spark, sf_dir).select("country").where("country is not null").distinct()


@query("agg09_message_days", f"select distinct channel, ts::date::varchar as day from {MESSAGES} where country = 'br'")
def agg09(spark, sf_dir):
    return messages(spark, sf_dir).where("country = 'br'").select("channel", F.to_date("ts").cast("string").alias("day")).distinct()


@query("agg10_taxonomy", "select lang as geo, source as category, count(*) as n from documents group by all order by n desc, geo, category limit 18")
def agg10(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("geo"), F.col("source").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "geo", "category").limit(18)


@query("agg11_entity_index", "select word, count(*) as n, min(doc_id) as first_id, md5(string_agg(doc_id::varchar, ',' order by doc_id)) as ids from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) as word from documents) group by 1 having count(*) > 1")
def agg11(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), F.lit(1)))).alias("word"))
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.md5(F.array_join(ids, ",")).alias("ids")).where("n > 1")


@query("agg16_topic_hash", "select source, md5(string_agg(h, '' order by h)) as hash from (select source, substr(md5(text), 1, 12) as h from documents) group by 1")
def agg16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", fn.md5_id(F.col("text")).alias("h")).groupBy("source").agg(fn.topic_hash(F.col("h")).alias("hash"))


@query("agg18_home", "select source, n, row_number() over (order by n desc, source) as place from (select source, count(*) as n from documents group by 1) order by n desc, source limit 12")
def agg18(spark, sf_dir):
    top = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")))


@query("agg19_pipeline_state", "select lang, count(*) filter (where l.doc_id is null) as to_tag, count(*) filter (where e.vec_id is null) as to_embed from documents d left join labels l on d.doc_id = l.doc_id left join embeddings e on e.vec_id = d.doc_id group by 1")
def agg19(spark, sf_dir):
    d, lab, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("e"))
    return d.join(lab, "doc_id", "left").join(e, "doc_id", "left").groupBy("lang").agg(F.count_if(F.col("l").isNull()).alias("to_tag"), F.count_if(F.col("e").isNull()).alias("to_embed"))


@query("agg21_recall", "select count(*) as total, count(*) filter (where contains(text, 'thand'))::bigint as found, round(avg(case when contains(text, 'thand') then 1.0 else 0.0 end), 6) as recall from documents where contains(text, 'than')")
def agg21(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("than"))
    hit = F.col("text").contains("thand")
    return d.agg(F.count("*").alias("total"), F.count_if(hit).alias("found"), F.round(F.avg(hit.cast("double")), 6).alias("recall"))


@query("win06_latest", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def win06(spark, sf_dir):
    return t.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("win07_trailing_count", "select event_id, count(*) over (partition by user_id % 5 order by ts range between interval 600 seconds preceding and current row) as n from events")
def win07(spark, sf_dir):
    return threads.trailing_count(table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 5), ["g"], 600).select("event_id", "n")


@query("snk01_insert_if_absent", "select event_id % 700 as id, min(event_id) as first_event from events where event_id % 700 not in (select event_id from events where event_id < 300) group by 1")
def snk01(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    have = e.where("event_id < 300").select(F.col("event_id").alias("id"))
    new = e.select((F.col("event_id") % 700).alias("id"), F.col("event_id").alias("first_event"))
    return t.insert_if_absent(have, new, ["id"], [F.asc("first_event")])


@query("snk05_upsert_latest", "select user_id, event_type, value from (select user_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def snk05(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id"))
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return t.upsert(old, new, ["user_id"], F.col("version")).select("user_id", "event_type", "value")


@query("snk06_quota_counts", "select user_id, ts::date::varchar as day, count(*) as n, bool_or(event_type = 'error') as banned from events group by all")
def snk06(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("banned"))


@query("snk09_patch", "select c_custkey, case when c_custkey % 10 = 0 then 'PATCHED' else c_mktsegment end as c_mktsegment from customer")
def snk09(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return t.patch(c, c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")), ["c_custkey"])


@query("snk10_outdated", "select o_orderkey, case when o_orderdate < timestamp '1998-01-01' - interval 90 days then 1 else 0 end as outdated from orders")
def snk10(spark, sf_dir):
    import datetime as dt

    return t.aged(table(spark, sf_dir, "orders").withColumn("outdated", F.lit(0)), "o_orderdate", dt.datetime(1998, 1, 1), 90, "outdated").select("o_orderkey", "outdated")


@query("snk12_failures", "select user_id::varchar || '/' || ts::date::varchar as key, count(*) as failed, arg_max(props, ts)[1:500] as last_error, count(*) >= 3 as dead from events where event_type = 'error' group by 1")
def snk12(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return t.failures(errors.withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))), "key", "props")


@query("snk13_delete_bots", f"select count(*) as kept, (select count(*) from {MESSAGES} where is_bot) as deleted from {MESSAGES} where not is_bot")
def snk13(spark, sf_dir):
    return messages(spark, sf_dir).agg(F.count_if(~F.col("is_bot")).alias("kept"), F.count_if(F.col("is_bot")).alias("deleted"))


@query("snk22_day_files", f"select country, channel, ts::date as day, count(*)::int as n, concat_ws(' ', '#', country, channel, ts::date::varchar) || chr(10) || string_agg('[' || strftime(ts, '%H:%M') || '] u/' || sender_id::varchar || ': ' || text, chr(10) order by ts, id) as body from {MESSAGES} group by country, channel, ts::date")
def snk22(spark, sf_dir):
    from tidemill.functions.text import message_line

    m = messages(spark, sf_dir)
    return t.dump_files(m.withColumn("line", message_line(F.col("ts"), F.col("text"), F.col("sender_id"), F.lit(None).cast("string"))))


@query("snk24_changed_files", "select doc_id::varchar as name, n_chars as mtime from documents where not (doc_id % 2 = 0 and doc_id % 10 <> 0)")
def snk24(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("mtime"), "doc_id")
    manifest = d.where("doc_id % 2 = 0").select("name", F.when(F.col("doc_id") % 10 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    return t.changed_files(d.select("name", "mtime"), manifest)


@query("snk25_kept_dates", "select doc_id, case when doc_id % 4 = 0 then '2024-01-01' else '2024-02-02' end as updated, doc_id % 4 <> 0 as changed from documents")
def snk25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.lit("else")).alias("text"), F.lit("2024-01-01").alias("updated"))
    return t.kept_dates(d.withColumn("updated", F.lit("2024-02-02")), old, "doc_id", F.md5("text"), "updated").select("doc_id", "updated", "changed")


@query("top03_by_confidence", "select o_orderkey, o_orderpriority from orders order by o_orderpriority desc, o_orderdate desc, o_orderkey limit 50")
def top03(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("confidence"), F.col("o_orderdate").alias("last_updated"))
    return k.by_confidence(o, 50).select(F.col("id").alias("o_orderkey"), F.col("confidence").alias("o_orderpriority"))


@query("top10_label_mass", "select word, count(*) as mass from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by 1 order by mass desc, word limit 90")
def top10(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("mass")).orderBy(F.desc("mass"), "word").limit(90)


@query("set06_gate", "select distinct source from documents where source not in (select source from documents where doc_id in (select doc_id from labels where toxic = 1) group by 1 having count(*) >= 4)")
def set06(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bad = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").groupBy("source").count().where("count >= 4").select("source")
    return d.select("source").distinct().join(bad, "source", "left_anti")


@query("set05_union", "select n_name as name from nation union select s_name from supplier")
def set05(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()


@query("set04_union_all", "select 'part' as kind, count(*) as n from part union all select 'order', count(*) from orders")
def set04(spark, sf_dir):
    count = lambda name, kind: table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("part", "part").unionByName(count("orders", "order"))


@query("fn13_redirects", "with r as (select p_partkey as line, '/' || p_name || case when p_size % 3 = 0 then '/*' when p_size % 3 = 1 then '/' else '' end as src, '/to/' || (p_partkey % 4)::varchar as dst from part), c as (select line, dst, regexp_replace(regexp_replace(src, '/\\*$', ''), '/+$', '') as src, suffix(src, '/*') as prefix from r) select src, prefix, arg_min(dst, line) as dst, count(distinct dst) - 1 as conflicts from c group by 1, 2")
def fn13(spark, sf_dir):
    tail = F.when(F.col("p_size") % 3 == 0, "/*").when(F.col("p_size") % 3 == 1, "/").otherwise("")
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.concat(F.lit("/"), "p_name", tail).alias("src"), F.concat(F.lit("/to/"), (F.col("p_partkey") % 4).cast("string")).alias("dst"))
    return p.redirects(rules)


@query("src11_fact_dedup", "select doc_id, h from (select doc_id, substr(md5(text), 1, 12) as h, row_number() over (partition by md5(text) order by doc_id) as n from documents) where n = 1")
def src11(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", fn.md5_id(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")
