"""Work lists, logs, copies, branches and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemill.functions import text as x
from tidemill.operators import upkeep as u
from tidemill.sources.store import cut_lineage, scratch

from .adapters import MESSAGES, TURNS, messages, table, turns
from .catalog import query
from .messages import HIT, KEYWORDS


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("dt01_iso_days", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1")
def dt01(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(u.iso_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@query(
    "dt03_rolling",
    "select event_type, count(*) filter (where ts between timestamp '2024-01-20' - interval 24 hours and timestamp '2024-01-20') as day, count(*) filter (where ts between timestamp '2024-01-20' - interval 10 days and timestamp '2024-01-20') as ten from events group by 1",
)
def dt03(spark, sf_dir):
    now, ts = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp"), F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(u.within(ts, now, hours=24)).alias("day"), F.count_if(u.within(ts, now, days=10)).alias("ten"))


LAST = f"select id, text from (select * from {MESSAGES} where ts between timestamp '2024-01-20' - interval 24 hours and timestamp '2024-01-20' and {HIT}"


@query("flt07_last_day_keywords", f"{LAST} order by ts, id limit 100)")
def flt07(spark, sf_dir):
    return u.last_day(messages(spark, sf_dir), dt.datetime(2024, 1, 20), KEYWORDS, 100).select("id", "text")


@query("msc27_country_last_day", f"{LAST} and country = 'br')")
def msc27(spark, sf_dir):
    return u.last_day(messages(spark, sf_dir), dt.datetime(2024, 1, 20), KEYWORDS, country="br").select("id", "text")


@query("src17_copied", "select count(*) as copied, count(*) as there, sum(length(text))::bigint as chars from documents")
def src17(spark, sf_dir):
    rows, path = docs(spark, sf_dir).withColumnRenamed("doc_id", "id"), scratch(spark)
    n = u.copied(rows.unionByName(rows), path)
    return spark.read.parquet(path).agg(F.lit(n).cast("long").alias("copied"), F.count("*").alias("there"), F.sum(F.length("text")).alias("chars"))


@query("snk32_wiped", "select count(*) as total, count(*) filter (where doc_id % 3 = 0 or doc_id % 5 = 0) as to_modify, count(*) filter (where doc_id % 3 <> 0 and doc_id % 5 <> 0) as untouched, 'doc_id,text' as left_columns from documents")
def snk32(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0))).alias("embedding"), F.when(F.col("doc_id") % 5 == 0, "v1").alias("model"))
    left, counts = u.wiped(rows, ["embedding", "model", "absent"])
    return counts.withColumn("left_columns", F.lit(",".join(left.columns)))


def run_log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") % 7).alias("chat_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("at"), F.col("turn").cast("long").alias("last_id"), F.lit(1).alias("messages"), F.length("text").alias("facts"))
    return u.logged(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"))


@query("snk18_run_log", "select conv_id % 7 as chat_id, count(*) as runs, count(*)::bigint as messages, sum(length(text))::bigint as facts, arg_max(turn::bigint, (conv_id * 100 + turn) * 1000 + turn) as last_id, max(conv_id * 100 + turn) as last_at from conversations group by 1")
def snk18(spark, sf_dir):
    return u.progress(run_log(spark, sf_dir))


MARKS = "(select o_custkey % 300 as key, o_orderkey as at_, case when o_orderstatus = 'F' then 'done' else 'failed' end as status, case when o_orderstatus = 'F' then o_orderkey % 50 end as patterns from orders where o_custkey % 300 < 250)"


def marks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey % 300 < 250")
    done = F.col("o_orderstatus") == "F"
    return o.select((F.col("o_custkey") % 300).alias("key"), F.when(done, "done").otherwise("failed").alias("status"), F.when(done, F.col("o_orderkey") % 50).alias("patterns"), F.when(~done, F.lit("late")).alias("error"), F.col("o_orderkey").alias("at"))


STATE = f"(select key, arg_max(status, at_) as status, arg_max(coalesce(patterns, -1), at_) as patterns from {MARKS} group by key)"


@query("src19_work_left", f"select key from (select distinct c_custkey % 300 as key from customer) left join {STATE} using (key) where coalesce(status, '') <> 'done'")
def src19(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 300).alias("key"))
    return u.work_left(keys, u.work_state(marks(spark, sf_dir)), 16)[0]


@query(
    "msc09_work_totals",
    f"select count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed, count(*) filter (where status is null) as pending, coalesce(sum(case when patterns >= 0 then patterns end), 0)::bigint as patterns, ceil(count(*) filter (where status is null or status = 'failed') / 16)::bigint as batches from (select distinct c_custkey % 300 as key from customer) left join {STATE} using (key)",
)
def msc09(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 300).alias("key"))
    return u.work_left(keys, u.work_state(marks(spark, sf_dir)), 16)[1]


@query("msc08_written_skipped", "select source as source_title, count(*) filter (where doc_id % 3 <> 0) as written, (count(*) filter (where doc_id % 3 = 0) + count(*) filter (where doc_id % 5 = 0))::bigint as skipped from documents group by 1")
def msc08(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("source_title"))
    return u.written_and_skipped(rows.unionByName(rows.where("id % 5 = 0")), rows.where("id % 3 = 0").select("id"))


@query("msc10_not_dumped", "select country, slug, day from (select distinct lang as country, source as slug, '2026-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as day, doc_id % 28 as k from documents) where k % 4 = 0 or k % 4 = 3")
def msc10(spark, sf_dir):
    k = F.col("doc_id") % 28
    t = docs(spark, sf_dir).select(F.col("lang").alias("country"), F.col("source").alias("slug"), F.concat(F.lit("2026-01-"), F.lpad((k + 1).cast("string"), 2, "0")).alias("day"), k.alias("k")).distinct()
    name = F.concat_ws("_", "day", "country", "slug")
    files = t.select("country", F.when(F.col("k") % 4 == 1, F.concat(name, F.lit(".txt"))).when(F.col("k") % 4 == 2, F.concat(name, F.lit("_part02.txt"))).otherwise(F.concat(name, F.lit(".tmp"))).alias("name"))
    return u.not_dumped(t.select("country", "slug", "day"), files)


@query("msc11_existing", "select 'c' || label as collection, vec_id as id, vec_id % 3 = 0 and label % 2 = 0 as there from embeddings")
def msc11(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"), F.col("vec_id").alias("id"), "label")
    return u.existing(e, e.where("id % 3 = 0 and label % 2 = 0"))


@query(
    "msc15_voices",
    "select path, unnest(case when shelf = 'src1' then ['one'] when shelf = 'src2' then ['one', 'two'] else ['any'] end) as voice from (select '/' || doc_id as path, source as shelf from documents)",
)
def msc15(spark, sf_dir):
    pages = docs(spark, sf_dir).select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("shelf_key"))
    pool = spark.createDataFrame([(0, "one", ["src1", "src2"]), (1, "two", ["src2"]), (2, "any", None), (3, "other", ["none"])], "place int, voice string, shelves array<string>")
    return u.voices(pages, pool)


@query("flt18_rental", "select doc_id, regexp_matches(said, '(?i)\\b(?:rent|rental|lease|apartment|condo|landlord|deposit|studio|tenant)\\w*') as rental from (select doc_id, case when doc_id % 5 = 0 then 'Landlords ask for two deposits. ' || text when doc_id % 5 = 1 then 'PARENTAL leave. ' || text else text end as said from documents)")
def flt18(spark, sf_dir):
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Landlords ask for two deposits. "), "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("PARENTAL leave. "), "text")).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", u.is_rental(said).alias("rental"))


def groups(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.groupBy(F.col("lang").alias("view"), (F.col("doc_id") % 40).alias("k")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).select("view", "rep", "n")


GROUPS = "(select lang as view, min(doc_id) as rep, count(*) as n from documents group by lang, doc_id % 40)"


@query("top08_group_order", f"select view, row_number() over (partition by view order by n desc, length(text) desc, rep)::int as place, rep, n from {GROUPS} g join documents d on g.rep = d.doc_id")
def top08(spark, sf_dir):
    return u.ordered_groups(groups(spark, sf_dir), docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length("text").alias("length")))


@query(
    "agg17_faq_items",
    f"""select view, rep, case when head = '' then text else head end as q, case when head = '' then '' else substr(text, length(head) + 3) end as a, n,
  case when n % 10 = 1 and n % 100 <> 11 then 'сообщение' when n % 10 between 2 and 4 and n % 100 not between 12 and 14 then 'сообщения' else 'сообщений' end as n_word
from (select view, rep, n, text, case when h = '' then '' else h end as head from (select g.*, d.text, regexp_extract(d.text, '(?s)^(.{{39,}}?[^\\d]\\.) ', 1) as h from {GROUPS} g join documents d on g.rep = d.doc_id))""".replace("substr(text, length(head) + 3)", "substr(text, length(head) + 2)"),
)
def agg17(spark, sf_dir):
    return u.faq_items(groups(spark, sf_dir), docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


BRANCHES = f"(select view, rep, case rep % 3 when 0 then 'Money Things' when 1 then '???' end as name from {GROUPS} where rep % 3 < 2 union all select view, rep + 100000, 'Money Things' from {GROUPS} where rep % 3 = 0)"


def branches(spark, sf_dir):
    g = groups(spark, sf_dir)
    of = g.where("rep % 3 < 2").select("view", "rep", F.when(F.col("rep") % 3 == 0, "Money Things").otherwise("???").alias("name"))
    absent = g.where("rep % 3 = 0").select("view", (F.col("rep") + 100_000).alias("rep"), F.lit("Money Things").alias("name"))
    return g, of.unionByName(absent).withColumn("key", F.lit(None).cast("string"))


@query("pg02_branch_pages", f"select view, view || '/money-things' as path, 'Money Things' as name, count(*) filter (where rep < 100000) as n from {BRANCHES} where name = 'Money Things' group by view")
def pg02(spark, sf_dir):
    return u.branch_pages(*branches(spark, sf_dir))[0]


@query("pg02_uncovered", f"select view, rep, n from {GROUPS} where rep % 3 = 2")
def pg02_rest(spark, sf_dir):
    return u.branch_pages(*branches(spark, sf_dir))[1]


def entries(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.col("source").alias("category"), F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 0).alias("is_outdated"))


@query("agg07_brain_info", "select row_number() over (order by n desc, category)::int as place, category, n, sum(n) over ()::bigint as total from (select source as category, count(*) as n from documents where doc_id % 4 <> 0 group by 1)")
def agg07(spark, sf_dir):
    return u.brain_info(entries(spark, sf_dir))


@query("agg07_status", f"select (select count(*) from {MESSAGES}) as messages, (select count(*) from documents where doc_id % 4 <> 0) as entries, (select count(distinct n_regionkey) from nation where n_nationkey % 6 <> 0) as countries, (select count(*) from nation where n_nationkey % 6 <> 0) as sources")
def agg07_status(spark, sf_dir):
    sources = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("country"), F.when(F.col("n_nationkey") % 6 == 0, 0).otherwise(1).alias("active"))
    return u.status(messages(spark, sf_dir), entries(spark, sf_dir), sources)


@query("msc20_topic_pages", "select lang as geo, source as topic, '/' || lang || '/' || source || '/' as path, count(*) as n, min(doc_id) as first_id from documents group by lang, source")
def msc20(spark, sf_dir):
    return u.topic_pages(docs(spark, sf_dir).select(F.col("lang").alias("geo"), F.col("source").alias("topic"), F.col("doc_id").alias("id")))


@query("msc32_step_table", f"select 0 as place, 'messages' as step, (select count(*) from {MESSAGES} where not is_bot) as jobs union all select 1, 'chains', (select count(*) from {TURNS} where reply_to is null) union all select 2, 'pages', (select count(*) from pages)")
def msc32(spark, sf_dir):
    steps = [("messages", messages(spark, sf_dir).where("not is_bot")), ("chains", turns(spark, sf_dir).where("reply_to is null")), ("pages", table(spark, sf_dir, "pages"))]
    return u.step_table(steps)


@query("msc31_display_names", "select doc_id, case lang when 'de' then '🇩🇪 Germany' when 'fr' then '🇫🇷 France' else upper(lang) end as name from documents")
def msc31(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", u.display_name(F.col("lang"), {"de": "Germany", "fr": "France", "br": "Brazil"}).alias("name"))


@query("src05_country_backfill", f"select id from {MESSAGES} where channel in ('click', 'view') and ts >= '2024-01-10'")
def src05(spark, sf_dir):
    sources = spark.createDataFrame([("click", "br", 1), ("view", "br", 1), ("error", "br", 0), ("purchase", "lk", 1)], "channel string, country string, active int")
    return u.of_country(messages(spark, sf_dir), sources, "br", dt.datetime(2024, 1, 10)).select("id")


@query("agg24_collection_counts", "select 'documents' as collection, count(*) as n from documents union all select 'missing', -1 union all select 'pages', count(*) from pages")
def agg24(spark, sf_dir):
    return u.counted_at(spark, {"documents": f"{sf_dir}/documents.parquet", "pages": f"{sf_dir}/pages.parquet", "missing": f"{sf_dir}/no-such-table.parquet"})


@query(
    "fn11_first_of_each",
    "select doc_id, list(w order by at_) as words from (select doc_id, w, min(at_) as at_ from (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as at_ from (select doc_id, string_split(lower(text), ' ') as ws from documents)) group by doc_id, w) group by doc_id",
)
def fn11(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", u.first_of_each(F.split(F.lower("text"), " ")).alias("words"))


@query("msc14_migrated", "select doc_id as id, case when doc_id % 3 = 0 or length(text) % 7 <> 0 then 'new' when doc_id % 3 = 1 then 'old' end as model, case when doc_id % 3 <> 0 and length(text) % 7 <> 0 then length(text)::double else 0 end as v from documents")
def msc14(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 == 0, "new").when(F.col("doc_id") % 3 == 1, "old").alias("model"), F.array(F.lit(0.0)).alias("v"))
    got = u.migrated(rows, "new", lambda todo: todo.withColumn("v", F.when(F.length("text") % 7 != 0, F.array(F.length("text").cast("double")))))
    return got.select("id", "model", F.col("v")[0].alias("v"))


@query("snk14_emptied", "select count(*) as before, 0::bigint as after, 'doc_id,text,lang,source,n_chars' as kept_columns from documents")
def snk14(spark, sf_dir):
    rows, path = docs(spark, sf_dir), scratch(spark)
    rows.write.parquet(path)
    u.emptied(rows, path + "-emptied")
    left = spark.read.schema(rows.schema).parquet(path + "-emptied")
    return spark.read.parquet(path).agg(F.count("*").alias("before"), F.lit(left.count()).cast("long").alias("after"), F.lit(",".join(left.columns)).alias("kept_columns"))


@query(
    "msc16_home_pages",
    """with g as (select lang, 'g' || doc_id % 6 as geo, count(*) as n, bool_or(doc_id % 11 = 0) as hub from documents group by all)
select lang, '/' || lang || '/' as path, list(geo order by -n, geo) as geos, sum(n)::bigint as n from g where hub and lang <> 'es' group by lang""",
)
def msc16(spark, sf_dir):
    pages = docs(spark, sf_dir).select("lang", F.concat(F.lit("g"), (F.col("doc_id") % 6).cast("string")).alias("geo"), F.when(F.col("doc_id") % 11 == 0, "hub").otherwise("fact").alias("kind"))
    return u.home_pages(pages, pages.where("lang <> 'es'").select("lang", F.lit("x").alias("name")).distinct())
