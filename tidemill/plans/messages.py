"""Scans, filters and keyword search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemill.operators import messages as m
from tidemill.operators import tables as t

from .adapters import MESSAGES, PATTERNS, messages, patterns, table
from .catalog import query
from .records import SAID, SAID_SQL

START, END, NOW = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12), dt.datetime(2024, 1, 20)
KEYWORDS = ["click", "purch*", "2024x"]


@query("flt01_range_limit", f"select channel, text from (select * from {MESSAGES} where ts between '2024-01-05' and '2024-01-09 12:00' order by ts, id limit 200)")
def flt01(spark, sf_dir):
    return m.oldest_first(m.between(messages(spark, sf_dir), START, END), 200).select("channel", "text")


@query("flt02_day", f"select id, channel, text from {MESSAGES} where ts::date = '2024-01-06'")
def flt02(spark, sf_dir):
    return m.on_day(messages(spark, sf_dir), "2024-01-06").select("id", "channel", "text")


@query("flt03_last_24h", f"select id, text from {MESSAGES} where ts between timestamp '2024-01-20' - interval 24 hours and timestamp '2024-01-20'")
def flt03(spark, sf_dir):
    return m.between(messages(spark, sf_dir), NOW - dt.timedelta(hours=24), NOW).select("id", "text")


@query("flt04_country_range", f"select id, channel, country from {MESSAGES} where country = 'br' and ts between '2024-01-05' and '2024-01-09 12:00'")
def flt04(spark, sf_dir):
    return m.between(messages(spark, sf_dir).where("country = 'br'"), START, END).select("id", "channel", "country")


HIT = "len(list_filter(regexp_split_to_array(lower(id || ' ' || channel || ' ' || ts::varchar || ' ' || text), '[^a-z0-9]+'), lambda x: x in ('click', '2024x') or x[1:5] = 'purch')) > 0"


@query("flt06_keywords", f"select id, text from (select * from {MESSAGES} where ts between '2024-01-05' and '2024-01-09 12:00' and {HIT} order by ts, id limit 300)")
def flt06(spark, sf_dir):
    return m.relevant(m.between(messages(spark, sf_dir), START, END), KEYWORDS, 300).select("id", "text")


@query("flt06_fallback", f"select id, text from (select * from {MESSAGES} where ts between '2024-01-05' and '2024-01-09 12:00' order by ts, id limit 300)")
def flt06_fallback(spark, sf_dir):
    return m.relevant(m.between(messages(spark, sf_dir), START, END), ["nosuchword", "neither*"], 300).select("id", "text")


@query("jon01_country_keywords", f"select id, text from (select * from {MESSAGES} where country = 'lk' and ts between '2024-01-05' and '2024-01-09 12:00' and {HIT} order by ts, id limit 100)")
def jon01(spark, sf_dir):
    return m.relevant(m.between(messages(spark, sf_dir).where("country = 'lk'"), START, END), KEYWORDS, 100).select("id", "text")


@query("flt08_human_day", f"select id, channel from {MESSAGES} where not is_bot and ts::date = '2024-01-06' and channel in ('click', 'view')")
def flt08(spark, sf_dir):
    return m.on_day(m.human(messages(spark, sf_dir)), "2024-01-06").where(F.col("channel").isin("click", "view")).select("id", "channel")


@query("flt16_blocked_senders", f"select count(*) as n from {MESSAGES} where not is_bot and sender_id not in (3, 5)")
def flt16(spark, sf_dir):
    return m.human(messages(spark, sf_dir), blocked=["3", "5"]).agg(F.count("*").alias("n"))


@query("src03_newest_per_channel", f"select id, channel, rn from (select id, channel, row_number() over (partition by channel order by ts desc, id desc) as rn from {MESSAGES}) where rn <= 20")
def src03(spark, sf_dir):
    return m.newest_per_channel(messages(spark, sf_dir), 20).select("id", "channel", "rn")


@query("src13_patterns", f"select id, length(body) as n from {PATTERNS} where country = 'en' and length(body) > 140 and id not in (select doc_id from labels where toxic = 1) order by id limit 200")
def src13(spark, sf_dir):
    p = patterns(spark, sf_dir).where((F.col("country") == "en") & (F.length("body") > 140) & ~m.is_junk(F.col("body")))
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return p.join(bad, "id", "left_anti").orderBy("id").limit(200).select("id", F.length("body").alias("n"))


@query("src16_pending_scan", "select doc_id as id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def src16(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@query("flt10_junk", f"select item_id, false as junk from benchmark union all select * from (values {SAID_SQL}) v(id, junk_text, junk)".replace("select * from (values", "select id, junk from (values"))
def flt10(spark, sf_dir):
    said = spark.createDataFrame([(i, t) for i, t, _ in SAID], "item_id long, text string")
    return table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(said).select("item_id", m.is_junk(F.col("text")).alias("junk"))


@query("flt15_gate", "select lang, source, count(*) as n from documents group by all having count(*) >= 12")
def flt15(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).where("n >= 12")


@query("flt20_pending_days", f"select distinct channel, ts::date::varchar as day from {MESSAGES} where (channel, ts::date) not in (select channel, ts::date from {MESSAGES} where sender_id = 1)")
def flt20(spark, sf_dir):
    days = messages(spark, sf_dir).select("channel", F.to_date("ts").cast("string").alias("day"), "sender_id")
    return days.select("channel", "day").distinct().join(days.where("sender_id = 1").select("channel", "day").distinct(), ["channel", "day"], "left_anti")


@query("flt21_undone", "select doc_id from documents where doc_id in (select doc_id from labels) and doc_id not in (select doc_id from labels where toxic = 1)")
def flt21(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(lab.select("doc_id"), "doc_id", "left_semi").join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("top05_pending_queue", "select doc_id as id, failed from (select doc_id, doc_id % 8 as failed, (doc_id * 7919) % 10007 as stamp from documents where doc_id not in (select doc_id from labels where quality = 1)) where failed < 5 order by stamp, id limit 100")
def top05(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("x").alias("embedded_at"))
    rows = patterns(spark, sf_dir).join(done, "id", "left").withColumn("failed", F.col("id") % 8)
    return t.pending(rows, 100).select("id", "failed")


@query("top12_corpus_lines", f"select id, case when length(text) > 12 then text[1:12] || ' ...' else text end as text from (select * from {MESSAGES} order by ts, id limit 500)")
def top12(spark, sf_dir):
    return m.corpus_lines(messages(spark, sf_dir), 500, 12).select("id", "text")
