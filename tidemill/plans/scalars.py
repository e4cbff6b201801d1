"""Text, id, JSON, number and date scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.functions import text as x
from tidemill.functions import values as fn
from tidemill.operators import knowledge as k
from tidemill.operators import messages as m

from .adapters import MESSAGES, TURNS, messages, table, turns
from .catalog import query


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("txt01_sanitize_ascii", r"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://\S+|www\.\S+', '', 'g'), '[@#][\p{L}\p{N}_]+', '', 'g'), '[^\p{L}\p{N}\p{P}\p{Zs}]', '', 'g'), '\s+', ' ', 'g'))) as h from documents")
def txt01(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(x.sanitize(F.col("text")).cast("binary")).alias("h"))


@query("txt03_utf16_len", "select doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) as n from documents")
def txt03(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", x.utf16_len(F.col("text")).alias("n"))


@query("txt06_one_line", "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as h from documents")
def txt06(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(x.one_line(F.col("text")).cast("binary")).alias("h"))


@query("txt07_word_sets", "select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'))) as n, list_contains(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), 'the') as has_the from documents")
def txt07(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", x.word_set(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_contains("w", "the").alias("has_the"))


@query("txt10_estimate_tokens", "select doc_id, greatest(1, length(text) // 3)::bigint as n from documents")
def txt10(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", x.estimate_tokens(F.col("text")).alias("n"))


@query("txt13_channel_slugs", "select p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') as slug, lower(regexp_replace(p_brand, '[^A-Za-z0-9_]', '', 'g')) as field from part")
def txt13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.channel_slug(F.col("p_name")).alias("slug"), x.channel_field(F.col("p_brand")).alias("field"))


@query("txt14_slugs", "select p_partkey, nullif(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-')[1:40], '') as slug from part")
def txt14(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("txt16_message_lines", f"select id, '[' || strftime(make_timestamp(said * 1000000), '%H:%M') || '] u/' || role || case when reply_to is not null then ' ← reply ' || regexp_extract(reply_to, '_([0-9]+)$', 1) else '' end || ': ' || length(text)::varchar as line from {TURNS}")
def txt16(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("id", x.message_line(F.col("ts"), F.length("text").cast("string"), F.col("role"), F.col("reply_to")).alias("line"))


@query("txt17_embed_text", "select doc_id, concat_ws('. ', lang, nullif(case when doc_id % 3 = 0 then '' else source end, ''), length(text)::varchar) as t from documents")
def txt17(spark, sf_dir):
    part = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))
    return docs(spark, sf_dir).select("doc_id", x.embed_text(F.col("lang"), part, F.length("text").cast("string")).alias("t"))


@query("txt18_context", "select string_agg(n::varchar || '. ' || source, chr(10) order by n) as context from (select row_number() over (order by doc_id) as n, source from (select * from documents order by doc_id limit 40))")
def txt18(spark, sf_dir):
    d = docs(spark, sf_dir).orderBy("doc_id").limit(40).withColumn("blank", F.lit("  "))
    return k.context(d, [F.asc("doc_id")], "blank", "source")


@query("txt19_leads", r"select doc_id, case when regexp_matches(text, '(?s)^.{39,}?[^\d]\. ') then length(regexp_extract(text, '(?s)^(.{39,}?[^\d]\.) ', 1)) else length(text) end as head, case when regexp_matches(text, '(?s)^.{39,}?[^\d]\. ') then length(text) - length(regexp_extract(text, '(?s)^(.{39,}?[^\d]\.) ', 1)) - 1 else 0 end as rest from documents")
def txt19(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", x.lead(F.col("text")).alias("l"))
    return d.select("doc_id", F.length("l.head").cast("long").alias("head"), F.length("l.rest").cast("long").alias("rest"))


@query("txt20_plurals", "select p_partkey, case when p_partkey % 10 = 1 and p_partkey % 100 <> 11 then 'one' when p_partkey % 10 between 2 and 4 and p_partkey % 100 not between 12 and 14 then 'few' else 'many' end as form from part")
def txt20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.plural(F.col("p_partkey"), "one", "few", "many").alias("form"))


@query("txt27_cyrillic", "select count(*) filter (where regexp_matches(text, '[а-яёА-ЯЁ]')) as n, count(*) as total from (select text from documents union all values ('Привет'), ('ёлка'), ('pizza'), (''), ('abc Ж'))")
def txt27(spark, sf_dir):
    said = spark.createDataFrame([("Привет",), ("ёлка",), ("pizza",), ("",), ("abc Ж",)], "text string")
    return docs(spark, sf_dir).select("text").unionByName(said).agg(F.count_if(x.has_cyrillic(F.col("text"))).alias("n"), F.count("*").alias("total"))


@query("txt30_geo_codes", "select p_partkey, list_distinct(list_filter([lower(p_type[1:2]), 'ec', 'any', 'zz'], lambda c: c in ('ec', 'st', 'pr', 'any'))).list_sort() as codes from part")
def txt30(spark, sf_dir):
    raw = F.concat(F.substring("p_type", 1, 2), F.lit(", EC;any/zz"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(x.geo_codes(raw, ["ec", "st", "pr"])).alias("codes"))


@query("txt32_pick", "select p_partkey, (('0x' || md5(p_name))::uhugeint % 7)::bigint as k from part")
def txt32(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.pick(F.col("p_name"), 7).alias("k"))


@query("snk30_first_sentences", "select doc_id, trim(regexp_split_to_array(text, '[.!?\\n]')[1])[1:200] as first from documents")
def snk30(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", x.first_sentence(F.col("text")).alias("first"))


RULES = [("tion", r"tion"), ("the", r"^the"), ("wh", r"wh")]


@query("vec13_subject", "select doc_id, case when regexp_matches(text, '(?i)tion') then 'tion' when regexp_matches(text, '(?i)^the') then 'the' when regexp_matches(text, '(?i)wh') then 'wh' else 'none' end as subject from documents")
def vec13(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", x.first_match(F.col("text"), RULES, "none").alias("subject"))


@query("vec14_tags", "select doc_id, list_sort(list_filter([case when regexp_matches(text, '(?i)thand') then 'b' end, case when regexp_matches(text, '(?i)wh') then 'a' end, case when regexp_matches(text, '(?i)ch') then 'c' end], lambda t: t is not null)) as tags from documents")
def vec14(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", x.tags(F.col("text"), [("thand", "b"), ("wh", "a"), ("ch", "c")]).alias("tags"))


#: Words of the shipped rules, one after each document; and what is near them, but not them.
SEEDS = (
    "Нужна карта банка", "где получить ВНЖ?", "нужна ли виза туристу", "сколько стоит багаж", "Такси или метро", "квартира в аренду", "супермаркет рядом", "торговый центр, mall", "спасибо", "картонка без визы",
    "принимают Pix и Wise", "апостиль и справка", "консульство и картория", "доставка еды ifood", "у карторио", "ок", "банкет", "можно ли без cpf", "перелёт с пересадкой", "Nubank",
)


def re2(pattern: str) -> str:
    """A pattern of the shipped rules as DuckDB reads it: word characters of all scripts, and borders of words as what surrounds them."""
    letter = r"[\p{L}\p{N}_]"
    return "(?i)" + pattern.replace(r"\b(?:", rf"(?:^|[^\p{{L}}\p{{N}}_])(?:").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])").replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])").replace(r"\w", letter)


SEEDED = f"(select doc_id, list_value({', '.join(f"'{s}'" for s in SEEDS)})[doc_id % {len(SEEDS)} + 1] as said from documents)"


def seeded(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array(*[F.lit(s) for s in SEEDS])[(F.col("doc_id") % len(SEEDS)).cast("int")].alias("said"))


@query(
    "vec13_shipped_rules",
    "select doc_id, case "
    + " ".join(f"when regexp_matches(said, '{re2(p)}') then '{s}'" for s, _, p in fixed.SUBJECTS) + f" else '{fixed.OTHER_SUBJECT}' end as subject, case "
    + " ".join(f"when regexp_matches(said, '{re2(p)}') then '{c}'" for _, c, p in fixed.SUBJECTS) + f" else '{fixed.OTHER_CATEGORY}' end as category from {SEEDED}",
)
def vec13_shipped(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", x.subject(F.col("said")).alias("subject"), x.category(F.col("said")).alias("category"))


@query("vec14_shipped_rules", "select doc_id, list_sort(list_distinct(list_filter([" + ", ".join(f"case when regexp_matches(said, '{re2(p)}') then '{t}' end" for p, t in fixed.TAGS) + f"], lambda t: t is not null))) as tags from {SEEDED}")
def vec14_shipped(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", x.tags(F.col("said")).alias("tags"))


@query("flt12_shipped_rules", f"select doc_id, regexp_matches(said, '{re2(fixed.QUESTION)}') as asks, regexp_matches(said, '{re2(fixed.USEFUL)}') as useful, regexp_matches(said, '{re2(fixed.NOISE)}') as noise from {SEEDED}")
def flt12_shipped(spark, sf_dir):
    said = F.col("said")
    return seeded(spark, sf_dir).select("doc_id", m.is_question(said).alias("asks"), m.is_useful(said).alias("useful"), m.is_noise(said).alias("noise"))


@query("vec15_overlap", "with w as (select item_id, list_distinct(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) as w from benchmark) select a.item_id as a, b.item_id as b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 9) as overlap from w a join w b on a.item_id < b.item_id")
def vec15(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", x.word_set(F.col("text")).alias("w"))  # a list of some dozens of phrases
    pairs = w.alias("a").join(w.alias("b"), F.col("a.item_id") < F.col("b.item_id"))
    return pairs.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(x.word_overlap(F.col("a.w"), F.col("b.w")), 9).alias("overlap"))


@query(
    "vec21_uuid5",
    "select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point from (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || doc_id::varchar::blob) as h from documents)",
)
def vec21(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.uuid5(F.col("doc_id").cast("string")).alias("point"))


@query("fn01_sha1_ids", "select doc_id, substr(sha1(source || ':' || doc_id::varchar), 1, 24) as id from documents")
def fn01(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.sha1_id(F.col("source"), F.col("doc_id")).alias("id"))


@query("fn03_json_lists", "select doc_id, '[\"' || lang || '\",\"' || source || '\"]' as j, 2 as n from documents")
def fn03(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", fn.json_list(F.array("lang", "source")).alias("j"))
    return d.select("doc_id", "j", F.size(fn.from_json_list(F.col("j"))).alias("n"))


@query("fn09_fan_out", "select doc_id, 'wisdom' as target, lang as value from documents where doc_id % 2 = 0 union all select doc_id, 'story', source from documents where doc_id % 3 = 0")
def fn09(spark, sf_dir):
    route = lambda name, col: F.struct(F.lit(name).alias("target"), F.col(col).alias("value"))
    d = docs(spark, sf_dir).select("doc_id", F.explode(fn.fan_out((F.col("doc_id") % 2 == 0, route("wisdom", "lang")), (F.col("doc_id") % 3 == 0, route("story", "source")))).alias("r"))
    return d.select("doc_id", "r.target", "r.value")


@query("fn10_confidence", "select conv_id, case when count(*) >= 3 then 'high' else 'medium' end as claim, case when count(*) >= 3 then 'high' else 'low' end as stored from conversations group by 1")
def fn10(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", fn.claim_confidence(F.col("n")).alias("claim"), fn.stored_confidence(F.col("n")).alias("stored"))


@query("dt02_hour_minute", f"select id, strftime(ts, '%H:%M') as hm, ts::date::varchar as day from {MESSAGES}")
def dt02(spark, sf_dir):
    return messages(spark, sf_dir).select("id", F.date_format("ts", "HH:mm").alias("hm"), F.to_date("ts").cast("string").alias("day"))


@query("dt04_quota_day", "select event_id, (ts at time zone 'UTC' at time zone 'America/Los_Angeles')::date::varchar as day from events")
def dt04(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.quota_day(F.col("ts").cast("timestamp")).cast("string").alias("day"))


@query("dt08_stale_hours", "select event_id, (epoch(timestamp '2024-02-01') - floor(epoch(ts)))::bigint // 3600 as hours from events")
def dt08(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.hours_between(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-02-01 00:00:00"))).alias("hours"))


@query("win13_clamp", "select p_partkey, greatest(3.0, least(20.0, 21 - p_size / 2)) as step from part")
def win13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.clamp(21 - F.col("p_size") / 2, 3.0, 20.0).alias("step"))


@query("set01_merged_tags", "select source, list_sort(list_distinct(list(lang) || list(case when doc_id % 2 = 0 then 'even' else 'odd' end))) as tags from documents group by 1")
def set01(spark, sf_dir):
    g = docs(spark, sf_dir).groupBy("source").agg(F.collect_set("lang").alias("a"), F.collect_set(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")).alias("b"))
    return g.select("source", fn.merged_sets(F.col("a"), F.col("b")).alias("tags"))


@query("msc19_first_words", "select doc_id, lower(regexp_split_to_array(trim(text), '\\s+')[1]) as w from documents")
def msc19(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", x.first_word(F.col("text")).alias("w"))


@query("top01_search", "with w as (select doc_id as id, list_distinct(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) as words, source, case doc_id % 3 when 0 then 1.2 when 1 then 1.0 else 0.7 end as weight from documents where lang = 'en'), h as (select *, list_filter(words, lambda v: length(v) >= 2) as lem from w), s as (select id, len(list_intersect(lem, ['the', 'and', 'src1'])) as hits, len(lem) as n, (case when contains(source, 'the') then 1 else 0 end + case when contains(source, 'and') then 1 else 0 end + case when contains(source, 'src1') then 1 else 0 end) as bonus, weight from h) select id, round((bonus * 2.0 + hits / (greatest(n, 1) / 10)) * weight, 9) as score from s where hits > 0 order by score desc, id limit 25")
def top01(spark, sf_dir):
    confidence = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    e = docs(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("").alias("question"), F.array("source").alias("tags"), x.lemmas(F.col("text")).alias("lemmas"), confidence.alias("confidence"))
    return k.search(e, ["the", "and", "src1"], 25).select("id", "score")
