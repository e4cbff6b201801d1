"""Wiki pages, node trees and the full-text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text as x
from tidemill.operators import nodes, postings, wiki
from tidemill.sources.store import cut_lineage, scratch

from .adapters import MESSAGES, messages, table
from .catalog import ORACLES, query
from .messages import END, KEYWORDS, START

#: Documents as wiki pages: each line is a listing, or a paragraph of a section; marks of the wiki's own are blanks in it.
WIKI_LINES = r"""select doc_id, lang as country, 'Page ' || doc_id as title, i,
    trim(regexp_replace(parts[i], '[^\pL\pN.,;]+', ' ', 'g')) as line from (select doc_id, lang, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, lang, string_split(text, chr(10)) as parts from documents))"""
MARKED = """case i % 5 when 0 then '{{See|name=Spot ' || i || '|content=' || line || '}}' when 1 then '{{ eat | alt = [[Inn|Inn ' || i || ']] | name= | price=5 | hours=''''noon'''' | content=' || substr(line, 1, 20) || '}}'
    when 2 then '{{infobox|name=no|content=' || line || '}}' when 3 then '==Get in==' || chr(10) || line || chr(10) else '=== Deeper ===' || chr(10) || chr(10) || line || chr(10) end"""


def wiki_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    each = d.select("doc_id", F.col("lang").alias("country"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), F.split("text", "\n").alias("parts"))
    line = lambda p: F.trim(F.regexp_replace(p, r"[^\p{L}\p{N}.,;]+", " "))

    def marked(p, k):
        i, text = (k + 1).cast("string"), line(p)
        kind = (k + 1) % 5
        return (
            F.when(kind == 0, F.concat(F.lit("{{See|name=Spot "), i, F.lit("|content="), text, F.lit("}}")))
            .when(kind == 1, F.concat(F.lit("{{ eat | alt = [[Inn|Inn "), i, F.lit("]] | name= | price=5 | hours=''noon'' | content="), F.substring(text, 1, 20), F.lit("}}")))
            .when(kind == 2, F.concat(F.lit("{{infobox|name=no|content="), text, F.lit("}}")))
            .when(kind == 3, F.concat(F.lit("==Get in==\n"), text, F.lit("\n")))
            .otherwise(F.concat(F.lit("=== Deeper ===\n\n"), text, F.lit("\n")))
        )

    return each.select("country", "title", F.array_join(F.transform("parts", marked), "\n").alias("text"))


@query(
    "src10_listings",
    rf"""
with lines as ({WIKI_LINES}
), pages as (
  select country, title, string_agg({MARKED}, chr(10) order by i) as page from lines group by country, title
), flat as (
  select country, title, 0 as pass, 0 as section, n as part, regexp_extract(t, '^\{{\{{\s*(\w+)', 1) as kind, t
  from (select country, title, unnest(ts) as t, unnest(range(len(ts))) as n from (select country, title, regexp_extract_all(page, '\{{\{{[^{{}}]*\}}\}}') as ts from pages))
), fields as (
  select country, title, pass, section, part, lower(kind) as kind, regexp_extract(t, '\|\s*name\s*=\s*([^|}}]*)', 1) as name, trim(regexp_extract(t, 'alt = \[\[Inn\|([^\]]*)\]\]', 1)) as alt,
    trim(regexp_extract(t, 'price=([^|}}]*)', 1)) as price, trim(replace(regexp_extract(t, 'hours=([^|}}]*)', 1), '''', '')) as hours, trim(regexp_extract(t, 'content=([^|}}]*)', 1)) as content from flat
), listed as (
  select country, title, pass, section, part, case when trim(name) <> '' then trim(name) else alt end as name, case kind when 'eat' then 'Food' else 'Travel' end as tag,
    concat_ws(' ', nullif(content, ''), 'Hours: ' || nullif(hours, '') || '.', 'Price: ' || nullif(price, '') || '.') as instruction
  from fields where kind in ('see', 'eat') and (trim(name) <> '' or alt <> '') and (length(content) >= 30 or (price <> '' and hours <> ''))
), sectioned as (
  select country, title, n as section, string_split(s, chr(10)) as head, s
  from (select country, title, unnest(ss) as s, unnest(range(len(ss))) as n from (select country, title, string_split(page, '==Get in==' || chr(10)) as ss from pages)) where n > 0
), parts as (
  select country, title, 1 as pass, section, p as part, title || ': Get in' as name, 'Bureaucracy' as tag, paragraph
  from (select country, title, section, unnest(ps) as paragraph, unnest(range(len(ps))) as p from (select country, title, section, string_split_regex(s, '\n\s*\n') as ps from sectioned)) where regexp_matches(paragraph, '\S')
), cleaned as (
  select country, title, pass, section, part, name, tag, trim(regexp_replace(regexp_replace(paragraph, '\{{\{{[^{{}}]*\}}\}}', '', 'g'), '\s+', ' ', 'g')) as instruction from parts
), numbered as (
  select *, row_number() over (partition by country, title order by pass, section, part) - 1 as idx from (select * from listed union all select * from cleaned)
)
select substr(sha1('wikivoyage:' || country || ':' || title || ':' || idx), 1, 24) as id, country, name as title, tag, instruction, title as source_title, idx from numbered where pass = 0 or length(instruction) >= 60
""",
)
def src10(spark, sf_dir):
    return wiki.wiki_patterns(wiki_pages(spark, sf_dir))


@query(
    "txt25_nodes",
    r"""
with whole as (
  select page_id, case when regexp_matches(html, '&[^\s;<>]*$') then regexp_replace(html, '[^>]*$', '') else regexp_replace(html, '<[^>]*$', '') end as h0 from (select page_id, replace(html, chr(10), '<br>') as html from pages)
), pages_ as (
  select page_id, h0, regexp_replace(regexp_replace(h0, '<!--.*?-->', '', 'g'), '<!DOCTYPE[^>]*>', '', 'g') as h from whole
), masked as (
  select page_id, h0, regexp_replace(h, '(<script>[^<]*)<[^<]*(</script>)', '\1\2', 'g') as h from pages_
), marks as (
  select page_id, h0, regexp_extract_all(h, '</?[a-z][a-z0-9]*[^>]*>') as tags from masked
), folded as (
  select page_id, h0, len(list_filter(tags, lambda t: not starts_with(t, '</'))) as n_tags, len(list_filter(tags, lambda t: regexp_matches(t, '^<a[ >]'))) as n_links,
    list_reduce(list_transform(tags, lambda t: {'path': [regexp_extract(t, '^</?([a-z0-9]+)', 1)], 'deep': case when starts_with(t, '</') then -1 when regexp_matches(t, '^<(br|img|hr)[ />]') then 0 else 1 end}),
      lambda a, t: case when t.deep = 1 then {'path': list_append(a.path, t.path[1]), 'deep': greatest(a.deep, len(a.path) + 1)}
        when t.deep = 0 then {'path': a.path, 'deep': greatest(a.deep, len(a.path) + 1)}
        when len(a.path) > 1 and a.path[-1] = t.path[1] then {'path': a.path[1:-2], 'deep': a.deep} else a end, {'path': ['p'], 'deep': 1}) as f
  from marks
)
select page_id, n_tags::bigint + 1 as n_tags, n_links::bigint as n_links, f.deep::bigint as depth,
  length(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h0, '(<script>[^<]*)</p>([^<]*</script>)', '\1....\2', 'g'), '<!--.*?-->|<!DOCTYPE[^>]*>|</?[a-z][a-z0-9]*(\s[^>]*)?>', '', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) as n_chars
from folded
""",
)
def txt25(spark, sf_dir):
    trees = table(spark, sf_dir, "pages").select("page_id", nodes.html_nodes(F.col("html")).alias("tree"))
    each = nodes.walked(cut_lineage(trees))
    count = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("long")
    return each.groupBy("page_id").agg(
        count(F.col("tag").isNotNull()).alias("n_tags"), count(F.col("tag") == "a").alias("n_links"), F.max(F.when(F.col("tag").isNotNull(), F.col("level") + 1)).cast("long").alias("depth"), F.sum(F.length("text")).alias("n_chars")
    )


def message_index(spark, sf_dir, *carry: str) -> str:
    rows, path = messages(spark, sf_dir), scratch(spark)
    postings.write_index(rows, postings.words_of([F.col("id"), F.col("channel"), F.col("ts").cast("string"), F.col("text")]), path, carry=carry)
    return path


def in_range():
    return F.col("ts").between(START, END)


@query("flt05_indexed_keywords", None)
def flt05_indexed(spark, sf_dir):
    return postings.relevant(messages(spark, sf_dir), message_index(spark, sf_dir, "ts"), KEYWORDS, in_range(), 300).select("id", "text")


@query("jon01_indexed_country", None)
def jon01_indexed(spark, sf_dir):
    return postings.relevant(messages(spark, sf_dir), message_index(spark, sf_dir, "ts", "country"), KEYWORDS, in_range() & (F.col("country") == "lk"), 100).select("id", "text")


@query(
    "flt05_term_counts",
    f"select term, count(distinct id) as texts, sum(n)::bigint as times from (select id, term, count(*) as n from (select id, unnest(regexp_split_to_array(lower(id || ' ' || channel || ' ' || ts::varchar || ' ' || text), '[^a-z0-9]+')) as term from {MESSAGES}) where term in ('error', '2024') or term[1:4] = 'purc' or term[1:1] = 'v' group by id, term) group by term",
)
def flt05_terms(spark, sf_dir):
    found = postings.postings(spark, message_index(spark, sf_dir), "error OR 2024 OR purc* OR v*")
    return found.groupBy("term").agg(F.countDistinct("id").alias("texts"), F.sum("n").cast("long").alias("times"))


@query("top01_indexed", None)
def top01_indexed(spark, sf_dir):
    confidence = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit("").alias("question"), F.array("source").alias("tags"), F.col("text"), confidence.alias("confidence"))
    path = scratch(spark)
    postings.write_index(e, x.lemmas(F.col("text")), path, carry=["lang"])
    return postings.search(e.where("lang = 'en'").drop("text"), path, ["the", "and", "src1"], F.col("lang") == "en", 25).select("id", "score")


def same_rows() -> None:
    """The index answers what the scans answer: their SQL is the same."""
    for indexed, scanned in (("flt05_indexed_keywords", "flt06_keywords"), ("jon01_indexed_country", "jon01_country_keywords"), ("top01_indexed", "top01_search")):
        ORACLES[indexed] = ORACLES[scanned]
