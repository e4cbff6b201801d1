"""The site: page assembly with its account, title index and sitemap, and builds in another language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import assembly, projection, ranking
from tidemill.sources.store import cut_lineage

from .adapters import table
from .catalog import query

MAIN = "en"
#: Documents as labelled items: labels with and without an address, translated or not, collective ones, and shelves of themes.
ITEMS = """
select lang, concat('g', cast(doc_id % 3 as string)) as geo, case when doc_id % 4 = 0 then 'shelf' else 'view' end as kind,
  case when doc_id % 4 = 0 then concat('Shelf ', cast(doc_id % 5 as string)) when doc_id % 5 = 0 then concat('Money ', cast(doc_id % 2 as string)) when doc_id % 5 = 1 then concat('Путь ', cast(doc_id % 2 as string))
    when doc_id % 5 = 2 then 'misc' when doc_id % 5 = 3 then '!!!' else concat('Visa ', cast(doc_id % 7 as string)) end as label,
  case when doc_id % 4 <> 0 and doc_id % 5 = 0 then concat('money-', cast(doc_id % 2 as string)) end as key,
  case when doc_id % 4 = 0 then case doc_id % 5 when 3 then null when 4 then 't9' else concat('t', cast(doc_id % 5 as string)) end
    when doc_id % 5 = 0 then case when lang = 'en' then 't0' end when doc_id % 5 = 2 then concat('t', cast(doc_id % 6 as string)) when doc_id % 5 = 4 then 't1' end as theme,
  doc_id as id, case when doc_id % 31 = 0 then null else text end as text
from documents"""
NAMES = "select distinct lang, theme, concat('Theme ', theme) as name from (select lang, explode(array('t0', 't1', 't2', 't9')) as theme from documents) where not (lang = 'fr' and theme = 't1')"


def site(spark: SparkSession, sf_dir: str) -> assembly.Site:
    docs = table(spark, sf_dir, "documents")
    items, names = spark.sql(ITEMS.replace("from documents", "from {docs}"), docs=docs), spark.sql(NAMES.replace("from documents", "from {docs}"), docs=docs)
    return assembly.assemble(items, names, main=MAIN, prefixes=["misc"])


SITE = f"""
with items as ({ITEMS.replace("as string", "as varchar")}
), names as (
  select distinct lang, theme as home, 'Theme ' || theme as name from documents, (select unnest(['t0', 't1', 't2', 't9']) as theme) where not (lang = 'fr' and theme = 't1')
), counted as (
  select lang, geo, kind, label, key, theme, count(*) as n from items group by all
), nodes as (
  select c.*, coalesce(c.theme, case when c.lang <> 'en' and c.kind = 'view' then k.theme end) as home,
    case when c.n < case kind when 'view' then 4 else 3 end then 'few' when label = '!!!' then 'no address' when kind = 'view' and lang <> 'en' and starts_with(label, 'П') then 'not translated'
      when kind = 'view' and lang = 'en' and label = 'misc' then 'collective label' end as reason,
    '/' || lang || '/' || c.geo || '/' || case kind when 'view' then '' else 's/' end || coalesce(c.key, replace(replace(lower(label), 'путь', 'put'), ' ', '-')) || '/' as path
  from counted c left join (select geo, key, min(theme) as theme from counted where lang = 'en' and kind = 'view' and key is not null and theme is not null group by all) k on c.geo = k.geo and c.key = k.key
), homes as (
  select lang, geo, home, path as shelf_path, n as shelf_n from nodes where reason is null and kind = 'shelf' and home is not null qualify row_number() over (partition by lang, geo, home order by n desc, label) = 1
), facts as (
  select f.*, h.shelf_path, h.shelf_n, m.name, bool_or(f.home is not null and m.name is null) over (partition by f.lang, f.geo) as flat
  from nodes f left join homes h on f.lang = h.lang and f.geo = h.geo and f.home = h.home left join names m on f.lang = m.lang and f.home = m.home where f.reason is null and f.kind = 'view'
), tiled as (
  select lang, geo, '/' || lang || '/' || geo || '/' as "on", 0 as rank, -count(*) as mass, name as title, shelf_path as url, sum(n) + shelf_n as n from facts where not flat and shelf_path is not null group by lang, geo, home, name, shelf_path, shelf_n
  union all select lang, geo, '/' || lang || '/' || geo || '/', 1, -n, label, path, n from facts where flat or shelf_path is null
  union all select lang, geo, shelf_path, 1, -n, label, path, n from facts where shelf_path is not null
)"""


@query(
    "pg01_pages",
    f"{SITE} select lang, geo, kind, path, home as theme, label, n from nodes where reason is null union all select lang, geo, 'hub', '/' || lang || '/' || geo || '/', null, '', count(*) from tiled where \"on\" = '/' || lang || '/' || geo || '/' group by lang, geo",
)
def pg01_pages(spark, sf_dir):
    return site(spark, sf_dir).pages


@query("pg01_tiles", f'{SITE} select lang, geo, "on", row_number() over (partition by "on" order by rank, mass, title, url) as place, title, url, n::bigint as n from tiled')
def pg01_tiles(spark, sf_dir):
    return site(spark, sf_dir).tiles


@query(
    "pg01_account",
    f"""{SITE}
select i.id, i.kind, case when n.reason is null then n.path when n.reason = 'collective label' and coalesce(trim(i.text), '') <> '' then h.shelf_path end as path,
  case when n.reason is null then 'item' when n.reason <> 'collective label' then n.reason when coalesce(trim(i.text), '') = '' then 'no text' when n.home is null then 'no theme' when h.shelf_path is null then 'no shelf' else 'rescued' end as outcome
from items i join nodes n on i.lang is not distinct from n.lang and i.geo = n.geo and i.kind = n.kind and i.label = n.label and i.key is not distinct from n.key and i.theme is not distinct from n.theme
  left join homes h on n.lang = h.lang and n.geo = h.geo and n.home = h.home""",
)
def pg01_account(spark, sf_dir):
    """Every item of the input, once: the page it is on, or why it is on none."""
    s = site(spark, sf_dir)
    on = s.placed.select("id", "kind", "path", F.col("role").alias("outcome"))
    return on.unionByName(s.unplaced.select("id", "kind", F.lit(None).cast("string").alias("path"), F.col("reason").alias("outcome")))


def first_letters(text: Column, n: int) -> Column:
    """The first n Latin letters and blanks of a text. Only as much of it is read as holds them."""
    start = F.regexp_extract(text, rf"^(?:[^A-Za-z ]*+[A-Za-z ]){{0,{n}}}+", 0)
    return F.regexp_replace(start, "[^A-Za-z ]", "")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "lang", F.when(F.col("doc_id") % 17 != 0, first_letters(F.col("text"), 12)).alias("title"), F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/")).alias("path"),
        (F.col("doc_id") % 9 == 0).alias("noindex"), F.when(F.col("doc_id") % 2 == 0, "2026-07-01").otherwise("").alias("updated"),
    )


@query(
    "snk27_title_index",
    """with pages_ as (select lang, substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 12) as title, '/' || lang || '/' || doc_id || '/' as path from documents where doc_id % 17 <> 0 and doc_id % 9 <> 0)
select lang, row_number() over (partition by lang order by lower(title), title, path) as position, title, path from pages_ where title <> ''""",
)
def snk27_index(spark, sf_dir):
    return ranking.title_index(titled(spark, sf_dir))


@query(
    "snk27_sitemap",
    """with listed as (select 'https://example.net/' || lang || '/' || doc_id || '/' as loc, case when doc_id % 2 = 0 then '2026-07-01' else '2026-01-01' end as lastmod, row_number() over (order by '/' || lang || '/' || doc_id || '/') as position from documents where doc_id % 9 <> 0)
select ((position - 1) // 150)::int as file, position, loc, lastmod from listed""",
)
def snk27_sitemap(spark, sf_dir):
    return ranking.sitemap(titled(spark, sf_dir), "https://example.net", lastmod="2026-01-01", per_file=150)


#: Two builds: the first of three quarters of the documents; by the second a tenth of the texts and some labels have changed.
FIRST = "doc_id % 4 <> 3"
PROJECTED = """
select concat('g', cast(doc_id % 4 as string)) as geo, case when doc_id % 3 = 0 then 'shelf' else 'view' end as kind, concat('n', cast(doc_id % 13 as string)) as node,
  case when doc_id % 13 = 5 then 'Без имени' when doc_id % 13 = 7 and doc_id % 4 = 0 and {second} then 'Renamed 7' else concat('Label ', cast(doc_id % 13 as string)) end as label, doc_id as id,
  case when doc_id % 10 = 0 and {second} then concat(text, '!') else text end as text from {docs}"""


def builds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The second build, and the signatures of both builds' sources."""
    docs = table(spark, sf_dir, "documents")
    # What cannot be translated: every eleventh text (by its length), and the label without a name.
    translate = lambda t: F.when(F.length(t) % 11 != 0, F.concat(F.lit("xx:"), t))
    name = lambda x: F.when(~x.startswith("Без"), F.upper(x))
    none = spark.createDataFrame([], "geo string, kind string, node string, src string, label string, id long, text string, h string")
    one, two = (spark.sql(PROJECTED.replace("{second}", s), docs=d) for d, s in ((docs.where(FIRST), "false"), (docs, "true")))
    first = cut_lineage(projection.project(one.drop("text"), one.select("id", "text"), none, translate, name).drop("carried"))
    # The old build's labels are known by a mark, to tell them from new ones.
    first = first.withColumn("label", F.concat(F.lit("old "), "label"))
    second = projection.project(two.drop("text"), two.select("id", "text"), first, translate, name)
    return second, projection.signature(one.drop("text"), one.select("id", "text")), projection.signature(two.drop("text"), two.select("id", "text"))


BUILDS = """
with one as (
  select 'g' || doc_id % 4 as geo, case when doc_id % 3 = 0 then 'shelf' else 'view' end as kind, 'n' || doc_id % 13 as node, case when doc_id % 13 = 5 then 'Без имени' else 'Label ' || doc_id % 13 end as label, doc_id as id, text from documents where doc_id % 4 <> 3
), two as (
  select 'g' || doc_id % 4 as geo, case when doc_id % 3 = 0 then 'shelf' else 'view' end as kind, 'n' || doc_id % 13 as node,
    case when doc_id % 13 = 5 then 'Без имени' when doc_id % 13 = 7 and doc_id % 4 = 0 then 'Renamed 7' else 'Label ' || doc_id % 13 end as label, doc_id as id, case when doc_id % 10 = 0 then text || '!' else text end as text from documents
), built as (
  select *, count(*) over (partition by geo, kind, node) as n from one where trim(text) <> '' and length(text) % 11 <> 0
), first_ as (
  select geo, kind, node, label, id, 'xx:' || text as said, text as source from built where kind <> 'view' or (n >= 4 and label <> 'Без имени')
), sets as (
  select geo, kind, node, label, list_sort(list_distinct(list(id))) as ids from two group by all
), old_sets as (
  select geo, kind, node, label, list_sort(list_distinct(list(id))) as ids from first_ group by all
), exact as (
  select n.geo, n.kind, n.node, o.label as old_label, o.node as old_node from sets n join old_sets o on n.geo = o.geo and n.kind = o.kind and n.label = o.label
), inner_ as (
  select n.geo, n.kind, n.node, o.geo as old_geo, o.kind as old_kind, o.node as old_node, o.label as old_label from sets n join old_sets o on list_has_all(n.ids, o.ids)
  where not exists (select 1 from exact e where e.geo = n.geo and e.kind = n.kind and e.node = n.node) and not exists (select 1 from exact e where e.geo = o.geo and e.kind = o.kind and e.old_node = o.node)
), lone as (
  select * from inner_ qualify count(*) over (partition by geo, kind, node) = 1
), bound as (
  select geo, kind, node, old_label from exact
  union all select geo, kind, node, old_label from (select *, row_number() over (partition by old_geo, old_kind, old_node order by geo, kind, node) as r from lone) where r = 1
), labels as (
  select s.geo, s.kind, s.node, s.label as src, case when b.old_label is not null and b.old_label <> 'Без имени' then 'old ' || upper(b.old_label) when s.label = 'Без имени' then s.label else upper(s.label) end as label
  from sets s left join bound b on s.geo = b.geo and s.kind = b.kind and s.node = b.node
), texts as (
  select t.geo, t.kind, t.node, t.id, f.source = t.text as carried, case when f.source = t.text then f.said when length(t.text) % 11 <> 0 then 'xx:' || t.text end as text
  from two t left join first_ f on t.id = f.id where trim(t.text) <> ''
), left_ as (
  select *, count(*) over (partition by geo, kind, node) as n from texts where text is not null
)
"""


@query("pg05_second_build", f"{BUILDS} select l.geo, l.kind, l.node, b.src, b.label, l.id, l.text, coalesce(l.carried, false) as carried from left_ l join labels b on l.geo = b.geo and l.kind = b.kind and l.node = b.node where l.kind <> 'view' or (l.n >= 4 and b.label <> 'Без имени')")
def pg05(spark, sf_dir):
    return builds(spark, sf_dir)[0].drop("h")


@query("pg13_stale", f"{BUILDS} select distinct t.geo from two t left join one o on t.id = o.id where o.id is null or o.text <> t.text or o.label <> t.label")
def pg13(spark, sf_dir):
    _, before, now = builds(spark, sf_dir)
    return projection.stale(now, before)
