"""Page assembly: links, rotation, uniqueness, themes, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text as x
from tidemill.operators import clusters as c
from tidemill.operators import knowledge as k
from tidemill.operators import pages as p

from .adapters import UNITS, PATTERNS, patterns, table
from .catalog import query
from .vectors import DOT

PATH = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', ''), ''), '/')"


@query("jon17_broken_links", "select distinct page_id, " + PATH.format("href") + " as path from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) where starts_with(href, '/') and " + PATH.format("href") + " not in (select " + PATH.format("url") + " from pages)")
def jon17(spark, sf_dir):
    return p.broken_links(table(spark, sf_dir, "pages"))


@query("pg09_readiness", r"select page_id, length(t)::int as text_chars, length(t) < 400 or not contains(html, '<h1') as thin, regexp_matches(html, 'Ã|â€|�') as mojibake from (select page_id, html, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')), '\s+', ' ', 'g') as t from pages)")
def pg09(spark, sf_dir):
    return p.readiness(table(spark, sf_dir, "pages"))


@query("grf03_crawl", "with recursive e as (select distinct lower(split_part(url, '/', 3)) as src, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) as dst from pages), r as (select src as node, 0 as depth from (select distinct src from e order by src limit 5) union select e.dst, r.depth + 1 from r join e on r.node = e.src where r.depth < 3) select node, min(depth) as depth from r group by 1")
def grf03(spark, sf_dir):
    e = table(spark, sf_dir, "pages").select(F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("dst")).distinct()
    return p.crawl(e, e.select("src").distinct().orderBy("src").limit(5).select(F.col("src").alias("node")), 3)


@query("grf04_sitemap_gaps", "with l as (select distinct " + PATH.format("url") + " as path from pages where page_id % 3 <> 0), e as (select distinct " + PATH.format("url") + " as path from pages where page_id % 5 <> 0) select coalesce(l.path, e.path) as path, case when e.path is null then 'dead' when l.path is null then 'orphan' else 'ok' end as status from l full join e on l.path = e.path")
def grf04(spark, sf_dir):
    pg = table(spark, sf_dir, "pages").select("page_id", p.local_path(F.col("url")).alias("path"))
    return p.sitemap_gaps(pg.where("page_id % 3 <> 0"), pg.where("page_id % 5 <> 0"))


@query("win09_rotation", f"select id, country from (select *, row_number() over (partition by country order by stamp, id) as n from {PATTERNS}) where n = 1 order by country in ('es', 'de'), country <= 'de', country limit 1")
def win09(spark, sf_dir):
    return p.rotation(patterns(spark, sf_dir).select("id", "country", "stamp"), ["es", "de"]).select("id", "country")


@query("win15_unique_names", "select p_partkey, case when n = 1 then name else name || '-' || n::varchar end as unique_name from (select p_partkey, lower(replace(p_name, ' ', '-')) as name, row_number() over (partition by p_brand, p_name order by p_partkey) as n from part)")
def win15(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", x.slug(F.col("p_name")).alias("name"))
    return p.unique_names(rows, ["p_brand"], "name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("vec17_first_theme", "with a as (select doc_id as id, source as theme, doc_id % 3 as place from documents union all select doc_id, lang, doc_id % 2 from documents), f as (select id, theme from (select *, row_number() over (partition by id order by place, theme) as n from a) where n = 1), s as (select theme, count(*) as c from f group by 1) select id, case when c >= 15 then theme else 'rest' end as theme from f join s using (theme)")
def vec17(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("id"), F.col("source").alias("theme"), (F.col("doc_id") % 3).alias("place")).unionByName(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("theme"), (F.col("doc_id") % 2).alias("place")))
    return p.first_assignment(a, 15).select("id", "theme")


@query("vec12_branches", "with b as (select lang as shelf, source as branch, doc_id as id from documents where doc_id in (select doc_id from labels)), g as (select shelf, branch from b group by all having count(*) >= 4), s as (select shelf from g group by 1 having count(*) >= 2) select b.* from b join g using (shelf, branch) join s using (shelf)")
def vec12(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select(F.col("lang").alias("shelf"), F.col("source").alias("branch"), F.col("doc_id").alias("id"))
    return c.carried_branches(b, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("top11_siblings", "with pg as (select p_partkey as key, p_brand as geo, p_type as theme from part), x as (select a.key, b.key as sibling, a.theme = b.theme as same from pg a join pg b on a.geo = b.geo and a.key <> b.key), y as (select *, max(same::int) over (partition by key) as any_same from x) select key, sibling, place from (select key, sibling, row_number() over (partition by key order by sibling)::int as place from y where same or any_same = 0) where place <= 6")
def top11(spark, sf_dir):
    return p.siblings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("geo"), F.col("p_type").alias("theme")))


@query(
    "jon08_merge_claims",
    """
with recursive said as (
  select q.conv_id as id, 'c' || q.conv_id % 4 as category, 't' || q.conv_id % 5 as tag, list_distinct(regexp_extract_all(lower(q.text), '[а-яёa-z0-9]+')) as words, row_number() over (partition by q.conv_id % 4 order by q.conv_id) as n
  from conversations q join conversations a on q.conv_id = a.conv_id and q.turn = 0 and a.turn = 1 where trim(q.text) <> '' and trim(a.text) <> ''
), fold as (
  select category, n, [{'id': id, 'words': words, 'n': 1::bigint, 'tags': [tag], 'stamp': n}] as stored from said where n = 1
  union all
  select category, n, case when hit is null then list_append(stored, {'id': id, 'words': words, 'n': 1::bigint, 'tags': [tag], 'stamp': n})
    else list_transform(stored, lambda s: case when s.id = hit then {'id': s.id, 'words': s.words, 'n': s.n + 1, 'tags': list_distinct(list_append(s.tags, tag)), 'stamp': n} else s end) end
  from (
    select r.*, f.stored, list_reverse_sort(list_filter(list_transform(f.stored, lambda s: {'share': len(list_intersect(s.words, r.words)) / greatest(least(len(s.words), len(r.words)), 1), 'stamp': s.stamp, 'id': s.id}), lambda x: x.share >= 0.6))[1].id as hit
    from fold f join said r on r.category = f.category and r.n = f.n + 1
  )
), last_ as (
  select category, unnest(arg_max(stored, n)) as s from fold group by category
)
select s.id as id, category, s.n as count, case when s.n >= 3 then 'high' else 'low' end as confidence, len(s.tags)::int as tags from last_
""",
)
def jon08(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    q = conv.where("turn = 0").select("conv_id", F.col("text").alias("question"))
    a = conv.where("turn = 1").select("conv_id", "text")
    rows = q.join(a, "conv_id").select(
        F.col("conv_id").alias("id"), F.lit("br").alias("country"), F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("category"), "question", F.col("text").alias("answer"),
        F.array(F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string"))).alias("tags"), F.array("conv_id").alias("source_msgs"), F.lit(1).cast("long").alias("count"),
    )
    return k.merge_claims(rows).select("id", "category", "count", "confidence", F.size("tags").alias("tags"))


@query(
    "jon12_carry_forward",
    """with old as (select lang || '/' || source as key, doc_id as id from documents), new as (select 'n/' || lang || '/' || source as key, doc_id as id from documents where doc_id % 6 <> 1),
sizes as (select o.key as old_key, n.key as new_key, count(*) as both_, (select count(*) from old x where x.key = o.key) as os, (select count(*) from new x where x.key = n.key) as ns from old o join new n on o.id = n.id group by o.key, n.key)
select new_key, old_key, round(both_ / os, 6) as coverage from sizes where both_ / os >= 0.7 or (both_ = os and both_ = ns)""",
)
def jon12(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.groupBy(F.concat_ws("/", "lang", "source").alias("key")).agg(F.collect_list("doc_id").alias("ids"))
    new = d.where("doc_id % 6 <> 1").groupBy(F.concat_ws("/", F.lit("n"), "lang", "source").alias("key")).agg(F.collect_list("doc_id").alias("ids"))
    return k.carry_forward(new, old).select("new_key", "old_key", F.round("coverage", 6).alias("coverage"))


@query("jon11_bind_nodes", "select 'n' || source as new_key, 'o' || source as old_key from documents group by source having count(*) filter (where doc_id % 2 = 0) > 0")
def jon11(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.groupBy(F.concat(F.lit("n"), "source").alias("key"), F.col("source").alias("src")).agg(F.collect_list("doc_id").alias("ids"))
    old = d.where("doc_id % 2 = 0").groupBy(F.concat(F.lit("o"), "source").alias("key"), F.when(F.crc32(F.col("source").cast("binary")) % 2 == 0, F.col("source")).otherwise(F.lit("other")).alias("src")).agg(F.collect_list("doc_id").alias("ids"))
    return k.bind_nodes(new, old.select("key", "src", "ids"))


@query("txt28_resolve_country", "with q as (select distinct n_name as query from nation union select 'nation_2' union select 'ASIA' union select '3'), c as (select n_nationkey::varchar as code, n_name as name from nation) select query, coalesce(max(code) filter (where lower(query) = lower(code)), max(code) filter (where lower(query) = lower(name)), case when count(distinct code) = 1 then max(code) end) as code from q left join c on lower(query) = lower(code) or lower(query) = lower(name) or starts_with(lower(name), lower(query)) group by 1")
def txt28(spark, sf_dir):
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    q = c.select(F.col("name").alias("query")).unionByName(spark.createDataFrame([("nation_2",), ("ASIA",), ("3",)], "query string")).distinct()
    return p.resolve_country(q, c)


@query("agg20_mature_geos", "select source as geo, count(*) filter (where l.doc_id is null and d.doc_id % 5 <> 0) as left, count(*) filter (where l.doc_id is null and d.doc_id % 5 <> 0) = 0 as mature from documents d left join labels l using (doc_id) group by 1".replace(" as left,", ' as "left",'))
def agg20(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("geo"), F.col("doc_id").alias("id"))
    return p.mature(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), d.where("id % 5 = 0"))


SPOILT = [(-1, "xa", "<h1>Ã©tÃ©</h1>"), (-2, "xb", "<p>no heading</p>"), (-3, "xc", "<h1>fine</h1>")]
SPOILT_SQL = ", ".join(f"({i}, '{g}', '{h}')" for i, g, h in SPOILT)


@query("pg10_bad_geos", f"with r as (select page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) as geo, html from pages union all values {SPOILT_SQL}) select geo, bool_or(regexp_matches(html, 'Ã|â€|�') or not contains(html, '<h1')) as bad, count(*) as n from r group by 1")
def pg10(spark, sf_dir):
    pg = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("geo"), "html").unionByName(spark.createDataFrame(SPOILT, "page_id long, geo string, html string"))
    return p.bad_geos(pg)


@query(
    "pg07_skeleton",
    f"""
with u as (select * from {UNITS}), m as (select label, list(x order by p) as v from (select label, p, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as p from u) group by all) group by 1
), best as (
  select id, category, v from (select a.id, a.v, b.label as category, row_number() over (partition by a.id order by round({DOT} / sqrt(list_sum(list_transform(b.v, lambda x: x * x))), 12) desc, b.label) as n from u a, m b) where n = 1
), centres as (
  select category, list(x order by p) as v from (select category, p, avg(x) as x from (select category, unnest(v) as x, generate_subscripts(v, 1) as p from best) group by all) group by 1
)
select a.category, count(*) as n, md5(string_agg(a.id::varchar, '' order by a.id::varchar)) as hash, round(avg({DOT} / sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 6) as coherence,
  count(*) >= 4 and avg({DOT} / sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) >= 0.2 as open
from best a join centres b on a.category = b.category group by a.category
""",
)
def pg07(spark, sf_dir):
    from .adapters import units

    u = units(spark, sf_dir).withColumn("h", F.col("id").cast("string"))
    cats = c.centroids(u, "label", 64).select(F.col("label").alias("category"), F.col("centroid").alias("c"))
    return p.skeleton(u, cats, 64, coherent=0.2).select("category", "n", "hash", F.round("coherence", 6).alias("coherence"), "open")


@query("ext02_embed_long")
def ext02(spark, sf_dir):
    from tidemill.functions.vectors import norm
    from tidemill.operators.external import HashEmbedder, embed_long

    got = embed_long(table(spark, sf_dir, "documents"), "doc_id", "text", HashEmbedder(32), 32)
    return got.select("id", "pieces", F.round(norm(F.col("v")), 6).alias("norm"))


@query("fn15_stitched_labels", "select doc_id, case when doc_id % 4 = 3 then 'other' else case doc_id % 3 when 0 then 'a' when 1 then 'b' else 'other' end end as label from documents")
def fn15(spark, sf_dir):
    from tidemill.operators.external import stitched

    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("batch"), (F.col("doc_id") % 4).alias("place"))
    label = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").otherwise("unknown")
    answers = d.withColumn("l", label).where("place < 3").groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "l"))), lambda r: r["l"]).alias("labels"))
    return stitched(d, "batch", answers, ["a", "b"], "other").select("doc_id", "label")
