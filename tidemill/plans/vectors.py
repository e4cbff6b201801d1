"""Vector search, assignment and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import vectors as v
from tidemill.operators import clusters as c

from .adapters import UNITS, table, units
from .catalog import query

THRESHOLD = 0.40
DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"


@query("vec01_cosine", f"select a.id as a, b.id as b, round({DOT}, 9) as cosine from {UNITS} a join {UNITS} b on b.id = a.id + 1")
def vec01(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e.alias("a").join(e.alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(v.cosine(F.col("a.embedding"), F.col("b.embedding")), 9).alias("cosine"))


@query("jon10_nearest", f"select query, id, rank, round(score, 9) as score from (select a.id as query, b.id as id, {DOT} as score, row_number() over (partition by a.id order by {DOT} desc, b.id) as rank from {UNITS} a join {UNITS} b on a.id <> b.id where a.id % 25 = 0) where rank <= 5")
def jon10(spark, sf_dir):
    u = units(spark, sf_dir).select("id", "v")
    return c.nearest(u.where("id % 25 = 0"), u, 5).select("query", "id", "rank", F.round("score", 9).alias("score"))


@query("jon09_similar_pairs", f"select a.id as a, b.id as b, round({DOT}, 9) as score from {UNITS} a join {UNITS} b on a.id < b.id where {DOT} >= {THRESHOLD}")
def jon09(spark, sf_dir):
    return c.similar_pairs(units(spark, sf_dir).select("id", "v"), THRESHOLD).select("a", "b", F.round("score", 9).alias("score"))


@query("grf01_components", f"with recursive e as (select a.id as a, b.id as b from {UNITS} a join {UNITS} b on a.id <> b.id where {DOT} >= {THRESHOLD}), r as (select id, id as seen from {UNITS} u union select r.id, e.b from r join e on r.seen = e.a) select id, min(seen) as component from r group by 1")
def grf01(spark, sf_dir):
    u = units(spark, sf_dir).select("id", "v")
    return c.components(u, c.linking_edges(u, THRESHOLD))


@query("vec05_near_groups")
def vec05(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("length"))
    return c.near_groups(d.join(units(spark, sf_dir).select("id", "v"), "id", "left"), THRESHOLD)


@query(
    "vec06_greedy_distinct",
    f"""with recursive u as (select id, label, v, row_number() over (partition by label order by id) as n from {UNITS}),
r as (
  select label, n, [v] as kept, id as kept_id from u where n = 1
  union all
  select u.label, u.n, case when free then list_append(r.kept, u.v) else r.kept end, case when free then u.id end
  from r join u on u.label = r.label and u.n = r.n + 1, lateral (select len(list_filter(r.kept, lambda k: list_inner_product(k, u.v) >= 0.3)) = 0 as free)
)
select label, kept_id as id from r where kept_id is not null""",
)
def vec06(spark, sf_dir):
    return c.greedy_distinct(units(spark, sf_dir), "label", 0.3)


@query("agg14_centroids", "select label, p as place, round(avg(x), 9) as x, count(*) as n from (select label, unnest(v) as x, generate_subscripts(v, 1) as p from " + UNITS + ") group by all")
def agg14(spark, sf_dir):
    got = c.centroids(units(spark, sf_dir), "label", 64).select("label", "n", F.posexplode("centroid").alias("p", "x"))
    return got.select("label", (F.col("p") + 1).cast("long").alias("place"), F.round("x", 9).alias("x"), "n")


@query("agg15_coherence", f"with u as (select * from {UNITS}), m as (select label, list(x order by p) as v from (select label, p, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as p from u) group by all) group by 1) select a.label, round(avg({DOT} / sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 9) as coherence, count(*) as n from u a join m b using (label) group by 1")
def agg15(spark, sf_dir):
    return c.coherence(units(spark, sf_dir), "label", 64).select("label", F.round("coherence", 9).alias("coherence"), "n")


@query("vec07_assign", f"with u as (select * from {UNITS}), m as (select label, list(x order by p) as v from (select label, p, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as p from u) group by all) group by 1), s as (select a.id, b.label as category, round({DOT} / sqrt(list_sum(list_transform(b.v, lambda x: x * x))), 12) as score from u a, m b) select id, category, round(score, 9) as score from (select *, row_number() over (partition by id order by score desc, category) as n from s) where n = 1")
def vec07(spark, sf_dir):
    u = units(spark, sf_dir)
    cats = c.centroids(u, "label", 64).select(F.col("label").alias("category"), F.col("centroid").alias("c"))
    return c.assign(u, cats).select("id", "category", F.round("score", 9).alias("score"))


@query("vec08_sections")
def vec08(spark, sf_dir):
    return c.sections(units(spark, sf_dir), "label").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("section").alias("sections"))
