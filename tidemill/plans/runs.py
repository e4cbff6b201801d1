"""Work in several runs that leave state: tagging, the pump, and streams that are stopped and started again."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import tagging
from tidemill.sources.store import cut_lineage, scratch
from tidemill.streaming import pump as pumping
from tidemill.streaming import streams as st

from .adapters import messages, table
from .catalog import query
from .streams import growing

#: What fails in a run of the tagger, by id: some never succeed, some from a later run on; in run 1 all do.
FAILS = "id % 13 = 0 or (id % 17 = 0 and {run} < 3) or (id % 19 = 0 and {run} < 4) or {run} = 1"
LABELS = "array(substr(lower(text), 1, 4), case when id % 3 = 0 then concat('  ', source) else '' end)"


def tagged_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, list[tagging.Report]]:
    rows, state = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "lang as shelf", "text", "source"), scratch(spark)
    tag = lambda todo, run: todo.selectExpr("id", f"case when {FAILS.format(run=run)} then null else {LABELS} end as labels")
    some = rows.count() * 2 // 5
    return rows, state, [tagging.tag_run(rows, partial(tag, run=k), state, k, limit) for k, limit in enumerate((some, some // 2, None, None, None))]


RUNS = """
with numbered as (
  select doc_id as id, lang as shelf, [substr(lower(text), 1, 4), case when doc_id % 3 = 0 then source else '' end] as labels, row_number() over (order by doc_id) <= count(*) over () * 2 // 5 as first_,
    doc_id % 13 = 0 as f13, doc_id % 13 = 0 or doc_id % 19 = 0 as f19, doc_id % 13 = 0 or doc_id % 19 = 0 or doc_id % 17 = 0 as any_ from documents
), folded as (
  select *, (first_ and any_)::int + any_::int as two, (first_ and any_)::int + any_::int + f19::int as three from numbered
), stated as (
  select *, three + (f13 and three < 3)::int as failures, case when not any_ then case when first_ then 0 else 2 end when not f19 then 3 when not f13 and three < 3 then 4 end as run from folded
)"""


@query("vec20_tag_runs", f"{RUNS} select id, run, failures, failures >= 3 and run is null as dead from stated")
def vec20(spark, sf_dir):
    rows, state, reports = tagged_documents(spark, sf_dir)
    if [r.stopped for r in reports] != [False, True, False, False, False] or reports[-1].remaining:
        raise AssertionError(f"the runs went otherwise: {reports}")
    return tagging.tag_state(rows, state, len(reports)).select("id", "run", "failures", "dead")


@query(
    "vec20_views",
    f"""{RUNS}, each as (
  select distinct id, shelf, trim(unnest(labels)) as name from stated where run is not null
), mass as (
  select shelf, name, count(*) as n from each where name <> '' group by shelf, name
), paged as (
  select e.id, e.shelf, 'page' as kind, e.name from each e join mass m on e.shelf = m.shelf and e.name = m.name where m.n >= 4
), tail as (
  select id, shelf, case when labels[1] < 'n' then 'early' when labels[1] < 'u' then 'late' end as home from stated where run is not null and id not in (select id from paged) and id % 29 <> 0
)
select * from paged union all select id, shelf, case when home is null then 'other' else 'shelf' end, coalesce(home, 'other') from tail""",
)
def vec20_views(spark, sf_dir):
    rows, state, reports = tagged_documents(spark, sf_dir)
    done = tagging.tag_state(rows, state, len(reports)).where("labels is not null").join(rows.select("id", "shelf"), "id").select("id", "shelf", "labels")
    home = F.when(F.col("labels")[0] < "n", "early").when(F.col("labels")[0] < "u", "late")
    return tagging.views(done, done.where("id % 29 = 0"), home)


@query("agg12_label_mass", f"{RUNS} select shelf, name as label, count(*) as n from (select distinct id, shelf, trim(unnest(labels)) as name from stated where run is not null) where name <> '' group by shelf, name")
def agg12(spark, sf_dir):
    rows, state, reports = tagged_documents(spark, sf_dir)
    done = tagging.tag_state(rows, state, len(reports)).where("labels is not null").join(rows.select("id", "shelf"), "id")
    return tagging.label_mass(done)


@query(
    "str09_pump",
    """
with recursive rows_ as (
  select doc_id as id, doc_id % 50 = 0 or trim(text) = '' as blank, doc_id % 10 = 9 as junk, least(3, doc_id * 4 // (max(doc_id) over () + 1)) as a, count(*) over () * 35 // 100 as quota from documents
), steps as (
  select -1 as b, id, a, blank, junk, quota, 0 as failures, 'waiting' as status, a as batch, 0::bigint as used from rows_
  union all
  select b, id, a, blank, junk, quota, case when hurt then failures + 1 else failures end,
    case when taken and junk then 'skipped' when tried and not hurt then 'embedded' when hurt and failures + 1 >= 5 then 'dropped' else status end,
    case when (taken and junk) or (tried and not hurt) or (hurt and failures + 1 >= 5) then b else batch end, used + count(*) filter (tried) over ()
  from (
    select *, tried and (id % 7 = 3 or (id % 11 = 5 and failures < 2)) or taken and blank and not junk as hurt from (
      select *, taken and not blank and not junk and count(*) filter (taken and not blank and not junk) over (order by a, id) <= quota - used as tried
      from (select b + 1 as b, id, a, blank, junk, quota, failures, status, batch, case when b = 2 then 0 else used end as used, status = 'waiting' and a <= b + 1 as taken from steps where b < 5)
    )
  )
)
select id, status, failures, batch from steps where b = 5
""",
)
def str09(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("text")).alias("text"))
    n, last = rows.agg(F.count("*"), F.max("id")).first()
    part = F.least(F.lit(3), F.floor(F.col("id") * 4 / (last + 1)))
    tick = spark.createDataFrame([(None, None)], rows.schema)
    state = scratch(spark)

    def embed(due: DataFrame) -> DataFrame:
        fails = (F.col("id") % 7 == 3) | ((F.col("id") % 11 == 5) & (F.col("failures") < 2))
        return due.withColumn("v", F.when(~fails, F.array(F.length("text").cast("double"))))

    def run(folder: str, checkpoint: str, k: int):
        handle = pumping.pump(embed, state, "first" if k < 3 else "second", n * 35 // 100, junk=lambda todo: todo.where("id % 10 = 9"))
        return st.each_batch(st.read_files(spark, folder, rows.schema), handle, checkpoint)

    growing(spark, [*(rows.where(part == k) for k in range(4)), tick, tick], run)
    return pumping.pumped(spark, state, rows.schema["id"].dataType.simpleString(), 6)


def in_two_runs(spark: SparkSession, sf_dir: str, build, files: int = 2) -> DataFrame:
    """All rows of a stream over messages in append mode: half of them, then, from the checkpoint, the rest; rows at the end of time close the windows."""
    rows = messages(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.range(1).select(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in (("id", "end"), ("channel", "end"), ("ts", "2100-01-01 00:00:00"), ("text", ""), ("sender_id", 0), ("is_bot", False), ("country", None))])
    out, schema = scratch(spark), []

    def run(folder: str, checkpoint: str, k: int):
        made = build(st.read_files(spark, folder, rows.schema, files))
        schema[:] = [made.schema]
        return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    early = F.col("ts") < "2024-01-12"
    growing(spark, [rows.where(early).repartition(3), rows.where(~early).repartition(3), end, end], run)
    return cut_lineage(spark.read.schema(schema[0]).parquet(out))


#: No row is late; the end of time is later still.
DELAY = "3000 days"


@query(
    "str02_sliding_windows",
    "select (time_bucket(interval 6 hours, ts, timestamp '2000-01-01') - to_hours(6 * k::int))::varchar as start, event_type as channel, count(*) as n from events, (select unnest([0, 1, 2, 3]) as k) group by all",
)
def str02(spark, sf_dir):
    got = in_two_runs(spark, sf_dir, lambda s: st.sliding_counts(s, ["channel"], "24 hours", "6 hours", DELAY))
    return got.where("channel <> 'end'").select(F.col("start").cast("string").alias("start"), "channel", "n")


@query(
    "str05_failure_windows",
    "select (time_bucket(interval 30 minutes, ts, timestamp '2000-01-01') - to_minutes(30 * k::int))::varchar as start, count(*) as failures from events, (select unnest([0, 1]) as k) where event_type = 'error' group by all having count(*) >= 2",
)
def str05(spark, sf_dir):
    got = in_two_runs(spark, sf_dir, lambda s: st.sliding_counts(s.where("is_bot or channel = 'end'"), ["is_bot"], "1 hour", "30 minutes", DELAY))
    return got.where("is_bot and n >= 2").select(F.col("start").cast("string").alias("start"), F.col("n").alias("failures"))


@query("str07_resumed_offsets", "select event_type as channel, count(*) as n, count(distinct event_id) as ids from events group by 1")
def str07(spark, sf_dir):
    got = in_two_runs(spark, sf_dir, lambda s: s.where("channel <> 'end'").select("id", "channel"), files=1)
    return got.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
