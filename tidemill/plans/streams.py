"""Streaming queries, replayed over a table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.store import cut_lineage, scratch
from tidemill.streaming import streams as st

from .adapters import messages
from .catalog import query


def drained(spark: SparkSession, build, sf_dir: str, mode: str = "append") -> DataFrame:
    """All rows that a stream over the messages gives, in files."""
    landed = messages(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    at = scratch(spark)
    landed.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/in")
    out = build(st.read_files(spark, f"{at}/in", landed.schema))
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state-{uuid.uuid4().hex}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return cut_lineage(spark.read.schema(out.schema).parquet(f"{at}/out"))


def growing(spark: SparkSession, parts: list[DataFrame], run) -> None:
    """A folder that takes in one part after another, with a run of the stream after each: run(folder, checkpoint, number)."""
    at = scratch(spark)
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{at}/in")
        run(f"{at}/in", f"{at}/state", k).awaitTermination()


@query("str01_stream_ingest", "select event_type as channel, count(*) as n from events where event_type in ('click', 'view') group by 1")
def str01(spark, sf_dir):
    known = spark.createDataFrame([("click", "br"), ("view", "lk")], "channel string, country string")
    return drained(spark, lambda s: st.ingest(s.unionByName(s), known), sf_dir).groupBy("channel").agg(F.count("*").alias("n"))


@query("str03_stream_days", "select date_trunc('day', ts)::timestamp::varchar as day, event_type as channel, count(*) as n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2")
def str03(spark, sf_dir):
    return drained(spark, lambda s: st.daily_counts(s, ["channel"]), sf_dir).select(F.col("day").cast("string").alias("day"), "channel", "n")


@query(
    "str04_stream_sessions",
    """with gaps as (select event_type as channel, ts, ts - lag(ts) over (partition by event_type order by ts) as gap from events),
sessions as (select channel, ts, count(*) filter (where gap is null or gap >= interval 10 minutes) over (partition by channel order by ts rows unbounded preceding) as s from gaps),
ended as (select channel, s, count(*) as n, max(ts) as last_ from sessions group by channel, s)
select channel, count(*) as sessions, sum(n)::bigint as messages from ended where last_ + interval 10 minutes <= (select max(ts) - interval 1 hour from events) group by channel""",
)
def str04(spark, sf_dir):
    return drained(spark, lambda s: st.sessions(s, ["channel"]), sf_dir).groupBy("channel").agg(F.count("*").alias("sessions"), F.sum("n").alias("messages"))


def ladder_sql(quiet: str, at_end: str = "") -> str:
    """The ladder as a fold over each key's requests: quiet says when a request finds a penalty forgiven, and frees the key."""
    return f"""
with recursive ev as (
  select (user_id % 20)::varchar as key, epoch_us(ts) / 1e6 as at_, case event_type when 'error' then 429 when 'purchase' then 200 else 0 end as status, row_number() over (partition by user_id % 20 order by ts, event_id) as i from events
), steps as (
  select distinct key, 0::bigint as i, 0 as level, false as struck, 0::double as until_, null::varchar as verdict, false as forgiven from ev
  union all
  select key, i, case when status = 200 then 0 when status = 429 and not (l0 = 0 and not s0) and l0 < 4 then l0 + 1 else l0 end,
    case when status = 200 then false when status = 429 and l0 = 0 and not s0 then true else s0 end,
    case when status = 200 then 0 when status = 429 and l0 = 0 and not s0 then at_ when status = 429 and l0 < 4 then at_ + ([60, 300, 1800, 6000])[l0 + 1] else u0 end,
    case when status = 429 then case when l0 = 0 and not s0 then 'mark' when l0 >= 4 then 'day_ban' else 'wait' end end, free
  from (
    select key, i, at_, status, free, case when free then 0 else level end as l0, case when free then false else struck end as s0, case when free and {'true' if at_end else 'false'} then 0 else until_ end as u0
    from (select e.key, e.i, e.at_, e.status, s.level, s.struck, s.until_, {quiet} and s.until_ > 0 and e.at_ - s.until_ > ([60, 300, 1800, 6000])[greatest(s.level - 1, 0) + 1] as free from steps s join ev e on e.key = s.key and e.i = s.i + 1)
  )
)
select key, verdict, count(*) as n from (select key, verdict from steps where verdict is not null{at_end}) group by key, verdict
"""


def requests_of(spark, sf_dir):
    m = messages(spark, sf_dir)
    status = F.when(F.col("is_bot"), 429).when(F.col("channel") == "purchase", 200).otherwise(0)
    return m.select((F.col("sender_id") % 20).cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), status.alias("status"), F.col("id").cast("long").alias("id"))


@query("win11_penalties", ladder_sql("e.status = 429"))
def win11(spark, sf_dir):
    return st.penalties(requests_of(spark, sf_dir)).groupBy("key", "verdict").agg(F.count("*").alias("n"))


#: Forgiveness is a row of its own: found by a later request, or by the timer after the last one.
FORGIVING = ladder_sql("true", " union all select key, 'forgiven' from steps where forgiven union all select key, 'forgiven' from (select key, arg_max(until_, i) as last_ from steps group by key) where last_ > 0")


@query("str06_forgiving_batch", FORGIVING)
def str06_batch(spark, sf_dir):
    return st.forgiving_penalties(requests_of(spark, sf_dir)).groupBy("key", "verdict").agg(F.count("*").alias("n"))


@query("str06_forgiving_stream", FORGIVING)
def str06_stream(spark, sf_dir):
    """The requests in four parts by time, each a run of the stream; times far beyond them let the timers fire."""
    rows = requests_of(spark, sf_dir)
    cuts = rows.agg(F.percentile("at", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    edges = [float("-inf"), *cuts, float("inf")]
    parts = [rows.where((F.col("at") > lo) & (F.col("at") <= hi)) for lo, hi in zip(edges, edges[1:])]
    ticks = [spark.createDataFrame([("tick", 4e9 + k, 200, k)], rows.schema) for k in range(2)]
    out, provider = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)

    def run(folder: str, checkpoint: str, k: int):
        made = st.forgiving_stream(st.read_files(spark, folder, rows.schema))
        return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        growing(spark, [*parts, *ticks], run)
    finally:
        spark.conf.set(provider, before)
    got = cut_lineage(spark.read.schema(st.LADDER_OUT).parquet(out))
    return got.groupBy("key", "verdict").agg(F.count("*").alias("n"))
