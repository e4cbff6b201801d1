"""Sessions, reply chains, spans, packing and streams."""

from __future__ import annotations

import pyspark.sql.functions as F

from tidemill.functions import fixed
from tidemill.operators import messages as m
from tidemill.operators import sequences as s
from tidemill.operators import threads as t

from .adapters import MESSAGES, TURNS, messages, table, turns
from .catalog import query


@query("win01_gap_sessions", f"select channel, session, count(*) as n, min(id) as first_id from (select channel, id, sum(new) over (partition by channel order by ts, id) as session from (select *, case when ts - lag(ts) over (partition by channel order by ts, id) <= interval 10 minutes then 0 else 1 end as new from {MESSAGES})) group by all")
def win01(spark, sf_dir):
    return t.gap_sessions(messages(spark, sf_dir), ["channel"], 10).groupBy("channel", "session").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("win02_reply_roots", f"with recursive up as (select id, id as root from {TURNS} where reply_to is null union all select c.id, up.root from {TURNS} c join up on c.reply_to = up.id) select id, root from up")
def win02(spark, sf_dir):
    return t.reply_roots(turns(spark, sf_dir).select("id", "reply_to", "ts")).select("id", "root")


@query("win03_forward_chains", f"with recursive e as (select id, case when turn % 3 <> 2 then reply_to end as reply_to from {TURNS}), up as (select id, id as root from e where reply_to is null union all select c.id, up.root from e c join up on c.reply_to = up.id) select root, count(*) as n from up group by 1")
def win03(spark, sf_dir):
    x = turns(spark, sf_dir)
    # Every third turn is dated before the one it answers, and so begins a chain.
    x = x.withColumn("ts", F.when(F.col("turn") % 3 == 2, F.col("ts") - F.expr("INTERVAL 90 SECONDS")).otherwise(F.col("ts")))
    return t.reply_roots(x.select("id", "reply_to", "ts"), forward_only=True).groupBy("root").agg(F.count("*").alias("n"))


def chains(spark, sf_dir):
    rooted = t.reply_roots(turns(spark, sf_dir).select("id", "reply_to", "ts", "text"), forward_only=True)
    low = F.lower("text")
    return t.spans(rooted, useful=low.contains("wh") | low.contains("ch"), question=low.contains("is"), noise=low.rlike(r"^\w+\.$"))


#: Spans by recursion over each chain's messages, as SQL: what is open, how much of it was useful, and how long nothing was.
SPANS = f"""with recursive up as (select id, id as root from {TURNS} where reply_to is null union all select c.id, up.root from {TURNS} c join up on c.reply_to = up.id),
 m as (select t.id, root, row_number() over (partition by root order by said, t.id) as n, contains(lower(text), 'wh') or contains(lower(text), 'ch') as useful, contains(lower(text), 'is') as asks, regexp_matches(lower(text), '^\\w+\\.$') as dull from up join {TURNS} t on t.id = up.id),
 f as (select root, n, id, useful, 0 as span, 0 as good, 0 as idle, true as inside, false as closed from m where n = 1
  union all select root, n, id, useful, span + (split or over_)::int, case when split or over_ then 0 else good + useful::int end, case when useful or split or over_ then 0 else idle + 1 end, not over_, split or over_ from
   (select m.root, m.n, m.id, m.useful, f.span, f.good, f.idle, not m.useful and not m.dull and m.asks and f.good > 0 as split,
     not m.useful and not (not m.dull and m.asks and f.good > 0) and f.idle + 1 >= 2 and f.good > 0 as over_ from f join m on m.root = f.root and m.n = f.n + 1)),
 s as (select root, span, count(*) filter (where inside and n > 1) as n, count(*) filter (where useful and n > 1) as useful, bool_or(closed and inside) as asked from f group by all having count(*) filter (where useful and n > 1) > 0)
"""


@query("win04_spans", SPANS + "select root, span, n + (not asked)::int as n, useful + (not asked and (select useful from m where m.root = s.root and m.n = 1))::int as useful from s")
def win04(spark, sf_dir):
    return chains(spark, sf_dir).groupBy("root", "span").agg(F.count("*").alias("n"), F.count_if("useful").alias("useful"))


#: Claims from the spans' messages, in order; a span that no question began opens with the chain's first message.
CLAIMS = SPANS + f""", told as (
  select f.root, f.span, f.n, f.id from f join s on f.root = s.root and f.span = s.span where f.inside and f.n > 1
  union all select s.root, s.span, 0, m.id from s join m on m.root = s.root and m.n = 1 where not s.asked
), spoken as (
  select told.root, told.span, list({{'text': t.text, 'useful': m.useful, 'asks': m.asks}} order by told.n) as ms from told join m on m.id = told.id join {TURNS} t on t.id = told.id group by all
), answered as (
  select root, span, ms[1].asks as asks, len(ms)::int as chain_size, array_to_string(list_transform(ms, lambda x: x.text), ' ') as whole, list_transform(list_filter(ms[2:], lambda x: x.useful), lambda x: x.text) as answers from spoken
), claimed as (
  select *, 'qa' as claim_type, array_to_string(answers[1:2], ' ') as answer from answered where asks
  union all select *, 'fact', unnest(answers[1:3]) from answered
)
select root, span, claim_type, length(answer)::int as answer_chars, case {" ".join(f"when regexp_matches(whole, '(?i){p}') then '{c}'" for _, c, p in fixed.SUBJECTS)} else '{fixed.OTHER_CATEGORY}' end as category, chain_size from claimed
"""


@query("win05_claims", CLAIMS)
def win05(spark, sf_dir):
    return t.claims(chains(spark, sf_dir)).select("root", "span", "claim_type", F.length("answer").alias("answer_chars"), "category", "chain_size")


@query("jon18_reply_history", f"select a.id, b.text as answer, c.text as question from {TURNS} a join {TURNS} b on a.reply_to = b.id join {TURNS} c on b.reply_to = c.id")
def jon18(spark, sf_dir):
    return t.reply_history(turns(spark, sf_dir))


@query("agg13_artifact_counts", f"select count(*) as messages, count(*) filter (where reply_to is null) as chains from {TURNS}")
def agg13(spark, sf_dir):
    r = t.reply_roots(turns(spark, sf_dir).select("id", "reply_to", "ts"))
    return r.agg(F.count("*").alias("messages"), F.count_if(F.col("id") == F.col("root")).alias("chains"))


@query("txt04_line_chunks")
def txt04(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return s.split_rows(d, "doc_id", "text", lambda x: s.line_chunks(x, 4000)).select("id", "piece", "pieces", F.length("text").alias("n"))


@query("txt11_overlapping_pieces")
def txt11(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return s.split_rows(d, "doc_id", "text", lambda x: s.overlapping_pieces(x, 1500)).select("id", "piece", "pieces", F.length("text").alias("n"))


@query("txt12_pack_budget", "with recursive r as (select source, doc_id, length(text) as size, row_number() over (partition by source order by doc_id) as n from documents), f as (select source, doc_id, n, size as total, 0 as part, 1 as k from r where n = 1 union all select r.source, r.doc_id, r.n, case when f.total + r.size > 8000 or f.k >= 5 or f.total > 8000 then r.size else f.total + r.size end, case when f.total + r.size > 8000 or f.k >= 5 or f.total > 8000 then f.part + 1 else f.part end, case when f.total + r.size > 8000 or f.k >= 5 or f.total > 8000 then 1 else f.k + 1 end from f join r on r.source = f.source and r.n = f.n + 1) select doc_id, part from f")
def txt12(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("size"))
    return s.pack(d, "source", ["doc_id"], "size", 8000, 5).select("doc_id", "part")


@query("flt12_questions", "select conv_id, turn, regexp_matches(text, '(?i)\\bis\\b') as asks from conversations")
def flt12(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", m.is_question(F.col("text"), r"(?<![\p{L}\p{N}_])is(?![\p{L}\p{N}_])").alias("asks"))
