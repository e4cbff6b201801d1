"""One query per operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, curves, epsilon, ledger, lines, merkle, mixing, packing, phrases, quality, sharding, simhash, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of those labelled as good."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one that quotes the template's own control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    quoted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(quoted)))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.train_and_score(docs, labels)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt into 24 shards in random order: shard counts differ by one at most."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all rules under the latest policy."""
    rows = ledger.apply_policy(ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")
    base = F.col("failed").bitwiseAND(F.lit(ledger.mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and roots of all documents, and each proof tried on a tampered fifth."""
    docs = table(spark, sf_dir, "documents")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    leaf = lambda text: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    proved = merkle.manifest(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), leaf(tampered).alias("tampered")))
    folded = proved.withColumn("folded_root", merkle.fold(F.col("tampered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it stands beside the package, and imports it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_chat_format": op2_chat_format,
    "op3_neighbours": op3_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_shards": op8_shards,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_quality_rules": op11_quality_rules,
    "op12_phrases": op12_phrases,
    "op13_manifest": op13_manifest,
    "pipeline": pipeline,
}

#: DuckDB's statements of the same results, by other means than the operators'.
ORACLES: dict[str, str] = {
    "op2_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), said as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as spoken,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as trained,
    sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|>') + length('<|im_end|>') + 2) as formatted
  from turns group by conv_id
)
select conv_id, n_turns, sha256(spoken) as turns_sha256, length(trained)::bigint as loss_chars, sha256(trained) as loss_sha256, formatted::bigint as formatted_chars from said
""",
    "op7_line_dedup": r"""
with split as (
  select doc_id, text, case when text is null then [] else string_split(text, chr(10)) end as parts from documents
), each as (
  select doc_id, i - 1 as line_no, parts[i] as line, list_filter(string_split(regexp_replace(lower(parts[i]), '[\t\r\x0b\x0c]', ' ', 'g'), ' '), lambda x: x <> '') as words
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from split)
), placed as (
  select *, len(words) as n_words, row_number() over (order by doc_id, line_no) as place from each where len(words) > 0
), firsts as (
  select words, n_words, min(place) as place from placed group by words, n_words
), tokened as (
  select words, place, n_words, n_words >= 8 as by_words, case when n_words >= 8 then words else string_split(array_to_string(words, ' '), '') end as tokens
  from firsts where n_words >= 8 or length(array_to_string(words, ' ')) >= 16
  union all
  select words, place, n_words, true, words from firsts where n_words = 7
), sized as (
  select *, len(tokens) as n from tokened
), prefixed as (
  select place, tokens, n, n_words, by_words, m, unnest([['s', array_to_string(tokens[1:m // 2], '|')], ['e', array_to_string(tokens[n - m // 2 + 1:n], '|')]]) as side
  from (select *, unnest([n, n + 1]) as m from sized)
), pairs as (
  select distinct a.place as place, a.tokens as tokens, a.n as n, b.tokens as of, b.n as k
  from prefixed a join prefixed b on a.m = b.m and a.side = b.side and a.by_words = b.by_words and b.place < a.place and (not a.by_words or greatest(a.n_words, b.n_words) >= 8) and abs(a.n - b.n) <= 1 and greatest(a.n, b.n) = a.m
), near as (
  select distinct place from pairs where
    len(list_filter(range(1, least(n, k) + 1), lambda i: tokens[1:i] = of[1:i])) + len(list_filter(range(1, least(n, k) + 1), lambda i: tokens[n - i + 1:n] = of[k - i + 1:k])) >= greatest(n, k) - 1
), removed as (
  select p.doc_id, p.line_no from placed p join firsts f on p.words = f.words where p.place > f.place or f.place in (select place from near)
), kept as (
  select e.doc_id, count(r.line_no) as n_removed, string_agg(e.line, chr(10) order by e.line_no) filter (where r.line_no is null) as text
  from each e left join removed r on e.doc_id = r.doc_id and e.line_no = r.line_no group by e.doc_id
)
select s.doc_id, len(s.parts)::int as n_lines, coalesce(k.n_removed, 0)::int as n_removed, case when s.text is null then null else coalesce(k.text, '') end as text
from split s left join kept k on s.doc_id = k.doc_id
""",
    "op10_mixing": r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h from documents
), weighed as (
  select source, sum(size)::bigint as source_size, 2.0::double * sum(size) as cap, ([5.0, 2.0, 1.0])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
  from sized group by source
), levels as (
  select w.*, cap / weight as ratio, 1.5::double * sum(source_size) over () as budget,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_left
  from weighed w
), fixed as (
  select min_by((budget - cap_before) / weight_left, ratio) as level from levels where (budget - cap_before) / weight_left <= ratio
), targets as (
  select source, source_size, coalesce(least(cap, level * weight), cap) as target from levels, fixed
), wants as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as base from targets
), runs as (
  select s.*, w.source_size, w.target, w.base, w.target - w.base * w.source_size as rem,
    sum(s.size) over (partition by s.source order by s.h) as through, sum(s.size) over (partition by s.source, s.h) as here
  from sized s join wants w on s.source is not distinct from w.source
), chosen as (
  select *, max(case when through <= rem then through end) over (partition by source) as under, min(case when through > rem then through end) over (partition by source) as over_ from runs
), final as (
  select *, case when rem > 0 and coalesce(over_ - rem < rem - coalesce(under, 0), false) then over_ else coalesce(under, 0) end as upto from chosen
)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies::bigint as copies
from (select *, base + (case when rem > 0 and through <= upto and size >= 0 then 1 else 0 end) as copies from final)
""",
    "op11_quality_rules": r"""
with docs as (
  select doc_id, row_number() over () as r, coalesce(text, '') as text from documents
), parts as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs
), windows as (
  select r, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select r, words, unnest(range(1, len(words) - 1)) as i from parts)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from windows) where n > 1
), covered as (
  select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by r
), measured as (
  select p.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    len(regexp_extract_all(text, '[A-Z]'))::bigint as n_capitals, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from parts p left join covered c on p.r = c.r
), judged as (
  select *, (case when n_words < 50 then 1 else 0 end) | (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end) | (case when 10 * n_symbols > n_words then 4 else 0 end)
    | (case when n_lines >= 5 and 10 * n_dup_lines > 4 * n_lines then 8 else 0 end) | (case when n_words > 0 and (word_chars / n_words < 2.5 or word_chars / n_words > 12) then 16 else 0 end)
    | (case when 10 * n_capitals > 4 * word_chars then 32 else 0 end) as failed
  from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept, failed::bigint as failed from judged
""",
    "op12_phrases": r"""
with split as (
  select row_number() over () as r, coalesce(lang, 'und') as lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as parts from documents
), worded as (
  select lang, regexp_extract_all(part, '[^\x20\x09]+') as words from (select lang, unnest(parts) as part from split)
), totals as (
  select lang, sum(len(words))::bigint as n from worded group by lang
), grams as (
  select lang, m, array_to_string(words[i:i + m - 1], ' ') as phrase
  from (select lang, words, m, unnest(range(1, len(words) - m + 2)) as i from worded, (select unnest([1, 2, 3, 4]) as m))
), counts as (
  select lang, m, phrase, count(*) as f from grams group by lang, m, phrase having count(*) >= 30
), cands as (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as words from counts where m >= 2
), longer as (
  select s.lang, s.phrase, max(l.a) as top from cands s join cands l on s.lang = l.lang and l.m > s.m and contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' ') group by s.lang, s.phrase
), cuts as (
  select c.lang, c.phrase, c.a, k, array_to_string(words[1:k], ' ') as head, array_to_string(words[k + 1:m], ' ') as tail
  from (select *, unnest(range(1, m)) as k from cands) c left join longer g on c.lang = g.lang and c.phrase = g.phrase where g.top is null or 100 * g.top < 80 * c.a
), scored as (
  select c.*, l.f as l, r.f as r, (2000000::hugeint * c.a) // (l.f::hugeint + r.f) as score
  from cuts c join counts l on c.lang = l.lang and c.head = l.phrase join counts r on c.lang = r.lang and c.tail = r.phrase
), best as (
  select *, row_number() over (partition by lang, phrase order by score, k) as place from scored
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best where place = 1
)
select lang, rank, phrase, a, l, r, t.n, score::bigint as score from ranked join totals t using (lang) where rank <= 2000
""",
    "op13_manifest": r"""
with recursive docs as (
  select *, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) as crc_ from documents
), hashed as (
  select doc_id, source, sha256(e0 || e1 || e2 || e3 || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf, sha256(e0 || e1 || e2 || e3 || coalesce(strlen(low)::varchar || ':' || low, '-')) as tampered
  from (select *, coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') as e0, coalesce(strlen(source)::varchar || ':' || source, '-') as e1,
      coalesce(strlen(lang)::varchar || ':' || lang, '-') as e2, coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') as e3,
      case when xor(crc_, 4294967295) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as low from docs)
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as total from hashed
), up as (
  select 0 as level, source, pos, total, leaf as node from leaves
  union all
  select level + 1, source, pos // 16, (max(total) + 15) // 16, sha256(string_agg(node, '' order by pos)) from up where total > 1 group by level, source, pos // 16
), subroots as (
  select source, node as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as total from up where total = 1
), top as (
  select 0 as level, pos, total, subroot as node from subroots
  union all
  select level + 1, pos // 16, (max(total) + 15) // 16, sha256(string_agg(node, '' order by pos)) from top where total > 1 group by level, pos // 16
), root as (
  select node as root from top where total = 1
), runs as (
  select a.source, a.level, a.pos, coalesce(string_agg(b.node, '' order by b.pos) filter (where b.pos < a.pos), '') as left_, coalesce(string_agg(b.node, '' order by b.pos) filter (where b.pos > a.pos), '') as right_
  from up a join up b on a.source is not distinct from b.source and a.level = b.level and a.pos // 16 = b.pos // 16 where a.total > 1 group by a.source, a.level, a.pos
), topruns as (
  select a.level, a.pos, coalesce(string_agg(b.node, '' order by b.pos) filter (where b.pos < a.pos), '') as left_, coalesce(string_agg(b.node, '' order by b.pos) filter (where b.pos > a.pos), '') as right_
  from top a join top b on a.level = b.level and a.pos // 16 = b.pos // 16 where a.total > 1 group by a.level, a.pos
), steps as (
  select l.source, l.pos, r.level as step, r.left_, r.right_ from leaves l join runs r on l.source is not distinct from r.source and r.pos = l.pos // (16 ** r.level)::bigint
  union all
  select l.source, l.pos, 100 + t.level, t.left_, t.right_ from leaves l join subroots s on l.source is not distinct from s.source join topruns t on t.pos = s.pos // (16 ** t.level)::bigint
), numbered as (
  select *, row_number() over (partition by source, pos order by step) as n from steps
), fold as (
  select source, pos, 0 as n, tampered as node from leaves
  union all
  select f.source, f.pos, f.n + 1, sha256(m.left_ || f.node || m.right_) from fold f join numbered m on f.source is not distinct from m.source and f.pos = m.pos and m.n = f.n + 1
), folded as (
  select source, pos, max_by(node, n) as folded_root from fold group by source, pos
), proofs as (
  select source, pos, string_agg(left_ || right_, '' order by n) as said from numbered group by source, pos
)
select l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.said, '')) as proof_sha256, f.folded_root, f.folded_root = r.root as verified
from leaves l join subroots s on l.source is not distinct from s.source cross join root r join folded f on l.source is not distinct from f.source and l.pos = f.pos left join proofs p on l.source is not distinct from p.source and l.pos = p.pos
""",
}
