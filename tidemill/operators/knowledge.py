"""Questions and answers: merging, search, carrying over."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemill.functions import fixed, text


#: Words of questions told to the fold as common, the commonest first; all others are as rare as each other.
COMMON_WORDS = 65_536


class _Stored:
    """The stored rows of one country and category, found by words.

    Words stand in one order, rare ones first. Rows that share `need` words of the smaller set share one of
    the smaller set's first size - need + 1 words, whatever the other words are. So a claim looks up its own first words
    among all words of stored rows (which finds larger ones), and all its words among the first words of stored rows (smaller ones).
    """

    def __init__(self, common: dict[str, int], threshold: float) -> None:
        self.common, self.threshold = common, threshold
        self.rows: list[dict] = []
        self.by_word: dict[str, list[int]] = {}
        self.by_first: dict[str, list[int]] = {}
        self.stamp = 0

    def _need(self, size: int) -> int:
        """The fewest words of a set of this size that reach the threshold."""
        n = max(1, int(self.threshold * size) - 1)
        while n < size and n / size < self.threshold:
            n += 1
        return n

    def _first(self, words: list[str]) -> list[str]:
        return words[: len(words) - self._need(len(words)) + 1] if words else []

    def fold(self, r: dict) -> None:
        words = sorted(r["words"], key=lambda w: (-self.common.get(w, COMMON_WORDS), w))
        mine, first, rows = set(words), self._first(words), self.rows
        near: set[int] = set()
        for w in first:
            near.update(self.by_word.get(w, ()))
        for w in words:
            near.update(self.by_first.get(w, ()))
        best = max(((len(mine & rows[k]["words"]) / min(len(mine), len(rows[k]["words"])), rows[k]["stamp"], k) for k in near), default=None)
        self.stamp += 1
        if best and best[0] >= self.threshold:
            s = rows[best[2]]
            s["tags"].update(r["tags"])
            s["sources"].update(r["source_msgs"])
            s["count"] += int(r["count"])
            s["answer"] = r["answer"] if len(r["answer"]) > len(s["answer"]) else s["answer"]
            s["stamp"] = self.stamp
            return
        for w in words:
            self.by_word.setdefault(w, []).append(len(rows))
        for w in first:
            self.by_first.setdefault(w, []).append(len(rows))
        rows.append({"id": r["id"], "question": r["question"], "words": mine, "answer": r["answer"], "tags": set(r["tags"]), "sources": set(r["source_msgs"]), "count": int(r["count"]), "stamp": self.stamp})


def merge_claims(claims: DataFrame, threshold: float = 0.6) -> DataFrame:
    """JON-08: claims (id, country, category, question, answer, tags, source_msgs, count) folded in id order into stored rows.

    A claim joins the stored row of its country and category whose question shares the most
    words (of the smaller set), at or above the threshold, the newest on ties: counts add,
    tags and sources unite, the longer answer stays. Else it is stored anew. Blank
    questions or answers are not stored. The fold depends on order, so a country's category
    is one task, which reads its claims in order and holds what is stored. A claim meets the stored rows
    that share a rare word with it (`_Stored`), not all that share some word.
    """
    words = text.word_set(F.col("question"))
    rows = claims.where("trim(question) <> '' and trim(answer) <> ''").withColumn("words", words)
    counted = rows.select(F.explode("words").alias("w")).groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(COMMON_WORDS)
    common = {r["w"]: k for k, r in enumerate(counted.select("w").collect())}
    kinds = dict(claims.dtypes)
    schema = f"id {kinds['id']}, country string, category string, question string, answer string, tags array<string>, source_msgs array<{kinds['source_msgs'].removeprefix('array<').removesuffix('>')}>, count long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(stored.rows), 10_000):
                out = [{**s, "country": key[0], "category": key[1], "tags": sorted(s["tags"]), "source_msgs": sorted(s["sources"])} for s in stored.rows[at : at + 10_000]]
                yield pa.RecordBatch.from_pylist([{c: s[c] for c in arrow.names} for s in out], arrow)

        key, stored = None, _Stored(common, threshold)
        for batch in batches:
            for r in batch.to_pylist():
                if (r["country"], r["category"]) != key:
                    yield from told()
                    key, stored = (r["country"], r["category"]), _Stored(common, threshold)
                stored.fold(r)
        yield from told()

    from tidemill.functions.values import stored_confidence

    # A number of partitions: without one, small partitions are put together, and several categories into one task.
    each = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(each, "country", "category").sortWithinPartitions("country", "category", "id")
    return dealt.mapInArrow(fold, schema).withColumn("confidence", stored_confidence(F.col("count")))


def search(entries: DataFrame, query_lemmas: Sequence[str], limit: int) -> DataFrame:
    """TOP-01, TOP-02: entries (id, question, tags, lemmas, confidence) by score, best first, ids on ties.

    Score: 2 for each query word found in the question or the tags, and the hits per ten words of the
    entry, by the weight of its confidence; entries without a hit are out.
    """
    q = F.array(*[F.lit(w) for w in dict.fromkeys(query_lemmas)])
    hits = F.size(F.array_intersect("lemmas", q))
    where = F.lower(F.concat_ws("\n", F.col("question"), F.to_json("tags")))
    bonus = sum((F.when(where.contains(w), 1).otherwise(0) for w in dict.fromkeys(query_lemmas)), F.lit(0))
    weight = F.create_map(*[F.lit(x) for kv in fixed.CONFIDENCE_WEIGHT.items() for x in kv])[F.col("confidence")]
    density = hits / (F.greatest(F.size("lemmas"), F.lit(1)) / 10)
    score = (bonus * 2.0 + density) * F.coalesce(weight, F.lit(1.0))
    return entries.where(hits > 0).withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "id").limit(limit)


def by_confidence(entries: DataFrame, limit: int) -> DataFrame:
    """TOP-03: by the name of the confidence, descending (medium, low, high), then newest."""
    return entries.orderBy(F.desc("confidence"), F.desc("last_updated"), "id").limit(limit)


def context(docs: DataFrame, order: Sequence[Column], *fields: str) -> DataFrame:
    """TXT-18, TXT-34: one numbered text of the first non-blank field of each row, in order; blank rows are skipped. For a prompt's few dozen rows."""
    body = F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields])
    rows = docs.withColumn("body", body).where("body is not null").withColumn("n", F.row_number().over(Window.orderBy(*order)))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda r: F.concat(r["n"].cast("string"), F.lit(". "), r["body"])), "\n").alias("context"))


def carry_translations(new: DataFrame, old: DataFrame) -> DataFrame:
    """JON-13: new (id, text) with the translation of old (id, src_hash, translation) where the source is unchanged; a missing hash is accepted."""
    return new.join(old, "id", "left").select("id", "text", F.when(F.col("src_hash").isNull() | (F.col("src_hash") == F.substring(F.sha1(F.col("text").cast("binary")), 1, 8)), F.col("translation")).alias("translation"))


def bind_nodes(new: DataFrame, old: DataFrame) -> DataFrame:
    """JON-11: (new_key, old_key): nodes (key, src, ids) bound by src, else to the one old node whose ids are all in the new one's; each old node once."""
    exact = new.alias("n").join(old.alias("o"), "src").select(F.col("n.key").alias("new_key"), F.col("o.key").alias("old_key"))
    rest_new = new.join(exact, new["key"] == exact["new_key"], "left_anti").select("key", F.explode("ids").alias("id"))
    rest_old = old.join(exact, old["key"] == exact["old_key"], "left_anti").select(F.col("key").alias("old_key"), F.size("ids").alias("size"), F.explode("ids").alias("id"))
    shared = rest_new.join(rest_old, "id").groupBy("key", "old_key", "size").agg(F.count_distinct("id").alias("n")).where("n = size")
    only = shared.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c = 1")
    once = only.withColumn("r", F.row_number().over(Window.partitionBy("old_key").orderBy("key"))).where("r = 1")
    return exact.unionByName(once.select(F.col("key").alias("new_key"), "old_key"))


def carry_forward(new: DataFrame, old: DataFrame, least: float = 0.7) -> DataFrame:
    """JON-12: (new_key, old_key, coverage): pages (key, ids) matched by the share of the old page's ids that the new one has.

    Equal id sets first, then best coverage at or above `least`; each key once. Rounds of mutual
    best matches give what taking matches from the best down would; ties go to smaller keys.
    """
    n = new.select(F.col("key").alias("new_key"), F.size("ids").alias("ns"), F.explode("ids").alias("id"))
    o = old.select(F.col("key").alias("old_key"), F.size("ids").alias("os"), F.explode("ids").alias("id"))
    pairs = n.join(o, "id").groupBy("new_key", "old_key", "ns", "os").agg(F.count_distinct("id").alias("both"))
    pairs = pairs.withColumn("coverage", F.col("both") / F.col("os")).withColumn("same", (F.col("both") == F.col("os")) & (F.col("both") == F.col("ns"))).where(F.col("same") | (F.col("coverage") >= least))
    from tidemill.sources.store import cut_lineage

    left, out = cut_lineage(pairs), None
    rank = [F.desc("same"), F.desc("coverage"), F.asc("new_key"), F.asc("old_key")]
    while left.limit(1).count():
        by = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(*rank))
        best = cut_lineage(left.withColumn("rn", by("new_key")).withColumn("ro", by("old_key")).where("rn = 1 and ro = 1").select("new_key", "old_key", "coverage"))
        out = best if out is None else out.unionByName(best)
        left = cut_lineage(left.join(best.select("new_key"), "new_key", "left_anti").join(best.select("old_key"), "old_key", "left_anti"))
    return out if out is not None else left.select("new_key", "old_key", "coverage")
