"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized, word_count

#: A hash has 60 bits; each pass over the histogram settles 10 of them.
HASH_BITS = 60
STEP_BITS = 10
HISTOGRAM_PASSES = 3
#: Rows tied at a threshold that are numbered together in one task.
TIED_ROWS = 20_000


def mix_hash(id_col: Column, text_col: Column, seed: int) -> Column:
    """60 uniform bits that depend on the seed, the id and the text alone."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """Targets per source: (source, source_size, target).

    Sources in code point order, null last, take the weights in turn. A source's
    target is at most max_repeat times its size; what is cut off goes to the
    others by weight until none is above. That fixed point is
    ``min(cap, level * weight)`` for one level: sources fill up in order of
    cap / weight, so running sums over the table of sources (one row each)
    give the level directly.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    ranked = (
        totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    )
    # The first source in this order that the level does not fill fixes it for all that follow.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"]
    return ranked.withColumn("fixed", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("fixed") * F.col("weight")), F.col("cap")).alias("target")
    )


def _boundary(rows: DataFrame, open_: DataFrame, shift: int) -> DataFrame:
    """One refinement: which bucket of the given width holds each source's threshold.

    open_ has (source, rem, below, low): words below hash `low` are taken, and the
    threshold lies in the bucket that starts at `low`. A source's histogram has
    2**STEP_BITS buckets at most, summed before the shuffle.
    """
    width = shift + STEP_BITS
    inside = rows.join(open_, rows["source"].eqNullSafe(open_["source"]) & (F.shiftright(rows["h"], width) == F.shiftright(open_["low"], width))).select(
        open_["source"], "rem", "below", "size", F.shiftleft(F.shiftright("h", shift), shift).alias("low")
    )
    hist = inside.groupBy("source", "low").agg(F.first("rem").alias("rem"), F.first("below").alias("below"), F.sum("size").alias("s"))
    run = Window.partitionBy("source").orderBy("low")
    hist = hist.withColumn("through", F.col("below") + F.sum("s").over(run)).withColumn("before", F.col("through") - F.col("s"))
    # The first bucket that passes the budget; if rounding leaves none, the last.
    return (
        hist.groupBy("source")
        .agg(F.coalesce(F.min(F.when(F.col("through") > F.col("rem"), F.struct("low", "before", "rem"))), F.max(F.struct("low", "before", "rem"))).alias("b"))
        .select("source", F.col("b.rem").alias("rem"), F.col("b.before").alias("below"), F.col("b.low").alias("low"))
    )


def mix_plan(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, max_repeat: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): doc_id, source, size and h of each document; and one row per source.

    A source takes each document `base` times, and once more those whose hash is at most
    `threshold`, and `some` of the `tied` rows whose hash is `edge` (rows that are equal in id
    and text share a hash, and may hold much of a source). plan has t_source,
    source_size, target and these.
    """
    text = F.col(text_col)
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), mix_hash(F.col(id_col), text, seed).alias("h")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = materialize(targets.withColumn("base", F.floor(ratio).cast("long")).withColumn("rem", F.col("target") - F.col("base") * F.col("source_size")))
    words = rows.where("size > 0").select("source", "size", "h")
    bound = targets.where("rem > 0").select("source", "rem", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("low"))
    shift = HASH_BITS
    for _ in range(HISTOGRAM_PASSES):
        shift -= STEP_BITS
        bound = materialize(_boundary(words, sized(bound), shift))
    bound = sized(bound)
    last = words.join(bound, words["source"].eqNullSafe(bound["source"]) & (F.shiftright(words["h"], shift) == F.shiftright(bound["low"], shift))).select(
        bound["source"], "rem", "below", "h", "size"
    )
    by_hash = last.groupBy("source", "h").agg(F.first("rem").alias("rem"), F.first("below").alias("below"), F.sum("size").alias("s"), F.count("*").alias("tied"))
    by_hash = by_hash.withColumn("through", F.col("below") + F.sum("s").over(Window.partitionBy("source").orderBy("h")))
    # The hash in which the budget is passed, or the last; of its rows as many as come nearest.
    edge = by_hash.groupBy("source").agg(
        F.coalesce(F.min(F.when(F.col("through") > F.col("rem"), F.struct("h", "rem", "through", "s", "tied"))), F.max(F.struct("h", "rem", "through", "s", "tied"))).alias("e")
    ).select(F.col("source").alias("t_source"), "e.*")
    some = F.greatest(F.lit(0), F.least(F.col("tied"), F.ceil((F.col("rem") - (F.col("through") - F.col("s"))) * F.col("tied") / F.col("s") - 0.5)))
    edge = edge.select("t_source", F.col("h").alias("edge"), "tied", some.cast("long").alias("some"))
    plan = targets.join(edge, targets["source"].eqNullSafe(edge["t_source"]), "left").select(
        F.col("source").alias("t_source"), "source_size", "target", "base",
        F.coalesce(F.when(F.col("some") == F.col("tied"), F.col("edge")).otherwise(F.col("edge") - 1), F.lit(-1)).alias("threshold"),
        F.when((F.col("some") > 0) & (F.col("some") < F.col("tied")), F.col("edge")).alias("edge"), F.coalesce("tied", F.lit(0)).alias("tied"), F.coalesce("some", F.lit(0)).alias("some"),
    )
    return rows, sized(materialize(plan))


def _with_copies(rows: DataFrame, plan: DataFrame, source: Column, h: Column) -> DataFrame:
    """rows with the plan's columns and __copies: how often the mix takes each.

    Documents meet the plan where they lie. Only rows tied at a source's edge are dealt
    out: in chunks by their place in the scan, so that no task holds them all.
    """
    joined = rows.withColumn("__h", h).join(plan, source.eqNullSafe(F.col("t_source")))
    more = (F.col("__h") <= F.col("threshold")).cast("long")
    if plan.where("edge is not null").isEmpty():
        return joined.withColumn("__copies", F.col("base") + more).drop("__h")
    joined = joined.withColumn("__tied", F.coalesce(F.col("__h") == F.col("edge"), F.lit(False)))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("tied") / TIED_ROWS))
    tied = materialize(joined.where("__tied").withColumn("__chunk", chunk))
    before = tied.groupBy("t_source", "__chunk").count()
    before = before.withColumn("__before", F.sum("count").over(Window.partitionBy("t_source").orderBy("__chunk")) - F.col("count"))
    before = sized(materialize(before.select(F.col("t_source").alias("__b_source"), F.col("__chunk").alias("__b_chunk"), "__before")))
    ranked = tied.withColumn("__rank", F.row_number().over(Window.partitionBy("t_source", "__chunk").orderBy("__h")))
    ranked = ranked.join(before, F.col("t_source").eqNullSafe(F.col("__b_source")) & (F.col("__chunk") == F.col("__b_chunk")))
    dealt = ranked.withColumn("__copies", F.col("base") + (F.col("__rank") + F.col("__before") <= F.col("some")).cast("long"))
    plain = joined.where("not __tied").withColumn("__copies", F.col("base") + more)
    return plain.unionByName(dealt.select(*plain.columns)).drop("__h", "__tied")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How many times the mix takes each document.

    Returns one row per row of docs: doc_id, source, size (words; null text 0),
    source_size, target (of its source) and copies. A source whose target is r
    times its size gives every document floor(r) times, and once more those
    whose hash is at most a threshold. The threshold comes from histograms of
    words by source and hash bucket: one pass finds the bucket in which the
    running total passes the budget, the next passes refine that bucket alone,
    and the last settles it hash by hash, to the nearest total. Nothing is sorted but the histograms.

    The copies depend on ids, texts, sources and the seed only, so reruns agree. Rows of
    equal id, text and source are interchangeable: where the budget ends among them, as
    many are taken as come nearest to it. So a source of null ids, or of one id, or of
    one document many times over, meets its target like any other. A null
    source is a source of its own, last in order. Sources without words have
    target 0. An empty table gives an empty result; very long texts are one document each; other columns are ignored.
    """
    rows, plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, share=share, max_repeat=max_repeat, seed=seed)
    mixed = _with_copies(rows, plan, F.col("source"), F.col("h"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", F.col("__copies").alias("copies"))


def repeat_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources says, columns unchanged.

    The plan has a row per source and is broadcast while that is small, so documents are
    filtered and repeated where they lie; their texts are not shuffled. Columns of docs
    that the plan also names are kept as they are.
    """
    _, plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, share=share, max_repeat=max_repeat, seed=seed)
    held = docs.select(F.struct(*docs.columns).alias("__doc"))
    taken = _with_copies(held, plan, F.col("__doc")[source_col], mix_hash(F.col("__doc")[id_col], F.col("__doc")[text_col], seed)).where("__copies > 0")
    return taken.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__turn")).select(*[F.col("__doc")[c].alias(c) for c in docs.columns])
