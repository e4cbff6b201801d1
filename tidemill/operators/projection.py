"""A build of nodes in another language: what is unchanged is carried over from the last build, the rest is translated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import has_cyrillic
from tidemill.operators.knowledge import bind_nodes
from tidemill.sources.store import cut_lineage

#: Items that a view needs after losses.
VIEW_MIN = 4
BUILT = ["geo", "kind", "node", "src", "label", "id", "text", "h"]


def source_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 8)


def signature(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """PG-13: (geo, signature): what a geo's build depends on: nodes, labels, items and their texts, in any order.

    A sum of hashes and a count, so a geo of any size is added up in parts.
    """
    met = nodes.join(texts.select("id", source_hash(F.col("text")).alias("h")), "id", "left")
    one = F.xxhash64("kind", "node", "label", F.col("id").cast("string"), F.coalesce("h", F.lit(""))).cast("decimal(38,0)")
    return met.groupBy("geo").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(one).cast("string")).alias("signature"))


def stale(now: DataFrame, built: DataFrame) -> DataFrame:
    """PG-13: (geo): geos whose signature is not that of their last build, or that have none."""
    same = F.col("n.geo") == F.col("b.geo")
    return now.alias("n").join(built.alias("b"), same & (F.col("n.signature") == F.col("b.signature")), "left_anti").select("geo")


def project(nodes: DataFrame, texts: DataFrame, old: DataFrame, translate: Callable[[Column], Column], name: Callable[[Column], Column]) -> DataFrame:
    """PG-05: the build (geo, kind, node, src, label, id, text, h, carried) of nodes (geo, kind, node, label, id) with texts (id, text).

    Of the old build (its columns without `carried`), a text is carried while its source's hash is the same, or it has none; a label while its node is bound: by
    the same source label in the same geo and kind, or as the one old node whose items are all in the new one's. All others go through
    `translate` and `name`, columns whose null is a failure. Items without a text go; views (kind 'view') go
    if four items are not left, or if their label stays Cyrillic; other nodes go with their last item.
    """
    met = nodes.join(texts.select("id", "text"), "id").where(F.trim("text") != "").withColumn("h", source_hash(F.col("text")))
    kept = old.where("text is not null").groupBy("id").agg(F.max_by(F.struct("text", "h"), F.struct("text", "h")).alias("__old"))
    met = met.join(kept, "id", "left")
    same = F.col("__old").isNotNull() & (F.col("__old.h").isNull() | (F.col("__old.h") == F.col("h")))
    met = met.withColumn("carried", same).withColumn("text", F.when(same, F.col("__old.text")).otherwise(translate(F.col("text")))).drop("__old").where("text is not null")

    own = ["geo", "kind", "node"]
    key = F.concat_ws("\u0001", *own)
    new_nodes = nodes.groupBy(*own, "label").agg(F.collect_set("id").alias("ids")).select(*own, "label", key.alias("key"), F.concat_ws("\u0001", "geo", "kind", "label").alias("src"), "ids")
    old_nodes = old.groupBy(*own, "src", "label").agg(F.collect_set("id").alias("ids")).select(key.alias("key"), F.concat_ws("\u0001", "geo", "kind", "src").alias("src"), F.col("label").alias("old_label"), "ids")
    new_nodes, old_nodes = cut_lineage(new_nodes), cut_lineage(old_nodes)
    bound = bind_nodes(new_nodes.select("key", "src", "ids"), old_nodes.select("key", "src", "ids"))
    labels = new_nodes.select(*own, "label", "key").join(bound, F.col("key") == F.col("new_key"), "left").join(old_nodes.select(F.col("key").alias("old_key"), "old_label"), "old_key", "left")
    fit = F.col("old_label").isNotNull() & ~has_cyrillic(F.col("old_label"))
    labels = cut_lineage(labels.select(*own, F.col("label").alias("src"), F.when(fit, F.col("old_label")).otherwise(F.coalesce(name(F.col("label")), F.col("label"))).alias("label")))

    left = met.groupBy(*own).agg(F.count("*").alias("n"))
    view = F.col("kind") == "view"
    alive = labels.join(left, own).where(~view | ((F.col("n") >= VIEW_MIN) & ~has_cyrillic(F.col("label")))).select(*own, "src", "label")
    return met.drop("label").join(alive, own).select(*BUILT, "carried")
