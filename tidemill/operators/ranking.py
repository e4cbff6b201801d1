"""Places in a global order, without a window over all rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.store import cut_lineage


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """rows with their place (from 1) in their group, by the order columns ascending, nulls first.

    Range partitions follow groups and order, so a group of any size is spread over tasks. A row's
    number in its partition, and one row for each partition and group that tells how many rows of the group come before
    it, give the place. Rows equal in groups and order lie together and are told apart by
    their place in the scan; many of them are spread too.
    """
    by = [*groups, *order]
    scanned = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in (*by, "__row")]
    dealt = cut_lineage(scanned.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = dealt.groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(groups)], part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = [f"__g{k}" for k in range(len(groups))]
    before = F.sum("__n").over(Window.partitionBy(*own).orderBy("__part")) - F.col("__n")
    parts = cut_lineage(parts.withColumn("__before", before))
    on = part == F.col("__part")
    for k, c in enumerate(groups):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    place = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return dealt.join(parts, on).select(*[dealt[c] for c in rows.columns], place.alias(name))


def title_index(pages: DataFrame) -> DataFrame:
    """SNK-27, PG-11: (lang, position, title, path): titles of each language in the order of their lower case, for pages (lang, title, path, noindex).

    Pages without a title or a language, and those kept from the index, are out; paths order equal titles.
    """
    listed = pages.where("title is not null and title <> '' and lang is not null and not coalesce(noindex, false)").select("lang", "title", "path", F.lower("title").alias("__low"))
    return numbered(listed, ["lang"], ["__low", "title", "path"]).select("lang", "position", "title", "path")


def indexable(draft: bool, noindex: Column) -> Column:
    """FLT-14: whether a page may be listed: the site is no draft and the page is not kept out."""
    return F.lit(not draft) & ~F.coalesce(noindex, F.lit(False))


def sitemap(pages: DataFrame, domain: str, *, draft: bool = False, lastmod: str = "", per_file: int = 50_000) -> DataFrame:
    """SNK-27: (file, position, loc, lastmod) of the indexable pages (path, noindex, updated), in the order of paths, so many to a file; pages without a date take the given one, or none."""
    listed = pages.where(indexable(draft, F.col("noindex"))).select(F.concat(F.lit(domain), "path").alias("loc"), F.coalesce(F.nullif("updated", F.lit("")), F.nullif(F.lit(lastmod), F.lit(""))).alias("lastmod"))
    placed = numbered(listed, [], ["loc"])
    return placed.select(F.floor((F.col("position") - 1) / per_file).cast("int").alias("file"), "position", "loc", "lastmod")


def paths(pages: DataFrame) -> DataFrame:
    """PG-11: the distinct paths of built pages."""
    return pages.where("path is not null and path <> ''").select("path").distinct()
