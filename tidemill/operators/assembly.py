"""A site's pages from labelled items, with an account of where every item went."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import bad_label, has_cyrillic, slug
from tidemill.sources.store import cut_lineage, dimension

#: Items that make a view a page, and those that make a shelf one.
VIEW_MIN, SHELF_MIN = 4, 3
NODE = ["lang", "geo", "kind", "label", "key", "theme"]


class Site(NamedTuple):
    """pages (lang, geo, kind, path, theme, label, n), placed (lang, geo, kind, label, id, path, role), unplaced (lang, geo, kind, label, id, reason), tiles (lang, geo, on, place, title, url, n)."""

    pages: DataFrame
    placed: DataFrame
    unplaced: DataFrame
    tiles: DataFrame


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def themes_of(nodes: DataFrame, main: str) -> DataFrame:
    """JON-14: nodes of other languages without a theme take that of the main language's view of the same geo and key."""
    known = nodes.where((F.col("lang") == main) & (F.col("kind") == "view") & F.col("key").isNotNull() & F.col("theme").isNotNull())
    known = known.groupBy(F.col("geo").alias("__geo"), F.col("key").alias("__key")).agg(F.min("theme").alias("__theme"))
    other = (F.col("lang") != main) & (F.col("kind") == "view")
    met = nodes.join(known, (F.col("geo") == F.col("__geo")) & (F.col("key") == F.col("__key")), "left")
    return met.withColumn("home", F.coalesce("theme", F.when(other, F.col("__theme")))).drop("__geo", "__key", "__theme")


def assemble(items: DataFrame, names: DataFrame, *, main: str = "ru", junk: Sequence[str] = (), prefixes: Sequence[str] = ()) -> Site:
    """PG-01: pages of items (lang, geo, kind, label, key, theme, id, text); names (lang, theme, name) is a dimension.

    A view of four items or more is a page, unless it has no address, or in another language than the main one a label that was not
    translated, or in the main one a collective label (junk, prefixes). A shelf of three items or more is
    the page of its theme. Texts of views with a collective label are rescued: they go to their theme's shelf, the largest if there are several.
    A geo has a hub if any view became a page: its tiles are themes, with all their views' and their shelf's items,
    then views without a theme that has a page; if a theme has no name in the language, all views instead.

    Each row of items is in placed or in unplaced, once. Nodes are counted before items meet them, so a node of any size is
    spread over tasks. Null labels count as empty; items with null ids are rows like any other; an empty table gives no pages.
    """
    items = items.select("lang", "geo", "kind", F.coalesce("label", F.lit("")).alias("label"), "key", "theme", "id", "text")
    nodes = items.groupBy(*NODE).agg(F.count("*").alias("n"))
    address = F.coalesce(F.nullif(F.trim("key"), F.lit("")), slug(F.col("label")))
    where = F.concat(F.lit("/"), "lang", F.lit("/"), "geo", F.lit("/"))
    view = F.col("kind") == "view"
    path = F.concat(where, F.when(view, F.lit("")).otherwise("s/"), address, F.lit("/"))
    reason = (
        F.when(F.col("n") < F.when(view, VIEW_MIN).otherwise(SHELF_MIN), "few")
        .when(address.isNull(), "no address")
        .when(view & (F.col("lang") != main) & has_cyrillic(F.col("label")), "not translated")
        .when(view & (F.col("lang") == main) & bad_label(F.col("label"), junk, prefixes).isNotNull(), "collective label")
    )
    nodes = cut_lineage(themes_of(nodes, main).withColumn("reason", reason).withColumn("path", path))
    live = nodes.where("reason is null")
    shelf = Window.partitionBy("lang", "geo", "home").orderBy(F.desc("n"), "label", F.asc_nulls_first("key"))
    homes = live.where("kind = 'shelf' and home is not null").withColumn("__r", F.row_number().over(shelf)).where("__r = 1").select("lang", "geo", "home", F.col("path").alias("shelf_path"), F.col("n").alias("shelf_n"))

    placed_nodes = nodes.join(homes, ["lang", "geo", "home"], "left")
    rescued = F.col("reason") == "collective label"
    at = placed_nodes.select(*NODE, "reason", "home", F.when(F.col("reason").isNull(), F.col("path")).when(rescued, F.col("shelf_path")).alias("path"))
    met = items.alias("i").join(at.alias("n"), _same("i", "n", *NODE)).select(*[F.col(f"i.{c}") for c in ("lang", "geo", "kind", "label", "id", "text")], "reason", "home", "path")
    told = F.coalesce(F.trim("text"), F.lit("")) != ""
    gone = (
        F.when(F.col("reason").isNull(), F.lit(None).cast("string"))
        .when(~rescued, F.col("reason")).when(~told, "no text").when(F.col("home").isNull(), "no theme").when(F.col("path").isNull(), "no shelf")
    )
    met = met.withColumn("gone", gone)
    placed = met.where("gone is null").select("lang", "geo", "kind", "label", "id", "path", F.when(F.col("reason").isNull(), "item").otherwise("rescued").alias("role"))
    unplaced = met.where("gone is not null").select("lang", "geo", "kind", "label", "id", F.col("gone").alias("reason"))

    facts = live.where("kind = 'view'")
    tiles = cut_lineage(_tiles(facts, homes, dimension(names.select("lang", F.col("theme").alias("home"), "name"))))
    hubs = tiles.where(F.col("on") == where).groupBy("lang", "geo").agg(F.count("*").alias("n"))
    hubs = hubs.select("lang", "geo", F.lit("hub").alias("kind"), where.alias("path"), F.lit(None).cast("string").alias("theme"), F.lit("").alias("label"), "n")
    pages = live.select("lang", "geo", "kind", "path", F.col("home").alias("theme"), "label", "n").unionByName(hubs)
    return Site(pages, placed, unplaced, tiles)


def _tiles(facts: DataFrame, homes: DataFrame, names: DataFrame) -> DataFrame:
    """TOP-09: tiles of hubs, in order: themes by their number of views, then loose views, the larger first; and of shelves: their views."""
    hub = F.concat(F.lit("/"), "lang", F.lit("/"), "geo", F.lit("/"))
    each = facts.select("lang", "geo", "home", "label", "path", "n").join(homes, ["lang", "geo", "home"], "left").join(names, ["lang", "home"], "left")
    flat = F.bool_or(F.col("home").isNotNull() & F.col("name").isNull())
    each = each.join(each.groupBy("lang", "geo").agg(flat.alias("flat")), ["lang", "geo"])
    grouped = ~F.col("flat") & F.col("shelf_path").isNotNull()
    themes = each.where(grouped).groupBy("lang", "geo", "home", "name", "shelf_path", "shelf_n").agg(F.count("*").alias("views"), F.sum("n").alias("n"))
    themes = themes.select("lang", "geo", F.lit(0).alias("rank"), (-F.col("views")).alias("mass"), F.col("name").alias("title"), F.col("shelf_path").alias("url"), (F.col("n") + F.col("shelf_n")).alias("n"))
    loose = each.where(~grouped).select("lang", "geo", F.lit(1).alias("rank"), (-F.col("n")).alias("mass"), F.col("label").alias("title"), F.col("path").alias("url"), "n")
    on_hub = themes.unionByName(loose).withColumn("on", hub)
    own = each.where("shelf_path is not null").select("lang", "geo", F.lit(1).alias("rank"), (-F.col("n")).alias("mass"), F.col("label").alias("title"), F.col("path").alias("url"), "n", F.col("shelf_path").alias("on"))
    place = F.row_number().over(Window.partitionBy("on").orderBy("rank", "mass", "title", "url"))
    return on_hub.unionByName(own).withColumn("place", place).select("lang", "geo", "on", "place", "title", "url", "n")
