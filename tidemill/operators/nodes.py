"""HTML as trees of nodes, held as VARIANT, since no struct type holds a tree of any depth."""

from __future__ import annotations

import json
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.store import cut_lineage

#: Tags that hold nothing.
VOID = frozenset({"br", "img", "hr"})
#: Levels of open tags; a tag opened deeper stands on the deepest level, so that a page of unclosed tags stays a valid value.
DEEPEST = 200
#: An ampersand, and the rest of a reference that a semicolon ends. One after which the text breaks off is left to the parser, which waits for more.
AMPERSAND = re.compile(r"&(?![^\s;<>]*\Z)(#\d+;|#[xX][0-9A-Fa-f]+;|[0-9A-Za-z]+;)?")


class _Builder(HTMLParser):
    """Nodes of a fragment: text, or a tag with its attributes and children.

    Only references that end in a semicolon stand for a character: the parser never sees another ampersand, but a character
    that the fragment does not hold.
    """

    def __init__(self, fragment: str) -> None:
        super().__init__()
        self.plain = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in fragment)
        self.top: list = []
        self.path: list[dict] = []
        self.beyond = 0

    def put(self, node: str | dict) -> None:
        (self.path[-1]["children"] if self.path else self.top).append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k.replace(self.plain, "&"): v.replace(self.plain, "&") for k, v in attrs if v is not None}
        tag = tag.replace(self.plain, "&")
        node = {"tag": tag} | ({"attrs": given} if given else {})
        self.put(node)
        if tag in VOID:
            return
        node["children"] = []
        if len(self.path) < DEEPEST:
            self.path.append(node)

    def handle_endtag(self, tag: str) -> None:
        # Only what is innermost closes; other closing tags are void.
        if self.path and self.path[-1]["tag"] == tag.replace(self.plain, "&"):
            self.path.pop()

    def handle_data(self, data: str) -> None:
        self.put(data.replace(self.plain, "&"))

    def read(self, fragment: str) -> None:
        whole = lambda end: end is not None and (end[0] == "#" or end in html5)
        self.feed(AMPERSAND.sub(lambda m: m[0] if whole(m[1]) else self.plain + (m[1] or ""), fragment))


def tree_of(html: str) -> list[dict]:
    """Paragraphs of a text: blank lines part them, other line ends are br; one that says so if there are none."""
    out = []
    for part in filter(None, (p.strip() for p in re.split(r"\n{2,}", html.strip()))):
        part = part.replace("\n", "<br>")
        builder = _Builder(part)
        builder.read(part)
        if builder.top:
            out.append({"tag": "p", "children": builder.top})
    return out or [{"tag": "p", "children": ["(empty)"]}]


def _trees(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else json.dumps(tree_of(x), ensure_ascii=False))


def html_nodes(html: Column) -> Column:
    """TXT-25: HTML as a VARIANT array of nodes (tag, attrs, children), strings being texts; null for null."""
    return F.parse_json(F.pandas_udf(_trees, "string")(html))


def walked(trees: DataFrame, tree: str = "tree") -> DataFrame:
    """One row per node of each tree: the other columns, level (from 0), path (places from the root), tag and attrs, or text.

    A level is exploded at a time, written, and its children are the next; so rounds are as many as the deepest tree has
    levels, at most DEEPEST and a few. Null trees have no nodes.
    """
    own = [c for c in trees.columns if c != tree]
    children = lambda v: F.variant_get(v, "$.children", "array<variant>")
    level = trees.select(*own, F.posexplode(F.try_variant_get(F.col(tree), "$", "array<variant>")).alias("at", "node")).select(*own, F.array("at").alias("path"), "node")
    out, depth = None, 0
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            return out if out is not None else _told(level, own, 0)
        rows = _told(level, own, depth)
        out = rows if out is None else out.unionByName(rows)
        inner = level.where(F.schema_of_variant("node") != "STRING").select(*own, "path", F.posexplode(children(F.col("node"))).alias("at", "node"))
        level, depth = inner.select(*own, F.concat("path", F.array("at")).alias("path"), "node"), depth + 1


def _told(level: DataFrame, own: list[str], depth: int) -> DataFrame:
    node, is_text = F.col("node"), F.schema_of_variant("node") == "STRING"
    get = lambda path, kind: F.when(~is_text, F.try_variant_get(node, path, kind))
    return level.select(*own, F.lit(depth).alias("level"), "path", get("$.tag", "string").alias("tag"), get("$.attrs", "map<string, string>").alias("attrs"), F.when(is_text, F.try_variant_get(node, "$", "string")).alias("text"))
