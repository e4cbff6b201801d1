"""Travel wiki pages as rows: listings in templates, and the paragraphs of sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemill.functions import fixed
from tidemill.functions.text import plain_wiki

#: What opens, parts or closes something in wiki text.
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
FIELDS = ("name", "alt", "address", "hours", "price", "phone", "content")


def templates(text: str) -> Iterator[tuple[int, str, dict[str, str]]]:
    """(start, name, fields) of each closed template, by start; nested ones count too.

    One pass with a stack of what is open. A bar parts fields of the innermost template, unless a
    link is open inside it. Links that a template's end cuts off were text, and so is
    a template that never closes, but not what it holds. The last of equal fields counts;
    fields without a name go by their number.
    """
    found = []
    open_: list[tuple[str, int, list[int]]] = []
    for mark in _MARK.finditer(text):
        kind, at = mark[0], mark.start()
        if kind in ("{{", "[["):
            open_.append((kind, at, []))
        elif kind == "|" and open_:
            open_[-1][2].append(at)
        elif kind == "]]" and open_ and open_[-1][0] == "[[":
            open_.pop()
        elif kind == "}}" and any(o[0] == "{{" for o in open_):
            bars: list[int] = []
            while open_[-1][0] == "[[":
                bars = open_.pop()[2] + bars
            _, start, own = open_.pop()
            ends = [*sorted(own + bars), at]
            name = text[start + 2 : ends[0]].strip().lower()
            fields, unnamed = {}, 0
            for lo, hi in zip(ends, ends[1:]):
                part = text[lo + 1 : hi]
                key, sign, value = part.partition("=")
                if not sign or "{{" in key or "[[" in key:
                    unnamed += 1
                    key, value = str(unnamed), part
                fields[key.strip()] = value
            found.append((start, name, fields))
    return iter(sorted(found, key=lambda t: t[0]))


@udtf(returnType="place int, kind string, " + ", ".join(f"f_{f} string" for f in FIELDS))
class Listings:
    """One row for each listing template of a page."""

    def eval(self, text: str) -> Iterator[tuple]:
        for place, (_, kind, fields) in enumerate(t for t in templates(text or "") if t[1] in fixed.LISTING_TAGS):
            yield (place, kind, *(fields.get(f) for f in FIELDS))


def _tag(names: Column, tags: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(names))), F.lit(fixed.OTHER_TAG))


def listings(pages: DataFrame) -> DataFrame:
    """SRC-10, TXT-22, first pass: (country, title, place, name, tag, instruction) of the listings of pages (country, title, text).

    A listing needs a name and a content of 30 characters, or two of address, hours, price and phone.
    """
    each = pages.lateralJoin(Listings(F.col("text").outer()))
    plain = lambda f: F.coalesce(plain_wiki(F.col(f"f_{f}")), F.lit(""))
    each = each.select("country", "title", "place", "kind", *[plain(f).alias(f"f_{f}") for f in FIELDS])
    name = F.when(F.col("f_name") != "", F.col("f_name")).otherwise(F.col("f_alt"))
    facts = [F.when(F.col(f"f_{f}") != "", F.concat(F.lit(f"{f.capitalize()}: "), F.col(f"f_{f}"), F.lit("."))) for f in ("address", "hours", "price", "phone")]
    content = F.nullif(F.col("f_content"), F.lit(""))
    enough = (F.length("f_content") >= 30) | (sum((f.isNotNull().cast("int") for f in facts), F.lit(0)) >= 2)
    return each.where((name != "") & enough).select("country", "title", "place", name.alias("name"), _tag(F.col("kind"), fixed.LISTING_TAGS).alias("tag"), F.concat_ws(" ", content, *facts).alias("instruction"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """SRC-10, second pass: (country, title, section, place, name, tag, instruction) of all paragraphs that are not blank in the sections of level two.

    What stands before the first heading is not read; deeper headings are part of their section, and a heading of level one ends it.
    """
    # A line of one or two equal signs at either end begins a section; the first piece is the lead.
    heads = F.split(F.col("text"), r"(?m)^(?==(?:=[^=\n]+==|[^=\n]+=)[ \t]*$)")
    each = pages.select("country", "title", F.posexplode(F.slice(heads, 2, 2**31 - 1)).alias("section", "body"))
    name = F.trim(F.regexp_extract("body", r"^==([^=\n]+)==", 1))
    body = F.regexp_replace("body", r"^==[^=\n]+==\s*", "")
    # The first piece of a page without a lead is a section too.
    first = pages.where(F.col("text").startswith("==")).select("country", "title", F.lit(-1).alias("section"), heads[0].alias("body"))
    each = each.unionByName(first).where(F.col("body").rlike(r"^==[^=\n]+==[ \t]*(?:\n|$)")).select("country", "title", "section", name.alias("heading"), F.posexplode(F.split(body, r"\n\s*\n")).alias("part", "paragraph"))
    each = each.where(F.trim(F.regexp_replace("paragraph", r"\s+", " ")) != "")
    return each.select("country", "title", "section", "part", F.concat("title", F.lit(": "), "heading").alias("name"), _tag(F.col("heading"), fixed.SECTION_TAGS).alias("tag"), plain_wiki(F.col("paragraph")).alias("instruction"))


def wiki_patterns(pages: DataFrame) -> DataFrame:
    """SRC-10: rows (id, country, title, tag, instruction, source_title, idx) of pages (country, title, text): listings, then paragraphs.

    Both are numbered in the page's order: idx goes on over paragraphs that are too short (under 60 characters), which are
    left out themselves. The id is made of country, page and number, so a second import of a page
    meets its own rows (MSC-08: insert them with tables.insert_ignore). A country's page is numbered by itself; null texts give nothing.
    """
    own = ["country", "title"]
    page = Window.partitionBy(*own)
    found = listings(pages).select(*own, F.lit(0).alias("pass"), F.lit(0).alias("section"), F.col("place").alias("part"), "name", "tag", "instruction")
    read = found.unionByName(paragraphs(pages).select(*own, F.lit(1).alias("pass"), "section", "part", "name", "tag", "instruction"))
    rows = read.withColumn("idx", F.row_number().over(page.orderBy("pass", "section", "part")) - 1).where((F.col("pass") == 0) | (F.length("instruction") >= 60))
    seed = F.concat_ws(":", F.lit(fixed.WIKI_SEED), "country", "title", F.col("idx").cast("string"))
    return rows.select(
        F.substring(F.sha1(seed.cast("binary")), 1, 24).alias("id"), "country", F.trim("name").alias("title"), "tag", F.trim("instruction").alias("instruction"), F.col("title").alias("source_title"), "idx"
    )
