"""Text scalars as column expressions; the few that Spark has no function for are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Java patterns get Unicode classes and case folding; Python's `re` has both by default.
UNICODE = "(?iU)"


def nfkc(text: Column) -> Column:
    """Compatibility composition (NFKC)."""

    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return normalize(text)


def sanitize(text: Column) -> Column:
    """TXT-01: NFKC; without links, mentions and hashtags; letters, numbers, punctuation and spaces alone; blanks collapsed. Null gives ''.

    Control characters vanish and do not become blanks.
    """
    t = nfkc(F.coalesce(text, F.lit("")))
    return sanitize_composed(t)


def sanitize_composed(text: Column) -> Column:
    """TXT-01 without the NFKC step, for text already composed: built-in functions alone."""
    t = F.regexp_replace(text, r"(?i)https?://\S+|www\.\S+", "")
    t = F.regexp_replace(t, r"(?U)[@#]\w+", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\p{P}\p{Zs}]", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def strip_fence(text: Column) -> Column:
    """TXT-02: without an outer code fence, whose first line may name a language."""
    t = F.trim(text)
    body = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")
    return F.when(t.startswith("```"), F.trim(body)).otherwise(text)


def utf16_len(text: Column) -> Column:
    """TXT-03: UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def one_line(text: Column) -> Column:
    """TXT-06: white space collapsed to single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_set(text: Column, stop: Sequence[str] = ()) -> Column:
    """TXT-07: distinct words of Cyrillic, Latin letters and digits, lower-cased, less stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([а-яёa-z0-9]+)"), F.lit(1)))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]).cast("array<string>")) if stop else words


def lemmas(text: Column, lemmatizer=None, stop: Sequence[str] = ()) -> Column:
    """TXT-08: distinct words of two or more characters in base form.

    lemmatizer maps a pandas Series of words to their base forms; without one
    words stay as they are.
    """
    words = F.filter(word_set(text, stop), lambda w: F.length(w) >= 2)
    if lemmatizer is None:
        return words

    @F.pandas_udf("array<string>")
    def base(rows: pd.Series) -> pd.Series:
        known = pd.Series(sorted({w for r in rows if r is not None for w in r}), dtype=object)
        forms = dict(zip(known, lemmatizer(known), strict=True))
        return rows.map(lambda r: None if r is None else [*dict.fromkeys(forms[w] for w in r if forms[w] not in stop)])

    return base(words)


def word_overlap(a: Column, b: Column) -> Column:
    """VEC-15: words shared, by the smaller of two word sets; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def estimate_tokens(text: Column) -> Column:
    """TXT-10: a third of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long")


def channel_slug(name: Column) -> Column:
    """TXT-13: without leading dashes, other than letters and digits as underscores."""
    return F.regexp_replace(F.regexp_replace(name, "^-+", ""), r"[^A-Za-z0-9]", "_")


def channel_field(name: Column) -> Column:
    """TXT-13: letters, digits and underscores alone, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_]", ""))


def slug(text: Column, fallback: str | None = None) -> Column:
    """TXT-14: a Latin address of up to 40 characters; null (or fallback) if nothing is left."""
    single = {k: v for k, v in fixed.TRANSLITERATION.items() if len(v) == 1}
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(single), "".join(single.values()))
    for letter, latin in fixed.TRANSLITERATION.items():
        if len(latin) != 1:
            t = F.replace(t, F.lit(letter), F.lit(latin))
    t = F.substring(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def url_handle(url: Column) -> Column:
    """TXT-15: the handle of @name, t.me/name and tg://resolve?domain=name; null for others."""
    found = F.regexp_extract(F.trim(url), r"(?i)^(?:@|(?:https?://)?(?:t|telegram)\.me/(?:s/)?|tg://resolve\?domain=)([A-Za-z0-9_]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def message_line(ts: Column, text: Column, sender: Column, reply_to: Column) -> Column:
    """TXT-16: [HH:MM] u/sender ← reply n: text; absent parts are left out."""
    head = F.concat(F.lit("["), F.date_format(ts, "HH:mm"), F.lit("]"))
    reply = F.concat(F.lit("← reply "), F.substring_index(reply_to, "_", -1))
    return F.concat(F.concat_ws(" ", head, F.concat(F.lit("u/"), sender.cast("string")), reply), F.lit(": "), text)


def embed_text(*parts: Column) -> Column:
    """TXT-17: parts that are not blank, joined by '. '."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p != ""), ". ")


def lead(text: Column) -> Column:
    """TXT-19: (head, rest) at the first '. ' from the 41st character on that no digit precedes."""
    found = F.regexp_extract(text, r"(?s)^(.{39,}?[^\d]\.) (.*)$", 1)
    rest = F.regexp_extract(text, r"(?s)^(.{39,}?[^\d]\.) (.*)$", 2)
    return F.struct(F.when(found == "", text).otherwise(found).alias("head"), F.when(found == "", F.lit("")).otherwise(rest).alias("rest"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """TXT-20: the Slavic plural form for a number."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    teens = tens.between(11, 14)
    return F.when((ones == 1) & ~teens, one).when(ones.between(2, 4) & ~teens, few).otherwise(many)


def plain_wiki(text: Column) -> Column:
    """TXT-21: wiki text without templates, links, emphasis and tags."""
    t = F.regexp_replace(text, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[https?://\S+ ([^\]]*)\]", "$1")
    t = F.regexp_replace(t, r"'{2,}", "")
    return one_line(F.regexp_replace(t, r"<[^>]+>", ""))


def ungrounded(answer: Column, sources: Column) -> Column:
    """TXT-23: numbers of two or more digits and Latin words of an answer that the sources (array) do not have."""
    src = F.lower(F.array_join(sources, " "))
    bare = lambda n: F.replace(F.regexp_replace(n, "[.,]+$", ""), F.lit(","), F.lit(""))
    src_numbers = F.transform(F.regexp_extract_all(src, F.lit(r"(\d[\d.,]*)"), F.lit(1)), bare)
    plain = F.regexp_replace(answer, "<[^>]+>", " ")
    numbers = F.regexp_extract_all(plain, F.lit(r"(\d[\d.,]*)"), F.lit(1))
    loose = F.filter(numbers, lambda n: (F.length(bare(n)) >= 2) & ~F.exists(src_numbers, lambda s: s.contains(bare(n))))
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([A-Za-z][A-Za-z0-9.&]{2,})"), F.lit(1)))
    clean = lambda w: F.lower(F.regexp_replace(w, r"^[.\-/&]+|[.\-/&]+$", ""))
    foreign = F.filter(words, lambda w: (F.length(clean(w)) >= 3) & ~src.contains(clean(w)))
    return F.concat(loose, foreign)


def has_cyrillic(text: Column) -> Column:
    """TXT-27."""
    return text.rlike("[а-яёА-ЯЁ]")


def geo_codes(raw: Column, known: Sequence[str]) -> Column:
    """TXT-30: distinct known codes of a list split at commas, semicolons and slashes; 'any' counts."""
    allowed = F.array(*[F.lit(c) for c in (*known, "any")])
    parts = F.transform(F.split(F.lower(F.coalesce(raw, F.lit(""))), "[,;/]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: F.array_contains(allowed, p)))


def names_of(codes: Column, names: dict[str, str]) -> Column:
    """TXT-29: a comma list of codes as names, unknown ones in capitals."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_join(F.transform(F.split(codes, ","), lambda c: F.coalesce(table[F.lower(F.trim(c))], F.upper(F.trim(c)))), ", ")


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """VEC-13, TXT-31: the value of the first (value, pattern) that matches."""
    out = None
    for value, pattern in rules:
        hit = text.rlike(UNICODE + pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def subject(text: Column) -> Column:
    """VEC-13: subject of a message."""
    return first_match(text, [(s, p) for s, _, p in fixed.SUBJECTS], fixed.OTHER_SUBJECT)


def category(text: Column) -> Column:
    """FN-12: category of the subject."""
    return first_match(text, [(c, p) for _, c, p in fixed.SUBJECTS], fixed.OTHER_CATEGORY)


def tags(text: Column, rules: Sequence[tuple[str, str]] = fixed.TAGS) -> Column:
    """VEC-14: all tags whose (pattern, tag) matches, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(UNICODE + p), F.lit(t)) for p, t in rules]))))


def capitalized(text: Column) -> Column:
    """TXT-31: first character in upper case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def first_word(text: Column) -> Column:
    """MSC-19: first word, lower-cased."""
    return F.lower(F.split(F.trim(text), r"\s+")[0])


def pick(seed: Column, n: int) -> Column:
    """TXT-32: md5 of a seed, as a 128-bit number, modulo n."""
    digits = F.transform(F.regexp_extract_all(F.md5(seed), F.lit("(.)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: F.pmod(acc * 16 + d, F.lit(n)))


def shortened(text: Column, limit: int) -> Column:
    """TXT-12 (corpus lines): cut to limit characters and ' ...'."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ..."))).otherwise(text)


def first_sentence(text: Column, limit: int = 200) -> Column:
    """SNK-30: up to the first stop or line end, cut to limit."""
    return F.substring(F.trim(F.split(text, r"[.!?\n]")[0]), 1, limit)


def hashtag(text: Column) -> Column:
    """TXT-26: '#' and the text without blanks and marks."""
    return F.concat(F.lit("#"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", ""))


def bad_label(label: Column, junk: Sequence[str] = (), prefixes: Sequence[str] = (), shelves: Sequence[str] = ()) -> Column:
    """FLT-13: why a label is unfit, or null: 'empty', 'junk', 'prefix' or 'shelf'."""
    clean = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(label, F.lit(""))), "ё", "е"), r"(?U)[^\w\s]", ""))
    out = F.when(clean == "", "empty").when(clean.isin(*junk), "junk")
    for p in prefixes:
        out = out.when(clean.startswith(p), "prefix")
    return out.when(clean.isin(*shelves), "shelf")


def question_prefix(text: Column, name: str) -> Column:
    """FLT-17: what follows a name that begins the text, in any case; null if it does not."""
    rest = F.regexp_extract(text, rf"(?isU)^\s*{re.escape(name)}[\s,:.!-]*(.*)$", 1)
    return F.when(text.rlike(rf"(?iU)^\s*{re.escape(name)}(?:\W|$)"), F.trim(rest))
