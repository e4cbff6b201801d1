"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import materialize, sized


def _key(value: Column) -> Column:
    """128 hashed bits of value."""
    return F.struct(F.xxhash64(value, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), value).alias("b"))


#: Lines of so many words or more are compared by words, shorter ones by characters.
WORDS = 8
#: Shorter lines of fewer characters than this repeat only exactly: one character would be a large part of them.
CHARACTERS = 16
#: ASCII white space besides the line feed, which ends lines, and the blank (fixed values).
BLANKS = ("\t", "\x0b", "\x0c", "\r")


def spaced(text: Column) -> Column:
    """text with a blank for each ASCII white space but line feeds."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def said(line: Column) -> Column:
    """The words of a spaced line, lower-cased, with one blank between them; empty without words."""
    one = F.trim(F.lower(line))
    return F.when(F.contains(one, F.lit("  ")), F.regexp_replace(one, " {2,}", " ")).otherwise(one)


def text_hash(text_col: str) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.lit(3), F.col(text_col))


def n_parts(text: Column, mark: str) -> Column:
    """So many parts split() would make at a mark of one byte."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit(""))) + 1


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, line_no, said, n_words of each line that has words."""
    lines = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), F.posexplode(F.split(spaced(F.col(text_col)), "\n")).alias("line_no", "line"))
    # Which lines have words is asked of the line itself: a filter on `said` would make it twice.
    lines = lines.where(F.trim("line") != "").select("doc_id", "text_hash", "line_no", said(F.col("line")).alias("said"))
    return lines.select("*", n_parts(F.col("said"), " ").alias("n_words"))


def characters(words: Column) -> Column:
    """A shorter line's characters. Each carries a blank, which no word has, so that they never meet words."""
    return F.transform(F.split(F.array_join(words, " "), ""), lambda c: F.concat(F.lit(" "), c))


def lines_at(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The words of wanted lines (doc_id, text_hash, line_no, key, place): key, place, words; other documents are not split."""
    per_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", "key", "place")).alias("at"))
    per_doc = materialize(per_doc.select(F.col("doc_id").alias("__at_doc"), F.col("text_hash").alias("__at_hash"), "at"))
    n_docs, n_lines = per_doc.agg(F.count("*"), F.sum(F.size("at"))).first()
    if n_docs + (n_lines or 0) <= common.BROADCAST_ROWS:
        per_doc = F.broadcast(per_doc)
    # The text is split once, as the only element of a list: inside, `parts` is a value.
    taken = F.transform(F.array(F.split(F.col(text_col), "\n")), lambda parts: F.transform("at", lambda x: F.struct(x["key"].alias("key"), x["place"].alias("place"), F.get(parts, x["line_no"]).alias("line"))))[0]
    found = docs.join(per_doc, docs[id_col].eqNullSafe(F.col("__at_doc")) & (text_hash(text_col) == F.col("__at_hash"))).select(F.explode(taken).alias("x"))
    found = found.select("x.key", "x.place", said(spaced(F.col("x.line"))).alias("said"))
    # Equal rows give a line more than once, and texts of equal hashes other lines: the line's own hash decides.
    found = found.where(_key(F.col("said")) == F.col("key")).dropDuplicates(["key"])
    return found.select("key", "place", F.split("said", " ").alias("words"))


def forms(lines: DataFrame) -> DataFrame:
    """Lines (key, place, words) as what edits are counted in: key, place, by_words, whole_only, tokens.

    A line of WORDS words or more is its words, a shorter one its characters. One word less than WORDS
    is words too, but meets longer lines only: of it there are no deletions (whole_only).
    """
    n, w = F.size("words"), F.col("words")
    short = F.array_join(w, " ")
    form = lambda by_words, whole_only, tokens: F.struct(F.lit(by_words).alias("by_words"), F.lit(whole_only).alias("whole_only"), tokens.alias("tokens"))
    each = F.when(n >= WORDS, F.array(form(True, False, w))).when(n < WORDS - 1, F.array(form(False, False, characters(w))))
    each = each.when(F.length(short) >= CHARACTERS, F.array(form(False, False, characters(w)), form(True, True, w))).otherwise(F.array(form(True, True, w)))
    return lines.select("key", "place", F.explode(each).alias("f")).select("key", "place", "f.*")


def _total(shift: int) -> Column:
    """The exclusive or of the hashes of token and place, the latter moved by shift."""
    return F.aggregate(F.transform("tokens", lambda t, j: F.xxhash64(t, j + shift)), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h))


def variants(lines: DataFrame) -> DataFrame:
    """(place, by_words, cut, v) of lines (place, by_words, tokens): hashed keys of the line itself (cut -1) and of it less each token.

    A list of tokens is keyed by the exclusive or of the hashes of token and place. So
    the key without a token is made of the exclusive or of the hashes ahead of it,
    and of that of the hashes behind it, each a place earlier. Both are
    running sums over the exploded line: work and memory grow with its length alone.
    """
    # Lines are dealt out whole, ahead of the window, and not as rows of their tokens.
    totals = lines.repartition("place").select("place", "by_words", "tokens", _total(0).alias("whole"), _total(-1).alias("moved"))
    each = totals.select("place", "by_words", "moved", F.posexplode("tokens").alias("cut", "t"))
    each = each.select("place", "by_words", "cut", "moved", F.xxhash64("t", "cut").alias("here"), F.xxhash64("t", F.col("cut") - 1).alias("before"))
    run = Window.partitionBy("place").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.bit_xor("here").over(run).bitwiseXOR(F.col("here"))
    behind = F.col("moved").bitwiseXOR(F.bit_xor("before").over(run))
    return each.select("place", "by_words", "cut", ahead.bitwiseXOR(behind).alias("v")).unionByName(totals.select("place", "by_words", F.lit(-1).alias("cut"), F.col("whole").alias("v")))


def whole_keys(lines: DataFrame) -> DataFrame:
    """The keys of variants() of the lines themselves."""
    return lines.select("place", "by_words", F.lit(-1).alias("cut"), _total(0).alias("v"))


def _places(numbered: DataFrame) -> Column:
    """Order of lines by doc_id (null last) and line_no, as one number that a hash aggregate can take the minimum of.

    A long where the table's ids and line numbers fit one, else a decimal.
    """
    low, high, lines = numbered.agg(F.min("doc_id"), F.max("doc_id"), F.max("line_no")).first()
    bits = (lines or 0).bit_length()
    if low is None or (low >= 0 and int(high) < 1 << (62 - bits)):
        last = F.lit(1 << 62).cast("long")
        return F.coalesce(F.shiftleft(F.col("doc_id").cast("long"), bits), last) + F.col("line_no")
    order = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (order * F.lit(1 << 31).cast("decimal(12,0)") + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")


def _halves(n: Column, head: Callable[[Column], Column], tail: Callable[[Column], Column], salt: int) -> list[Column]:
    """Hashed keys of the first and last halves of a line of n tokens, for partners of as many tokens and of one more or less.

    If two lines differ by one token, it lies in one half of the longer, counted
    from the start before it and from the end behind it; what is left of both is equal.
    Halves of n and of n + 1 tokens are three: of an even n the first ones agree, of an odd n the last ones.
    """
    half = F.shiftright(n, 1)
    first, last = (lambda k: F.xxhash64(head(k), F.lit(salt + 1))), (lambda k: F.xxhash64(tail(k), F.lit(salt)))
    return [first(half), last(half + 1), F.when(n % 2 == 0, last(half)).otherwise(first(half + 1))]


def half_keys(line: Column, n: Column) -> tuple[Column, Column]:
    """Keys of halves of a line, as said(), of n words: of its words, and of its characters; null where it is not compared so."""
    by_words = _halves(n, lambda k: F.call_function("substring_index", line, F.lit(" "), k), lambda k: F.call_function("substring_index", line, F.lit(" "), -k), 0)
    by_text = _halves(F.length(line), lambda k: F.left(line, k), lambda k: F.right(line, k), 2)
    # One word less than WORDS, an odd number, meets longer lines only.
    words = F.when(n >= WORDS, F.array(*by_words)).when(n == WORDS - 1, F.array(*by_words[1:]))
    return words, F.when((n < WORDS) & (F.length(line) >= CHARACTERS), F.array(*by_text))


def _quarters(tokens: Column, whole_only: Column) -> Column:
    """Hashed keys of a list less each of its quarters, as in _halves; whole_only: only for partners of one token more.

    The keys are made in a lambda: written out one by one their code exceeds what the JVM compiles.
    """
    n = F.size(tokens)

    def key(x: Column) -> Column:
        longer, k = n + x["more"], x["k"]
        head, tail = F.shiftright(longer * k, 2), longer - F.shiftright(longer * (k + 1), 2)
        return F.xxhash64(F.slice(tokens, F.lit(1), head), k, F.slice(tokens, n - tail + 1, tail))

    each = [[F.struct(F.lit(more).alias("more"), F.lit(k).alias("k")) for k in range(4)] for more in (1, 0)]
    return F.array_distinct(F.transform(F.when(whole_only, F.array(*each[0])).otherwise(F.array(*each[0], *each[1])), key))


def _sharing(keyed: DataFrame) -> DataFrame:
    """Lines `a` of keyed (a, keys) that have a key in common with another line.

    A key of two members is settled by its smallest and largest; only
    keys of more are looked up again.
    """
    each = keyed.select("a", F.explode("keys").alias("k"))
    groups = materialize(each.groupBy("k").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("n")).where("lo < hi"))
    ends = groups.select(F.explode(F.array("lo", "hi")).alias("a"))
    more = each.join(sized(groups.where("n > 2").select("k")), "k", "left_semi").select("a")
    return ends.unionByName(more).distinct()


def within_one_token(a: Column, b: Column) -> Column:
    """Whether token lists are at edit distance 0 or 1: common start and end cover all but one token."""

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(first == 0, F.least(F.size(x), F.size(y))).otherwise(first - 1)

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that repeat an earlier line: (doc_id, text_hash, line_no).

    Lines are compared as lists of words, lower-cased; lines without words stay. Order is by doc_id
    (null last) and line. A line goes if an earlier one is equal, whatever its length, or
    within the edit bound, whether or not that one is kept itself. The bound is one
    token put in, left out or replaced: one word where one of the lines has WORDS words or more, and
    one character where both have fewer and CHARACTERS characters or more (words joined by blanks).

    1. Equal lines meet by their hash; the earliest is kept, unless it has a partner itself.
    2. Lines within one token share their first or their last half, and then three of
       their quarters. Lines that share no such key with another are out: most.
    3. The others emit all their variants, the line itself and each deletion of one
       token, as hashed keys. Members of one variant that lack the same token
       are within the bound of each other, and so is a line that equals the variant
       of any. So the earliest partner is a minimum by key: no pairs arise,
       however common a variant is.
    4. The tokens of line and partner are compared.

    Null and empty texts have no lines to lose, an empty table gives none, and a line of
    any length is compared whole.
    """
    lines = line_table(docs, id_col, text_col)
    at = ["doc_id", "text_hash", "line_no"]
    by_words, by_text = half_keys(F.col("said"), F.col("n_words"))
    numbered = materialize(lines.select(*at, _key(F.col("said")).alias("key"), by_words.alias("by_words"), by_text.alias("by_text")))
    place = _places(numbered)
    hashed = numbered.select(*at, "key", place.alias("place"))
    first = hashed.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    repeated = materialize(first.where("copies > 1").select("key", "first"))

    keys = F.when(F.col("by_text").isNull(), F.col("by_words")).when(F.col("by_words").isNull(), F.col("by_text")).otherwise(F.concat("by_words", "by_text"))
    fuzzy = numbered.where("by_words is not null or by_text is not null")
    halved = materialize(_sharing(fuzzy.select("key.a", keys.alias("keys"))))
    candidates = fuzzy.select(*at, "key", place.alias("place"), F.col("key.a").alias("a")).join(sized(halved), "a", "left_semi")
    candidates = candidates.groupBy("key").agg(F.min_by(F.struct(*at, "place"), "place").alias("at")).select("key", "at.*")
    texts = forms(lines_at(docs, candidates, id_col, text_col))
    texts = materialize(texts.withColumn("quarters", _quarters(F.col("tokens"), F.col("whole_only"))))
    quartered = materialize(_sharing(texts.select("key.a", F.col("quarters").alias("keys"))))
    texts = materialize(texts.drop("quarters").withColumn("a", F.col("key.a")).join(sized(quartered), "a", "left_semi").drop("a"))

    deletions = materialize(variants(texts.where("not whole_only").select("place", "by_words", "tokens")).unionByName(whole_keys(texts.where("whole_only"))))
    # Most variants are of one line only, which gives it no partner.
    shared = materialize(deletions.groupBy("v").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select("v"))
    deletions = materialize(deletions.join(sized(shared), "v", "left_semi"))
    by_cut = deletions.groupBy("v", "cut").agg(F.min("place").alias("first"))
    by_variant = by_cut.groupBy("v").agg(F.min(F.when(F.col("cut") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("cut") >= 0, F.col("first"))).alias("cut_first"))
    partners = by_cut.join(by_variant, "v").select("v", "cut", F.when(F.col("cut") < 0, F.col("cut_first")).otherwise(F.least("first", "whole")).alias("partner"))
    partners = materialize(partners.where("partner is not null"))
    found = deletions.join(sized(partners), ["v", "cut"]).where(F.col("partner") < F.col("place")).groupBy("place", "by_words").agg(F.min("partner").alias("partner"))
    of = texts.select(F.col("place").alias("at"), F.col("by_words").alias("of_words"), F.col("tokens").alias("of"))
    verified = found.join(texts, ["place", "by_words"]).join(of, (F.col("partner") == F.col("at")) & (F.col("by_words") == F.col("of_words")))
    verified = verified.where(within_one_token(F.col("tokens"), F.col("of"))).select("key", "place").distinct()
    # Of equal lines all but the earliest go, and with a partner that one, too: one pass over the lines for both.
    limits = repeated.select("key", (F.col("first") + 1).alias("least")).unionByName(verified.select("key", F.col("place").alias("least")))
    limits = materialize(limits.groupBy("key").agg(F.min("least").alias("least")))
    return hashed.join(sized(limits), "key").where(F.col("place") >= F.col("least")).select(*at).distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs without repeated lines: its columns, text rewritten, and n_lines, n_removed.

    See duplicate_lines for what repeats. Null text stays null (no lines) and empty text stays
    empty. Rows that share a doc_id, or have none, are one document in the order: their
    lines of the same number do not remove each other, and each loses its own. With drop_emptied, documents
    whose words are all in removed lines go. Columns of docs already
    called n_lines or n_removed are replaced.
    """
    removed = duplicate_lines(docs, id_col=id_col, text_col=text_col)
    # One array per document, no longer than the document's own list of lines.
    removed = removed.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("__removed"))
    removed = materialize(removed.select(F.col("doc_id").alias("__line_doc"), F.col("text_hash").alias("__line_hash"), "__removed"))
    docs_hit, lines_hit = removed.agg(F.count("*"), F.sum(F.size("__removed"))).first()
    if docs_hit + (lines_hit or 0) <= 2 * common.BROADCAST_ROWS:
        removed = F.broadcast(removed)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.join(removed, docs[id_col].eqNullSafe(removed["__line_doc"]) & (text_hash(text_col) == removed["__line_hash"]), "left")
    split = F.split(F.col(text_col), "\n")

    def left(parts: Column) -> Column:
        # The numbers of kept lines by a hashed difference; then each line by its place.
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__removed")), lambda k: F.get(parts, k)), "\n")

    rewritten = F.transform(F.array(split), left)[0]
    joined = joined.withColumn("__text", F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(rewritten))
    if drop_emptied:
        joined = joined.where(F.col("__removed").isNull() | (F.trim("__text") != ""))
    return joined.select(
        *[F.col("__text").alias(c) if c == text_col else F.col(c) for c in names],
        F.when(F.col(text_col).isNull(), 0).otherwise(n_parts(F.col(text_col), "\n")).alias("n_lines"),
        F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).alias("n_removed"),
    )
