"""Collocations by suffix-sigma: truncated suffixes, sorted, and their prefixes counted with one stack."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized

#: Bytes at which texts fall into pieces, and the one other space beside the blank (fixed values).
BREAKS, TAB = b".,;:!?\n\v\f\r", b"\t"
_CLEAN = bytes.maketrans(BREAKS + TAB, b"\n" * len(BREAKS) + b" ")

#: Distinct words that a task counts before it hands them on, and words that it takes together.
HELD = 400_000
#: Size of the filters of frequent words and pairs, whatever their number: 8 MB each.
FILTER_BITS = 1 << 26
#: Pairs of words that a task counts before it hands them on.
HELD_PAIRS = 6_000_000
#: A first word with more than this share of all words is divided over several tasks; there are at most this many.
HOT_SHARE = 256

LANG_SEED = 42


def cleaned(text: bytes) -> bytes:
    """A text, A-Z in lower case, with line feeds between its pieces and blanks between words; it holds no zero byte (written as 1 1, and 1 as 1 2)."""
    text = text.lower().translate(_CLEAN)
    if b"\0" in text or b"\1" in text:
        text = text.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")
    return text


COUNTED = ["lang", "term", "n"]


def _lot(lang: str, terms: pa.Array, n: pa.Array) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(terms), np.int8)), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, terms, n], names=COUNTED)


def _words(docs: DataFrame) -> DataFrame:
    """Words of the texts (lang, text) with their number per task, in lots: lang, term, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def lots() -> Iterator[pa.RecordBatch]:
            for lang, counter in seen.items():
                keys = list(counter)
                for lo in range(0, len(keys), 50_000):
                    part = keys[lo : lo + 50_000]
                    yield _lot(lang, pa.array(part, pa.binary()), pa.array([counter[k] for k in part], pa.int64()))
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[lang].update(cleaned(text.as_py()).split())
                if sum(map(len, seen.values())) > HELD:
                    yield from lots()
        yield from lots()

    return docs.mapInArrow(count, "lang string, term binary, n long")


def _bits(hashes: DataFrame) -> bytes:
    """A bit for each hash (h). What else has the same bit only costs time."""
    bit = F.pmod("h", F.lit(FILTER_BITS))
    cells = hashes.select(F.floor(bit / 64).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) % 64 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    got = cells.toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got["cell"].to_numpy()] = got["bits"].to_numpy()
    return out.astype("<i8").tobytes()


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one; zero where either is rare or a piece ends, and at the last."""
    nxt = np.append(h[1:], np.uint64(0))
    return np.where((h > 0) & (nxt > 0), (h * np.uint64(0x9E3779B97F4A7C15) ^ (nxt >> np.uint64(29)) ^ nxt) * np.uint64(0xD1342543DE82EF95) >> np.uint64(24) | np.uint64(1), np.uint64(0))


class Coder:
    """Texts as codes of words, in lots of some size: words, codes, and a hash of each word, zero for rare ones."""

    def __init__(self, bits: bytes, size: int) -> None:
        self.bits, self.size = np.frombuffer(bits, np.uint8), size
        # What is known of words: emptied when full, so that rare words cannot fill the memory.
        self.known: dict[str, dict[bytes, int]] = defaultdict(dict)
        self.held: dict[str, list[bytes]] = defaultdict(list)

    def hashes(self, lang: str, words: list[bytes]) -> np.ndarray:
        here, seed = self.known[lang], xxhash.xxh64_intdigest(lang.encode(), seed=LANG_SEED)
        if len(here) > self.size:
            here.clear()
        new = [w for w in words if w not in here]
        if new:
            h = np.array([xxhash.xxh64_intdigest(w, seed=seed) for w in new], np.uint64)
            kept = _has(self.bits, h) & np.array([w != b"\0" for w in new])
            here.update(zip(new, np.where(kept, h | np.uint64(1), np.uint64(0)).tolist()))
        return np.array([here[w] for w in words], np.uint64)

    def add(self, lang: str, text: bytes) -> bool:
        """Take a text in; whether a lot is full."""
        # A zero byte of its own stands where a piece ends.
        self.held[lang] += cleaned(text).replace(b"\n", b" \0 ").split()
        self.held[lang].append(b"\0")
        return sum(map(len, self.held.values())) > self.size

    def lots(self) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
        for lang, taken in self.held.items():
            coded = pa.array(taken, pa.binary()).dictionary_encode()
            yield lang, coded.dictionary, coded.indices.to_numpy().astype(np.int64), self.hashes(lang, coded.dictionary.to_pylist())
        self.held.clear()

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
        """The lots of batches (lang, text)."""
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if self.add(lang, text.as_py()):
                    yield from self.lots()
        yield from self.lots()


def _word_pairs(docs: DataFrame, frequent: bytes) -> DataFrame:
    """Hashes of neighbouring frequent words with their number per lot of pairs: h, n."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def lot() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times, pa.int64())], names=["h", "n"])

        for _, _, codes, h in Coder(shared.value, HELD).read(batches):
            pairs = _pairs(h[codes])
            held.append(pairs[pairs > 0])
            if sum(map(len, held)) > HELD_PAIRS:
                yield lot()
        yield lot()

    return docs.mapInArrow(count, "h long, n long")


def _together(words: pa.Array, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Phrases of so many words from each start on, joined by zero bytes; codes tell the words."""
    parts = []
    for k in range(int(lengths.max(initial=0))):
        has = lengths > k
        at = codes[np.where(has, starts + k, 0)]
        parts.append(words.take(pa.array(np.where(has, at, 0), mask=~has)))
    return pc.binary_join_element_wise(*parts, b"\0", null_handling="skip") if parts else pa.array([], pa.binary())


def suffix_lot(words: pa.Array, codes: np.ndarray, often: np.ndarray, longest: int, follows: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different suffixes of two words or more of the runs of frequent words in a text of codes, truncated to `longest` words: the suffix, how often it occurs, where it first does, and its length.

    follows says after which places a run goes on.
    """
    marks = np.cumsum(often) * often  # 0 ends a run
    c, base = np.append(marks[codes], np.zeros(longest, np.int64)), int(often.sum()) + 1
    n = len(codes)
    goes = np.append(np.ones(n, bool) if follows is None else follows, np.zeros(longest, bool))
    alive, lengths, key = c[:n] > 0, (c[:n] > 0).astype(np.int64), c[:n]
    for k in range(1, longest):
        nxt = np.where(alive & goes[k - 1 : n + k - 1], c[k : n + k], 0)
        alive = nxt > 0
        lengths += alive
        if int(key.max(initial=0)) > (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + nxt
    real = np.flatnonzero(lengths > 1)
    _, first, times = np.unique(key[real], return_index=True, return_counts=True)
    starts = real[first]
    return _together(words, codes, starts, lengths[starts]), times, starts, lengths[starts]


def _suffixes(docs: DataFrame, frequent: bytes, pairs: bytes, hot: dict[tuple[str, bytes], int], longest: int) -> DataFrame:
    """Suffixes of the runs of frequent words and pairs, truncated to `longest` words, with their number per lot: lang, term, n, home, divided.

    `home` is where a suffix is dealt: a hash of language and first word, and for hot first words (with the number
    of their parts) one of as many homes by the first three words; these are `divided`.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, pairs, hot))
    names = [*COUNTED, "home", "divided"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, pairs, hot = shared.value
        pair_bits = np.frombuffer(pairs, np.uint8)
        for lang, words, codes, h in Coder(frequent, HELD).read(batches):
            each = h[codes]
            near = _pairs(each)
            terms, times, starts, lengths = suffix_lot(words, codes, (h > 0).astype(np.int64), longest, (near > 0) & _has(pair_bits, near))
            parts = np.array([hot.get((lang, w), 0) for w in words.to_pylist()], np.uint64)[codes[starts]]
            home, three = each[starts], np.zeros(len(starts), np.uint64)
            for k in range(3):
                three = three * np.uint64(0x9E3779B97F4A7C15) + np.where(lengths > k, each[np.minimum(starts + k, len(codes) - 1)], np.uint64(0))
            home = home + np.where(parts > 0, (three >> np.uint64(17)) % np.maximum(parts, np.uint64(1)), np.uint64(0)) * np.uint64(0xD1342543DE82EF95)
            rows = _lot(lang, terms, pa.array(times, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(home.view(np.int64)), pa.array(parts > 0)], names=names)

    return docs.mapInArrow(count, "lang string, term binary, n long, home long, divided boolean")


class Stack:
    """Counts of the prefixes of sorted suffixes of one language.

    It holds the words of the present suffix and the count of each of its prefixes so far. A lot of
    suffixes is taken at a time: what its first suffixes share with the stack goes on, all runs of equal prefixes
    that end within the lot are closed and counted, and the prefixes of its last suffix become the stack.
    """

    def __init__(self, least: int) -> None:
        self.least, self.words, self.counts, self.divided = least, [], [], False

    def closed(self, depth: np.ndarray, totals: np.ndarray, divided: np.ndarray) -> np.ndarray:
        """Which prefixes are handed on: frequent ones of two words or more, and those of which other tasks may hold more."""
        return (depth > 1) & ((totals >= self.least) | (divided & (depth == 2)))

    def rest(self) -> tuple[pa.Array, pa.Array]:
        """The prefixes on the stack, which nothing follows."""
        depth = np.arange(1, len(self.words) + 1)
        keep = np.flatnonzero(self.closed(depth, np.array(self.counts, np.int64), np.full(len(depth), self.divided)))
        return pa.array([b"\0".join(self.words[: k + 1]) for k in keep], pa.binary()), pa.array([self.counts[k] for k in keep], pa.int64())

    def take(self, terms: pa.Array, n: np.ndarray, divided: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The prefixes that end within these suffixes, and their counts."""
        # The stack's own suffix comes first, without a count; what its prefixes have so far is added below.
        terms = pa.concat_arrays([pa.array([b"\0".join(self.words)], pa.binary()), terms])
        n, divided = np.append(0, n), np.append(self.divided, divided)
        split = pc.split_pattern(terms, b"\0")
        offsets, coded = split.offsets.to_numpy().astype(np.int64), split.values.dictionary_encode()
        codes, starts, sizes = coded.indices.to_numpy().astype(np.int64), offsets[:-1], np.diff(offsets)
        if not self.words:
            sizes[0] = 0
        same = np.ones(len(sizes), bool)
        same[0] = False
        out_starts, out_depth, out_n, words, counts = [], [], [], [], []
        for k in range(int(sizes.max())):
            has = sizes > k
            code = codes[np.where(has, starts + k, 0)]
            same[1:] &= has[1:] & has[:-1] & (code[1:] == code[:-1])
            opens = np.flatnonzero(has & ~same)
            totals = np.add.reduceat(np.where(has, n, 0), opens)
            if k < len(self.words):
                totals[0] += self.counts[k]
            if has[-1]:  # the last run goes on
                words.append(coded.dictionary[code[-1]].as_py())
                counts.append(int(totals[-1]))
                opens, totals = opens[:-1], totals[:-1]
            keep = self.closed(np.full(len(opens), k + 1), totals, divided[opens])
            out_starts.append(starts[opens[keep]])
            out_depth.append(np.full(int(keep.sum()), k + 1))
            out_n.append(totals[keep])
        self.words, self.counts, self.divided = words, counts, bool(divided[-1])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return _together(coded.dictionary, codes, join(out_starts), join(out_depth)), pa.array(join(out_n), pa.int64())


def _prefixes(rows: DataFrame, least: int) -> DataFrame:
    """Counts of all prefixes of two words or more of the suffixes (lang, term, n, divided), sorted in reverse: lang, term, n.

    A stack for each language counts them. Prefixes below `least` go, unless their
    first word is divided over tasks and they are so short that other tasks may hold more of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[str, Stack] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            of, n, divided = coded.indices.to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(of == k)
                yield _lot(lang, *stacks.setdefault(lang, Stack(least)).take(batch.column(1).take(pa.array(at)), n[at], divided[at]))
        for lang, stack in stacks.items():
            yield _lot(lang, *stack.rest())

    return rows.mapInArrow(count, "lang string, term binary, n long")


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words with at least `least` occurrences, and the number of all words: (lang, phrase, words, f) and (lang, n).

    A first pass counts words, a second one hashes of neighbouring words. No phrase with a rarer word or pair can reach `least`, so these
    end a run, by bit filters of fixed size whose false hits change nothing. Suffixes are counted in lots,
    dealt by language and first word (a very common first word, by its first three words), and sorted.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words = materialize(_words(texts).groupBy("lang", "term").agg(F.sum("n").alias("n")))
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= least)
    everything = totals.agg(F.sum("n")).first()[0] or 0
    # At most HOT_SHARE words have so large a share.
    hot = frequent.where(F.col("n") * HOT_SHARE > everything).select("lang", "term", F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, everything))).cast("int").alias("parts")).collect()
    often = _bits(frequent.select(F.xxhash64("lang", "term").alias("h")))
    pairs = _word_pairs(texts, often).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")
    suffixes = _suffixes(texts, often, _bits(pairs), {(r["lang"], bytes(r["term"])): r["parts"] for r in hot}, longest)
    dealt = suffixes.repartition("lang", "home").select("lang", "term", "n", "divided").sortWithinPartitions(F.desc("term"))
    counted = _prefixes(dealt, least).groupBy("lang", "term").agg(F.sum("n").alias("f")).where(F.col("f") >= least).unionByName(frequent.withColumnRenamed("n", "f"))
    text = F.col("term").cast("string")
    phrase = F.replace(F.replace(F.replace(text, F.lit("\0"), F.lit(" ")), F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))
    phrases = counted.select("lang", phrase.alias("phrase"), "f").withColumn("words", F.split("phrase", " "))
    return materialize(phrases), totals


def _said(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, most: int = 2_000) -> DataFrame:
    """The `most` best phrases of 2 to `longest` words of each language, by how much more often they occur than their parts allow.

    Returns lang, rank, phrase, a, l, r, n, score: a = f(phrase); the cut with the lowest score
    floor(2000000 a / (l + r)) counts, l and r being the frequencies of its parts. Phrases inside a longer
    one that makes up 80 % of them go. Null languages are `und`, null texts empty; ids play no part, so repeated rows
    count as often as they occur; other columns are ignored; an empty table gives no rows. Texts are read whole.
    """
    phrases, totals = phrase_counts(docs, text_col=text_col, lang_col=lang_col, longest=longest, least=least)
    candidates = phrases.where(F.size("words") >= 2)
    words, size = F.col("words"), F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _said(words, i, m))))
    longer = candidates.where(size >= 3).select(F.col("lang").alias("__lang"), "f", F.explode(inner).alias("__inner")).groupBy("__lang", "__inner").agg(F.max("f").alias("__longer"))
    kept = candidates.join(longer, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__inner")), "left")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    kept = kept.where(F.col("__longer").isNull() | (exact("__longer") * 100 < exact("f") * 80)).select("lang", "phrase", "words", F.col("f").alias("a"))

    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _said(words, 1, F.col("k")).alias("head"), _said(words, F.col("k") + 1, size - F.col("k")).alias("tail"))
    parts = sized(phrases.where(size < longest).select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("f").alias("__f")))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts, (F.col("lang") == F.col("__lang")) & (F.col(side) == F.col("__part"))).withColumn(name, F.col("__f")).drop("__lang", "__part", "__f", side)
    score = F.expr("(cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut")).select("lang", "phrase", "cut.*")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each of 64 shares of a language, so that no task reads a language whole.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    few = scored.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= most).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(sized(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
