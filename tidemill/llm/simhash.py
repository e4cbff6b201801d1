"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import materialize, sized
from .graph import connected_components

SEED = 42
#: Members of one key up to which pairs are formed by a join; larger groups are walked in blocks.
PAIR_GROUP = 8
#: Members of a block of a larger group; two blocks are held by a task at a time.
BLOCK = 4096
#: Rounds whose ranks, eight times as many each, cover the rows of two blocks and more.
MAX_RANK_ROUNDS = 10

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, repeats included; of all words if they are fewer.

    A-Z are lower-cased, words end at ASCII white space and are joined by spaces.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """Other hashes made of hashes (the splitmix64 finalizer)."""
    h = h + _MIX
    h = (h ^ (h >> np.uint64(30))) * _MUL1
    h = (h ^ (h >> np.uint64(27))) * _MUL2
    return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint words: bit b of word j is 1 if set in over half of hashes[:, j]. Shape (n, j) to (j,)."""
    n, j = hashes.shape
    if not n:
        return np.zeros(j, np.uint64)
    counts = np.zeros(j * 64, np.int64)
    step = 255 * 16  # counts of 255 rows fit a byte, which keeps the sums vectorized
    for lo in range(0, n, step):
        bits = np.unpackbits(hashes[lo : lo + step].view(np.uint8).reshape(-1, j * 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, j * 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        if whole < len(bits):
            counts += bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


@dataclass(frozen=True)
class Fingerprint:
    """What is compared.

    shingle: words in a shingle. key_words: 64-bit words of the fingerprint that keys
    are made of. check_words: further words, of shingles of check_shingle words, that
    candidates are verified by (0: the key words themselves). max_bits: differing bits
    up to which two documents link. segments: (first bit, bits). pairs: two segments
    that a key joins, and whether the first enters as it is or by its fuzzy keys.
    similar: with it, what links by bits is only a candidate, and holds if the sets of
    shingles of shingle + 2 words have a Jaccard similarity of that fraction or more; the further
    words are then of that set. more_words: words of a longer fingerprint of that set, which
    only members of large groups get, and which may differ in more_bits bits there.
    """

    shingle: int = 3
    key_words: int = 1
    check_words: int = 0
    max_bits: int = 2
    segments: tuple[tuple[int, int], ...] = ((0, 22), (22, 21), (43, 21))
    pairs: tuple[tuple[int, int, bool], ...] = ((0, 1, True), (1, 2, True), (2, 0, True))
    similar: tuple[int, int] | None = None
    more_words: int = 0
    more_bits: int = 0

    @property
    def width(self) -> int:
        return self.key_words + self.check_words + (2 if self.similar else 0)

    def wide_set(self, text: str, h: np.ndarray) -> np.ndarray:
        """The set of shingles of shingle + 2 words, as sorted hashes; h holds those of shingle words."""
        # A shingle of shingle + 2 words is settled by the first and the last it contains.
        return np.unique(mixed(h[:-2] * _MUL2 ^ h[2:]) if len(h) > 2 else shingle_hashes(text, self.shingle + 2))

    def of_set(self, wide: np.ndarray, words: int) -> np.ndarray:
        columns = [wide]
        for _ in range(words - 1):
            columns.append(mixed(columns[-1]))
        return majority(np.stack(columns, 1))

    def words(self, text: str) -> np.ndarray:
        h = shingle_hashes(text, self.shingle)
        columns = [h]
        for _ in range(self.key_words - 1):
            columns.append(mixed(columns[-1]))
        out = [majority(np.stack(columns, 1))]
        if self.similar:
            from xxhash import xxh3_128_digest

            wide = self.wide_set(text, h)
            out += [self.of_set(wide, self.check_words), np.frombuffer(xxh3_128_digest(wide.tobytes(), SEED), np.uint64)]
        return np.concatenate(out)

    def checked(self, words: np.ndarray) -> np.ndarray:
        return words[:, self.key_words : self.key_words + self.check_words] if self.check_words else words[:, : self.key_words]

    @property
    def exhaustive(self) -> bool:
        """Whether keys miss no link: three segments, two errors at most, the first of a key's segments exact."""
        return self.max_bits <= 2 and len(self.segments) == 3 and not self.check_words and all(exact for _, _, exact in self.pairs)

    def segment_values(self, words: np.ndarray) -> list[np.ndarray]:
        out = []
        for at, size in self.segments:
            word, off = divmod(at, 64)
            value = words[:, word] >> np.uint64(off)
            if off + size > 64:
                value |= words[:, word + 1] << np.uint64(64 - off)
            out.append((value & np.uint64((1 << size) - 1)).astype(np.int64))
        return out

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Keys of fingerprints (n, words): a row for each fingerprint, padded with -1."""
        segment = self.segment_values(words)
        fuzzy = {j: golay.keys(segment[j]) for a, b, exact in self.pairs for j in ((b,) if exact else (a, b))}
        parts = []
        for number, (a, b, exact) in enumerate(self.pairs):
            left = segment[a][:, None] if exact else fuzzy[a]
            both = (left[:, :, None] << 12 | fuzzy[b][:, None, :]).reshape(len(words), -1)
            valid = ((left >= 0)[:, :, None] & (fuzzy[b] >= 0)[:, None, :]).reshape(len(words), -1)
            parts.append(np.where(valid, both << 4 | number, -1))
        return np.concatenate(parts, 1)


#: Fingerprints of 64 bits that link at 2 differing bits or fewer. With at most 2
#: errors in three segments one has none, and in the next there are at most 2, which
#: its fuzzy keys bridge: the exact segment with each fuzzy key of the next is a
#: key of about 33 bits, and no link is lost.
EXACT = Fingerprint()


def _cyclic(n: int) -> tuple[tuple[int, int, bool], ...]:
    return tuple((i, (i + 1) % n, False) for i in range(0, n, 2))


#: Documents whose shingles of five words are similar by 0.8 or more (Jaccard): about
#: 15 % of the bits of such fingerprints differ, and 12 % of those of
#: three words. Keys join the fuzzy keys of two 23-bit segments of the latter,
#: five times over. 128 bits of the former, of which 19.4 differ at 0.8 (deviation 4.1),
#: leave out what cannot link; in large groups 2,048 bits do, of which 310.3 differ at 0.8
#: (deviation 16.2; 364 is passed by 999 of 1,000 there, and by one of 20 at 0.7), and the shingle sets themselves decide.
SIMILAR = Fingerprint(shingle=3, key_words=4, check_words=2, max_bits=36, segments=tuple((23 * k, 23) for k in range(10)), pairs=_cyclic(10), similar=(4, 5), more_words=32, more_bits=364)


def longer_fingerprints(nodes: DataFrame, docs: DataFrame, kind: Fingerprint, *, id_col: str, text_col: str) -> DataFrame:
    """(rep, w): kind.more_words words of the shingle set of each text of the given ids (rep); other texts are not read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.zeros((batch.num_rows, kind.more_words), np.uint64)
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                words[k] = kind.of_set(kind.wide_set(text, shingle_hashes(text, kind.shingle)), kind.more_words)
            w = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * kind.more_words, pa.int32()), pa.array(words.view(np.int64).ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), w], names=["rep", "w"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(sized(materialize(nodes)), "rep", "left_semi")
    return texts.mapInArrow(read, "rep long, w array<long>").dropDuplicates()


def fingerprints(docs: DataFrame, kind: Fingerprint, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp, an array of 64-bit words, of each document. Null text has no words."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.ArrayType(T.LongType()))])
    width = kind.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.zeros((batch.num_rows, width), np.uint64)
            for k, text in enumerate(batch.column(1)):
                words[k] = kind.words(text.as_py() or "")
            flat = pa.array(words.view(np.int64).ravel(), pa.int64())
            fp = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(read, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).view(np.uint64).reshape(-1, width)


def distance(a: Column, b: Column, width: int) -> Column:
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for k in range(1, width):
        out = out + F.bit_count(a[k].bitwiseXOR(b[k]))
    return out


def walk(ids: np.ndarray, words: np.ndarray, other: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked among the rows of one or two blocks.

    Breadth first from each row not reached yet: the rows within max_bits of the
    one at hand that were not reached so far become its children. So each row
    is compared until it is reached, one edge per row comes out, and rows in
    reach of each other end up connected, without listing their pairs.
    With two blocks (other tells them apart) only pairs across count.
    """
    edges: list[tuple[int, int]] = []
    left = np.arange(len(ids))
    across = bool(other.any()) and not bool(other.all())
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(words[left] ^ words[x]).sum(1, dtype=np.int64) <= max_bits
            if across:
                near &= other[left] != other[x]
            found, left = left[near], left[~near]
            edges += [(int(ids[x]), int(ids[y])) for y in found]
            queue += found.tolist()
    return edges


def remaining(ids: np.ndarray, words: np.ndarray, other: np.ndarray, start: np.ndarray, now: np.ndarray, max_bits: int, ranks: tuple[int, int]) -> tuple[list[tuple[int, int]], bool]:
    """Candidates not settled by the links found so far, and whether later ranks hold more.

    start and now are the components after the walk and at present. Rows outside the
    commonest first component look at the rows within max_bits of theirs in a fixed
    order, of which those of the given ranks are due, unless linked by now. So each
    candidate between two components comes up once, and few do before a row is linked.
    """
    names, sizes = np.unique(start, return_counts=True)
    across = bool(other.any()) and not bool(other.all())
    found: list[tuple[int, int]] = []
    more = False
    for x in np.flatnonzero(start != names[sizes.argmax()]):
        near = (np.bitwise_count(words ^ words[x]).sum(1, dtype=np.int64) <= max_bits) & (start != start[x])
        if across:
            near &= other != other[x]
        y = np.flatnonzero(near)
        apart = now[y] != now[x]
        found += [(int(ids[x]), int(ids[k])) for k in y[ranks[0] : ranks[1]][apart[ranks[0] : ranks[1]]]]
        more = more or bool(apart[ranks[1] :].any())
    return found, more


def verified(pairs: DataFrame, docs: DataFrame, kind: Fingerprint, *, id_col: str, text_col: str) -> DataFrame:
    """The candidates (u, v) whose texts' shingle sets are as similar as kind.similar or more; rows that share an id count each."""
    nodes = sized(materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            sets = [kind.wide_set(t, shingle_hashes(t, kind.shingle)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(nodes, "node", "left_semi")
    sets = materialize(texts.mapInArrow(read, "node long, s array<long>").dropDuplicates())
    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    over, under = kind.similar
    common = F.size(F.array_intersect("a", "b"))
    holds = common * (over + under) >= (F.size("a") + F.size("b")) * over
    return pairs.join(a, "u").join(b, "v").where(holds).select("u", "v").distinct()


def fingerprint_links(reps: DataFrame, kind: Fingerprint, verify: Callable[[DataFrame], DataFrame] | None = None, longer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (u, v) between the ids of distinct fingerprints (rep, fp), enough to connect all that link.

    Keys with few members form pairs in a join that compares before it emits.
    Keys with more are counted off first. Where keys miss no link, a key of more than a block is
    divided by the fuzzy keys of its third segment, which two linked members share too: what is
    left together then is bounded by the code, whatever the table. Groups are dealt into blocks of
    bounded size by a hash of the id, and each block and each two blocks of a group are walked by a
    task of their own: exact at any size of a group, and linear in edges.

    With longer, members of such groups are compared by longer fingerprints, which it gives for ids.
    With verify, links are candidates until it has let them pass. Where some of a
    walk's did not, rows may be connected by others: those between
    components that are still apart follow in rounds, each verified.
    """
    width = kind.check_words or kind.key_words
    wide, bits = (kind.more_words, kind.more_bits) if longer else (width, kind.max_bits)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("w", T.ArrayType(T.LongType()))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = kind.width
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                words = _matrix(part.column("fp"), full)
                keys = kind.keys(words)
                rows = np.nonzero(keys >= 0)[0]
                flat = pa.array(kind.checked(words)[rows].view(np.int64).ravel(), pa.int64())
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keys >= 0], pa.int64()), part.column("rep").take(pa.array(rows)), w], names=schema.names)

    def across(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("rep")  # so that a row's edges in several keys tend to be the same
        ids, words = np.asarray(batch["rep"]), _matrix(batch["w"], wide)
        other = np.asarray(batch["block"]) != batch["lo"][0].as_py()
        edges = walk(ids, words, other, bits)
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column("key"))
            values = kind.segment_values(_matrix(batch.column("w"), width))
            other = np.array([3 - a - b for a, b, _ in kind.pairs])[key & 15] if len(key) else np.zeros(0, np.int64)
            subs = golay.keys(np.stack(values)[other, np.arange(len(key))]) if len(key) else np.zeros((0, 1), np.int64)
            row, column = np.nonzero(subs >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(subs[row, column], pa.int64()), batch.column("rep").take(pa.array(row)), batch.column("w").take(pa.array(row))], names=["key", "sub", "rep", "w"])

    keyed = materialize(reps.select("rep", "fp").mapInArrow(spread, schema))
    many = materialize(keyed.groupBy("key").count().where(F.col("count") > PAIR_GROUP).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")))
    many = sized(many)
    few = keyed.join(many, "key", "left_anti")
    a, b = few.alias("a"), few.alias("b")
    near = distance(F.col("a.w"), F.col("b.w"), width) <= kind.max_bits
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & near).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    large = keyed.join(many, "key").withColumn("sub", F.lit(0).cast("long"))
    if kind.exhaustive:
        # Members of a key that fill several blocks are told apart by the segment that is not in it.
        sub = large.where("blocks > 1").select("key", "rep", "w").mapInArrow(divide, "key long, sub long, rep long, w array<long>")
        sub = materialize(sub)
        sizes = sub.groupBy("key", "sub").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
        columns = ["key", "sub", "rep", "w", "blocks"]
        large = large.where("blocks = 1").select(*columns).unionByName(sub.join(sized(materialize(sizes)), ["key", "sub"]).select(*columns))
    if longer:
        large = large.drop("w").join(longer(large.select("rep").distinct()), "rep")
    dealt = large.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "sub", "rep", "w", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("key", "sub", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "rep", "w")
    dealt = materialize(dealt)
    walked = dealt.groupBy("key", "sub", "lo", "hi").applyInArrow(across, "u long, v long")
    if verify is None:
        return pairs.unionByName(walked).distinct()

    def rest(ranks: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
        def of(batch: pa.Table) -> pa.Table:
            batch = batch.sort_by("rep")
            ids, words = np.asarray(batch["rep"]), _matrix(batch["w"], wide)
            other = np.asarray(batch["block"]) != batch["lo"][0].as_py()
            edges, more = remaining(ids, words, other, np.asarray(batch["start"]), np.asarray(batch["now"]), bits, ranks)
            # A row without ends says that this group holds more.
            edges = edges + [(None, None)] * more
            columns = {"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())}
            return pa.table(columns | {c: pa.array([batch[c][0].as_py() if len(edges) else None] * len(edges), batch[c].type) for c in group})

        return of

    group = ["key", "sub", "lo", "hi"]
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    found = materialize(verify(materialize(ordered(pairs.unionByName(walked)))))
    if many.isEmpty():
        return found
    start = None
    for k in range(MAX_RANK_ROUNDS):
        ranks = (8**k if k else 0, 8 ** (k + 1))
        now = materialize(connected_components(found))
        # What is linked so far is as well said by each node's component.
        found = now.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        here = now.select(F.col("node").alias("rep"), F.col("component").alias("now"))
        start = here.withColumnRenamed("now", "start") if start is None else start
        # One row per linked node: the members of groups meet both components in one join.
        state = sized(materialize(here.join(start, "rep", "left").select("rep", F.coalesce("start", "rep").alias("start"), "now")))
        placed = dealt.join(state, "rep", "left").withColumn("start", F.coalesce("start", "rep")).withColumn("now", F.coalesce("now", "rep"))

        due = materialize(placed.groupBy(*group).applyInArrow(rest(ranks), "u long, v long, key long, sub long, lo int, hi int"))
        found = materialize(found.unionByName(verify(materialize(ordered(due.where("u is not null").select("u", "v"))))))
        # Groups that hold no more candidates between components are done: the next round reads the others only.
        unfinished = materialize(due.where("u is null").select(*group).distinct())
        if unfinished.isEmpty():
            return found
        dealt = dealt.join(sized(unfinished), group, "left_semi")
    raise RuntimeError("groups were not walked to the end")


def near_duplicates(docs: DataFrame, *, kind: Fingerprint = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (words of the fingerprint) and component_id, the smallest doc_id reachable by links.

    Documents link if the verified words of their fingerprints differ in
    kind.max_bits bits or fewer and, with kind.similar, their shingle sets are that similar. Equal fingerprints are one from the start, so copies, however many,
    cost nothing after that. Ids must be integers; a row with a null id keeps
    a null component of its own and links nothing. Rows of equal id are one document
    if their texts are; else their fingerprints link through the id. Empty and null texts
    have the fingerprint zero, which links like any other. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, kind, id_col=id_col, text_col=text_col))
    reps = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")))
    verify = (lambda pairs: verified(pairs, docs, kind, id_col=id_col, text_col=text_col)) if kind.similar else None
    longer = (lambda nodes: longer_fingerprints(nodes, docs, kind, id_col=id_col, text_col=text_col)) if kind.more_words else None
    links = fingerprint_links(reps, kind, verify, longer)
    # One id with several texts: its rows are one node.
    same_id = prints.where("doc_id is not null").join(reps, "fp").select(F.col("doc_id").cast("long").alias("u"), F.col("rep").alias("v"))
    twice = same_id.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").select("u")
    links = links.unionByName(same_id.join(twice, "u", "left_semi"))
    components = connected_components(links)
    found = reps.join(components, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(found, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, kind: Fingerprint = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: that of the smallest id.

    Rows with a null id stay, as do all rows that share a kept id and, among documents
    with words, nothing else is dropped. Documents without words are copies of each other only.
    """
    groups = near_duplicates(docs, kind=kind, id_col=id_col, text_col=text_col)
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, docs[id_col] == F.col("__dropped"), "left_anti")
