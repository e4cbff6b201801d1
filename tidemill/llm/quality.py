"""Quality by an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sized

#: Characters in an n-gram. Every code point is a symbol of its own.
ORDER = 5
#: Stands before the first character of a text.
START = "\x02"
#: Characters of a text that a task handles at a time.
CHUNK = 2_000_000
#: N-grams, at most, whose probabilities tasks hold themselves: the commonest. All others are joined.
HEAD = 1 << 20
#: Steps of a doubling by which counts are told apart to find the commonest.
STEPS = 16

_MUL = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    """Code points, with START ones ahead; a NUL counts as the character after it."""
    points = np.frombuffer((START * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points == 0, np.uint32(1), points)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """64 bits for each run of ORDER code points."""
    n = len(points) - ORDER + 1
    h = np.zeros(n, np.uint64)
    for k in range(ORDER):
        h = (h + points[k : k + n]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def gram_strings(points: np.ndarray, at: np.ndarray) -> list[str]:
    """The runs of ORDER code points that begin at the given places."""
    return points[at[:, None] + np.arange(ORDER)].astype("<u4").view(f"<U{ORDER}").ravel().tolist() if len(at) else []


def stretches(text: str) -> Iterator[np.ndarray]:
    """Code points of a text in stretches of at most CHUNK n-grams; each n-gram is in one."""
    points = code_points(text)
    for lo in range(0, len(points) - ORDER + 1, CHUNK):
        yield points[lo : lo + CHUNK + ORDER - 1]


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, c): counts of n-grams of the full order in column text, over all rows; counted in tasks, then by gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            # Texts follow one another; n-grams that reach over a seam do not count.
            points = np.concatenate(held)
            ends = np.cumsum([len(p) for p in held])
            inside = np.ones(len(points) - ORDER + 1, bool)
            for end in ends[:-1]:
                inside[end - ORDER + 1 : end] = False
            at = np.flatnonzero(inside)
            _, first, c = np.unique(gram_hashes(points)[at], return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram_strings(points, at[first]), pa.string()), pa.array(c, pa.int64())], names=["gram", "c"])

        size = 0
        for batch in batches:
            for text in batch.column(0):
                for points in stretches(text.as_py() or ""):
                    held.append(points)
                    size += len(points)
                    if size >= CHUNK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


class Model:
    """A table per order, in hash shards: p (gram, p), and back (context, back); and the mass of a character never seen."""

    def __init__(self, p: dict[int, DataFrame], back: dict[int, DataFrame], counts: DataFrame, unseen: float):
        self.p, self.back, self.counts, self.unseen = p, back, counts, unseen

    def head(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and log probabilities of the commonest n-grams of the full order, HEAD at most."""
        step = F.floor(F.log2("c") * STEPS).cast("int")
        room, least = HEAD, None
        for r in self.counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            room -= r["count"]
            if room < 0:
                break
            least = r["step"]
        if least is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.float32)
        found = self.p[ORDER].join(self.counts.where(step >= least).select("gram"), "gram").select("gram", F.log("p").cast("float").alias("log")).toArrow()
        grams = np.array(found["gram"].to_pylist(), f"<U{ORDER}")
        points = grams.view("<u4").reshape(-1, ORDER)
        # Laid end to end, every ORDER-th run is one of them.
        hashes = gram_hashes(points.ravel())[::ORDER] if len(points) else np.zeros(0, np.uint64)
        return hashes, np.asarray(found["log"])


def kneser_ney(counts: DataFrame) -> Model:
    """The model of n-gram counts (gram, c).

    Each order's counts are joined by the context to the context's totals,
    and by the shortened n-gram to the order below, whose counts are
    numbers of different symbols before. Discounts for counts 1, 2 and 3 or more
    follow from the counts of counts of the order. Below the first order every
    character, and one more for those never seen, is as likely as any other.
    """
    tables = {ORDER: materialize(counts.select("gram", "c"))}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = materialize(tables[n + 1].groupBy(F.right("gram", F.lit(n)).alias("gram")).agg(F.count("*").alias("c")))
    uniform = 1.0 / (tables[1].count() + 1)
    p, back = {}, {}
    for n in range(1, ORDER + 1):
        seen = {r["c"]: r["n"] for r in tables[n].where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (max(1, seen.get(k, 0)) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        cuts = [min(max(k - (k + 1) * y * above / here, 0.05), k - 0.05) for k, here, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("c") == 1, cuts[0]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[2])
        grams_n = tables[n].select("gram", "c", F.left("gram", F.lit(n - 1)).alias("context"), cut.alias("cut"))
        totals = grams_n.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("mass"))
        totals = materialize(totals.select("context", "total", (F.col("mass") / F.col("total")).alias("back")))
        own = grams_n.join(totals, "context").withColumn("own", (F.col("c") - F.col("cut")) / F.col("total"))
        if n == 1:
            probs = own.select("gram", (F.col("own") + F.col("back") * uniform).alias("p"))
        else:
            below = p[n - 1].select(F.col("gram").alias("short"), F.col("p").alias("below"))
            probs = own.withColumn("short", F.right("gram", F.lit(n - 1))).join(below, "short").select("gram", (F.col("own") + F.col("back") * F.col("below")).alias("p"))
        p[n] = materialize(probs)
        back[n] = totals.select("context", "back")
    return Model(p, back, tables[ORDER], uniform)


def log_probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, log) of distinct n-grams of the full order, by joins with the model's shards.

    What an order has seen is settled there; the rest goes on to the order below, by its
    last characters, with the back-off weight of its context.
    """
    left = grams.select("gram", F.col("gram").alias("rest"), F.lit(0.0).alias("so_far"))
    done = []
    for n in range(ORDER, 0, -1):
        table = model.p[n].select(F.col("gram").alias("rest"), F.log("p").alias("__log"))
        met = materialize(left.join(table, "rest", "left"))
        done.append(met.where("__log is not null").select("gram", (F.col("so_far") + F.col("__log")).alias("log")))
        missed = met.where("__log is null").withColumn("context", F.left("rest", F.lit(n - 1)))
        missed = missed.join(model.back[n], "context", "left")
        left = missed.select("gram", F.right("rest", F.lit(n - 1)).alias("rest"), (F.col("so_far") + F.coalesce(F.log("back"), F.lit(0.0))).alias("so_far"))
    done.append(left.select("gram", (F.col("so_far") + F.lit(float(np.log(model.unseen)))).alias("log")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out)


class Head:
    """Log probabilities of common n-grams by hash: two tables in which a hash has one place each."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        bits = max(4, int(2 * len(hashes)).bit_length())
        self.tables = []
        for shift in (0, 32):
            slot = (hashes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            keys, values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
            keys[slot], values[slot] = hashes, logs
            self.tables.append((np.uint64(shift), np.uint64((1 << bits) - 1), keys, values))
            lost = keys[slot] != hashes
            hashes, logs = hashes[lost], logs[lost]

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, and which n-grams have one here."""
        out, known = np.zeros(len(hashes), np.float32), np.zeros(len(hashes), bool)
        open_ = np.arange(len(hashes))
        for shift, mask, keys, values in self.tables:
            slot = (hashes[open_] >> shift) & mask
            hit = keys[slot] == hashes[open_]
            out[open_[hit]] = values[slot[hit]]
            known[open_[hit]] = True
            open_ = open_[~hit]
        return out, known


_heads: dict[str, Head] = {}
#: N-grams, at most, of which every task holds the joined log probability: those that most documents share.
SHARED = 100_000


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """docs less text with symbols (long) and perplexity (double; null for texts without any).

    Each document's n-grams are counted where it lies. Those that the model's bounded head holds
    are settled at once. The others, rare or never seen, are joined with the sharded
    model: first each distinct one on its way down the orders, then each document's
    counts with what came out. Of these, n-grams that many documents share are broadcast,
    a bounded number, so that none is a hot key.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model.head()))
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hashes, logs = shared.value
        if name not in _heads:  # once in the life of a worker
            _heads.clear()
            _heads[name] = Head(hashes, logs)
        head = _heads[name]
        for batch in batches:
            symbols, total, grams, counts = [], [], [], []
            for text in batch.column(batch.schema.names.index("text")):
                n, known_log, others, times = 0, 0.0, [], []
                for points in stretches(text.as_py() or ""):
                    h = gram_hashes(points)
                    log, known = head(h)
                    n += len(h)
                    known_log += float(log.sum(dtype=np.float64))
                    at = np.flatnonzero(~known)
                    if len(at):
                        _, first, c = np.unique(h[at], return_index=True, return_counts=True)
                        others += gram_strings(points, at[first])
                        times += c.tolist()
                symbols.append(n)
                total.append(known_log)
                grams.append(others)
                counts.append(times)
            columns = [*(batch.column(f.name) for f in rest), pa.array(symbols, pa.int64()), pa.array(total, pa.float64()), pa.array(grams, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), "symbols", "__known", "__grams", "__counts"])

    added = [("symbols", T.LongType()), ("__known", T.DoubleType()), ("__grams", T.ArrayType(T.StringType())), ("__counts", T.ArrayType(T.LongType()))]
    read = docs.mapInArrow(score, T.StructType([*rest, *(T.StructField(n, t) for n, t in added)]))
    read = materialize(read.withColumn("__row", F.monotonically_increasing_id()))
    each = read.select("__row", F.explode(F.arrays_zip("__grams", "__counts")).alias("x")).select("__row", F.col("x.__grams").alias("gram"), F.col("x.__counts").alias("n"))
    distinct = materialize(each.groupBy("gram").agg(F.count("*").alias("rows")))
    logs = log_probabilities(distinct, model)
    common = distinct.where("rows > 1").orderBy(F.desc("rows"), "gram").limit(SHARED).select("gram")
    common = materialize(logs.join(common, "gram").select("gram", F.col("log").alias("common")))
    met = each.join(F.broadcast(common), "gram", "left")  # SHARED rows at most
    here = met.where("common is not null").select("__row", (F.col("n") * F.col("common")).alias("l"))
    there = met.where("common is null").select("__row", "gram", "n").join(logs, "gram").select("__row", (F.col("n") * F.col("log")).alias("l"))
    joined = here.unionByName(there).groupBy("__row").agg(F.sum("l").alias("__joined"))
    log = F.col("__known") + F.coalesce("__joined", F.lit(0.0))
    scored = read.drop("__grams", "__counts").join(joined, "__row", "left").withColumn("perplexity", F.when(F.col("symbols") > 0, F.exp(-log / F.col("symbols"))))
    return scored.select(*(f.name for f in rest), "symbols", "perplexity")


def held_out(id_col: Column) -> Column:
    """A third of the ids, by crc32 of their text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def classify(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995, smoothing: float = 100.0) -> DataFrame:
    """doc_id, lang, symbols, perplexity, steady, threshold and kept for each document.

    trusted names (by column doc_id) the documents whose text is trusted. The model is
    trained on two thirds of them, whole, without a cap: all their characters and
    all their n-grams. A few words say little, so
    documents are judged by `steady`: the perplexity of the text together with
    `smoothing` symbols as usual as trusted text. A language's threshold is the given
    quantile of it among the other third, whose text the model has not seen; a language without such takes that of all languages. Documents above it are not kept.

    Empty and null texts have no perplexity and are not kept. A null lang is a
    language of its own. If there is no trusted text, nothing can be told: all
    documents with text are kept and thresholds are null. Repeated rows are scored alike. A text of any length is read whole, in
    stretches. Other columns are ignored, whatever they are called.
    """
    every = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    names = sized(materialize(trusted.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()))
    good = every.join(names, F.col("doc_id") == F.col("__id"), "left_semi")
    model = kneser_ney(count_grams(good.where(~held_out(F.col("doc_id")))))
    scored = materialize(perplexity(every, model))
    apart = scored.where(F.col("perplexity").isNotNull() & held_out(F.col("doc_id"))).join(names, F.col("doc_id") == F.col("__id"), "left_semi")
    usual = apart.agg((F.sum(F.log("perplexity") * F.col("symbols")) / F.sum("symbols")).alias("m")).first()["m"] or 0.0
    steady = F.exp((F.log("perplexity") * F.col("symbols") + usual * smoothing) / (F.col("symbols") + smoothing))
    scored, apart = scored.withColumn("steady", steady), apart.withColumn("steady", steady)
    cut = F.percentile_approx("steady", quantile, 10_000).alias("cut")
    # One row per language.
    by_lang = sized(materialize(apart.groupBy("lang").agg(cut).select(F.col("lang").alias("__lang"), "cut")))
    overall = apart.agg(cut).first()["cut"]
    judged = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("threshold", F.coalesce("cut", F.lit(overall).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("steady") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "symbols", "perplexity", "steady", "threshold", kept.alias("kept"))
