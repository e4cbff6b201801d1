"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Labelled rows that the model is fitted on, at most: those of the smallest hashed id.
TRAIN_ROWS = 20_000
#: Word beginnings of these lengths count as terms beside whole words.
STEMS = (4, 5, 6, 7)
#: A term's share of toxic documents, smoothed, from which it may vote.
PRECISION = 0.8
#: Evidence beyond that of the best term by chance: from the first on a term is strong; below it by the second at most, it is a weaker one.
STRONG, WEAKER = 4, 12
#: Terms that a task counts before it hands them on.
HELD_TERMS = 50_000
#: How many rows a labelled row stands for when it ties the classes to their meaning; what fits the labels best is taken.
TIES = (1.0, 3.0, 10.0)
#: Nats of mutual information, given the class, from which two voters are taken to depend on each other.
DEPENDS = 1e-3

#: Everyday English insults, a voter that needs no labels.
SEED_WORDS = ("bastard", "clown", "disgusting", "dumb", "filthy", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: Characters written for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_DISGUISED = re.compile(r"(?<![\w@$])(?:[^\W\d_]+[013457@$!*]+[^\W\d_]|[013457@$]+[^\W\d_])[\w@$!*]*")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-*]){3,}[^\W\d_](?!\w)")


def letters(text: str) -> str:
    """Lower-cased words of letters alone, a space before and after each."""
    return f" {_NOT_LETTERS.sub(' ', text.lower())} "


def terms_of(text: str) -> set[str]:
    """Terms of a text: ' word ' for each word, ' stem' for each of its beginnings."""
    out = set()
    for word in set(letters(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if len(word) >= n)
    return out


def disguised(text: str) -> str:
    """Words of a text that digits, signs or spacing hide, as plain letters."""
    lower = text.lower()
    found = [m[0].rstrip("!*").translate(str.maketrans(LOOKALIKE)) for m in _DISGUISED.finditer(lower)]
    found += [re.sub(r"[ .\-*]", "", m[0]) for m in _SPELLED.finditer(lower)]
    return letters(" ".join(w.replace("*", "") for w in found)) if found else ""


def shouted(text: str) -> bool:
    """Whether over 0.6 of all letters of a text are upper-case."""
    return sum(map(str.isupper, text)) > 0.6 * sum(map(str.isalpha, text))


def evidence(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    """Log-likelihood ratio of a term's counts among toxic and other documents."""
    n, total = pos + neg, n_pos + n_neg
    out = 0.0
    for a, row, col in ((pos, n, n_pos), (neg, n, n_neg), (n_pos - pos, total - n, n_pos), (n_neg - neg, total - n, n_neg)):
        if a > 0:
            out += a * math.log(a * total / (row * col))
    return 2 * out


def lexicons(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int, n_terms: int) -> dict[str, tuple[int, int]]:
    """Terms to (family, tier) from (term, toxic documents, others); tier 0 is strong, 1 weaker.

    A term is strong if its evidence is beyond what the best of n_terms terms would show by
    chance, and its smoothed share of toxic documents PRECISION or more; weaker if it
    falls short of that by WEAKER at most. Terms that begin alike are one family; a term whose
    beginning is in needs no entry.
    """
    bar = 2 * math.log(max(2, n_terms)) + STRONG
    good = [(t, evidence(p, q, n_pos, n_neg)) for t, p, q in counts if (p + 0.5) / (p + q + 1) >= PRECISION]
    kept: dict[str, tuple[int, int]] = {}
    held: set[str] = set()
    for tier in (0, 1):
        for t in sorted((t for t, e in good if (e >= bar if tier == 0 else bar - WEAKER <= e < bar)), key=lambda t: (len(t.rstrip()), t)):
            stem = t.rstrip()
            if not any(stem[:n] in held for n in range(3, len(stem) + 1)):
                kept[t] = (len(kept), tier)
                if not t.endswith(" "):
                    held.add(t)
    return kept


@dataclass
class Voters:
    """Lexicon and pattern voters over a text: 1 toxic, -1 clean, 0 no vote."""

    learned: dict[str, tuple[int, int]]
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"learned": self.learned}

    def __setstate__(self, state: dict) -> None:
        self.learned, self.automaton = state["learned"], None

    NAMES = ("words", "beginnings", "weaker_words", "weaker_beginnings", "seed_words", "several", "density", "disguised", "repeated", "outcry")
    #: Features of the classifier: each voter for, each lexicon, then counts.
    FEATURES = len(NAMES) + 5

    def find(self, spaced: str) -> list[tuple[int, int, bool]]:
        """(family, voter, seed) of each term in a spaced text; voter -1 for a seed word that was not learned."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            entries = {t: (family, 2 * tier + (not t.endswith(" ")), False) for t, (family, tier) in self.learned.items()}
            for k, w in enumerate(SEED_WORDS):
                entries.setdefault(f" {w} ", (-1 - k, -1, True))
            for t, at in entries.items():
                self.automaton.add_word(t, (*at[:2], at[2] or t.strip() in SEED_WORDS))
            self.automaton.make_automaton()
        return [hit for _, hit in self.automaton.iter(spaced)]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Votes, and the classifier's features, of a whole text."""
        spaced = letters(text)
        hits = self.find(spaced)
        hidden = self.find(disguised(text))
        families = {f for f, _, _ in hits}
        words = max(1, spaced.count(" ") - 1)
        per_hundred = 100 * len(hits) / words
        votes = np.zeros(len(self.NAMES), np.int8)
        for _, voter, _ in hits:
            if voter >= 0:
                votes[voter] = 1
        votes[4] = any(seed for _, _, seed in hits)
        votes[5] = 1 if len(families) > 1 else -1
        votes[6] = 1 if per_hundred >= 0.5 else 0 if hits else -1
        votes[7] = bool(hidden)
        votes[8] = 1 if len(hits) > max(1, len(families)) else -1
        votes[9] = bool(hits) and ("!!" in text or shouted(text))
        return votes, np.array([*(votes > 0), bool(hits), math.log1p(len(families)), math.log1p(len(hits)), math.log1p(per_hundred), 1.0], np.float64)


def dependence(votes: np.ndarray, by_class: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mutual information of each two voters given the class, from patterns of votes and their weights in either class."""
    total = sum(w.sum() for w in by_class)
    m = votes.shape[1]
    out = np.zeros((m, m))
    for w in by_class:
        for a in range(m):
            for b in range(a):
                joint = np.array([[w[(votes[:, a] == x) & (votes[:, b] == y)].sum() for y in (-1, 0, 1)] for x in (-1, 0, 1)]) + 1e-9
                p = joint / joint.sum()
                out[a, b] += w.sum() / total * (p * np.log(p / np.outer(p.sum(1), p.sum(0)))).sum()
    return out + out.T


def dependence_tree(information: np.ndarray) -> list[int]:
    """Parent of each voter in the tree of greatest dependence; -1 for the root and where dependence is slight."""
    m = len(information)
    parent, reached = [-1] * m, {0}
    while len(reached) < m:
        best, a, b = max((information[i, j], i, j) for i in reached for j in range(m) if j not in reached)
        parent[b] = a if best >= DEPENDS else -1
        reached.add(b)
    return parent


def vote_tables(votes: np.ndarray, weight: np.ndarray, parent: list[int], smooth: float = 0.5) -> list[np.ndarray]:
    """For each voter the probabilities of its votes -1, 0, 1 in one class, or, a row for each vote of its parent, given that."""
    tables = []
    for j in range(votes.shape[1]):
        alone = np.array([weight[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + smooth
        alone /= alone.sum()
        if parent[j] < 0:
            tables.append(alone)
            continue
        joint = np.array([[weight[(votes[:, parent[j]] == u) & (votes[:, j] == v)].sum() for v in (-1, 0, 1)] for u in (-1, 0, 1)]) + 2 * alone
        tables.append(joint / joint.sum(1, keepdims=True))
    return tables


def log_likelihood(votes: np.ndarray, tables: list[np.ndarray], parent: list[int]) -> np.ndarray:
    """Of each pattern of votes in the class of the tables."""
    out = np.zeros(len(votes))
    for j, t in enumerate(tables):
        out += np.log(t[votes[:, j] + 1] if parent[j] < 0 else t[votes[:, parent[j]] + 1, votes[:, j] + 1])
    return out


def label_model(votes: np.ndarray, count: np.ndarray, toxic: np.ndarray, clean: np.ndarray, tie: float = 3.0, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of toxic for each pattern of votes, by its votes alone, and what was estimated.

    count holds the rows of each pattern, of which so many are labelled toxic and clean. A hidden
    class makes the votes: each voter votes toxic, clean or not at all with probabilities
    that depend on the class (its accuracy) and on the vote of one other voter, its parent in
    the tree of greatest dependence (its correlation). The class's share and these tables are
    estimated by expectation maximization over all rows. Labels are no voter: they start the
    estimate, and rows that have one stand in their own class, `tie` times, which ties the classes to their meaning.
    """
    free = np.maximum(count - toxic - clean, 0)
    share = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
    agree = (votes > 0).sum(1)
    post = np.where(toxic + clean > 0, (toxic + share / 2) / (toxic + clean + 0.5), np.where(agree > 1, 0.9, np.where(agree > 0, 0.1, 0.02)))
    parent: list[int] = []
    tables: list[list[np.ndarray]] = []
    for step in range(rounds):
        weights = (free * (1 - post) + tie * clean, free * post + tie * toxic)
        if step % 10 == 0 and step < rounds // 2:  # then the tree stands, and each step betters the likelihood
            parent = dependence_tree(dependence(votes, weights))
        share = float((weights[1].sum() + 1) / (weights[0].sum() + weights[1].sum() + 2))
        tables = [vote_tables(votes, w, parent) for w in weights]
        odds = math.log(share / (1 - share)) + log_likelihood(votes, tables[1], parent) - log_likelihood(votes, tables[0], parent)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        settled, post = np.abs(new - post).max(initial=0) < 1e-7, new
        if settled and step % 10 != 9:
            break
    return post, {"share": share, "parent": parent, "tables": tables}


def tuned_label_model(votes: np.ndarray, count: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, dict]:
    """The label model of that of TIES whose posterior gives the labels the least surprise."""
    fits = [label_model(votes, count, toxic, clean, tie) for tie in TIES]
    surprise = [-(toxic @ np.log(np.clip(p, 1e-6, 1)) + clean @ np.log(np.clip(1 - p, 1e-6, 1))) for p, _ in fits]
    return fits[int(np.argmin(surprise))]


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Ids whose labels nobody learns from: crc32 of their text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    estimates: dict

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.voters(text)[1] @ self.weights, -30, 30))))


def find_voters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[Voters, DataFrame]:
    """Voters with the terms that labels show, and the labelled rows (text, toxic) they were found on.

    At most TRAIN_ROWS labelled documents outside the held-out third are used, those of the
    smallest hashed id. Of a document's several labels the highest counts.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(TRAIN_ROWS).select(F.col("doc_id").alias("__id"), "toxic")
    )
    # TRAIN_ROWS rows of an id and a flag: small enough for every task.
    sample = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    sample = materialize(sample.select("text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            terms = [*pos.keys() | neg.keys()]
            columns = [pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())]
            pos.clear(), neg.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "pos", "neg"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                (pos if toxic.as_py() else neg).update(terms_of(text.as_py()))
                if len(pos) + len(neg) > HELD_TERMS:
                    yield flush()
        yield flush()

    sizes = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    terms = materialize(sample.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    strong = terms.where(((F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1) >= PRECISION) & (F.col("pos") >= 3)).orderBy(F.desc("pos"), "term")
    # Terms of at most TRAIN_ROWS rows that pass the bar of evidence: all of them.
    return Voters(lexicons([tuple(r) for r in strong.select("term", "pos", "neg").collect()], n_pos, n_neg, terms.where("pos + neg >= 3").count())), sample


def cast_votes(rows: DataFrame, voters: Voters) -> DataFrame:
    """rows with votes and features in place of column text, whose null is empty."""
    rest = [f for f in rows.schema.fields if f.name != "text"]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [voters(t.as_py() or "") for t in batch.column(batch.schema.names.index("text"))]
            columns = [*(batch.column(f.name) for f in rest), pa.array([v.tolist() for v, _ in pairs], pa.list_(pa.int8())), pa.array([f.tolist() for _, f in pairs], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), "votes", "features"])

    return rows.mapInArrow(vote, T.StructType([*rest, T.StructField("votes", T.ArrayType(T.ByteType())), T.StructField("features", T.ArrayType(T.DoubleType()))]))


def fit(voters: Voters, voted: DataFrame, sample: DataFrame) -> Model:
    """The label model over the votes of all documents, and the linear classifier of its posterior.

    voted has a row of votes per document. Equal rows are counted first: what reaches the driver is
    the patterns that occur, of 3 ** 10 possible ones. The classifier is fitted on the labelled
    rows' features (sample, TRAIN_ROWS at most) with the posteriors of their votes.
    """
    # A few made-up rows of seed words keep the fit defined where labels are few or none.
    made = [(voters(t), y) for t, y in (("", 0), ("a quiet day", 0), ("you stupid idiot", 1), ("worthless scum", 1), ("such an idiot! What an idiot!!", 1))]
    rows = cast_votes(sample.select("text", (F.col("toxic") > 0).alias("toxic")), voters).toArrow()
    votes = np.array([*rows["votes"].to_pylist(), *(v for (v, _), _ in made)], np.int8)
    features = np.array([*rows["features"].to_pylist(), *(f for (_, f), _ in made)], np.float64)
    known = np.array([*rows["toxic"].to_pylist(), *(bool(y) for _, y in made)])
    counted = {tuple(r["votes"]): r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    patterns = list(dict.fromkeys([*map(tuple, votes.tolist()), *counted]))
    place = {p: k for k, p in enumerate(patterns)}
    at = np.array([place[tuple(v)] for v in votes.tolist()])
    toxic, clean = (np.bincount(at[known == flag], minlength=len(patterns)).astype(float) for flag in (True, False))
    count = np.maximum(np.array([counted.get(p, 0) for p in patterns], float), toxic + clean)
    posterior, estimates = tuned_label_model(np.array(patterns, np.int8), count, toxic, clean)
    return Model(voters, fit_linear(features, posterior[at]), estimates)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the votes on all docs and from labels (doc_id, toxic).

    Labels find terms (find_voters), and tie the label model's classes to their meaning (fit); documents
    without labels take part in the label model as they are. Without any labels the seed words remain.
    """
    voters, sample = find_voters(docs, labels, id_col=id_col, text_col=text_col)
    return fit(voters, cast_votes(docs.select(F.col(text_col).alias("text")), voters), sample)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, by its whole text, however long; null text is empty.

    Repeated rows are scored alike, each for itself; an empty table gives none; columns besides
    the id and the text are ignored, whatever they are called.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(read, schema)


def train_and_score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What score says of docs by the model trained on them, reading the texts for votes once."""
    voters, sample = find_voters(docs, labels, id_col=id_col, text_col=text_col)
    voted = materialize(cast_votes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), voters))
    weights = F.array(*[F.lit(float(w)) for w in fit(voters, voted, sample).weights])
    odds = F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return voted.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows that score threshold or more; columns unchanged, nothing shuffled.

    Null and empty texts stay, repeated rows stay or go alike, and an empty table stays empty.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
