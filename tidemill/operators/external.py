"""External models as maps over columns, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import values
from tidemill.operators import sequences

#: Texts to vectors (n, size); and prompts to replies. A call may raise: Spark retries the task.
Embedder = Callable[[Sequence[str]], np.ndarray]
TextModel = Callable[[Sequence[str]], Sequence[str]]

#: Texts of one call of an embedder.
LOT = 256


class HashEmbedder:
    """EXT-01: a stand-in: word hashes summed into a unit vector. Equal texts give equal vectors, shared words nearby ones."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = hashlib.md5(w.encode()).digest()
                row[int.from_bytes(h[:4], "big") % self.size] += 1 if h[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(text: Column, model: Embedder) -> Column:
    """EXT-01, EXT-03: vectors of a text column, LOT texts of an Arrow batch a call at most; null and blank texts have none."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            some = [k for k, t in enumerate(s) if isinstance(t, str) and t.strip()]
            for start in range(0, len(some), LOT):
                lot = some[start : start + LOT]
                for k, made in zip(lot, np.asarray(model([s.iat[k] for k in lot]), np.float64), strict=True):
                    out[k] = made
            yield pd.Series(out, index=s.index, dtype=object)

    return run(text)


def embed_long(rows: DataFrame, id_col: str, text_col: str, model: Embedder, size: int, tokens: int = 1500) -> DataFrame:
    """EXT-02, MSC-07: (id, v, pieces): texts split into overlapping pieces, each embedded, the vectors averaged and made unit."""
    from tidemill.functions.vectors import mean_vector, normalized

    pieces = sequences.split_rows(rows, id_col, text_col, lambda t: sequences.overlapping_pieces(t, tokens))
    vectors = pieces.select("id", embed(F.col("text"), model).alias("v")).where("v is not null")
    return vectors.groupBy("id").agg(mean_vector(F.col("v"), size).alias("m"), F.count("*").alias("pieces")).select("id", normalized(F.col("m")).alias("v"), "pieces")


def ask(prompt: Column, model: TextModel) -> Column:
    """EXT-05, 06, 07: replies to prompts, an Arrow batch a call; null prompts have none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            made = iter(model(s[s.notna()].tolist()) if s.notna().any() else ())
            yield pd.Series([next(made) if x else None for x in s.notna()], index=s.index, dtype=object)

    return run(prompt)


def ask_rows(prompt: Column, model: TextModel, need: str, schema: str) -> Column:
    """EXT-05, EXT-08, FN-05: rows (array of a struct schema) of a reply: those that parse, from broken JSON too."""
    found = values.salvage(ask(prompt, model), need)
    return F.filter(F.transform(found, lambda t: F.from_json(t, schema)), lambda r: r.isNotNull())


def stitched(items: DataFrame, group: str, replies: DataFrame, allowed: Sequence[str], default: str) -> DataFrame:
    """FN-15, VEC-18: items (group, place, ...) with `label` from replies (group, labels array) by place; none, unknown or missing give the default."""
    each = replies.select(F.col(group).alias("__g"), F.posexplode("labels").alias("__p", "__label"))
    joined = items.join(each, (F.col(group) == F.col("__g")) & (F.col("place") == F.col("__p")), "left")
    return joined.withColumn("label", F.when(F.col("__label").isin(*allowed), F.col("__label")).otherwise(F.lit(default))).drop("__g", "__p", "__label")


def echo(texts: Sequence[str]) -> list[str]:
    """A stand-in text model: the prompt's words and length as JSON."""
    return [json.dumps({"patterns": [{"title": t.split()[0] if t.split() else "", "n": str(len(t))}]}, ensure_ascii=False) for t in texts]
