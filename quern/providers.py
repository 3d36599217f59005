"""Embedders and rerankers: protocols, and offline ones for tests and static tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import errors


class Embedder(Protocol):
    """Ordered batches of documents, and queries by a way of their own."""

    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class Reranker(Protocol):
    """One score for each passage, in order."""

    def rerank(self, query: str, passages: list[str]) -> list[float]: ...


class HashEmbedder:
    """Counts of lower-case words by a hash of their bytes: no model, but stable."""

    def __init__(self, dimensions: int = 8) -> None:
        self.dimensions = dimensions

    def _one(self, text: str) -> np.ndarray:
        out = np.zeros(self.dimensions, np.float32)
        for word in sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split())):
            h = 0
            for b in word.encode():
                h = (h * 31 + b) & 0xFFFFFFFFFFFFFFFF
            out[h % self.dimensions] += 1
        return out

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        return np.stack([self._one(t) for t in texts]) if texts else np.zeros((0, self.dimensions), np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self._one(text)


class StaticEmbedder:
    """The normalized mean of a table's rows for a text's tokens, unknown ones left out."""

    def __init__(self, table: np.ndarray, tokenize: Callable[[str], list[int]], unknown: int | None = None, max_tokens: int = 16_384) -> None:
        self.table, self.tokenize, self.unknown, self.max_tokens = table.astype(np.float32), tokenize, unknown, max_tokens
        self.dimensions = table.shape[1]

    def embed_query(self, text: str) -> np.ndarray:
        ids = [i for i in self.tokenize(text) if i != self.unknown][: self.max_tokens]
        mean = self.table[ids].mean(axis=0) if ids else np.zeros(self.dimensions, np.float32)
        norm = float(np.linalg.norm(mean))
        if not np.isfinite(norm) or norm <= np.finfo(np.float32).eps:
            raise errors.NonFinite("a text without known tokens has no direction")
        return mean / norm

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.embed_query(t) for t in texts])


def windows(tokens: int, size: int = 256, overlap: int = 32) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` tokens, each after the first beginning ``overlap`` before the last one's end."""
    if not 0 <= overlap < size:
        raise errors.InvalidValue("the overlap must be smaller than the window")
    out, at = [], 0
    while at < tokens:
        out.append((at, min(tokens, at + size)))
        if out[-1][1] == tokens:
            break
        at += size - overlap
    return out


class WindowedEmbedder:
    """Texts of any length by a model of bounded input: windows, their mean weighted by tokens, unit length.

    ``encode`` gives a text's token ids, ``model`` a vector for each of a batch of id
    lists.  Windows of all texts are sorted by length, so a batch holds little padding;
    their order is restored.  A text without tokens is an error.
    """

    def __init__(self, encode: Callable[[str], list[int]], model: Callable[[list[list[int]]], np.ndarray], dimensions: int, size: int = 256, overlap: int = 32, batch: int = 32) -> None:
        self.encode, self.model, self.dimensions = encode, model, dimensions
        self.size, self.overlap, self.batch = size, overlap, batch

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        parts = [(i, ids[a:b]) for i, t in enumerate(texts) for ids in [self.encode(t)] for a, b in windows(len(ids), self.size, self.overlap)]
        total, weight = np.zeros((len(texts), self.dimensions)), np.zeros(len(texts))
        order = sorted(range(len(parts)), key=lambda p: len(parts[p][1]))
        for a in range(0, len(order), self.batch):
            some = [parts[p] for p in order[a : a + self.batch]]
            for (i, ids), v in zip(some, np.asarray(self.model([ids for _, ids in some]), np.float64)):
                total[i] += v * len(ids)
                weight[i] += len(ids)
        if len(texts) and not weight.all():
            raise errors.EmptyValue("a text without tokens can't be embedded")
        mean = total / np.maximum(weight, 1)[:, None]
        norms = np.linalg.norm(mean, axis=1)
        if not (np.isfinite(norms) & (norms > np.finfo(np.float32).eps)).all():
            raise errors.NonFinite("a text has no direction")
        return (mean / norms[:, None]).astype(np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]


def embed(docs: DataFrame, embedder: Embedder, text_col: str = "content", batch: int = 128) -> DataFrame:
    """``docs`` with ``embedding``; texts are grouped by length within a batch, and order is restored."""
    sent = docs.sparkSession.sparkContext.broadcast(embedder)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(at).to_pylist()
            out: list[np.ndarray | None] = [None] * len(texts)
            order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts[i]))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                got = np.asarray(sent.value.embed_batch([texts[j] for j in some]), np.float32)
                if got.shape != (len(some), sent.value.dimensions):
                    raise errors.DimensionMismatch(f"{got.shape} for {len(some)} texts")
                if not np.isfinite(got).all():
                    raise errors.NonFinite("an embedder returned a value that isn't finite")
                for j, v in zip(some, got):
                    out[j] = v
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([None if v is None else v.tolist() for v in out], pa.list_(pa.float32()))], schema.names)

    return docs.mapInArrow(run, schema)


def scorer(reranker: Reranker) -> Callable[[Column, Column], Column]:
    """A reranker as a scorer of query and passage columns; passages of one query in a batch go together."""

    @F.pandas_udf("float")
    def score(query: pd.Series, passage: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=query.index)
        for text, rows in query.groupby(query).groups.items():
            got = reranker.rerank(text, passage.loc[rows].tolist())
            if len(got) != len(rows):
                raise errors.RetrieverError(f"{len(got)} scores for {len(rows)} passages")
            out.loc[rows] = got
        return out.astype("float32")

    return score
