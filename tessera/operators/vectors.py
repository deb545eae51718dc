"""Exact vector search, the hash embedder and its cache."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
"""Query vectors that are sent to the workers at once; a larger query set is searched in as many blocks as needed."""


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of the same length in double arithmetic; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` nearest by cosine for each query (``query_id``, ``vector``), exactly.

    Each block of queries is multiplied with the vectors of a partition at once, and a partition passes on only its own
    ``k`` best per query. Null and zero vectors are near nothing; ties go to the lower key.
    """
    spark = vectors.sparkSession
    ordered = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("v")).orderBy("query_id")
    parts = None
    for b in range(max(1, math.ceil(ordered.count() / BLOCK))):
        rows = ordered.offset(b * BLOCK).limit(BLOCK).collect()
        if not rows:
            break
        block = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.v for r in rows], np.float64)))

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ids, q = block.value
            qn = np.linalg.norm(q, axis=1)
            for batch in batches:
                m = np.array(batch[vector].tolist(), np.float64)
                keys = batch[key].to_numpy()
                if not len(m):
                    continue
                norms = np.linalg.norm(m, axis=1)
                with np.errstate(all="ignore"):
                    scores = np.round((q @ m.T) / np.outer(qn, norms), 9)
                for i, row in enumerate(scores):
                    good = np.flatnonzero(np.isfinite(row))
                    if len(good) > k:
                        cut = np.partition(-row[good], k - 1)[k - 1]
                        good = good[-row[good] <= cut]
                    best = good[np.lexsort((keys[good], -row[good]))][:k]
                    yield pd.DataFrame({"query_id": ids[i], key: keys[best], "score": row[best]})

        schema = f"query_id long, {key} long, score double"
        found = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(search, schema)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], f"query_id long, {key} long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


WORD = re.compile(r"\w+")
DIMENSION = 128


def embed_text(text: str | None) -> list[float]:
    """Signed feature hashing of words and word pairs into ``DIMENSION`` places, of unit length (all zero if empty)."""
    words = WORD.findall((text or "").lower())
    vector = [0.0] * DIMENSION
    for token in [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:]))]:
        h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        vector[h % DIMENSION] += 1.0 if h >> 7 & 1 else -1.0
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else vector


class Embedder(Protocol):
    """What turns texts into vectors; further ones are added to ``EMBEDDERS`` by name."""

    model_id: str
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """The stand-in that needs no model: hashed words and word pairs."""

    model_id, dimension = "hash-stub", DIMENSION

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [embed_text(t) for t in texts]


EMBEDDERS: dict[str, Callable[[str | None], Embedder]] = {}
"""Makers of embedders by provider, in the order in which they are tried; one that can't be made raises ``ImportError``."""


def build_embedder(model: str | None = None, prefer: str = "auto") -> Embedder:
    """The first provider that can be made (only ``prefer``, if it names one), else the stand-in."""
    if prefer != "hash":
        for name, make in EMBEDDERS.items():
            if prefer in ("auto", name):
                try:
                    return make(model)
                except ImportError:
                    continue
    return HashEmbedder()


def embedder_for_query(retrieval: str) -> Embedder | None:
    """Lexical questions take no vectors, hybrid ones whatever there is, ``auto`` ones no stand-in."""
    if retrieval == "bm25":
        return None
    chosen = build_embedder()
    return None if retrieval == "auto" and isinstance(chosen, HashEmbedder) else chosen


def text_hash(text: str | None) -> str:
    """The 128-bit content hash under which a vector is cached."""
    return hashlib.blake2b((text or "").encode(), digest_size=16).hexdigest()


def pack_vector(vector: list[float]) -> bytes:
    """Little-endian single floats, the form in which other stores keep vectors."""
    return np.asarray(vector, "<f4").tobytes()


def unpack_vector(blob: bytes) -> list[float]:
    return np.frombuffer(blob, "<f4").tolist()


def embedded_text(symbols: DataFrame) -> DataFrame:
    """``symbol_id, text``: what is embedded of a symbol, its name, signature, the first 240 characters of its docstring
    and its card, each on a line of its own where there is one."""
    lines = F.array("qname", "signature", F.substring("docstring", 1, 240), *([F.col("capsule")] if "capsule" in symbols.columns else []))
    return symbols.select("symbol_id", F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n").alias("text"))


def embed_with_cache(docs: DataFrame, key: str, text: str, cache: DataFrame | None = None, embedder: Embedder | None = None, batch: int = 64) -> DataFrame:
    """``key, model, content_hash, embedding``: cached vectors of the same key, model and content as they are, the others
    made ``batch`` texts at a time. A second model has vectors of its own."""
    embedder = embedder or HashEmbedder()

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], text: b[text], "content_hash": [text_hash(t) for t in b[text]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                made = embedder.embed_batch([t or "" for t in part[text]])
                yield pd.DataFrame({key: part[key], "model": embedder.model_id, "content_hash": part["content_hash"], "embedding": made})

    schema = f"{key} long, model string, content_hash string, embedding array<float>"
    hashed = docs.select(key, text).mapInPandas(hashes, f"{key} long, {text} string, content_hash string")
    if cache is None:
        return hashed.mapInPandas(run, schema)
    usable = cache.where(F.col("model") == embedder.model_id).select(key, "model", "content_hash", "embedding")
    missing = hashed.join(usable.select(key, "content_hash"), [key, "content_hash"], "left_anti")
    kept = usable.join(hashed.select(key, "content_hash"), [key, "content_hash"], "left_semi").select(key, "model", "content_hash", "embedding")
    return kept.unionByName(missing.mapInPandas(run, schema))


def of_model(cache: DataFrame, model: str) -> DataFrame:
    """The vectors of one model."""
    return cache.where(F.col("model") == model)


def hash_embed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, embedding`` by ``embed_text``, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "embedding": [embed_text(t) for t in batch[text]]})

    return docs.select(key, text).mapInPandas(run, f"{key} long, embedding array<float>")


def not_cached(docs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Documents whose vector is not cached under the same key and content hash."""
    return docs.join(cache.select(key, "content_hash"), [key, "content_hash"], "left_anti")
