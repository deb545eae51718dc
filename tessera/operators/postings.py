"""The stored inverted index: built once, asked by term."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.session import parallelism, shared_folder

BUCKETS = 64
"""Folders that terms are spread over by their hash: a question opens those of its terms only."""


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class StoredIndex:
    """Postings, terms, lengths and figures of a collection as tables below ``path``.

    Postings (``key, term, tf, length``) lie in ``BUCKETS`` folders by the hash of the term, sorted by term inside, so a
    lookup reads the folders and the row groups of its terms and nothing else. Tasks write even ranges of (bucket, term,
    key): a term that a third of all documents has is spread over as many files as it needs.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str) -> StoredIndex:
        """Write the index of ``docs``. A null text has no terms and length 1; documents without terms count."""
        spark = docs.sparkSession
        rows = search.postings(docs, key, text).withColumn("bucket", bucket_of("term"))
        rows.repartitionByRange(parallelism(spark), "bucket", "term", key).sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{path}/postings")
        index = cls(spark, path, key)
        index.postings().groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        search.lengths(docs, key, text).write.mode("overwrite").parquet(f"{path}/lengths")
        figures = index.lengths().agg(
            F.greatest(F.count("*"), F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg("length"), F.lit(1.0)), F.lit(1.0)).alias("avgdl")
        )
        # written last: its presence tells that the index is whole
        figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")
        return index

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} long, term string, tf long, length int, bucket int").parquet(f"{self.path}/postings")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("bucket int, term string, df long").parquet(f"{self.path}/terms")

    def lengths(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} long, length int").parquet(f"{self.path}/lengths")

    def figures(self) -> DataFrame:
        return self.spark.read.schema("n_docs long, avgdl double").parquet(f"{self.path}/figures")

    def lookup(self, words: list[str]) -> DataFrame:
        """Postings of some terms: their folders are chosen when the question is planned."""
        if not words:
            return self.postings().limit(0)
        row = self.spark.range(1).select(F.array(*[bucket_of(F.lit(w)) for w in words]).alias("b")).first()
        buckets = sorted(set(row["b"]))
        return self.postings().where(F.col("bucket").isin(*buckets) & F.col("term").isin(*words))

    def document_length(self, keys: DataFrame) -> DataFrame:
        """``key, length`` of some documents; those that the index does not have count as 1."""
        return keys.select(self.key).join(self.lengths(), self.key, "left").select(self.key, F.coalesce("length", F.lit(1)).alias("length"))

    @staticmethod
    def _weighed(wanted: DataFrame, figures: Row) -> DataFrame:
        n_docs, avgdl = figures["n_docs"], figures["avgdl"]
        idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("length") / F.lit(avgdl)))
        return wanted.withColumn("part", idf * weight)

    def ask(self, question: str) -> DataFrame:
        """``key, score`` of every document that shares a term with a question; its terms count once."""
        words = search.question_terms(question)
        df = {r["term"]: r["df"] for r in self.terms().where(F.col("term").isin(*words)).collect()} if words else {}
        if not df:
            return self.postings().limit(0).select(self.key, F.lit(0.0).alias("score"))
        table = F.create_map(*[F.lit(x) for pair in df.items() for x in pair])
        return self._weighed(self.lookup(list(df)).withColumn("df", table[F.col("term")]), self.figures().first()).groupBy(self.key).agg(F.sum("part").alias("score"))

    def top_many(self, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
        """``query_id, key, score, rank``: the ``k`` best documents for each of ``queries`` (``query_id, query``); ties go to
        the lower key.

        A block of queries is a matrix of their terms. Postings of these terms are brought together by document once, each
        batch of documents is multiplied with the matrix, and a task passes on only its own ``k`` best per query, so the
        scores of all pairs never leave a task.
        """
        asked = queries.select("query_id", "query").where("query is not null").orderBy("query_id")
        figures = self.figures().first()
        parts = None
        for b in range(max(1, -(-asked.count() // block))):
            rows = asked.offset(b * block).limit(block).collect()
            terms = [search.question_terms(r["query"]) for r in rows]
            words = sorted({w for t in terms for w in t})
            if not words:
                continue
            place = {w: i for i, w in enumerate(words)}
            matrix = np.zeros((len(words), len(rows)))
            for j, t in enumerate(terms):
                matrix[[place[w] for w in t], j] = 1.0
            told = self.spark.sparkContext.broadcast((place, matrix, [r["query_id"] for r in rows]))
            names = self.spark.createDataFrame([(w,) for w in words], "term string").withColumn("bucket", bucket_of("term"))
            wanted = self._weighed(self.postings().join(names.join(self.terms(), ["bucket", "term"]), ["bucket", "term"]), figures)
            found = wanted.select(self.key, "term", "part").repartition(self.key).sortWithinPartitions(self.key).mapInPandas(_best_of(self.key, told, k), f"query_id long, {self.key} long, score double")
            parts = found if parts is None else parts.unionByName(found)
        if parts is None:
            return self.spark.createDataFrame([], f"query_id long, {self.key} long, score double, rank int")
        return search.top_per_query(parts, self.key, k)


def _best_of(key: str, told, k: int):
    """The ``k`` best documents per query of one task, whose rows come sorted by document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, matrix, ids = told.value
        best: list[pd.DataFrame] = []
        rest: pd.DataFrame | None = None

        def score(rows: pd.DataFrame) -> pd.DataFrame:
            keys, row = np.unique(rows[key].to_numpy(), return_inverse=True)
            out = []
            for first in range(0, len(keys), 512):
                mine = (row >= first) & (row < first + 512)
                docs = np.zeros((min(512, len(keys) - first), len(place)))
                docs[row[mine] - first, [place[t] for t in rows["term"].to_numpy()[mine]]] = rows["part"].to_numpy()[mine]
                scores = docs @ matrix
                d, q = np.nonzero(scores > 0)
                out.append(pd.DataFrame({"query_id": np.array(ids)[q], key: keys[first : first + 512][d], "score": scores[d, q]}))
            return top(pd.concat(out))

        def top(rows: pd.DataFrame) -> pd.DataFrame:
            ordered = rows.assign(_s=-rows["score"].round(9)).sort_values(["query_id", "_s", key])
            return ordered.groupby("query_id", sort=False).head(k).drop(columns="_s")

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            if not len(rows):
                continue
            # the last document of a batch may go on in the next one
            last = rows[key] == rows[key].iloc[-1]
            rest = rows[last]
            if (~last).any():
                best = [top(pd.concat([*best, score(rows[~last])]))]
        if rest is not None and len(rest):
            best = [top(pd.concat([*best, score(rest)]))]
        yield from best

    return run


def fingerprint(df: DataFrame) -> str:
    """A name for the files behind a frame that changes with any of them: paths, lengths and times of change."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    told = []
    for name in sorted(df.inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(conf).getFileStatus(where)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)


def stored_index(make: Callable[[], DataFrame], key: str, text: str, name: str, sources: list[DataFrame]) -> StoredIndex:
    """The index of the documents that ``make`` gives in the shared folder, built if there is none for the present state
    of the files behind ``sources``."""
    spark = sources[0].sparkSession
    mark = hashlib.sha256(" ".join(map(fingerprint, sources)).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/tessera-index-{name}-{mark}"
    if not complete(spark, f"{path}/figures"):
        StoredIndex.build(make(), key, text, path)
    return StoredIndex(spark, path, key)
