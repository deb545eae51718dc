"""Containment of points in intervals and longest-prefix matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str, name: str) -> DataFrame:
    """``points`` with ``enclosing``: the shortest span of the same ``keys`` that holds ``at`` (ties: first ``name``).

    Spans are put into every bucket of ``WIDTH`` that they touch and points into theirs, so one key with very many
    spans is met bucket by bucket. Points in no span, and those with nulls, keep a null.
    """
    low, high = F.floor(F.col(begin) / WIDTH), F.floor(F.col(end) / WIDTH)
    sides = spans.where(F.col(begin) <= F.col(end)).select(*keys, begin, end, name, F.explode(F.sequence(low, high)).alias("_bucket"))
    numbered = points.withColumns({"_bucket": F.floor(F.col(at) / WIDTH), "_point": F.struct(*points.columns)})
    found = numbered.select(*keys, "_bucket", F.col(at).alias("_at")).distinct().join(sides, [*keys, "_bucket"]).where(F.col("_at").between(F.col(begin), F.col(end)))
    best = found.groupBy(*keys, "_at").agg(F.min(F.struct((F.col(end) - F.col(begin)).alias("n"), F.col(name).alias("name"))).alias("b")).select(*keys, "_at", F.col("b.name").alias("enclosing"))
    return points.join(best.withColumnRenamed("_at", at), [*keys, at], "left")


def longest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str, sep: str = ".") -> DataFrame:
    """``names`` with ``matched``: the longest of ``prefixes`` that is the name or ends before a ``sep`` in it.

    Each name is cut at every separator and the pieces meet the prefixes by equality, so no pair is tried in vain.
    """
    parts = F.split(name, F.lit("[" + sep + "]"))
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    tried = names.select(name, F.explode(cuts).alias(prefix)).distinct().join(prefixes.select(prefix).distinct(), prefix)
    best = tried.groupBy(name).agg(F.max_by(prefix, F.length(prefix)).alias("matched"))
    return names.join(best, name, "left")
