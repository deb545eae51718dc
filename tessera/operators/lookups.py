"""Lookups by name, path, kind and edge, each ordered by a natural key so that limits are deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_symbol(symbols: DataFrame, qname: str) -> DataFrame:
    return symbols.where(F.col("qname") == qname)


def find_by_name(symbols: DataFrame, name: str, limit: int = 25, parity: bool = False) -> DataFrame:
    """Symbols whose name is ``name`` or whose qualified name ends in it. ``parity`` compares like SQL's ``LIKE``: without
    case, and with ``_`` standing for any character."""
    tail = F.col("qname").ilike(f"%.{name}") if parity else F.col("qname").endswith(f".{name}")
    return symbols.where((F.col("name") == name) | tail).orderBy("qname").limit(limit)


def in_file(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return symbols.join(files.where(F.col("path") == path).select("file_id"), "file_id").orderBy("start_line", "qname")


def of_kind(symbols: DataFrame, kind: str, limit: int = 1000) -> DataFrame:
    return symbols.where(F.col("kind") == kind).orderBy("qname").limit(limit)


def outgoing(edges: DataFrame, src: str, types: list[str] | None = None) -> DataFrame:
    rows = edges.where(F.col("src") == src)
    return rows.where(F.col("edge_type").isin(*types)) if types else rows


def incoming(edges: DataFrame, dst: str, types: list[str] | None = None) -> DataFrame:
    rows = edges.where(F.col("dst") == dst)
    return rows.where(F.col("edge_type").isin(*types)) if types else rows


def touching(edges: DataFrame, qname: str) -> DataFrame:
    """Edges at either end, as two equality scans without the overlap, most confident first."""
    rows = outgoing(edges, qname).unionByName(incoming(edges, qname).where(~F.col("src").eqNullSafe(F.lit(qname))))
    return rows.orderBy(F.desc("confidence"), "edge_id")


def resolve(symbols: DataFrame, files: DataFrame, target: str, limit: int = 25) -> DataFrame:
    """Symbols that a path, a qualified name or a bare name stands for: the first of these that gives any."""
    by_path = in_file(symbols, files, target).withColumn("_way", F.lit(0))
    exact = find_symbol(symbols, target).withColumn("_way", F.lit(1))
    named = find_by_name(symbols, target, limit).withColumn("_way", F.lit(2))
    every = by_path.unionByName(exact, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    first = every.agg(F.min("_way").alias("_first"))
    return every.join(F.broadcast(first), F.col("_way") == F.col("_first")).drop("_way", "_first")


def file_matches(retrieved: Column, oracle: Column) -> Column:
    """Paths that are equal, end in each other at a slash, or share the last part."""
    a, b = F.regexp_replace(retrieved, r"^\./", ""), F.regexp_replace(oracle, r"^\./", "")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    bare = (last(a) == last(b)) & (~F.contains(a, F.lit("/")) | ~F.contains(b, F.lit("/")))
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a)) | bare


def symbol_matches(oracle: Column, qname: Column) -> Column:
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    return (oracle == qname) | qname.endswith(F.concat(F.lit("."), oracle)) | (last(oracle) == last(qname))
