"""Graph operators: degrees, neighbourhoods, containment, views, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, release

# Edge types that carry impact.
IMPACT_TYPES = (
    "CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "ROUTES_TO", "HANDLES_ROUTE", "TESTS", "TESTS_SYMBOL", "QUERIES", "MODEL_USED_BY", "FETCHES", "CALLS_EXTERNAL",
)
# Order in which kinds are kept when nodes are trimmed.
KIND_PRIORITY = {
    "process": 0, "route": 1, "test_block": 1, "model": 1, "api_consumer": 1, "folder": 2, "file": 2, "function": 3, "method": 3,
    "class": 4, "interface": 4, "type_alias": 5, "variable": 6,
}


def degrees(edges: DataFrame) -> DataFrame:
    """``qname, callers, callees``: resolved edges into and all edges out of each symbol, summed before the join."""
    into = edges.where("dst is not null").groupBy(F.col("dst").alias("qname")).agg(F.count("*").alias("callers"))
    out = edges.where("src is not null").groupBy(F.col("src").alias("qname")).agg(F.count("*").alias("callees"))
    return into.join(out, "qname", "full").select("qname", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, types: tuple[str, ...] = IMPACT_TYPES) -> DataFrame:
    """``qname, depth`` of all nodes within ``depth`` undirected steps of ``start`` (``qname``), by levels.

    Every level joins the new nodes only; visited ones are taken out by an anti join, and each level is materialised, so
    the plan does not grow with the depth. Unknown or null start nodes reach nothing but themselves.
    """
    kept = edges.where(F.col("edge_type").isin(*types) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
    both = kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = cut_lineage(start.select("qname").where("qname is not null").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        frontier = seen.where(F.col("depth") == level - 1).select(F.col("qname").alias("src"))
        reached = both.join(frontier, "src").select(F.col("dst").alias("qname")).distinct()
        fresh = reached.join(seen.select("qname"), "qname", "left_anti").withColumn("depth", F.lit(level))
        grown = cut_lineage(seen.unionByName(fresh))
        release(seen)
        seen = grown
    return seen


def callers_and_callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``qname, neighbour, direction`` for each resolved CALLS edge between known symbols."""
    calls = edges.where("edge_type = 'CALLS' and dst is not null")
    known = symbols.select("qname")
    inner = calls.join(known.withColumnRenamed("qname", "src"), "src", "left_semi").join(known.withColumnRenamed("qname", "dst"), "dst", "left_semi")
    pairs = inner.select("src", "dst").distinct()
    return pairs.select(F.col("src").alias("qname"), F.col("dst").alias("neighbour"), F.lit("callee").alias("direction")).unionByName(
        pairs.select(F.col("dst").alias("qname"), F.col("src").alias("neighbour"), F.lit("caller").alias("direction"))
    )


def folder_paths(path: Column | str) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def folder_rollup(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``folder, n_files, n_symbols`` of every folder with all that lies below it; ``.`` holds everything."""
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    counted = files.join(per_file, "file_id", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
    nested = F.when(F.instr("path", "/") > 0, F.concat(F.array(F.lit(".")), folder_paths("path"))).otherwise(F.array(F.lit(".")))
    return counted.select(F.explode(nested).alias("folder"), "n").groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_symbols"))


def containment_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``source, target`` of the containment tree: folder to folder, folder to file, file to symbol."""
    parts = F.split("path", "/")
    folder_of = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    to_files = files.select(F.concat(F.lit("folder:"), folder_of).alias("source"), F.concat(F.lit("file:"), "path").alias("target")).where("source is not null")
    folders = files.select(F.explode(folder_paths("path")).alias("folder")).distinct()
    above = F.regexp_extract("folder", "^(.*)/[^/]*$", 1)
    to_folders = folders.where(above != "").select(F.concat(F.lit("folder:"), above).alias("source"), F.concat(F.lit("folder:"), "folder").alias("target"))
    to_symbols = symbols.join(files.select("file_id", "path"), "file_id").select(F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("symbol:"), "qname").alias("target"))
    return to_folders.unionByName(to_files).unionByName(to_symbols)


def view(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """Edges of some types between symbols of some kinds."""
    nodes = symbols.where(F.col("kind").isin(*kinds)).select("qname")
    kept = edges.where(F.col("edge_type").isin(*types))
    return kept.join(nodes.withColumnRenamed("qname", "src"), "src", "left_semi").join(nodes.withColumnRenamed("qname", "dst"), "dst", "left_semi")


def kind_priority(kind: Column | str) -> Column:
    order = F.create_map(*[F.lit(x) for pair in KIND_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(order, kind), F.lit(9))


def trim_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """Edges of the ``max_nodes`` most important nodes, most confident first (lower precision first on ties)."""
    top = nodes.orderBy(kind_priority("kind"), "qname").limit(max_nodes).select("qname")
    inner = edges.join(top.withColumnRenamed("qname", "src"), "src", "left_semi").join(top.withColumnRenamed("qname", "dst"), "dst", "left_semi")
    return inner.orderBy(F.desc("confidence"), "precision_level", "edge_id").limit(max_edges)


def relationship_type(edge_type: Column | str) -> Column:
    """A name that graph databases accept: upper-case words joined by underscores."""
    return F.upper(F.array_join(F.regexp_extract_all(edge_type, F.lit("([A-Za-z0-9]+)"), F.lit(1)), "_"))


def export_rows(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows for a graph database, ``kept`` where both ends are known; others are dangling and get counted, not written."""
    known = symbols.select(F.col("qname").alias("k"), F.lit(True).alias("there"))
    ends = edges.join(known.select(F.col("k").alias("src"), F.col("there").alias("src_there")), "src", "left").join(
        known.select(F.col("k").alias("dst"), F.col("there").alias("dst_there")), "dst", "left"
    )
    return ends.select(
        "edge_id", F.concat(F.lit("symbol:"), "src").alias("source"), F.concat(F.lit("symbol:"), "dst").alias("target"),
        relationship_type("edge_type").alias("rel_type"), (F.col("src_there").isNotNull() & F.col("dst_there").isNotNull()).alias("kept"),
    )
