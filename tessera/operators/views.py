"""Views of the graph: nodes and edges of each kind of picture, details of a node, attached roles and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, lookups, processes

# The edge types and symbol kinds of each view.
CALL_TYPES = ("CALLS", "ACCESSES", "INSTANTIATES", "EXTENDS", "IMPLEMENTS", "HAS_METHOD")
FRAMEWORK_TYPES = (
    "HANDLES_ROUTE", "ROUTES_TO", "ROUTE_HANDLED_BY", "TESTS", "TESTS_SYMBOL", "QUERIES", "FETCHES", "CALLS_EXTERNAL", "USES_MIDDLEWARE", "MODEL_USED_BY",
    "READS_ENV_VAR",
)
FRAMEWORK_KINDS = ("route", "test_block", "model", "api_consumer", "env_var", "component")
CALL_KINDS = (
    "function", "method", "constructor", "class", "interface", "struct", "record", "enum", "trait", "type_alias", "component", "module", "test_block",
)
VIEWS = ("full", "repo", "symbols", "calls", "processes", "framework")
NODE = ("id", "label", "kind", "path", "start_line", "end_line")
EDGE = ("id", "source", "target", "type", "confidence", "precision_level")
SCHEMA_VERSION = 5


def symbol_id(qname: Column | str) -> Column:
    return F.concat(F.lit("symbol:"), F.col(qname) if isinstance(qname, str) else qname)


def symbol_nodes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One node per symbol; a symbol without a stored file has no path."""
    rows = symbols.join(files.select("file_id", "path"), "file_id", "left")
    return rows.select(symbol_id("qname").alias("id"), F.col("name").alias("label"), "kind", "path", "start_line", "end_line")


def file_nodes(files: DataFrame) -> DataFrame:
    label = F.element_at(F.split("path", "/"), -1)
    return files.select(F.concat(F.lit("file:"), "path").alias("id"), label.alias("label"), F.lit("file").alias("kind"), "path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))


def folder_nodes(files: DataFrame) -> DataFrame:
    folders = files.select(F.explode(graph.folder_paths("path")).alias("folder")).distinct()
    label = F.element_at(F.split("folder", "/"), -1)
    return folders.select(F.concat(F.lit("folder:"), "folder").alias("id"), label.alias("label"), F.lit("folder").alias("kind"), F.col("folder").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))


def contains(pairs: DataFrame) -> DataFrame:
    """Containment records of ``source, target``."""
    return pairs.select(
        F.concat(F.lit("contains:"), "source", F.lit("->"), "target").alias("id"), "source", "target", F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"), F.lit(1).alias("precision_level")
    )


def stored_edges(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edge records; the steps of processes are no edges of the graph, and a target that is not resolved counts by name."""
    rows = edges.where(F.col("edge_type").isin(*types)) if types else edges.where("edge_type != 'STEP_IN_PROCESS'")
    return rows.where("src is not null").select(
        F.concat(F.lit("edge:"), F.col("edge_id").cast("string")).alias("id"), symbol_id("src").alias("source"), symbol_id(F.coalesce("dst", "dst_name")).alias("target"),
        F.col("edge_type").alias("type"), "confidence", "precision_level",
    )


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*EDGE)


def graph_view(
    name: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, of_processes: tuple[DataFrame, DataFrame] | None = None,
    max_nodes: int | None = None, max_edges: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (``NODE``) and edges (``EDGE``) of a view.

    ``full``: files, symbols, containment and all stored edges; ``repo``: folders and files; ``symbols``: files and what
    they hold; ``calls`` and ``framework``: symbols and edges of their kinds, the latter with whatever stands at the other
    end; ``processes``: processes, their steps and members (``of_processes`` holds both frames). ``max_nodes`` and
    ``max_edges`` are a picture's limits: the most important nodes, then the most confident edges stay.
    """
    if name not in VIEWS:
        raise ValueError(f"no such view: {name}; there are {', '.join(VIEWS)}")
    of_symbols = symbol_nodes(symbols, files)
    held = files.join(symbols.select("file_id", "qname"), "file_id").select(F.concat(F.lit("file:"), "path").alias("source"), symbol_id("qname").alias("target"))
    if name == "repo":
        parts = F.split("path", "/")
        folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
        nodes = folder_nodes(files).unionByName(file_nodes(files))
        links = contains(files.select(F.concat(F.lit("folder:"), folder).alias("source"), F.concat(F.lit("file:"), "path").alias("target")).where("source is not null"))
    elif name == "symbols":
        nodes, links = file_nodes(files).unionByName(of_symbols), contains(held)
    elif name == "calls":
        nodes = of_symbols.where(F.col("kind").isin(*CALL_KINDS))
        links = inside(stored_edges(edges, CALL_TYPES), nodes)
    elif name == "framework":
        links = inside(stored_edges(edges, FRAMEWORK_TYPES), of_symbols)
        ends = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        nodes = of_symbols.where(F.col("kind").isin(*FRAMEWORK_KINDS)).unionByName(of_symbols.where(~F.col("kind").isin(*FRAMEWORK_KINDS)).join(ends, "id", "left_semi"))
    elif name == "processes":
        nodes, links = process_view(*of_processes, symbols, files)
    else:
        nodes = file_nodes(files).unionByName(of_symbols)
        links = contains(held).unionByName(inside(stored_edges(edges), nodes))
    if max_nodes is not None:
        nodes = nodes.orderBy(graph.kind_priority("kind"), "id").limit(max_nodes)
        links = inside(links, nodes)
    if max_edges is not None:
        links = links.orderBy(F.desc("confidence"), "precision_level", "id").limit(max_edges)
    return nodes.select(*NODE), links.select(*EDGE)


def node_or_fallback(qnames: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A node for each name: its symbol's, or one that only has the last part of the name where there is no symbol."""
    found = qnames.select(symbol_id("qname").alias("id"), F.substring_index("qname", ".", -1).alias("_last")).distinct().join(symbol_nodes(symbols, files), "id", "left")
    return found.select("id", F.coalesce("label", "_last").alias("label"), F.coalesce("kind", F.lit("symbol")).alias("kind"), F.coalesce("path", F.lit("")).alias("path"), "start_line", "end_line")


def process_view(built: DataFrame, steps: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processes with the symbols on their way, the steps between these, and which symbol belongs to which process."""
    own = built.select(
        F.concat(F.lit("process:"), "process_id").alias("id"), F.concat_ws(": ", "process_type", "entrypoint").alias("label"), F.lit("process").alias("kind"), F.lit("").alias("path"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
    )
    ends = steps.select(F.explode(F.array("src", "dst")).alias("qname")).distinct()
    way = steps.select(
        F.format_string("step:%s:%d", "process_id", "step").alias("id"), symbol_id("src").alias("source"), symbol_id("dst").alias("target"), F.col("edge_type").alias("type"), "confidence", F.lit(3).alias("precision_level")
    )
    members = steps.join(built.select("process_id", F.col("confidence").alias("sure")), "process_id").select(
        F.format_string("member:%s:%d:%s", "process_id", "step", "src").alias("id"), F.concat(F.lit("process:"), "process_id").alias("source"), symbol_id("src").alias("target"),
        F.lit("MEMBER_OF").alias("type"), F.col("sure").alias("confidence"), F.lit(3).alias("precision_level"),
    )
    return own.unionByName(node_or_fallback(ends, symbols, files)), way.unionByName(members)


def attach_roles(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Nodes with ``roles`` (most confident first) and the first of them as ``role``."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "role")))
    listed = roles.groupBy(symbol_id("qname").alias("id")).agg(F.transform(order, lambda r: r["role"]).alias("roles"))
    return nodes.join(listed, "id", "left").withColumn("role", F.try_element_at("roles", F.lit(1)))


def parameters_by_owner(parameters: DataFrame) -> DataFrame:
    """``owner_qname, parameters``: the parameters of each owner in order, as structs."""
    one = F.struct("position", "name", "declared_type", "confidence")
    return parameters.groupBy("owner_qname").agg(F.array_sort(F.collect_list(one)).alias("parameters"))


def attach_parameters(nodes: DataFrame, parameters: DataFrame) -> DataFrame:
    nested = parameters_by_owner(parameters).select(symbol_id("owner_qname").alias("id"), "parameters")
    return nodes.join(nested, "id", "left")


def sized(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``degree`` and the ``size`` they are drawn with, and how many different neighbours they have."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))))
    pairs = ends.groupBy("id", "other").agg(F.count("*").alias("n"))
    degree = pairs.groupBy("id").agg(F.sum("n").alias("degree"), F.count("*").alias("n_neighbours"))
    counted = nodes.join(degree, "id", "left").fillna(0, ["degree", "n_neighbours"])
    return counted.withColumn("size", F.log(F.col("degree") + 1) * 1.1)


def metadata(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about a view: name, versions and counts."""
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count"))).select(
        F.lit(name).alias("view"), F.lit(SCHEMA_VERSION).alias("schema_version"), "node_count", "edge_count"
    )


def in_folder(files: DataFrame, folder: str, limit: int = 200) -> DataFrame:
    """Files below a folder, by path."""
    return files.where(F.col("path").startswith(folder.rstrip("/") + "/")).orderBy("path").limit(limit)


def node_details(node_id: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, roles: DataFrame, built: DataFrame) -> dict[str, DataFrame]:
    """What a node's page shows, by the kind of its id: the node itself and its relations, each a frame."""
    kind, _, name = node_id.partition(":")
    if kind == "symbol":
        return {
            "node": attach_roles(symbol_nodes(lookups.find_symbol(symbols, name), files), roles),
            "callers": lookups.incoming(edges, name, ["CALLS", "HANDLES_ROUTE", "TESTS", "TESTS_SYMBOL"]).select(F.col("src").alias("qname"), "edge_type", "confidence"),
            "callees": lookups.outgoing(edges, name, ["CALLS", "QUERIES", "FETCHES", "CALLS_EXTERNAL", "USES_MIDDLEWARE"]).select(F.coalesce("dst", "dst_name").alias("qname"), "edge_type", "confidence"),
            "processes": processes.touching(built, name),
        }
    if kind == "file":
        return {"node": files.where(F.col("path") == name), "symbols": lookups.in_file(symbols, files, name)}
    if kind == "folder":
        return {"files": in_folder(files, name)}
    if kind == "process":
        return {"node": built.where(F.col("process_id") == name)}
    return {}


def pins_of(node_ids: list[str], files: DataFrame, symbols: DataFrame, steps: DataFrame) -> DataFrame:
    """``path``: the files that selected nodes stand for: files, those of symbols, those of the steps of processes."""
    chosen = files.sparkSession.createDataFrame([tuple(n.partition(":")[::2]) for n in node_ids] or [("", "")], "kind string, name string")
    of_files = files.join(chosen.where("kind = 'file'").select(F.col("name").alias("path")), "path", "left_semi").select("path")
    told = chosen.where("kind = 'symbol'").select(F.col("name").alias("qname"))
    way = steps.join(chosen.where("kind = 'process'").select(F.col("name").alias("process_id")), "process_id", "left_semi").select(F.explode(F.array("src", "dst")).alias("qname"))
    of_symbols = symbols.join(told.unionByName(way).distinct(), "qname", "left_semi").join(files.select("file_id", "path"), "file_id").select("path")
    return of_files.unionByName(of_symbols).distinct().orderBy("path")


def topological_order(after: dict[str, list[str]]) -> list[str]:
    """Names so that each stands after those it needs; of equally free ones the first given. A cycle is an error."""
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 1:
            raise ValueError(f"cycle at {name}")
        if name in state:
            return
        state[name] = 1
        for need in after.get(name, ()):
            if need not in after:
                raise ValueError(f"{name} needs {need}, which is not there")
            visit(need)
        state[name] = 2
        order.append(name)

    for name in after:
        visit(name)
    return order
