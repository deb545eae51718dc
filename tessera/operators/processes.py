"""Process traces: greedy walks along the most telling edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import salted_join
from tessera.session import cut_lineage, release

FOLLOW = ("CALLS", "QUERIES", "CALLS_EXTERNAL", "FETCHES", "ROUTES_TO")
METHOD = r"^(?:http::)?(?:([A-Za-z]+)\s+)?(.*)$"
ROUTE_CONFIDENCE = 0.8
TERMINAL = ("QUERIES", "CALLS_EXTERNAL", "FETCHES")
MAX_DEPTH, MIN_CONFIDENCE = 8, 0.5


def normalize_path(path: Column | str) -> Column:
    """A route path in lower case without outer slashes, with ``:id`` and ``[id]`` as ``:param``."""
    p = F.lower(F.btrim(F.col(path) if isinstance(path, str) else path, F.lit("/")))
    return F.regexp_replace(F.regexp_replace(p, r"\[[^\]]+\]", ":param"), ":[a-z0-9_]+", ":param")


def slug(text: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(text, "[^a-zA-Z0-9._:/-]+", "-"), F.lit("-")), 1, 200)


def unique_names(symbols: DataFrame) -> DataFrame:
    """Names that stand for one symbol: qualified names, and bare names that only one symbol has."""
    alone = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("qname").alias("qname")).where("n = 1").select(F.col("name").alias("dst_name"), "qname")
    exact = symbols.select(F.col("qname").alias("dst_name"), "qname")
    return exact.unionByName(alone.join(exact.select("dst_name"), "dst_name", "left_anti"))


def resolved_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with ``target``: the resolved end, else the symbol that the bare name alone can mean; others are left out.

    A name means one symbol at most, so the join adds no rows; Spark splits a name with very many edges (skew join).
    """
    named = edges.where("dst is null and dst_name is not null").join(unique_names(symbols), "dst_name").withColumnRenamed("qname", "target")
    given = edges.where("dst is not null").withColumn("target", F.col("dst"))
    return given.unionByName(named)


def salted_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``resolved_targets`` over whole tables, with names of very many edges spread over tasks before the join."""
    open_edges = edges.where("dst is null and dst_name is not null")
    counts = open_edges.groupBy("dst_name").agg(F.count("*").alias("n"))
    keyed = cut_lineage(unique_names(symbols).join(counts, "dst_name").withColumnRenamed("qname", "target"))
    named = salted_join(open_edges, keyed.select("dst_name", "target", "n"), "dst_name", weight="n", salt="edge_id").drop("n")
    return edges.where("dst is not null").withColumn("target", F.col("dst")).unionByName(named)


def best_steps(targets: DataFrame, keep: int = MAX_DEPTH + 2) -> DataFrame:
    """The ``keep`` best edges of each symbol to different targets: a walk of at most ``MAX_DEPTH`` steps has visited
    fewer targets than that, so no walk can need a worse one, and a symbol with very many edges stays small."""
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(FOLLOW) for x in (t, i)])
    steps = targets.where(F.col("edge_type").isin(*FOLLOW) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("src") != F.col("target")))
    order = F.struct(F.try_element_at(rank, "edge_type").alias("o"), (-F.col("confidence")).alias("c"), (-F.coalesce("precision_level", F.lit(0))).alias("p"), "edge_id")
    ranked = steps.groupBy("src", "target").agg(F.min(F.struct(order.alias("order"), "edge_type", "confidence")).alias("best"))
    w = Window.partitionBy("src").orderBy("best.order")
    return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select("src", "target", "best.order", "best.edge_type", "best.confidence")


def walk(starts: DataFrame, steps: DataFrame, depth: Column | int = MAX_DEPTH) -> DataFrame:
    """Extend traces greedily: ``process_id, at, visited, n_steps, log_sum, terminal`` after at most ``MAX_DEPTH`` steps.

    ``starts`` has ``process_id, at, visited, n_steps, log_sum, max_depth``. Each step takes the best edge to a symbol
    that was not visited; a trace ends at an external or database edge. One join per level; levels are materialised.
    """
    live = cut_lineage(starts.withColumn("done", F.lit(False)))
    for _ in range(MAX_DEPTH - 1):
        going = live.where(~F.col("done") & (F.col("n_steps") < F.col("max_depth")))
        choices = going.join(steps, going["at"] == steps["src"]).where(~F.array_contains("visited", F.col("target")) | F.col("edge_type").isin(*TERMINAL))
        best = choices.groupBy("process_id").agg(F.min(F.struct("order", "target", "edge_type", "confidence")).alias("b"))
        nxt = live.join(best, "process_id", "left").select(
            "process_id",
            F.coalesce("b.target", "at").alias("at"),
            F.when(F.col("b").isNull(), F.col("visited")).otherwise(F.concat("visited", F.array("b.target"))).alias("visited"),
            (F.col("n_steps") + F.when(F.col("b").isNull(), 0).otherwise(1)).alias("n_steps"),
            (F.col("log_sum") + F.coalesce(F.log(F.greatest(F.lit(0.01), F.least(F.lit(1.0), "b.confidence"))), F.lit(0.0))).alias("log_sum"),
            "max_depth",
            (F.col("b").isNull() | F.col("done") | F.coalesce(F.col("b.edge_type").isin(*TERMINAL), F.lit(False))).alias("done"),
        )
        grown = cut_lineage(nxt)
        release(live)
        live = grown
        if live.where("not done and n_steps < max_depth").isEmpty():
            break
    return live


def entry_traces(symbols: DataFrame, targets: DataFrame, kind: str, edge_type: str, least: float, process: str, depth: int) -> DataFrame:
    """First steps of processes: from each symbol of ``kind`` along its best edge of ``edge_type`` (resolved ones first)."""
    first = targets.where((F.col("edge_type") == edge_type) & (F.col("confidence") >= least))
    order = F.struct(F.col("dst").isNull().alias("u"), (-F.col("confidence")).alias("c"), "edge_id")
    best = first.groupBy("src").agg(F.min(F.struct(order.alias("order"), "target", "confidence")).alias("b"))
    entries = symbols.where(F.col("kind") == kind).join(best, F.col("qname") == F.col("src"))
    # names that agree in their first 200 characters share an id; the first name keeps it
    first_of_id = Window.partitionBy("process_id").orderBy("entrypoint")
    return entries.select(
        slug(F.concat(F.lit(f"{process}::"), "qname")).alias("process_id"), F.lit(process).alias("process_type"), F.col("qname").alias("entrypoint"),
        F.col("b.target").alias("at"), F.array("qname", "b.target").alias("visited"), F.lit(1).alias("n_steps"),
        F.log(F.greatest(F.lit(0.01), F.least(F.lit(1.0), "b.confidence"))).alias("log_sum"), F.lit(depth).alias("max_depth"),
    ).withColumn("_r", F.row_number().over(first_of_id)).where("_r = 1").drop("_r")


def _log(confidence: Column | str) -> Column:
    return F.log(F.greatest(F.lit(0.01), F.least(F.lit(1.0), confidence)))


def fetch_traces(symbols: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """First steps of the flows from a user interface: one for each caller, method and address of its ``FETCHES`` edges.

    Method and address are those of ``metadata_json``, else of the name (``http::GET /a``). A route of the same
    normalised path follows (one of the same method or of any, else the first), then its handler; without a handler
    the trace ends there.
    """

    def told(frame: DataFrame, column: str, key: str, name: str, group: int) -> Column:
        said = F.get_json_object(column, f"$.{key}") if column in frame.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(said, F.lit("")), F.regexp_extract(name, METHOD, group))

    consumer = F.coalesce("dst", "dst_name")
    fetches = edges.where((F.col("edge_type") == "FETCHES") & (F.col("confidence") >= MIN_CONFIDENCE) & consumer.isNotNull() & F.col("src").isNotNull())
    named = fetches.withColumn("dst_name", F.coalesce("dst_name", "dst"))
    asked = named.select("edge_id", "src", consumer.alias("consumer"), "confidence", told(named, "metadata_json", "http_method", "dst_name", 1).alias("method"), told(named, "metadata_json", "url", "dst_name", 2).alias("url"))
    one = asked.withColumn("process_id", slug(F.concat_ws("::", F.lit("ui_to_api_flow"), "src", "method", "url")))
    first = one.withColumn("_r", F.row_number().over(Window.partitionBy("process_id").orderBy("src", "edge_id"))).where("_r = 1").drop("_r")
    of_kind = symbols.where("kind = 'route'")
    routes = of_kind.select("qname", F.upper(told(of_kind, "extras", "http_method", "name", 1)).alias("verb"), normalize_path(told(of_kind, "extras", "path", "name", 2)).alias("place")).where("place is not null")
    asking = first.where("url != ''").select("process_id", F.upper("method").alias("asked"), normalize_path("url").alias("place"))
    other = F.coalesce((F.col("verb") != F.col("asked")) & (F.col("verb") != "ANY"), F.lit(True))
    matched = asking.join(routes, "place").groupBy("process_id").agg(F.min(F.struct(other.alias("other"), "qname"))["qname"].alias("route"))
    handling = targets.where("edge_type = 'HANDLES_ROUTE'")
    order = F.struct(F.col("dst").isNull().alias("u"), (-F.col("confidence")).alias("c"), "edge_id")
    handlers = handling.groupBy(F.col("src").alias("route")).agg(F.min(F.struct(order.alias("order"), F.col("target").alias("handler"), F.col("confidence").alias("sure"))).alias("h"))
    steps = first.join(matched, "process_id", "left").join(handlers, "route", "left")
    n_steps = F.lit(1) + F.col("route").isNotNull().cast("int") + F.col("h").isNotNull().cast("int")
    return steps.select(
        "process_id", F.lit("ui_to_api_flow").alias("process_type"), F.col("src").alias("entrypoint"), F.coalesce("h.handler", "route", "consumer").alias("at"),
        F.array_compact(F.array("src", "consumer", "route", "h.handler")).alias("visited"), n_steps.alias("n_steps"),
        (_log("confidence") + F.when(F.col("route").isNotNull(), _log(F.lit(ROUTE_CONFIDENCE))).otherwise(0.0) + F.when(F.col("h").isNotNull(), _log(F.coalesce("h.sure", F.lit(0.0)))).otherwise(0.0)).alias("log_sum"),
        F.when(F.col("h").isNotNull(), MAX_DEPTH).otherwise(n_steps).alias("max_depth"),
    )


def build(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """All processes: ``process_id, process_type, entrypoint, terminal, n_steps, confidence, path``.

    Route flows begin at a route's handler, test flows at what a test block tests (half as deep), flows from a user
    interface at an edge that fetches, with the route and handler that answer it. The confidence is the
    geometric mean of the steps'.
    """
    targets = salted_targets(edges, symbols)
    starts = cut_lineage(
        entry_traces(symbols, targets, "route", "HANDLES_ROUTE", MIN_CONFIDENCE, "api_flow", MAX_DEPTH).unionByName(
            entry_traces(symbols, targets, "test_block", "TESTS", MIN_CONFIDENCE - 0.05, "test_flow", MAX_DEPTH // 2)
        ).unionByName(fetch_traces(symbols, edges, targets))
    )
    ended = walk(starts.drop("process_type", "entrypoint"), cut_lineage(best_steps(targets)))
    return ended.join(starts.select("process_id", "process_type", "entrypoint"), "process_id").select(
        "process_id", "process_type", "entrypoint", F.col("at").alias("terminal"), "n_steps",
        F.round(F.exp(F.col("log_sum") / F.col("n_steps")), 6).alias("confidence"), F.array_join("visited", " > ").alias("path"),
    )


def steps(built: DataFrame, edges: DataFrame) -> DataFrame:
    """``process_id, step, src, dst, edge_type, confidence, reason``: the steps of each process in order.

    A step's type and confidence are those of the best stored edge between its ends (resolved, or by the name alone);
    one that was made by matching a route has none and counts as ``STEP_IN_PROCESS``.
    """
    way = F.split("path", " > ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(way) - 1), lambda i: F.struct(i.alias("step"), F.element_at(way, i).alias("src"), F.element_at(way, i + 1).alias("dst")))
    rows = built.where(F.size(way) > 1).select("process_id", F.inline(pairs))
    wanted = edges.where(F.col("src").isNotNull()).select("src", F.coalesce("dst", "dst_name").alias("to"), "edge_type", "confidence", "edge_id")
    best = wanted.join(rows.select("src").distinct(), "src", "left_semi").groupBy("src", "to").agg(
        F.min_by(F.struct("edge_type", "confidence"), F.struct((-F.col("confidence")).alias("c"), "edge_id")).alias("b")
    )
    # the name of an edge that is not resolved is the last part of the target
    told = rows.join(best.select("src", F.col("to").alias("dst"), F.col("b").alias("exact")), ["src", "dst"], "left")
    last = F.substring_index("dst", ".", -1)
    named = told.withColumn("to", last).join(best.withColumnRenamed("b", "by_name"), ["src", "to"], "left")
    found = F.coalesce("exact", "by_name")
    return named.select(
        "process_id", "step", "src", "dst", F.coalesce(found["edge_type"], F.lit("STEP_IN_PROCESS")).alias("edge_type"), F.coalesce(found["confidence"], F.lit(ROUTE_CONFIDENCE)).alias("confidence"),
        F.format_string("step %d of %s", "step", "process_id").alias("reason"),
    )


def step_edges(of_steps: DataFrame) -> DataFrame:
    """Steps as edges of the graph, ``STEP_IN_PROCESS``, with what they are about as JSON."""
    meta = F.to_json(F.struct("process_id", "step", "edge_type"))
    return of_steps.select("src", "dst", F.lit("STEP_IN_PROCESS").alias("edge_type"), "confidence", F.lit(3).alias("precision_level"), F.lit("process-builder").alias("extraction_source"), "reason", meta.alias("metadata_json"))


def touching(built: DataFrame, qname: str) -> DataFrame:
    """Processes that a symbol is a step of."""
    return built.where(F.array_contains(F.split("path", " > "), qname))


def counts_by_type(built: DataFrame) -> DataFrame:
    """Processes of each type, and all of them."""
    per = built.groupBy("process_type").agg(F.count("*").alias("n"))
    return per.unionByName(built.agg(F.count("*").alias("n")).select(F.lit("total").alias("process_type"), "n"))


def route_label(routes: DataFrame) -> DataFrame:
    """``qname, label``: method and path of a route, else its name."""
    method, path = F.get_json_object("extras", "$.http_method"), F.get_json_object("extras", "$.path")
    told = F.when(F.coalesce(path, F.lit("")) != "", F.trim(F.concat_ws(" ", F.nullif(method, F.lit("")), path)))
    return routes.select("qname", F.coalesce(told, F.nullif("name", F.lit("")), "qname").alias("label"))
