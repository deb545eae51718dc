"""Alias words of symbols: what people may call what code calls otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for a kind of symbol.
KIND_CONCEPTS = {
    "route": ("endpoint", "api", "http", "handler", "route"), "component": ("component", "ui", "react", "view", "render"),
    "test": ("test", "spec", "verify", "assert", "expectation"), "class": ("class", "type", "model"), "method": ("method", "operation"),
    "function": ("function", "operation"),
}
# Words that go with a stem in a name.
STEM_CONCEPTS = [
    ("token", ("token", "budget", "context", "size", "prompt", "count", "cost")), ("estimate", ("estimate", "predict", "approximate")),
    ("truncate", ("truncate", "limit", "trim", "cut", "shrink", "fit")), ("capsule", ("capsule", "summary", "card", "compact")),
    ("retriev", ("retrieve", "fetch", "get", "lookup", "search")), ("index", ("index", "ingest", "build", "scan")),
    ("parse", ("parse", "extract", "ast", "structure")), ("embed", ("embed", "vector", "semantic", "similarity")),
    ("auth", ("auth", "authentication", "login", "session", "token", "permission")), ("upload", ("upload", "file", "save", "ingest")),
    ("router?", ("route", "endpoint", "api", "url")), ("score|rank", ("score", "rank", "sort", "priority")),
    ("graph", ("graph", "neighbor", "edge", "node", "traverse")), ("impact", ("impact", "affected", "blast", "radius", "callers")),
    ("refactor", ("refactor", "rewrite", "reorganize")), ("validate", ("validate", "check", "verify", "ensure")),
    ("config", ("config", "configuration", "settings", "option")), ("store|persist", ("store", "persist", "save", "database")),
    ("scan", ("scan", "walk", "traverse", "discover")), ("ignore", ("ignore", "exclude", "filter", "skip")),
    ("hybrid|rrf", ("hybrid", "fuse", "fusion", "rrf", "combine")), ("budget", ("budget", "limit", "allocate", "share", "cap")),
    ("governor", ("governor", "control", "policy", "regulate")), ("mcp", ("mcp", "tool", "context", "protocol")),
]
NEIGHBOUR_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "ROUTES_TO")
#: endings of paths that are no words
PATH_ENDINGS = ("py", "ts", "tsx", "js", "jsx")
PIECES = "([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+)"


def identifier_words(name: Column | str) -> Column:
    """Lower-case pieces of an identifier of at least two characters: cut at separators, at upper case and at digits."""
    chunks = F.split(F.col(name) if isinstance(name, str) else name, r"[._/-]+")
    pieces = F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(c, F.lit(PIECES), F.lit(1))))
    return F.filter(F.transform(pieces, F.lower), lambda t: F.length(t) > 1)


def path_words(path: Column | str) -> Column:
    found = F.transform(F.regexp_extract_all(path, F.lit("([A-Za-z][A-Za-z0-9_]+)"), F.lit(1)), F.lower)
    return F.filter(found, lambda t: ~t.isin(*PATH_ENDINGS))


def neighbour_words(edges: DataFrame) -> DataFrame:
    """``qname, words``: the distinct pieces of the last parts of the names that a symbol calls, imports, extends or routes
    to. Pieces are made distinct before they are put together, so a symbol with very many edges stays small."""
    last = F.substring_index("dst_name", ".", -1)
    pieces = edges.where(F.col("edge_type").isin(*NEIGHBOUR_TYPES) & F.col("src").isNotNull() & F.col("dst_name").isNotNull())
    rows = pieces.select(F.col("src").alias("qname"), F.explode(identifier_words(last)).alias("word")).distinct()
    return rows.groupBy("qname").agg(F.array_sort(F.collect_list("word")).alias("words"))


def alias_words(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """``qname, alias``: the alias words of each symbol as one text. ``symbols`` may have ``extras`` (JSON)."""
    named = symbols.join(files.select("file_id", "path"), "file_id", "left").join(neighbour_words(edges), "qname", "left")
    none = F.array().cast("array<string>")

    def if_(when: Column, words: tuple[str, ...]) -> Column:
        return F.when(when, F.array(*map(F.lit, words))).otherwise(none)

    kinds = [if_(F.col("kind") == k, words) for k, words in KIND_CONCEPTS.items()]
    name = F.coalesce("name", F.lit(""))
    stems = [if_(F.lower(name).rlike(stem) | F.lower("qname").rlike(stem), words) for stem, words in STEM_CONCEPTS]
    extras = "extras" in symbols.columns
    of_route = (F.col("kind") == "route") if extras else F.lit(False)
    method = F.get_json_object("extras", "$.http_method") if extras else F.lit(None).cast("string")
    path = F.get_json_object("extras", "$.path") if extras else F.lit(None).cast("string")
    route = F.when(of_route, F.concat(F.array_compact(F.array(F.nullif(F.lower(method), F.lit("")))), F.coalesce(F.regexp_extract_all(path, F.lit("([A-Za-z][A-Za-z0-9_]+)"), F.lit(1)), none))).otherwise(none)
    last = F.substring_index("qname", ".", -1)
    parts = [identifier_words(name), identifier_words(last), F.coalesce(path_words("path"), none), *kinds, *stems, F.coalesce("words", none), route]
    return named.select("qname", F.array_join(F.concat(*parts), " ").alias("alias"))
