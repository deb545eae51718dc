"""Incremental maintenance of the index as set operations on old and new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status``: ``added``, ``removed``, ``changed`` or ``unchanged`` by the hash in ``value``."""
    a = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    status = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with its rows replaced by those of ``new`` that have the same keys, and the new ones added."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_writer(rows: DataFrame, key: str, order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stale_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols whose file is gone (or that name none)."""
    return symbols.join(files.select("file_id"), "file_id", "left_anti")


def prune_edges(edges: DataFrame, stale: DataFrame) -> DataFrame:
    """Edges that touch no stale symbol at either end; null ends touch nothing."""
    gone = stale.select("qname").distinct()
    kept = edges.join(gone.withColumnRenamed("qname", "src"), "src", "left_anti")
    return kept.join(gone.withColumnRenamed("qname", "dst"), "dst", "left_anti")


def semantic_merge(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """What semantic facts (``src, dst, edge_type, confidence``) do to rough edges: ``upgraded`` gives the first edge of
    the same source and type whose bare name is the last part of the target, ``inserted`` facts have none and are no
    edge yet. Columns ``src, dst, edge_type, action, edge_id``. Facts without a target are skipped; equal ones count once.
    """
    best = facts.where("src is not null and dst is not null").groupBy("src", "dst", "edge_type").agg(F.max("confidence").alias("confidence"))
    named = best.withColumn("dst_name", F.substring_index("dst", ".", -1))
    rough = edges.where("dst is null and dst_name is not null").groupBy("src", "edge_type", "dst_name").agg(F.min("edge_id").alias("edge_id"))
    there = edges.where("dst is not null").select("src", "dst", "edge_type").distinct().withColumn("there", F.lit(True))
    matched = named.join(rough, ["src", "edge_type", "dst_name"], "left")
    # one rough edge can take one fact: the most confident, then the first name
    w = Window.partitionBy("edge_id").orderBy(F.desc("confidence"), "dst")
    ranked = matched.withColumn("_r", F.when(F.col("edge_id").isNotNull(), F.row_number().over(w)))
    joined = ranked.join(there, ["src", "dst", "edge_type"], "left")
    action = F.when(F.col("_r") == 1, "upgraded").when(F.col("there").isNull(), "inserted").otherwise("known")
    return joined.select("src", "dst", "edge_type", action.alias("action"), F.when(F.col("_r") == 1, F.col("edge_id")).alias("edge_id"))


# Versions of the parsers; raising one makes its files be read again.
PARSER_VERSIONS = {"python": 3, "javascript": 3, "typescript": 3, "java": 1, "go": 1, "csharp": 1, "rust": 1, "kotlin": 1}
FAMILIES = {"python": "python:ast", "javascript": "jsts:regex", "typescript": "jsts:regex"}


def parser_signature(language: Column | str) -> Column:
    """``family:backend:version`` of the parser of a language; ``language:none:1`` where there is none."""
    c = F.col(language) if isinstance(language, str) else language
    known = F.create_map(*[F.lit(x) for k, v in PARSER_VERSIONS.items() for x in (k, f"{FAMILIES.get(k, f'{k}:regex')}:{v}")])
    return F.coalesce(F.try_element_at(known, c), F.concat(F.coalesce(c, F.lit("unknown")), F.lit(":none:1")))


def to_index(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """``path, status``: what happens to each file (``path, hash, signature``) when the index is brought up to date:
    ``added``, ``removed``, ``changed``, ``reparsed`` (same content, another parser), ``forced`` or ``unchanged``."""
    a = old.select("path", F.col("hash").alias("_h"), F.col("signature").alias("_s"), F.lit(True).alias("_was"))
    b = new.select("path", "hash", "signature", F.lit(True).alias("_is"))
    status = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("hash").eqNullSafe(F.col("_h")), "changed")
        .when(~F.col("signature").eqNullSafe(F.col("_s")), "reparsed").otherwise("forced" if force else "unchanged")
    )
    return a.join(b, "path", "full").select("path", status.alias("status"))


def stale_parser_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, stored, current``: files that another parser (``path, signature``) read than would read them now."""
    now = files.select("path", parser_signature("language").alias("current"))
    return now.join(stored.select("path", F.col("signature").alias("stored")), "path", "left").where(~F.col("current").eqNullSafe(F.col("stored")))


def replace_files(tables: dict[str, DataFrame], new: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """All tables with what belongs to ``paths`` replaced by the rows of ``new``: deleting a file takes its symbols, their
    edges and parameters, and its bindings with it.

    ``tables`` has ``files`` (``path, file_id``), ``symbols`` (``file_id, qname``), ``edges`` (``src, dst``), ``imports``
    (``path``) and may have ``parameters`` (``owner_qname``); ``new`` has those of them that get rows. An edge from
    another file keeps its name but loses a target that is no more.
    """
    gone_files = tables["files"].join(paths.select("path").distinct(), "path", "left_semi").select("file_id")
    gone = tables["symbols"].join(gone_files, "file_id", "left_semi").select("qname").distinct()
    kept = {
        "files": tables["files"].join(paths.select("path").distinct(), "path", "left_anti"),
        "symbols": tables["symbols"].join(gone_files, "file_id", "left_anti"),
        "imports": tables["imports"].join(paths.select("path").distinct(), "path", "left_anti"),
        "edges": prune_edges(tables["edges"], gone),
    }
    if "parameters" in tables:
        kept["parameters"] = tables["parameters"].join(gone.withColumnRenamed("qname", "owner_qname"), "owner_qname", "left_anti")
    return {name: df.unionByName(new[name], allowMissingColumns=True) if name in new else df for name, df in kept.items()}


def delete_edges_from(edges: DataFrame, reparsed: DataFrame) -> DataFrame:
    """Edges without those that start at re-parsed symbols (``qname``)."""
    return edges.join(reparsed.select(F.col("qname").alias("src")).distinct(), "src", "left_anti")


def merge_first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both, one per key: those that are there win over those that come."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_o")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_o", "_r")


def set_binding_targets(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """Bindings with the ``target`` that was resolved for their id; the others keep theirs."""
    told = resolved.select("import_id", F.col("target").alias("_new"))
    return imports.join(told, "import_id", "left").withColumn("target", F.coalesce("_new", "target")).drop("_new")


def orphan_parameters(parameters: DataFrame, symbols: DataFrame) -> DataFrame:
    """Parameters whose owner is no symbol any more."""
    return parameters.join(symbols.select(F.col("qname").alias("owner_qname")), "owner_qname", "left_anti")


ENRICHED = ("signature", "return_type", "declared_type", "docstring", "visibility")


def enrich_symbols(symbols: DataFrame, facts: DataFrame, columns: tuple[str, ...] = ENRICHED) -> DataFrame:
    """Symbols with what semantic facts (``qname`` and some of ``columns``) say of them; blank facts change nothing, facts
    on unknown names are left out, the first of several facts on a name counts."""
    known = [c for c in columns if c in facts.columns and c in symbols.columns]
    once = facts.groupBy("qname").agg(*[F.min(F.nullif(c, F.lit(""))).alias(f"_{c}") for c in known])
    joined = symbols.join(once, "qname", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in known}).drop(*[f"_{c}" for c in known])


def upsert_type_facts(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Type facts by (``owner_qname``, ``name``, ``kind``): new ones replace old ones, those without a type are left out."""
    told = facts.where("declared_type is not null and declared_type != '' and owner_qname is not null")
    keys = ["owner_qname", "name", "kind"]
    once = told.groupBy(*keys).agg(F.max("declared_type").alias("declared_type"))
    return upsert(stored.select(*keys, "declared_type"), once, keys)


def replace_parameters(stored: DataFrame, facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Parameters with those of semantic facts in place of the syntactic ones of the same owner, where the owner exists;
    an owner for which no fact has a name keeps its own."""
    usable = facts.where("name is not null and name != ''").join(symbols.select(F.col("qname").alias("owner_qname")), "owner_qname", "left_semi")
    return stored.join(usable.select("owner_qname").distinct(), "owner_qname", "left_anti").unionByName(usable, allowMissingColumns=True)


# Names under which parsers give a parameter's type and default.
TYPE_NAMES, DEFAULT_NAMES = ("declared_type", "type", "annotation"), ("default_value", "default")


def parameter_rows(raw: DataFrame) -> DataFrame:
    """Parameters given as JSON (``owner_qname, position, parameter``) as typed rows; without a name they are left out, a
    missing confidence is .5."""

    def field(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object("parameter", f"$.{n}"), F.lit("")) for n in names], F.lit(""))

    flag = lambda n: F.coalesce(F.lower(F.get_json_object("parameter", f"$.{n}")).isin("true", "1"), F.lit(False))
    rows = raw.select(
        "owner_qname", F.col("position").cast("int").alias("position"), F.get_json_object("parameter", "$.name").alias("name"), field(TYPE_NAMES).alias("declared_type"),
        field(DEFAULT_NAMES).alias("default_value"), flag("is_optional").alias("is_optional"), flag("is_rest").alias("is_rest"),
        F.coalesce(F.get_json_object("parameter", "$.confidence").try_cast("double"), F.lit(0.5)).alias("confidence"),
    )
    return rows.where("name is not null and name != ''")


# Columns that each version of the tables added, with their defaults.
MIGRATIONS: dict[str, dict[str, tuple[str, object]]] = {
    "symbols": {
        "return_type": ("string", ""), "declared_type": ("string", ""), "visibility": ("string", ""), "is_exported": ("int", 0), "parser_backend": ("string", ""),
        "parser_version": ("string", ""), "semantic_backend": ("string", ""), "semantic_version": ("string", ""), "content_hash": ("string", ""), "metadata_json": ("string", "{}"),
    },
    "edges": {
        "extraction_source": ("string", ""), "line": ("int", None), "col_no": ("int", None), "precision_level": ("int", 1), "reason": ("string", ""),
        "metadata_json": ("string", "{}"), "created_at": ("timestamp", None),
    },
}


def migrated(table: DataFrame, name: str) -> DataFrame:
    """A table of an older version with the columns that it lacks; those it has stay as they are."""
    missing = {c: F.lit(v).cast(t) for c, (t, v) in MIGRATIONS.get(name, {}).items() if c not in table.columns}
    return table.withColumns(missing) if missing else table


def tolerant_json(column: Column | str) -> Column:
    """Bad or missing JSON objects as ``{}``."""
    c = F.col(column) if isinstance(column, str) else column
    parsed = F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(parsed.isNotNull() & F.trim(c).startswith("{") & F.trim(c).endswith("}"), c).otherwise("{}")
