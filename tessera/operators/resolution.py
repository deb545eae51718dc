"""Resolution of edge targets by name, in ordered passes of rising scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import salted_join
from tessera.session import cut_lineage

RESOLVER_PRECISION = 2
PASSES = ("import_alias", "file_scope", "class_scope", "unique_name")


def js_relative_module(path: Column | str, module: Column | str) -> Column:
    """The dotted module that a ``./x`` or ``../x`` import in the file ``path`` stands for; a last ``index`` is dropped."""
    parts = F.split(path, "/")
    steps = F.filter(F.split(module, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        steps,
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    trimmed = F.when(F.try_element_at(walked, F.lit(-1)) == "index", F.slice(walked, 1, F.greatest(F.size(walked) - 1, F.lit(0)))).otherwise(walked)
    return F.array_join(trimmed, ".")


def python_module(path: Column | str) -> Column:
    """The dotted module of a file: its path without the extension."""
    return F.translate(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/", ".")


def python_relative_module(owner: Column | str, module: Column | str) -> Column:
    """The module that ``.x`` or ``..x`` stands for inside the module ``owner``."""
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    tail = F.regexp_replace(module, r"^\.+", "")
    parts = F.split(owner, r"\.")
    base = F.when(dots <= F.size(parts), F.slice(parts, 1, F.greatest(F.size(parts) - dots, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(base, F.array(tail)), lambda p: p != ""), ".")


JS_ENDINGS = r"\.(ts|tsx|js|jsx|mjs|cjs)$"


def js_module(path: Column | str) -> Column:
    """The dotted module of a JavaScript or TypeScript file; a last ``index`` is dropped."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, JS_ENDINGS, ""), "/index$", ""), "/", ".")


def package_roots(files: DataFrame) -> DataFrame:
    """``disk, name``: folders with an ``__init__.py`` whose parent has none, as the prefix that names have by their path and
    the one that they are imported by. Roots at the top of a repository are imported by their path and are left out."""
    folders = files.where(F.col("path").rlike(r"(^|/)__init__\.py$") & F.contains("path", F.lit("/"))).select(F.regexp_replace("path", r"/__init__\.py$", "").alias("folder")).distinct()
    parent = F.regexp_replace("folder", r"/?[^/]*$", "")
    roots = folders.withColumn("parent", parent).join(folders.select(F.col("folder").alias("parent"), F.lit(True).alias("inner")), "parent", "left").where("inner is null")
    named = roots.select(F.translate("folder", "/", ".").alias("disk"), F.element_at(F.split("folder", "/"), -1).alias("name"))
    return named.where("disk != name")


def _prefixes(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def import_names(names: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``names`` with ``imported``: the name as imports write it, below the longest root that it lies in; null outside of
    roots. Each name meets the roots on its own prefixes, by equality."""
    tried = names.select(column, F.explode(_prefixes(F.col(column))).alias("disk")).join(roots, "disk")
    best = tried.groupBy(column).agg(F.max_by(F.struct("disk", "name"), F.length("disk")).alias("b"))
    told = best.select(column, F.concat(F.col("b.name"), F.substring(F.col(column), F.length("b.disk") + 1, F.length(column))).alias("imported"))
    return names.join(told, column, "left")


def lookup_names(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``lookup, qname``: each symbol under its name by path and under the one imports write; the former wins over the
    latter of another symbol, and of several symbols the first name."""
    both = import_names(symbols.select("qname"), "qname", package_roots(files))
    rows = both.select(F.col("qname").alias("lookup"), "qname", F.lit(0).alias("o")).unionByName(both.where("imported is not null and imported != qname").select(F.col("imported").alias("lookup"), "qname", F.lit(1).alias("o")))
    return rows.groupBy("lookup").agg(F.min_by("qname", F.struct("o", "qname")).alias("qname"))


def file_modules(files: DataFrame) -> DataFrame:
    """``path, module``: the module of each Python file as imports write it, that of scripts by their path."""
    python = files.where("language = 'python'").select("path", F.regexp_replace(python_module("path"), r"\.__init__$", "").alias("module"))
    told = import_names(python.select("module").distinct(), "module", package_roots(files)).select("module", F.coalesce("imported", "module").alias("name"))
    scripts = files.where("language in ('javascript', 'typescript')").select("path", js_module("path").alias("module"))
    return python.join(told, "module").select("path", F.col("name").alias("module")).unionByName(scripts)


def binding_candidates(imports: DataFrame) -> DataFrame:
    """Bindings with the ordered candidates for what they import; default and star imports stand for the module."""
    named = F.col("imported_name").isNotNull() & ~F.col("imported_name").isin("default", "*")
    module = F.coalesce("source_module", F.lit(""))
    relative = module.rlike(r"^\.\.?/")
    target = F.when(relative, js_relative_module("path", module)).otherwise(python_relative_module(python_module("path"), module))
    inside = F.concat_ws(".", target, "imported_name")
    near = F.when(target != "", F.array(F.when(named, inside), target))
    far = F.array(
        F.when(named & (module != ""), F.concat_ws(".", module, "imported_name")), F.when(module != "", module), F.when(named, F.col("imported_name"))
    )
    candidates = F.when(module.startswith("."), near).otherwise(far)
    return imports.withColumn("candidates", F.array_compact(candidates))


def resolve_bindings(imports: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``import_id, path, local_name, target``: the first candidate of each binding that is a symbol. With ``files``,
    symbols below package roots are also found by the names that imports write."""
    tried = binding_candidates(imports).select("import_id", "path", "local_name", F.posexplode("candidates").alias("place", "lookup"))
    names = symbols.select(F.col("qname").alias("lookup"), "qname") if files is None else lookup_names(symbols, files)
    hits = tried.join(names, "lookup")
    return hits.groupBy("import_id", "path", "local_name").agg(F.min_by("qname", "place").alias("target"))


def alias_table(resolved: DataFrame) -> DataFrame:
    """One target per file and local name, that of the last binding."""
    return resolved.where("local_name is not null").groupBy("path", "local_name").agg(F.max_by("target", "import_id").alias("alias_target"))


def _only(symbols: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Names with exactly one symbol per key, counted before any join, so a name with many symbols never meets its edges."""
    return symbols.groupBy(*keys, "name").agg(F.count("*").alias("_n"), F.min("qname").alias(target)).where("_n = 1").drop("_n")


def resolve_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """All edges with ``resolved`` (the target) and ``strategy`` (which pass found it; ``given`` if it was there).

    Each pass sees what the earlier ones left: the file's import aliases, a symbol that is alone with its name in the
    file, among the members of the caller's parent, or anywhere. Scope passes don't link a symbol to itself.
    """
    owners = symbols.join(files.select("file_id", "path"), "file_id", "left").select(F.col("qname").alias("src"), F.col("file_id").alias("_file"), F.col("parent").alias("_parent"), "path")
    aliases = alias_table(resolve_bindings(imports, symbols, files)).withColumnRenamed("local_name", "dst_name")
    in_file = _only(symbols, ["file_id"], "file_target").select(F.col("file_id").alias("_file"), F.col("name").alias("dst_name"), "file_target")
    in_class = _only(symbols.where("parent is not null"), ["parent"], "class_target").select(F.col("parent").alias("_parent"), F.col("name").alias("dst_name"), "class_target")
    anywhere = _only(symbols, [], "unique_target").withColumnRenamed("name", "dst_name")
    open_edges = edges.where("dst is null and dst_name is not null")
    # what an edge resolves to depends on its source and name only: each such pair is looked up once, so that a name or a
    # source with a third of all edges makes few rows; edges get the result back on the pair
    asked = cut_lineage(open_edges.groupBy("src", "dst_name").agg(F.count("*").alias("_n")))
    placed = asked.join(owners, "src", "left")
    tried = placed.join(aliases, ["path", "dst_name"], "left").join(in_file, ["_file", "dst_name"], "left").join(in_class, ["_parent", "dst_name"], "left").join(anywhere, "dst_name", "left")
    file_hit = F.when(F.col("file_target") != F.col("src"), F.col("file_target"))
    class_hit = F.when(F.col("class_target") != F.col("src"), F.col("class_target"))
    strategy = (
        F.when(F.col("alias_target").isNotNull(), PASSES[0])
        .when(file_hit.isNotNull(), PASSES[1])
        .when(class_hit.isNotNull(), PASSES[2])
        .when(F.col("unique_target").isNotNull(), PASSES[3])
    )
    pair = F.sha2(F.to_json(F.struct("src", "dst_name"), {"ignoreNullFields": "false"}), 256).alias("_pair")
    answers = cut_lineage(tried.select(pair, F.coalesce("alias_target", file_hit, class_hit, "unique_target").alias("resolved"), strategy.alias("strategy"), "_n"))
    found = salted_join(open_edges.withColumn("_pair", pair), answers, "_pair", weight="_n", salt="edge_id").select(*edges.columns, "resolved", "strategy")
    given = edges.where("dst is not null or dst_name is null").select("*", F.col("dst").alias("resolved"), F.when(F.col("dst").isNotNull(), "given").alias("strategy"))
    return given.unionByName(found)


def audited(resolved: DataFrame) -> DataFrame:
    """Precision, source and reason as the passes record them (the pass over all names leaves no trace)."""
    traced = F.col("strategy").isin(*PASSES[:3])
    tag = F.when(F.col("strategy") == PASSES[0], "import-alias-resolver").otherwise(F.concat(F.lit("edge-resolver:"), F.col("strategy")))
    source = F.trim(F.coalesce("extraction_source", F.lit("")))
    reason = F.when(F.col("strategy") == PASSES[0], "Resolved via import alias").otherwise(F.concat(F.lit("Resolved via "), F.col("strategy")))
    return resolved.withColumns(
        {
            "precision_level": F.when(traced, F.greatest("precision_level", F.lit(RESOLVER_PRECISION))).otherwise(F.col("precision_level")),
            "extraction_source": F.when(traced, F.when(source == "", tag).otherwise(F.concat_ws("+", source, tag))).otherwise(F.col("extraction_source")),
            "reason": F.when(traced, reason).otherwise(F.col("reason")),
        }
    )
