"""References to records that do not exist, found by run-compressed parent keys and an as-of match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_or_null
from tessera.operators.skew import salted_join
from tessera.session import cut_lineage

BUCKETS = 4096
"""Hash ranges in which names get their integer keys. A bucket is one window group; it holds distinct names only, so
its size is the number of distinct names over ``BUCKETS`` whatever the skew of the references."""


def number_names(names: DataFrame, name: str = "name", buckets: int = BUCKETS) -> DataFrame:
    """Give each distinct name an integer key: ``bucket`` and its place ``key`` (from 1) in the bucket's name order.

    Names that exist and stand beside each other in that order get adjacent keys, so existing keys form long runs
    that are only broken by names that do not exist. ``names`` must hold each name once; an empty table gives none.
    """
    bucketed = names.withColumn("bucket", F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int"))
    return bucketed.withColumn("key", F.row_number().over(Window.partitionBy("bucket").orderBy(name)))


def compress_runs(keyed: DataFrame, present: Column) -> DataFrame:
    """The keys for which ``present`` holds as maximal runs of consecutive integers: ``bucket, run_start, run_end``."""
    w = Window.partitionBy("bucket").orderBy("key")
    flag = F.when(present, 1).otherwise(0)
    islands = keyed.select("bucket", "key", flag.alias("present"), (F.col("key") - F.sum(flag).over(w)).alias("island"))
    return (
        islands.where("present = 1")
        .groupBy("bucket", "island")
        .agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"))
        .drop("island")
    )


def asof_runs(keyed: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """Match each key with the preceding run start of each run set and add ``beyond_<set>``: the key lies past that
    run's end (or no run starts before it), so the set has no such key. Keys before all runs are beyond as well."""
    columns = keyed.columns
    side = keyed.withColumns({"_order": F.lit(1), **{f"_end_{s}": F.lit(None).cast("int") for s in runs}})
    for s, df in runs.items():
        ends = {f"_end_{x}": (F.col("run_end") if x == s else F.lit(None)).cast("int") for x in runs}
        side = side.unionByName(
            df.select("bucket", F.col("run_start").alias("key"), F.lit(0).alias("_order"), *[c.alias(n) for n, c in ends.items()]),
            allowMissingColumns=True,
        )
    w = Window.partitionBy("bucket").orderBy("key", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = side.withColumns({f"_at_{s}": F.last(f"_end_{s}", ignorenulls=True).over(w) for s in runs})
    return matched.where("_order = 1").select(
        *columns, *[(F.col(f"_at_{s}").isNull() | (F.col("key") > F.col(f"_at_{s}"))).alias(f"beyond_{s}") for s in runs]
    )


def reference_rows(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Each reference that names something: ``ref_table, ref_field, row_id, name, created_at`` (null for imports)."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("ref_field"), name_or_null(f).alias("name")) for f in ("src_qname", "dst_qname")]
    )
    from_edges = edges.select(F.lit("edges").alias("ref_table"), F.col("id").alias("row_id"), "created_at", F.inline(pairs))
    from_imports = imports.select(
        F.lit("imports").alias("ref_table"),
        F.col("id").alias("row_id"),
        F.lit(None).cast(edges.schema["created_at"].dataType).alias("created_at"),
        F.lit("target_qname").alias("ref_field"),
        name_or_null("target_qname").alias("name"),
    )
    return from_edges.unionByName(from_imports).where("name is not null")


def parent_names(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbol rows as parents: ``name``, whether their file is there, and when that file was indexed."""
    there = files.select(F.col("id").alias("file_id"), "indexed_at", F.lit(1).alias("there")).where("file_id is not null")
    named = symbols.select(name_or_null("qualified_name").alias("name"), "file_id").where("name is not null")
    # a file with very many symbols is one hot join key: names are made distinct first
    return named.distinct().join(there, "file_id", "left").select("name", "there", "indexed_at")


def classify_names(references: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per distinct name that is referred to and for which some reference may be a case.

    ``state`` is ``missing``, ``deleted`` or ``late`` (then only references before ``first_indexed`` are cases);
    ``n_refs`` is the number of references to the name.
    """
    time = references.schema["created_at"].dataType
    null_time = F.lit(None).cast(time)
    both = references.select(
        "name", "created_at", F.lit(1).alias("ref"), F.lit(0).alias("symbol"), F.lit(0).alias("there"), null_time.alias("indexed_at")
    ).unionByName(
        parents.select(
            "name", null_time.alias("created_at"), F.lit(0).alias("ref"), F.lit(1).alias("symbol"),
            F.coalesce("there", F.lit(0)).alias("there"), F.col("indexed_at").cast(time).alias("indexed_at"),
        )
    )
    names = both.groupBy("name").agg(
        F.sum("ref").alias("n_refs"),
        F.max("symbol").alias("symbol"),
        F.max("there").alias("there"),
        F.min("created_at").alias("first_used"),
        F.min("indexed_at").alias("first_indexed"),
    )
    keyed = number_names(names)
    runs = {"all": compress_runs(keyed, F.col("symbol") == 1), "live": compress_runs(keyed, F.col("there") == 1)}
    matched = asof_runs(keyed.where("n_refs > 0").select("bucket", "key", "name", "n_refs", "first_used", "first_indexed"), runs)
    state = (
        F.when(F.col("beyond_all"), "missing")
        .when(F.col("beyond_live"), "deleted")
        .when(F.col("first_used") < F.col("first_indexed"), "late")
    )
    return matched.select("name", "n_refs", "first_indexed", state.alias("state")).where("state is not null")


def orphan_references(edges: DataFrame, imports: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Every reference of ``edges.src_qname``, ``edges.dst_qname`` and ``imports.target_qname`` without a live target.

    Columns ``ref_table, ref_field, row_id, ref_state, created_at``. Null and blank references are no cases; names
    compare after white space at both ends is removed; a null ``created_at`` is never late; repeated rows count each;
    other columns of the inputs play no part. With an empty ``symbols`` or ``files`` every reference is missing or
    deleted; with empty references the result is empty.
    """
    references = reference_rows(edges, imports)
    flagged = cut_lineage(classify_names(references, parent_names(symbols, files)))
    joined = salted_join(references, flagged, "name", weight="n_refs", salt="row_id")
    state = F.when(F.col("state") != "late", F.col("state")).when(
        (F.col("ref_table") == "edges") & (F.col("created_at") < F.col("first_indexed")), "late"
    )
    return joined.select("ref_table", "ref_field", "row_id", state.alias("ref_state"), "created_at").where("ref_state is not null")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, state and month (``unknown`` where ``created_at`` is null, as for all imports)."""
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown"))
    return orphans.groupBy("ref_table", "ref_field", "ref_state", month.alias("period")).agg(F.count("*").alias("n_refs"))
