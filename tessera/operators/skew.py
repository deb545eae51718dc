"""Per-key processing that keeps all tasks equally loaded, however few keys hold most rows."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, parallelism

MAX_HEAVY = 4096
"""Most keys that are split. A key is split only if it holds more than one ``MAX_HEAVY``-th of all rows, so there
are never more than this many; that bounds what is sent to the driver and broadcast."""


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, *, weight: str, salt: str, shard_rows: int = 250_000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (each key once, ``weight`` = rows per key) that splits heavy keys.

    A key with more than ``shard_rows`` rows, and more than one ``MAX_HEAVY``-th of the weight, gets proportionate
    shards: its rows spread over them by a hash of ``salt``, its one row of ``keyed`` is repeated for each shard.
    ``keyed`` should be materialised, since its total weight is read first. Null keys match nothing.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    size = max(shard_rows, total // MAX_HEAVY + 1)
    heavy = keyed.where(F.col(weight) > size).select(key, F.ceil(F.col(weight) / size).cast("int").alias("_shards"))
    shards = F.coalesce("_shards", F.lit(1))
    left = rows.join(F.broadcast(heavy), key, "left").withColumn(
        "_shard", F.when(F.col("_shards").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt), shards)).cast("int")
    )
    right = keyed.join(F.broadcast(heavy), key, "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    return left.drop("_shards").join(right.drop("_shards"), [key, "_shard"]).drop("_shard")


def pack_loads(loads: list[tuple[object, int]], tasks: int) -> dict[object, int]:
    """Longest-processing-time bin packing of ``(item, load)`` into ``tasks``; ties go to the lower task, then item order."""
    heap = [(0, t) for t in range(tasks)]
    placed = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        total, task = heapq.heappop(heap)
        placed[item] = task
        heapq.heappush(heap, (total + load, task))
    return placed


class FragmentPlan:
    """Where the rows of each key go: whole small keys by packed groups of keys, large keys by shards.

    ``counts`` holds each key once with its ``load`` (rows to route) and should be written, since it is read more than
    once. Keys above ``total / (tasks * split)`` rows are large: at most ``tasks * split`` of them exist, so they may be
    collected and broadcast. All other keys fall into
    ``tasks * groups_per_task`` hash groups (at most ``2 * MAX_HEAVY``), whose loads (a bounded number of sums) are packed like the shards.
    """

    def __init__(self, counts: DataFrame, keys: list[str], tasks: int | None = None, split: int = 2, groups_per_task: int = 32, load: str = "n_rows"):
        spark = counts.sparkSession
        counts = counts.select(*keys, F.col(load).alias("n_rows"))
        self.keys, self.tasks = keys, min(tasks or parallelism(spark), MAX_HEAVY)
        self.groups = max(2 * self.tasks, min(self.tasks * groups_per_task, 2 * MAX_HEAVY))
        self.total = counts.agg(F.sum("n_rows")).first()[0] or 0
        self.size = max(1, math.ceil(self.total / (self.tasks * split)))
        large = counts.where(F.col("n_rows") > self.size).select(*keys, "n_rows").collect()
        light = (
            counts.where(F.col("n_rows") <= self.size)
            .groupBy(self.group_of().alias("g"))
            .agg(F.sum("n_rows").alias("n"))
            .collect()
        )
        shards = {tuple(r[k] for k in keys): math.ceil(r["n_rows"] / self.size) for r in large}
        loads = [(("group", r["g"]), r["n"]) for r in light]
        of = [shards[tuple(r[k] for k in keys)] for r in large]
        loads += [(("key", i, s), r["n_rows"] // of[i]) for i, r in enumerate(large) for s in range(of[i])]
        placed = pack_loads(loads, self.tasks)
        self.group_tasks = [placed.get(("group", g), g % self.tasks) for g in range(self.groups)]
        schema = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
        self.large = spark.createDataFrame(
            [(*(r[k] for k in keys), [placed["key", i, s] for s in range(of[i])]) for i, r in enumerate(large)],
            f"{schema}, _tasks array<int>",
        )
        self.n_large = len(large)

    def group_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.groups)).cast("int")

    def _located(self, df: DataFrame) -> DataFrame:
        same = [df[k].eqNullSafe(self.large[k]) for k in self.keys]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        return df.join(F.broadcast(self.large), condition, "left").select(df["*"], "_tasks")

    def _group_task(self) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in self.group_tasks]), self.group_of() + 1)

    def route(self, df: DataFrame, salt: list[str]) -> DataFrame:
        """``df`` with ``task``: rows of a large key spread over its shards by a hash of ``salt``."""
        at = F.pmod(F.xxhash64(*salt), F.size("_tasks")).cast("int") + 1
        task = F.when(F.col("_tasks").isNull(), self._group_task()).otherwise(F.element_at("_tasks", at))
        return self._located(df).withColumn("task", task).drop("_tasks").repartitionById(self.tasks, "task")

    def replicate(self, side: DataFrame) -> DataFrame:
        """The matching side: rows of small keys go to their one task, rows of large keys to each task of a shard."""
        tasks = F.when(F.col("_tasks").isNull(), F.array(self._group_task())).otherwise(F.array_distinct("_tasks"))
        located = self._located(side).withColumn("task", F.explode(tasks)).drop("_tasks")
        return located.repartitionById(self.tasks, "task")


def key_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key. The sums are made before the shuffle, so a hot key sends one row per task."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def key_results(
    rows: DataFrame, keys: list[str], *, distinct: str, mean: str, side: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """Per key: ``n_rows``, ``n_<mean>`` (not null), ``mean_<mean>``, ``distinct_<distinct>`` and, where ``side`` (keys
    and other columns) is given, ``n_matches``, the pairs of a row and a row of ``side`` with the same key.

    Rows are first summed per key and value of ``distinct``, map-side before the shuffle; that table is written once and
    carries the estimated loads. Its rows of a large key are spread over shards by ``distinct``, so distinct values are
    counted whole inside a shard and the shards only add up; nothing but sums per shard moves afterwards. Null keys form keys of their own (and
    match nulls of ``side``); null ``distinct`` and ``mean`` values are not counted. An empty table gives no rows;
    names of other columns do not matter.
    """
    left = rows.select(*keys, F.col(distinct).alias("_distinct"), F.col(mean).cast("double").alias("_mean"))
    # one row per key and value before anything is routed: a value with most rows of a key is one row
    per_value = cut_lineage(
        left.groupBy(*keys, "_distinct").agg(F.count("*").alias("n"), F.count("_mean").alias("n_mean"), F.sum("_mean").alias("total"))
    )
    counts = cut_lineage(per_value.groupBy(*keys).agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows")))
    plan = FragmentPlan(counts, keys, tasks, load="n_values")
    per_value = plan.route(per_value, ["_distinct"])
    per_shard = per_value.groupBy("task", *keys).agg(
        F.sum("n").alias("n"), F.sum("n_mean").alias("n_mean"), F.sum("total").alias("total"), F.count("_distinct").alias("callers")
    )
    if side is not None:
        matching = plan.replicate(side.select(*keys)).groupBy("task", *keys).agg(F.count("*").alias("side_rows"))
        on = per_shard["task"] == matching["task"]
        for k in keys:
            on = on & per_shard[k].eqNullSafe(matching[k])
        per_shard = per_shard.join(matching, on, "left").select(
            per_shard["*"], (F.col("n") * F.coalesce("side_rows", F.lit(0))).alias("matches")
        )
    result = per_shard.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum("n_mean").alias(f"n_{mean}"),
        (F.sum("total") / F.sum("n_mean")).alias(f"mean_{mean}"),
        F.sum("callers").alias(f"distinct_{distinct}"),
        *([F.sum("matches").alias("n_matches")] if side is not None else []),
    )
    return result


def heavy_keys(results: DataFrame, share: float = 0.02) -> DataFrame:
    """Keys of ``key_results`` that hold more than ``share`` of all rows."""
    total = results.agg(F.sum("n_rows").alias("_total"))
    return results.join(F.broadcast(total), F.col("n_rows") > F.col("_total") * F.lit(share)).drop("_total")
