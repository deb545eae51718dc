"""Full hierarchies from parent-child rows by parallel tree contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import name_or_null
from tessera.session import cut_lineage, parallelism, release

TREE, CYCLE, BELOW = "tree", "cycle", "below"
STRETCH_ROWS = 20_000
"""Live nodes of one stretch of names, which one task contracts inside; larger trees have more stretches."""
STEP = "node string, up string, hops int, via array<string>, size long, extra long, child string, between long, taken boolean, idle boolean"


def parent_links(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Distinct nodes with their parent: ``node, parent`` (null for roots).

    Names are stripped; rows without a node name are left out; a parent that is no node counts as none. Where rows of
    one node disagree the least existing parent name is taken.
    """
    named = rows.select(name_or_null(node).alias("node"), name_or_null(parent).alias("parent")).where("node is not null").distinct()
    nodes = named.select(F.col("node").alias("parent")).distinct().withColumn("known", F.lit(True))
    known = named.join(nodes, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    return known.groupBy("node").agg(F.min("parent").alias("parent"))


def _contract(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One rake and one compress: the live nodes that remain, the nodes taken out with what undoes it, and the
    intermediate table both are read from.

    Live nodes have ``node, up`` (live parent, null at a root), ``hops`` (original edges to it), ``via`` (the nodes
    spliced out in between, nearest to the node first), ``size`` (descendants already folded into the node) and
    ``extra`` (the nodes spliced out above it, with all that was folded into them).
    """
    # rake: a leaf hands its size to its parent; sums are made before the shuffle, so wide parents are harmless
    children = live.where("up is not null").groupBy(F.col("up").alias("node")).agg(
        F.count("*").alias("n_children"), F.min("node").alias("child")
    )
    counted = live.join(children, "node", "left")
    leaf = F.col("n_children").isNull() & F.col("up").isNotNull()
    folded = counted.where(leaf).groupBy(F.col("up").alias("node")).agg(
        F.count("*").alias("raked"), F.sum(F.col("size") + F.col("extra") + F.lit(1)).alias("raked_size")
    )
    seen = cut_lineage(
        counted.join(folded, "node", "left").select(
            "node", "up", "hops", "via",
            (F.col("size") + F.coalesce("raked_size", F.lit(0))).alias("size"),
            "extra",
            leaf.alias("leaf"),
            (F.coalesce("n_children", F.lit(0)) - F.coalesce("raked", F.lit(0))).alias("left"),
            "n_children", "child",
        )
    )
    raked = seen.where("leaf").select(
        "node", "up", "hops", "via", "size", "extra", F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("between")
    )
    kept = seen.where("not leaf")

    # compress: splice out inner nodes with exactly one child, no two of them neighbours (by coins that change each turn)
    coin = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    only_child = F.when((F.col("left") == 1) & (F.col("n_children") == 1), F.col("child"))
    inner = kept.select(
        "node", "up", "hops", "via", "size", "extra",
        only_child.alias("only_child"),
        # a root or the last node of a cycle, with nothing else left below it
        (F.when(F.col("up").isNull(), F.col("left") == 0).otherwise((F.col("up") == F.col("node")) & (F.col("left") == 1))).alias("idle"),
    )
    chain = inner.where("only_child is not null and up is not null and up != node")
    heads = chain.where(coin).select("node", "up", "hops", "via", "size", "extra", "only_child")
    tails = chain.where(~coin).select(F.col("node").alias("only_child"), F.col("extra").alias("between"))
    ends = inner.where("only_child is null").select(F.col("node").alias("only_child"), F.col("extra").alias("between"))
    # the child must stay in this step: it is no chain node at all, or one with the other coin
    spliced = heads.join(tails.unionByName(ends), "only_child")
    jump = spliced.select(
        F.col("only_child").alias("node"), F.col("node").alias("mid"), F.col("up").alias("new_up"),
        F.col("hops").alias("mid_hops"), F.col("via").alias("mid_via"), (F.col("size") + F.col("extra") + F.lit(1)).alias("mid_extra"),
    )
    remaining = (
        inner.join(spliced.select("node"), "node", "left_anti")
        .join(jump, "node", "left")
        .select(
            "node",
            F.when(F.col("mid").isNull(), F.col("up")).otherwise(F.col("new_up")).alias("up"),
            F.when(F.col("mid").isNull(), F.col("hops")).otherwise(F.col("hops") + F.col("mid_hops")).alias("hops"),
            F.when(F.col("mid").isNull(), F.col("via")).otherwise(F.concat("via", F.array("mid"), "mid_via")).alias("via"),
            "size",
            (F.col("extra") + F.coalesce("mid_extra", F.lit(0))).alias("extra"),
            "idle",
        )
    )
    compressed = spliced.select("node", "up", "hops", "via", "size", "extra", F.col("only_child").alias("child"), "between")
    return remaining, raked.unionByName(compressed), seen


def _contract_stretches(live: DataFrame, n_live: int, stretch_rows: int) -> DataFrame:
    """Rake and compress inside stretches of neighbouring names: rows of ``STEP``, what remains and what was taken out.

    Names of one tree mostly share their beginning, so one shuffle by ranges of names does the work of many global
    steps. Names are distinct, so stretches are even whatever the shape of the trees.
    """
    children = live.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    counted = live.join(children, "node", "left").select("node", "up", "hops", "via", "size", "extra", F.coalesce("n_children", F.lit(0)).alias("n_children"))
    stretches = max(1, min(4 * parallelism(live.sparkSession), -(-n_live // stretch_rows)))
    return counted.repartitionByRange(stretches, "node").mapInArrow(_contract_stretch, STEP)


def _contract_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the nodes of one stretch as far as their neighbours are in it.

    A leaf is raked if its parent is here; an inner node is spliced out if its only child is here. So a node with a child
    elsewhere is never taken out, and what is taken out hangs from one that stays, after what went later is looked through.
    """
    rows = [r for batch in batches for r in batch.to_pylist()]
    at = {r["node"]: r for r in rows}
    below: dict[str, set[str]] = {}
    for r in rows:
        if r["up"] in at:
            below.setdefault(r["up"], set()).add(r["node"])
    gone: dict[str, dict] = {}
    todo = [r["node"] for r in rows]
    while todo:
        node = todo.pop()
        r = at[node]
        up = r["up"]
        if node in gone or up is None or up == node:
            continue
        here = below.get(node, ())
        if not r["n_children"] and up in at:
            gone[node] = r | {"child": None, "between": None}
            parent = at[up]
            parent["size"] += r["size"] + r["extra"] + 1
            parent["n_children"] -= 1
            below[up].discard(node)
            todo.append(up)
        elif r["n_children"] == 1 and len(here) == 1:
            (child,) = here
            c = at[child]
            gone[node] = r | {"child": child, "between": c["extra"]}
            c["up"], c["hops"], c["via"] = up, c["hops"] + r["hops"], [*c["via"], node, *r["via"]]
            c["extra"] += r["size"] + r["extra"] + 1
            if up in at:
                below[up].discard(node)
                below[up].add(child)
                todo.append(up)
    # what was taken out hangs from what stays: look through those that went later
    for node in reversed(gone):
        r = gone[node]
        if (above := gone.get(r["up"])) is not None:
            r["hops"] += above["hops"]
            r["via"] = [*r["via"], r["up"], *above["via"]]
            r["up"] = above["up"]
        if (lower := gone.get(r["child"])) is not None:
            if lower["child"] is None:
                r["size"], r["between"] = r["size"] + r["between"] + 1 + lower["size"], None
            else:
                r["between"] += 1 + lower["size"] + lower["between"]
            r["child"] = lower["child"]
    out = []
    for r in rows:
        taken = gone.get(r["node"])
        if taken is not None:
            out.append(taken | {"taken": True, "idle": False})
        else:
            idle = r["n_children"] == 0 if r["up"] is None else r["up"] == r["node"] and r["n_children"] == 1
            out.append(r | {"child": None, "between": None, "taken": False, "idle": idle})
    schema = pa.schema(
        [("node", pa.string()), ("up", pa.string()), ("hops", pa.int32()), ("via", pa.list_(pa.string())), ("size", pa.int64()), ("extra", pa.int64()),
         ("child", pa.string()), ("between", pa.int64()), ("taken", pa.bool_()), ("idle", pa.bool_())]
    )
    for i in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema)


def _contract_once(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One global rake and compress as rows of ``STEP``, and the table to release once they are written."""
    remaining, record, seen = _contract(live, turn)
    left = remaining.withColumns({"child": F.lit(None).cast("string"), "between": F.lit(None).cast("long"), "taken": F.lit(False)})
    return left.unionByName(record.withColumns({"taken": F.lit(True), "idle": F.lit(False)})), seen


def hierarchy(links: DataFrame, max_rounds: int = 200, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Root, depth, path and number of descendants of every node of ``links`` (``node, parent``; see ``parent_links``).

    Columns ``node, status, root, depth, path, n_descendants``. ``status`` is ``tree``, ``cycle`` (the node lies on a
    cycle) or ``below`` (it only hangs below one); the latter two have root ``''``, depth -1 and -2, a null path and
    null descendants. Rounds of leaf raking and unary-chain splicing shrink every tree to its root, in turn inside
    stretches of ``stretch_rows`` neighbouring names and over all nodes at once; the latter alone ends in a number of
    rounds that is logarithmic in the size of a tree whatever its depth. The recorded contractions are then undone in
    reverse order. What cannot shrink further is one node per cycle, its own parent. An empty table gives no rows.
    """
    live = first = cut_lineage(
        links.select(
            "node", F.col("parent").alias("up"), F.lit(1).alias("hops"), F.array().cast("array<string>").alias("via"),
            F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("extra"),
        )
    )
    n_live = live.count()
    rounds: list[DataFrame] = []
    cores: list[DataFrame] = []
    for turn in range(max_rounds):
        if turn % 2:
            step, seen = _contract_once(live, turn)
            both = cut_lineage(step)
            release(seen)
        else:
            both = cut_lineage(_contract_stretches(live, n_live, stretch_rows))
        rounds.append(both)
        cores.append(_solve_idle(both.where("idle")))
        live = both.where("not taken and not idle").drop("taken", "idle", "child", "between")
        n_live = live.count()
        if not n_live:
            break
    else:
        raise RuntimeError(f"the hierarchy did not contract in {max_rounds} rounds")
    solved = cut_lineage(reduce(DataFrame.unionByName, cores))
    for both in reversed(rounds):
        grown = cut_lineage(_undo(solved, both.where("taken").drop("taken", "idle")))
        release(solved)
        solved = grown
    release(first, *rounds)
    return solved


def _solve_idle(cores: DataFrame) -> DataFrame:
    tree = F.col("up").isNull()
    return cores.select(
        "node",
        F.when(tree, TREE).otherwise(CYCLE).alias("status"),
        F.when(tree, F.col("node")).otherwise("").alias("root"),
        F.when(tree, F.lit(0)).otherwise(F.lit(-1)).alias("depth"),
        F.when(tree, F.array("node")).alias("path"),
        F.when(tree, F.col("size")).alias("n_descendants"),
    )


def _undo(solved: DataFrame, record: DataFrame) -> DataFrame:
    """Put the nodes of one contraction back: first those spliced out (their child is solved), then the raked leaves."""
    spliced = _attach(solved, record.where("child is not null"))
    grown = solved.unionByName(spliced)
    return grown.unionByName(_attach(grown, record.where("child is null")))


def _attach(solved: DataFrame, record: DataFrame) -> DataFrame:
    anchor = solved.select(
        F.col("node").alias("up"), F.col("status").alias("up_status"), F.col("root").alias("up_root"),
        F.col("depth").alias("up_depth"), F.col("path").alias("up_path"),
    )
    below = solved.select(F.col("node").alias("child"), F.col("status").alias("child_status"), F.col("n_descendants").alias("child_size"))
    placed = record.join(anchor, "up").join(below, "child", "left")
    status = (
        F.when(F.col("child_status") == CYCLE, CYCLE).when(F.col("up_status") == TREE, TREE).otherwise(BELOW)
    )
    placed = placed.withColumn("status", status)
    tree = F.col("status") == TREE
    return placed.select(
        "node",
        "status",
        F.when(tree, F.col("up_root")).otherwise("").alias("root"),
        F.when(tree, F.col("up_depth") + F.col("hops")).when(F.col("status") == CYCLE, -1).otherwise(-2).alias("depth"),
        F.when(tree, F.concat("up_path", F.reverse("via"), F.array("node"))).alias("path"),
        F.when(tree, F.col("size") + F.coalesce(F.col("child_size") + F.col("between") + F.lit(1), F.lit(0))).alias("n_descendants"),
    )


def descendants(solved: DataFrame) -> DataFrame:
    """Every pair of a node and one of its descendants: ``node, descendant, distance``. Each node's path lists its
    ancestors, so the pairs come from one row at a time and a root with very many descendants is no group."""
    pairs = solved.where("path is not null").select(
        F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("place", "ancestor"), "node", "depth"
    )
    return pairs.select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), (F.col("depth") - F.col("place")).alias("distance"))
