"""The general data problems against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.hierarchy import _contract_stretch, descendants, hierarchy, parent_links
from tessera.operators.references import orphan_references, orphans_by_period
from tessera.operators.skew import FragmentPlan, heavy_keys, key_counts, key_results, pack_loads, salted_join

T0 = dt.datetime(2024, 1, 1)
EDGES = "id long, src_qname string, dst_qname string, created_at timestamp, name string, there int"
IMPORTS = "id long, target_qname string, state string"
SYMBOLS = "qualified_name string, file_id long, bucket int"
FILES = "id long, indexed_at timestamp, key string"


def day(n):
    return T0 + dt.timedelta(days=n)


def brute_orphans(edges, imports, symbols, files):
    files = {i: t for i, t, _ in files if i is not None}
    of = defaultdict(set)
    for q, f, _ in symbols:
        if q and q.strip():
            of[q.strip()].add(f)
    out = []

    def state(name, at):
        if name not in of:
            return "missing"
        live = [files[f] for f in of[name] if f in files]
        if not live:
            return "deleted"
        known = [t for t in live if t]
        return "late" if at and known and at < min(known) else None

    for i, src, dst, at, *_ in edges:
        for field, name in (("src_qname", src), ("dst_qname", dst)):
            if name and name.strip() and (s := state(name.strip(), at)):
                out.append(("edges", field, i, s))
    for i, name, _ in imports:
        if name and name.strip() and (s := state(name.strip(), None)):
            out.append(("imports", "target_qname", i, s))
    return Counter(out)


def frames(spark, edges, imports, symbols, files):
    make = spark.createDataFrame
    return make(edges, EDGES), make(imports, IMPORTS), make(symbols, SYMBOLS), make(files, FILES)


def test_orphans_match_brute_force(spark):
    r = random.Random(5)
    names = [f"n{i:02d}" for i in range(60)]
    files = [(i, day(r.randrange(20)) if i % 5 else None, "x") for i in range(12)] + [(None, day(1), "x")]
    symbols = [(r.choice([n, n + " ", "\t" + n]), r.choice([None, *range(18)]), 1) for n in names[:40] for _ in range(r.randrange(3))] + [(None, 1, 1), (" ", 1, 1)]
    pick = lambda: r.choice([None, "", "  ", r.choice(names), " " + r.choice(names), "hot", "hot"])
    edges = [(i, pick(), pick(), r.choice([None, day(r.randrange(25))]), "c", 1) for i in range(300)]
    edges += edges[:20]
    imports = [(i, pick(), "s") for i in range(80)]
    got = orphan_references(*frames(spark, edges, imports, symbols, files))
    rows = Counter((x.ref_table, x.ref_field, x.row_id, x.ref_state) for x in got.collect())
    assert rows == brute_orphans(edges, imports, symbols, files)
    report = orphans_by_period(got).collect()
    assert sum(x.n_refs for x in report) == sum(rows.values())
    assert {x.period for x in report if x.ref_table == "imports"} == {"unknown"}


def test_orphans_of_empty_tables(spark):
    assert orphan_references(*frames(spark, [], [], [], [])).count() == 0
    one = frames(spark, [(1, "a", None, None, "c", 1)], [], [], [])
    assert [x.ref_state for x in orphan_references(*one).collect()] == ["missing"]


def test_salted_join_splits_a_hot_key_and_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "key string, id long")
    keyed = rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n")
    got = salted_join(rows, keyed, "key", weight="n", salt="id", shard_rows=100)
    assert got.count() == 3000 and got.where("key = 'hot' and n = 2000").count() == 2000


def test_loads_are_packed_evenly():
    placed = pack_loads([(i, n) for i, n in enumerate([50, 40, 30, 20, 10, 10])], 2)
    loads = Counter()
    for i, n in enumerate([50, 40, 30, 20, 10, 10]):
        loads[placed[i]] += n
    assert max(loads.values()) == 80


def test_key_results_match_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice(["CALLS", "TESTS", None]), r.choice(["get"] * 12 + ["a", "b", None, f"n{r.randrange(40)}"]), r.choice([None, f"s{r.randrange(30)}"]), r.choice([None, r.random()]), 7) for _ in range(2000)]
    df = spark.createDataFrame(rows, "edge_type string, dst_name string, src_qname string, confidence double, task int")
    side = spark.createDataFrame([("CALLS", "get")] * 3 + [(None, None), ("TESTS", "none")], "edge_type string, dst_name string")
    got = {(x.edge_type, x.dst_name): x for x in key_results(df, ["edge_type", "dst_name"], distinct="src_qname", mean="confidence", side=side, tasks=5).collect()}
    by = defaultdict(list)
    for e, d, s, c, _ in rows:
        by[e, d].append((s, c))
    assert set(got) == set(by)
    sides = Counter([("CALLS", "get")] * 3 + [(None, None)])
    for k, v in by.items():
        assert got[k].n_rows == len(v) and got[k].distinct_src_qname == len({s for s, _ in v if s})
        known = [c for _, c in v if c is not None]
        assert got[k].n_confidence == len(known) and (not known or abs(got[k].mean_confidence - sum(known) / len(known)) < 1e-9)
        assert got[k].n_matches == len(v) * sides[k]
    heavy = {(x.edge_type, x.dst_name) for x in heavy_keys(key_results(df, ["edge_type", "dst_name"], distinct="src_qname", mean="confidence"), 0.02).collect()}
    assert heavy == {k for k, v in by.items() if len(v) > 0.02 * len(rows)}


def test_no_task_gets_much_more_than_its_share(spark):
    df = spark.createDataFrame([("CALLS", "get" if i % 10 < 6 else f"n{i % 97}", f"s{i}") for i in range(20_000)], "edge_type string, dst_name string, src string")
    plan = FragmentPlan(key_counts(df, ["edge_type", "dst_name"]), ["edge_type", "dst_name"], tasks=8)
    loads = [x["count"] for x in plan.route(df, ["src"]).groupBy("task").count().collect()]
    assert sum(loads) == 20_000 and max(loads) < 1.4 * 20_000 / 8 and plan.n_large >= 1


def test_key_results_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string, c double")
    assert key_results(df, ["a"], distinct="b", mean="c").count() == 0


def brute_tree(parents):
    out = {}
    for n in parents:
        path, seen = [n], {n}
        while (up := parents[path[-1]]) is not None and up not in seen:
            path.append(up)
            seen.add(up)
        end = parents[path[-1]]
        out[n] = ("tree", path[-1], len(path) - 1, tuple(reversed(path))) if end is None else ("cycle" if end == n else "below", "", -1 if end == n else -2, None)
    return out


def check_tree(spark, parents, **options):
    links = spark.createDataFrame(list(parents.items()), "node string, parent string")
    solved = hierarchy(links, **options)
    rows = {x.node: x for x in solved.collect()}
    want = brute_tree(parents)
    assert {n: (x.status, x.root, x.depth, tuple(x.path) if x.path else None) for n, x in rows.items()} == want
    below = Counter(a for x in want.values() if x[3] for a in x[3][:-1])
    assert all(x.n_descendants == (below[n] if x.status == "tree" else None) for n, x in rows.items())
    pairs = {(x.node, x.descendant, x.distance) for x in descendants(solved).collect()}
    assert pairs == {(a, n, len(x[3]) - 1 - i) for n, x in want.items() if x[3] for i, a in enumerate(x[3][:-1])}


def random_parents(seed, n):
    r = random.Random(seed)
    return {f"n{i}": None if r.random() < 0.1 else (f"n{i - 1}" if r.random() < 0.5 and i else f"n{r.randrange(n)}") for i in range(n)}


@pytest.mark.parametrize("rows", [1, 5, 40])
def test_tree_contraction_in_stretches_of_any_size(spark, rows):
    check_tree(spark, random_parents(rows, 60), stretch_rows=rows)


def test_tree_contraction_of_a_chain_and_random_trees(spark):
    check_tree(spark, {f"c{i}": f"c{i - 1}" if i else None for i in range(150)} | random_parents(3, 80))


@given(st.lists(st.one_of(st.none(), st.integers(0, 11)), min_size=1, max_size=12), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_one_stretch_is_contracted_exactly(parents, elsewhere):
    """Nodes of one stretch in memory, some of whose children are elsewhere: what is taken out hangs from what stays."""
    n = len(parents)
    up = {f"n{i}": None if p is None else f"n{p % n}" for i, p in enumerate(parents)}
    here = [f"n{i}" for i in range(n - min(elsewhere, n - 1))]
    kids = Counter(u for u in up.values() if u)
    rows = [{"node": x, "up": up[x], "hops": 1, "via": [], "size": 0, "extra": 0, "n_children": kids[x]} for x in here]
    schema = pa.schema([("node", pa.string()), ("up", pa.string()), ("hops", pa.int32()), ("via", pa.list_(pa.string())), ("size", pa.int64()), ("extra", pa.int64()), ("n_children", pa.int64())])
    out = [r for b in _contract_stretch(iter([pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()]
    stays = {r["node"] for r in out if not r["taken"]} | (set(up) - set(here))
    assert {r["node"] for r in out} == set(here)
    for r in out:
        walk, at = [], up[r["node"]]
        for _ in range(r["hops"] - 1):
            walk.append(at)
            at = up[at]
        if r["up"] is not None:
            assert r["via"] == walk and at == r["up"]
        if r["taken"]:
            assert r["up"] in stays and (r["child"] is None or r["child"] in stays) and not kids[r["node"]] - sum(up[x] == r["node"] for x in here)


def test_parent_links_clean_names(spark):
    df = spark.createDataFrame([(" a ", None, 1), ("b", "\ta", 1), ("b", "a ", 1), ("c", " ", 1), ("d", "gone", 1), (None, "a", 1), ("", "a", 1)], "q string, p string, node int")
    assert {tuple(x) for x in parent_links(df, "q", "p").collect()} == {("a", None), ("b", "a"), ("c", None), ("d", None)}
    assert hierarchy(parent_links(df.limit(0), "q", "p")).count() == 0
