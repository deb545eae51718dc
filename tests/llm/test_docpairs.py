"""Comments go to the function of a file that they fit best, however many functions or lines lie between."""

import random

from tessera.llm import docpairs
from tessera.llm.docpairs import REACH, groups, link_weight, pair_documentation, pair_group, tag_names

ABOUT = "Waits for the last reader of {}.\n@param {} rows that were fixed before noon"


def row(line, name, parameter, doc=None, key=None):
    return (line, f"m.{name}", key or name, 1, name, f"def {name}({parameter})", doc)


def test_comment_goes_past_other_functions():
    rows = [row(10, "fa", "x", ABOUT.format("fd", "limit")), row(20, "fb", "x"), row(30, "fc", "x"), row(40, "fd", "limit")]
    assert [x[0] for x in pair_group(rows)] == ["fd"]


def test_comment_goes_on_to_an_overload():
    """The comment in the way of a better one goes to the function of the same name whose parameter it tells."""
    rows = [row(10, "fa", "x", ABOUT.format("fd", "limit")), row(11, "fd", "limit", "@param other rows fixed before noon", "one"), row(12, "fd", "other", None, "two")]
    assert [x[0] for x in pair_group(rows)] == ["one", "two"]


def test_comment_goes_over_the_line_of_a_stretch(spark):
    rows = [(1, 1, "function", "fa", "m.fa", 509, "def fa(x)", ABOUT.format("fb", "limit")), (2, 1, "function", "fb", "m.fb", 515, "def fb(limit)", None)]
    rows += [(3, 2, "function", "fa", "m.fa", 509, "def fa(x)", ABOUT.format("fb", "limit")), (4, 3, "function", "fb", "m.fb", 515, "def fb(limit)", None)]
    df = spark.createDataFrame(rows, "id long, file_id long, kind string, name string, qualified_name string, start_line int, signature string, docstring string")
    assert sorted(r.symbol_id for r in pair_documentation(df).collect()) == [2, 3]


def test_an_unknown_line_is_no_distance(spark):
    rows = [(1, 1, "function", "fa", "m.fa", None, "def fa(x)", ABOUT.format("fb", "limit")), (2, 1, "function", "fb", "m.fb", 5000, "def fb(limit)", None)]
    rows += [(3, None, "function", "fa", "o.fa", None, "def fa(x)", ABOUT.format("fb", "limit")), (4, None, "function", "fb", "o.fb", None, "def fb(limit)", None)]
    df = spark.createDataFrame(rows, "id long, file_id long, kind string, name string, qualified_name string, start_line int, signature string, docstring string")
    assert sorted(r.symbol_id for r in pair_documentation(df).collect()) == [2, 4]


def test_rows_that_nothing_places_are_no_group(spark):
    """Neither file, name nor line: a comment cannot go to another such row."""
    rows = [(1, None, "function", "fa", None, None, "def fa(x)", ABOUT.format("fb", "limit")), (2, None, "function", "fb", None, None, "def fb(limit)", None)]
    df = spark.createDataFrame(rows, "id long, file_id long, kind string, name string, qualified_name string, start_line int, signature string, docstring string")
    assert [r.symbol_id for r in pair_documentation(df).collect()] == [1]


def best_total(rows):
    """Greatest total weight over all links, by trying every use of the functions, comment after comment."""
    weights = []
    for c, (line, *_, text) in enumerate(rows):
        if text:
            tags = tag_names(text)
            weights.append([link_weight(text, tags, f[4], f[5], i == c, 0 if None in (f[0], line) else abs(f[0] - line)) for i, f in enumerate(rows)])
    best = {0: 0.0}
    for ws in weights:
        new = dict(best)
        for used, total in best.items():
            for f, w in enumerate(ws):
                if w > 0 and not used >> f & 1:
                    new[used | 1 << f] = max(new.get(used | 1 << f, 0.0), total + w)
        best = new
    return max(best.values())


def test_groups_are_matched_by_best_total(monkeypatch):
    monkeypatch.setattr(docpairs, "informative", lambda *_: True)
    r, moved = random.Random(3), 0
    for _ in range(900):
        span, names, tags = r.choice([1, 40, 300, 3 * REACH]), ["fa", "fb", "fc", "operator==", None], ["x", "limit", "$y", ""]
        rows, known = [], r.choice([0.0, 0.7, 1.0, 1.0])
        for i in range(r.randrange(2, 9)):
            text = f"Waits for {r.choice(names)}" + "".join(f"\n@param {t or '[]'} rows" for t in r.sample(tags, r.choice([0, 1, 1, 1, 2])))
            rows.append(row(r.randrange(span) if r.random() < known else None, r.choice(names), ", ".join(r.sample(tags, r.choice([0, 1, 2, 3]))), text if r.random() < 0.8 else None, f"k{i}"))
        rows.sort(key=lambda x: (x[0] is not None, x[0]))
        got = [x for g in groups(("file 1", *x) for x in rows) for x in pair_group([x[1:] for x in g])]
        assert len({x[0] for x in got}) == len(got)
        assert abs(sum(x[3] for x in got) - best_total(rows)) < 1e-9
        moved += {x[0] for x in got} != {x[2] for x in rows if x[6]}
    assert moved > 10
