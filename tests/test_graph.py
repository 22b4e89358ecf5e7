"""PageRank, impact and closure against plain Python."""

import random
from collections import deque

import pytest

from wovengraph.operators import graph, lookup


def slow_rank(n, edges, d=0.85, eps=1e-6, most=100):
    edges = set(edges)
    out = {i: [b for a, b in edges if a == i] for i in range(n)}
    s = [1 / n] * n
    for _ in range(most):
        lost = sum(s[i] for i in range(n) if not out[i])
        new = [(1 - d) / n + d * lost / n] * n
        for i in range(n):
            for b in out[i]:
                if b != i:
                    new[b] += d * s[i] / len(out[i])
        change = sum(abs(a - b) for a, b in zip(s, new, strict=True))
        s = new
        if change < eps:
            break
    return s


SHAPES = {"chain": (3, [(0, 1), (1, 2)]), "star, loop and repeats": (5, [(0, 1), (0, 2), (0, 2), (3, 3), (3, 0)]), "band": (20, [(i, j) for i in range(20) for j in range(i + 1, min(i + 4, 20))])}


@pytest.mark.parametrize("shape", SHAPES)
def test_pagerank(spark, shape):
    n, edges = SHAPES[shape]
    got = graph.pagerank(spark.createDataFrame([(str(i),) for i in range(n)], "id string"), spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string"))
    found = {int(r.id): r.pagerank for r in got.collect()}
    assert found == pytest.approx(dict(enumerate(slow_rank(n, edges))), abs=1e-9)


def test_pagerank_of_nothing_and_of_dangling_edges(spark):
    none = spark.createDataFrame([], "id string")
    assert graph.pagerank(none, spark.createDataFrame([], "src string, dst string")).count() == 0
    got = graph.pagerank(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b"), ("a", "gone")], "src string, dst string"))
    assert sum(r.pagerank for r in got.collect()) == pytest.approx(1)


def slow_impact(edges, known, target, cap):
    depth, todo = {target: 0}, deque([target])
    while todo:
        x = todo.popleft()
        if cap is not None and depth[x] >= cap:
            continue
        for a, b in edges:
            if b == x and a not in depth and a in known:
                depth[a] = depth[x] + 1
                todo.append(a)
    return {k: v for k, v in depth.items() if k != target}


@pytest.mark.parametrize("cap", [None, 0, 2])
def test_impact(spark, cap):
    rng = random.Random(1)
    edges = [(f"s{rng.randrange(30)}", f"s{rng.randrange(30)}") for _ in range(45)] + [("s1", "s1"), ("ghost", "s3"), ("s9", "ghost")]
    known = {f"s{i}" for i in range(30)}
    calls = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, call_site_line bigint")
    symbols = spark.createDataFrame([(i, i, "Function", 1) for i in sorted(known)], "id string, name string, kind string, start_line bigint")
    got = {r.id: r.depth for r in graph.impact(calls, symbols, "s3", cap).collect()}
    assert got == slow_impact(edges, known, "s3", cap)


def test_impact_report_and_dead_code(spark):
    names = "abcd"
    symbols = spark.createDataFrame([(f"f.rs::{n}", n, "Function", 1) for n in names] + [("f.rs::main", "main", "Function", 1), ("f.rs::S", "S", "Struct", 1)], "id string, name string, kind string, start_line bigint")
    calls = spark.createDataFrame([(f"f.rs::{a}", f"f.rs::{b}", 1) for a, b in ("ab", "bc", "da")], "src string, dst string, call_site_line bigint")
    scores = spark.createDataFrame([("f.rs::a", 0.5), ("f.rs::b", 0.3), ("f.rs::c", 0.2)], "id string, pagerank double")
    rows = [(r.rank, r.name, r.depth, r.pagerank) for r in lookup.impact_report(calls, symbols, scores, "f.rs::c").orderBy("rank").collect()]
    assert rows == [(1, "a", 2, 0.5), (2, "b", 1, 0.3), (3, "d", 3, None)]
    assert [r.id for r in lookup.dead_code(symbols, calls, scores).collect()] == ["f.rs::d"]
    assert [(r.rank, r.name) for r in lookup.rank(symbols, scores, 2).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_resolving_one(spark):
    symbols = spark.createDataFrame([("a.rs::go", "go", "Function", 3), ("b.rs::go", "go", "Function", 4), ("a.rs::Gone", "Gone", "Struct", 5)], "id string, name string, kind string, start_line bigint")
    assert lookup.one_symbol(symbols, "a.rs::go")["start_line"] == 3
    assert lookup.one_symbol(symbols, "GON", True)["name"] == "Gone"
    with pytest.raises(lookup.Ambiguous) as e:
        lookup.one_symbol(symbols, "go")
    assert e.value.candidates == [{"name": "go", "file": "a.rs", "line": 3}, {"name": "go", "file": "b.rs", "line": 4}]
    with pytest.raises(lookup.NotFound) as e:
        lookup.one_symbol(symbols, "a.rs")
    assert e.value.suggestions == ["a.rs::Gone", "a.rs::go"]
    with pytest.raises(lookup.InvalidInput):
        lookup.context({"symbols": symbols})


def test_closure(spark):
    contains = spark.createDataFrame([("File", "f", "f::A"), ("Symbol", "f::A", "f::A::m"), ("Symbol", "f::A::m", "f::A::m::i"), ("File", "g", "g::B")], "src_kind string, src string, dst string")
    got = {(r.ancestor, r.descendant): r.depth for r in graph.containment_closure(contains).collect()}
    assert got == {("f", "f::A"): 1, ("f", "f::A::m"): 2, ("f", "f::A::m::i"): 3, ("f::A", "f::A::m"): 1, ("f::A", "f::A::m::i"): 2, ("f::A::m", "f::A::m::i"): 1, ("g", "g::B"): 1}
    symbols = spark.createDataFrame([(i, i[-1], "Class", 1) for i in ("f::A", "f::A::m", "f::A::m::i", "g::B")], "id string, name string, kind string, start_line bigint")
    assert sorted(r.id for r in graph.contained_symbols(contains, symbols, "f").collect()) == ["f::A", "f::A::m", "f::A::m::i"]
    assert graph.contained_symbols(contains, symbols, "none").count() == 0


def watched(monkeypatch):
    """The tables that the operators checkpoint, as they are made."""
    made, old = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: made.append(df) or old(df))
    return made


def test_pagerank_rounds_hold_numbers_and_blocks_of_targets(spark, monkeypatch):
    made = watched(monkeypatch)
    monkeypatch.setattr(graph, "_BLOCK", 3)
    n, edges = 12, [(0, b) for b in range(12)] + [(b, (b * 5 + 1) % 12) for b in range(1, 9)]
    got = graph.pagerank(spark.createDataFrame([(f"s{i}",) for i in range(n)], "id string"), spark.createDataFrame([(f"s{a}", f"s{b}") for a, b in edges], "src string, dst string"))
    assert {int(r.id[1:]): r.pagerank for r in got.collect()} == pytest.approx(dict(enumerate(slow_rank(n, edges))), abs=1e-9)
    assert all(kind != "string" for frame in made[1:] for _, kind in frame.dtypes)
    blocks = next(frame for frame in made if "to" in frame.columns).collect()
    assert len([r for r in blocks if r.degree == 12]) > 1 and sum(len(r.to) for r in blocks) == len({(a, b) for a, b in edges if a != b})


def test_impact_leaves_the_edges_where_they_are(spark, monkeypatch):
    made = watched(monkeypatch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.impact(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "c").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in made[2]._jdf.queryExecution().executedPlan().toString()
