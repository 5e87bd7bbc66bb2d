"""Components and paths of graphs, against plain versions."""

import itertools
import random
from collections import deque

import pytest

from sparkloom.catalog import Catalog
from sparkloom.operators import model_graph
from sparkloom.operators.components import components
from sparkloom.operators.model_graph import paths_from, with_bridges


def plain_components(edges):
    """{(model, node): least name of its component} of all that reach themselves, by searching from each."""
    out = {}
    for model in {m for m, _, _ in edges}:
        onward = {}
        for m, a, b in edges:
            if m == model:
                onward.setdefault(a, set()).add(b)
        reach = {}
        for start in onward:
            seen, todo = set(), [start]
            while todo:
                for b in onward.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach[start] = seen
        for v in onward:
            if v in reach[v]:
                out[model, v] = min(w for w in reach[v] if w in reach and v in reach[w])
    return out


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = []
    for model in range(60):
        n = rng.randint(1, 14)
        names = [f"v{i}" for i in range(n)]
        rng.shuffle(names)
        edges += [(f"m{model}", rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 2 * n))]
        if model % 3 == 0:
            edges += [(f"m{model}", a, b) for a, b in itertools.pairwise([*names, names[0]])]
    got = {(r.model, r.v): r.component for r in components(spark.createDataFrame(edges, "model string, a string, b string")).collect()}
    assert got == plain_components(edges)
    assert components(spark.createDataFrame([], "model string, a string, b string")).collect() == []


def test_long_rings_and_chains(spark):
    """Rounds grow with the digits of the length, not with the length."""
    n = 100_000
    ids = spark.range(n)
    ring = ids.selectExpr("'m' AS model", f"concat('r', lpad(id, 6, '0')) AS a", f"concat('r', lpad((id + 1) % {n}, 6, '0')) AS b")
    chain = ids.selectExpr("'m' AS model", "concat('c', id) AS a", "concat('c', id + 1) AS b")
    # a chain of 5000 between two objects that call each other
    held = spark.range(5000).selectExpr("'n' AS model", "concat('h', id) AS a", "concat('h', (id + 1) % 5001) AS b").union(spark.createDataFrame([("n", "h5000", "h0"), ("n", "h0", "x"), ("n", "x", "h0"), ("n", "x", "y")], "model string, a string, b string"))
    got = components(ring.union(chain).union(held)).groupBy("model", "component").count().collect()
    assert sorted(map(tuple, got)) == [("m", "r000000", n), ("n", "h0", 5002)]


@pytest.mark.parametrize("most", [None, 2])
def test_shortest_paths_from_many_starts(spark, most):
    rng = random.Random(8)
    edges = set()
    for model in range(20):
        n = rng.randint(2, 9)
        for _ in range(rng.randint(1, 2 * n)):
            a, b = rng.sample(range(n), 2)
            edges |= {(f"m{model}", f"t{a}", f"t{b}"), (f"m{model}", f"t{b}", f"t{a}")}
    starts = sorted({(m, a) for m, a, _ in edges if a in ("t0", "t1", "t2")})
    got = {(r.model, r.start, r.table): (r.depth, r.before) for r in paths_from(spark.createDataFrame(starts, "model string, start string"), spark.createDataFrame(sorted(edges), "model string, a string, b string"), most).collect()}
    want = {}
    for model, start in starts:
        best, todo = {start: (start,)}, deque([start])
        while todo:  # by length, then by names
            level = sorted(best[x] for x in todo)
            todo = deque()
            for path in level:
                for m, a, b in sorted(edges):
                    if m == model and a == path[-1] and b not in best and (most is None or len(path) <= most):
                        best[b] = (*path, b)
                        todo.append(b)
        want |= {(model, start, t): (len(p) - 1, p[-2] if len(p) > 1 else None) for t, p in best.items()}
    assert got == want


def plain_bridges(starts, edges, hops):
    """The starts of one model, and what lies on the shortest paths between them that sort first, read from the lesser end."""
    out = set(starts)
    for start in starts - {None}:
        best, level = {start: (start,)}, [(start,)]
        while level:
            after = []
            for path in sorted(level):
                for b in sorted(b for a, b in edges if a == path[-1] and b not in best):
                    best[b] = (*path, b)
                    after.append(best[b])
            level = after
        for end in starts - {None}:
            if start < end and end in best and (hops is None or len(best[end]) <= hops + 2):
                out |= set(best[end])
    return out


@pytest.mark.parametrize("hops", [None, 1])
def test_bridges_are_looked_for_once_in_models_with_equal_graphs(spark, monkeypatch, hops):
    rng = random.Random(12)
    graphs = []
    for _ in range(12):
        n = rng.randint(3, 9)
        edges = {tuple(f"t{x}" for x in rng.sample(range(n), 2)) for _ in range(rng.randint(1, 2 * n))}
        graphs.append((frozenset(rng.sample([f"t{x}" for x in range(n)], 3)), frozenset(edges)))
    graphs += [(graphs[0][0] | {None}, graphs[0][1]), (graphs[0][0], frozenset()), (frozenset(), graphs[1][1]), (frozenset({None}), graphs[1][1])]
    graphs += [(frozenset({"a", "c"}), frozenset({("a", "b"), ("b", "c")})), (frozenset({"a", "b", "c"}), frozenset({("a", "b"), ("b", "c")})), (frozenset({"a", "c"}), frozenset({("a", "bc"), ("bc", "c")})), (frozenset({"a", "", "c"}), frozenset({("a", ""), ("", "c")}))]
    models = {f"m{i}": graphs[i % len(graphs)] for i in range(5 * len(graphs))} | {None: graphs[0]}
    tables, rels = [], []
    for model, (starts, edges) in models.items():
        tables += [(model, t) for t in starts] * rng.randint(1, 2)
        for a, b in sorted(edges):
            rels += [(model, *rng.choice([(a, b), (b, a)]))] * rng.randint(1, 2)  # either way round, some twice
        rels += [(model, "t0", "t0"), (model, None, "t1"), (model, "t1", None)][: rng.randint(0, 3)]
    rng.shuffle(rels)
    c = Catalog.empty(spark, relationships=spark.createDataFrame(rels, "model string, from_table string, to_table string"))
    searched = []
    monkeypatch.setattr(model_graph, "paths_from", lambda starts, *rest: searched.append(starts.select("model").distinct().count()) or paths_from(starts, *rest))
    got = [(r.model, r.table) for r in with_bridges(c, spark.createDataFrame(tables, "model string, table string"), hops).collect()]
    both = {g: g[1] | {(b, a) for a, b in g[1]} for g in graphs}
    want = {(m, t) for m, g in models.items() for t in (plain_bridges(g[0], both[g], hops) if m else g[0])}
    assert len(got) == len(set(got)) and set(got) == want
    assert searched == [len({(s, both[s, e]) for s, e in graphs if s})]
