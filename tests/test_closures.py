"""Closures of edge tables against plain Python."""

import random

import pytest

from quillspark.plans import closures, dag


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def walk(roots, edges):
    depth, level = dict.fromkeys(roots, 0), list(roots)
    while level:
        level = [b for a in level for p, b in edges if p == a and b not in depth and depth.setdefault(b, depth[a] + 1)]
    return depth


def peel(nodes, edges):
    """Longest ways by repeated relaxation; what never settles is cyclic or below a cycle."""
    edges = {(a, b) for a, b in edges if a in nodes and b in nodes}
    done, left = {}, set(nodes)
    while ready := {n for n in left if all(a in done for a, b in edges if b == n)}:
        done |= {n: max([done[a] + 1 for a, b in edges if b == n], default=0) for n in ready}
        left -= ready
    return done


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, tables = 10_000, []
    table = closures.table
    monkeypatch.setattr(closures, "table", lambda df, name: tables.append(name) or table(df, name))
    edges = spark.range(n).selectExpr("cast(id AS string) AS parent", "cast(id + 1 AS string) AS child")
    got = {r.node: r.depth for r in closures.descendants(frame(spark, [("0",)], ["node"]), edges).collect()}
    assert got == {str(i): i for i in range(n + 1)}
    assert len(tables) < 22
    found = closures.layers(edges.selectExpr("child AS node").union(frame(spark, [("0",)], ["node"])), edges)
    assert {r.node: r.layer for r in found.collect()} == got


@pytest.mark.parametrize("seed", range(3))
def test_graphs_of_several_parents(spark, seed):
    rng = random.Random(seed)
    names = [str(i) for i in range(40)]
    edges = [(str(a), str(b)) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(30 + 15 * seed))]
    edges += [(names[i], names[i + 1]) for i in range(20, 30)]
    if seed:  # a cycle, and one of a single node
        edges += [("12", "11"), ("11", "12"), ("33", "33")]
    roots = rng.sample(names, 3)
    rows = frame(spark, [*edges, *edges[:5], (None, "1"), ("2", None)], ["parent", "child"])
    got = closures.descendants(frame(spark, [(r,) for r in roots] + [(None,)], ["node"]), rows)
    assert sorted(map(tuple, got.collect())) == sorted(walk(roots, edges).items())
    nodes = names[:38]
    got = closures.layers(frame(spark, [(x,) for x in nodes + nodes[:2]], ["node"]), rows)
    assert sorted(map(tuple, got.collect())) == sorted(peel(nodes, edges).items())
    if not seed:
        order = dag.layers(nodes, edges)
        assert {n: k for k, layer in enumerate(order) for n in layer} == peel(nodes, edges)


def test_empty_tables(spark):
    none = frame(spark, [], ["parent", "child"])
    assert closures.descendants(frame(spark, [], ["node"]), none).collect() == []
    assert [tuple(r) for r in closures.descendants(frame(spark, [("a",)], ["node"]), none).collect()] == [("a", 0)]
    assert [tuple(r) for r in closures.layers(frame(spark, [("a",)], ["node"]), none).collect()] == [("a", 0)]
