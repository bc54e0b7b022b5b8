import random

import pytest

from tidemark.operators import hierarchy


def brute(edges):
    """root, depth and number of descendants, by walking."""
    parent = {i: (p if p in dict(edges) else None) for i, p in edges}
    out = {}
    for i in parent:
        path, at = [], i
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        loop = at is not None
        below, todo = set(), [i]
        while todo:
            x = todo.pop()
            for c in (c for c, p in parent.items() if p == x):
                if c not in below:
                    below.add(c)
                    todo.append(c)
        out[i] = ("", -1, len(below - {i})) if loop else (path[-1], len(path) - 1, len(below - {i}))
    return out


def run(spark, edges):
    nodes = spark.createDataFrame(edges, "id string, parent string")
    levels = hierarchy.hierarchy(nodes)
    return nodes, levels, {r.id: (r.root, r.depth, r.n_descendants) for r in levels.collect()}


CASES = {
    "chain": [("n0", None), *((f"n{i}", f"n{i - 1}") for i in range(1, 21))],
    "star": [("r", None), *((f"c{i}", "r") for i in range(50))],
    "loops": [("s", "s"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("t", "s"), ("x", "y"), ("y", "x"), ("m", "gone"), ("k", "m")],
    "only loop": [("a", "b"), ("b", "a")],
    "single": [("a", None)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_walking(spark, name):
    assert run(spark, CASES[name])[2] == brute(CASES[name])


@pytest.mark.parametrize("name", ["loops", "star", "random"])
def test_many_tasks_give_what_one_gives(spark, monkeypatch, name):
    rnd = random.Random(7)
    edges = CASES.get(name) or [(f"n{i:02}", rnd.choice([None, *(f"n{rnd.randrange(50):02}" for _ in range(5))])) for i in range(50)]
    one = sorted(map(tuple, run(spark, edges)[1].collect()))
    monkeypatch.setattr(hierarchy, "ONE_TASK", 0)
    levels, got = run(spark, edges)[1:]
    assert got == brute(edges)
    assert sorted(map(tuple, levels.select("id", "parent", "root", "depth", "n_descendants", "size", "pos").collect())) == one


def test_random_graphs(spark):
    rnd = random.Random(3)
    edges = [(f"n{i}", rnd.choice([None, *(f"n{rnd.randrange(60)}" for _ in range(5))])) for i in range(60)]
    nodes, levels, got = run(spark, edges)
    assert got == brute(edges)
    # Ranges: positions are distinct, and a descendant lies in its ancestor's range.
    pos = {r.id: (r.pos, r.size) for r in levels.where("depth >= 0").collect()}
    assert len({p for p, _ in pos.values()}) == len(pos)
    pairs = {(r.ancestor, r.id) for r in hierarchy.descendants(levels, levels.select("id"), width=8).collect()}
    parent = dict(edges)
    expected = set()
    for i in pos:
        at = parent[i] if parent[i] in parent else None
        while at is not None:
            expected.add((at, i))
            at = parent[at] if parent[at] in parent else None
    assert pairs == expected
    paths = {r.id: r.path for r in hierarchy.paths(nodes, levels).collect()}
    assert all((len(p) == got[i][1] + 1 and p[0] == got[i][0] and p[-1] == i) if got[i][1] >= 0 else p == [] for i, p in paths.items())


def test_empty_and_null_ids(spark):
    assert run(spark, [])[2] == {}
    assert run(spark, [(None, "a"), ("a", None)])[2] == {"a": ("a", 0, 0)}


@pytest.mark.parametrize("name", ["loops", "only loop", "chain"])
def test_descendants_of_every_node(spark, name):
    edges = CASES[name]
    kids = {}
    for i, p in edges:
        kids.setdefault(p, []).append(i)
    want = []
    for i, _ in edges:
        below, todo = set(), [i]
        while todo:
            new = [c for c in kids.get(todo.pop(), []) if c not in below]
            below.update(new)
            todo += new
        want += [(i, x) for x in below - {i}]
    levels = run(spark, edges)[1]
    assert sorted((r.ancestor, r.id) for r in hierarchy.all_descendants(levels, width=8).collect()) == sorted(want)
