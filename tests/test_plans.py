"""Schemas, cliques, orders and trees."""

import random

import pytest

from cubiform.plans import cliques as C
from cubiform.plans.schema import Schema

D = Schema(tuple("abcd"), (10, 20, 30, 40))
D4 = Schema(tuple("abcd"), (2, 3, 4, 5))
SETS = {"tree": ["ab", "bc", "cd"], "cyclic": ["a", "ab", "bc", "ac", "bd"], "missing": ["ab", "da"], "full": ["abcd"], "single": ["d"], "permuted": ["abc", "cba", "bd"]}
CASES = {k: [tuple(c) for c in v] for k, v in SETS.items()}


def test_schema_algebra():
    assert D != Schema(tuple("bacd"), (20, 10, 30, 40))
    assert D.project(["b", "a"]) == Schema(("b", "a"), (20, 10))
    assert D.project("a").attrs == ("a",)
    assert D.marginalize(["c", "d", "e"]).attrs == ("a", "b")
    assert D.invert(["c", "x"]) == ["a", "b", "d"]
    assert D.canonical(["d", "a"]) == ("a", "d")
    assert D.axes(["c", "a"]) == (2, 0)
    assert D.size() == 240_000 and D.size(()) == 1 and D.size(["a", "b"]) == 200
    assert D.strides(["c", "a"]) == (10, 1)
    assert D.merge(Schema(("d", "e"), (40, 50))).attrs == tuple("abcde")
    assert D.intersect(Schema(("z", "b"), (1, 20))).attrs == ("b",)
    assert D.intersect(Schema(("z",), (1,))).attrs == ()
    assert D.contains(Schema(("a",), (10,))) and "a" in D and D["b"] == 20 and len(D) == 4
    assert Schema.from_json(D.to_json()) == D and Schema.from_struct(D.to_struct()) == D


@pytest.mark.parametrize("make", [lambda: Schema(("a", "a"), (1, 2)), lambda: Schema(("a",), (1, 2)), lambda: D.project(["x"]), lambda: D.merge(Schema(("a",), (11,)))])
def test_schema_errors(make):
    with pytest.raises(ValueError):
        make()


def test_maximal_and_mapping():
    assert C.maximal_subset([("a",), ("a", "b"), ("b", "a"), ("c",)]) == [("a", "b"), ("c",)]
    assert C.clique_mapping([("a", "b"), ("b", "c")], [("b",), ("c",), ("d",)]) == {("b",): ("a", "b"), ("c",): ("b", "c")}
    assert C.reverse_clique_mapping([("a", "b"), ("b", "c")], [("b",), ("c",)]) == {("a", "b"): [("b",)], ("b", "c"): [("c",)]}
    assert C.downward_closure([("a", "b")]) == [("a",), ("b",), ("a", "b")]
    assert C.k_way(D, 2, 300) == [("a", "b"), ("a", "c")]


EXPECTED = {
    "tree": ([("a", "b"), ("b", "c"), ("c", "d")], list("abcd"), 43, 38),
    "cyclic": ([("a", "b", "c"), ("b", "d")], list("dabc"), 55, 39),
    "missing": ([("a", "b"), ("a", "d"), ("c",)], list("cbad"), 22, 20),
    "full": ([("a", "b", "c", "d")], list("abcd"), 205, 120),
    "single": ([("a",), ("b",), ("c",), ("d",)], list("abcd"), 8, 14),
    "permuted": ([("a", "b", "c"), ("b", "d")], list("dabc"), 55, 39),
}


@pytest.mark.parametrize("case", CASES)
def test_junction_trees(case):
    nodes, order, cost, cells = EXPECTED[case]
    found, total = C.greedy_order(D4, CASES[case])
    tree = C.junction_tree(D4, CASES[case])
    assert (found, total) == (order, cost)
    assert tree.cliques == nodes and tree.cells(D4) == cells
    assert len(tree.messages) == 2 * (len(nodes) - 1)
    done = set()
    for a, b in tree.messages:
        assert all((n, a) in done for n in tree.around[a] if n != b)
        done.add((a, b))
    for a in D4:  # running intersection
        held = [k for k, c in enumerate(tree.cliques) if a in c]
        reach, stack = {held[0]}, [held[0]]
        while stack:
            for n in tree.around[stack.pop()]:
                if n in held and n not in reach:
                    reach.add(n)
                    stack.append(n)
        assert reach == set(held)


def test_random_orders_never_lose():
    base = C.greedy_order(D4, CASES["cyclic"])[1]
    tree = C.junction_tree(D4, CASES["cyclic"], order=5)
    assert tree.cells(D4) <= base
    order, _ = C.greedy_order(D4, CASES["cyclic"], random.Random(1))
    assert sorted(order) == list("abcd")
    assert C.model_size_mb(D4, CASES["full"]) == 120 * 8 / 2**20


def test_region_graph():
    g = C.region_graph(D4, [("a", "b"), ("b", "c"), ("c", "d")])
    assert set(g.regions) == {("a", "b"), ("b", "c"), ("c", "d"), ("b",), ("c",)}
    assert set(g.parents["b",]) == {("a", "b"), ("b", "c")}
