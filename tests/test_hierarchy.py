from __future__ import annotations

import random

import pytest

from mnemospark.operators.hierarchy import descendants, parent_links, resolve_hierarchy


def brute(parent: dict[str, str]) -> dict[str, tuple[str, int]]:
    out = {}
    for node in parent:
        seen, at = [node], parent[node]
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        out[node] = (min(seen[seen.index(at):]), -1) if at in seen else (at, len(seen))
    return out


def resolved(spark, parent: dict[str, str], with_paths: bool = False):
    rows = [(k, v) for k, v in parent.items()]
    return resolve_hierarchy(spark.createDataFrame(rows, "node string, parent string"), with_paths)


def test_random_forests_and_circles(spark):
    rng = random.Random(5)
    nodes = [f"n{i:03}" for i in range(120)]
    parent = {n: rng.choice(nodes) for n in nodes[:80]} | {f"c{i:03}": f"c{i + 1:03}" for i in range(40)} | {"x": "y", "y": "z", "z": "x", "s": "s"}
    got = {r.node: (r.root, r.depth) for r in resolved(spark, parent).collect()}
    assert got == brute(parent)


def test_paths_and_descendants(spark):
    found = resolved(spark, {"a": "b", "b": "c", "d": "c", "p": "q", "q": "p", "t": "p"}, True)
    rows = {r.node: r for r in found.collect()}
    assert rows["a"].path == ["b", "c"] and rows["a"].depth == 2
    assert rows["p"].on_cycle and not rows["t"].on_cycle and rows["t"].path is None and rows["t"].root == "p"
    assert {(r.ancestor, r.node, r.distance) for r in descendants(found).collect()} == {("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("c", "d", 1)}


@pytest.mark.parametrize("rows", [[], [(None, None, 1)], [("a", "", 1), ("b", "gone", 1), ("c", None, 1), ("c", None, 1)]])
def test_nothing_to_resolve(spark, rows):
    nodes = spark.createDataFrame(rows, "id string, superseded_by string, node int")  # a column that clashes with an inner name
    assert resolve_hierarchy(parent_links(nodes), False).count() == 0


def test_copies_count_once(spark):
    nodes = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", None), ("b", None)], "id string, superseded_by string")
    assert [tuple(r) for r in resolve_hierarchy(parent_links(nodes), False).collect()] == [("a", "b", 1)]
