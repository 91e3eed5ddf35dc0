"""Searches in cells against plain counts, and what they may shuffle."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from mnemospark.operators import expansion as X
from mnemospark.operators.graph import betweenness
from mnemospark.operators.retrieval import keyword_channel, theme_channel, vector_channel


def _store(n: int) -> list[tuple[str, str | None, list[str] | None]]:
    rnd = random.Random(7)
    return [(f"m{i:03}", None if i % 17 == 0 else " ".join(rnd.choices("kiln glaze oven clay wheel shelf".split(), k=rnd.randint(0, 6))), None if i % 13 == 0 else rnd.choices(["Kiln-care", "clay_store", "wheel"], k=rnd.randint(0, 2))) for i in range(n)]


def test_word_searches_in_cells(spark):
    rows = _store(120)
    memories = spark.createDataFrame(rows, "id string, summary string, themes array<string>")
    asked = {1: "kiln glaze", 2: "oven clay wheel shelf kiln", 3: "nothing", 4: "kiln nothing"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    said = {m: ((s or "").split(), [w for t in themes or [] for w in t.lower().replace("-", " ").split()]) for m, s, themes in rows}
    mean, want = sum(len(s) + len(t) for s, t in said.values()) / len(said), []
    for q, text in asked.items():
        found = []
        for m, (s, t) in said.items():
            hits = [w for w in text.split() if w in s or w in t]
            if not hits or (len(text.split()) <= 3 and len(hits) < len(text.split())):
                continue
            score = 0.0
            for w in hits:
                df = sum(w in s2 or w in t2 for s2, t2 in said.values())
                wtf = 13.278 * s.count(w) + 5.731 * t.count(w)
                score += math.log((len(said) - df + 0.5) / (df + 0.5) + 1) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * (len(s) + len(t)) / mean))
            found.append((-round(score, 9), m))
        want += [(q, m) for _, m in sorted(found)[:7]]
    got = keyword_channel(queries, memories, k=7)
    assert {(r.query_id, r.memory_id) for r in got.collect()} == set(want)
    assert "EvalPython" not in got._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    overlap = [(r.query_id, r.memory_id, r.overlap) for r in theme_channel(queries, memories, k=1000).collect()]
    assert set(overlap) == {(q, m, n) for q, text in asked.items() for m, _, themes in rows if (n := len(set(text.split()) & {w for t in themes or [] for w in t.lower().replace("_", "-").split("-")}))}


def test_vectors_in_cells(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 5)).astype(np.float16).astype(np.float64)
    x[100:110] = x[0] * 2  # ties
    rows = [(f"v{i:03}", v.tolist()) for i, v in enumerate(x)] * 2
    vectors = spark.createDataFrame(rows, "id string, vector array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "query_id long, vector array<double>")
    live = spark.createDataFrame([(f"v{i:03}",) for i in range(300) if i % 3], "id string")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    distance = np.round(1 - unit[:4] @ unit.T, 9)
    want = {(q, f"v{i:03}") for q in range(4) for i in sorted((i for i in range(300) if i % 3), key=lambda i: (distance[q, i], i))[:6]}
    assert {(r.query_id, r.id) for r in vector_channel(queries, vectors, k=6, among=live).collect()} == want


def _vector(*first: float) -> list[float]:
    return [*map(float, first), *[0.0] * (384 - len(first))]


def test_links_by_novelty(spark):
    vectors = spark.createDataFrame([("hit", _vector(0, 2)), ("seed", _vector(1, 0)), ("new", _vector(1, 1)), ("same", _vector(2, 0)), ("pooled", _vector(0, 1)), ("dead", _vector(0, 1)), ("new", _vector(1, 1))], "memory_id string, embedding array<float>")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "query_id long, memory_id string")
    adj = spark.createDataFrame([("seed", n, 1.0) for n in ("new", "same", "pooled", "dead", "none", "seed", "new")], "node string, neighbour string, weight double")
    live = spark.createDataFrame([(m,) for m in ("hit", "seed", "new", "same", "pooled", "none")], "memory_id string")
    found = X.by_links(pairs((1, "hit")), pairs((1, "seed"), (2, "seed")), adj, vectors, pairs((1, "seed"), (1, "pooled")), live)
    assert {(r.query_id, r.memory_id): r.novelty for r in found.collect()} == {(1, "new"): pytest.approx(1.0), (1, "same"): 0.0}


def test_moved_vectors(spark):
    vectors = spark.createDataFrame([("a", _vector(2, 0)), ("b", _vector(0, 2)), ("b", _vector(0, 2))], "memory_id string, embedding array<float>")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "query_id long, memory_id string")
    got = {r.query_id: r.vector[:2] for r in X.moved_vectors(pairs((1, "a"), (2, "a"), (2, "b"), (3, "gone")), pairs((1, "b"), (3, "b")), vectors).collect()}
    assert got == {1: pytest.approx([0.7 / 0.58**0.5, 0.3 / 0.58**0.5]), 2: pytest.approx([0.5**0.5] * 2)}


def test_betweenness_in_shares(spark):
    """A ring with a chord and a tail, from all nodes, a few at a time; nothing by (source, node) may be shuffled."""
    links = [(i, (i + 1) % 8) for i in range(8)] + [(0, 4), (4, 8), (8, 9)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "source_id string, target_id string")
    sources = spark.createDataFrame([(f"n{i}",) for i in range(10)], "memory_id string")
    beside, want = {i: {b for p in links for a, b in (p, p[::-1]) if a == i} for i in range(10)}, dict.fromkeys(range(10), 0.0)

    def paths(a: int) -> tuple[dict[int, int], dict[int, int]]:
        far, count, level = {a: 0}, {a: 1}, [a]
        while level:
            met: dict[int, int] = {}
            for x in level:
                for y in beside[x] - far.keys():
                    met[y] = met.get(y, 0) + count[x]
            far |= dict.fromkeys(met, far[level[0]] + 1)
            count |= met
            level = list(met)
        return far, count

    all_paths = {i: paths(i) for i in range(10)}
    for s, (far, count) in all_paths.items():
        for t in far:
            for v in set(far) - {s, t}:
                if far[v] + all_paths[v][0][t] == far[t] and s != t:
                    want[v] += count[v] * all_paths[v][1][t] / count[t]
    for at_once in (10, 30, 1000):
        found = betweenness(edges, sources, shares=3, at_once=at_once)
        assert {r.memory_id: r.betweenness for r in found.collect()} == {f"n{i}": pytest.approx(v) for i, v in want.items() if v}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_expansions_share_one_pool(spark, monkeypatch):
    from mnemospark.operators import retrieval as R
    from mnemospark.plans import feature_queries as Y

    searches = []
    for name in ("keyword_channel", "theme_channel"):
        monkeypatch.setattr(R, name, lambda *args, f=getattr(R, name), n=name, **more: (searches.append(n), f(*args, **more))[1])
    plan = Y.expand_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(searches) == ["keyword_channel", "theme_channel"] and "MapInArrow" in plan


def test_theme_bridge_in_cells(spark):
    memories = spark.createDataFrame([("a", ["kiln care", "clay"]), ("b", ["kiln_care"]), ("c", ["clay", "kiln-care"]), ("d", ["wheel"]), ("e", ["clay"])], "id string, themes array<string>")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "query_id long, memory_id string")
    queries = spark.createDataFrame([(1, "wheel"), (2, "clay")], "query_id long, query string")
    found = X.by_theme_bridge(pairs((1, "a"), (2, "a"), (2, "d")), queries, memories, pairs((1, "a"), (1, "b"), (2, "a")), k=3)
    assert {(r.query_id, r.memory_id): (r.shared, r["rank"]) for r in found.collect()} == {(1, "c"): (2, 0), (1, "e"): (1, 1), (2, "b"): (1, 0), (2, "c"): (1, 1), (2, "d"): (1, 2)}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_related_and_rocchio_search_once(spark, monkeypatch):
    """The vectors asked for come by their ids' hash, before any shuffle; one search serves hits and pool."""
    from mnemospark.operators import recall as C
    from mnemospark.operators import retrieval as R
    from mnemospark.plans import feature_queries as Y
    from mnemospark.plans import recall_queries as Z

    own, searches = [], []
    monkeypatch.setattr(C, "related", lambda *args, f=C.related, **more: (own.append(more["own"]), f(*args, **more))[1])
    Z.related_memories(spark, "/root/testdata/sf0.001")
    assert all(r.h < "05" for r in own[0].selectExpr("substring(md5(cast(memory_id as binary)), 1, 2) as h").collect())
    monkeypatch.setattr(R, "keyword_channel", lambda *args, f=R.keyword_channel, **more: (searches.append(1), f(*args, **more))[1])
    Y.expand_by_rocchio(spark, "/root/testdata/sf0.001")
    assert len(searches) == 1


def test_related_by_a_usable_copy(spark):
    """Of a memory's copies a usable one is asked with, whichever comes first."""
    from mnemospark.operators.recall import related

    spoilt = [("a", _vector()), ("a", [None, *_vector(1)[1:]]), ("a", _vector(1)[:5]), ("a", None)]
    rows = [*spoilt, ("a", _vector(1, 0)), ("b", _vector(1, 1)), ("c", _vector(0, 1)), ("gone", _vector(1, 0)), ("zero", _vector()), ("c", _vector(0, 1))]
    memories = spark.createDataFrame([(m, None, None) for m in ("a", "b", "c", "zero")], "id string, summary string, themes array<string>")
    asked = spark.createDataFrame([("a", "no such words"), ("zero", None)], "memory_id string, content string")
    for order in (rows, rows[::-1], [rows[4], *rows[:4], *rows[5:]]):
        vectors = spark.createDataFrame(order, "memory_id string, embedding array<float>").coalesce(1)
        found = related(asked, memories, vectors)
        assert [(r.memory_id, r.related_id, r["rank"]) for r in found.orderBy("memory_id", "rank").collect()] == [("a", "b", 0), ("a", "c", 1)]


def test_moved_vectors_sends_what_is_asked_for(spark, monkeypatch):
    """Of many vectors hardly any but those of hits and seeds are packed and shuffled, and all of these are."""
    from mnemospark.operators import search

    sent = []
    monkeypatch.setattr(search, "with_packed", lambda *args, f=search.with_packed, **more: (sent.append(f(*args, **more)), sent[-1])[1])
    vectors = spark.range(3000).selectExpr("concat('m', id) as memory_id", "transform(sequence(0, 383), i -> cast(if(i = id % 384, 2, 0) as float)) as embedding")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "query_id long, memory_id string")
    got = X.moved_vectors(pairs((1, "m0"), (2, "m5"), (2, None)), pairs((1, "m1"), (3, "m7"), (1, "none")), vectors).collect()
    assert {r.query_id: (r.vector[0], r.vector[1], r.vector[5]) for r in got} == {1: pytest.approx((0.7 / 0.58**0.5, 0.3 / 0.58**0.5, 0)), 2: pytest.approx((0, 0, 1))}
    ids = {r.memory_id for r in sent[0].collect()}
    assert {"m0", "m1", "m5", "m7"} <= ids and len(ids) < 20
    every = spark.range(40_000).selectExpr("concat('m', id) as memory_id")
    marks = search.marked(every.where("memory_id like '%3'"))
    at = np.array([r.at for r in every.select(search._place("memory_id").alias("at")).collect()])
    there = (marks[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
    assert there[3::10].all() and there.sum() < 4200
