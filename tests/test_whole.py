"""Queries against a plain count over all rows of small tables, not over a part of them."""

from __future__ import annotations

import os

import numpy as np
import pytest

from mnemospark.operators.graph import first_vectors
from mnemospark.plans import parts as P
from mnemospark.plans import registry
from mnemospark.sources.tables import table

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def query(spark, name):
    return {r[0]: r for r in registry.queries()[name](spark, FOLDER).collect()}


@pytest.fixture(scope="module")
def store(spark):
    """Memories with a usable vector, in order of their ids, and all cosines."""
    rows = P.memories(spark, FOLDER).select("id", "status", "category", "base_priority", "created_at").join(first_vectors(table(spark, FOLDER, "memory_vec")).withColumnRenamed("memory_id", "id"), "id").orderBy("id").toPandas()
    x = np.array(rows.embedding.tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return rows.drop(columns="embedding"), x @ x.T


def test_near_duplicates(spark, store):
    rows, cos = store
    p, want = rows.base_priority.fillna(0), {}
    live = np.flatnonzero(rows.status == "active")
    for i in live:
        above = [j for j in live if rows.category[j] == rows.category[i] and (-p[j], j) < (-p[i], i) and round(1 - cos[i, j], 6) <= 0.15]
        if above:
            j = min(above, key=lambda j: (round(1 - cos[i, j], 6), j))
            want[rows.id[i]] = (rows.id[j], pytest.approx(1 - cos[i, j], abs=1e-5))
    got = query(spark, "near_duplicates")
    assert {k: (r.winner, r.distance) for k, r in got.items()} == want


def test_arrivals(spark, store):
    rows, cos = store
    p, want = rows.base_priority, {i: ("inserted", None, None) for i in (r.id for r in P.active(spark, FOLDER).select("id").collect())}
    live = np.flatnonzero(rows.status == "active")
    for i in live:
        older = [j for j in live if rows.category[j] == rows.category[i] and rows.created_at[j] < rows.created_at[i]]
        if older:
            d, j = min((round(1 - cos[i, j], 9), j) for j in older)
            outcome = "inserted" if d >= 0.1 else "superseded" if p[i] > p[j] else "dedup_rejected"
            want[rows.id[i]] = (outcome, rows.id[j], pytest.approx(d, abs=1e-5))
    got = query(spark, "arrivals")
    assert {k: (r.outcome, r.other, r.distance) for k, r in got.items()} == want
    assert {r.outcome for r in got.values()} == {"inserted", "superseded", "dedup_rejected"}


def test_link_shadows(spark, store):
    rows, cos = store
    born, want = rows.created_at.to_numpy(), {}
    for i in range(len(rows)):
        newer = born > born[i]
        best = cos[i][newer].max() if newer.any() else 0.0
        want[rows.id[i]] = pytest.approx(min(1.0, max(0.0, (best - 0.7) / 0.25)), abs=2e-5)
    assert {k: r.shadow for k, r in query(spark, "link_shadows").items()} == want


def test_stream_sessions(spark):
    events = P.events(spark, FOLDER).where("session_id is not null and created_at is not null").select("session_id", "created_at").toPandas().sort_values(["session_id", "created_at"])
    new = (events.session_id != events.session_id.shift()) | (events.created_at.diff().dt.total_seconds() >= 1800)
    sizes = events.groupby(["session_id", new.cumsum()]).size().groupby("session_id").agg(["count", "max"])
    assert {k: (r.bursts, r.longest) for k, r in query(spark, "stream_sessions").items()} == {k: (r["count"], r["max"]) for k, r in sizes.iterrows()}
