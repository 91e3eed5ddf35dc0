"""Training-data operators against brute force, round trips and hand-made cases."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from mnemospark.llm import encoding as E
from mnemospark.llm import mixing, packing, pii
from mnemospark.llm.canonical import edit_distance, map_to_canonical, words_of
from mnemospark.llm.components import connected_components
from mnemospark.llm.cooccurrence import baskets_of, pair_association
from mnemospark.llm.neighbours import TreeParams, _placed, build, most_similar, visits
from mnemospark.llm.tokens import count_tokens, with_token_counts

DIM = 24


def clustered(n: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIM)) * 1.5
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, DIM))
    x[: n // 5] = x[n // 5 : 2 * (n // 5)] + rng.normal(size=(n // 5, DIM)) * 0.15
    return x.astype(np.float32)


def brute_neighbours(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(np.float64) @ u.T.astype(np.float64)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order if s[i, j] >= least}
    return out


@pytest.mark.parametrize(("least", "factor"), [(0.8, 1.0), (0.8, 0.6), (-1.0, 1.0)])
def test_neighbours(spark, least, factor):
    x = clustered(400)
    ids = [f"m{i:04}" for i in range(len(x))]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    dirty = [("null", None), ("zero", [0.0] * DIM), ("short", [1.0] * 3), (None, x[0].tolist()), (ids[5], x[5].tolist()), ("hole", [None] + [1.0] * (DIM - 1))]
    df = spark.createDataFrame(rows + dirty, "id string, vector array<float>")
    got = {(r.id, r.neighbour) for r in most_similar(df, k=5, min_cosine=least, dim=DIM, params=TreeParams(factor=factor, shard_rows=64, leaf_rows=16)).collect()}
    want = brute_neighbours(ids, x, 5, least)
    assert len(got & want) >= (1.0 if factor == 1 else 0.9) * len(want)
    assert factor != 1 or got == want


def test_many_equal_vectors(spark):
    v = [1.0] + [0.0] * (DIM - 1)
    w = [1.0, 0.1] + [0.0] * (DIM - 2)
    df = spark.createDataFrame([(f"c{i:02}", v) for i in range(30)] + [("d", w)], "id string, vector array<float>")
    got = {}
    for r in most_similar(df, k=3, dim=DIM).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert [n for _, n in sorted(got["c00"])] == ["c01", "c02", "c03"] and [n for _, n in sorted(got["d"])] == ["c00", "c01", "c02"]
    assert most_similar(df.where("false"), k=3, dim=DIM).count() == 0


def test_exact_tree_loses_nothing():
    x = clustered(500)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = math.acos(0.8)
    tree, leaves = build(x, reach * 0.05, 40, TreeParams())
    assert leaves > 1 and sorted(np.concatenate([n.rows[:] for n, _ in visits(tree, x[:1], 10.0)])) == list(range(500))
    seen = np.zeros((500, 500), dtype=bool)
    for node, rows in visits(tree, x, reach):
        seen[np.ix_(rows, node.rows)] = True
    assert seen[(x @ x.T) >= 0.8].all()


def test_cooccurrence(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]) for i in range(300)]
    rows += [(0, rows[0][1]), (300, None), (301, [None, "a", "a"]), (None, ["a", "b"]), (302, [f"x{i}" for i in range(600)])]
    from pyspark.sql import functions as F

    got = {(r.item_a, r.item_b): (r.n_ab, r.n_records) for r in pair_association(baskets_of(spark.createDataFrame(rows, "id long, items array<string>"), "id", F.col("items"))).collect()}
    sets = {i: {x for x in (b or []) if x} for i, b in rows if i is not None}
    want = Counter(p for b in sets.values() for p in itertools.combinations(sorted(b), 2))
    assert {k: v[0] for k, v in got.items()} == dict(want) and {v[1] for v in got.values()} == {len(sets)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 300):03}", f"n{rng.randint(0, 300):03}") for _ in range(180)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"z{i:03}") for i in range(80)]
    dirty = [(None, "a"), ("a", None), ("b", "b"), ("p001", "p000")]
    got = {r.member: r.component for r in connected_components(spark.createDataFrame(edges + dirty, "a string, b string"), "a", "b").collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    count = Counter(map(find, parent))
    assert got == {x: find(x) for x in parent if count[find(x)] > 1}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_canonical(spark):
    canon = spark.createDataFrame([("budget-history",), ("session-troubleshooting",), ("budget-history",), (None,)], "entry string")
    cases = {
        "Budget_History": "budget-history", "budgethistory": "budget-history", "history budget": "budget-history", "budegt-histry": "budget-history", "budget-histo": "budget-history",
        "ｓｅｓｓｉｏｎ-troubleshooting": "session-troubleshooting", "séssion & troubleshooting!": "session-troubleshooting", "sessionTroubleshootings": "session-troubleshooting",
        "budget-quiz": None, "budget": None, "session-history": None, "???": None, "": None, "kelp " * 2000: None,
    }
    df = spark.createDataFrame([(v,) for v in [*cases, None, "Budget_History"]], "value string")
    rows = map_to_canonical(df, canon).collect()
    assert {r.value: r.entry for r in rows} == cases and len(rows) == len(cases)
    assert {r.entry for r in map_to_canonical(df, canon.where("false")).collect()} == {None}


def test_edit_distance():
    assert edit_distance("privayc", "privacy") == 1 and edit_distance("", "ab") == 2 and edit_distance("abc", "abc") == 0
    assert words_of("fooBar-Bâz & qux") == ["foo", "bar", "baz", "qux"]


CASES = [
    ("email", "Mail from ana.b+x@mail.example.org, please.", ["ana.b+x@mail.example.org"]),
    ("email", "reply to felix dot dorgard at mail dot example dot org", ["felix dot dorgard at mail dot example dot org"]),
    ("email", "New contact <rosa {at} example.net> was added", ["rosa {at} example.net"]),
    ("email", "Pinned pkg@4.2.0 and recall@10 with @retry", []),
    ("phone", "Call back on +44 (0)20 7946 0625 about it.", ["+44 (0)20 7946 0625"]),
    ("phone", "Left a voicemail ((415) 555-0175), no answer.", ["(415) 555-0175"]),
    ("phone", "Left a voicemail (020 7946 0852), no answer. 3 edges", ["020 7946 0852"]),
    ("phone", "Batch id 20250716-093012 was late, host 192.0.2.17", []),
    ("id_number", "They read out NI number QQ 12 34 56 C over the line. SSN 666123456 again, passport no. XX1234567", ["QQ 12 34 56 C", "666123456", "XX1234567"]),
    ("id_number", "Ticket 109-21-3002 has three subtasks.", []),
    ("address", "Parcel goes to Flat 20, 62 Old Quarry Avenue, Tarnwick.", ["Flat 20, 62 Old Quarry Avenue"]),
    ("address", "Moved to Lindenaustr. 61, 01234 Neufurt; 45 bis rue des Ombrelles; Plaza de los Hornos, 25, 1º C, Vallombre", ["Lindenaustr. 61", "45 bis rue des Ombrelles", "Plaza de los Hornos, 25, 1º C"]),
    ("address", "Order of stages: 3 Street view, 4 Road test.", []),
    ("name", "Ask Ms. Brenbrook, Omar before touching it. According to Julia M. van Halotti, fine. Dr. L. Wesham signed", ["Brenbrook, Omar", "Julia M. van Halotti", "L. Wesham"]),
    ("name", "what did paul mireaux say about decay", ["paul mireaux"]),
    ("name", "The Blue Atlas project and Quiet Harbor release are done.", []),
]


@pytest.mark.parametrize(("kind", "text", "items"), CASES)
def test_candidates(kind, text, items):
    found = [text[c.start : c.end] for c in pii.candidates(text) if c.kind == kind]
    wrong = [x for x in found if x not in items]
    assert all(i in found for i in items)
    # What is cut too widely is for the labelers to vote down.
    assert all(sum(pii.votes(c, text)) < 2 for c in pii.candidates(text) if c.kind == kind and text[c.start : c.end] in wrong)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.3
    accuracy = np.array([0.95, 0.8, 0.7])
    right = rng.random((20_000, 3)) < accuracy
    votes = np.where(right == y[:, None], 1, -1) * (rng.random((20_000, 3)) < 0.8)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, table = pii.estimate(patterns, counts.astype(float))
    assert ((post[inverse.ravel()] > 0.5) == y).mean() > 0.9
    assert table[1, 0, 2] > table[1, 2, 2]


def test_items_and_placeholders(spark):
    from mnemospark.llm.pii import items_of_rows, redact

    # Reliabilities are estimated from distinct texts, so there are many of each kind, more of those without items.
    rows = [("content", f"r{j}" if i == 0 else f"r{j}-{i}", f"{i}. {t}") for j, (_, t, items) in enumerate(CASES) for i in range(20 if items else 60)]
    rows += [("query", "r0", rows[0][2])]
    rows = rows + [("content", "null", None), ("content", "empty", ""), ("content", "long", "x " * 60_000 + "Mail from ana@mail.example.org today")]
    df = spark.createDataFrame(rows, "source_field string, record_key string, text string")
    found = {(r.record_key, r.pii_type, r.pii_text) for r in items_of_rows(df).collect()}
    assert ("long", "email", "ana@mail.example.org") in found and ("r0", "email", "ana.b+x@mail.example.org") in found
    assert not any(k == "r3" for k, _, _ in found)
    masked = {r.record_key: r.redacted for r in redact(df).collect()}
    assert masked["r0"] == "0. Mail from [EMAIL], please." and "r3" not in masked
    assert items_of_rows(df.where("false")).count() == 0


TEXTS = [
    "Die Prüfung dauerte neun Minuten, und die Gespräche wären kürzer geworden.", "Le résumé précédent a été écrasé ; l’été, la forêt — et le café…", "Мы не забыли ключ от дачи; оценка полезности выросла.",
    "Część notatek wciąż nie ma oceny, więc próg został obniżony.", "¿Por qué desaparece la señal después de la sesión? ¡Ojo!", "It’s the “same” note — isn’t it?",
]
DAMAGE = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "latin-1")]


def sloppy(raw: bytes, page: str) -> str:
    return "".join(bytes([b]).decode(page, errors="ignore") or chr(b) for b in raw)


@pytest.fixture(scope="module")
def repairer():
    counts = Counter()
    for t in TEXTS * 40:
        for w in E.odd_words(t):
            counts.update(E.pairs_of(w))
    return E.Repairer(E.Plausibility(counts), E.RepairParams())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("written", "read"), DAMAGE)
@pytest.mark.parametrize("times", [1, 2])
def test_encoding_round_trip(repairer, text, written, read, times):
    bad = text
    for _ in range(times):
        bad = sloppy(bad.encode(written), read)
    assert repairer.repair(bad) == text
    assert repairer.repair("All is well here.\n" + bad + "\nNothing to see.") == "All is well here.\n" + text + "\nNothing to see."


def test_encoding_leaves_alone(repairer):
    for text in [*TEXTS, "plain", "Search for “â€™” in old exports.", "The console printed `Ã©` instead of é.", "A `�` in the preview is a font problem."]:
        assert repairer.repair(text) is None
    assert repairer.repair("Le caf� est ferm�.") == "" and repairer.repair("Donâ€™t merge â€œthisâ€ with that.") == ""


def test_encoding_of_rows(spark):
    good = "Die Prüfung der Gespräche: größtenteils überflüssig für später."
    rows = [(i, good) for i in range(60)] + [(100, good.encode().decode("cp1252")), (101, None), (102, ""), (103, (good + " ") * 3000)]
    found = {r.id: r.restored for r in E.repair_encoding(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert found == {100: good}
    assert E.repair_encoding(spark.createDataFrame([], "id long, text string")).count() == 0


def test_boundaries_are_optimal():
    rng = random.Random(4)
    lengths = np.array(sorted(rng.sample(range(1, 60), 9)))
    counts = np.array([rng.randint(1, 9) for _ in lengths])
    for k in (1, 2, 3, 4):
        got = packing.bucket_boundaries(lengths, counts, k)
        padding = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        best = min(padding((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], k - 1))
        assert len(got) <= k and padding(got) == best


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([3, 10, 40, 90, 100, 101, 250])) for i in range(400)] + [(500, None), (501, 0), (502, 1000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens int"), [("a", 100), ("b", 300)]).toPandas()
    for name, capacity in (("a", 100), ("b", 300)):
        own = got[got.profile == name]
        assert dict(own.groupby("doc_id").tokens.sum()) == {i: n or 0 for i, n in rows}
        fill = own[own.container.notna()].groupby("container").tokens.sum()
        assert fill.max() <= capacity and sorted(fill.index) == list(range(len(fill))) and fill.mean() > 0.93 * capacity
        sizes = dict(rows)
        assert all(sizes[d] > capacity for d, n in own.groupby("doc_id").size().items() if n > 1)
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), [("a", 100)]).count() == 0


def test_schedule_deviates_by_less_than_a_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    done = Counter()
    for t, (s, k, slot) in enumerate(mixing.schedule(weights, 1000), 1):
        assert k == done[s] and slot == t - 1
        done[s] += 1
        assert all(abs(done[x] - w * t) < 1 for x, w in weights.items())


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, "big" if i < 2000 else "small", rng.randint(5, 60)) for i in range(2300)] + [(9000, None, 5), (9001, "big", 0), (9002, "other", 50)]
    targets = [("big", 0.7, 1), ("small", 0.3, 2), ("empty", 0.2, 3)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, tokens int"), targets)
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    assert report["small"].most_repeats == 2 and report["big"].most_repeats == 1 and report["empty"].tokens == 0
    assert report["big"].actual_share == pytest.approx(0.7, abs=0.005)
    p = mixed.toPandas()
    assert not p.duplicated(["doc_id", "copy"]).any() and set(p.source) == {"big", "small"}
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, tokens int"), targets).count() == 0


def test_tokens(spark):
    from mnemospark.llm.tokens import DEFAULT_TOKENIZER, encoding

    text = "Some words, with spaces  and\nlines; " * 2000
    assert count_tokens(text, DEFAULT_TOKENIZER) == len(encoding(DEFAULT_TOKENIZER).encode_ordinary(text))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world")], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in with_token_counts(df).collect()} == {1: 0, 2: 0, 3: 2}


def test_two_levels_of_routing(spark):
    """A sample too small to tell shards apart: leaves get trees of their own, and vectors meet about as few others as by one tree over all."""
    from pyspark.sql import functions as F

    n, rng, met = 1600, np.random.default_rng(5), {}
    x = (np.repeat(rng.normal(size=(n // 40, DIM)) * 2, 40, axis=0) + rng.normal(size=(n, DIM)) * 0.3).astype(np.float32)
    ids = [f"m{i:05}" for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vector array<float>").cache()
    groups = df.select(F.xxhash64("vector").alias("gid"), F.pmod(F.xxhash64(F.xxhash64("vector"), F.lit(3)), F.lit(1_000_003)).alias("salt"), "vector")
    for sample in (96, n):
        params = TreeParams(factor=0.4, shard_rows=80, leaf_rows=40, sample_rows=sample)
        placed, _ = _placed(groups, n, params.factor * math.acos(0.8), DIM, params)
        counted = placed.selectExpr("shard", "int(role = 0) own", "int(role = 1) guest").groupBy("shard").sum("own", "guest").collect()
        assert sum(r[1] for r in counted) == n and max(r[1] for r in counted) <= 6 * params.shard_rows
        met[sample] = sum(r[1] * (r[1] + r[2]) for r in counted) / n
    assert n * 16 > 80 * 96 and met[96] <= 2 * met[n]
    params = TreeParams(factor=0.4, shard_rows=80, leaf_rows=40, sample_rows=96)
    got, want = {(r.id, r.neighbour) for r in most_similar(df, k=5, min_cosine=0.8, dim=DIM, params=params).collect()}, brute_neighbours(ids, x, 5, 0.8)
    assert len(got & want) >= 0.97 * len(want)
