"""The most similar vectors of every vector: vantage-point trees per shard.

Distances are angles, which obey the triangle inequality. A vantage-point tree halves a set by the distance to a
vantage point v: inside are the vectors nearer to v than mu. A query within ``reach`` of its neighbours need not look
inside if d(q, v) - factor * reach > mu, nor outside if d(q, v) + factor * reach <= mu. With factor 1 nothing within reach is
missed; a smaller factor prunes more and may miss some, since in many dimensions two near vectors nearly agree in
their distance to a third: that they differ by all of their own distance hardly happens.

* A *routing tree* is fitted on the driver to a bounded sample (``sample_rows`` vectors of ``dim`` times 4 bytes, 31 MB with the
  defaults, whatever the size of the data). Its leaves are shards of about ``shard_rows`` vectors. Where the sample is too small to
  tell shards apart, each leaf gets a routing tree of its own, fitted in a task to a sample of that leaf, again of ``sample_rows`` at most;
  so two levels tell the square of the leaves of one apart. A leaf that still holds more, for want of structure, is dealt out to several shards by hash.
* Every vector is indexed in one shard, and visits the other shards that it can't rule out. Either of two shards finds
  their pairs, so each vector visits only one of each two: half of the traffic.
* In a shard, a tree of the same kind is built over all its vectors. Visitors stream by in Arrow batches and are
  compared with whole leaves at a time, as matrix products.

Equal vectors are indexed once. A vector's neighbours include its own copies, and each copy is a neighbour in its own right;
of a group of copies the first ``k + 1`` ids can be needed, so a group of any size costs no more than that.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.runtime import checkpoint


@dataclass(frozen=True)
class TreeParams:
    """How trees are built and searched.

    factor: share of the reach that pruning honours; 1 is exact. leaf_rows: below this a set isn't split.
    least_gain: a split is worth its while if it lets queries skip at least this share of what they could skip if none
    came near the border. candidates: vantage points tried per split. sample_rows: bound of the sample that a routing tree is fitted to.
    """

    factor: float = 0.16
    shard_rows: int = 8192
    leaf_rows: int = 256
    least_gain: float = 0.6
    candidates: int = 24
    sample_rows: int = 20_000
    probe_rows: int = 2_000


@dataclass
class Node:
    vantage: np.ndarray | None = None
    mu: float = 0.0
    inside: "Node | None" = None
    outside: "Node | None" = None
    rows: np.ndarray | None = field(default=None, repr=False)
    leaf: int = -1


def angles(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ v, -1.0, 1.0))


def _vantages(x: np.ndarray, params: TreeParams, rng: np.random.Generator) -> np.ndarray:
    """Candidate vantage points: members of the set, and the directions in which members gather around them."""
    some = x[rng.choice(len(x), min(len(x), params.candidates), replace=False)]
    probe = x[rng.choice(len(x), min(len(x), params.probe_rows), replace=False)]
    near = probe @ some.T
    own = []
    for j in range(len(some)):
        cut = np.partition(near[:, j], -max(1, len(probe) // 40))[-max(1, len(probe) // 40)]
        mean = probe[near[:, j] >= cut].mean(0)
        for _ in range(2):  # the mean of those nearest to the mean
            mean /= max(np.linalg.norm(mean), 1e-9)
            close = probe @ mean
            mean = probe[close >= max(np.partition(close, -max(1, len(probe) // 40))[-max(1, len(probe) // 40)], 0.8 * close.max())].mean(0)
        own.append(mean / max(np.linalg.norm(mean), 1e-9))
    return np.vstack([some, np.array(own, dtype=np.float32)])


def _split(x: np.ndarray, margin: float, least: int, params: TreeParams, rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
    """Vantage point and radius whose halves a query has to visit the smallest expected share of."""
    probe = x[rng.choice(len(x), min(len(x), params.probe_rows), replace=False)]
    vantages = _vantages(x, params, rng)
    near = np.sort(np.arccos(np.clip(probe @ vantages.T, -1, 1)), axis=0)
    n, best = len(probe), None
    shares = [s for s in (0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.33, 0.42, 0.5, 0.6, 0.7, 0.8) if s * len(x) >= least / 4]
    for j in range(vantages.shape[0]):
        d = near[:, j]
        for s in shares:
            at = int(s * n)
            if not 0 < at < n:
                continue
            lo, hi = max(1, int(at * 0.7)), min(n - 1, int(at * 1.4) + 2)
            cut = lo + int(np.argmax(d[lo:hi] - d[lo - 1 : hi - 1])) if hi > lo else at  # the widest gap near by
            for mu in (d[at], (d[cut] + d[cut - 1]) / 2):
                inner = np.searchsorted(d, mu, "right") / n
                if not 0 < inner < 1:
                    continue
                visited = inner * np.searchsorted(d, mu + margin) / n + (1 - inner) * (1 - np.searchsorted(d, mu - margin) / n)
                if 1 - visited >= params.least_gain * 2 * inner * (1 - inner) and (best is None or visited < best[2]):
                    best = (vantages[j], float(mu), float(visited))
    return best


def build(x: np.ndarray, margin: float, most_rows: int, params: TreeParams, seed: int = 11) -> tuple[Node, int]:
    """A vantage-point tree over the rows of ``x`` and its number of leaves.

    Sets of up to ``most_rows``, and those that no vantage point splits with profit, are leaves.
    """
    rng = np.random.default_rng(seed)
    leaves = 0

    def grow(rows: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        found = _split(x[rows], margin, most_rows, params, rng) if len(rows) > most_rows and depth < 64 else None
        if found is None:
            leaves += 1
            return Node(rows=rows, leaf=leaves - 1)
        vantage, mu, _ = found
        inner = angles(x[rows], vantage) <= mu
        if inner.all() or not inner.any():
            leaves += 1
            return Node(rows=rows, leaf=leaves - 1)
        return Node(vantage, mu, grow(rows[inner], depth + 1), grow(rows[~inner], depth + 1))

    return grow(np.arange(len(x)), 0), leaves


def visits(root: Node, x: np.ndarray, margin: float) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, rows of x that can't rule it out); with margin 0 each row comes to its own leaf only."""
    stack = [(root, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node.rows is not None:
            yield node, rows
            continue
        d = angles(x[rows], node.vantage)
        stack += [(node.inside, rows[d - margin <= node.mu]), (node.outside, rows[d + margin > node.mu])]


def _unit(batch: pa.Array, dim: int) -> np.ndarray:
    """Vectors that came as bytes, 2 or 4 a number, as rows of length 1."""
    raw = batch.to_pylist()
    x = np.empty((len(raw), dim), dtype=np.float32)
    for i, b in enumerate(raw):
        x[i] = np.frombuffer(b, dtype=np.float16 if len(b) == 2 * dim else np.float32)
    return _normed(x)


def _normed(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(np.float32)


def _router(tree: Node, margin: float, dim: int):
    """One row for the leaf that holds a vector (role 0), and one for each leaf that it visits (role 1).

    Vectors travel as bytes, two a number where halves lose nothing. Of equal vectors each task sends on one.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            gids = batch.column("gid").to_pylist()
            new = [i for i, g in enumerate(gids) if not (g in seen or seen.add(g))]
            if not new:
                continue
            batch = batch.take(pa.array(new))
            flat = np.asarray(batch.column("vector").flatten(), dtype=np.float32).reshape(-1, dim)
            with np.errstate(over="ignore"):
                half = flat.astype(np.float16)
            fits = (half.astype(np.float32) == flat).all(axis=1)
            packed = [half[i].tobytes() if fits[i] else flat[i].tobytes() for i in range(len(flat))]
            x = _normed(flat)
            home = np.empty(len(x), dtype=np.int64)
            for node, rows in visits(tree, x, 0.0):
                home[rows] = node.leaf
            at, leaf, role = [np.arange(len(x))], [home], [np.zeros(len(x), dtype=np.int8)]
            for node, rows in visits(tree, x, margin):
                going = _one_way(home, rows, node.leaf)
                at.append(going)
                leaf.append(np.full(len(going), node.leaf))
                role.append(np.ones(len(going), dtype=np.int8))
            take = pa.array(np.concatenate(at))
            columns = [pa.array(np.concatenate(leaf), pa.int32()), pa.array(np.concatenate(role), pa.int8()), batch.column("gid").take(take), batch.column("salt").take(take), pa.array(packed, pa.binary()).take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["leaf", "role", "gid", "salt", "packed"])

    return route


def _one_way(home: np.ndarray, rows: np.ndarray, place: int) -> np.ndarray:
    """Of two places one visits the other; which one alternates, so that none gets all the visitors."""
    return rows[(home[rows] != place) & ((home[rows] < place) == ((home[rows] + place) % 2 == 0))]


def _dealt(tree: Node, salts: np.ndarray, x: np.ndarray, keys: np.ndarray, roles: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, role) within one leaf: its own vectors to their shards and to others, visitors to all that they can't rule out."""
    first = np.concatenate([[0], np.cumsum(salts)])  # shards first[sub] .. first[sub + 1] - 1
    home = np.full(len(x), -1, dtype=np.int64)
    for node, rows in visits(tree, x, 0.0):
        rows = rows[roles[rows] == 0]
        home[rows] = first[node.leaf] + keys[rows] % salts[node.leaf]
    own = np.flatnonzero(home >= 0)
    at, shard, role = [own], [home[own]], [np.zeros(len(own), dtype=np.int8)]
    for node, rows in visits(tree, x, margin):
        guests, hosts = rows[roles[rows] == 1], rows[roles[rows] == 0]
        for s in range(first[node.leaf], first[node.leaf + 1]):
            going = np.concatenate([guests, _one_way(home, hosts, s)])
            at.append(going)
            shard.append(np.full(len(going), s))
            role.append(np.ones(len(going), dtype=np.int8))
    return np.concatenate(at), np.concatenate(shard), np.concatenate(role)


def _leaf_trees(expected: dict[int, float], margin: float, dim: int, params: TreeParams):
    """Fits a routing tree to the sample of a leaf: one row of the tree, with the number of shards in it."""

    def fit(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        order = np.argsort(np.asarray(table.column("gid")))
        x = _unit(table.column("packed").take(pa.array(order)), dim)
        tree, salts = fitted(x, expected[leaf], margin, params)
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps((tree, salts))], pa.binary()), "shards": pa.array([int(salts.sum())], pa.int64())})

    return fit


def fitted(x: np.ndarray, total: float, margin: float, params: TreeParams) -> tuple[Node, np.ndarray]:
    """A routing tree over a sample of ``total`` vectors, without the sample's rows, and the number of shards that each leaf needs."""
    tree, leaves = build(x, margin, max(16, int(params.shard_rows * len(x) / max(total, 1))), params)
    counts, nodes = np.zeros(leaves), [tree]
    while nodes:
        node = nodes.pop()
        if node.rows is not None:
            counts[node.leaf], node.rows = len(node.rows), np.arange(0)
        else:
            nodes += [node.inside, node.outside]
    return tree, np.maximum(1, np.ceil(counts * total / max(len(x), 1) / params.shard_rows)).astype(np.int64)


def _leaf_router(offsets: dict[int, int], margin: float, dim: int):
    """Rows come sorted by leaf and part, the leaf's tree before its vectors."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, salts = None, None, None
        for batch in batches:
            leaves, parts, roles = np.asarray(batch.column("leaf")), np.asarray(batch.column("part")), np.asarray(batch.column("role"))
            cuts = np.concatenate([[0], np.flatnonzero((leaves[1:] != leaves[:-1]) | (parts[1:] != parts[:-1]) | ((roles[1:] < 0) != (roles[:-1] < 0))) + 1, [len(leaves)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if roles[a] < 0:
                    at, (tree, salts) = (leaves[a], parts[a]), pickle.loads(batch.column("packed")[int(a)].as_py())
                    continue
                if at != (leaves[a], parts[a]):
                    raise ValueError("a leaf's vectors came without its tree")
                own = batch.slice(int(a), int(b - a))
                rows, shard, role = _dealt(tree, salts, _unit(own.column("packed"), dim), np.asarray(own.column("salt")), roles[a:b], margin)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(shard + offsets[int(leaves[a])], pa.int64()), pa.array(role, pa.int8()), own.column("gid").take(take), own.column("packed").take(take)], ["shard", "role", "gid", "packed"])

    return route


def _narrow_router(salts: np.ndarray, offsets: np.ndarray):
    """Where each leaf is one shard or a few by hash: no tree is needed to tell them apart."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, keys, roles = (np.asarray(batch.column(c), dtype=np.int64) for c in ("leaf", "salt", "role"))
            at, shard, role = [], [], []
            for one in np.unique(leaf):
                rows = np.flatnonzero(leaf == one)
                i, s, r = _dealt(Node(rows=np.arange(0), leaf=0), salts[one : one + 1], np.zeros((len(rows), 1), dtype=np.float32), keys[rows], roles[rows], 0.0)
                at.append(rows[i])
                shard.append(s + offsets[one])
                role.append(r)
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard), pa.int64()), pa.array(np.concatenate(role), pa.int8()), batch.column("gid").take(take), batch.column("packed").take(take)], ["shard", "role", "gid", "packed"])

    return route


def _placed(groups: DataFrame, total: int, margin: float, dim: int, params: TreeParams) -> tuple[DataFrame, int]:
    """(shard, role, gid, packed) of every vector in its shard and in those that it visits, and the number of shards."""
    kind = "shard long, role byte, gid long, packed binary"
    tree, salts = Node(rows=np.arange(0), leaf=0), np.array([1])
    if total > params.shard_rows:
        share = int(min(1.0, params.sample_rows / total) * (1 << 40))
        drawn = groups.where(F.pmod(F.xxhash64("gid", F.lit(1)), F.lit(1 << 40)) < share).dropDuplicates(["gid"]).select("gid", "vector").toArrow()
        drawn = drawn.take(pa.array(np.argsort(np.asarray(drawn.column("gid")))))
        x = _normed(np.asarray(drawn.column("vector").combine_chunks().flatten(), dtype=np.float32).reshape(-1, dim))
        tree, salts = fitted(x, total, margin, params)
    routed = groups.mapInArrow(_router(tree, margin, dim), "leaf int, role byte, gid long, salt long, packed binary")
    if total * 16 <= params.shard_rows * params.sample_rows:
        # The sample holds at least 16 vectors of each shard: one level tells the shards apart.
        offsets = np.concatenate([[0], np.cumsum(salts)])
        return routed.mapInArrow(_narrow_router(salts, offsets), kind), int(salts.sum())
    routed = checkpoint(routed)
    held = {r.leaf: r.n for r in routed.where("role = 0").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a leaf
    sizes = groups.sparkSession.createDataFrame([(leaf, n, min(1 << 40, int(params.sample_rows / n * (1 << 40)))) for leaf, n in held.items()], "leaf int, n long, share long")
    few = routed.where("role = 0").join(F.broadcast(sizes), "leaf").where(F.pmod(F.xxhash64("gid", F.lit(2)), F.lit(1 << 40)) < F.col("share"))
    trees = checkpoint(few.select("leaf", "gid", "packed").groupBy("leaf").applyInArrow(_leaf_trees(held, margin, dim, params), "leaf int, tree binary, shards long"))
    counts = sorted((r.leaf, r.shards) for r in trees.select("leaf", "shards").collect())
    offsets, shards = {}, 0
    for leaf, n in counts:
        offsets[leaf] = shards
        shards += n
    # A leaf's vectors are dealt out to parts, each of which gets the leaf's tree first.
    parts = F.ceil(F.col("n") / (16 * params.shard_rows)).cast("int")
    heads = trees.join(F.broadcast(sizes), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(-1).cast("byte").alias("role"), F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("salt"), F.col("tree").alias("packed"))
    body = routed.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod("salt", parts).cast("int").alias("part"), "role", "gid", "salt", "packed")
    streams = heads.unionByName(body).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "role")
    return streams.mapInArrow(_leaf_router(offsets, margin, dim), kind), shards


class _Shard:
    """The tree over one shard's own vectors, searched by blocks of rows."""

    def __init__(self, gids: np.ndarray, x: np.ndarray, margin: float, k: int, least: float, params: TreeParams) -> None:
        self.gids, self.x, self.margin, self.k, self.least = gids, x, margin, k, least
        self.tree, _ = build(x, margin, params.leaf_rows, params)

    def search(self, gids: np.ndarray, x: np.ndarray, own: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, neighbour, cosine) arrays: for rows of x against the shard and, for visitors, also the reverse."""
        q, r, c = [], [], []
        for node, rows in visits(self.tree, x, self.margin):
            for part in np.array_split(rows, max(1, len(rows) // 2048)):
                cos = x[part] @ self.x[node.rows].T
                if self.least > -1:
                    i, j = np.nonzero(cos >= self.least)
                else:
                    keep = min(self.k + 1, cos.shape[1])
                    top = np.argpartition(-cos, keep - 1, axis=1)[:, :keep]
                    low = min(self.k + 1, cos.shape[0])
                    back = np.argpartition(-cos, low - 1, axis=0)[:low]
                    i = np.concatenate([np.repeat(np.arange(len(part)), keep), back.ravel()])
                    j = np.concatenate([top.ravel(), np.tile(np.arange(cos.shape[1]), low)])
                    pairs = np.unique(i * cos.shape[1] + j)
                    i, j = pairs // cos.shape[1], pairs % cos.shape[1]
                i, j = part[i], node.rows[j]
                q.append(i)
                r.append(j)
        if not q:
            return []
        i, j = np.concatenate(q), np.concatenate(r)
        apart = gids[i] != self.gids[j]
        i, j = i[apart], j[apart]
        exact = np.einsum("ij,ij->i", x[i].astype(np.float64), self.x[j].astype(np.float64))
        found = [(gids[i], self.gids[j], exact)]
        if not own:
            found.append((self.gids[j], gids[i], exact))
        return [self._top(*f) for f in found]

    def _top(self, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """No more of a query's neighbours than can be among its k nearest groups."""
        order = np.lexsort((r, -c, q))
        q, r, c = q[order], r[order], c[order]
        start = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
        keep = rank < self.k + 1
        return q[keep], r[keep], c[keep]


def _searcher(margin: float, k: int, least: float, dim: int, params: TreeParams):
    """Rows come sorted by shard, a shard's own vectors before its visitors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, tree = None, [], None

        def out(found):
            for q, r, c in found:
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(c)], ["gid", "near", "cosine"])

        def ready():
            nonlocal tree, own
            if tree is None and own:
                gids, once = np.unique(np.concatenate([g for g, _ in own]), return_index=True)
                x = np.concatenate([v for _, v in own])[once]
                tree, own = _Shard(gids, x, margin, k, least, params), []
                yield from out(tree.search(gids, x, True))

        for batch in batches:
            shards, roles = np.asarray(batch.column("shard")), np.asarray(batch.column("role"))
            gids, x = np.asarray(batch.column("gid")), _unit(batch.column("packed"), dim)
            cuts = np.concatenate([[0], np.flatnonzero((shards[1:] != shards[:-1]) | (roles[1:] != roles[:-1])) + 1, [len(shards)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if shards[a] != at:
                    yield from ready()
                    at, own, tree = shards[a], [], None
                if roles[a] == 0:
                    own.append((gids[a:b], x[a:b]))
                else:
                    yield from ready()
                    if tree is not None:
                        yield from out(tree.search(gids[a:b], x[a:b], False))
        yield from ready()

    return search


def most_similar(vectors: DataFrame, k: int = 10, min_cosine: float = 0.8, dim: int = 384, params: TreeParams = TreeParams()) -> DataFrame:
    """(id, neighbour, cosine, rank) of the k most similar vectors of every vector, if at least ``min_cosine`` similar.

    ``vectors`` has the columns id (string) and vector (array of float). Null vectors, those of another length than
    ``dim``, with a null or non-finite number, or all zero take no part. Repeated ids count once, with the vector of the
    smallest hash should they differ. Ties in similarity go to the smaller id. The reach of the search is
    the angle of ``min_cosine``; -1 makes it the half circle, whose pruning then rests on ``factor`` alone.
    """
    usable = (
        vectors.where(F.col("id").isNotNull() & (F.size("vector") == dim))
        .select("id", F.col("vector").cast("array<float>").alias("vector"))
        .where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
        .withColumn("gid", F.xxhash64("vector"))
    )
    ids = usable.groupBy("id").agg(F.min("gid").alias("gid"))
    # Groups of equal vectors, numbered by their hash: the first k + 1 ids of each.
    members = checkpoint(ids.withColumn("at", F.row_number().over(Window.partitionBy("gid").orderBy("id"))).where(F.col("at") <= k + 1))
    groups = usable.select("gid", F.pmod(F.xxhash64("gid", F.lit(3)), F.lit(1_000_003)).alias("salt"), "vector")

    reach = float(np.arccos(max(min_cosine, -1.0)))
    margin = params.factor * reach
    total = members.where("at = 1").count()
    routed, shards = _placed(groups, total, margin, dim, params)
    placed = routed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "role")
    pairs = placed.mapInArrow(_searcher(margin, k, min_cosine - 1e-6, dim, params), "gid long, near long, cosine double")
    near = pairs.where(F.col("cosine") >= min_cosine).groupBy("gid", "near").agg(F.max("cosine").alias("cosine"))

    # A vector's candidates: the first ids of its own group, and of the k + 1 groups nearest to it.
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("cosine"), "near"))).where(F.col("at") <= k + 1).drop("at")
    own = members.where("at = 1").select("gid", F.col("gid").alias("near"), F.lit(1.0).alias("cosine"))
    all_near = best.unionByName(own)
    first = members.select(F.col("gid").alias("near"), F.col("id").alias("neighbour"))
    listed = all_near.join(first, "near").select("gid", "neighbour", "cosine")
    ranked = ids.join(listed, "gid").where("id <> neighbour").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")
