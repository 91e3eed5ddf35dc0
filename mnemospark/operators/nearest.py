"""The nearest vector among those that rank before, for every vector: all pairs of blocks, none left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: By how much a similarity in single precision may be off; what is this near to the best is compared again in double.
SLACK = 4e-6


def _dealt(blocks: dict[str, int], dim: int):
    """Each row once for every block of its kind, which its own meets; vectors as bytes, two a number where halves lose nothing."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.asarray(batch.column("vector").flatten(), dtype=np.float32).reshape(-1, dim)
            with np.errstate(over="ignore"):
                half = flat.astype(np.float16)
            fits = (half.astype(np.float32) == flat).all(axis=1)
            packed = pa.array([half[i].tobytes() if fits[i] else flat[i].tobytes() for i in range(len(flat))], pa.binary())
            most = np.array([blocks[k] for k in batch.column("kind").to_pylist()])
            block = np.asarray(batch.column("hash"), dtype=np.int64) % most
            for other in range(most.max()):
                take = np.flatnonzero(other < most)
                low, high = np.minimum(block, other)[take], np.maximum(block, other)[take]
                rest = [pa.array(low), pa.array(high), pa.array(block[take] == low), *(c.take(pa.array(take)) for c in (batch.column("id"), batch.column("place"), packed))]
                yield pa.RecordBatch.from_arrays([batch.column("kind").take(pa.array(take)), *rest], ["kind", "low", "high", "first", "id", "place", "packed"])

    return deal


class _Best:
    """The best found so far for a block of rows, with all that come so near that only double precision can tell."""

    def __init__(self, rows: int, least: float) -> None:
        self.best, self.least = np.full(rows, -2.0, dtype=np.float32), least
        self.q, self.r = [], []

    def add(self, at: int, cos: np.ndarray, can: np.ndarray, columns: np.ndarray, codes: np.ndarray) -> None:
        v = np.where(can, cos, np.float32(-2))
        best = np.maximum(self.best[at : at + len(v)], v.max(axis=1))
        self.best[at : at + len(v)] = best
        i, j = np.nonzero(v >= np.where(best > -1.5, np.maximum(best, self.least) - SLACK, np.inf).astype(np.float32)[:, None])
        j = columns[j]
        if len(i) > 4 * len(v):  # of equal vectors the first one will do
            _, once = np.unique(i * (int(codes.max()) + 1) + codes[j], return_index=True)
            i, j = i[once], j[once]
        self.q.append(at + i)
        self.r.append(j)

    def found(self, raw: np.ndarray, queries: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, its nearest, cosine) of the rows that have one; of equal ones the first."""
        q, r = np.concatenate(self.q), np.concatenate(self.r)
        exact = np.empty(len(q))
        for s in range(0, len(q), 20_000):
            x, y = raw[queries[q[s : s + 20_000]]].astype(np.float64), raw[r[s : s + 20_000]].astype(np.float64)
            exact[s : s + 20_000] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        order = np.lexsort((r, -np.round(exact, digits), q))
        q, r, exact = q[order], r[order], exact[order]
        one = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=bool)
        return q[one], r[one], exact[one]


def _unit(x: np.ndarray) -> np.ndarray:
    x /= np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(np.float32)
    return x


def _nearest_in(first: np.ndarray, own: bool, raw: np.ndarray, codes: np.ndarray, place: np.ndarray, ties: bool, least: float, digits: int, tile: tuple[int, int] = (512, 4096)):
    """(row, nearest, cosine) for the rows of two blocks, or of one with itself. Rows are in order of their ids."""
    a, b = (np.arange(len(raw)),) * 2 if own else (np.flatnonzero(first), np.flatnonzero(~first))
    if not len(a) or not len(b):
        return
    there, back = _Best(len(a), least), _Best(len(b), least)
    xa = _unit(raw[a])
    xb = xa if own else _unit(raw[b])
    for s in range(0, len(a), tile[0]):
        rows = a[s : s + tile[0]]
        for t in range(0, len(b), tile[1]):
            columns = b[t : t + tile[1]]
            cos = xa[s : s + tile[0]] @ xb[t : t + tile[1]].T
            p, q = place[rows][:, None], place[columns][None, :]
            before, after = q < p, p < q
            if ties:
                before |= (q == p) & (columns[None, :] < rows[:, None])
                after |= (q == p) & (columns[None, :] > rows[:, None])
            there.add(s, cos, before, columns, codes)
            if not own:
                back.add(t, cos.T, after.T, rows, codes)
    for side, queries in ((there, a), (back, b))[: 1 if own else 2]:
        q, r, c = side.found(raw, queries, digits)
        yield queries[q], r, c


def _compared(ties: bool, least: float, digits: int, dim: int):
    """Rows come sorted by the pair of blocks and by id."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def ready():
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            raw, known, codes = np.empty((rows.num_rows, dim), dtype=np.float32), {}, np.empty(rows.num_rows, dtype=np.int64)
            for i, x in enumerate(rows.column("packed")):
                x = x.as_py()
                raw[i] = np.frombuffer(x, dtype=np.float16 if len(x) == 2 * dim else np.float32)
                codes[i] = known.setdefault(hash(x), i)
            ids, first, place = rows.column("id").combine_chunks(), np.asarray(rows.column("first")), np.asarray(rows.column("place"))
            del rows, known
            for q, r, c in _nearest_in(first, at[1] == at[2], raw, codes, place, ties, least, digits):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), ids.take(pa.array(r)), pa.array(c)], ["id", "other", "cosine"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "low", "high"))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if keys[start] != at:
                    yield from ready()
                    held, at = [], keys[start]
                held.append(batch.slice(start, i - start))
                start = i
        yield from ready()

    return compare


def nearest_before(rows: DataFrame, ties: bool = False, least: float = -1.0, digits: int = 9, block_rows: int = 24_576, dim: int = 384) -> DataFrame:
    """(id, other, cosine): for each row (id, kind, place, vector) the most similar row of its kind with a smaller place.

    Every two rows of a kind are compared and the condition holds before the nearest is chosen, so no number of others
    can crowd it out. Rows of equal place don't count, or with ``ties`` those of a smaller id do. Only similarities of at least
    ``least`` count; equal ones, to ``digits`` places, go to the smaller id. Rows with a null, and vectors of another length than ``dim``, with a
    null or non-finite number, or all zero take no part. Ids are distinct, kinds few. Rows of a kind are dealt to blocks by hash, and one task compares
    one pair of blocks both ways: the work is quadratic in the rows of a kind, and what is sent is each row once for each block of its kind.
    """
    usable = (
        rows.where((F.size("vector") == dim) & F.col("id").isNotNull() & F.col("kind").isNotNull() & F.col("place").isNotNull())
        .select("id", "kind", F.col("place").cast("long").alias("place"), F.col("vector").cast("array<float>").alias("vector"))
        .where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    )
    blocks = {r.kind: -(-r["count"] // block_rows) for r in rows.where("kind is not null").groupBy("kind").count().collect()}  # without a look at the vectors, which would be shuffled for it
    dealt = usable.withColumn("hash", F.xxhash64("id")).mapInArrow(_dealt(blocks, dim), "kind string, low long, high long, first boolean, id string, place long, packed binary")
    pairs = sum(b * (b + 1) // 2 for b in blocks.values())
    placed = dealt.repartition(max(1, 2 * pairs), "kind", "low", "high").sortWithinPartitions("kind", "low", "high", "id")
    found = placed.mapInArrow(_compared(ties, least, digits, dim), "id string, other string, cosine double").where(F.col("cosine") >= least)
    best = found.groupBy("id").agg(F.min(F.struct((-F.round("cosine", digits)).alias("order"), "other", "cosine")).alias("n"))
    return best.select("id", F.col("n.other").alias("other"), F.col("n.cosine").alias("cosine"))
