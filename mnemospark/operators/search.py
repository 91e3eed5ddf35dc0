"""All queries against all rows, dealt out to cells: each cell holds a share of the queries, meets a share of the rows and gives only its k best of each query.

A row is sent once for each share of the queries and a query once for each share of the rows; no match is shuffled but the best of a cell. In a
cell, rows come in order of their ids, so that of equal ones the first to come is the one that counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a row of a cell is; rows come in this order.
QUERY, LEFT_OUT, LISTED, ROW = range(4)
#: Rows that are scored at once.
BLOCK = 4096
#: Bits of a map of ids, 1 MB of them.
MARKS = 1 << 23


class Best:
    """The k highest scores of one query so far, in order; of equal ones those that came first."""

    __slots__ = ("k", "score", "at", "least")

    def __init__(self, k: int) -> None:
        self.k, self.score, self.at, self.least = k, np.empty(0), np.empty(0, dtype=np.int64), -np.inf

    def add(self, score: np.ndarray, at: np.ndarray) -> None:
        """Scores of rows in order, all of them beyond ``least``."""
        if len(score) > 2 * self.k:
            kept = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, at = score[kept], at[kept]
        score, at = np.concatenate([self.score, score]), np.concatenate([self.at, at])
        order = np.argsort(-score, kind="stable")[: self.k]
        self.score, self.at = score[order], at[order]
        if len(order) == self.k:
            self.least = self.score[-1]


def _in_cells(scorer: Callable, k: int, of: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, rows, held, last = None, {}, None, [], None

        def score() -> None:
            nonlocal rows, last
            if not held:
                return
            got = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = got.column("id").combine_chunks()
            # Rows of one id are copies.
            new = np.ones(len(ids), dtype=bool)
            if len(ids):
                new[1:] = np.asarray(pc.not_equal(ids[1:], ids[:-1]))
                new[0] = last is None or ids[0].as_py() != last
                last = ids[-1].as_py()
            if LISTED in parts:
                new &= np.asarray(pc.is_in(ids, value_set=parts[LISTED]))
            got = got.filter(pa.array(new))
            if rows is None:
                empty = lambda n: pa.Table.from_batches(parts.get(n, []), schema=got.schema)
                rows = (scorer(empty(QUERY), k), empty(LEFT_OUT).select(["query_id", "id"]).combine_chunks(), [])
            if got.num_rows:
                rows[0].add(got, sum(map(len, rows[2])), _left_out(rows[0].number, rows[1], got.column("id").combine_chunks()))
                rows[2].append(got.column("id").combine_chunks())

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal rows, last
            score()
            if rows is not None and rows[2]:
                ids = pa.concat_arrays(rows[2])
                for query, best in zip(rows[0].ids, rows[0].best):
                    if len(best.at):
                        yield pa.RecordBatch.from_arrays([pa.array([query] * len(best.at), rows[0].kind), ids.take(pa.array(best.at)), pa.array(best.score)], ["query_id", "id", "score"])
            parts.clear()
            rows = last = None

        def joined(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some, n = [], 0
            for b in found:
                some.append(b)
                n += b.num_rows
                if n >= 20_000:
                    yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                    some, n = [], 0
            if some:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()

        waiting = 0
        for batch in batches:
            cells, kinds = np.asarray(batch.column("cell")), np.asarray(batch.column("part"))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if a == b:
                    continue
                if cells[a] != cell:
                    yield from joined(finished())
                    cell, waiting = cells[a], 0
                piece = batch.slice(a, b - a)
                if kinds[a] == ROW:
                    if LISTED in parts and isinstance(parts[LISTED], list):
                        parts[LISTED] = pa.concat_arrays([p.column("id") for p in parts[LISTED]])
                    elif of and LISTED not in parts:
                        parts[LISTED] = pa.array([], batch.schema.field("id").type)
                    for s in range(0, piece.num_rows, block):
                        held.append(piece.slice(s, block))
                        waiting += held[-1].num_rows
                        if waiting >= block:
                            score()
                            waiting = 0
                else:
                    parts.setdefault(int(kinds[a]), []).append(piece)
        yield from joined(finished())

    return run


def _left_out(number: dict, pairs: pa.Table, ids: pa.Array) -> dict[int, np.ndarray]:
    """Of each query, the places in ``ids`` of what is left out."""
    if not pairs.num_rows:
        return {}
    at = pc.index_in(pairs.column("id"), value_set=ids)
    here = pairs.append_column("at", at).filter(pc.is_valid(at))
    found: dict[int, list[int]] = {}
    for q, i in zip(here.column("query_id").to_pylist(), here.column("at").to_pylist()):
        if q in number:
            found.setdefault(number[q], []).append(i)
    return {q: np.array(i) for q, i in found.items()}


def best_in_cells(queries: DataFrame, rows: DataFrame, scorer: Callable, k: int, salts: int, shares: int, without: DataFrame | None = None, among: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score): of each query (query_id, ...) and each cell the k rows (id, ...) of the highest score, ties by id.

    ``scorer`` takes the queries of a cell and k, and adds block after block of its rows. Rows of one id are taken as copies. What ``without`` (query_id, id)
    lists is left out before the k are chosen; with ``among`` (id) only rows listed there take part. The k best of a query are among those of its cells.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["id"]
    share, salt = F.pmod(F.xxhash64("query_id"), F.lit(shares)), F.pmod(F.xxhash64("id"), F.lit(salts))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = lambda df, part, a, b: df.withColumn("a", a).withColumn("b", b).withColumn("cell", (F.col("a") * salts + F.col("b")).cast("int")).withColumn("part", F.lit(part)).drop("a", "b")
    every = cells(queries, QUERY, share, each(salts)).unionByName(cells(rows, ROW, each(shares), salt), allowMissingColumns=True)
    if without is not None:
        every = every.unionByName(cells(without.select("query_id", "id"), LEFT_OUT, share, salt), allowMissingColumns=True)
    if among is not None:
        every = every.unionByName(cells(among.select("id"), LISTED, each(shares), salt), allowMissingColumns=True)
    dealt = every.repartitionById(salts * shares, F.col("cell")).sortWithinPartitions("cell", "part", "id")
    return dealt.mapInArrow(_in_cells(scorer, k, "listed" if among is not None else "", block), f"query_id {kinds[0]}, id {kinds[1]}, score double")


def by_terms(first: float, second: float, k1: float | None = None, b: float = 0.0) -> Callable:
    """Scorer by words: queries have ``terms`` (apart by spaces), ``weights``, ``n_terms`` and ``mean``, the mean length; rows ``first`` and ``second``, words with these weights.

    With ``k1`` and ``b`` as BM25 has it, else the weights alone. A query with up to ``all_terms`` terms, also a column, finds what has all of them, another what has any.
    """

    class Scorer:
        def __init__(self, queries: pa.Table, k: int) -> None:
            self.ids, self.kind = queries.column("query_id").to_pylist(), queries.column("query_id").type
            self.number = {q: i for i, q in enumerate(self.ids)}
            self.best = [Best(k) for _ in self.ids]
            split = pc.split_pattern(queries.column("terms").combine_chunks(), " ")
            flat = split.flatten().dictionary_encode()
            self.terms, codes = flat.dictionary, np.asarray(flat.indices)
            sizes, weights = np.asarray(pc.list_value_length(split)), np.asarray(queries.column("weights").combine_chunks().flatten())
            cuts = np.cumsum(sizes)[:-1] if len(sizes) else []
            self.asked = list(zip(np.split(codes, cuts), np.split(weights, cuts)))
            self.mean = queries.column("mean")[0].as_py() if len(self.ids) else None
            n, most = (np.asarray(queries.column(c)) for c in ("n_terms", "all_terms"))
            self.need = np.where(n <= most, n, 0)

        def add(self, rows: pa.Table, start: int, left_out: dict[int, np.ndarray]) -> None:
            if not self.ids:
                return
            at, code, worth = [], [], []
            length = np.zeros(rows.num_rows)
            for column, weight in (("first", first), ("second", second)):
                words = pc.split_pattern(rows.column(column).combine_chunks(), " ")
                flat, of = words.flatten(), np.asarray(pc.list_parent_indices(words))
                there = np.asarray(pc.not_equal(flat, ""))  # of an empty text
                length += np.bincount(of[there], minlength=rows.num_rows)
                found = pc.index_in(flat, value_set=self.terms)
                known = np.asarray(found.is_valid()) & there
                at.append(of[known])
                code.append(np.asarray(found.fill_null(0))[known])
                worth.append(np.full(int(known.sum()), weight))
            key, inverse = np.unique(np.concatenate(code).astype(np.int64) * rows.num_rows + np.concatenate(at), return_inverse=True)
            wtf = np.bincount(inverse, weights=np.concatenate(worth), minlength=len(key))
            place = key % rows.num_rows
            tf = wtf if k1 is None else wtf * (k1 + 1) / (wtf + k1 * (1 - b + b * length[place] / self.mean))
            cuts = np.searchsorted(key // rows.num_rows, np.arange(len(self.terms) + 1))
            for q, (codes, weights) in enumerate(self.asked):
                best, score, n = self.best[q], np.zeros(rows.num_rows), 0
                for c, w in zip(codes, weights):
                    s, e = cuts[c], cuts[c + 1]
                    if s < e:
                        score[place[s:e]] += w * tf[s:e]
                        n += 1
                if not n or n < self.need[q]:
                    continue
                if q in left_out:
                    score[left_out[q]] = 0.0
                if self.need[q] > 1:
                    have = np.zeros(rows.num_rows, dtype=np.int64)
                    for c in codes:
                        have[place[cuts[c] : cuts[c + 1]]] += 1
                    score[have < self.need[q]] = 0.0
                i = np.flatnonzero(score > max(0.0, best.least - 1e-8))
                value = np.round(score[i], 9)
                more = value > best.least
                if more.any():
                    best.add(value[more], start + i[more])

    return Scorer


def packed(vectors: pa.ListArray) -> pa.Array:
    """Vectors as bytes, in the shortest of three kinds of numbers that loses nothing; the first byte tells which."""
    sizes, flat = np.asarray(pc.list_value_length(vectors)), np.asarray(vectors.flatten())
    with np.errstate(over="ignore"):
        kinds = flat.astype(np.float16), flat.astype(np.float32), flat.astype(np.float64)
    fits = np.where(kinds[0] == flat, 0, np.where(kinds[1] == flat, 1, 2))
    ends = np.cumsum(sizes)
    most = [int(fits[s:e].max()) for s, e in zip(ends - sizes, ends)]
    return pa.array([b"efd"[k : k + 1] + kinds[k][s:e].tobytes() for k, s, e in zip(most, ends - sizes, ends)], pa.binary())


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.dtype(x[:1].decode()), offset=1)


def _place(name: str) -> Column:
    """The bit of an id in ``marked``."""
    return F.pmod(F.xxhash64(name), F.lit(MARKS)).cast("int")


def marked(ids: DataFrame) -> np.ndarray:
    """Bits of the ids (memory_id), one each by its hash: an id whose bit isn't set is none of them. ``MARKS`` bits reach the driver, however many ids there are."""
    place = ids.select(_place("memory_id").alias("at"))
    words = place.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("bits")).toArrow()
    found = np.zeros(MARKS >> 5, dtype=np.uint32)
    found[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    return found


def _pack(name: str, marks: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if marks is not None:
                at = np.asarray(batch.column("at"))
                batch = batch.filter(pa.array((marks[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([batch.column(name), packed(batch.column("vector"))], [name, "packed"])

    return run


def with_packed(df: DataFrame, name: str, marks: np.ndarray | None = None) -> DataFrame:
    """(name, packed) of (name, vector): null vectors, those with a null or a non-finite number in them and zero ones are left out, and those that ``marks``, if given, shows to be none of its ids."""
    usable = df.where("vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)).select(name, "vector", *([] if marks is None else [_place(name).alias("at")]))
    return usable.mapInArrow(_pack(name, marks), f"{name} {dict(df.dtypes)[name]}, packed binary")


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def by_cosine(queries: pa.Table, k: int):
    """Scorer by vectors: queries and rows have ``packed``; the score is the distance by cosine, negative. A query meets only vectors of its length."""
    return _Cosines(queries, k)


class _Cosines:
    def __init__(self, queries: pa.Table, k: int) -> None:
        self.ids, self.kind = queries.column("query_id").to_pylist(), queries.column("query_id").type
        self.number = {q: i for i, q in enumerate(self.ids)}
        self.best = [Best(k) for _ in self.ids]
        self.k, self.groups = k, {}
        vectors = [unpacked(x) for x in queries.column("packed").to_pylist()]
        for dim in {len(v) for v in vectors}:
            own = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
            unit = _unit([vectors[i] for i in own])
            self.groups[dim] = own, unit, unit.astype(np.float32)

    def add(self, rows: pa.Table, start: int, left_out: dict[int, np.ndarray]) -> None:
        vectors = [unpacked(x) for x in rows.column("packed").to_pylist()]
        sizes = np.array([len(v) for v in vectors])
        for dim in np.unique(sizes):
            if dim not in self.groups:
                continue
            at = np.flatnonzero(sizes == dim)
            unit = _unit([vectors[i] for i in at])
            single, (own, exact, fast) = unit.astype(np.float32), self.groups[dim]
            # What single precision may be off by at most; what comes this near is worked out again in double.
            slack = np.float32(dim * 2.4e-7)
            for s in range(0, len(own), 256):
                near = fast[s : s + 256] @ single.T
                for q in set(own[s : s + 256].tolist()) & left_out.keys():
                    near[np.searchsorted(own, q) - s, np.isin(at, left_out[q])] = -2.0
                least = np.array([self.best[q].least for q in own[s : s + 256]])
                if len(at) > self.k and np.isinf(least).any():
                    least = np.maximum(least, np.partition(near, len(at) - self.k, axis=1)[:, len(at) - self.k].astype(np.float64) - 1 - slack)
                i, j = np.nonzero(near >= np.maximum(-1.5, 1 + least - slack).astype(np.float32)[:, None])
                for c in range(0, len(i), 20_000):
                    a, b = i[c : c + 20_000], j[c : c + 20_000]
                    value = np.round(np.einsum("ij,ij->i", exact[s + a], unit[b]) - 1, 9)
                    for lo, hi in zip(*_runs(a)):
                        best = self.best[own[s + a[lo]]]
                        more = value[lo:hi] > best.least
                        if more.any():
                            best.add(value[lo:hi][more], start + at[b[lo:hi][more]])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x)]])


def with_vectors(wanted: DataFrame, vectors: DataFrame, dim: int = 384, marks: np.ndarray | None = None) -> DataFrame:
    """Rows of ``wanted`` (memory_id, ...) with the memory's usable vector, ``packed``; others are left out. ``vectors`` is (memory_id, embedding), unchecked.

    Vectors are sent packed, once, and of copies one is taken; with ``marks`` of the ids wanted hardly any others are sent.
    """
    usable = vectors.where((F.size("embedding") == dim) & F.col("memory_id").isNotNull()).select("memory_id", F.col("embedding").alias("vector"))
    return wanted.join(with_packed(usable, "memory_id", marks), "memory_id").dropDuplicates(wanted.columns)


def each_query(rows: DataFrame, work: Callable, schema: str, first: int = 2) -> DataFrame:
    """What ``work`` makes of each query's rows (query_id, part, memory_id, packed, ...), a query after the other.

    It takes the query's id, the vectors of the ``first`` parts as lists, which have to be few, and an iterator of the other rows' batches, so that these may be many.
    """
    sorted_ = rows.repartition("query_id").sortWithinPartitions("query_id", "part", "memory_id")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, parts = None, []

        def made(rest: pa.RecordBatch | None) -> pa.RecordBatch | None:
            found = work(query, parts, rest)
            return found and pa.RecordBatch.from_arrays(found, names)

        met = True
        for batch in batches:
            ids, kinds = batch.column("query_id").to_pylist(), batch.column("part").to_pylist()
            a = 0
            for b in range(1, len(ids) + 1):
                if b < len(ids) and ids[b] == ids[a] and (kinds[b] == kinds[a] or min(kinds[a], kinds[b]) >= first):
                    continue
                if ids[a] != query:
                    if not met and (x := made(None)):
                        yield x
                    query, parts, met = ids[a], [[] for _ in range(first)], False
                piece = batch.slice(a, b - a)
                if kinds[a] < first:
                    parts[kinds[a]] += zip(piece.column("memory_id").to_pylist(), map(unpacked, piece.column("packed").to_pylist()))
                else:
                    met = True
                    if x := made(piece):
                        yield x
                a = b
        if not met and (x := made(None)):
            yield x

    return sorted_.mapInArrow(run, schema)
