"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are packed into blocks of similar vectors; a block is stored with a list per dimension, sorted by value, and with the range of each dimension. A
query reads all lists of a block in parallel, from the top where its own component is positive and from the bottom where it is negative.
What is seen for the first time is scored in full; the search stops when the threshold (the score of an imaginary vector made of the values the
lists have come to) is below the k-th best score, because nothing unseen can score more than the threshold. Depth grows fourfold from one look to the
next; a block of which more than half has been seen is scored to its end, each row once.

The k-th best score a search starts from is that of the block nearest to its query block. With it, blocks whose first threshold (the best values of
all lists) is below the k-th best of every query of a query block are skipped without being sent; the bounds are computed from the ranges
alone. Bounds help as far as vectors of a block are alike: on clustered vectors most rows are never scored, on independent random ones nearly all are.

Scores are integers; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import settled

PACKED = "n int, dims int, kind string, ids binary, vectors binary, lists binary, low array<long>, high array<long>, middle array<double>"
PIVOTS, NONE = 256, -(1 << 62)


def integer_vectors(rows: DataFrame, scale: int = 64, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(scale * x) with x as double. Rows with a NULL id or vector, or a component that is NULL or not finite, are left out."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(wide, lambda x: F.floor(x * scale).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _dealt(pivots: dict[int, np.ndarray]):
    """Rows with the number of the pivot of their length that is nearest; only the packing depends on it."""

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cells = np.zeros(len(part), dtype=np.int64)
            lengths = part["v"].map(len).to_numpy()
            for dims, centres in pivots.items():
                mine = np.flatnonzero(lengths == dims)
                if len(mine) and dims:
                    rows = np.array(part["v"].iloc[mine].tolist(), dtype=float).reshape(len(mine), dims)
                    cells[mine] = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            yield part.assign(cell=cells)

    return deal


def _pack(rows_per_block: int):
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(dims: int, held: list) -> pd.DataFrame:
            ids = np.array([i for i, _ in held], dtype=np.int64)
            vectors = np.array([v for _, v in held], dtype=np.int64).reshape(len(held), dims)
            # Repeated rows count once.
            _, first = np.unique(np.column_stack([ids, vectors]), axis=0, return_index=True)
            ids, vectors = ids[first], vectors[first]
            kind = np.min_scalar_type(-1 - int(np.abs(vectors).max(initial=0)))
            order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.uint32)
            return pd.DataFrame({
                "n": [len(ids)], "dims": [dims], "kind": [kind.str], "ids": [ids.tobytes()], "vectors": [vectors.astype(kind).tobytes()],
                "lists": [order.tobytes()], "low": [vectors.min(axis=0)], "high": [vectors.max(axis=0)], "middle": [vectors.mean(axis=0)],
            })

        held: dict[int, list] = {}
        for part in parts:
            for i, v in zip(part["vec_id"], part["v"]):
                mine = held.setdefault(len(v), [])
                mine.append((i, v))
                if len(mine) == rows_per_block:
                    yield block(len(v), held.pop(len(v)))
        for dims, mine in held.items():
            yield block(dims, mine)

    return pack


def pivots_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Up to PIVOTS vectors, by hash order of vec_id, as centres for packing alike vectors together; results do not depend on them."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").collect()
    found: dict[int, list] = {}
    for (v,) in rows:
        found.setdefault(len(v), []).append(v)
    return {dims: np.unique(np.array(vs, dtype=float).reshape(len(vs), dims), axis=0) for dims, vs in found.items()}


def pack(vectors: DataFrame, rows_per_block: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of at most `rows_per_block` vectors of one length, those near one pivot next to each other. A pivot near which a large
    share of all vectors lies is divided by id."""
    n = max(1, -(-vectors.count() // rows_per_block))
    dealt = vectors.mapInPandas(_dealt(pivots), "vec_id long, v array<long>, cell long")
    near = dealt.repartitionByRange(n, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    blocks = near.select("vec_id", "v").mapInPandas(_pack(rows_per_block), PACKED)
    return settled(blocks.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def _vectors(data: bytes, kind: str, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(kind)).astype(np.int64).reshape(n, dims)


class Lists:
    """A block of candidates and its sorted lists, one per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T if order is None else order
        self.values = np.take_along_axis(vectors, self.order.T, axis=0).T
        # Exact in double precision as long as sums stay below 2**53; else integers are used.
        top = float(np.abs(vectors.astype(float)).max(initial=0.0))
        self.small = top * max(1.0, top) * vectors.shape[1] < 2**50
        self.doubles = vectors.astype(float) if self.small else None
        self.scored = 0  # rows scored so far, over all queries

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        if self.small and float(np.abs(query).max(initial=0)) < 2**20:
            return (self.doubles[rows] @ query.astype(float)).astype(np.int64)
        return self.vectors[rows] @ query

    def best(self, query_id: int, query: np.ndarray, k: int, floor: int = NONE) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best that score at least `floor`, without the query's own id; all of them if there are fewer."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        up, down = used[query[used] > 0], used[query[used] < 0]
        ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(n, dtype=bool)
        come, depth = 0, min(n, max(2 * k, n // 8) // max(1, len(used)) + 1)
        threshold = int(self.values[up, -1] @ query[up] + self.values[down, 0] @ query[down]) if n else NONE
        while threshold >= floor:
            fresh = np.zeros(n, dtype=bool)
            fresh[self.order[down, come:depth].ravel()] = True
            fresh[self.order[up, n - depth : n - come].ravel()] = True
            fresh &= ~seen
            whole = depth >= n or not len(used) or np.count_nonzero(seen | fresh) > n // 2
            rows = np.flatnonzero(~seen if whole else fresh)
            seen |= fresh
            part = self.scores(rows, query)
            fit = (part >= floor) & (self.ids[rows] != query_id)
            ids, score = np.concatenate([ids, self.ids[rows[fit]]]), np.concatenate([score, part[fit]])
            order = np.lexsort((ids, -score)) if len(ids) <= 4 * k else self._top(ids, score, k)
            ids, score = ids[order], score[order]
            if len(np.unique(ids)) < len(ids):  # one id with several vectors: its best score counts
                first = np.sort(np.unique(ids, return_index=True)[1])
                ids, score = ids[first], score[first]
            ids, score = ids[:k], score[:k]
            if whole:
                break
            if len(ids) == k:
                floor = max(floor, int(score[-1]))
            threshold = int(self.values[up, n - depth] @ query[up] + self.values[down, depth - 1] @ query[down])
            if len(ids) == k and threshold < score[-1]:
                break
            come, depth = depth, min(n, 4 * depth)
        return ids, score

    @staticmethod
    def _top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Positions, in order, of all that may be among the k best distinct ids."""
        cut = np.partition(score, len(score) - k)[len(score) - k]
        while True:
            some = np.flatnonzero(score >= cut)
            if len(some) == len(score) or len(np.unique(ids[some])) >= k:
                return some[np.lexsort((ids[some], -score[some]))]
            lower = score[score < cut]
            cut = np.partition(lower, max(0, len(lower) - k))[max(0, len(lower) - k)]


def _cell(row) -> tuple[Lists, np.ndarray, np.ndarray, np.ndarray]:
    """A row of candidates and queries: lists, ids and vectors of the queries, and the k-th best scores known of them."""
    order = np.frombuffer(row.lists, np.uint32).reshape(row.dims, row.n).astype(np.int64)
    lists = Lists(np.frombuffer(row.ids, np.int64), _vectors(row.vectors, row.kind, row.n, row.dims), order)
    queries = _vectors(row.q_vectors, row.q_kind, row.q_n, row.dims)
    floors = np.frombuffer(row.floors, np.int64) if row.floors is not None else np.full(row.q_n, NONE)
    return lists, np.frombuffer(row.q_ids, np.int64), queries, floors


def _floors(k: int):
    def floors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                lists, names, queries, _ = _cell(row)
                found = [lists.best(int(name), q, k)[1] for name, q in zip(names, queries)]
                least = np.array([f[-1] if len(f) == k else NONE for f in found], dtype=np.int64)
                yield pd.DataFrame({"q_block": [row.q_block], "floors": [least.tobytes()]})

    return floors


def _worth(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of blocks in which some query may find a score that is not below its k-th best."""
    for part in parts:
        kept = []
        for row in part.itertuples(index=False):
            queries = _vectors(row.q_vectors, row.q_kind, row.q_n, row.dims).astype(float)
            bound = np.maximum(queries, 0) @ np.asarray(row.high, float) + np.minimum(queries, 0) @ np.asarray(row.low, float)
            slack = 1e-9 * np.abs(bound) + 1  # of the doubles
            if (bound + slack >= np.frombuffer(row.floors, np.int64)).any():
                kept.append((row.block, row.q_block))
        yield pd.DataFrame(kept, columns=["block", "q_block"])


def _search(k: int):
    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                lists, names, queries, floors = _cell(row)
                found = [(name, *lists.best(int(name), q, k, int(f))) for name, q, f in zip(names, queries, floors)]
                yield pd.DataFrame({
                    "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                    "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found]),
                })

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block_rows: int = 2048, query_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates (vec_id, v) of each query (vec_id, v), its own id left out.

    Both sides hold integer vectors; only vectors of equal length meet. Repeated rows count once; an id with several
    vectors keeps its best score, as candidate and as query. Fewer candidates than k give all; empty tables give no rows.
    """
    pivots = pivots_of(candidates)
    asked = pack(queries, query_rows, pivots)
    blocks = pack(candidates, block_rows, pivots)
    names = {"block": "q_block", "n": "q_n", "kind": "q_kind", "ids": "q_ids", "vectors": "q_vectors"}
    asked = asked.select("dims", "middle", *[F.col(c).alias(n) for c, n in names.items()])
    ranges = blocks.select("block", "dims", "low", "high")

    def bound(middle: str):
        best = F.zip_with(middle, F.arrays_zip("low", "high"), lambda m, r: F.when(m > 0, m * r["high"]).otherwise(m * r["low"]))
        return F.aggregate(best, F.lit(0.0), lambda x, y: x + y)

    block_columns = ("n", "kind", "ids", "vectors", "lists")
    query_columns = ("q_block", "q_n", "q_kind", "q_ids", "q_vectors", "floors")
    # Every query block first meets the block that its middle bounds highest; what it finds there is where all searches start.
    nearest = asked.select("q_block", "dims", "middle").join(ranges, "dims").groupBy("q_block").agg(F.max_by("block", bound("middle")).alias("block"))
    first = nearest.join(blocks, "block").join(asked.drop("dims", "middle"), "q_block").withColumn("floors", F.lit(None).cast("binary"))
    floors = settled(first.select("dims", *block_columns, *query_columns).mapInPandas(_floors(k), "q_block long, floors binary"), "floors")
    known = settled(asked.drop("middle").join(floors, "q_block"), "query-blocks")
    pairs = known.join(ranges, "dims").select("block", "q_block", "dims", "q_n", "q_kind", "q_vectors", "low", "high", "floors")
    worth = settled(pairs.mapInPandas(_worth, "block long, q_block long"), "block-pairs")
    cells = worth.join(blocks, "block").join(known.drop("dims"), "q_block").select("dims", *block_columns, *query_columns)
    found = cells.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
