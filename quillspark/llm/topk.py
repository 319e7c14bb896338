"""Exact top-k search by inner product: sorted lists read in order, with bounds on what is still unread.

Rows are packed into blocks. In a block every component is a sorted list, which a query reads from
its end of the larger products. What has been read to a depth gives each row a least and a greatest
score, for all queries of a batch by matrix products of the lists as read so far (a value not yet
read counts as the list's value at that depth for the upper bound, as its far end for the lower
one). A query stops where hardly more rows can still qualify than it wants; these are then scored
exactly. Lists that are read to their ends give exact scores, so nothing depends on where it stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import own_name, small_batches, staged

#: Bytes of vectors in a block of candidates, and in a slab of queries that meets it at once.
BLOCK_BYTES, SLAB_BYTES = 8 << 20, 8 << 20
#: Queries whose bounds are computed at once.
BATCH = 64
#: Shares of the lists that are read, one after another.
DEPTHS = (0.125, 0.25, 0.5, 1.0)
#: A query stops reading where so many times the rows wanted can still qualify.
SURVIVORS = 8
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

_PACKED = "block long, dim int, ids binary, known binary, asks binary, vectors binary"
_ASKED = "block long, place int, id long, floor double, vector binary"


def _matrix(raw: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(rows, dim)


def _pack(scale: float, block_bytes: int):
    """Rows (id, vector, ask) to blocks of whole-number vectors; rows of other lengths begin another block."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}
        made = 0

        def full(dim: int) -> pd.DataFrame:
            nonlocal made
            ids, asks, vectors = zip(*held.pop(dim), strict=True)
            made += 1
            return pd.DataFrame({"block": [first + made], "dim": [dim], "ids": [np.array([i or 0 for i in ids], dtype=np.int64).tobytes()], "known": [np.array([i is not None for i in ids], dtype=np.uint8).tobytes()], "asks": [np.array(asks, dtype=np.uint8).tobytes()], "vectors": [np.concatenate(vectors).tobytes() if dim else b""]})

        for batch in batches:
            for id_, ask, vector in zip(batch["id"], batch["ask"], batch["vector"], strict=True):
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(np.asarray(vector, dtype=np.float64) * scale)
                if not np.isfinite(v).all():
                    continue
                rows = held.setdefault(len(v), [])
                rows.append((None if pd.isna(id_) else int(id_), bool(ask), v))
                if len(rows) * max(8, v.nbytes) >= block_bytes:
                    yield full(len(v))
        for dim in list(held):
            yield full(dim)

    return pack


def _ids(ids: bytes, known: bytes) -> list:
    return [i if k else None for i, k in zip(np.frombuffer(ids, dtype=np.int64).tolist(), known, strict=True)]


def _exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; those beyond a long are its nearest end."""
    if rows.shape[1] * np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) < EXACT:
        return (rows @ query).astype(np.int64)
    whole = [int(x) for x in query]
    sums = [sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in rows]
    return np.array([min(LONG, max(-LONG - 1, s)) for s in sums], dtype=np.int64)


def qualifying(block: np.ndarray, queries: np.ndarray, floors: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) for each query: rows of the block that may be among its k best.

    floors are scores that k rows elsewhere reach; own is a query's own row, or -1.
    """
    n, dim = block.shape
    lists = np.sort(block, axis=0)
    least, most = lists[0], lists[-1]
    for start in range(0, len(queries), BATCH):
        left = np.arange(start, min(start + BATCH, len(queries)))
        for share in DEPTHS:
            depth = max(1, int(n * share))
            high, low = lists[n - depth], lists[depth - 1]  # where reading from either end stands
            up, down = np.maximum(queries[left], 0).T, np.minimum(queries[left], 0).T
            from_top, from_bottom = block >= high, block <= low
            upper = np.maximum(block, high) @ up + np.minimum(block, low) @ down
            lower = np.where(from_top, block, least) @ up + np.where(from_bottom, block, most) @ down
            slack = np.abs(block).max(initial=0) * np.abs(queries[left]).max(initial=0) * dim
            if slack >= EXACT:
                upper += slack * (dim + 2) * 2.0**-50
                lower -= slack * (dim + 2) * 2.0**-50
            mine = np.flatnonzero(own[left] >= 0)
            upper[own[left][mine], mine] = lower[own[left][mine], mine] = -np.inf
            bar = floors[left]
            if n > k:
                bar = np.maximum(bar, np.partition(lower, n - k, axis=0)[n - k])
            live = upper >= bar
            live[own[left][mine], mine] = False
            done = (live.sum(axis=0) <= SURVIVORS * k) | (share == 1)
            for j in np.flatnonzero(done):
                rows = np.flatnonzero(live[:, j])
                yield int(left[j]), rows, _exact(block[rows], queries[left[j]])
            left = left[~done]
            if not len(left):
                break


def _best(rows: np.ndarray, scores: np.ndarray, ids: list, k: int) -> list[int]:
    """Places in rows of the k best: by score, then smaller id (null last), then place."""
    return sorted(range(len(rows)), key=lambda i: (-int(scores[i]), ids[rows[i]] is None, ids[rows[i]] or 0, int(rows[i])))[:k]


def _ask(k: int):
    """Queries of each block with the k-th best score of their own block."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                ids, places = _ids(b.ids, b.known), np.flatnonzero(np.frombuffer(b.asks, dtype=np.uint8))
                if not len(places):
                    continue
                block = _matrix(b.vectors, b.dim, len(ids))
                asked = block[places]
                floors = np.full(len(places), -np.inf)
                for q, rows, scores in qualifying(block, asked, floors.copy(), places, k):
                    if len(rows) >= k:
                        floors[q] = float(np.nextafter(float(np.partition(scores, len(scores) - k)[len(scores) - k]), -np.inf))
                yield pd.DataFrame({"block": b.block, "place": places.astype(np.int32), "id": [ids[p] for p in places], "floor": floors, "vector": [v.tobytes() for v in asked]})

    return ask


def _meet(k: int):
    """The k best rows of a slab's blocks for each of its queries."""

    def meet(key: tuple, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        width = asked["vector"].map(len)
        for b in blocks.itertuples():
            ids = _ids(b.ids, b.known)
            block = _matrix(b.vectors, b.dim, len(ids))
            for size, same in asked.groupby(width):
                dim = max(b.dim, size // 8)  # a component that one side lacks counts as 0
                queries = np.zeros((len(same), dim))
                queries[:, : size // 8] = np.vstack([np.frombuffer(v, dtype=np.float64) for v in same["vector"]])
                wide = block if dim == b.dim else np.hstack([block, np.zeros((len(ids), dim - b.dim))])
                own = np.where(same["block"] == b.block, same["place"], -1).astype(np.int64)
                of, place, id_ = same["block"].to_numpy(), same["place"].to_numpy(), same["id"].to_numpy()
                for q, rows, scores in qualifying(wide, queries, same["floor"].to_numpy(dtype=float), own, k):
                    for i in _best(rows, scores, ids, k):
                        out.append((of[q], place[q], id_[q], ids[rows[i]], int(scores[i]), b.block, int(rows[i])))
        made = pd.DataFrame(out, columns=["of", "place", "query_id", "vec_id", "score", "block", "row"])
        return made.astype({"vec_id": "Int64"})

    return meet


def top_k(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", queries: Column | None = None, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query, itself left out.

    A component x is floor(scale * x); scores are exact, those beyond a long being its nearest end. Ties
    go to the smaller id (null last). queries tells which rows ask (those whose id is divisible by 100).
    Vectors that are null or empty of meaning (a null or non-finite component, also after scaling) take
    no part; of two lengths, the shorter counts as 0 where it ends. Rows with a null id are found, but
    don't ask. Repeated ids are rows of their own: each asks, and finds the others. Other columns are
    ignored. An empty table gives an empty one.

    Queries meet all blocks in slabs: a slab of queries and a block of candidates of at most SLAB_BYTES and
    BLOCK_BYTES or so meet in a task, so neither side is held or sent whole.
    """
    spark = df.sparkSession
    x, id_ = F.col(vector), F.col(id_col)
    asks = F.coalesce(queries if queries is not None else F.pmod(id_, F.lit(100)) == 0, F.lit(False)) & id_.isNotNull()
    usable = x.isNotNull() & ~F.coalesce(F.exists(x, lambda e: e.isNull()), F.lit(False))
    rows = df.where(usable).select(id_.cast("long").alias("id"), asks.alias("ask"), x.cast("array<double>").alias("vector"))
    packed = staged(rows.mapInPandas(_pack(scale, BLOCK_BYTES), _PACKED), "blocks")
    with small_batches(spark, 4):
        asked = staged(packed.mapInPandas(_ask(k), _ASKED), "asked")
    n_blocks = packed.count()
    size = asked.agg(F.sum(F.octet_length("vector") + 64).alias("b")).first()["b"] or 0
    slabs = max(1, -(-size // SLAB_BYTES))
    spread = asked.select("*", F.pmod(F.xxhash64("block", "place"), F.lit(slabs)).cast("long").alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(max(1, n_blocks) - 1))).alias("cell"))
    placed = packed.drop("asks").select("*", F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks))).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"))
    found = spread.groupBy("slab", "cell").cogroup(placed.groupBy("slab", "cell")).applyInPandas(_meet(k), "of long, place int, query_id long, vec_id long, score long, block long, row int")
    rank = own_name(found, "rank")
    order = Window.partitionBy("of", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "block", "row")
    best = found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)
    return best.select("query_id", F.col(rank).alias("rank"), "vec_id", "score")
