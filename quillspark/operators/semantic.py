"""Latent semantic vectors: the leading singular vectors of the TF-IDF matrix by distributed subspace iteration.

A document's weights are one sparse row. A pass multiplies the rows with a matrix of terms by directions and back;
tasks sum the products over their rows, in blocks of terms. That matrix has at most MOST_NUMBERS entries, whatever
the number of documents; between passes the driver makes its columns orthonormal, and after the last solves
the small eigenproblem of the directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.hashing import md5_bucket
from quillspark.sources import writers

#: Most entries of the matrix of terms by directions, which is sent to tasks (8 bytes each); terms in a row of partial sums.
MOST_NUMBERS, BLOCK_TERMS = 16_000_000, 512
#: Further directions than those wanted, and passes over the rows.
OVERSAMPLE, PASSES = 10, 4


def sparse_rows(weights: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, idx, w): a document's terms by number and their weights, from long weights(id, term, w) and a vocabulary(term, idx)."""
    numbered = weights.join(F.broadcast(vocab.select("term", "idx")), "term")  # at most the vocabulary's max_features rows
    packed = numbered.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("w").cast("double").alias("w")))).alias("t"))
    return packed.select(id_col, F.transform("t", lambda s: s["idx"]).alias("idx"), F.transform("t", lambda s: s["w"]).alias("w"))


def _flat(idx: pd.Series, w: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all entries of a batch."""
    sizes = np.array([len(x) for x in idx], dtype=np.int64)
    empty = not sizes.sum()
    return np.repeat(np.arange(len(sizes)), sizes), np.zeros(0, np.int64) if empty else np.concatenate(list(idx)).astype(np.int64), np.zeros(0) if empty else np.concatenate(list(w))


def project(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, directions: np.ndarray) -> np.ndarray:
    """The product of a batch's n sparse rows with the directions."""
    row, term, w = rows
    out = np.zeros((n, directions.shape[1]))
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(w[:, None] * directions[term], first)
    return out


@dataclass(frozen=True)
class SemanticModel:
    """directions (terms by size) and the singular values that belong to them, largest first."""

    directions: np.ndarray
    values: np.ndarray

    def embed(self, rows: DataFrame, id_col: str, unit: bool = True) -> DataFrame:
        """(id, vector): each sparse row in the directions, at unit length if asked; zeros for a row without terms."""
        directions = self.directions

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                y = project(_flat(b["idx"], b["w"]), len(b), directions)
                if unit:
                    norm = np.linalg.norm(y, axis=1, keepdims=True)
                    y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)
                yield pd.DataFrame({id_col: b[id_col], "vector": list(y)})

        kind = rows.schema[id_col].dataType.simpleString()
        return rows.select(id_col, "idx", "w").mapInPandas(run, f"`{id_col}` {kind}, vector array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, v.tolist()) for i, v in enumerate(self.directions)] + [(-1, self.values.tolist())]
        spark.createDataFrame(rows, "idx int, vector array<double>").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SemanticModel:
        rows = sorted((r["idx"], r["vector"]) for r in spark.read.parquet(path).collect())  # bounded by MOST_NUMBERS
        return SemanticModel(np.array([v for i, v in rows if i >= 0]), np.array(rows[0][1]))


def _product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times q, in one pass over the rows."""
    n_terms, m = q.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((n_terms, m)), np.zeros(n_terms, dtype=bool)
        for b in batches:
            row, term, w = _flat(b["idx"], b["w"])
            if not len(term):
                continue
            y = project((row, term, w), len(b), q)
            by = np.argsort(term, kind="stable")
            term, row, w = term[by], row[by], w[by]
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            total[term[first]] += np.add.reduceat(w[:, None] * y[row], first)
            seen[term[first]] = True
        for a in range(0, n_terms, BLOCK_TERMS):
            if seen[a : a + BLOCK_TERMS].any():
                yield pd.DataFrame({"block": [a], "sums": [total[a : a + BLOCK_TERMS].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = None, None
        for b in batches:
            for block, raw in zip(b["block"], b["sums"], strict=True):
                part = np.frombuffer(raw)
                if block != held:
                    if held is not None:
                        yield pd.DataFrame({"block": [held], "sums": [sums.tobytes()]})
                    held, sums = block, part.copy()
                else:
                    sums += part
        if held is not None:
            yield pd.DataFrame({"block": [held], "sums": [sums.tobytes()]})

    kind = "block int, sums binary"
    out = np.zeros((n_terms, m))
    for r in rows.select("idx", "w").mapInPandas(partial, kind).repartition("block").sortWithinPartitions("block").mapInPandas(add, kind).collect():
        out[r["block"] : r["block"] + BLOCK_TERMS] = np.frombuffer(r["sums"]).reshape(-1, m)
    return out


def fit(rows: DataFrame, n_terms: int, size: int = 64, passes: int = PASSES, seed: int = 7) -> SemanticModel:
    """The model of staged sparse rows(idx, w); fewer directions where there are fewer terms. Deterministic but for
    the order in which sums are added."""
    m = min(n_terms, size + OVERSAMPLE)
    if n_terms * m > MOST_NUMBERS:
        raise ValueError(f"{n_terms} terms by {m} directions are over {MOST_NUMBERS} numbers; take fewer features")
    if n_terms == 0:
        return SemanticModel(np.zeros((0, 0)), np.zeros(0))
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, m)))
    for _ in range(passes):
        q, _ = np.linalg.qr(_product(rows, q))
    small = q.T @ _product(rows, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:size]
    directions = q @ vectors[:, best]
    sign = np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(best))] < 0, -1.0, 1.0)
    return SemanticModel(directions * sign, np.sqrt(np.maximum(values[best], 0)))


def embed_by_bucket(model: SemanticModel, rows: DataFrame, id_col: str, path: str, buckets: int = 16) -> int:
    """Vectors under path in parts by the md5 of their id; parts that a former run finished stay. The number of parts written."""
    made = 0
    for b in range(buckets):
        part = rows.where(md5_bucket(F.coalesce(F.col(id_col).cast("string"), F.lit("")), buckets) == b)
        made += writers.part_once(model.embed(part, id_col), path, f"bucket{b:03}")
    return made
