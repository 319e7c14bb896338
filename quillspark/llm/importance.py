"""Resampling towards a target distribution: hashed n-gram features, counted by sorting packed streams of buckets.

Features become unsigned 16-bit bucket numbers, which are written packed, many documents to a row, with
the documents' offsets. To count, a row's stream is sorted and run-length encoded; to weigh, each
number fetches its bucket's gain and np.add.reduceat sums these between the offsets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import small_batches, staged

#: Buckets of features; a bucket's number has to fit in 16 bits.
BUCKETS = 10_000
#: Features in a packed row (a document is never split, so a longer one has a row of its own).
STREAM = 1 << 20
#: Rows of documents that a Python worker gets at once; words of a text whose checksums are held at once.
ROWS, SLICE = 200, 1 << 15

_PACKED = "ids binary, known binary, words binary, ends binary, stream binary"
#: A-Z in lower case, all that is no part of a word as a space; bytes over 127 are parts of letters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def features(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the buckets of all runs of one to three words, as unsigned 16-bit numbers."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    parts = [np.zeros(0, dtype=np.uint16)]
    for at in range(0, len(words), SLICE):
        here = words[at : at + SLICE + 2]
        following = [b" " + w for w in here[1:]]
        one = list(map(zlib.crc32, here[:SLICE]))
        two = list(map(zlib.crc32, following, one))  # a checksum goes on where that of the first word ended
        three = list(map(zlib.crc32, following[1:], two))
        codes = np.fromiter(one + two + three, dtype=np.uint32, count=len(one) + len(two) + len(three))
        parts.append((codes % np.uint32(buckets)).astype(np.uint16))
    return len(words), np.concatenate(parts)


def _pack(buckets: int, stream: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        words: list[int] = []
        parts: list[np.ndarray] = []
        n = 0

        def row() -> pd.DataFrame:
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            return pd.DataFrame({"ids": [np.array([i or 0 for i in ids], dtype=np.int64).tobytes()], "known": [np.array([i is not None for i in ids], dtype=np.uint8).tobytes()], "words": [np.array(words, dtype=np.int64).tobytes()], "ends": [ends.tobytes()], "stream": [np.concatenate(parts).tobytes()]})

        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                n_words, part = features(text or "", buckets)
                if parts and n + len(part) > stream:
                    yield row()
                    ids, words, parts, n = [], [], [], 0
                ids.append(None if pd.isna(id_) else int(id_))
                words.append(n_words)
                parts.append(part)
                n += len(part)
        if parts:
            yield row()

    return pack


def run_lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, n) by sorting each row's stream; runs of equal numbers are counts."""
    for batch in batches:
        for raw in batch["stream"]:
            sorted_ = np.sort(np.frombuffer(raw, dtype=np.uint16), kind="stable")  # a radix sort for 16 bits
            first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, int)
            yield pd.DataFrame({"bucket": sorted_[first].astype(np.int32), "n": np.diff(np.append(first, len(sorted_)))})


def packed_features(df: DataFrame, *, id_col: str | None, text: str = "text", buckets: int = BUCKETS, stream: int = STREAM) -> DataFrame:
    """df's features as packed rows in the shared folder: (ids, known, words, ends, stream)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")
    id_ = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = df.select(id_.alias("id"), F.col(text).alias("text"))
    with small_batches(df.sparkSession, ROWS):
        return staged(rows.mapInPandas(_pack(buckets, stream), _PACKED), "features")


def bucket_counts(packed: DataFrame) -> dict[int, int]:
    """Features in each bucket; at most 65,536 rows reach the driver, whatever the input is."""
    with small_batches(packed.sparkSession, 16):
        return {r["bucket"]: r["n"] for r in packed.select("stream").mapInPandas(run_lengths, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((raw.get(b, 0) + 1.0) * t))) for b in range(buckets)], dtype=np.int64)


def _weigh(gains: np.ndarray):
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                words, ends = np.frombuffer(b.words, dtype=np.int64), np.frombuffer(b.ends, dtype=np.int64)
                starts = np.append(0, ends[:-1])
                n = ends - starts
                weights = np.zeros(len(n), dtype=np.int64)
                if (full := n > 0).any():  # reduceat takes no empty ranges
                    weights[full] = np.add.reduceat(gains[np.frombuffer(b.stream, dtype=np.uint16)], starts[full])
                yield pd.DataFrame({"id": pd.arrays.IntegerArray(np.frombuffer(b.ids, dtype=np.int64).copy(), np.frombuffer(b.known, dtype=np.uint8) == 0), "n_words": words, "n_features": n, "weight": weights})

    return weigh


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every document, percent of those with least_words drawn.

    score is the weight with Gumbel noise from the id, so the draw is one without replacement with chances
    in proportion to exp(weight / 1000). Words are runs of ASCII letters and digits and other characters
    beyond ASCII, A-Z in lower case. Null and empty texts have no features and a weight of 0. Repeated
    rows are documents of their own; with one id and text they have one score. A null id counts as an empty one
    in the noise and comes last in ties. Without documents the result is empty; without target texts
    t and T are 0. Other columns are ignored.
    """
    packed = packed_features(docs, id_col=id_col, text=text, buckets=buckets)
    wanted = packed_features(target, id_col=None, text=text, buckets=buckets)
    gains = bucket_gains(bucket_counts(packed), bucket_counts(wanted), buckets)
    with small_batches(docs.sparkSession, 16):
        weighed = packed.mapInPandas(_weigh(gains), "id long, n_words long, n_features long, weight long")
        noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
        scored = staged(weighed.withColumn("score", F.col("weight") + gumbel), "scored")
    return _drawn(scored, percent, least_words).withColumnRenamed("id", id_col)


def _drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored with rank: rows are dealt in ranges of the order of drawing, so a row's place is its range's offset and
    its place there; what the driver reads is one count for each range."""
    spark = scored.sparkSession
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count() * percent // 100
    order = [F.col("late"), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.xxhash64("id", "weight")]
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = scored.withColumn("late", (~enough).cast("int"))
    dealt = ordered.repartitionByRange(shuffle, *order).sortWithinPartitions(*order)
    placed = staged(dealt.select("*", F.monotonically_increasing_id().alias("at")), "ranked")
    counts = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    table = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))  # one row for each range
    joined = placed.withColumn("part", F.shiftright("at", 33)).join(table, "part", "left")
    place = F.col("before") + F.col("at") - F.shiftleft(F.col("part"), 33) + 1
    return joined.select("id", "n_words", "n_features", "weight", "score", F.when((F.col("late") == 0) & (place <= n), place).alias("rank"))
