"""Cutting byte spans out of texts, for the operators that find repeated passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = "n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, n_repeated long, repeated array<struct<start:int,end:int>>, kept_sha256 string, kept binary"


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what a worker makes of one is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def document_key(id_: Column, text: Column) -> list[Column]:
    """Two hashes, k1 and k2, that tell rows apart by id and text; equal rows are one document."""
    return [F.xxhash64(text, id_).alias("k1"), F.xxhash64(id_, text, F.lit(7)).alias("k2")]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of the merged spans lies outside of the others, merged too."""
    out, i = [], 0
    for a, b in spans:
        while i < len(others) and others[i][1] <= a:
            i += 1
        j = i
        while j < len(others) and others[j][0] < b:
            if a < others[j][0]:
                out.append((a, others[j][0]))
            a, j = max(a, others[j][1]), j + 1
        if a < b:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the merged spans."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def without_spans(keyed: DataFrame, found: DataFrame, *, keep_bytes: bool, passage: int = 0) -> DataFrame:
    """For each row of keyed(id, k1, k2, text) its id and the columns of OUT.

    found(k1, k2, spans) has arrays of (start, end, drop) in bytes. Overlapping and touching spans
    are joined, and those of under `passage` bytes go: all of them give `repeated`, those with drop
    give `spans`, which are cut out but for bytes that those where drop is false hold. Where it is null, they are
    reported only. `kept` is null unless keep_bytes.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pairs, pa.int64(), pairs, pa.string(), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "spans", "n_repeated", "repeated", "kept_sha256", "kept"]
        for batch in small(batches):
            rows = []
            found_here = batch.column(2).flatten()
            start, end, drop = (found_here.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(3))
            upto = np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            for text, a, b in zip(batch.column(1), [0, *upto], upto, strict=False):
                raw = text.as_py() or b""
                spans = list(zip(start[a:b], end[a:b], drop[a:b], strict=True))
                every = [x for x in merged([x[:2] for x in spans]) if x[1] - x[0] >= passage]
                runs = [x for x in merged([x[:2] for x in spans if x[2]]) if x[1] - x[0] >= passage]
                runs = without(runs, merged([x[:2] for x in spans if x[2] is False]))
                kept = cut(raw, runs)
                dicts = [[{"start": a, "end": b} for a, b in x] for x in (runs, every)]
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), dicts[0], sum(b - a for a, b in every), dicts[1], hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            made = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.record_batch([batch.column(0), *(pa.array(m, type=k) for m, k in zip(made, kinds, strict=True))], names=["id", *names])

    joined = keyed.join(found, ["k1", "k2"], "left").select("id", F.col("text").cast("binary").alias("text"), "spans")
    return joined.mapInArrow(apply, f"id {dict(keyed.dtypes)['id']}, {OUT}")
