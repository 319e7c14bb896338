"""Substring dedup by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import staged
from quillspark.llm.spans import document_key, small, without_spans

#: The gear hash sees WINDOW bytes. In every SPAN places in a row the one of least hash is a cut, so cuts
#: depend on the bytes near them alone, lie at most SPAN bytes apart and about (SPAN + 1) / 2 on average.
WINDOW, SPAN = 16, 48
MOST = SPAN + WINDOW
#: A repeated passage has so many bytes.
PASSAGE = 128
#: Passages that make up more than a PARTS-th of all, and PART or more, are dealt to tasks in parts, so there are fewer than PARTS of them.
PARTS, PART = 10_000, 1000


def gear_table(seed: int = 20240607) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, size=256, dtype=np.uint32)


GEAR = gear_table()


def cuts(raw: bytes, block: int = 1 << 18) -> np.ndarray:
    """Places whose WINDOW bytes have the least gear hash (the last of equal ones) of some SPAN places, in blocks of bounded memory."""
    found, last = [], len(raw) - WINDOW - SPAN + 1
    for at in range(0, last + 1, block):
        n = min(block, last + 1 - at)
        h = GEAR[np.frombuffer(raw, dtype=np.uint8, count=n + SPAN + WINDOW - 2, offset=at)]
        width = 1
        while width < WINDOW:  # the recurrence h = 2 h + gear[byte] over the window, by doubling
            longer = h.copy()
            longer[width:] += h[:-width] << np.uint32(width)
            h, width = longer, 2 * width
        h = h[WINDOW - 1 :].astype(np.uint64) << np.uint64(32) | np.arange(len(h) - WINDOW, -1, -1, dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:  # least of the next places, by doubling
            h, width = np.minimum(h[:-width], h[width:]), 2 * width
        h = np.minimum(h[:n], h[SPAN - width :][:n])
        h = h[np.flatnonzero(np.diff(h, prepend=~h[:1]))]
        found.append((at + n + SPAN - 2) - (h & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def chunk_ends(raw: bytes) -> list[int]:
    """Where the chunks of some bytes end; the last end is their length."""
    return [*(x for x in cuts(raw).tolist() if x), len(raw)] if raw else []


def passages(raw: bytes, least: int = PASSAGE) -> list[tuple[int, int]]:
    """(start, end) from each cut, and the text's start, to the first end of a cut's window, or the text's, that makes `least`
    bytes or more; and the last of these starts to the text's end."""
    n = len(raw)
    if n < least or not n:
        return []
    at = cuts(raw)
    starts, ends = np.concatenate([[0], at[at > 0]]), np.append(at[at < n - WINDOW] + WINDOW, n)
    starts = starts[starts <= n - least]
    found = list(zip(starts.tolist(), ends[np.searchsorted(ends, starts + least)].tolist(), strict=True))
    return found if found[-1][1] == n else [*found, (found[-1][0], n)]


def chunk_rows(batches: Iterator[pa.RecordBatch], least: int = PASSAGE) -> Iterator[pa.RecordBatch]:
    """From batches (k1, k2, text) a row for each of passages(): k1, k2, digest, start, end, and whether it occurs earlier in its text."""
    for batch in small(batches):
        digests, starts, stops, later, counts = [], [], [], [], []
        for text in batch.column(2):
            raw = text.as_py() or b""
            found = passages(raw, least)
            own = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in found]
            digests += own
            first = dict(zip(reversed(own), range(len(own) - 1, -1, -1), strict=True))
            later += [first[d] != i for i, d in enumerate(own)]
            starts += [a for a, _ in found]
            stops += [b for _, b in found]
            counts.append(len(found))
        of = pa.array(np.repeat(np.arange(len(counts)), counts))
        yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(later, pa.bool_())], names=["k1", "k2", "digest", "start", "end", "later"])


def repeated_chunks(keyed: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(k1, k2, spans) from keyed(k1, k2, text), for texts with any: the passages() that occur more
    than once, as an array of (start, end, drop), drop being false at the first occurrence.

    They are compared by digest. The first occurrence is that of the document of least k1, there
    the least start. Digests are counted by an aggregation (combined before the shuffle); only those
    that occur twice are joined back, to those made anew from the texts. Of these, digests of over a
    PARTS-th of all occurrences are joined in parts by document. What is gathered for a document is bounded by its text.
    """
    chunks = keyed.select("k1", "k2", F.col("text").cast("binary").alias("text")).mapInArrow(lambda batches: chunk_rows(batches, passage), "k1 long, k2 long, digest long, start int, end int, later boolean")
    counted = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min("k1").alias("least"))
    twice = staged(counted.where("n > 1"), "twice")
    part = max(PART, (twice.agg(F.sum("n")).first()[0] or 0) // PARTS)
    hot = staged(twice.where(F.col("n") > part).select("digest", F.ceil(F.col("n") / part).cast("int").alias("parts")), "hot")
    here = F.coalesce(F.pmod(F.xxhash64("k1"), F.col("parts")), F.lit(0)).cast("int")
    dealt = chunks.join(F.broadcast(hot), "digest", "left").withColumn("part", here).drop("parts")
    wanted = twice.join(F.broadcast(hot), "digest", "left").select("digest", "least", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    hits = dealt.join(wanted, ["digest", "part"]).select("k1", "k2", F.struct("start", "end", (F.col("later") | (F.col("k1") != F.col("least"))).alias("drop")).alias("c"))
    return hits.groupBy("k1", "k2").agg(F.collect_set("c").alias("spans"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, keep_bytes: bool = True) -> DataFrame:
    """A row for every row of docs: id, n_bytes, n_removed, n_spans, spans, n_repeated, repeated,
    kept_sha256, kept.

    Cuts are content-defined: an insertion shifts them only near itself. Every cut begins a string of
    `passage` bytes or more that ends by a cut; strings that occur more than once (also in one text)
    are `repeated`, and their bytes outside of first occurrences are removed (`spans`).
    repeated_chunks() says which occurrence is the first. A passage that two texts share has the same
    cuts in both, the first and the last at most SPAN - 1 bytes from its ends; so one of
    passage + 2 * (SPAN - 1) bytes or more is never missed, whatever surrounds it.
    Rows equal in id and text are one document: they count as copies for
    `repeated`, but share what is removed. Spans are in bytes of UTF-8, end exclusive. Null and empty
    texts have no chunks. Texts of any length are read whole; other columns are not read.
    """
    keyed = docs.select(F.col(id_col).alias("id"), *document_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    return without_spans(keyed, repeated_chunks(keyed, passage), keep_bytes=keep_bytes, passage=passage)
