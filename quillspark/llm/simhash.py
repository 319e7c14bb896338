"""SimHash near-dedup by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import own_name, staged
from quillspark.llm.components import connected_components

BITS = 64
#: Blocks beyond the radius: any two close fingerprints agree on so many blocks, which form a key.
SPARE = 3
#: Buckets of more fingerprints than this are linked through shared midpoints instead of pairs.
PAIRWISE = 32


def simhash(text: str | None, shingle_words: int) -> int:
    """The unsigned 64-bit fingerprint of a text; see fingerprints()."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle_words + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[:n].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=n)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle_words: int) -> Column:
    """The fingerprint as a signed long.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased; shingles are
    shingle_words words in a row, joined by a space, with repeats. A bit is 1 if set in over half of
    the shingles' XXH64 (UTF-8, seed 42). A text of fewer words is one shingle; one without words,
    like null, has fingerprint 0.
    """

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            got = np.fromiter((simhash(t, shingle_words) for t in s), dtype=np.uint64, count=len(s))
            yield pd.Series(got.view(np.int64))

    return of(text)


def _block_masks(radius: int) -> list[int]:
    """Masks of which two fingerprints within the radius agree under at least one.

    The bits are split into radius + SPARE blocks; differing bits touch at most radius of them, so
    the remaining SPARE or more agree.
    """
    n = radius + SPARE
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, SPARE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(prints: DataFrame, radius: int, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints of prints(fp) as all close pairs do.

    Pigeonhole blocks: every fingerprint gets a key for each choice of SPARE blocks, fingerprints
    are joined on the key, and pairs within the radius (0 to 2) are verified. A bucket of more than
    pairwise fingerprints isn't paired: its members are grouped by the fingerprints one bit or none
    from them. Two fingerprints are within 2 bits exactly if they share such a midpoint, and at
    most 65 can share one, so this is exact and linear in the bucket; each member is linked to the
    smallest of its group. (For radius 1 or 0 such groups are verified in pairs.)
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    keys = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(_block_masks(radius))))).alias("b")).select("fp", "b.c", "b.k")
    sizes = staged(keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    small = keys.join(sizes.where(F.col("n") <= pairwise).select("c", "k"), ["c", "k"])
    a, b = small.withColumnRenamed("fp", "u"), small.withColumnRenamed("fp", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = a.join(b, ["c", "k"]).where((F.col("u") > F.col("v")) & near).select("u", "v")
    large = keys.join(sizes.where(F.col("n") > pairwise).select("c", "k"), ["c", "k"]).select("fp").distinct()
    flips = [0, *(1 << i for i in range(BITS))]
    middle = large.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(x))) for x in flips))).alias("mid"))
    groups = middle.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if radius == 2:
        stars = groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v")
    else:
        stars = groups.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v")).where((F.col("u") > F.col("v")) & near)
    return pairs.union(stars).distinct()


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 2) -> DataFrame:
    """(id, fp, component) for every row of docs: fp as a signed long, component the smallest id
    reachable through fingerprints that differ in at most radius bits.

    Equal fingerprints are one node, so copies cost nothing beyond an aggregation. Null and empty
    texts have fingerprint 0 and are linked like any other. A null id counts only where its group
    has no other; repeated rows are kept. Other columns are not read.
    """
    rows = staged(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle_words).alias("fp")), "prints")
    prints = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = connected_components(close_links(prints.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 2) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id.

    Groups are those of near_duplicate_groups(). Rows that share the smallest id and its
    fingerprint count as one document. Columns stay as they are.
    """
    groups = near_duplicate_groups(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, radius=radius)
    first = groups.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("component").agg(F.min("fp").alias("fp"))
    name = own_name(docs, "fp")
    marked = docs.withColumn(name, fingerprint(F.col(text_col), shingle_words))
    kept = marked.join(first, marked[id_col].eqNullSafe(first["component"]) & (marked[name] == first["fp"]), "left_semi")
    return kept.dropDuplicates([id_col, name]).select(*docs.columns)
