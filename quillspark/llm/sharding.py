"""Sharding by a k-d tree over document metadata."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._common import own_name, staged

#: A key along a dimension: its value in VALUE_BITS bits, then TIE_BITS bits that order equal values.
VALUE_BITS, TIE_BITS, STEP_BITS = 12, 20, 16


BROADCAST_ROWS = 100_000


def with_metadata(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: Sequence[str] = ("source", "lang")) -> tuple[DataFrame, list[str]]:
    """docs with columns of doubles to cut along, and their names: the log of the text's bytes, its bytes a character,
    the id's value (0 for a text) and, for source and language, the mean log of their documents' bytes.

    So sources are in an order, those of short documents first. Null texts count as empty, null
    sources as one source. Means are joined by a broadcast up to BROADCAST_ROWS of them.
    """
    held = own_name(docs, "meta")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.log2(F.octet_length(text) + F.lit(1.0))
    out = docs.withColumns({f"{held}0": size, f"{held}1": F.octet_length(text) / F.greatest(F.char_length(text), F.lit(1)), f"{held}2": F.coalesce(F.expr(f"try_cast(`{id_col}` AS double)"), F.lit(0.0))})
    for i, c in enumerate(groups):
        # Sums of whole numbers, so that the mean is the same however rows are dealt.
        means = staged(docs.groupBy(F.col(c).alias(f"{held}of{i}")).agg((F.sum(F.round(size * 4096).cast("long")) / F.count("*")).alias(f"{held}{i + 3}")), "means")
        means = F.broadcast(means) if means.count() <= BROADCAST_ROWS else means
        out = out.join(means, out[c].eqNullSafe(means[f"{held}of{i}"]), "left").drop(f"{held}of{i}")
    return out, [f"{held}{i}" for i in range(3 + len(groups))]


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def kd_shards(
    docs: DataFrame,
    *,
    size: Column,
    tie: Column,
    dimensions: Sequence[Column],
    target_bytes: int | None = None,
    shards: int | None = None,
    size_name: str = "size",
    shard_name: str = "shard",
    drop: Sequence[str] = (),
) -> DataFrame:
    """docs without the columns of drop, with size (long) and shard (int, from 0), of near equal sizes.

    A k-d tree: the whole is to be cut into ceil(total / target_bytes) leaves (or as many as shards
    says). A node of k leaves is cut along the dimension in which its documents spread widest, at
    the weighted quantile k // 2 / k (the median for even k), until each node is one leaf. Quantiles
    are found for all nodes of a level at once, by two histograms of sizes over the key, whose ties
    are ordered by `tie` (a long; rows equal in it and in all dimensions stay together). The driver
    gets a few numbers a node. The tree is built over keys and sizes alone, written once a level;
    then docs' rows walk down it. What is joined to find a row's node has a row a node of the level
    and is broadcast up to BROADCAST_ROWS nodes.

    Null dimensions count as the smallest value. An empty table gives an empty result. Sizes must
    not be negative. Columns of the output's names are replaced.
    """
    held = own_name(docs, "kd")
    names = [f"{held}{i}" for i in range(len(dimensions))]
    spark, node, upper = docs.sparkSession, f"{held}node", f"{held}upper"
    marked = docs.withColumns({f"{held}size": size.cast("long"), f"{held}tie": tie.bitwiseAND(F.lit((1 << TIE_BITS) - 1)), **dict(zip(names, (d.cast("double") for d in dimensions), strict=True))})
    narrow = staged(marked.select(f"{held}size", f"{held}tie", *names), "kd")
    spread = narrow.agg(F.sum(f"{held}size").alias("total"), *(f(n).alias(f"{t}{n}") for n in names for t, f in (("lo", F.min), ("hi", F.max)))).first()
    total = spread["total"] or 0
    leaves = shards if shards is not None else max(1, math.ceil(total / target_bytes))
    top = (1 << VALUE_BITS) - 1
    keys = {}
    for n in names:
        lo, hi = spread[f"lo{n}"], spread[f"hi{n}"]
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        value = F.coalesce(F.floor((F.col(n) - F.lit(lo or 0.0)) / F.lit(width) * top), F.lit(0)).cast("long")
        keys[f"{n}key"] = F.shiftleft(value, TIE_BITS).bitwiseOR(F.col(f"{held}tie"))
    root = {node: F.lit(0), upper: F.lit(leaves)}
    at = narrow.withColumns(keys | root).drop(*names, f"{held}tie")
    nodes, levels = {(0, leaves)}, []
    while open_ := sorted((a, b) for a, b in nodes if b - a > 1):
        at = staged(at, "level")
        levels.append(_cuts(at, held, names, node, upper, open_))
        at = _lower(at, held, names, node, upper, levels[-1])
        nodes = (nodes - set(open_)) | {x for a, b in open_ for m in [a + (b - a) // 2] for x in ((a, m), (m, b))}
    rest = [c for c in docs.columns if c not in (size_name, shard_name, *drop)]
    out = marked.withColumns(keys | root)
    for cuts in levels:
        out = _lower(out, held, names, node, upper, cuts)
    return out.select(*rest, F.col(f"{held}size").alias(size_name), F.col(node).alias(shard_name))


def _lower(at: DataFrame, held: str, names: list[str], node: str, upper: str, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """at, with its rows one level down: cuts has the nodes that are cut, their dimension and last key to the left."""
    key = lambda dim: F.coalesce(*(F.when(dim == i, F.col(f"{n}key")) for i, n in enumerate(names)))
    if len(cuts) == 1:  # no join for the root
        (of, dim, cut), joined = cuts[0], at
        split, right = F.col(node) == of, (F.col(node) == of) & (F.col(f"{names[dim]}key") > cut)
    else:
        table = _table(at.sparkSession, cuts, f"{node}_of int, {held}dim int, {held}cut long")
        table = F.broadcast(table) if len(cuts) <= BROADCAST_ROWS else table
        joined = at.join(table, at[node] == table[f"{node}_of"], "left")
        split, right = F.col(f"{held}dim").isNotNull(), F.coalesce(key(F.col(f"{held}dim")) > F.col(f"{held}cut"), F.lit(False))
    middle = F.col(node) + F.floor((F.col(upper) - F.col(node)) / 2).cast("int")
    moved = {f"{held}n": F.when(right, middle).otherwise(F.col(node)), f"{held}u": F.when(split & ~right, middle).otherwise(F.col(upper))}
    return joined.withColumns(moved).drop(node, upper, f"{node}_of", f"{held}dim", f"{held}cut").withColumnsRenamed({f"{held}n": node, f"{held}u": upper})


def _cuts(at: DataFrame, held: str, names: list[str], node: str, upper: str, open_: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """For each open node its first leaf, the index of its widest dimension and the last key that goes left."""
    ranges = at.where(F.col(upper) - F.col(node) > 1).groupBy(node).agg(F.sum(f"{held}size").alias("total"), *(f(f"{n}key").alias(f"{t}{i}") for i, n in enumerate(names) for t, f in (("lo", F.min), ("hi", F.max))))
    wanted: dict[int, tuple[int, int]] = {}
    leaves = dict(open_)
    for r in ranges.collect():
        a = r[node]
        k = leaves[a] - a
        widest = max(range(len(names)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
        wanted[a] = (widest, r["total"] * (k // 2) // k)
    found = {a: (0, 0) for a in wanted}  # the key's prefix and the size before it
    bins: dict = {}
    for shift in range(VALUE_BITS + TIE_BITS - STEP_BITS, -1, -STEP_BITS):
        rows = [(a, wanted[a][0], wanted[a][1], *found[a]) for a in found]
        if not rows:
            break
        table = _table(at.sparkSession, rows, f"{held}a int, {held}dim int, {held}want long, {held}prefix long, {held}before long")
        table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
        key = F.coalesce(*(F.when(F.col(f"{held}dim") == i, F.col(f"{n}key")) for i, n in enumerate(names)))
        part = at.join(table, at[node] == table[f"{held}a"]).withColumn(f"{held}key", key).where(F.shiftright(f"{held}key", shift + STEP_BITS) == F.col(f"{held}prefix"))
        sums = part.groupBy(node, f"{held}want", f"{held}before", F.shiftright(f"{held}key", shift).alias("bin")).agg(F.sum(f"{held}size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy(node).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{held}before")
        first = sums.withColumn("upto", upto).where(F.col("upto") >= F.col(f"{held}want")).groupBy(node).agg(F.min_by(F.struct("bin", "upto", "words"), F.col("bin")).alias("b"))
        bins = {r[node]: r["b"] for r in first.collect()}
        found = {a: (b["bin"], b["upto"] - b["words"]) for a, b in bins.items()}
    out = []
    for a, b in bins.items():
        before, want = b["upto"] - b["words"], wanted[a][1]
        out.append((a, wanted[a][0], b["bin"] if 2 * before + b["words"] < 2 * want else b["bin"] - 1))
    return out


def with_slots(sharded: DataFrame, *, order: Sequence[Column], rows: int | None = None, shard_name: str = "shard", slot_name: str = "slot", rows_a_block: int = 20_000) -> DataFrame:
    """sharded with slot (long): each row's place in its shard, gapless from 0.

    A shard is cut into blocks by a digest of `order`; a row's slot is its block's offset plus its
    place in the block by `order`. A block has rows_a_block rows or so, so no task holds a shard; rows
    equal in all of `order` share a block and are interchangeable. A column of the name is replaced.
    """
    n = rows if rows is not None else sharded.count()
    block = own_name(sharded, "block")
    blocks = max(1, -(-n // rows_a_block))
    marked = sharded.drop(slot_name).withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = marked.groupBy(shard_name, block).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(shard_name).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(shard_name).alias(f"{block}s"), F.col(block).alias(f"{block}b"), F.coalesce(before, F.lit(0)).alias(f"{block}o"))
    placed = marked.withColumn(f"{block}r", F.row_number().over(Window.partitionBy(shard_name, block).orderBy(*order)))
    out = placed.join(offsets, (placed[shard_name] == offsets[f"{block}s"]) & (placed[block] == offsets[f"{block}b"]))
    rest = [c for c in sharded.columns if c != slot_name]
    return out.select(*rest, (F.col(f"{block}o") + F.col(f"{block}r") - 1).alias(slot_name))
