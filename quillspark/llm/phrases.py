"""Phrase collocations: depth-limited count tries of each shard, serialised in order and merged by ranges of prefixes.

A shard's words are a stream of numbers; its trie of bounded depth is the sorted array of the windows
that start at each word, of which every prefix is a node and every run of equal prefixes a count. A task
merges the tries of its shards, and writes their nodes path by path. Merging deals them in ranges of paths, so equal paths of all shards
meet and a prefix stands before what it begins: walking a range then yields the counts of all first
parts. Counts of the rests come through suffix links (a path without its first word), depth by depth.

Before, one pass counts runs of one to four words in hashed cells. What lies in a cell
of too few can't be part of a phrase that is frequent enough, so windows end there: this loses no phrase, and
the table of cells has the same size for any input.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import small_batches, staged

#: Words in a candidate; its least count; a phrase is judged by its cut of the lowest score.
DEPTH, LEAST = 5, 100
#: Words that a worker counts in cells, and of which it builds a trie, at once; words whose cells are looked up at once.
COUNT_WORDS, SHARD_WORDS, LOOKUP_WORDS = 2_000_000, 4_000_000, 1_000_000
#: Words of a task that merges its tries, and nodes that it holds for this.
TASK_WORDS, HELD_NODES = 16_000_000, 1_000_000
#: Bytes of a text that are split into words at once (more, to the end of a word).
SLICE_BYTES = 1 << 20
#: Words that are counted together in cells; bits of a cell, and of the part of it that one packed row holds.
RUNS, CELL_BITS, PART_BITS = 4, 26, 14
#: Rows of documents that a Python worker gets at once.
ROWS = 200

#: A-Z in lower case, what ends a piece as a line feed, a tab as a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_TOKEN = re.compile(rb"[^ \n]+|\n")
_END = 0


def _slices(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of that many bytes or more, each ending where a word does."""
    start = 0
    while start < len(raw):
        stop = start + size
        if stop < len(raw):
            ends = [i for i in (raw.find(b" ", stop), raw.find(b"\n", stop)) if i >= 0]
            stop = min(ends, default=len(raw))
        yield raw[start:stop]
        start = stop


class _Shard:
    """The words of one language as a stream of numbers; 0 ends a piece."""

    def __init__(self) -> None:
        self.number = dict.fromkeys([b"\n"], _END)
        self.next = counter(1)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        number, fresh = self.number, self.next
        for w in set(tokens):
            if w not in number:
                number[w] = next(fresh)
        part = np.fromiter(map(number.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        self.parts.append(part)
        self.size += len(part)

    def take(self, keep: int) -> tuple[list[bytes], np.ndarray, int]:
        """(words in order, numbers by that order, starts to count); the last `keep` stay to be counted with what follows."""
        stream = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        words = sorted(w for w in self.number if w != b"\n")
        place = np.zeros(len(self.number), dtype=np.int32)
        place[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        ranked = place[stream]
        starts = max(0, len(stream) - keep)
        rest = [b"\n" if i == _END else words[i - 1] for i in ranked[starts:]]
        self.__init__()
        if rest:
            self.add(rest)
        return words, ranked, starts


def _shards(batches: Iterator[pa.RecordBatch], reach: int, size: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(lang, words, numbers, starts) of each language's stream, as often as `size` words are held; each start sees
    `reach` words more."""
    held: dict[str, _Shard] = {}
    n = 0

    def flush(keep: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
        nonlocal n
        for lang in list(held):
            yield lang, *held[lang].take(keep)
            if not keep:
                del held[lang]
        n = sum(s.size for s in held.values())

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if (raw := text.as_py()) is None:
                continue
            for part in _slices(raw.translate(_TABLE), SLICE_BYTES):
                shard = held.setdefault(lang, _Shard())
                before = shard.size
                shard.add(_TOKEN.findall(part))
                n += shard.size - before
                if n >= size:
                    yield from flush(reach)
            if lang in held:
                held[lang].add([b"\n"])
                n += 1
            if n >= size:  # also where most texts are empty
                yield from flush(reach)
    yield from flush(0)


def _cells(lang: str, words: list[bytes], stream: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, inside a piece) of the runs of one to RUNS words at each start that has so many after it."""
    own = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint64, count=len(words))
    own = np.append(np.uint64(0), own)[stream]
    held = np.full(len(stream), zlib.crc32(lang.encode()), dtype=np.uint64)
    inside = np.ones(len(stream), dtype=bool)
    for k in range(RUNS):
        n = max(0, len(stream) - k)
        held = held[:n] * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n] + np.uint64(1)
        inside = inside[:n] & (stream[k : k + n] > 0)
        mixed = held ^ (held >> np.uint64(29))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        yield (mixed >> np.uint64(64 - CELL_BITS)).astype(np.uint32), inside


def _count_runs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, n, part, cells, counts): words of each language, and packed counts of runs by cell, up to `least`."""
    kind = np.min_scalar_type(least)
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, stream, starts in _shards(batches, RUNS - 1, COUNT_WORDS):
            n = int(np.count_nonzero(stream[:starts]))
            rows: list[tuple] = [(lang, n, None, None, None)]
            found = np.sort(np.concatenate([cells[:starts][inside[:starts]] for cells, inside in _cells(lang, words, stream)]))
            if len(found):
                first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                cells, counts = found[first], np.minimum(np.diff(np.append(first, len(found))), least).astype(kind)
                parts = cells >> PART_BITS
                cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
                low = (cells & ((1 << PART_BITS) - 1)).astype(np.uint16)
                for a, b in zip(cuts, np.append(cuts[1:], len(cells)), strict=True):
                    rows.append((None, None, int(parts[a]), low[a:b].tobytes(), counts[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _full_cells(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The sums of each part's packed rows, which come next to each other, as a bit for each cell of `least` or more."""

    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, sums = None, np.zeros(1 << PART_BITS, dtype=np.int64)
        done = lambda: pd.DataFrame({"part": [part], "bits": [np.packbits(sums >= least).tobytes()]})
        for batch in batches:
            for p, cells, counts in zip(batch["part"], batch["cells"], batch["counts"], strict=True):
                if p != part:
                    if part is not None:
                        yield done()
                    part, sums = p, np.zeros(1 << PART_BITS, dtype=np.int64)
                sums[np.frombuffer(cells, dtype=np.uint16)] += np.frombuffer(counts, dtype=kind)
        if part is not None:
            yield done()

    return run


def _full_runs(lang: str, words: list[bytes], stream: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Whether the runs of one to RUNS words at each start lie in full cells, looked up a part of the stream at a time."""
    full = [np.zeros(len(stream), dtype=bool) for _ in range(RUNS)]
    for a in range(0, len(stream), LOOKUP_WORDS):
        part = stream[a : a + LOOKUP_WORDS + RUNS - 1]
        for k, (cells, inside) in enumerate(_cells(lang, words, part)):
            n = min(len(cells), LOOKUP_WORDS)
            full[k][a : a + n] = inside[:n] & (bits[cells[:n] >> 3] >> (7 - (cells[:n] & 7)).astype(np.uint8) & 1).astype(bool)
    return full


def trie_levels(stream: np.ndarray, depth: int, full: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, paths, counts) for each depth of the trie of the windows at the starts, paths in order.

    full[k] tells of each start whether the k + 1 words there may be part of a phrase; starts are those of full[0].
    Only starts at which a second word may follow have windows to sort; single words are counted as they are.
    """
    counts = np.bincount(stream[np.flatnonzero(full[0])])
    seen = np.flatnonzero(counts)
    yield 1, seen.astype(np.int32)[:, None], counts[seen]
    at = np.flatnonzero(full[0] & full[1])
    windows = np.zeros((len(at), depth), dtype=np.int32)
    windows[:, 0] = stream[at]
    long = np.append(stream, np.zeros(depth, stream.dtype))
    padded = [np.append(f, np.zeros(depth, bool)) for f in full]
    open_ = np.ones(len(at), dtype=bool)
    for d in range(1, depth):
        for k in range(1, min(d + 1, len(padded))):  # the runs that end with this word
            open_ &= padded[k][at + d - k]
        windows[:, d] = np.where(open_, long[at + d], _END)
    windows = windows[np.lexsort(windows.T[::-1])]
    fresh = np.zeros(len(windows), dtype=bool)
    fresh[:1] = True
    fresh[1:] = windows[1:, 0] != windows[:-1, 0]
    for d in range(1, depth):
        column = windows[:, d]
        fresh[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(fresh)
        counts = np.diff(np.append(first, len(windows)))
        inside = column[first] > 0
        yield d + 1, windows[first[inside], : d + 1], counts[inside]


def _merged(tries: list[pa.Table]) -> pa.Table:
    """One trie of several, the counts of equal paths added."""
    return pa.concat_tables(tries).group_by(["lang", "path"]).aggregate([("f", "sum")]).select(["lang", "path", "f_sum"]).rename_columns(["lang", "path", "f"])


def _serialise(bits: np.ndarray, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes of a task's tries. Tries of SHARD_WORDS words are merged, paths being words joined by spaces, and written at the
    end, or before where many nodes are held: what is frequent is in every trie."""

    def nodes(lang: str, words: list[bytes], stream: np.ndarray, starts: int) -> Iterator[pa.Table]:
        full = _full_runs(lang, words, stream, bits)
        full[0][starts:] = False
        named = pa.array(words, type=pa.binary()).cast(pa.string())
        for d, paths, counts in trie_levels(stream, depth, full):
            values = named.take(pa.array(paths.ravel() - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(paths) + 1, dtype=np.int32) * d), values)
            yield pa.table({"lang": pa.array([lang] * len(paths), pa.string()), "path": pc.binary_join(lists, " "), "f": pa.array(counts.astype(np.int64))})

    def written(tries: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        for part in _merged(tries).to_batches(max_chunksize=50_000):
            yield pa.record_batch([part.column(0), pc.split_pattern(part.column(1), " "), part.column(2)], names=["lang", "path", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for lang, words, stream, starts in _shards(batches, depth - 1, SHARD_WORDS):
            if len(stream) < 1:
                continue
            held += nodes(lang, words, stream, starts)
            if sum(map(len, held)) > HELD_NODES:
                held = [_merged(held)]
                if len(held[0]) > HELD_NODES // 2:
                    yield from written(held)
                    held = []
        if held:
            yield from written(held)

    return run


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes in order of their paths, with `lefts`: counts of all their beginnings, null where a range starts below one."""
    at: list[tuple[str, int]] = []  # the words and counts from the root to the last node
    lang_of = None
    for batch in batches:
        lefts = []
        for lang, path, f in zip(batch["lang"], batch["path"], batch["f"], strict=True):
            if lang != lang_of:
                at, lang_of = [], lang
            common = 0
            for (word, _), other in zip(at, path[:-1]):
                if word != other:
                    break
                common += 1
            lefts.append([c for _, c in at[:common]] + [None] * (len(path) - 1 - common))
            at = at[:common] + [(w, None) for w in path[common:-1]] + [(path[-1], int(f))]
        yield batch.assign(lefts=pd.Series(lefts, index=batch.index, dtype=object))


def word_totals(counted: DataFrame) -> DataFrame:
    return counted.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, *, text: str, lang: str, depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words; and (lang, path, f, lefts): every run of one to `depth` words found `least` times or more."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    with small_batches(spark, ROWS):
        counted = staged(rows.mapInArrow(_count_runs(least), "lang string, n long, part int, cells binary, counts binary"), "runs")
    bits = np.zeros(1 << CELL_BITS - 3, dtype=np.uint8)
    with small_batches(spark, 100):
        parts = counted.where("part IS NOT NULL").select("part", "cells", "counts").repartition("part").sortWithinPartitions("part")
        for r in parts.mapInPandas(_full_cells(least), "part int, bits binary").collect():  # 8 MB in all, for any input
            here = np.frombuffer(r["bits"], dtype=np.uint8)
            bits[r["part"] * len(here) : (r["part"] + 1) * len(here)] |= here
    words = word_totals(counted).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-words // TASK_WORDS))
    with small_batches(spark, ROWS):
        nodes = staged(rows.coalesce(tasks).mapInArrow(_serialise(bits, depth), "lang string, path array<string>, f long"), "tries")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = nodes.repartitionByRange(ranges, "lang", "path").groupBy("lang", "path").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    walked = merged.sortWithinPartitions("lang", "path").mapInPandas(walk, "lang string, path array<string>, f long, lefts array<long>")
    return word_totals(counted), _whole(staged(walked, "nodes"))


def _whole(nodes: DataFrame) -> DataFrame:
    """Nodes whose beginnings stand in an earlier range get their counts: those are beginnings of the range's first path alone."""
    cut = F.exists("lefts", lambda c: c.isNull())
    broken = nodes.where(cut)
    places = broken.select("lang", "path", "f", F.posexplode("lefts").alias("i", "left"))
    known = nodes.select(F.col("lang").alias("of"), F.col("path").alias("start"), F.col("f").alias("n"))
    filled = places.withColumn("start_", F.slice("path", 1, F.col("i") + 1)).join(known, (F.col("lang") == F.col("of")) & (F.col("start_") == F.col("start")))
    whole = filled.groupBy("lang", "path", "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("left", "n").alias("n")))), lambda s: s["n"]).alias("lefts"))
    return nodes.where(~cut).unionByName(whole)


def _with_rests(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes with `rights`: counts of all their rests, by one suffix link a depth."""
    linked = nodes.where(F.size("path") == 1).select("*", F.array().cast("array<long>").alias("rights"))
    out = linked
    for d in range(2, depth + 1):
        here = nodes.where(F.size("path") == d).withColumn("link", F.slice("path", 2, d - 1))
        to = linked.select(F.col("lang").alias("of"), F.col("path").alias("suffix"), F.col("f").alias("n"), F.col("rights").alias("more"))
        joined = here.join(to, (F.col("lang") == F.col("of")) & (F.col("link") == F.col("suffix")))
        linked = joined.select(*nodes.columns, F.concat(F.array("n"), "more").alias("rights"))
        out = out.unionByName(linked)
    return out


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `depth` words.

    Words are runs of anything but spaces and tabs within pieces, which end at .,;:!? and line ends; A-Z
    count as lower case. a is the phrase's count (least or more), n that of all words, l and r those of
    the parts of its lowest-scoring cut (ties: the first), score floor(1000 a n / (l r)), exactly. A
    phrase goes if a longer one that holds it is as frequent. Ranks go by score, then a, then the phrase's
    bytes. A null text has no words and a null language is `und`; repeated rows count as often as they
    are there; a text of any length is read in slices. Other columns are ignored, and an empty table gives
    no phrase.
    """
    totals, nodes = phrase_counts(docs, text=text, lang=lang, depth=depth, least=least)
    full = staged(_with_rests(nodes, depth), "linked").where(F.size("path") > 1)
    joined = full.join(totals, "lang")
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda z, i: F.struct(z["lefts"].alias("l"), z["rights"].alias("r"), i.alias("k")))
    scored = joined.select("lang", "path", F.col("f").alias("a"), "n", "lefts", "rights", F.explode(cuts).alias("c"))
    score = F.expr("CAST(1000BD * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(38,0)) DIV (CAST(c.l AS DECIMAL(19,0)) * CAST(c.r AS DECIMAL(19,0)))")
    lowest = scored.select("lang", "path", "a", "n", F.struct(score.alias("score"), F.col("c.k").alias("k"), F.col("c.l").alias("l"), F.col("c.r").alias("r")).alias("c"))
    judged = lowest.groupBy("lang", "path", "a", "n").agg(F.min("c").alias("c"))
    # f falls with length, so a longer phrase as frequent has one of just a word more in between
    longer = full.where(F.size("path") > 2)
    holds = longer.where(F.col("f") >= F.element_at("lefts", -1)).select("lang", F.expr("slice(path, 1, size(path) - 1)").alias("path"))
    held = holds.unionByName(longer.where(F.col("f") >= F.element_at("rights", 1)).select("lang", F.expr("slice(path, 2, size(path) - 1)").alias("path")))
    kept = judged.join(held, ["lang", "path"], "left_anti").select("lang", F.array_join("path", " ").alias("phrase"), "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
