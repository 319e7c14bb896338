"""Exact repeated-substring removal with suffix arrays built by two-stage sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import staged
from quillspark.llm.spans import document_key, small, without_spans

#: Bytes that must repeat to be removed, those that must repeat to be reported, and bytes of the grams whose least
#: hash names a window's bucket.
LENGTH, REPORT, GRAM = 400, 256, 32
#: Suffix arrays are built over texts of about so many bytes. A bucket of more is settled by counting
#: its windows' digests instead, so that no task holds an unbounded bucket.
SORT_BYTES = 1 << 20
#: Places of a text, and windows of a piece, that a worker looks at together.
BLOCK = 1 << 17
SEPARATOR = b"\xff"  # never occurs in UTF-8


def two_stage_suffix_array(text: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of text (those of `wanted`, if given) in the order of their first depth bytes.

    Two-stage sorting (Itoh and Tanaka, 1999): a suffix is of type S if it is smaller than its
    successor, else of type L; the last is of type L. Only the S suffixes are sorted directly. Then
    the buckets of first bytes are scanned in order, L suffixes before S suffixes: each suffix in a
    bucket puts its predecessor, if that is of type L, at the end of what its bucket has so far. An
    L suffix comes after its successor, so all are placed when their bucket is scanned.

    wanted is a mask of places in which the successor of an L suffix is wanted, too.
    """
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    wanted = np.ones(n, dtype=bool) if wanted is None else wanted
    of_s = np.flatnonzero(_smaller_than_successor(t) & wanted)
    of_s = of_s[np.argsort(t[of_s], kind="stable")]
    s_ends = np.searchsorted(t[of_s], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        induced[t[n - 1]].append(np.array([n - 1], dtype=np.int64))
    out = []
    for c in range(256):
        bucket = np.concatenate(induced[c]) if induced[c] else np.zeros(0, dtype=np.int64)
        found = [bucket]
        while len(bucket):  # predecessors with the same first byte join the bucket's end
            before = bucket[bucket > 0] - 1
            bucket = before[(t[before] == c) & wanted[before]]
            found.append(bucket)
        directly = of_s[s_ends[c] : s_ends[c + 1]].tolist()
        directly.sort(key=lambda i: text[i : i + depth])  # the keys of one bucket at a time are held
        whole = np.concatenate([*found, np.array(directly, dtype=np.int64)])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(t[before] > c) & wanted[before]]
        if len(before):
            byte = t[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cuts):
                induced[t[part[0]]].append(part)
    return np.concatenate(out)


def _smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Type S: the next differing byte is larger; in a last run of equal bytes, none is."""
    n = len(t)
    up = np.zeros(n, dtype=bool)
    differ = np.flatnonzero(t[:-1] != t[1:])
    if len(differ):
        run = np.diff(np.concatenate([[-1], differ]))
        up[: differ[-1] + 1] = np.repeat(t[differ] < t[differ + 1], run)
    return up


def _first_windows(t: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A mask of each piece's first counts places and those on to the next suffix of type S, from which L suffixes are induced."""
    wanted = np.zeros(len(t) + 1, dtype=np.int64)
    of_s = np.flatnonzero(_smaller_than_successor(t))
    upto = of_s[np.searchsorted(of_s, begins + counts)]  # a piece's last byte is less than the separator, so there is one
    np.add.at(wanted, begins, 1)
    np.add.at(wanted, upto + 1, -1)
    return np.cumsum(wanted[:-1]) > 0


def repeated_starts(pieces: list[bytes], counts: list[int], lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the lengths, the places in SEPARATOR.join(pieces) + SEPARATOR, among each piece's first counts, where
    a substring of so many bytes starts that starts at these places more than once: neighbours in the suffix array with
    so long a common prefix."""
    text = SEPARATOR.join(pieces) + SEPARATOR
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    many = np.array(counts, dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    t = np.frombuffer(text, dtype=np.uint8)
    order = two_stage_suffix_array(text, max(lengths), _first_windows(t, begins, many))
    of = np.searchsorted(ends, order)
    order, room = order[order < (begins + many)[of]], (ends[of] - order)[order < (begins + many)[of]]
    found = []
    for length in lengths:
        fit = order[room >= length].tolist()
        same = np.array([text[a : a + length] == text[b : b + length] for a, b in zip(fit, fit[1:], strict=False)], dtype=bool)
        flags = np.zeros(len(fit), dtype=bool)
        flags[:-1] |= same
        flags[1:] |= same
        found.append(np.sort(np.array(fit, dtype=np.int64)[flags]))
    return found


def _gram_hashes(raw: bytes, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place, by doubling a polynomial; gram is a power of two."""
    h = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width, factor = 1, 0xD6E8FEB86659FD93
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


def _runs(raw: bytes, length: int, gram: int, block: int) -> Iterator[tuple[int, int, int, bool]]:
    """(bucket, first, end, twice) of the runs of window starts of one bucket, from blocks of bounded memory; twice is
    true where the windows hold their bucket's gram more than once."""
    width, last, at = length - gram + 1, len(raw) - length + 1, 0
    open_: tuple[int, int] | None = None  # a run longer than `width`, which goes on from an earlier block
    while at < last:
        n = min(max(block, 2 * width), last - at)
        h = _gram_hashes(raw[at : at + n + length - 1], gram)
        m = _window_minima(h, width)
        cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
        runs = list(zip(m[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), n], strict=True))
        done = at + n >= last
        if open_ and open_[0] != runs[0][0]:
            yield *open_, at, True
            open_ = None
        for i, (bucket, a, b) in enumerate(runs):
            if i == len(runs) - 1 and not done:
                if open_ is None and b - a <= width:
                    n = a  # the next block begins with this run
                elif open_ is None:
                    open_ = bucket, at + a
            elif open_:
                yield *open_, at + b, True
                open_ = None
            else:
                yield bucket, at + a, at + b, np.count_nonzero(h[a : b + width - 1] == np.uint64(bucket)) > 1
        at += n


def pieces_of(raw: bytes, length: int, report: int, gram: int, block: int = BLOCK) -> list[tuple[int, int, int, int, int]]:
    """(bucket, digest, start, windows, end) of the pieces of a text.

    A window of `report` bytes belongs to the bucket of its grams' least hash, so equal windows
    share a bucket. A piece is a maximal run of windows of one bucket: the bytes from the first
    window's start to `length` bytes (or the text's end) from the last one's. Each window is in one
    piece, and so is each of `length` bytes, which begins with one. A piece that has its bucket's
    gram more than once, in which windows may equal each other, has an even digest.
    """
    out = []
    for bucket, a, b, twice in _runs(raw, report, gram, block):
        end = min(b - 1 + length, len(raw))
        out.append((bucket, (xxhash.xxh3_64_intdigest(raw[a:end], b - a) | 1) - int(twice), a, b - a, end))
    return out


def piece_rows(length: int, report: int, gram: int):
    """mapInArrow function: from (k1, k2, text) a row (k1, k2, bucket, digest, start, windows, end) for each piece.

    Digests are odd, but even for pieces that have the bucket's gram more than once.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            rows, counts = [], []
            for text in batch.column(2):
                found = pieces_of(text.as_py() or b"", length, report, gram)
                rows += found
                counts.append(len(found))
            of_row = pa.array(np.repeat(np.arange(len(counts)), counts))
            bucket, digest, start, many, end = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            whole = batch.column(0).take(of_row), batch.column(1).take(of_row), long(bucket), long(digest), pa.array(start, pa.int32()), pa.array(many, pa.int32()), pa.array(end, pa.int32())
            for at in range(0, max(1, len(rows)), BLOCK):
                yield pa.record_batch([x.slice(at, BLOCK) for x in whole], names=["k1", "k2", "bucket", "digest", "start", "windows", "end"])

    return of


_PIECE = "bucket long, digest long, windows int, piece binary"
_PART = "bucket long, digest long, from int, to int, drop boolean"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, wanted: array of (bucket, digest, windows, start, end)) the bytes of each wanted piece."""
    for batch in small(batches, 64):
        rows = [(w["bucket"], w["digest"], w["windows"], raw[w["start"] : w["end"]]) for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for raw in [text.as_py()] for w in wanted]
        bucket, digest, many, piece = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([pa.array(bucket, pa.int64()), pa.array(digest, pa.int64()), pa.array(many, pa.int32()), pa.array(piece, pa.binary())], names=["bucket", "digest", "windows", "piece"])


def _sorted_repeats(length: int, report: int, most: int):
    """mapInArrow function: from (bucket, digest, windows, piece) sorted by bucket, (bucket, digest, from, to, drop) of
    what repeats: drop is true for strings of `length` bytes, null for those of `report`."""

    def settle(held: list[tuple[int, int, int, bytes]]) -> list[tuple]:
        sizes = np.cumsum([0] + [len(p) + 1 for _, _, _, p in held])
        out: list[tuple] = []
        for size, drop, starts in zip((length, report), (True, None), repeated_starts([x[3] for x in held], [x[2] for x in held], (length, report)), strict=True):
            of = np.searchsorted(sizes, starts, side="right") - 1
            for at, i in zip((starts - sizes[of]).tolist(), of.tolist(), strict=True):
                bucket, digest = held[i][:2]
                if out and out[-1][:2] == (bucket, digest) and out[-1][4] is drop and at <= out[-1][3]:
                    out[-1] = (bucket, digest, out[-1][2], at + size, drop)
                else:
                    out.append((bucket, digest, at, at + size, drop))
        return out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def give() -> pa.RecordBatch:
            bucket, digest, start, end, drop = zip(*rows, strict=True) if (rows := settle(held) if held else []) else ((), (), (), (), ())
            return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(digest, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(drop, pa.bool_())], names=["bucket", "digest", "from", "to", "drop"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= most // 4 and held[-1][0] != row[0]:
                    yield give()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield give()

    return of


def _window_digests(length: int, report: int):
    """mapInArrow function: from (bucket, digest, windows, piece) a row (bucket, digest, drop, start, w1, w2) for each window
    of `length` (drop true) and `report` bytes (null)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, digest, many, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for size, drop in ((length, True), (report, None))[: 1 + (report < length)]:
                    upto = min(many, len(piece) - size + 1)
                    for at in range(0, upto, BLOCK):
                        n = min(BLOCK, upto - at)
                        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(piece[i : i + size]) for i in range(at, at + n)), dtype="<i8").reshape(n, 2)
                        starts = pa.array(np.arange(at, at + n, dtype=np.int32))
                        yield pa.record_batch([pa.array(np.full(n, bucket)), pa.array(np.full(n, digest)), pa.array([drop] * n, pa.bool_()), starts, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["bucket", "digest", "drop", "start", "w1", "w2"])

    return of


def _runs_of_windows(starts: DataFrame, length: int, report: int) -> DataFrame:
    """(bucket, digest, from, to, drop) of the bytes that windows(bucket, digest, drop, start) cover; most pieces have few windows."""
    size = F.when(F.col("drop"), F.lit(length)).otherwise(F.lit(report))
    order = Window.partitionBy("bucket", "digest", "drop").orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("start").over(order) > size, F.lit(True)).cast("int")
    runs = starts.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("bucket", "digest", "drop", "run").agg(F.min("start").alias("from"), (F.max("start") + size).alias("to")).select("bucket", "digest", "from", "to", "drop")


def repeated_spans(keyed: DataFrame, *, length: int = LENGTH, report: int = REPORT, gram: int = GRAM, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """(k1, k2, spans) from keyed(k1, k2, text), for texts with any: arrays of (start, end, drop) that
    together cover each byte of a string which starts anywhere else in the corpus; drop is true
    for strings of `length` bytes, null for those of `report` bytes.

    1. Every text becomes pieces (pieces_of): equal windows are in pieces of the same bucket.
    2. Buckets that occur once are done. Pieces that occur twice (digest) repeat as a whole.
    3. A bucket with several different pieces, or one in which windows may equal each other, needs
       comparing: one occurrence of each different piece is fetched from its text, and the bucket's
       pieces meet in one task, which sorts their suffixes (two_stage_suffix_array) and compares
       neighbours. Buckets of over sort_bytes are settled by counting 128-bit digests of windows.
    4. What repeats in a piece holds for all its occurrences.
    """
    texts = keyed.select("k1", "k2", F.col("text").cast("binary").alias("text"))
    pieces = staged(texts.where(F.octet_length("text") >= report).mapInArrow(piece_rows(length, report, gram), "k1 long, k2 long, bucket long, digest long, start int, windows int, end int"), "pieces")
    again = (F.col("digest").bitwiseAND(F.lit(1)) == 0).cast("int")
    buckets = pieces.groupBy("bucket").agg(F.count("*").alias("n"), F.max(again).alias("again"))
    live = staged(buckets.where("n > 1 or again > 0").select("bucket"), "buckets")
    seen = staged(pieces.join(live, "bucket"), "repeats")
    first = F.min(F.struct("k1", "k2", "start", "end", "windows")).alias("at")
    kinds = staged(seen.groupBy("bucket", "digest").agg(F.count("*").alias("n"), first), "kinds")
    size = F.col("at.end") - F.col("at.start")
    both = F.array(F.struct((F.col("at.windows") - 1 + report).alias("to"), F.lit(None).cast("boolean").alias("drop")), F.struct(size.alias("to"), F.lit(True).alias("drop")))
    whole = kinds.where("n > 1").select("bucket", "digest", F.lit(0).alias("from"), size.alias("size"), F.explode(both).alias("p")).where(f"p.drop is null or size >= {length}").select("bucket", "digest", "from", "p.to", "p.drop")

    per = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max(again).alias("again"), F.sum(size).alias("size"))
    open_ = staged(per.where("kinds > 1 or again > 0").select("bucket", (F.col("size") > sort_bytes).alias("large")), "open")
    wanted = kinds.join(open_, "bucket").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("bucket", "digest", F.col("at.windows").alias("windows"), F.col("at.start").alias("start"), F.col("at.end").alias("end"))).alias("wanted"))
    one = texts.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "wanted")
    fetched = staged(one.mapInArrow(_extract, _PIECE), "fetched")
    small = fetched.join(open_.where(~F.col("large")).select("bucket"), "bucket").repartition("bucket").sortWithinPartitions("bucket")
    by_sort = small.select("bucket", "digest", "windows", "piece").mapInArrow(_sorted_repeats(length, report, sort_bytes), _PART)
    large = fetched.join(open_.where("large").select("bucket"), "bucket").select("bucket", "digest", "windows", "piece")
    windows = large.mapInArrow(_window_digests(length, report), "bucket long, digest long, drop boolean, start int, w1 long, w2 long")
    common = staged(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "common")
    by_count = _runs_of_windows(windows.join(common, ["w1", "w2"]).select("bucket", "digest", "drop", "start"), length, report)
    parts = whole.union(by_sort).union(by_count).groupBy("bucket", "digest").agg(F.collect_set(F.struct("from", "to", "drop")).alias("parts"))
    hits = seen.join(parts, ["bucket", "digest"]).select("k1", "k2", "start", F.explode("parts").alias("p"))
    span = F.struct((F.col("start") + F.col("p.from")).alias("start"), (F.col("start") + F.col("p.to")).alias("end"), F.col("p.drop").alias("drop"))
    return hits.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, report: int | None = None, gram: int = GRAM, sort_bytes: int = SORT_BYTES, keep_bytes: bool = True) -> DataFrame:
    """A row for every row of docs: id, n_bytes, n_removed, n_spans, spans, n_repeated, repeated, kept_sha256, kept.

    Removed is each byte covered by a string of `length` bytes (at least gram, a power of two) that
    also starts anywhere else, in the same text or another; strings overlap and are judged on the
    input. n_repeated and repeated say the same of strings of `report` bytes (REPORT, but length where
    that is less; no more than length), which stay. Texts are UTF-8 bytes, null is empty, and a text shorter than
    `length` stays whole. Repeated rows are occurrences of their own: such texts of `length` bytes go
    entirely. Texts of any length are read whole, in blocks; other columns are not read.
    """
    report = min(REPORT, length) if report is None else report
    if gram & (gram - 1) or not gram <= report <= length:
        raise ValueError("gram must be a power of two and no more than report, report no more than length")
    keyed = docs.select(F.col(id_col).alias("id"), *document_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    return without_spans(keyed, repeated_spans(keyed, length=length, report=report, gram=gram, sort_bytes=sort_bytes), keep_bytes=keep_bytes)
