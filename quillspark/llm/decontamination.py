"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks, in DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import own_name, staged, word_grams
from quillspark.llm.spans import document_key

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints are cut into BLOCKS blocks; within RADIUS bits some block differs in BLOCK_RADIUS bits or fewer.
BITS, BLOCKS, BLOCK_RADIUS = 64, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: An item shingle table of up to so many rows is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Votes are summed two to a long, of 32 bits each.
LANES = 32


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _votes(h: Column, weight: Column | int = 1) -> list[Column]:
    """A shingle's votes for the 64 bits, in LANES longs: bit j in the low half of the j-th, bit LANES + j in its high half."""
    ones = F.lit((1 << 32) + 1)
    return [F.shiftrightunsigned(h, j).bitwiseAND(ones) * weight for j in range(LANES)]


def _fingerprint(votes: Column, total: Column) -> Column:
    """The SimHash of summed votes (an array of LANES longs): a bit is 1 if set in over half of the total weight."""
    count = lambda i: F.call_function("shiftrightunsigned", F.get(votes, i % LANES), (F.floor(i / LANES) * 32).cast("int")).bitwiseAND(F.lit((1 << 32) - 1))
    bit = lambda i: F.when(2 * count(i) > total, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda bits, i: bits.bitwiseOR(bit(i)))


def _blocks(fp: Column, probe: bool) -> Column:
    """Array of (block, value) for each block; when probing, also the values that differ in up to BLOCK_RADIUS bits."""
    width = BITS // BLOCKS
    flips = [x for x in range(1 << width) if x.bit_count() <= (BLOCK_RADIUS if probe else 0)]
    value = lambda b: F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*(F.struct(F.lit(b).alias("block"), value(b).bitwiseXOR(F.lit(x)).alias("value")) for b in range(BLOCKS) for x in flips))


def _starts(at: Column, n_words: Column, n_item: Column, k: int, similarity: float) -> Column:
    """Array of the windows' starts that can reach the similarity, from the sorted places of an item's shingles.

    What a window and the item have in common is at most the number of such places in the window.
    """
    span = F.least(n_words, n_item)
    need = F.greatest(F.lit(1), F.ceil((span + n_item - 2 * (k - 1)) * (similarity / (1 + similarity)) - 1e-6).cast("int"))
    # From place j on `need` places lie in the windows of these starts; those before place j - 1 were laid with it.
    lo = lambda j: F.greatest(F.lit(0), F.get(at, j + need - 1) - (span - k), F.coalesce(F.get(at, j - 1) + 1, F.lit(0)))
    hi = lambda j: F.least(F.get(at, j), n_words - span)
    firsts = F.when(F.size(at) >= need, F.sequence(F.lit(0), F.size(at) - need)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(F.filter(firsts, lambda j: lo(j) <= hi(j)), lambda j: F.sequence(lo(j), hi(j))))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _item_hits(texts: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(k1, k2, id, text_key, n_words, of, n_item, k, m, pos, h): each place of a document with a shingle of an item, which has it m times."""
    found = []
    for k in sizes:
        of = _bounded(grams.where(F.col("k") == k))
        places = word_grams(texts.withColumn("n_words", F.size("words")), k, ["k1", "k2", "id", "text_key", "n_words"])
        found.append(places.join(of, "h").select("k1", "k2", "id", "text_key", "n_words", "of", "n_item", "k", "m", "pos", "h"))
    return reduce(DataFrame.union, found)


def _window_fingerprints(texts: DataFrame, laid: DataFrame, sizes: list[int]) -> DataFrame:
    """laid(k1, k2, k, shingles, start) with fp: the SimHash of the window's shingles.

    Votes are summed from the first start of a document's windows of a length on to the end of the last, and a
    window's are the difference of two such sums.
    """
    keys = ["k1", "k2", "k", "shingles"]
    hulls = _bounded(staged(laid.groupBy(*keys).agg(F.min("start").alias("lo"), (F.max("start") + F.col("shingles") - 1).alias("hi")), "hulls"))
    docs = _bounded(staged(hulls.select("k1", "k2").distinct(), "leaky"))
    once = staged(texts.select("k1", "k2", "words").join(docs, ["k1", "k2"]).dropDuplicates(["k1", "k2"]), "leaky")
    found = [word_grams(once, k, ["k1", "k2"]).select("k1", "k2", F.lit(k).alias("k"), "pos", "h") for k in sizes]
    inside = reduce(DataFrame.union, found).join(hulls, ["k1", "k2", "k"]).where(F.col("pos").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = staged(inside.select(*keys, "pos", "h", F.array(*(F.sum(v).over(order) for v in _votes(F.col("h")))).alias("upto")), "votes")
    first = upto.select(*keys, F.col("pos").alias("start"), F.zip_with("upto", F.array(*_votes(F.col("h"))), lambda a, b: a - b).alias("before"))
    last = upto.select(*keys, F.col("pos").alias("last"), "upto")
    both = laid.withColumn("last", F.col("start") + F.col("shingles") - 1).join(first, [*keys, "start"]).join(last, [*keys, "last"])
    return both.withColumn("fp", _fingerprint(F.zip_with("upto", "before", lambda a, b: a - b), F.col("shingles"))).drop("before", "upto", "last")


def _common(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(k1, k2, of, start, shingles, ...) with common: how many shingles the window and the item share, each as
    often as both have it.

    A shingle that the item has m times counts at a place for the windows that begin after its m-th place before, so a
    window's sum is that of the places' stretches of starts that cover its start.
    """
    keys = ["k1", "k2", "of"]
    wanted = pairs.groupBy(*keys).agg(F.max("shingles").alias("shingles"))
    places = hits.join(wanted, keys).groupBy(*keys, "shingles", "h", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    from_ = lambda p, j: F.greatest(F.lit(0), p - F.col("shingles") + 1, F.coalesce(F.get("at", j - F.col("m").cast("int")) + 1, F.lit(0)))
    stretches = places.select(*keys, F.explode(F.transform("at", lambda p, j: F.struct(from_(p, j).alias("a"), p.alias("b")))).alias("s")).where("s.a <= s.b")
    ends = stretches.select(*keys, F.explode(F.array(F.struct(F.col("s.a").alias("start"), F.lit(1).alias("d")), F.struct((F.col("s.b") + 1).alias("start"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.select(*keys, "e.start", "e.d").union(pairs.select(*keys, "start", F.lit(0))).groupBy(*keys, "start").agg(F.sum("d").alias("d"))
    sums = steps.select(*keys, "start", F.sum("d").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)).alias("common"))
    return pairs.join(sums, [*keys, "start"])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, text_key, item, similarity, first_word, last_word, n_windows) for each item found in a document.

    A window has as many words as the item (or is the whole document, if shorter). Windows are laid
    for an item at every start where they hold as many of its shingles, in any order, as the
    similarity needs; the others are below it for certain. Each gets a fingerprint (SimHash over
    five-word shingles, repeats included, by running sums). Fingerprints of windows are joined on
    blocks with those of the items that they are laid for: every pair within RADIUS bits agrees in some block up
    to BLOCK_RADIUS bits, so none is missed. Of these pairs the exact weighted Jaccard similarity of
    shingle counts is computed; those of `similarity` or more are results, n_windows of them.
    Similarity, first_word and last_word are of the best window, the earliest if several tie.

    text_key is xxhash64 of the text: with the id it tells rows apart, and repeated rows give one
    result. Null and empty texts and items without words match nothing; items of under five words
    are one shingle. A null id is a value like others. Whole texts and items are read, of any length:
    no row of what is made for each word holds more than a few words of its text.
    """
    items = staged(benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).distinct().select("*", F.xxhash64("words").alias("of"), F.size("words").alias("n_item"), F.least(F.size("words"), F.lit(SHINGLE_WORDS)).alias("k")), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect()) or [SHINGLE_WORDS]
    once = items.dropDuplicates(["of"])
    grams = reduce(DataFrame.union, (word_grams(once.where(F.col("k") == k), k, ["of", "n_item", "k"]).select("of", "n_item", "k", "h") for k in sizes))
    grams = staged(grams.groupBy("of", "n_item", "k", "h").agg(F.count("*").alias("m")), "grams")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), *document_key(F.col(id_col), F.col(text_col)), words_of(F.col(text_col)).alias("words"))
    hits = staged(_item_hits(texts, grams, sizes), "hits")

    one = [F.first(c).alias(c) for c in ("id", "text_key", "n_words")]
    held = hits.groupBy("k1", "k2", "of", "n_item", "k").agg(F.array_sort(F.collect_set("pos")).alias("at"), *one)
    starts = reduce(lambda found, k: found.when(F.col("k") == k, _starts(F.col("at"), F.col("n_words"), F.col("n_item"), k, similarity)), sizes, F)
    shingles = F.least("n_words", "n_item") - F.col("k") + 1
    laid = staged(held.select("k1", "k2", "id", "text_key", "of", "n_item", "k", shingles.alias("shingles"), F.explode(starts).alias("start")), "windows")
    window = ["k1", "k2", "k", "start", "shingles"]
    prints = _window_fingerprints(texts, laid.select(*window).distinct(), sizes)

    left = laid.join(staged(prints, "prints"), window).select("k1", "k2", "of", "start", "shingles", F.col("fp").alias("wfp"), F.explode(_blocks(F.col("fp"), False)).alias("b")).select("*", "b.block", "b.value").drop("b")
    sums = grams.groupBy("of", "n_item", "k").agg(F.array(*(F.sum(v) for v in _votes(F.col("h"), F.col("m")))).alias("votes"), F.sum("m").alias("total"))
    right = staged(sums.select("of", "total", _fingerprint(F.col("votes"), F.col("total")).alias("ifp")), "prints")
    right = right.select("of", "total", "ifp", F.explode(_blocks(F.col("ifp"), True)).alias("b")).select("of", "total", "ifp", "b.block", "b.value")
    near = F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= RADIUS
    pairs = staged(left.join(right, ["of", "block", "value"]).where(near).select("k1", "k2", "of", "start", "shingles", "total").distinct(), "pairs")

    alike = _common(hits, pairs).withColumn("similarity", F.col("common") / (F.col("shingles") + F.col("total") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = F.min_by(F.struct("similarity", "start"), F.struct(-F.col("similarity"), F.col("start")))
    found = alike.groupBy("k1", "k2", "of").agg(best.alias("b"), F.count("*").alias("n_windows"))
    named = found.join(held.select("k1", "k2", "of", "id", "text_key"), ["k1", "k2", "of"]).join(items.select("of", "item", "n_item"), "of")
    return named.select("id", "text_key", "item", "b.similarity", F.col("b.start").cast("long").alias("first_word"), (F.col("b.start") + F.col("n_item") - 1).cast("long").alias("last_word"), "n_windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which find_leaks() finds no item; docs' columns only."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("_leak_id"), F.col("text_key").alias("_leak_key")).distinct()
    name = own_name(docs, "text_key")
    marked = docs.withColumn(name, F.xxhash64(F.col(text_col)))
    clean = marked.join(leaks, marked[id_col].eqNullSafe(leaks["_leak_id"]) & (marked[name] == leaks["_leak_key"]), "left_anti")
    return clean.select(*docs.columns)
