"""Near-dedup at a shingle similarity: wide SimHash fingerprints, blocks and bands, exact verification.

Texts whose shingle counts have a Jaccard similarity of 0.8 differ in about 15 % of their SimHash bits.
Blocks of 24 bits and more, so that strangers seldom share one, are shared by 2 % of these pairs at most, so a few of them
link what is nearly equal, and with it most of large groups. All else meets in bands: a band's key is made of the least
of a text's shingles in ROWS random orders. Pairs at similarity 0.8 share one of the BANDS with a probability of
0.989 (at 0.85, of 0.9997), strangers share none however many there are, so the rows a text don't grow with the
number of texts. That holds for repeated shingles too, as each occurrence is a shingle of its own (numbered()).
What shares a block or band is verified by Hamming distance and then by the exact similarity, so nothing below it is
linked. In buckets of many texts that are alike but not linked, the pairs are found by their rarest shingles instead,
which loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import own_name, small_batches, staged
from quillspark.llm.components import connected_components

#: A fingerprint has LONGS longs; each of several orders of its bits is cut into blocks, so many that pairs that differ
#: in a DIFFER-th of their bits share one with probability MEET. Blocks have BLOCK_BITS bits, more for many
#: fingerprints: SPARE_BITS over the logarithm of their number, so that strangers seldom share one.
LONGS, BLOCK_BITS, SPARE_BITS, DIFFER, MEET = 16, 24, 8, 0.151, 0.96
BITS = 64 * LONGS
#: Blocks that are used: their buckets are linked through leaders first.
FIRST = 20
#: Texts of a similarity share a band with probability similarity ** ROWS.
ROWS, BANDS = 10, 40
#: Candidates differ in at most so many bits, three deviations above what a similarity of 0.8 has.
NEAR = 190
#: Buckets in which more pairs would be compared are settled by rare shingles.
CROWD = 100_000
#: Pairs that meet one copy of a node's shingles.
SHARE = 2_000
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """The XXH64 of each shingle, repeats included; of fewer words, of the whole sequence; of none, empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[:n].tolist(), ends[min(shingle_words, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=n)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """The hashes, the second and later ones of equal ones changed by their number, so that all differ: the share of what
    two texts have in common of these is the similarity of their shingle counts."""
    order = np.argsort(hashes, kind="stable")
    held = hashes[order]
    fresh = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else order
    if len(fresh) == len(held):
        return hashes
    number = np.arange(len(held)) - np.repeat(fresh, np.diff(np.append(fresh, len(held))))
    out = np.empty_like(hashes)
    out[order] = held ^ (number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """LONGS longs: a bit is 1 if set in over half of the shingles, whose hashes are mixed anew for each long."""
    votes = np.zeros(BITS, dtype=np.int64)
    mixers = np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255 * 8):
        h = hashes[at : at + 255 * 8, None] + mixers
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            votes += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A long for each band: its number and, in each of its ROWS orders, the least of the hashes, hashed. The hashes are
    ordered by their products with an odd number."""
    orders = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[at : at + 256, None] * orders).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketch(text: Column, shingle_words: int) -> Column:
    """fp: the longs of wide_simhash(), and the number of shingles; bands: band_keys()."""

    @F.pandas_udf("fp array<long>, bands array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            hashes = [numbered(shingle_hashes(t, shingle_words)) for t in s]
            yield pd.DataFrame({"fp": [np.append(wide_simhash(h), len(h)) for h in hashes], "bands": [band_keys(h) for h in hashes]})

    return of(text)


def block_bits(fingerprints: int) -> int:
    """Bits of a block for so many fingerprints."""
    return max(BLOCK_BITS, (max(1, fingerprints) - 1).bit_length() + SPARE_BITS)


def block_places(bits: int = BLOCK_BITS, seed: int = 11) -> np.ndarray:
    """A row for each block: the places of its bits."""
    rng = np.random.Generator(np.random.PCG64(seed))
    per = BITS // bits
    splits = math.ceil(math.log(1 - MEET) / math.log(1 - (1 - DIFFER) ** bits) / per)
    return np.concatenate([rng.permutation(BITS)[: per * bits].reshape(per, bits) for _ in range(splits)])


def block_keys(fp: Column, bits: int, blocks: int) -> Column:
    """An array with a long for each of the first `blocks` blocks: the block's number above its bits."""
    places = block_places(bits)[:blocks]
    powers = 1 << np.arange(bits, dtype=np.int64)
    numbers = np.arange(len(places), dtype=np.int64) << bits

    @F.pandas_udf("array<long>")
    def of(prints: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in prints:
            out = []
            for at in range(0, len(s), 128):
                longs = np.stack([x[:LONGS] for x in s.iloc[at : at + 128]])
                unpacked = np.unpackbits(longs.view(np.uint8), axis=1, bitorder="little")
                keys = np.zeros((len(longs), len(places)), dtype=np.int64)
                for bit, power in enumerate(powers):
                    keys += unpacked[:, places[:, bit]] * power
                out += list(keys + numbers)
            yield pd.Series(out)

    return of(fp)


def _distance(a: Column, b: Column) -> Column:
    """In how many bits two fingerprints differ."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, LONGS):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def _near(a: Column, b: Column, similarity: float) -> Column:
    """Whether two fingerprints are within NEAR bits, and the numbers of shingles allow the similarity."""
    return (F.least(a[LONGS], b[LONGS]) >= similarity * F.greatest(a[LONGS], b[LONGS])) & (_distance(a, b) <= NEAR)


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingles(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(node, hs) for wanted(node): the sorted hashes of the node's numbered shingles."""
    reps = _bounded(staged(nodes.join(wanted, "node", "left_semi").select("node", "rep.id", "rep.text_key"), "wanted"))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("text"))
    found = texts.join(reps, texts["_id"].eqNullSafe(reps["id"]) & (texts["_key"] == reps["text_key"])).select("node", "text")

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([np.sort(numbered(shingle_hashes(t, shingle_words)).view(np.int64)) for t in s])

    with small_batches(docs.sparkSession):
        return staged(found.select("node", of("text").alias("hs")), "shingles").dropDuplicates(["node"])


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> DataFrame:
    """Of distinct candidate pairs (u, v) of nodes those whose texts are as similar.

    A node with many pairs, as a large group's leader has, is dealt to tasks in shares of SHARE pairs.
    """
    near = staged(pairs, "near")
    wanted = near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node"))).distinct()
    found = staged(_shingles(wanted, nodes, docs, id_col, text_col, shingle_words), "hashes")
    shares = near.groupBy("u").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).where("shares > 1")
    shares = _bounded(staged(shares, "shares"))
    share = F.coalesce(F.pmod(F.xxhash64("v"), F.col("shares")), F.lit(0)).cast("int")
    dealt = near.join(shares, "u", "left").select("u", "v", share.alias("share"))
    copies = found.toDF("u", "uh").join(shares, "u", "left").select("u", "uh", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.asarray(z.values) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = dealt.join(found.toDF("v", "vh"), "v").join(copies, ["u", "share"]).select("u", "v", "uh", "vh")
    with small_batches(docs.sparkSession, 250):
        return staged(both.mapInArrow(compare, "u long, v long"), "linked")


def _led(members: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of each node v of members(key, node, component) and u, that of most degree among the nodes of other components
    that lead v's buckets (which have most degree there), if they are _near()."""
    leads = members.join(prints.select("node", "degree"), "node").groupBy("key").agg(F.max(F.struct("degree", "node", "component")).alias("lead"))
    leads = staged(leads.select(F.col("key").alias("of"), "lead"), "leads")
    led = members.join(leads, (F.col("key") == F.col("of")) & (F.col("component") != F.col("lead.component")))
    led = led.groupBy(F.col("node").alias("v")).agg(F.max("lead").getField("node").alias("u"))
    fp = prints.select("node", "fp")
    both = staged(led, "led").join(fp.toDF("v", "vfp"), "v").join(fp.toDF("u", "ufp"), "u")
    return both.where(_near(F.col("ufp"), F.col("vfp"), similarity)).select("u", "v")


def _rare(open_: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(key, node, component, n, pos) from open_(node, component): of each node's n shingles those that come first by
    frequency among these nodes and can be the first that it shares with another node of the similarity.

    If two sets of n and m have at least c in common, the first of these in any order is one of the first n - c + 1 and
    m - c + 1. Shingles of one node are counted, but can't be shared.
    """
    even = shingles.repartitionByRange(int(shingles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    each = staged(even.select("node", F.size("hs").alias("n"), F.explode("hs").alias("key")), "each")
    often = staged(each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "often")
    shared = each.join(often, "key")
    by_node = Window.partitionBy("node")
    pos = F.col("n") - F.count("*").over(by_node) + F.row_number().over(by_node.orderBy("often", "key")) - 1
    placed = shared.withColumn("pos", pos).where(F.col("pos") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-6))
    return placed.join(open_, "node").select("key", "node", "component", "n", F.col("pos").cast("int").alias("pos"))


def _across(members: DataFrame, most: DataFrame, meet: Column) -> DataFrame:
    """Distinct pairs (u, v) of members(key, node, component, ...) of different components with the same key, for which `meet` (of a and b)
    holds; most(key, most) names a component of each key, within which none is sought."""
    most = most.select(F.col("key").alias("of"), "most")
    rest = members.join(most, (F.col("key") == F.col("of")) & (F.col("component") != F.col("most"))).drop("of", "most")
    left = rest.alias("a").join(members.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & meet)
    return left.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """(key, n, in_most, most) for the keys of members(key, node, component) with several components: most is the largest, with in_most of the n members."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    found = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("groups"), F.sum("n").alias("n"))
    return found.where("groups > 1").select("key", "n", F.col("m.n").alias("in_most"), F.col("m.component").alias("most"))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """(id, text_key, component, first): for every row of docs its group and the group's first member's
    struct (id, text_key), a group being what links of `similarity` or more connect.

    Equal fingerprints are one node, shown by the document of least id (null last, then text_key).
    Nodes are joined on blocks, then on bands. A bucket's leader is the node that shares blocks with most others, which is
    near the middle of its group. In the blocks every node is a candidate with the foremost of its
    buckets' leaders. This links large groups of near copies by a few pairs a node. The same is done in those
    bands' buckets that the links leave with several groups. Then the nodes outside of a
    bucket's largest group are candidates with all nodes of its other groups, so no link between
    groups is lost. Candidates within NEAR bits are verified by _linked().

    A bucket in which over `crowd` pairs would be compared holds many texts that are alike, but
    hardly as much as sought. All nodes of such buckets are joined on their rarest shingles instead
    (_rare()), an exact filter: every pair of the similarity meets, others hardly ever.

    Null and empty texts have no shingles and are one group. Repeated rows and rows that share an id
    and a text are copies. Other columns are not read.
    """
    fp = F.xxhash64("fp").alias("node")
    with small_batches(docs.sparkSession):
        rows = staged(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), sketch(F.col(text_col), shingle_words).alias("s")).select("id", "text_key", "s.*").select("*", fp), "wide")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("text_key"))
    reps = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min_by(F.struct("id", "text_key", "bands"), order).alias("rep"))
    nodes = staged(reps.select("node", "fp", "rep.bands", F.struct("rep.id", "rep.text_key").alias("rep")), "nodes")
    given = nodes, docs, id_col, text_col, shingle_words

    bits = block_bits(nodes.count())
    first = staged(nodes.select("node", F.explode(block_keys(F.col("fp"), bits, FIRST)).alias("key")), "first")
    sizes = staged(first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    first = staged(first.join(sizes, "key"), "shared")
    prints = staged(nodes.select("node", "fp").join(first.groupBy("node").agg(F.sum("n").alias("degree")), "node", "left").fillna(0, ["degree"]), "prints")
    links = _linked(_led(first.select("key", "node", F.col("node").alias("component")), prints, similarity), *given, similarity)
    groups = connected_components(links)

    shown = staged(nodes.select("node", "bands").join(groups, "node", "left").select("node", "bands", F.coalesce("component", "node").alias("component")), "shown")
    keys = shown.select("node", "component", F.explode("bands").alias("key"))
    several = staged(keys.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key"), "several")
    members = staged(keys.join(_bounded(several), "key").select("key", "node", "component"), "members")
    links = staged(links.union(_linked(_led(members, prints, similarity).join(links, ["u", "v"], "left_anti"), *given, similarity)), "links")
    groups = connected_components(links)

    members = staged(members.drop("component").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "members")
    most = staged(_mixed(members).withColumn("crowded", (F.col("n") - F.col("in_most")) * F.col("n") > crowd), "most")
    within = members.join(prints.select("node", "fp"), "node")
    more = _across(within, most.where("not crowded"), _near(F.col("a.fp"), F.col("b.fp"), similarity))
    open_ = staged(members.join(most.where("crowded"), "key", "left_semi").select("node", "component").distinct(), "open")
    if not open_.isEmpty():
        rare = staged(_rare(open_, _shingles(open_.select("node"), *given), similarity), "rare")
        common = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))  # at most, from this shingle on
        need = similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-6
        more = more.union(_across(rare, staged(_mixed(rare), "most"), common >= need)).distinct()
    more = _linked(more, *given, similarity)
    if not more.isEmpty():
        groups = connected_components(links.union(more))

    found = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = found.groupBy("component").agg(F.min_by("rep", F.struct(F.col("rep.id").isNull(), F.col("rep.id"), F.col("rep.text_key"))).alias("first"))
    named = staged(found.select("node", "component").join(firsts, "component"), "groups")
    return rows.select("id", "text_key", "node").join(named, "node").select("id", "text_key", "component", "first")


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of similar_groups(): its first member, once. Columns stay as they are."""
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, **options)
    firsts = groups.select("first.id", "first.text_key").distinct().toDF("_first_id", "_first_key")
    name = own_name(docs, "text_key")
    marked = docs.withColumn(name, F.xxhash64(F.col(text_col)))
    kept = marked.join(firsts, marked[id_col].eqNullSafe(firsts["_first_id"]) & (marked[name] == firsts["_first_key"]), "left_semi")
    return kept.dropDuplicates([id_col, name]).select(*docs.columns)
