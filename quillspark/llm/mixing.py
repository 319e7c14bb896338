"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import own_name, staged, word_count

#: Bits of the seeded place of a document, and bits that one pass over the boundary resolves.
PLACE_BITS, STEP_BITS = 60, 15


def place(id_: Column, seed: str) -> Column:
    """A document's seeded place: the first 60 bits of md5(seed || ':' || id); a null id counts as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets by weight that sum to total, none above most times its size; the excess is reshared by weight."""
    targets, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while free:
        level = left / sum(weights[i] for i in free)
        full = [i for i in free if level * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = level * weights[i]
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left = total - sum(targets)
        free = [i for i in free if i not in full]
    return targets


def max_flow(edges: dict[int, list[list]], source: int, sink: int) -> int:
    """Dinic's algorithm on edges[u] = [[v, capacity, index of the reverse edge], ...], changed in place."""
    sent = 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, cap, _ in edges[u]:
                if cap > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return sent
        at = dict.fromkeys(edges, 0)
        while True:
            path, u = [], source
            while u != sink:
                while at[u] < len(edges[u]):
                    v, cap, _ = edges[u][at[u]]
                    if cap > 0 and level.get(v, -1) == level[u] + 1:
                        break
                    at[u] += 1
                else:
                    if not path:
                        break
                    u = path.pop()[0]
                    at[u] += 1
                    continue
                path.append((u, at[u]))
                u = v
            if u != sink:
                break
            push = min(edges[x][i][1] for x, i in path)
            for x, i in path:
                e = edges[x][i]
                e[1] -= push
                edges[e[0]][e[2]][1] += push
            sent += push


def route(patterns: Sequence[tuple[frozenset[int], int]], quotas: Sequence[int], most_repeats: int) -> list[dict[int, int]]:
    """For each pattern (its sources, its words) the words it sends to each source's quota.

    A min-cost flow from patterns to quotas. A pattern's first pass costs less a word than its
    second, and so on (convex costs), while all other edges are free. So the cheapest flow comes
    from opening the passes one after another and each time sending as much as fits.
    """
    n = len(patterns)
    edges: dict[int, list[list]] = {i: [] for i in range(n + len(quotas) + 2)}
    source, sink = n + len(quotas), n + len(quotas) + 1

    def join(u: int, v: int, cap: int) -> list:
        edges[u].append([v, cap, len(edges[v])])
        edges[v].append([u, 0, len(edges[u]) - 1])
        return edges[u][-1]

    supply = [join(source, i, 0) for i in range(n)]
    sent = [{s: join(i, n + s, most_repeats * words) for s in sorted(of)} for i, (of, words) in enumerate(patterns)]
    for s, q in enumerate(quotas):
        join(n + s, sink, q)
    for _ in range(most_repeats):
        for e, (_, words) in zip(supply, patterns, strict=True):
            e[1] += words
        max_flow(edges, source, sink)
    return [{s: most_repeats * patterns[i][1] - e[1] for s, e in row.items()} for i, row in enumerate(sent)]


@dataclass(frozen=True)
class Mix:
    """docs: docs with size, passes and taken; sources: of each source its key, size, target and the words routed to it."""

    docs: DataFrame
    sources: list[dict]


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    members: Column | None = None,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    most_repeats: int = 2,
    seed: str = "mix",
    most_patterns: int = 100_000,
    keep_text: bool = True,
    names: tuple[str, str, str] = ("size", "passes", "taken"),
) -> Mix:
    """Mix documents so that every source's words come near its target.

    members is an array of the sources that a document belongs to (default: its column source). A
    null element is a source of its own; an empty or null array means the null source. Sources by
    code point, null last, get the weights in turn and share budget times all words (those of a
    document in several sources count once in the total, and in each source's size); a target stops
    at most_repeats times the source's size and the excess is reshared.

    Documents are summed by membership pattern. Only these sums reach the driver, of which there
    may be at most most_patterns (else ValueError: nothing is dropped). The flow of route() gives
    the words that each pattern sends; passes over the whole pattern come first, and for the rest
    documents are taken whole in the order of their seeded place while that brings the sum nearer.
    The boundary is found by histograms over the place, STEP_BITS bits at a time, never by sorting
    a pattern. Reruns agree, and equal ids are taken alike. Null and empty texts have size 0 and
    take 0. An empty table gives an empty mix. `names` are those of the three new columns; columns of
    docs with such names are replaced.
    """
    members = members if members is not None else F.array(F.col("source"))
    size, pattern, at = own_name(docs, "size"), own_name(docs, "pattern"), own_name(docs, "place")
    listed = F.when(F.coalesce(F.size(members), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(F.sort_array(F.array_distinct(members)))
    marked = docs.withColumns({size: word_count(F.col(text_col)), pattern: listed, at: place(F.col(id_col), seed)})
    if not keep_text:
        marked = marked.drop(text_col)
    marked = staged(marked, "mix")
    sums = marked.groupBy(pattern).agg(F.sum(size).alias("words")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"over {most_patterns} membership patterns")
    sums = sorted(((tuple(r[0]), int(r["words"])) for r in sums), key=lambda x: [(s is None, s or "") for s in x[0]])
    keys = sorted({s for p, _ in sums for s in p}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(keys)}
    sizes = [sum(w for p, w in sums if s in p) for s in keys]
    total = budget * sum(w for _, w in sums)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(keys))], total, most_repeats)
    flows = route([(frozenset(index[s] for s in p), w) for p, w in sums], [round(t) for t in targets], most_repeats)
    sources = [{"source": s, "size": sizes[i], "target": targets[i], "routed": sum(f.get(i, 0) for f in flows)} for i, s in enumerate(keys)]

    plan = {p: divmod(sum(f.values()), w) if w else (0, 0) for (p, w), f in zip(sums, flows, strict=True)}
    bounds = _boundaries(marked, size, pattern, at, {p: rest for p, (_, rest) in plan.items() if rest})
    spark = docs.sparkSession
    rows = [(list(p), int(full), bounds.get(p, -1)) for p, (full, _) in plan.items()]
    table = spark.createDataFrame(rows, f"{pattern}_p array<string>, full int, upto long")
    table = F.broadcast(table) if len(rows) <= 10_000 else table
    out = marked.join(table, _text_of(pattern) == _text_of(f"{pattern}_p"), "left")
    passes = F.col("full") + (F.col(at) <= F.col("upto")).cast("int")
    kept = [c for c in docs.columns if c in marked.columns and c not in names]
    mixed = out.select(*(marked[c] for c in kept), F.col(size).alias(names[0]), passes.alias(names[1]), (F.col(size) * passes).alias(names[2]))
    return Mix(mixed, sources)


def _text_of(pattern: str) -> Column:
    """A pattern as text, in which null elements compare equal."""
    return F.to_json(F.col(pattern), {"ignoreNullFields": "false"})


def _boundaries(marked: DataFrame, size: str, pattern: str, at: str, rests: dict[tuple, int]) -> dict[tuple, int]:
    """For each pattern the last place to take, so that the words up to it come nearest to its rest.

    Each pass sums words by (pattern, next STEP_BITS bits of the place) below the prefix found so
    far, at most 2**STEP_BITS sums a pattern, and takes the first bin at which they reach the rest.
    """
    spark = marked.sparkSession
    state = {p: (0, 0) for p in rests}  # prefix, words before it
    bins = {}
    for shift in range(PLACE_BITS - STEP_BITS, -1, -STEP_BITS):
        rows = [(list(p), rests[p], prefix, before) for p, (prefix, before) in state.items()]
        if not rows:
            break
        want = spark.createDataFrame(rows, "p array<string>, rest long, prefix long, before long")
        want = F.broadcast(want) if len(rows) <= 10_000 else want
        inside = F.shiftright(F.col(at), shift + STEP_BITS) == F.col("prefix")
        part = marked.select(pattern, size, at).join(want, (_text_of(pattern) == _text_of("p")) & inside)
        sums = part.groupBy("p", "rest", "before", F.shiftright(F.col(at), shift).alias("bin")).agg(F.sum(size).alias("words"))
        upto = F.sum("words").over(Window.partitionBy("p").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
        first = sums.withColumn("upto", upto).where("upto >= rest").groupBy("p").agg(F.min_by(F.struct("bin", "upto", "words"), F.col("bin")).alias("b"))
        bins = {tuple(r["p"]): r["b"] for r in first.collect()}
        state = {p: (b["bin"], b["upto"] - b["words"]) for p, b in bins.items()}
    # The last bin is one place: it is taken if that brings the sum nearer to the rest.
    nearer = {p: 2 * (b["upto"] - b["words"]) + b["words"] < 2 * rests[p] for p, b in bins.items()}
    return {p: b["bin"] if nearer[p] else b["bin"] - 1 for p, b in bins.items()}


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its passes, none for 0; docs' columns only."""
    names = own_name(docs, "size_"), own_name(docs, "passes_"), own_name(docs, "taken_")
    mixed = mix_sources(docs, names=names, **options).docs
    return mixed.where(F.col(names[1]) > 0).withColumn(names[1], F.explode(F.sequence(F.lit(1), F.col(names[1])))).select(*docs.columns)
