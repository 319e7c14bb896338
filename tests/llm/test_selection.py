"""Mixing, quality rules and sharding against brute force."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, quality, sharding


@pytest.mark.parametrize(("sizes", "want"), [([10, 10, 10], [20, 8.333333, 16.666667]), ([1, 100, 100], [2, 99.833333, 199.666667]), ([0, 5], [0, 7.5]), ([], [])])
def test_water_fill(sizes, want):
    got = mixing.water_fill(sizes, [3.0, 1.0, 2.0][: len(sizes)], 1.5 * sum(sizes), 2)
    assert got == pytest.approx(want, abs=1e-5)


def flow_cost(patterns, flows):
    return sum(max(0, sum(f.values()) - w) for (_, w), f in zip(patterns, flows))


def test_routes_are_cheapest():
    """Against all ways to route a few tokens: as much as possible, then as little repetition as possible."""
    rng = random.Random(1)
    for _ in range(25):
        patterns = [(frozenset(rng.sample(range(2), rng.randint(1, 2))), rng.randint(0, 3)) for _ in range(3)]
        quotas = [rng.randint(0, 5) for _ in range(2)]
        got = mixing.route(patterns, quotas, 2)
        for (of, w), f in zip(patterns, got):
            assert set(f) == set(of) and 0 <= sum(f.values()) <= 2 * w
        used = [sum(f.get(s, 0) for f in got) for s in range(2)]
        assert all(u <= q for u, q in zip(used, quotas))
        best = (0, 0)
        for split in product(*[[(a, b) for a in range(7) for b in range(7) if (0 in of or a == 0) and (1 in of or b == 0) and a + b <= 2 * w] for of, w in patterns]):
            a, b = sum(x for x, _ in split), sum(y for _, y in split)
            if a <= quotas[0] and b <= quotas[1]:
                best = max(best, (a + b, -sum(max(0, x + y - w) for (x, y), (_, w) in zip(split, patterns))))
        assert (sum(used), -flow_cost(patterns, got)) == best


def test_mix_meets_targets(spark, prose_of):
    rng = random.Random(2)
    docs = [(i, prose_of(i, rng.randint(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = mixing.mix_sources(df)
    got = mix.docs.collect()
    assert len(got) == 300 and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df).docs.collect()))
    taken = Counter()
    for r in got:
        assert r["size"] == len(r["text"].split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert [s["source"] for s in mix.sources] == ["a", "b", "c", None]
    for s in mix.sources:
        assert abs(taken[s["source"]] - s["target"]) <= 60


def test_overlapping_sources(spark, prose_of):
    docs = [(i, prose_of(i, 20), [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, m array<string>")
    mix = mixing.mix_sources(df, members=F.col("m"), weights=(1.0,), budget=1.2)
    total = sum(r["taken"] for r in mix.docs.collect())
    assert abs(total - sum(s["routed"] for s in mix.sources)) <= 40
    assert all(s["routed"] <= round(s["target"]) for s in mix.sources)
    with pytest.raises(ValueError):
        mixing.mix_sources(df, members=F.col("m"), most_patterns=1)


def test_mix_of_edge_cases(spark, edge, empty):
    mix = mixing.mix_sources(edge)
    assert mix.docs.count() == edge.count() and mix.docs.columns[-3:] == ["size", "passes", "taken"]
    assert mixing.mix_sources(empty).docs.count() == 0
    taken = mixing.take_mix(edge)
    assert taken.columns == edge.columns and taken.count() == mix.docs.agg(F.sum("passes")).first()[0]
    assert mixing.take_mix(empty).count() == 0


def brute_measure(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(lines), upper, upper + lower, words.count("|"))


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c a b c", "x\nx\n\n y\nx", "É # 😀 A|B c d", "aa aa aa aa aa", "THE end\r\nTHE end\r\n", "a b\x1cc d", "a | b | c\n| d |", "|x ||"])
def test_measurements(text):
    assert quality.measure(text) == brute_measure(text)


def test_tables_and_other_scripts_are_not_rejected(spark, prose_of):
    table = "\n".join(" | ".join(prose_of(i, 8).split()) for i in range(20))
    noise = " ".join(f"{w}%%%" for w in prose_of(1, 200).split())
    greek = " ".join("αβγδεζ"[i % 4 :] + str(i) for i in range(200)) + " USB"
    df = spark.createDataFrame([(1, table), (2, noise), (3, greek), (4, prose_of(2, 100).upper())], "doc_id long, text string")
    assert {r["doc_id"] for r in quality.keep_quality(df).collect()} == {1, 3}


def test_ledger_policies_and_ablations(spark, edge, empty):
    found = quality.ledger(edge)
    assert found.count() == edge.count() and {"measures", "failures"} <= set(found.columns)
    for r in found.collect():
        m = dict(zip(quality.MEASUREMENTS, brute_measure(r["text"])))
        bits = sum(1 << i for i, (_, sql) in enumerate(quality.RULES) if eval(sql.replace("AND", "and").replace("OR", "or"), {}, m))
        assert r["failures"] == bits
    kept = quality.keep_quality(edge, version="v1")
    assert kept.columns == edge.columns
    v1 = {r["rule"]: (r["n_failed"], r["n_rejected_alone"]) for r in quality.ablations(found, (quality.POLICIES["v1"],)).collect()}
    rows = [r["failures"] for r in found.collect()]
    base = quality.mask(quality.BASE)
    for rule in quality.BASE:
        bit = quality.mask((rule,))
        assert v1[rule] == (sum(f & bit > 0 for f in rows), sum(f & base == bit for f in rows))
    assert quality.ledger(empty).count() == 0 and quality.keep_quality(empty).count() == 0
    tally = found.where(quality.verdict(F.col("failures"), quality.POLICIES["v3"])).count()
    assert tally >= found.where(quality.verdict(F.col("failures"), quality.POLICIES["v2"])).count()


def shard(df, **options):
    marked, dims = sharding.with_metadata(df)
    return sharding.kd_shards(marked, size=F.octet_length(F.coalesce("text", F.lit(""))) + 1, tie=F.xxhash64("doc_id", "text"), dimensions=[F.col(d) for d in dims], drop=dims, **options)


def serial_tree(rows, first, leaves):
    """{row's name: leaf} of rows (name, size, keys), by recursion."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    spread = [max(r[2][i] for r in rows) - min(r[2][i] for r in rows) for i in range(len(rows[0][2]))]
    dim = spread.index(max(spread))
    want, upto, cut = sum(r[1] for r in rows) * (leaves // 2) // leaves, 0, None
    for key in sorted({r[2][dim] for r in rows}):
        size = sum(r[1] for r in rows if r[2][dim] == key)
        if upto + size >= want:
            cut = key if 2 * upto + size < 2 * want else key - 1
            break
        upto += size
    half = leaves // 2
    return serial_tree([r for r in rows if r[2][dim] <= cut], first, half) | serial_tree([r for r in rows if r[2][dim] > cut], first + half, leaves - half)


@pytest.mark.parametrize("shards", [2, 7, 16])
def test_shards_against_a_serial_tree(spark, prose_of, shards):
    rng = random.Random(shards)
    docs = [(i, prose_of(i, rng.randint(0, 50)) + "é" * rng.randint(0, 30), rng.choice(["en", "fr", None]), rng.choice("abcdef")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    marked, dims = sharding.with_metadata(df)
    found = marked.select("doc_id", F.octet_length("text") + 1, F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 20) - 1)), *dims).collect()
    lo, hi = ([f(r[3 + i] for r in found) for i in range(len(dims))] for f in (min, max))
    keys = lambda r: [int((x - a) / (b - a) * 4095) << 20 | r[2] for x, a, b in zip(r[3:], lo, hi, strict=True)]
    want = serial_tree([(r[0], r[1], keys(r)) for r in found], 0, shards)
    assert {r["doc_id"]: r["shard"] for r in shard(df, shards=shards).collect()} == want
    assert len({hi[i] > lo[i] for i in range(len(dims))}) == 1 and {r["doc_id"] for r in shard(df, shards=1).collect()} == set(want)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_even_and_slots_gapless(spark, prose_of, shards):
    rng = random.Random(3)
    docs = [(i, prose_of(i, rng.randint(0, 50)), rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = sharding.with_slots(shard(df, shards=shards), order=[F.col("doc_id")], rows_a_block=7).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        assert r["size"] == len(r["text"].encode()) + 1
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(shards)) and len(out) == 600
    assert max(sizes.values()) - min(sizes.values()) <= 5 * 400
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_by_target_bytes_and_edge_cases(spark, edge, empty):
    total = sum(len((r["text"] or "").encode()) + 1 for r in edge.collect())
    out = shard(edge, target_bytes=total // 4 + 1)
    rows = out.collect()
    assert len(rows) == edge.count() and {r["shard"] for r in rows} <= {0, 1, 2, 3}
    slotted = sharding.with_slots(out, order=[F.col("doc_id"), F.xxhash64("text")])
    assert sorted(slotted.columns) == sorted(edge.columns) and slotted.count() == edge.count()
    assert sharding.with_slots(shard(empty, shards=16), order=[F.col("doc_id")]).count() == 0
