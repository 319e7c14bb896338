"""SimHash near-dedup, substring dedup and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash, spans, substrings, suffixes
from quillspark.llm.components import connected_components


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == union_find(nodes, [x for x in links if x[0] != x[1]])


def test_no_links_no_components(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_simhash(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints(spark, edge):
    got = edge.select("text", simhash.fingerprint(F.col("text"), 3).alias("f"), F.xxhash64("text").alias("x")).collect()
    for r in got:
        assert r["f"] & (1 << 64) - 1 == plain_simhash(r["text"], 3)


@pytest.mark.parametrize(("radius", "pairwise"), [(2, 32), (2, 1), (1, 1), (0, 32)])
def test_close_links(spark, radius, pairwise):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, pairwise)
    got = union_find(signed, [(r["u"], r["v"]) for r in links.collect()])
    want = union_find(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius])
    assert got == want


def test_near_duplicate_groups(spark, edge, empty, prose_of):
    got = simhash.near_duplicate_groups(edge, shingle_words=3).collect()
    assert len(got) == edge.count()
    by = {(r["id"], r["fp"]): r["component"] for r in got}
    assert by[4, got[[r["id"] for r in got].index(4)]["fp"]] == 4 and [r["component"] for r in got if r["id"] == 5] == [4]
    blank = {r["component"] for r in got if r["fp"] == 0}
    assert blank == {1}  # null and empty texts are linked, the null id giving way
    assert simhash.near_duplicate_groups(empty).count() == 0


def test_one_of_each_group_stays(spark, edge, empty):
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(set(texts)) and sum(not (t or "").strip() for t in texts) == 1
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_chunks_resist_an_insertion(prose_of):
    raw = prose_of(5, 2000).encode()
    pieces = lambda b: {b[x:y] for ends in [substrings.chunk_ends(b)] for x, y in zip([0, *ends[:-1]], ends)}
    a, b = pieces(raw), pieces(raw[:100] + b"inserted here" + raw[100:])
    assert len(a & b) > 0.97 * len(a)
    ends = substrings.chunk_ends(raw)
    assert ends == sorted(set(ends)) and ends[-1] == len(raw) and max(y - x for x, y in zip([0, *ends], ends)) <= substrings.MOST
    assert substrings.chunk_ends(b"") == [] and substrings.chunk_ends(b"ab") == [2]


def test_repeated_passages_are_found_and_clean_texts_left(spark, prose_of):
    passages = [prose_of(50 + i, 70) for i in range(20)]
    docs = [(i, prose_of(100 + i, 120)) for i in range(60)]
    dirty = {2 * i: passages[i] for i in range(20)} | {2 * i + 1: passages[i] for i in range(20)}
    docs = [(i, f"{t[:300]} {dirty[i]} {t[300:]}" if i in dirty else t) for i, t in docs]
    got = {r["id"]: r for r in substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["n_repeated"]} == set(dirty)
    text = dict(docs)
    for i, r in got.items():
        raw = text[i].encode()
        assert r["kept"] == spans.cut(raw, [(s["start"], s["end"]) for s in r["spans"]]) and r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest()
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"])
    assert sum(r["n_removed"] > 0 for r in got.values()) == 20  # the first occurrence stays


def test_passages_are_found_in_any_surroundings(prose_of):
    rng = random.Random(3)
    keys = lambda text: {text[a:b] for a, b in substrings.passages(text)}
    for i in range(300):
        shared = prose_of(5000 + i, 90).encode()[: substrings.PASSAGE + 2 * (substrings.SPAN - 1)]
        texts = [prose_of(seed, 40).encode()[: rng.randint(0, 150)] + shared + prose_of(seed + 1, 40).encode() for seed in (9000 + 4 * i, 9002 + 4 * i)]
        assert keys(texts[0]) & keys(texts[1])


def test_first_occurrence_stays_whole(spark):
    r = substrings.dedup_substrings(spark.createDataFrame([(1, "a" * 5000)], "doc_id long, text string")).collect()[0]
    assert r["n_repeated"] == 5000 and substrings.PASSAGE <= len(r["kept"]) <= 2 * substrings.PASSAGE
    assert spans.without([(0, 10), (20, 30)], [(2, 4), (8, 22), (29, 40)]) == [(0, 2), (4, 8), (22, 29)]


def brute_substrings(docs, keys):
    """{id: (n_repeated, kept)} of docs (id, bytes) by the definition: passages that occur twice, the first of the least key stays."""
    found = [(keys[i], a, b, raw[a:b], i) for i, raw in docs for a, b in substrings.passages(raw)]
    counts = Counter(x[3] for x in found)
    first = {}
    for x in sorted(found):
        first.setdefault(x[3], x)
    out = {}
    for i, raw in docs:
        mine = [x for x in found if x[4] == i and counts[x[3]] > 1]
        cover = lambda xs: {p for x in xs for p in range(x[1], x[2])}
        held = cover([x for x in mine if first[x[3]] is x])
        gone = cover([x for x in mine if first[x[3]] is not x]) - held
        out[i] = len(cover(mine)), bytes(b for p, b in enumerate(raw) if p not in gone)
    return out


@pytest.mark.parametrize(("parts", "part"), [(substrings.PARTS, substrings.PART), (10**9, 1)])
def test_substrings_against_brute_force(spark, prose_of, parts, part, monkeypatch):
    monkeypatch.setattr(substrings, "PARTS", parts)
    monkeypatch.setattr(substrings, "PART", part)
    rng = random.Random(12)
    blocks = [prose_of(300 + i, rng.randint(20, 120)) for i in range(12)]
    docs = [(i, " ".join([*rng.sample(blocks, rng.randint(0, 3)), prose_of(600 + i, rng.randint(0, 60)), *rng.sample(blocks, rng.randint(0, 2))])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keys = {r["doc_id"]: r["k1"] for r in df.select("doc_id", spans.document_key(F.col("doc_id"), F.col("text"))[0]).collect()}
    want = brute_substrings([(i, t.encode()) for i, t in docs], keys)
    got = {r["id"]: (r["n_repeated"], r["kept"]) for r in substrings.dedup_substrings(df).collect()}
    assert got == want


def test_a_passage_again_16_mib_later(spark, prose_of):
    passage = prose_of(8, 200)
    filler = "".join(chr(97 + i * i % 23) + str(i) + " " for i in range(2_000_000))[: (1 << 24) - len(passage)]
    r = substrings.dedup_substrings(spark.createDataFrame([(1, passage + filler + passage)], "doc_id long, text string"), keep_bytes=False).collect()[0]
    assert r["n_repeated"] >= 2 * (len(passage) - 128) and abs(r["n_removed"] - len(passage)) <= 128


def test_substrings_of_edge_cases(spark, edge, empty):
    got = substrings.dedup_substrings(edge).collect()
    assert len(got) == edge.count() and substrings.dedup_substrings(empty).count() == 0
    copies = [r for r in got if r["id"] in (4, 5)]
    assert all(r["n_repeated"] == r["n_bytes"] for r in copies) and {r["n_removed"] for r in copies} == {0, copies[0]["n_bytes"]}
    assert all(r["n_bytes"] == r["n_removed"] == 0 for r in got if r["id"] in (1, 3))


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_sorting(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab" if seed % 2 else b"abcd\xff") for _ in range(rng.randint(0, 150)))
    for depth in (1, 4, 200):
        got = suffixes.two_stage_suffix_array(text, depth).tolist()
        assert sorted(got) == list(range(len(text)))
        keys = [text[i : i + depth] for i in got]
        assert keys == sorted(keys)


def brute_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        out.append(bytes(b for b, x in zip(r, hit) if not x))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_sorting_the_first_windows_only(seed):
    rng = random.Random(seed)
    pieces = [bytes(rng.choice(b"ab" if seed % 2 else b"aaab") for _ in range(rng.randint(12, 60))) for _ in range(rng.randint(1, 9))]
    counts = [rng.randint(1, len(p) - 11) for p in pieces]
    text = suffixes.SEPARATOR.join(pieces) + suffixes.SEPARATOR
    begins = [0, *np.cumsum([len(p) + 1 for p in pieces]).tolist()]
    places = [b + i for b, n in zip(begins, counts, strict=False) for i in range(n)]
    for length, got in zip((16, 12), suffixes.repeated_starts(pieces, counts, (16, 12)), strict=True):
        fit = [p for p in places if suffixes.SEPARATOR not in text[p : p + length]]
        many = Counter(text[p : p + length] for p in fit)
        assert got.tolist() == [p for p in fit if many[text[p : p + length]] > 1]


@pytest.mark.parametrize("seed", range(30))
def test_pieces_do_not_depend_on_blocks(seed):
    rng = random.Random(seed)
    raw = b"".join(rng.choice([b"ab", b"a", b"b" * 40, bytes(rng.choice(b"abcd") for _ in range(30))]) * rng.randint(1, 60) for _ in range(12))
    whole = suffixes.pieces_of(raw, 40, 24, 8, 1 << 20)
    assert suffixes.pieces_of(raw, 40, 24, 8, 37) == whole
    assert [p[2] for p in whole] == [0, *np.cumsum([p[3] for p in whole]).tolist()][: len(whole)] and sum(p[3] for p in whole) == max(0, len(raw) - 23)


@pytest.mark.parametrize("sort_bytes", [1 << 20, 60])
def test_suffix_dedup_against_brute_force(spark, sort_bytes):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 40)))
    shared = [word() * 3 for _ in range(8)]
    texts = ["".join(rng.choice([word(), rng.choice(shared), "ab" * rng.randint(1, 30), "a" * rng.randint(1, 50)]) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    texts += [None, "", "xyz", texts[3], texts[3], texts[5]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r for r in suffixes.remove_repeats(df, length=24, gram=8, sort_bytes=sort_bytes).collect()}
    for i, want in enumerate(brute_removal(texts, 24)):
        assert got[i]["kept"] == want and got[i]["n_removed"] == got[i]["n_repeated"] == got[i]["n_bytes"] - len(want)
    both = {r["id"]: r for r in suffixes.remove_repeats(df, length=30, report=14, gram=8, sort_bytes=sort_bytes).collect()}
    for i, (gone, said) in enumerate(zip(brute_removal(texts, 30), brute_removal(texts, 14), strict=True)):
        assert both[i]["kept"] == gone and both[i]["n_repeated"] == both[i]["n_bytes"] - len(said)


def test_suffix_dedup_of_edge_cases(spark, edge, empty):
    got = suffixes.remove_repeats(edge).orderBy("id").collect()
    want = Counter(hashlib.sha256(x).hexdigest() for x in brute_removal([r["text"] for r in edge.collect() if len(r["text"] or "") < 20_000], 400))
    assert len(got) == edge.count() and suffixes.remove_repeats(empty).count() == 0
    assert want - Counter(r["kept_sha256"] for r in got) == Counter()
    with pytest.raises(ValueError):
        suffixes.remove_repeats(edge, gram=7)
