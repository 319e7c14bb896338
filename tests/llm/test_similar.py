"""Near-dedup at a shingle similarity against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import similar
from tests.llm.test_dedup import union_find


def shingles(text, k=5):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or Counter([tuple(words)] if words else [])


def similarity(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [similar.CROWD, 0])
def test_groups_against_brute_force(spark, prose_of, crowd):
    rng = random.Random(7)
    texts = [prose_of(i, rng.randint(60, 200)) for i in range(25)]
    texts += [edited(rng, texts[i % 25], rng.randint(0, 6)) for i in range(50)]
    hub = prose_of(99, 150)
    texts += [edited(rng, hub, rng.randint(0, 2)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in similar.similar_groups(df, crowd=crowd).collect()}
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    want = union_find(range(len(texts)), links)
    groups = lambda of: {frozenset(i for i in of if of[i] == c) for c in of.values()}
    assert all(len({want[i] for i in g}) == 1 for g in groups(got))  # nothing below the similarity is linked
    together = sum(got[i] == got[j] for i, j in links)
    assert together >= 0.95 * len(links)
    kept = similar.drop_similar(df, crowd=crowd).collect()
    assert {r["doc_id"] for r in kept} == {min(g) for g in groups(got)}


def test_near_copies_with_repeated_lines(spark, prose_of):
    footer = prose_of(77, 14)
    pairs = [(prose_of(200 + i, 300), " ".join([prose_of(200 + i, 300), *[footer] * 4])) for i in range(20)]
    assert all(similarity(shingles(a), shingles(b)) >= 0.8 for a, b in pairs)
    fp = lambda t: np.unpackbits(similar.wide_simhash(similar.numbered(similar.shingle_hashes(t, 5))).view(np.uint8))
    assert all((fp(a) != fp(b)).sum() <= similar.NEAR for a, b in pairs)
    df = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in similar.similar_groups(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(20)) >= 19
    h = np.array([7, 5, 7, 7, 5, 1], dtype=np.uint64)
    assert len(set(similar.numbered(h).tolist())) == 6 and (np.sort(similar.numbered(h)) == np.sort(similar.numbered(h[::-1]))).all()


def test_wide_fingerprints():
    h = similar.shingle_hashes("a b c d e f g h", 5)
    assert len(h) == 4 and len(similar.shingle_hashes("a b", 5)) == 1 and len(similar.shingle_hashes(" ", 5)) == 0
    many = np.arange(70_000, dtype=np.uint64) ** 3
    fp = similar.wide_simhash(many)
    assert fp.shape == (similar.LONGS,) and not similar.wide_simhash(h[:0]).any()
    assert (similar.wide_simhash(many[:1]) == similar.wide_simhash(np.repeat(many[:1], 3))).all()
    places = similar.block_places()
    assert places.shape == (168, 24) and all(len(set(places[i : i + 42].ravel())) == 1008 for i in range(0, 168, 42))
    assert [similar.block_bits(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 10**9)] == [24, 24, 24, 25, 38]
    for bits in (26, 38):
        many = similar.block_places(bits)
        assert 1 - (1 - 0.849**bits) ** len(many) >= 0.96


def test_edge_cases(spark, edge, empty):
    got = similar.similar_groups(edge).collect()
    assert len(got) == edge.count()
    kept = similar.drop_similar(edge)
    assert kept.columns == edge.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(set(texts)) and sum(not (t or "").strip() for t in texts) == 1
    assert similar.drop_similar(empty).count() == 0 and similar.similar_groups(empty).count() == 0


def test_recall_between_80_and_85_hundredths(spark, prose_of):
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 500:
        words = prose_of(10_000 + len(pairs), rng.randint(80, 240)).split()
        other = list(words)
        while (alike := similarity(shingles(" ".join(words)), shingles(" ".join(other)))) > 0.85:
            other[rng.randrange(len(other))] = f"w{rng.randrange(10**6)}"
        if alike >= 0.8:
            pairs.append((" ".join(words), " ".join(other)))
    df = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in similar.similar_groups(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(500)) >= 475


def test_a_crowd_whose_leader_is_at_its_edge(spark, prose_of):
    rng = random.Random(6)
    base = prose_of(400, 150)
    texts = [edited(rng, base, rng.randint(0, 9)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(120) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    for crowd in (0, 1_000_000):
        got = {r["id"]: r["component"] for r in similar.similar_groups(df, crowd=crowd).collect()}
        assert sum(got[i] == got[j] for i, j in links) >= 0.97 * len(links)


def test_recall_just_above_80_hundredths(spark, prose_of):
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 400:
        words = prose_of(20_000 + len(pairs), rng.randint(300, 400)).split()
        other = list(words)
        while (alike := similarity(shingles(" ".join(words)), shingles(" ".join(other)))) > 0.815:
            other[rng.randrange(len(other))] = f"w{rng.randrange(10**6)}"
        if alike >= 0.8:
            pairs.append((" ".join(words), " ".join(other)))
    df = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in similar.similar_groups(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(400)) >= 393


def test_rows_of_a_text_in_a_crowd_of_alike_texts(spark, prose_of, monkeypatch):
    """Texts that are alike, but mostly not linked, make no more rows each than there are bands, and lose no link for it."""
    rng = random.Random(9)
    base = prose_of(500, 300)
    texts = [edited(rng, base, rng.randint(2, 7)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, staged = {}, similar.staged

    def counted(frame, tag):
        out = staged(frame, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(similar, "staged", counted)
    got = {r["id"]: r["component"] for r in similar.similar_groups(df).collect()}
    assert 0 < rows["members"] <= 40 * rows["nodes"]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(300) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)


def test_bands():
    h = similar.shingle_hashes("a b c d e f g h i j", 5)
    keys = similar.band_keys(h)
    assert keys.shape == (40,) and keys.dtype == np.int64 and len(set(keys.tolist())) == 40
    assert (similar.band_keys(h[::-1]) == keys).all() and len(similar.band_keys(h[:0])) == 40
    rng = np.random.Generator(np.random.PCG64(4))
    shared = []
    for _ in range(500):
        each = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        shared.append((similar.band_keys(each[:270]) == similar.band_keys(each[30:])).sum())  # 240 of 300 in common
    assert abs(np.mean(shared) - 40 * 0.8**10) < 0.5 and np.mean(np.array(shared) > 0) >= 0.975
