"""Phrases, resampling and exact search against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import importance, phrases, topk
from quillspark.llm._common import staged


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_phrases(rows, least, best=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for i in range(len(words)) for k in range(1, 6) if i + k <= len(words))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    gone = {(lang, p[a:b]) for (lang, p), v in found.items() for a in range(len(p)) for b in range(a + 2, len(p) + 1) if b - a < len(p) and v >= f[lang, p[a:b]]}
    by_lang = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, all_ in by_lang.items() for i, (score, a, p, left, right) in enumerate(sorted(all_)[:best]))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = ["of", "the", "New", "york", "city", "à", "b\x01", "b", "\x02", "is"] + [f"w{i}" for i in range(20)]
    made = []
    for i in range(150):
        parts = [str(rng.choice(words)) for _ in range(int(rng.integers(0, 60)))]
        for at in rng.integers(0, len(parts) + 1, 3):
            parts[at:at] = ["New", "York", "City"] if rng.random() < 0.7 else ["of", "the"]
        made.append(("".join(p + str(rng.choice([" ", "  ", "\t", ", ", ".", "\r\n", " "])) for p in parts), ["en", "fr", None][i % 3]))
    return made + [("", "en"), (None, "en"), (" . ", "de"), ("a a a a a a a a a a a a", "it")]


@pytest.mark.parametrize(("shard", "slice_", "files"), [(1_000_000, 1 << 20, 1), (40, 16, 6), (7, 3, 3)])
def test_collocations_against_brute_force(spark, monkeypatch, texts, shard, slice_, files):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "COUNT_WORDS", shard)
    monkeypatch.setattr(phrases, "LOOKUP_WORDS", max(5, shard // 3))
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_)
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(files)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=4).collect())
    want = brute_phrases(texts, 4)
    assert got == want and len(want) > 30


def test_a_task_writes_equal_paths_of_its_tries_once(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 50)
    bits = np.full(1 << phrases.CELL_BITS - 3, 255, dtype=np.uint8)
    batch = pa.record_batch([pa.array(["en"] * 40), pa.array([b"New York city. of the city"] * 40)], names=["lang", "text"])
    for most, times in ((1_000_000, 1), (4, 10)):  # where more are held, they are written before
        monkeypatch.setattr(phrases, "HELD_NODES", most)
        out = pa.Table.from_batches(phrases._serialise(bits, 3)(iter([batch]))).to_pylist()
        found = Counter()
        for r in out:
            found[tuple(r["path"])] += r["f"]
        assert found == {("new",): 40, ("york",): 40, ("city",): 80, ("of",): 40, ("the",): 40, ("new", "york"): 40, ("york", "city"): 40, ("of", "the"): 40, ("the", "city"): 40, ("new", "york", "city"): 40, ("of", "the", "city"): 40}
        assert (len(out) == len(found)) == (times == 1)


def test_tries_follow_the_words_not_the_files(spark, texts):
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(40)
    written = []

    def kept(df, tag):
        out = staged(df, tag)
        written.append((tag, out.count(), out.select("lang", "path").distinct().count())) if tag == "tries" else None
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "staged", kept)
        phrases.phrase_counts(docs, text="text", lang="lang", least=4)
    [(_, nodes, different)] = written
    assert nodes <= spark.sparkContext.defaultParallelism * different


def test_collocations_keep_the_best(spark, texts):
    docs = spark.createDataFrame(texts, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=3, best=5).collect()) == brute_phrases(texts, 3, 5)


def test_scores_pass_64_bits(spark):
    """One phrase in a corpus of counts near 2^32, told apart by a unit."""
    n, f = 40_000_000_000, 8_000_000_000
    nodes = spark.createDataFrame([("en", ["a"], f, []), ("en", ["b"], f - 1, []), ("en", ["a", "b"], f - 2, [f])], "lang string, path array<string>, f long, lefts array<long>")
    full = phrases._with_rests(nodes, 2).where("size(path) = 2").first()
    assert (full["lefts"], full["rights"]) == ([f], [f - 1])
    assert 1000 * (f - 2) * n > 2**64
    got = spark.sql(f"SELECT CAST(1000BD * CAST({f - 2}L AS DECIMAL(19,0)) * CAST({n}L AS DECIMAL(19,0)) AS DECIMAL(38,0)) DIV (CAST({f}L AS DECIMAL(19,0)) * CAST({f - 1}L AS DECIMAL(19,0))) AS s").first()["s"]
    assert got == 1000 * (f - 2) * n // (f * (f - 1))


def test_collocations_of_edge_cases(spark, edge, empty):
    got = sorted(tuple(r) for r in phrases.collocations(edge, least=20).collect())
    assert got == brute_phrases([(r["text"], r["lang"]) for r in edge.collect()], 20)
    assert any(r[2] == "aaaa aaaa" for r in got)
    assert phrases.collocations(empty).count() == 0


def test_walk_knows_what_begins_before_its_range(spark):
    import pandas as pd

    part = pd.DataFrame({"lang": ["en"] * 3, "path": [["a", "b", "c"], ["a", "c"], ["b"]], "f": [4, 5, 6]})
    assert [list(x) for x in next(phrases.walk(iter([part])))["lefts"]] == [[None, None], [None], []]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(rows, target):
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for r in found for b in r[2]), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, drawn[: 5 * len(drawn) // 100]


def test_resampling_against_brute_force(spark, prose_of, monkeypatch):
    rows = [(i, prose_of(i % 90, i % 45) + (" Ünï-code 3x" if i % 7 == 0 else "")) for i in range(400)] + [(1000 + i, None if i % 2 else "") for i in range(4)]
    target = [prose_of(i, 30) for i in range(5)] + [None, ""]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    out, drawn = brute_resample(rows, target)
    ranks = {r[0]: i + 1 for i, r in enumerate(drawn)}
    want = sorted((*r, ranks.get(r[0], 0)) for r in out)
    got = importance.resample(docs, wanted)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((*tuple(r)[:5], r["rank"] or 0) for r in got.collect()) == want and len(drawn) > 5
    monkeypatch.setattr(importance, "STREAM", 40)
    small = importance.packed_features(docs, id_col="doc_id", stream=40)
    assert small.count() > 50 and importance.bucket_counts(small) == Counter(b for i, t in rows for b in features(t)[1])


def test_resampling_of_edge_cases(spark, edge, empty):
    target = spark.createDataFrame([], "text string")
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    out, _ = brute_resample(rows, [])
    got = importance.resample(edge, target).collect()
    assert sorted((r["doc_id"] or -1, r["n_features"], r["weight"], r["score"]) for r in got) == sorted((i or -1, f, w, s) for i, _, f, w, s in out)
    assert importance.resample(empty, target).count() == 0
    many = spark.createDataFrame([(7, "a b c d " * 10)] * 50, "doc_id long, text string")  # one score for all
    assert sorted(r["rank"] or 0 for r in importance.resample(many, target).collect()) == [0] * 48 + [1, 2]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8])
def test_features_in_slices(monkeypatch, n):
    monkeypatch.setattr(importance, "SLICE", 3)
    text = " ".join(f"W{i}é" for i in range(n))
    size, codes = importance.features(text)
    assert (size, sorted(codes.tolist())) == (n, sorted(features(text)[1]))


def brute_search(rows, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x * 1024) for x in v)]
    out = []
    for a, (query, q) in enumerate(usable):
        if query is None or query % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v)), i is None, i or 0) for b, (i, v) in enumerate(usable) if b != a)
        out += [(query, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "slab", "files"), [(8 << 20, 8 << 20, 1), (4096, 700, 3)])
def test_search_against_brute_force(spark, monkeypatch, block, slab, files):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "SLAB_BYTES", slab)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(800)]
    rows += [(900 + i, rows[i][1]) for i in range(60)]  # ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(files)
    exact = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = sorted((tuple(r) for r in topk.top_k(vectors).collect()), key=str)
    assert got == brute_search(exact) and len(got) == 90


def test_search_reads_no_more_than_it_needs():
    """Rows far from all others settle a query before its lists end."""
    rng = np.random.default_rng(5)
    block = np.floor(rng.normal(0, 20, (2000, 8)))
    block[:5] = 1000
    found = list(topk.qualifying(block, block[:1], np.array([-np.inf]), np.array([0]), 3))
    assert found[0][1].tolist()[:4] == [1, 2, 3, 4] and len(found[0][1]) <= 24


def test_search_of_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [5.0, 5.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (100, []), (7, [-0.0001, 3.0]), (8, [1.0]), (200, [1e300, -1e300]), (9, [1e300, 1e300]), (300, [3.0, 1.0, 4.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    long = (1 << 63) - 1
    want = sorted(((q, r, i, max(-long - 1, min(long, s))) for q, r, i, s in brute_search(rows)), key=str)
    got = sorted((tuple(r) for r in topk.top_k(vectors).collect()), key=str)
    assert [r for r in got if r[0] != 200] == [r for r in want if r[0] != 200]
    assert {r[2] for r in got if r[0] == 200} == {r[2] for r in want if r[0] == 200}  # clipped scores tie by id
    assert topk.top_k(vectors.limit(0)).count() == 0
    assert [tuple(r) for r in topk.top_k(vectors.where("vec_id = 300")).collect()] == []
