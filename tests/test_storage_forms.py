"""Vector files by row, tables in buckets, and latent semantic vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import buckets, semantic, terms
from quillspark.sources import npy

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i4", "<i8"])
def test_npy_rows_equal_numpy(spark, tmp_path, kind):
    x = (np.random.default_rng(1).normal(0, 100, (1000, 7))).astype(kind)
    np.save(f"{tmp_path}/x.npy", x)
    df = npy.read_npy(spark, f"{tmp_path}/x.npy", partitionBytes=7 * 8 * 100)
    assert df.rdd.getNumPartitions() >= 5
    got = df.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1000)) and np.array_equal(np.array([r["vector"] for r in got], dtype=kind), x)


def test_npy_reads_only_what_is_asked(spark, tmp_path):
    x = np.arange(5000, dtype=np.float32).reshape(1000, 5)
    np.save(f"{tmp_path}/x.npy", x)
    reader = npy.NpyReader({"path": f"{tmp_path}/x.npy", "partitionBytes": "2000"})
    assert len(reader.partitions()) == 10
    list(reader.pushFilters([npy.GreaterThanOrEqual(("row",), 310), npy.LessThan(("row",), 330), npy.EqualTo(("other",), 1)]))
    assert reader.partitions() == [npy.Rows(310, 330)]
    list(reader.pushFilters([npy.In(("row",), (312, 315))]))
    assert reader.partitions() == [npy.Rows(312, 316)]
    df = npy.read_npy(spark, f"{tmp_path}/x.npy").where("row BETWEEN 310 AND 312")
    assert [r["vector"] for r in df.orderBy("row").collect()] == x[310:313].tolist()
    part = npy.read_npy(spark, f"{tmp_path}/x.npy", firstRow=990)
    assert part.count() == 10


def test_npy_head(spark, tmp_path):
    np.save(f"{tmp_path}/v.npy", np.arange(3.0))
    assert [tuple(r) for r in npy.read_npy(spark, f"{tmp_path}/v.npy").collect()] == [(0, [0.0]), (1, [1.0]), (2, [2.0])]
    np.save(f"{tmp_path}/none.npy", np.zeros((0, 4)))
    assert npy.read_npy(spark, f"{tmp_path}/none.npy").count() == 0
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(np.zeros((3, 4))))
    (tmp_path / "no.npy").write_bytes(b"something else")
    for name in ("f", "no"):
        with pytest.raises(ValueError):
            npy.header(f"{tmp_path}/{name}.npy")


def test_npy_written_and_read(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").repartition(3)
    index = npy.write_npy(e, "vec_id", "embedding", f"{tmp_path}/m").collect()
    want = {r["vec_id"]: r["embedding"] for r in e.collect()}
    assert len(index) == len(want) and len({r["file"] for r in index}) == 3
    for r in index[:20]:
        assert np.load(r["file"])[r["row"]].tolist() == want[r["vec_id"]]


def test_tables_in_buckets_need_no_exchange(spark, tmp_path):
    reviews = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("at"), (F.col("id") * 31 % 997).alias("v"))
    games = spark.range(700).select(F.col("id").alias("k"), (F.col("id") % 9).alias("kind"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = buckets.store(reviews, "quill_reviews", "k", 4, f"{tmp_path}/a")
        b = buckets.store(games, "quill_games", "k", 4, f"{tmp_path}/b")
        chain = lambda r, g: buckets.keep_first(r, "k", [-F.col("at")]).join(g, "k").groupBy("k").agg(F.sum("v").alias("s"), F.max("kind").alias("kind"))
        got, plain = chain(a, b), chain(reviews, games)
        assert buckets.exchanges(got) == 0 and buckets.exchanges(plain) >= 2
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS quill_reviews")
        spark.sql("DROP TABLE IF EXISTS quill_games")


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+"), lambda w: F.length(w) > 1).alias("words"))
    tf = terms.term_frequencies(docs, "doc_id", "words")
    vocab = terms.vocabulary(terms.term_counts(tf), docs.count(), min_df=4, max_features=600)
    path = str(tmp_path_factory.mktemp("lsa"))
    semantic.sparse_rows(terms.weights(tf, vocab, "doc_id"), vocab, "doc_id").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    n_terms = vocab.count()
    dense = {r["doc_id"]: np.bincount(r["idx"], r["w"], n_terms) for r in rows.collect()}
    return rows, n_terms, dense


def test_subspace_is_that_of_the_singular_vectors(spark, matrix, tmp_path):
    rows, n_terms, dense = matrix
    a = np.array(list(dense.values()))
    model = semantic.fit(rows, n_terms, size=12, passes=8)
    exact = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values[:8], exact[1][:8], rtol=1e-3)
    best = (exact[1][:12] ** 2).sum()
    assert np.linalg.norm(a @ model.directions) ** 2 > 0.995 * best
    assert np.allclose(model.directions.T @ model.directions, np.eye(12), atol=1e-8)
    top = exact[2][:3].T  # well apart from the rest
    assert np.linalg.svd(top.T @ model.directions)[1].min() > 0.999
    raw = {r["doc_id"]: r["vector"] for r in model.embed(rows, "doc_id", unit=False).collect()}
    assert all(np.allclose(raw[i], dense[i] @ model.directions) for i in dense)
    model.save(spark, f"{tmp_path}/m")
    again = semantic.SemanticModel.load(spark, f"{tmp_path}/m")
    assert np.array_equal(again.directions, model.directions) and np.array_equal(again.values, model.values)


def test_vectors_resume_by_bucket(spark, matrix, tmp_path):
    rows, n_terms, dense = matrix
    model = semantic.fit(rows, n_terms, size=5, passes=1)
    assert semantic.embed_by_bucket(model, rows, "doc_id", f"{tmp_path}/v", buckets=3) == 3
    assert semantic.embed_by_bucket(model, rows, "doc_id", f"{tmp_path}/v", buckets=3) == 0
    got = {r["doc_id"]: r["vector"] for r in spark.read.parquet(f"{tmp_path}/v").collect()}
    assert got.keys() == dense.keys() and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())


def test_semantic_edge_cases(spark):
    none = spark.createDataFrame([], "id int, idx array<int>, w array<double>")
    model = semantic.fit(none, 5, size=2)
    assert model.directions.shape == (5, 2) and model.values.tolist() == [0.0, 0.0]
    bare = spark.createDataFrame([(1, [], []), (None, [0], [2.0])], "id int, idx array<int>, w array<double>")
    got = {r["id"]: r["vector"] for r in model.embed(bare, "id").collect()}
    assert got[1] == [0.0, 0.0] and len(got[None]) == 2
    with pytest.raises(ValueError):
        semantic.fit(none, 10_000_000, size=64)
