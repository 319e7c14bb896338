"""Queries: layouts and formats written to the shared folder and read again, and the remaining scalar and user-code rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import labels, text
from quillspark.operators import bootstrap, features, models, sampling, statistics
from quillspark.plans.registry import query
from quillspark.plans.roles import G, MD5, R, TOXIC, bootstrap_sql, games, reviews, table
from quillspark.sources import readers, writers
from quillspark.sources.staging import shared_path, staged


@query("src_02_recursive_listing", "SELECT o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    root = shared_path(spark, "tree")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for s in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == s).write.parquet(f"{root}/{s}/deep")
    return readers.parquet(spark, root, recursive=True).groupBy(F.col("o_orderstatus").alias("part")).agg(F.count("*").alias("n"))


@query("src_03_folder_scan", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def _(spark, d):
    path = shared_path(spark, "folder")
    table(spark, d, "orders").repartition(5).write.parquet(path)
    return readers.parquet(spark, path).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("src_04_json_array", "SELECT p_partkey AS game_id, p_brand AS title, p_retailprice AS price FROM part")
def _(spark, d):
    path = shared_path(spark, "games")
    rows = table(spark, d, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("game_id"), F.col("p_brand").alias("title"), F.col("p_retailprice").alias("price"))).alias("j"))
    parts = F.pmod(F.xxhash64("j"), F.lit(-(-rows.count() // 10_000) or 1)).alias("part")  # a file for about so many rows
    rows.groupBy(parts).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return readers.json_array(spark, path, "game_id long, title string, price double").select("game_id", "title", "price")


@query("src_05_discovery", "SELECT unnest(['games', 'other', 'reviews', 'users']) AS kind, unnest([true, true, true, true]) AS found")
def _(spark, d):
    root = shared_path(spark, "raw")
    reviews(spark, d).select("review_url", F.col("review_lang").alias("review_text")).write.parquet(f"{root}/en/reviews")
    games(spark, d).select("game_id", F.col("tags").alias("popular_tags")).write.parquet(f"{root}/games")
    table(spark, d, "customer").select(F.col("c_custkey").alias("steam_id")).write.parquet(f"{root}/users")
    table(spark, d, "region").write.parquet(f"{root}/region")
    kinds = readers.discover(spark, root)
    return spark.createDataFrame([(k, bool(v)) for k, v in kinds.items()], "kind string, found boolean")


@query("src_08_schema_probe", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name")
def _(spark, d):
    return staged(features.column_profile(table(spark, d, "orders")), "schema").select(F.col("column").alias("name"))


@query("src_09_12_layouts", "SELECT layout, lang, count(*) AS n FROM documents, (SELECT unnest(['flat', 'hive', 'plain']) AS layout) WHERE lang IN ('en', 'fr') GROUP BY 1, 2")
def _(spark, d):
    root = shared_path(spark, "layouts")
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("review_lang"))
    docs.write.partitionBy("review_lang").parquet(f"{root}/hive")
    docs.write.parquet(f"{root}/flat")
    for x in ("en", "fr"):
        docs.where(F.col("review_lang") == x).drop("review_lang").write.parquet(f"{root}/plain/{x}")
    parts = [readers.language_layout(spark, f"{root}/{k}", x).select(F.lit(k).alias("layout"), F.col("review_lang").alias("lang")) for k in ("hive", "flat", "plain") for x in ("en", "fr")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("layout", "lang").agg(F.count("*").alias("n"))


@query("src_13_14_snk_08_csv", "SELECT doc_id, quality AS y_review_gold FROM labels")
def _(spark, d):
    path = shared_path(spark, "gold")
    writers.csv(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y_review_gold")), path)
    return readers.csv(spark, path, "doc_id long, y_review_gold int")


@query("src_15_snk_15_json_lines", "SELECT conv_id, turn, role FROM conversations")
def _(spark, d):
    path = shared_path(spark, "lines")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    writers.json_lines(c.where("turn = 0"), path)
    writers.json_lines(c.where("turn <> 0"), path)
    spark.range(1).select(F.lit("{not json").alias("value")).write.mode("append").text(path)
    return readers.json_lines(spark, path, "conv_id long, turn long, role string")


@query("snk_01_03_parquet", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
def _(spark, d):
    path = shared_path(spark, "zstd")
    writers.parquet(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("snk_02_04_published_twice", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    """The language is a plain column: a rerun with other languages leaves no stale partition behind."""
    path = shared_path(spark, "published")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    writers.publish(docs.withColumn("lang", F.lit("und")), path)
    writers.publish(docs, path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("snk_09_14_report", f"WITH {R} SELECT count(*) AS n_read, sum({TOXIC})::BIGINT AS n_toxic FROM r")
def _(spark, d):
    path = f"{shared_path(spark, 'report')}/summary.json"
    r = reviews(spark, d)
    writers.report(r.agg(F.count("*").alias("n_read"), F.sum(labels.toxic(F.col("perspective"), F.col("detoxify"))).alias("n_toxic")), path)
    return readers.json_array(spark, path, "n_read long, n_toxic long")


@query("snk_16_metric_rows", "SELECT 'y' AS label, 'profile' AS arm, l_returnflag AS model, round(avg(l_discount), 6) AS auc_pr FROM lineitem GROUP BY 3")
def _(spark, d):
    path = shared_path(spark, "metrics")
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.round(F.avg("l_discount"), 6).alias("auc_pr"))
    writers.metric_rows(m.select(F.lit("y").alias("label"), F.lit("profile").alias("arm"), "model", "auc_pr"), path)
    return spark.read.parquet(path).select("label", "arm", "model", "auc_pr")


@query("snk_17_figure_data", f"WITH {G} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM g) GROUP BY 1")
def _(spark, d):
    return games(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("pkg_03_manifest", "SELECT 1 AS n_files, true AS same")
def _(spark, d):
    path = shared_path(spark, "artifact")
    table(spark, d, "region").coalesce(1).write.parquet(path)
    a = writers.manifest(spark, path).where(F.col("path").endswith(".parquet"))
    return a.agg(F.count("*").cast("int").alias("n_files"), F.lit(statistics.same_rows(a, writers.manifest(spark, path).where(F.col("path").endswith(".parquet")))).alias("same"))


@query("set_01_union_all_by_name", "SELECT n_name AS name, n_nationkey AS key FROM nation UNION ALL BY NAME SELECT r_regionkey AS key, r_name AS name FROM region")
def _(spark, d):
    return table(spark, d, "nation").selectExpr("n_name AS name", "n_nationkey AS key").unionByName(table(spark, d, "region").selectExpr("r_regionkey AS key", "r_name AS name"))


@query("arr_02_exploded_tags", "SELECT game_id, tag FROM (SELECT p_partkey AS game_id, unnest(string_split(p_name, ' ')) AS tag FROM part WHERE p_size > 16) WHERE tag <> ''")
def _(spark, d):
    tags = F.when(F.col("p_size") > 16, F.split("p_name", " "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.explode(tags).alias("tag")).where("tag <> ''")


@query("map_01_lookups", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') > 0 AS has_view FROM events GROUP BY 1")
def _(spark, d):
    u = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return u.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("n_click"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.map_contains_key("m", "view").alias("has_view"))


@query("typ_01_casts", "SELECT c_custkey, (c_acctbal > 0)::INT AS positive, c_nationkey::DOUBLE AS nation, c_custkey::VARCHAR AS key FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("positive"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_custkey").cast("string").alias("key"))


_GRID = ", ".join(repr(0.01 + (0.999 - 0.01) * i / 199) for i in range(200))


@query("sta_09_threshold_on_a_sample", f"WITH s AS (SELECT toxic AS y, doc_id % 17 / 17 * 0.7::DOUBLE + toxic * 0.3::DOUBLE AS p FROM labels ORDER BY {MD5.format("doc_id::VARCHAR || 'search'")}, doc_id LIMIT 50000), t AS (SELECT DISTINCT unnest(quantile_cont(p, [{_GRID}])) AS t FROM s), c AS (SELECT t, count(*) FILTER (WHERE y = 1 AND p >= t)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p >= t)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p < t)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND p < t)::DOUBLE AS tn FROM s, t GROUP BY 1), f AS (SELECT t, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 12) AS f FROM c) SELECT round(t, 6) AS threshold, round(f, 6) AS f1_macro FROM f ORDER BY f DESC, t LIMIT 1")
def _(spark, d):
    """The threshold search on at most 50,000 rows, as a sampling operator."""
    y = table(spark, d, "labels").select("doc_id", "toxic", (F.col("doc_id") % 17 / 17 * 0.7 + F.col("toxic") * 0.3).alias("p"))
    out = statistics.best_threshold(sampling.sample_rows(y, "doc_id", 50_000, "search"), "toxic", "p")
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("f1_macro", 6).alias("f1_macro"))


@query("smp_07_resamples", bootstrap_sql("SELECT doc_id AS k, toxic AS y, doc_id % 7 AS a, doc_id % 11 + toxic AS b FROM labels", rounds=20, seed=3, each=True))
def _(spark, d):
    y = table(spark, d, "labels").select("doc_id", "toxic", (F.col("doc_id") % 7).cast("double").alias("a"), (F.col("doc_id") % 11 + F.col("toxic")).cast("double").alias("b"))
    drawn = bootstrap.bootstrap_rounds(y, "doc_id", "toxic", "a", "b", rounds=20, seed=3)
    return drawn.select("round", F.round("ap_a", 6).alias("ap_a"), F.round("ap_b", 6).alias("ap_b"))


@query("ml_08_scores", "SELECT count(*) AS n, 0::BIGINT AS n_missing FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("k"), (F.col("label") < 4).cast("int").alias("y"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)))
    data = sampling.folds(e, "y", "k", 2)
    out = models.out_of_fold(data, "k", "y", "fold", "svm", ["x0", "x1", "x2"])
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("n_missing"))


@query("ml_09_sequences", "SELECT conv_id, string_agg(left(text, 500), ' [SEP] ' ORDER BY turn) AS sequence, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    """The input of a fine-tuned sequence model; the model itself is external."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.cut(F.col("text"), "sequence").alias("t")))).alias("ts"), F.count("*").alias("n"))
    return c.select("conv_id", F.array_join(F.transform("ts", lambda s: s["t"]), " [SEP] ").alias("sequence"), "n")


@query("ml_10_loss_summary", "SELECT user_id, round(avg(value) FILTER (WHERE a <= 50), 6) AS first_50, round(avg(value) FILTER (WHERE b <= 50), 6) AS last_50 FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) GROUP BY 1")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumns({"a": F.row_number().over(w.orderBy("event_id")), "b": F.row_number().over(w.orderBy(F.desc("event_id")))})
    return e.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("a") <= 50, F.col("value"))), 6).alias("first_50"), F.round(F.avg(F.when(F.col("b") <= 50, F.col("value"))), 6).alias("last_50"))


@query("udf_03_batch_map", "SELECT doc_id, left(text, 3) AS head FROM documents")
def _(spark, d):
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "head": b["text"].str[:3]})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(heads, "doc_id long, head string")


@query("udf_05_06_grouped", "SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


@query("udf_07_records", "SELECT conv_id, turn, length(text) AS n FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n"))).alias("rows"))
    return c.select("conv_id", F.inline("rows"))
