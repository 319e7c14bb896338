"""Queries: scans, projections, filters, dedup, joins, sets, samples and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import hashing, labels, parsing, text
from quillspark.operators import dedup, features, models, reports, sampling
from quillspark.plans.registry import query
from quillspark.plans.roles import D, G, MD5, P, R, TOXIC, VALID, games, labelled, profiles, reviews, table
from quillspark.sources import readers


@query("src_01_parquet_scan", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def _(spark, d):
    return readers.parquet(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("src_06_pruned_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 25").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("src_07_batch_scan", "SELECT count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("src_10_union_by_name", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    return a.unionByName(table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_name AS name"), allowMissingColumns=True)


@query("src_11_row_numbers", "SELECT count(*) AS n, count(DISTINCT row_number)::BIGINT AS n_places FROM (SELECT row_number() OVER () AS row_number FROM nation)")
def _(spark, d):
    rows = readers.with_row_ids(table(spark, d, "nation"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("file_name", "row_index").alias("n_places"))


@query("src_16_registered_keys", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(spark, d):
    readers.register(spark, "wanted_keys", [("1-URGENT",), ("2-HIGH",)], "o_orderpriority string")
    return table(spark, d, "orders").join(F.broadcast(spark.table("wanted_keys")), "o_orderpriority").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("src_17_vectors_by_key", "SELECT label, count(*) AS n, round(avg(embedding[1]), 6) AS first_mean FROM embeddings WHERE embedding[2] > 0 GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    index = e.where(F.col("embedding")[1] > 0).select("vec_id")
    return e.join(index, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first_mean"))


@query("src_18_languages", "SELECT DISTINCT lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("lang").distinct()


_NULLS = ", ".join(f"count(*) - count({c}) AS {c}" for c in ("perspective", "detoxify", "is_recommended", "review_url"))


@query("snk_10_null_summary", f"WITH {R}, n AS (SELECT {_NULLS} FROM r) SELECT u.\"column\", u.n_null FROM n UNPIVOT (n_null FOR \"column\" IN (perspective, detoxify, is_recommended, review_url)) u")
def _(spark, d):
    return reports.null_summary(reviews(spark, d).select("perspective", "detoxify", "is_recommended", "review_url"))


@query("snk_11_first_rows", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(20)


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, min({c})::DOUBLE AS least, quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS q50, quantile_cont({c}, 0.75)::DOUBLE AS q75, max({c})::DOUBLE AS most FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))


@query("snk_12_describe", _STATS)
def _(spark, d):
    return reports.describe(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("prj_01_02_rename_drop", "SELECT c_custkey AS user_id, c_name AS title, c_acctbal AS balance FROM customer")
def _(spark, d):
    return table(spark, d, "customer").withColumnsRenamed({"c_custkey": "user_id", "c_name": "title", "c_acctbal": "balance"}).drop("c_nationkey", "c_mktsegment", "not_there")


@query("prj_03_sentinels", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_custkey % 5 = 1 THEN NULL WHEN o_custkey % 5 = 2 THEN NULL ELSE o_orderstatus END AS b FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    raw = o.select("o_orderkey", F.when(F.col("o_custkey") % 10 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("a"), F.when(F.col("o_custkey") % 5 == 1, "").when(F.col("o_custkey") % 5 == 2, "-1").otherwise(F.col("o_orderstatus")).alias("b"))
    return parsing.nullify_sentinels(raw)


@query("prj_04_05_casts", "SELECT o_orderkey, floor(TRY_CAST(t AS DOUBLE))::BIGINT AS n, TRY_CAST(t AS DOUBLE) AS x FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '12.7' WHEN 1 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END AS t FROM orders)")
def _(spark, d):
    raw = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN '12.7' WHEN 1 THEN 'none' ELSE CAST(o_custkey AS STRING) END AS t")
    cast = parsing.cast_present(raw.withColumn("x", F.col("t")), {"x": "double", "absent": "int"})
    return cast.select("o_orderkey", parsing.to_integer(F.col("t")).alias("n"), "x")


@query("prj_06_price", "SELECT p_partkey, CASE WHEN t = 'Free' THEN 0.0::DOUBLE ELSE TRY_CAST(t AS DOUBLE) END AS price FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Free' WHEN 1 THEN 'soon' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)")
def _(spark, d):
    raw = table(spark, d, "part").selectExpr("p_partkey", "CASE p_size % 3 WHEN 0 THEN 'Free' WHEN 1 THEN 'soon' ELSE CAST(p_size AS STRING) END AS t")
    return raw.select("p_partkey", parsing.price(F.col("t")).alias("price"))


@query("prj_07_codes", "SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 3 - 1 = 1) AS n_yes, count(*) FILTER (WHERE l_linenumber % 3 - 1 = 0) AS n_no FROM lineitem GROUP BY 1")
def _(spark, d):
    rec = parsing.recommended(F.col("l_linenumber") % 3 - 1)
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(rec).alias("n_yes"), F.count_if(~rec).alias("n_no"))


@query("prj_08_iso_dates", "SELECT o_orderkey, strftime(TRY_CAST(t AS DATE), '%Y-%m-%d') AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)")
def _(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"))
    return raw.select("o_orderkey", parsing.iso_date(F.col("t")).alias("day"))


_MONTH_LIST = "['" + "', '".join(parsing.MONTHS) + "']"


@query("prj_09_portuguese_dates", f"SELECT o_orderkey, strftime(TRY_CAST(year(o_orderdate) || '-' || lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((o_custkey % 31 + 1)::VARCHAR, 2, '0') AS DATE), '%Y-%m-%d') AS day, (['', 'PUBLICADA: '])[o_orderkey % 2 + 1] || upper((o_custkey % 31 + 1) || ' de ' || ({_MONTH_LIST})[o_orderkey % 12 + 1] || ' de ' || year(o_orderdate)) || (['', '.', ' às 10h'])[o_orderkey % 3 + 1] AS raw FROM orders")
def _(spark, d):
    month = F.element_at(F.array(*map(F.lit, parsing.MONTHS)), (F.col("o_orderkey") % 12 + 1).cast("int"))
    date = F.upper(F.concat_ws(" de ", (F.col("o_custkey") % 31 + 1).cast("string"), month, F.year("o_orderdate").cast("string")))
    around = [F.get(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts)).cast("int")) for texts in (("", "PUBLICADA: "), ("", ".", " às 10h"))]
    raw = F.concat(around[0], date, around[1])
    return table(spark, d, "orders").select("o_orderkey", parsing.portuguese_date(raw).alias("day"), raw.alias("raw"))


@query("prj_11_url_types", "SELECT CASE WHEN lower(url) LIKE '%/profiles/%' THEN 'profiles' WHEN lower(url) LIKE '%/id/%' THEN 'vanity' ELSE 'outro' END AS url_type, count(*) AS n FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'https://host/Profiles/' || page_id WHEN 1 THEN 'https://host/id/u' || page_id ELSE url END AS url FROM pages) GROUP BY 1")
def _(spark, d):
    urls = table(spark, d, "pages").selectExpr("CASE page_id % 3 WHEN 0 THEN concat('https://host/Profiles/', page_id) WHEN 1 THEN concat('https://host/id/u', page_id) ELSE url END AS url")
    return urls.groupBy(parsing.url_type(F.col("url")).alias("url_type")).agg(F.count("*").alias("n"))


@query("prj_12_label_source", f"WITH {R} SELECT CASE WHEN detoxify >= 0.9 AND perspective >= 0.7 THEN 'both' WHEN detoxify >= 0.9 THEN 'detox' WHEN perspective >= 0.7 THEN 'persp' ELSE 'none' END AS tox_source, count(*) AS n FROM r GROUP BY 1")
def _(spark, d):
    return reviews(spark, d).groupBy(labels.label_source(F.col("perspective"), F.col("detoxify")).alias("tox_source")).agg(F.count("*").alias("n"))


@query("prj_13_15_profile_defaults", f"WITH {P} SELECT user_id, coalesce(profile_level, 0)::INT AS profile_level, (profile_level IS NULL)::INT AS level_missing, round(((country IS NOT NULL)::INT + (profile_level IS NOT NULL)::INT + (library_size IS NOT NULL)::INT)::DOUBLE / 3, 6) AS visibility FROM p")
def _(spark, d):
    seen = sum((F.col(c).isNotNull().cast("int") for c in ("profile_level", "library_size")), F.col("country").isNotNull().cast("int"))
    return profiles(spark, d).select("user_id", F.coalesce("profile_level", F.lit(0)).cast("int").alias("profile_level"), F.col("profile_level").isNull().cast("int").alias("level_missing"), F.round(seen / 3, 6).alias("visibility"))


@query("prj_14_guarded_ratio", "SELECT o_custkey, round(coalesce(count(*)::DOUBLE / nullif(date_diff('day', min(o_orderdate), max(o_orderdate)), 0) * 365, 0), 6) AS per_year FROM orders GROUP BY 1")
def _(spark, d):
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.coalesce(F.count("*") / F.nullif(days, F.lit(0)) * 365, F.lit(0.0)), 6).alias("per_year"))


@query("prj_16_count_buckets", "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' ELSE '>=10' END AS bucket, count(*) AS n_users FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy(labels.count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_users"))


@query("prj_17_confusion_cells", f"WITH {R} SELECT CASE WHEN y = 1 AND q = 1 THEN 'TP' WHEN y = 0 AND q = 1 THEN 'FP' WHEN y = 1 AND q = 0 THEN 'FN' ELSE 'TN' END AS cell, count(*) AS n FROM (SELECT {TOXIC} AS y, CASE WHEN perspective >= 0.5 THEN 1 ELSE 0 END AS q FROM r) GROUP BY 1")
def _(spark, d):
    r = reviews(spark, d).select(labels.toxic(F.col("perspective"), F.col("detoxify")).alias("y"), F.when(F.col("perspective") >= 0.5, 1).otherwise(0).alias("q"))
    return r.groupBy(labels.confusion_cell(F.col("y"), F.col("q")).alias("cell")).agg(F.count("*").alias("n"))


@query("prj_18_union_label", f"WITH {R} SELECT review_lang, count(*) AS n_kept, sum({TOXIC})::BIGINT AS n_toxic, (SELECT sum({TOXIC})::BIGINT FROM r) AS n_toxic_unmasked FROM r WHERE {VALID} GROUP BY 1")
def _(spark, d):
    r = reviews(spark, d)
    y = labels.toxic(F.col("perspective"), F.col("detoxify"))
    kept = r.where(labels.valid_scores(F.col("perspective"), F.col("detoxify"))).groupBy("review_lang").agg(F.count("*").alias("n_kept"), F.sum(y).alias("n_toxic"))
    return kept.crossJoin(F.broadcast(r.agg(F.sum(y).alias("n_toxic_unmasked"))))


@query("flt_01_critical_columns", f"WITH {R} SELECT count(*) AS n_before, count(*) FILTER (WHERE perspective IS NOT NULL AND is_recommended IS NOT NULL) AS n_after FROM r")
def _(spark, d):
    r = reviews(spark, d)
    after = r.na.drop(subset=["perspective", "is_recommended"]).agg(F.count("*").alias("n_after"))
    return r.agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(after))


@query("flt_02_language_agreement", f"WITH {R} SELECT review_lang, count(*) AS n FROM r WHERE review_lang IN ('en', 'fr') AND review_lang = declared GROUP BY 1")
def _(spark, d):
    return reviews(spark, d).where(labels.language_agrees(F.col("review_lang"), F.col("declared"), ["en", "fr"])).groupBy("review_lang").agg(F.count("*").alias("n"))


@query("flt_03_one_language", f"WITH {R} SELECT count(*) FILTER (WHERE review_lang = 'en' AND declared = 'en') AS n_kept, count(*) FILTER (WHERE NOT (review_lang = 'en' AND declared = 'en')) AS n_excluded FROM r")
def _(spark, d):
    both = (F.col("review_lang") == "en") & (F.col("declared") == "en")
    return reviews(spark, d).agg(F.count_if(both).alias("n_kept"), F.count_if(~both).alias("n_excluded"))


@query("flt_04_validity_mask", f"WITH {R} SELECT review_lang, count(*) FILTER (WHERE {VALID}) AS n_valid, count(*) FILTER (WHERE NOT {VALID}) AS n_invalid FROM r GROUP BY 1")
def _(spark, d):
    ok = labels.valid_scores(F.col("perspective"), F.col("detoxify"))
    return reviews(spark, d).groupBy("review_lang").agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


@query("flt_05_06_validated_keys", f"WITH {R}, k AS (SELECT DISTINCT game_id FROM r WHERE (review_lang = declared OR review_lang = 'und') AND hours_played > 50000) SELECT game_id, count(*) AS n FROM r WHERE game_id IN (SELECT game_id FROM k) GROUP BY 1")
def _(spark, d):
    r = reviews(spark, d)
    keys = r.where(labels.detector_agrees(F.col("review_lang"), F.col("declared")) & (F.col("hours_played") > 50000)).select("game_id")
    return r.join(keys, "game_id", "left_semi").groupBy("game_id").agg(F.count("*").alias("n"))


@query("flt_07_08_contains", "SELECT doc_id, contains(lower(text), 'license') AS has_term, regexp_matches(text, '(?i)token\\s*=|GESCH') AS has_pattern FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.contains_term(F.col("text"), "License").alias("has_term"), text.matches(F.col("text"), r"token\s*=|GESCH").alias("has_pattern"))


@query("flt_09_tag_contains", f"WITH {G} SELECT game_id FROM g WHERE len(list_filter(tags, lambda t: contains(lower(t), 're'))) > 0")
def _(spark, d):
    return games(spark, d).where(text.has_tag(F.col("tags"), "RE")).select("game_id")


@query("flt_10_volume_floor", f"WITH {R}, n AS (SELECT game_id, count(*) AS n FROM r GROUP BY 1) SELECT game_id, n FROM n WHERE n >= (SELECT quantile_cont(n, 0.9) FROM n)")
def _(spark, d):
    return reports.above_quantile(reviews(spark, d).groupBy("game_id").agg(F.count("*").alias("n")), "n", 0.9)


@query("flt_11_hash_slice", f"SELECT o_orderkey FROM orders WHERE {MD5.format('CAST(o_orderkey AS VARCHAR)')} % 10 = 0")
def _(spark, d):
    return sampling.hash_slice(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10)


@query("flt_12_populations", f"WITH {R}, u AS (SELECT user_id, count(*) AS n_reviews, sum({TOXIC})::BIGINT AS n_toxic FROM r GROUP BY 1) SELECT user_id, n_reviews, n_toxic FROM u WHERE n_reviews - n_toxic >= 1 AND n_reviews >= 2")
def _(spark, d):
    u = reviews(spark, d).groupBy("user_id").agg(F.count("*").alias("n_reviews"), F.sum(labels.toxic(F.col("perspective"), F.col("detoxify"))).alias("n_toxic"))
    return models.clean_population(u, least_positives=1, two=True)


_FIRST = "SELECT review_url, min_by(struct_pack(d := review_date, h := hours_played, g := game_id), struct_pack(d := review_date, h := hours_played, g := game_id)) AS b FROM r GROUP BY 1"


@query("jon_01_ddp_03_earliest_review", f"WITH {R}, k AS ({_FIRST}) SELECT review_url, b.d AS review_date, b.h AS hours_played, b.g AS game_id FROM k")
def _(spark, d):
    r = reviews(spark, d).select("review_url", "review_date", "hours_played", "game_id")
    return dedup.keep_earliest(r, ["review_url"], "review_date", [F.col("hours_played"), F.col("game_id")])


@query("jon_02_08_match_indicator", f"WITH {P}, e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT e.user_id, e.n, (p.user_id IS NOT NULL) AS found, p.country FROM e LEFT JOIN (SELECT * FROM p WHERE profile_level > 5) p ON e.user_id = p.user_id")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    p = profiles(spark, d).where("profile_level > 5").select("user_id", "country")
    return reports.with_profiles(e, p, "user_id").select("user_id", "n", "found", "country")


@query("jon_03_key_types", f"WITH {R}, {G} SELECT title, count(*) AS n FROM r LEFT JOIN g ON TRY_CAST(CAST(r.game_id AS VARCHAR) AS BIGINT) = g.game_id GROUP BY 1")
def _(spark, d):
    r = reviews(spark, d).select(F.col("game_id").cast("string").alias("raw_id"))
    g = games(spark, d).select("game_id", "title")
    return r.join(g, F.col("raw_id").try_cast("bigint") == g["game_id"], "left").groupBy("title").agg(F.count("*").alias("n"))


@query("jon_04_gold_labels", "SELECT doc_id, quality AS y_gold FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id)")
def _(spark, d):
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y_gold")).distinct()
    return table(spark, d, "documents").select("doc_id").join(gold, "doc_id", "left")


@query("jon_05_06_profile_medians", f"WITH {P}, m AS (SELECT median(profile_level) AS lv, median(library_size) AS lb FROM p), o AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1) SELECT o.user_id, n, round(coalesce(profile_level, lv), 4) AS lv, round(coalesce(library_size, lb), 4) AS lb FROM o LEFT JOIN p USING (user_id) CROSS JOIN m")
def _(spark, d):
    p = profiles(spark, d)
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"))
    m = p.agg(F.median("profile_level").alias("mlv"), F.median("library_size").alias("mlb"))
    return o.join(p, "user_id", "left").crossJoin(F.broadcast(m)).select("user_id", "n", F.round(F.coalesce(F.col("profile_level").cast("double"), "mlv"), 4).alias("lv"), F.round(F.coalesce("library_size", "mlb"), 4).alias("lb"))


@query("jon_09_selected_users", "SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) ON o_custkey = c_custkey")
def _(spark, d):
    sel = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(sel, "o_custkey")


@query("jon_10_11_semi_anti", "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT user_id FROM events) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def _(spark, d):
    c, e = table(spark, d, "customer").select("c_custkey"), table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    count = lambda how: c.join(e, "c_custkey", f"left_{how}").agg(F.lit(how).alias("kind"), F.count("*").alias("n"))
    return count("semi").union(count("anti"))


@query("jon_12_paired_scores", f"WITH {R}, u AS (SELECT user_id, avg(perspective) AS a FROM r WHERE review_lang = 'en' GROUP BY 1), v AS (SELECT user_id, avg(detoxify) AS b FROM r WHERE declared = 'fr' GROUP BY 1) SELECT user_id, round(a, 6) AS a, round(b, 6) AS b FROM u JOIN v USING (user_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    r = reviews(spark, d)
    a = r.where("review_lang = 'en'").groupBy("user_id").agg(F.round(F.avg("perspective"), 6).alias("a"))
    b = r.where("declared = 'fr'").groupBy("user_id").agg(F.round(F.avg("detoxify"), 6).alias("b"))
    return a.join(b, "user_id").na.drop()


@query("jon_13_lookup_default", "SELECT e.event_id, coalesce(c.c_nationkey, -1) AS fold FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 0")
def _(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return table(spark, d, "events").select("event_id", "user_id").join(c, "user_id", "left").select("event_id", F.coalesce("c_nationkey", F.lit(-1)).alias("fold"))


@query("jon_14_15_titles", f"WITH {R}, {G} SELECT r.review_url, CAST(r.game_id AS VARCHAR) AS game_id, title FROM r LEFT JOIN g ON CAST(r.game_id AS VARCHAR) = CAST(g.game_id AS VARCHAR) WHERE r.hours_played > 60000")
def _(spark, d):
    r = reviews(spark, d).where("hours_played > 60000").select("review_url", F.col("game_id").cast("string").alias("game_id"))
    return r.join(games(spark, d).select(F.col("game_id").cast("string").alias("game_id"), "title"), "game_id", "left").select("review_url", "game_id", "title")


@query("jon_16_judge_pairs", f"WITH {R}, m AS (SELECT game_id, review_lang AS judge, avg(perspective) AS s FROM r GROUP BY 1, 2) SELECT a.judge AS a, b.judge AS b, count(*) AS n, round(corr(a.s, b.s), 6) AS r FROM m a JOIN m b ON a.game_id = b.game_id AND a.judge < b.judge WHERE a.s IS NOT NULL AND b.s IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    m = reviews(spark, d).groupBy("game_id", F.col("review_lang").alias("judge")).agg(F.avg("perspective").alias("s")).na.drop()
    a, b = m.toDF("game_id", "a", "sa"), m.toDF("game_id", "b", "sb")
    return a.join(b, "game_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.corr("sa", "sb"), 6).alias("r"))


@query("ddp_01_keep_first", "SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def _(spark, d):
    return dedup.keep_first(table(spark, d, "documents").select("doc_id", "text", "source"), ["text"], [F.col("doc_id")]).select("text", "doc_id", "source")


@query("ddp_02_md5_buckets", f"SELECT {MD5.format('text')} % 200 AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(hashing.md5_bucket(F.col("text"), 200).alias("bucket")).agg(F.count("*").alias("n"))


@query("ddp_04_06_accounting", "SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_final, count(*) - count(DISTINCT text) AS dropped FROM documents")
def _(spark, d):
    return dedup.accounting(table(spark, d, "documents"), ["text"])


@query("ddp_05_distinct_keys", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("ord_01_02_top_terms", f"WITH {G} SELECT tag, count(*) AS tf FROM (SELECT unnest(tags) AS tag FROM g) GROUP BY 1 ORDER BY tf DESC, tag LIMIT 10")
def _(spark, d):
    return games(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("tf")).orderBy(F.desc("tf"), "tag").limit(10)


@query("ord_03_lowest", f"WITH {R} SELECT game_id, round(avg(perspective), 6) AS mean FROM r WHERE perspective IS NOT NULL GROUP BY 1 ORDER BY round(avg(perspective), 6), game_id LIMIT 5")
def _(spark, d):
    return reviews(spark, d).where("perspective IS NOT NULL").groupBy("game_id").agg(F.round(F.avg("perspective"), 6).alias("mean")).orderBy("mean", "game_id").limit(5)


@query("ord_05_pseudo_random", f"SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)) LIMIT 5")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").orderBy(F.md5(F.col("c_custkey").cast("string").cast("binary"))).limit(5)


_Y = f"y AS (SELECT doc_id, toxic, {MD5.format('doc_id::VARCHAR || {0}')} AS h FROM labels)"


@query("smp_01_03_sample", f"SELECT doc_id FROM documents ORDER BY {MD5.format(chr(100) + 'oc_id::VARCHAR || ' + chr(39) + 's1' + chr(39))}, doc_id LIMIT 50")
def _(spark, d):
    return sampling.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 50, "s1")


def _hashed(salt: str) -> str:
    return _Y.replace("{0}", f"'{salt}'")


@query("smp_02_negatives", f"WITH {_hashed('neg')} SELECT doc_id, toxic FROM y WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (ORDER BY h, doc_id) AS rn FROM y WHERE toxic = 0) WHERE rn <= 2 * (SELECT count(*) FROM y WHERE toxic = 1)")
def _(spark, d):
    return sampling.with_negatives(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 2, "neg")


@query("smp_04_stratified", f"WITH {_hashed('str')}, c AS (SELECT CAST(round(100.0 * sum(toxic) / count(*)) AS BIGINT) AS n_pos FROM y) SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) AS rn FROM y) CROSS JOIN c WHERE rn <= CASE toxic WHEN 1 THEN n_pos ELSE 100 - n_pos END")
def _(spark, d):
    return sampling.stratified(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 100, "str")


@query("smp_05_blocks", f"WITH {_hashed('blk')}, c AS (SELECT CAST(round(40.0 * sum(toxic) / count(*)) AS BIGINT) AS n_pos FROM y), k AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) - 1 AS rn, CASE toxic WHEN 1 THEN n_pos ELSE 40 - n_pos END AS n FROM y CROSS JOIN c) SELECT doc_id, toxic, CAST(rn // n AS INT) AS block FROM k WHERE rn // n < 5")
def _(spark, d):
    return sampling.blocks(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 5, 40, "blk")


@query("smp_06_balanced_draws", f"WITH y AS (SELECT doc_id, toxic FROM labels), e AS (SELECT doc_id, toxic, k::INT AS draw FROM y CROSS JOIN range(3) t(k)), q AS (SELECT *, row_number() OVER (PARTITION BY toxic, draw ORDER BY {MD5.format('doc_id || chr(58) || draw || ' + chr(39) + 'bal' + chr(39))}, doc_id) AS rn FROM e) SELECT doc_id, toxic, draw FROM q WHERE toxic = 1 OR rn <= (SELECT count(*) FROM y WHERE toxic = 1)")
def _(spark, d):
    return sampling.balanced_draws(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 3, "bal")


@query("smp_08_oversample", "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, count(*) * CASE WHEN toxic = (SELECT arg_min(toxic, n) FROM c) THEN (SELECT max(n) // min(n) FROM c) ELSE 1 END AS n FROM labels GROUP BY 1")
def _(spark, d):
    return sampling.oversampled(table(spark, d, "labels"), "toxic").groupBy("toxic").agg(F.count("*").alias("n"))


@query("smp_09_capped", f"WITH k AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_total, row_number() OVER (PARTITION BY conv_id ORDER BY {MD5.format('turn::VARCHAR || ' + chr(39) + 'cap' + chr(39))}, turn) AS rn FROM conversations) SELECT conv_id, turn, n_total FROM k WHERE rn <= 2")
def _(spark, d):
    return sampling.capped_per_group(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2, "cap")


@query("set_02_03_unions", "SELECT 'a' AS side, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', o_orderkey FROM orders WHERE o_totalprice > 200000")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").selectExpr("'a' AS side", "o_orderkey AS k").unionByName(o.where("o_totalprice > 200000").selectExpr("'b' AS side", "o_orderkey AS k"))


@query("str_01_06_surface", r"""SELECT doc_id, length(text)::INT AS len_chars,
    (CASE WHEN text IS NULL OR trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END)::INT AS len_words,
    round(CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) END, 6) AS caps_ratio,
    len(regexp_extract_all(text, '\b[A-Z]{3,}\b'))::INT AS upper_word_count, len(regexp_extract_all(lower(text), 'r{3,}'))::INT AS rrun_count,
    len(regexp_extract_all(text, '!'))::INT AS excl_count, len(regexp_extract_all(text, '\?'))::INT AS ques_count FROM documents""")
def _(spark, d):
    made = text.surface_features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(F.round(c, 6).alias(n) if n == "caps_ratio" else c.alias(n) for n, c in made.items()))


@query("str_07_08_keys", r"SELECT page_id, nullif(regexp_extract(u, 'profiles/([0-9]+)', 1), '') AS pid, coalesce(nullif(regexp_extract(u, 'profiles/([0-9]+)', 1), ''), 'v:' || nullif(regexp_extract(u, '/id/([^/]+)', 1), '')) AS group_key FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://h/profiles/76' || page_id WHEN 1 THEN 'https://h/id/u' || page_id || '/x' ELSE url END AS u FROM pages)")
def _(spark, d):
    u = table(spark, d, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN concat('https://h/profiles/76', page_id) WHEN 1 THEN concat('https://h/id/u', page_id, '/x') ELSE url END AS u")
    return u.select("page_id", parsing.profile_id(F.col("u")).alias("pid"), parsing.group_key(F.col("u")).alias("group_key"))


_BANNERED = "'análise de ACESSO antecipado ' || text || ' Produto recebido de graça'"


@query("str_09_boilerplate", f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BANNERED}, '(?i)AN[AÁ]LISE DE ACESSO ANTECIPADO', ' ', 'g'), '(?i)produto recebido de gra[cç]a', ' ', 'g'), '(?i)produto reembolsado', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def _(spark, d):
    raw = F.concat(F.lit("análise de ACESSO antecipado "), "text", F.lit(" Produto recebido de graça"))
    return table(spark, d, "documents").select("doc_id", text.without_boilerplate(raw, collapse=True).alias("clean"))


@query("str_10_for_detection", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(text, 2000), 'http\S+|www\.\S+', ' ', 'g'), '(?i)AN[AÁ]LISE DE ACESSO ANTECIPADO', ' ', 'g'), '(?i)produto recebido de gra[cç]a', ' ', 'g'), '(?i)produto reembolsado', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[0-9_]+', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.for_detection(F.col("text")).alias("clean"))


@query("str_12_18_cuts", "SELECT doc_id, left(text, 1200) AS scored, left(text, 300) AS judged, floor(length(text) / 4)::BIGINT + 150 AS n_tokens FROM documents")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.cut(t, "scoring").alias("scored"), text.cut(t, "judge").alias("judged"), text.token_estimate(t).alias("n_tokens"))


@query("str_13_14_lists", "SELECT p_partkey, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') AS tags, coalesce(len(string_split(t, ',')), 0)::INT AS n FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE ' ' || replace(p_name, ' ', ' ,, ') || ' ' END AS t FROM part)")
def _(spark, d):
    raw = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(' ', replace(p_name, ' ', ' ,, '), ' ') END AS t")
    return raw.select("p_partkey", parsing.split_tags(F.col("t")).alias("tags"), parsing.value_count(F.col("t")).alias("n"))


@query("str_15_bins", "SELECT l_discount, l_discount::DOUBLE AS low FROM (SELECT DISTINCT l_discount FROM lineitem)")
def _(spark, d):
    bins = table(spark, d, "lineitem").select("l_discount").distinct()
    label = F.concat(F.lit("score in [ "), F.col("l_discount").cast("string"), F.lit(", 1.0)"))
    return bins.select("l_discount", parsing.bin_lower_bound(label).alias("low"))


@query("str_16_md5_number", f"SELECT o_orderkey, {MD5.format('CAST(o_orderkey AS VARCHAR)')} AS h FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.md5_number(F.col("o_orderkey")).alias("h"))


@query("str_17_agg_21_prompts", "SELECT conv_id, 'User''s reviews (' || count(*) || ' total):' || chr(10) || string_agg('[' || turn - m || '] \"\"\"' || left(text, 1500) || '\"\"\"', chr(10) ORDER BY turn) || chr(10) || 'Judge.' AS prompt FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count("*").alias("n"))
    return c.select("conv_id", text.prompt(F.transform("t", lambda s: s["text"]), F.col("n"), 1000, "Judge.").alias("prompt"))


@query("dat_01_02_dates", "SELECT user_id, year(min(ts))::INT AS first_year, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS tenure, date_diff('day', max(ts)::DATE, DATE '2024-06-30')::INT AS since FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.year(F.min("ts")).alias("first_year"), F.datediff(F.max("ts"), F.min("ts")).alias("tenure"), F.datediff(F.lit("2024-06-30").cast("date"), F.max("ts")).alias("since"))


@query("mth_01_03_math", "SELECT c_custkey, round(c_acctbal / 7, 3) AS r, round(log2((abs(c_acctbal) + 1e-9) / 100), 6) AS lg, greatest(1, least(20, c_nationkey)) AS clamped FROM customer")
def _(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(b / 7, 3).alias("r"), F.round(F.log2((F.abs(b) + 1e-9) / 100), 6).alias("lg"), F.greatest(F.lit(1), F.least(F.lit(20), "c_nationkey")).alias("clamped"))


@query("arr_01_tag_flags", f"WITH {G} SELECT game_id, coalesce(list_contains(tags, 'red') OR list_contains(tags, 'blue'), false) AS warm, coalesce(list_contains(tags, 'widget'), false) AS widget FROM g")
def _(spark, d):
    return games(spark, d).select("game_id", *(c.alias(n) for n, c in features.tag_flags(F.col("tags"), {"warm": ("red", "blue"), "widget": ("widget",)}).items()))


@query("arr_03_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) > 0 AS nonzero, 1.0::DOUBLE AS norm FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", features.l2_normalised(F.col("embedding")).alias("v"), "embedding")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return e.select("vec_id", F.exists("embedding", lambda x: x != 0).alias("nonzero"), F.round(norm, 6).alias("norm"))


@query("jsn_01_04_answers", """WITH a AS (SELECT event_id, event_id % 6 AS k, event_id % 130 AS s FROM events) SELECT event_id,
    CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN NULL WHEN 4 THEN 1 END::INT AS label,
    CASE WHEN k IN (0, 1) THEN least(1.0, s / 100.0) WHEN k = 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE k WHEN 0 THEN 3 ELSE -1 END::INT AS worst,
    CASE WHEN k < 2 THEN true ELSE false END AS has_block FROM a""")
def _(spark, d):
    raw = table(spark, d, "events").selectExpr("event_id", """CASE event_id % 6 WHEN 0 THEN concat('Sure: {"label": "toxic", "user_toxicity_score": ', event_id % 130, ', "worst_review": 3} done')
        WHEN 1 THEN concat('{"label": "non-toxic", "user_toxicity_score": ', event_id % 130, ', "worst_review": -1}') WHEN 2 THEN 'this is nontoxic' WHEN 3 THEN 'ERR:timeout' WHEN 4 THEN 'Toxic.' END AS t""")
    t = F.col("t")
    label = parsing.answer_label(t)
    return raw.select("event_id", label.alias("label"), parsing.answer_score(t, label).alias("score"), parsing.answer_worst(t).alias("worst"), (parsing.json_block(t) != "{}").alias("has_block"))


@query("fea_03_splits", f"SELECT CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM (SELECT {MD5.format('CAST(c_custkey AS VARCHAR)')} % 100 AS b FROM customer) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy(hashing.split_name(F.col("c_custkey")).alias("split")).agg(F.count("*").alias("n"))


@query("win_08_ml_02_folds", f"WITH {_hashed('')} SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) - 1) % 5)::INT AS fold FROM y")
def _(spark, d):
    return sampling.folds(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 5)


@query("pkg_02_privacy_scan", "SELECT 'text' AS \"column\", 'credential' AS rule, count(*) AS n FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{40}\"') HAVING count(*) > 0 UNION ALL SELECT 'text', 'blocked name', count(*) FROM documents HAVING count(*) > 0")
def _(spark, d):
    from quillspark.sources import writers

    return writers.findings(table(spark, d, "documents").select("doc_id", "text"), {"credential": 'token = "[0-9a-f]{40}"'}, ("text", "review_text"))


@query("txt_14_examples", f"WITH {D} SELECT doc_id, source FROM d WHERE toxic = 1 AND contains(lower(text), 'the')")
def _(spark, d):
    return labelled(spark, d).where((F.col("toxic") == 1) & text.contains_term(F.col("text"), "the")).select("doc_id", "source")
