"""Queries: aggregations, windows, TF-IDF and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import labels, text
from quillspark.operators import bootstrap, reports, sampling, statistics, terms
from quillspark.plans.registry import query
from quillspark.plans.roles import CLEAN, D, G, P, R, TOXIC, VALID, games, labelled, profiles, reviews, table, bootstrap_sql


def _labelled_reviews(spark, d):
    r = reviews(spark, d)
    return r.where(labels.valid_scores(F.col("perspective"), F.col("detoxify")))


@query("agg_01_global_counts", f"WITH {R} SELECT count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT game_id) AS n_games, count(DISTINCT CASE WHEN {TOXIC} = 1 THEN user_id END) AS n_toxic_users, sum({TOXIC})::BIGINT AS n_toxic FROM r")
def _(spark, d):
    y = labels.toxic(F.col("perspective"), F.col("detoxify"))
    return reviews(spark, d).agg(F.count("*").alias("n_reviews"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("game_id").alias("n_games"), F.count_distinct(F.when(y == 1, F.col("user_id"))).alias("n_toxic_users"), F.sum(y).alias("n_toxic"))


_A, _B = "coalesce(perspective >= 0.7, false)", "coalesce(detoxify >= 0.9, false)"


@query("agg_02_label_split", f"WITH {R} SELECT coalesce(review_lang, 'total') AS review_lang, count(*) FILTER (WHERE {_A} AND NOT {_B}) AS only_perspective, count(*) FILTER (WHERE {_B} AND NOT {_A}) AS only_detoxify, count(*) FILTER (WHERE {_A} AND {_B}) AS both, count(*) FILTER (WHERE {_A} OR {_B}) AS either, count(*) AS n_rows FROM r GROUP BY ROLLUP (review_lang)")
def _(spark, d):
    return reports.label_split(reviews(spark, d), "review_lang")


@query("agg_03_threshold_agreement", f"WITH {R} SELECT review_lang, count(*) FILTER (WHERE {_A} AND {_B}) AS both, count(*) FILTER (WHERE {_A} OR {_B}) AS either, coalesce(round(100.0 * count(*) FILTER (WHERE {_A} AND {_B})::DOUBLE / nullif(count(*) FILTER (WHERE {_A} OR {_B}), 0), 2), 0.0)::DOUBLE AS both_pct_of_either FROM r GROUP BY 1")
def _(spark, d):
    return reports.threshold_agreement(reviews(spark, d), "review_lang")


@query("agg_04_validity", f"WITH {R} SELECT review_lang, count(*) AS n_rows, count(*) FILTER (WHERE {VALID}) AS n_valid, count(*) FILTER (WHERE NOT coalesce(perspective BETWEEN 0 AND 1, false)) AS n_bad_perspective, count(*) FILTER (WHERE NOT coalesce(detoxify BETWEEN 0 AND 1, false)) AS n_bad_detoxify FROM r GROUP BY 1")
def _(spark, d):
    return reports.validity(reviews(spark, d), "review_lang")


@query("agg_05_language_validation", f"WITH {R}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE review_lang = declared) AS n_match, count(*) FILTER (WHERE review_lang = 'und') AS n_undetermined, count(*) FILTER (WHERE review_lang <> declared AND review_lang <> 'und') AS n_mismatch FROM r) SELECT *, round(100.0::DOUBLE * n_match / n, 2) AS pct_match, round(100.0::DOUBLE * n_mismatch / n, 2) AS pct_mismatch, round(100.0::DOUBLE * n_undetermined / n, 2) AS pct_undetermined FROM c")
def _(spark, d):
    return reports.language_validation(reviews(spark, d), "declared", "review_lang")


@query("agg_06_mismatches", f"WITH {R} SELECT review_lang, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM r WHERE review_lang <> declared AND review_lang <> 'und' GROUP BY 1")
def _(spark, d):
    return reports.mismatch_breakdown(reviews(spark, d), "declared", "review_lang")


@query("agg_07_languages", "SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("agg_08_per_game", f"WITH {R} SELECT game_id, count(*) AS n, sum({TOXIC})::BIGINT AS n_toxic FROM r WHERE {VALID} GROUP BY 1")
def _(spark, d):
    return reports.per_key_counts(_labelled_reviews(spark, d), "game_id")


@query("agg_09_per_user", f"WITH {R} SELECT user_id, count(*) AS n, sum({TOXIC})::BIGINT AS n_toxic, sum({TOXIC}) >= 1 AS is_toxic FROM r WHERE {VALID} GROUP BY 1")
def _(spark, d):
    return reports.per_key_counts(_labelled_reviews(spark, d), "user_id").withColumn("is_toxic", F.col("n_toxic") >= 1)


@query("agg_10_accounting", f"WITH {R} SELECT count(*) AS n_read, count(*) FILTER (WHERE {VALID}) AS n_kept, count(*) FILTER (WHERE NOT {VALID}) AS n_dropped, count(DISTINCT CASE WHEN {VALID} THEN game_id END) AS n_keys, count(*) FILTER (WHERE {VALID} AND {TOXIC} = 1) AS n_toxic FROM r")
def _(spark, d):
    return reports.accounting(reviews(spark, d), "game_id")


_COUNTS = f"c AS (SELECT game_id, count(*) AS n, sum({TOXIC})::BIGINT AS n_toxic FROM r WHERE {VALID} GROUP BY 1)"
_TAGS = "t AS (SELECT DISTINCT game_id, unnest(tags) AS tag FROM g)"
_BY_TAG = "b AS (SELECT tag, sum(n)::BIGINT AS n_reviews, sum(n_toxic)::BIGINT AS n_toxic FROM t JOIN c USING (game_id) WHERE tag <> '' GROUP BY 1)"


@query("agg_11_tag_toxicity", f"WITH {R}, {G}, {_COUNTS}, {_TAGS}, {_BY_TAG} SELECT tag, n_reviews, n_toxic, round(n_toxic / n_reviews, 8) AS toxicity_rate, round(100 * n_toxic / n_reviews, 6) AS toxicity_pct FROM b WHERE n_reviews >= (SELECT quantile_cont(n_reviews, 0.5) FROM b) ORDER BY toxicity_rate DESC, tag LIMIT 10")
def tag_toxicity(spark, d):
    by_tag = reports.tag_toxicity(reports.per_key_counts(_labelled_reviews(spark, d), "game_id"), games(spark, d), "game_id")
    top = reports.above_quantile(by_tag, "n_reviews", 0.5).withColumns({"toxicity_rate": F.round("toxicity_rate", 8), "toxicity_pct": F.round("toxicity_pct", 6)})
    return top.orderBy(F.desc("toxicity_rate"), "tag").limit(10)


@query("agg_12_tag_coverage", f"WITH {R}, {_COUNTS} SELECT count(*) FILTER (WHERE p_size > 12) AS games_with_tags, count(*) FILTER (WHERE p_size <= 12) AS games_without, sum(CASE WHEN p_size > 12 THEN n ELSE 0 END)::BIGINT AS reviews_with_tags, sum(CASE WHEN p_size <= 12 THEN n ELSE 0 END)::BIGINT AS reviews_without FROM c JOIN part ON game_id = p_partkey")
def _(spark, d):
    parts = table(spark, d, "part")
    tagged = parts.select(F.col("p_partkey").alias("game_id"), F.when(F.col("p_size") > 12, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("tags"))
    return reports.tag_coverage(reports.per_key_counts(_labelled_reviews(spark, d), "game_id"), tagged, "game_id")


@query("agg_13_15_user_aggregate", f"WITH {R} SELECT user_id, max({TOXIC}) AS y_user, sum({TOXIC})::BIGINT AS n_toxic, count(*) AS n_reviews, count(DISTINCT game_id) AS n_games, round(avg(CASE WHEN is_recommended THEN 1.0 WHEN NOT is_recommended THEN 0.0 END), 6) AS pct_recommended, round(quantile_cont(hours_played, 0.5), 4) AS hours_med, round(quantile_cont(hours_played, 0.9), 4) AS hours_p90, date_diff('day', min(review_date), max(review_date))::INT AS tenure FROM r GROUP BY 1")
def _(spark, d):
    y = labels.toxic(F.col("perspective"), F.col("detoxify"))
    rec = F.avg(F.when(F.col("is_recommended"), F.lit(1.0)).when(~F.col("is_recommended"), F.lit(0.0)))
    return reviews(spark, d).groupBy("user_id").agg(F.max(y).alias("y_user"), F.sum(y).alias("n_toxic"), F.count("*").alias("n_reviews"), F.count_distinct("game_id").alias("n_games"), F.round(rec, 6).alias("pct_recommended"), F.round(F.percentile("hours_played", 0.5), 4).alias("hours_med"), F.round(F.percentile("hours_played", 0.9), 4).alias("hours_p90"), F.datediff(F.max("review_date"), F.min("review_date")).alias("tenure"))


@query("agg_14_distinct_values", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))


@query("agg_16_19_medians_shares", f"WITH {R} SELECT review_lang, median(hours_played) AS med, median(hours_played) FILTER (WHERE is_recommended) AS med_rec, round(quantile_cont(hours_played, 0.9), 4) AS p90, count(*) FILTER (WHERE NOT is_recommended) AS n_no, round(avg((hours_played > 30000)::INT) * 100, 4) AS pct_long FROM r GROUP BY 1")
def _(spark, d):
    h = F.col("hours_played")
    return reviews(spark, d).groupBy("review_lang").agg(F.median(h).alias("med"), F.median(F.when(F.col("is_recommended"), h)).alias("med_rec"), F.round(F.percentile(h, 0.9), 4).alias("p90"), F.count_if(~F.col("is_recommended")).alias("n_no"), F.round(F.avg((h > 30000).cast("int")) * 100, 4).alias("pct_long"))


@query("agg_20_joined_texts", "SELECT conv_id, string_agg(left(text, 500), ' [SEP] ' ORDER BY turn) AS joined FROM conversations GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.cut(F.col("text"), "sequence").alias("t")))).alias("ts"))
    return rows.select("conv_id", F.array_join(F.transform("ts", lambda s: s["t"]), " [SEP] ").alias("joined"))


_UL = "u AS (SELECT user_id, event_type AS k, count(*) AS v FROM events GROUP BY 1, 2)"


@query("agg_22_31_count_maps", f"WITH {_UL} SELECT user_id, list(k ORDER BY k) AS keys, list(v ORDER BY k) AS counts, sum(v)::BIGINT AS total, count(*)::INT AS n_kinds, coalesce(sum(v) FILTER (WHERE k = 'click'), 0)::BIGINT AS n_click FROM u GROUP BY 1")
def _(spark, d):
    u = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.count("*").alias("v"))
    m = u.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))
    return m.select("user_id", F.map_keys("m").alias("keys"), F.map_values("m").alias("counts"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.size("m").alias("n_kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("n_click"))


@query("agg_31_kinds_per_user", f"WITH {_UL} SELECT n_kinds, count(*) AS n_users FROM (SELECT user_id, count(*) AS n_kinds FROM u GROUP BY 1) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n_kinds")).groupBy("n_kinds").agg(F.count("*").alias("n_users"))


@query("agg_23_24_mean_sd", f"WITH {R} SELECT review_lang, declared, count(perspective) AS n, round(avg(perspective), 6) AS mean, round(coalesce(stddev_samp(perspective), 0), 6) AS sd FROM r GROUP BY 1, 2")
def _(spark, d):
    return reviews(spark, d).groupBy("review_lang", "declared").agg(F.count("perspective").alias("n"), F.round(F.avg("perspective"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("perspective"), F.lit(0.0)), 6).alias("sd"))


@query("agg_25_pivot", f"WITH {R} SELECT declared, round(avg(perspective) FILTER (WHERE review_lang = 'en'), 6) AS en, round(avg(perspective) FILTER (WHERE review_lang = 'fr'), 6) AS fr, round(avg(perspective) FILTER (WHERE review_lang = 'und'), 6) AS und FROM r GROUP BY 1")
def _(spark, d):
    return reviews(spark, d).groupBy("declared").pivot("review_lang", ["en", "fr", "und"]).agg(F.round(F.avg("perspective"), 6))


@query("agg_27_prevalence", f"WITH {R} SELECT review_lang, count(*) AS n, round(100.0::DOUBLE * sum({TOXIC}) / count(*), 3) AS pct_toxic FROM r GROUP BY 1")
def _(spark, d):
    y = labels.toxic(F.col("perspective"), F.col("detoxify"))
    return reviews(spark, d).groupBy("review_lang").agg(F.count("*").alias("n"), F.round(100 * F.sum(y) / F.count("*"), 3).alias("pct_toxic"))


@query("agg_28_toxic_recommends", f"WITH {R} SELECT review_lang, round(100.0::DOUBLE * count(*) FILTER (WHERE is_recommended) / count(*), 4) AS pct_of_all, round(100.0::DOUBLE * avg(CASE WHEN is_recommended THEN 1.0 WHEN NOT is_recommended THEN 0.0 END), 4) AS pct_of_known FROM r WHERE {TOXIC} = 1 GROUP BY 1")
def _(spark, d):
    rec = F.col("is_recommended")
    bad = reviews(spark, d).where(labels.toxic(F.col("perspective"), F.col("detoxify")) == 1)
    return bad.groupBy("review_lang").agg(F.round(100 * F.count_if(F.coalesce(rec, F.lit(False))) / F.count("*"), 4).alias("pct_of_all"), F.round(100 * F.avg(F.when(rec, F.lit(1.0)).when(~rec, F.lit(0.0))), 4).alias("pct_of_known"))


def _toxic_users(spark, d):
    u = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"), (F.max("o_totalprice") > 300000).alias("is_toxic"))
    return reports.with_profiles(u, profiles(spark, d).where("profile_level > 5"), "user_id")


_TU = f"{P}, o AS (SELECT o_custkey AS user_id, count(*) AS n, max(o_totalprice) > 300000 AS is_toxic FROM orders GROUP BY 1), u AS (SELECT o.*, (q.user_id IS NOT NULL) AS found, q.has_ban, q.library_size FROM o LEFT JOIN (SELECT * FROM p WHERE profile_level > 5) q ON o.user_id = q.user_id)"


@query("agg_29_ban_rates", f"WITH {_TU} SELECT is_toxic, count(*) AS n_users, count(*) FILTER (WHERE found) AS n_matched, count(*) FILTER (WHERE has_ban) AS n_banned, round(100.0::DOUBLE * count(*) FILTER (WHERE has_ban) / count(*), 4) AS ban_pct_all, round(100.0::DOUBLE * count(*) FILTER (WHERE has_ban) / nullif(count(*) FILTER (WHERE found), 0), 4) AS ban_pct_matched FROM u GROUP BY 1")
def _(spark, d):
    return reports.ban_rates(_toxic_users(spark, d))


@query("agg_30_group_medians", f"WITH {_TU} SELECT is_toxic, median(library_size) AS med, count(library_size) AS n, count(*) FILTER (WHERE library_size <= 0) AS n_not_drawn FROM u GROUP BY 1")
def _(spark, d):
    return _toxic_users(spark, d).groupBy("is_toxic").agg(F.median("library_size").alias("med"), F.count("library_size").alias("n"), F.count_if(F.coalesce(F.col("library_size") <= 0, F.lit(False))).alias("n_not_drawn"))


@query("agg_32_win_05_rolling", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 24 PRECEDING), 6) AS rolling FROM events")
def _(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-24, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(order), 6).alias("rolling"))


@query("win_01_02_average_ranks", f"WITH {R} SELECT DISTINCT perspective AS v, rank() OVER (ORDER BY perspective) + (count(*) OVER (PARTITION BY perspective) - 1) / 2 AS rank FROM r WHERE perspective IS NOT NULL")
def _(spark, d):
    return statistics._average_ranks(reviews(spark, d).where("perspective IS NOT NULL"), "perspective")


@query("win_03_07_top_k", f"WITH {R} SELECT review_lang, game_id, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY review_lang ORDER BY n DESC, game_id) AS rank FROM (SELECT review_lang, game_id, count(*) AS n FROM r GROUP BY 1, 2)) WHERE rank <= 5")
def _(spark, d):
    n = reviews(spark, d).groupBy("review_lang", "game_id").agg(F.count("*").alias("n"))
    return sampling.top_k(n, ["review_lang"], [F.desc("n"), F.col("game_id")], 5)


@query("win_04_ecdf", "SELECT DISTINCT l_quantity AS value, round(cume_dist() OVER (ORDER BY l_quantity), 8) AS share FROM lineitem")
def _(spark, d):
    return reports.ecdf(table(spark, d, "lineitem"), "l_quantity").withColumn("share", F.round("share", 8))


@query("win_09_bands", "WITH t AS (SELECT c_custkey AS i, c_mktsegment AS family FROM customer), s AS (SELECT *, row_number() OVER (ORDER BY i) - row_number() OVER (PARTITION BY family ORDER BY i) AS grp FROM t) SELECT family, min(i) AS first, max(i) AS last, count(*) AS n FROM s GROUP BY family, grp")
def _(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("family"))
    return reports.bands(t, "i", "family")


_STOP = "['" + "', '".join((*terms.STOP_WORDS, *terms.EXTRA_STOP_WORDS["en"])) + "']"
_TERMS = f"""{D}, c AS (SELECT doc_id, toxic, {CLEAN} AS clean FROM d), w AS (SELECT doc_id, unnest(list_filter(string_split(clean, ' '), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))) AS term FROM c),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM d), df AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY 1)"""
_VOCAB = "v AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, tf, df, n FROM df, n WHERE df >= 5 AND df <= 0.8 * n ORDER BY tf DESC, term LIMIT 2000))"
_WEIGHTS = "x AS (SELECT doc_id, term, tf.tf * idf AS w FROM tf JOIN v USING (term)), z AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x)"


def _terms(spark, d):
    docs = labelled(spark, d)
    stop = (*terms.STOP_WORDS, *terms.EXTRA_STOP_WORDS["en"])
    tf = terms.term_frequencies(docs.select("doc_id", terms.tokens(text.for_terms(F.col("text")), stop).alias("tokens")), "doc_id", "tokens")
    return docs, tf


def _vocab(docs, tf):
    return terms.vocabulary(terms.term_counts(tf), docs.count(), min_df=5, max_features=2000)


@query("txt_01_03_term_counts", f"WITH {_TERMS} SELECT term, tf, df FROM df")
def _(spark, d):
    return terms.term_counts(_terms(spark, d)[1])


@query("txt_04_05_vocabulary", f"WITH {_TERMS}, {_VOCAB} SELECT term, idx, tf, df, round(idf, 6) AS idf FROM v")
def _(spark, d):
    return _vocab(*_terms(spark, d)).withColumns({"idf": F.round("idf", 6), "idx": F.col("idx").cast("long")})


@query("txt_06_weights", f"WITH {_TERMS}, {_VOCAB}, {_WEIGHTS} SELECT doc_id, term, round(w, 6) AS w FROM z")
def _(spark, d):
    docs, tf = _terms(spark, d)
    return terms.weights(tf, _vocab(docs, tf), "doc_id").withColumn("w", F.round("w", 6))


_MEANS = "m AS (SELECT term, sum(CASE WHEN toxic = 1 THEN w ELSE 0 END) / (SELECT count(*) FROM d WHERE toxic = 1) AS toxic, sum(CASE WHEN toxic = 0 THEN w ELSE 0 END) / (SELECT count(*) FROM d WHERE toxic = 0) AS neutral FROM z JOIN d USING (doc_id) GROUP BY 1)"


def _lexicon(spark, d):
    docs, tf = _terms(spark, d)
    w = terms.weights(tf, _vocab(docs, tf), "doc_id")
    return terms.lexicon(terms.class_means(w, docs, "doc_id", "toxic"))


@query("txt_07_08_lexicon", f"WITH {_TERMS}, {_VOCAB}, {_WEIGHTS}, {_MEANS} SELECT term, round(toxic, 6) AS toxic, round(neutral, 6) AS neutral, round(toxic - neutral, 6) + 0 AS difference FROM m")
def _(spark, d):
    return _lexicon(spark, d).select("term", *(F.round(c, 6).alias(c) for c in ("toxic", "neutral")), (F.round("difference", 6) + 0).alias("difference"))


@query("txt_09_top_terms", f"WITH {_TERMS}, {_VOCAB}, {_WEIGHTS}, {_MEANS}, l AS (SELECT term, toxic - neutral AS v FROM m) SELECT 'toxic' AS class, rank::INT AS rank, term, round(v, 6) AS value FROM (SELECT *, row_number() OVER (ORDER BY round(v, 10) DESC, term) AS rank FROM l) WHERE rank <= 10 UNION ALL SELECT 'neutral', rank::INT, term, round(v, 6) FROM (SELECT *, row_number() OVER (ORDER BY round(v, 10), term) AS rank FROM l) WHERE rank <= 10")
def _(spark, d):
    return terms.top_terms(_lexicon(spark, d), "difference", 10).withColumn("value", F.round("value", 6))


@query("txt_10_11_tag_means", f"WITH {_TERMS}, {_VOCAB}, {_WEIGHTS}, s AS (SELECT source, count(*) AS n FROM d WHERE toxic = 1 GROUP BY 1) SELECT d.source AS tag, term, round(sum(w) / any_value(s.n), 6) AS mean FROM z JOIN d USING (doc_id) JOIN s ON s.source = d.source WHERE toxic = 1 AND term IN ('idiot', 'the', 'worthless', 'scum', 'de', 'la') GROUP BY 1, 2")
def _(spark, d):
    docs, tf = _terms(spark, d)
    w = terms.weights(tf, _vocab(docs, tf), "doc_id")
    tags = docs.where("toxic = 1").select("doc_id", F.col("source").alias("tag"))
    return terms.tag_means(w, tags, "doc_id", ["idiot", "the", "worthless", "scum", "de", "la"]).withColumn("mean", F.round("mean", 6))


@query("txt_12_fit_summary", f"WITH {_TERMS}, {_VOCAB} SELECT (SELECT n FROM n) AS n_docs, count(*) AS n_terms, round(min(idf), 6) AS idf_min, round(max(idf), 6) AS idf_max FROM v")
def _(spark, d):
    docs, tf = _terms(spark, d)
    n = docs.count()
    return _vocab(docs, tf).agg(F.lit(n).cast("long").alias("n_docs"), F.count("*").alias("n_terms"), F.round(F.min("idf"), 6).alias("idf_min"), F.round(F.max("idf"), 6).alias("idf_max"))


@query("sta_01_02_correlations", f"WITH {R}, v AS (SELECT perspective AS x, detoxify AS y FROM r WHERE {VALID}), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM v) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k")
def _(spark, d):
    out = statistics.correlations(_labelled_reviews(spark, d), "perspective", "detoxify")
    return out.withColumns({"pearson": F.round("pearson", 6), "spearman": F.round("spearman", 6)})


@query("sta_03_moments", f"WITH {R} SELECT count(*) AS n, round(avg(perspective), 6) AS mp, round(stddev_samp(perspective), 6) AS sp, round(avg(detoxify), 6) AS md, round(stddev_samp(detoxify), 6) AS sd FROM r WHERE {VALID}")
def _(spark, d):
    return _labelled_reviews(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("perspective"), 6).alias("mp"), F.round(F.stddev_samp("perspective"), 6).alias("sp"), F.round(F.avg("detoxify"), 6).alias("md"), F.round(F.stddev_samp("detoxify"), 6).alias("sd"))


_VOTES = "w AS (SELECT o_orderkey AS item, o_orderpriority AS bin, rater, ((o_orderkey * 7 + o_custkey * rater) % 5 < 2)::INT AS vote FROM orders CROSS JOIN (SELECT unnest([1, 2, 3]) AS rater))"


def _votes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("bin"), "o_custkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater"))
    return o.select("item", "bin", "rater", ((F.col("item") * 7 + F.col("o_custkey") * F.col("rater")) % 5 < 2).cast("int").alias("vote"))


@query("sta_04_kappas", f"WITH {_VOTES}, i AS (SELECT bin, item, sum(vote) AS a, count(*) - sum(vote) AS b FROM w GROUP BY 1, 2), p AS (SELECT bin, count(*) AS n_items, avg((a * (a - 1) + b * (b - 1)) / 6.0::DOUBLE) AS po, sum(a)::DOUBLE / sum(a + b) AS s FROM i GROUP BY 1) SELECT bin, n_items, round(po, 6) AS observed, round((po - 0.5) / 0.5, 6) AS kappa_randolph, round((po - (s * s + (1 - s) * (1 - s))) / (1 - (s * s + (1 - s) * (1 - s))), 6) AS kappa_fleiss FROM p")
def _(spark, d):
    return statistics.kappas(_votes(spark, d), "bin", "item", "vote").select("bin", "n_items", *(F.round(c, 6).alias(c) for c in ("observed", "kappa_randolph", "kappa_fleiss")))


@query("sta_05_majorities", f"WITH {_VOTES}, i AS (SELECT bin, item, count(DISTINCT vote) AS k, avg(vote) AS m FROM w GROUP BY 1, 2), p AS (SELECT bin, count(*) FILTER (WHERE k = 1) AS n_unanimous, count(*) FILTER (WHERE m > 0.5) AS n_toxic_items, count(*) FILTER (WHERE m < 0.5) AS n_neutral_items FROM i GROUP BY 1) SELECT *, CASE WHEN n_toxic_items > n_neutral_items THEN 'toxic' WHEN n_toxic_items < n_neutral_items THEN 'neutral' ELSE 'tie' END AS majority FROM p")
def _(spark, d):
    return statistics.majorities(_votes(spark, d), "bin", "item", "vote")


@query("sta_06_missing_votes", f"WITH {_VOTES}, m AS (SELECT item, rater, CASE WHEN (item + rater) % 4 = 0 THEN NULL ELSE vote END AS vote FROM w), q AS (SELECT item, count(*) FILTER (WHERE vote IS NULL) AS k, count(*) FILTER (WHERE vote = 1) AS a, count(*) FILTER (WHERE vote = 0) AS b FROM m GROUP BY 1) SELECT item, rater, coalesce(vote, CASE WHEN a > b THEN 1 ELSE 0 END)::INT AS vote FROM m JOIN q USING (item) WHERE k = 0 OR a <> b")
def _(spark, d):
    votes = _votes(spark, d).select("item", "rater", F.when((F.col("item") + F.col("rater")) % 4 != 0, F.col("vote")).alias("vote"))
    return statistics.resolve_missing(votes, "item", "vote", fill=True)


_SCORED = f"s AS (SELECT {TOXIC} AS y, declared, round((hours_played % 97) / 97 * 0.5 + coalesce(detoxify, 0) * 0.5, 4) AS p FROM r)"


def _scored(spark, d):
    y = labels.toxic(F.col("perspective"), F.col("detoxify"))
    p = F.round(F.col("hours_played") % 97 / 97 * 0.5 + F.coalesce("detoxify", F.lit(0.0)) * 0.5, 4)
    return reviews(spark, d).select(y.alias("y"), "declared", p.alias("p"))


_CURVE = "k AS (SELECT declared, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY declared) AS np, sum(neg) OVER (PARTITION BY declared) AS nn FROM k WINDOW w AS (PARTITION BY declared ORDER BY p DESC))"


@query("sta_10_11_ranking_metrics", f"WITH {R}, {_SCORED}, {_CURVE} SELECT declared, (max(np) + max(nn))::BIGINT AS n, round(max(np)::DOUBLE / (max(np) + max(nn)), 6) AS prevalence, round(sum(pos::DOUBLE / np * tp / (tp + fp)), 6) AS auc_pr, round(sum(neg::DOUBLE * (tp - pos::DOUBLE / 2)) / (max(np)::DOUBLE * max(nn)), 6) AS auc_roc FROM c GROUP BY 1")
def _(spark, d):
    out = statistics.ranking_metrics(_scored(spark, d), "y", "p", ["declared"])
    return out.withColumns({c: F.round(c, 6) for c in ("prevalence", "auc_pr", "auc_roc")})


@query("sta_10_decision_metrics", f"WITH {R}, {_SCORED}, c AS (SELECT declared, count(*) FILTER (WHERE y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5)::DOUBLE AS tn FROM s GROUP BY 1), e AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS pe FROM c) SELECT declared, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp), 6) AS precision_pos, round(tp / (tp + fn), 6) AS recall_pos, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_pos, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1_macro, round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa FROM e")
def _(spark, d):
    s = _scored(spark, d).withColumn("q", (F.col("p") >= 0.5).cast("int"))
    out = statistics.decision_metrics(s, "y", "q", ["declared"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision_pos", "recall_pos", "f1_pos", "f1_macro", "accuracy", "kappa")})


_GRID = ", ".join(repr(0.01 + (0.999 - 0.01) * i / 19) for i in range(20))


@query("sta_08_best_threshold", f"WITH {R}, {_SCORED}, t AS (SELECT DISTINCT unnest(quantile_cont(p, [{_GRID}])) AS t FROM s), c AS (SELECT t, count(*) FILTER (WHERE y = 1 AND p >= t)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p >= t)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p < t)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND p < t)::DOUBLE AS tn FROM s, t GROUP BY 1), f AS (SELECT t, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 12) AS f FROM c) SELECT round(t, 6) AS threshold, round(f, 6) AS f1_macro FROM f ORDER BY f DESC, t LIMIT 1")
def _(spark, d):
    out = statistics.best_threshold(_scored(spark, d), "y", "p", grid=20)
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("f1_macro", 6).alias("f1_macro"))


@query("sta_12_paired_bootstrap", bootstrap_sql("SELECT doc_id AS k, toxic AS y, (doc_id % 17) / 17 AS a, (doc_id % 13) / 13 + toxic AS b FROM labels", rounds=50, seed=7))
def _(spark, d):
    s = table(spark, d, "labels").select("doc_id", "toxic", (F.col("doc_id") % 17 / 17).alias("a"), (F.col("doc_id") % 13 / 13 + F.col("toxic")).alias("b"))
    return bootstrap.paired_bootstrap(s, "doc_id", "toxic", "a", "b", rounds=50).select(*(F.round(c, 6).alias(c) for c in ("delta", "low", "high")), "excludes_0")


@query("sta_16_self_preference", "WITH j AS (SELECT l_returnflag AS generator, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS judge, l_quantity AS s FROM lineitem) SELECT judge, round(avg(s) FILTER (WHERE judge = generator), 6) AS own, round(avg(s) FILTER (WHERE judge <> generator), 6) AS others, round(avg(s) FILTER (WHERE judge = generator) - avg(s) FILTER (WHERE judge <> generator), 6) AS bias FROM j GROUP BY 1")
def _(spark, d):
    j = table(spark, d, "lineitem").selectExpr("l_returnflag AS generator", "CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS judge", "l_quantity AS s")
    own, others = F.avg(F.when(F.col("judge") == F.col("generator"), F.col("s"))), F.avg(F.when(F.col("judge") != F.col("generator"), F.col("s")))
    return j.groupBy("judge").agg(F.round(own, 6).alias("own"), F.round(others, 6).alias("others"), F.round(own - others, 6).alias("bias"))


@query("sta_17_claims", "WITH c AS (SELECT 'orders' AS claim, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'mean price', avg(o_totalprice) FROM orders) SELECT claim, p.published, p.decimals, round(value, 4) AS value, round(p.published * pow(10.0, p.decimals)) = round(value * pow(10.0, p.decimals)) AS agrees FROM (SELECT 'orders' AS claim, 15000.0::DOUBLE AS published, 0 AS decimals UNION ALL SELECT 'mean price', 1.5::DOUBLE, 1) p LEFT JOIN c USING (claim)")
def _(spark, d):
    claims = spark.createDataFrame([("orders", 15000.0, 0), ("mean price", 1.5, 1)], "claim string, published double, decimals int")
    o = table(spark, d, "orders")
    computed = o.agg(F.lit("orders").alias("claim"), F.count("*").cast("double").alias("value")).union(o.agg(F.lit("mean price"), F.avg("o_totalprice")))
    return statistics.claim_table(claims, computed).withColumn("value", F.round("value", 4))


@query("sta_18_summary_block", "SELECT count(*) AS n, round(avg(c), 6) AS mean, median(c) AS med, quantile_cont(c, 0.9) AS p90, max(c) AS most, round(avg((c = 1)::INT) * 100, 4) AS pct_one FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1)")
def _(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("c"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.median("c").alias("med"), F.percentile("c", 0.9).alias("p90"), F.max("c").alias("most"), F.round(F.avg((F.col("c") == 1).cast("int")) * 100, 4).alias("pct_one"))


@query("sta_19_recomputation", "SELECT count(*) AS n_groups, true AS same FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def _(spark, d):
    li = table(spark, d, "lineitem")
    saved = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    again = li.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"))
    return saved.agg(F.count("*").alias("n_groups"), F.lit(statistics.same_rows(saved, again)).alias("same"))


@query("ord_04_largest_per_column", "WITH m AS (SELECT l_partkey AS k, 'quantity' AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_partkey, 'tax', round(sum(l_tax), 6) FROM lineitem GROUP BY 1) SELECT c, k, round(v, 6) AS v, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v DESC, k) AS rank FROM m) WHERE rank <= 3")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_tax"), 6).alias("tax"))
    long = m.unpivot("k", ["quantity", "tax"], "c", "v")
    return sampling.top_k(long, ["c"], [F.desc("v"), F.col("k")], 3).select("c", "k", F.round("v", 6).alias("v"), "rank")


@query("ord_06_by_row_mean", "SELECT l_shipmode, round((a + b) / 2, 6) AS mean FROM (SELECT l_returnflag AS l_shipmode, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1) ORDER BY mean DESC")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return m.select("l_shipmode", F.round((F.col("a") + F.col("b")) / 2, 6).alias("mean")).orderBy(F.desc("mean"))


@query("set_04_uncovered_terms", f"WITH {G} SELECT DISTINCT tag FROM (SELECT unnest(g.tags) AS tag FROM g JOIN part ON game_id = p_partkey WHERE p_size > 20) WHERE tag NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part WHERE p_retailprice > 1990)")
def _(spark, d):
    g = table(spark, d, "part").select("p_size", "p_retailprice", F.explode(F.split("p_name", " ")).alias("tag"))
    return g.where("p_size > 20").select("tag").distinct().join(g.where("p_retailprice > 1990").select("tag"), "tag", "left_anti")


@query("str_11_for_terms", f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.for_terms(F.col("text")).alias("clean"))


@query("sta_07_equal_bins", "WITH c AS (SELECT 'bin' AS name, count(*) AS n FROM orders GROUP BY o_orderkey % 5 UNION ALL SELECT 'status', count(*) FROM orders GROUP BY o_orderstatus) SELECT name FROM c GROUP BY 1 HAVING min(n) = max(n) AND count(*) > 1")
def _(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("bin"), F.col("o_orderstatus").alias("status"))
    return spark.createDataFrame([(c,) for c in statistics.equal_bins(o, ["bin", "status"])], "name string")


_BALANCED = "y AS (SELECT doc_id, toxic, round((doc_id % 17) / 17 * 0.7 + toxic * 0.3, 4) AS p FROM labels), e AS (SELECT doc_id, toxic, p, k::INT AS draw FROM y CROSS JOIN range(5) t(k)), q AS (SELECT *, row_number() OVER (PARTITION BY toxic, draw ORDER BY ('0x' || substr(md5(doc_id || ':' || draw || 'bal'), 1, 15))::BIGINT, doc_id) AS rn FROM e), s AS (SELECT toxic AS y, p, draw FROM q WHERE toxic = 1 OR rn <= (SELECT count(*) FROM y WHERE toxic = 1) UNION ALL SELECT toxic, p, -1 FROM y)"


@query("sta_14_15_real_and_balanced", f"WITH {_BALANCED}, k AS (SELECT draw, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY draw) AS np FROM k WINDOW w AS (PARTITION BY draw ORDER BY p DESC)), a AS (SELECT draw, sum(pos::DOUBLE / np * tp / (tp + fp)) AS ap FROM c GROUP BY 1) SELECT CASE WHEN draw < 0 THEN 'real' ELSE 'balanced' END AS kind, count(*) AS n, round(avg(ap), 6) AS mean, round(coalesce(stddev_samp(ap), 0), 6) AS sd FROM a GROUP BY 1")
def _(spark, d):
    y = table(spark, d, "labels").select("doc_id", "toxic", F.round(F.col("doc_id") % 17 / 17 * 0.7 + F.col("toxic") * 0.3, 4).alias("p"))
    draws = sampling.balanced_draws(y, "toxic", "doc_id", 5, "bal").unionByName(y.withColumn("draw", F.lit(-1)))
    ap = statistics.ranking_metrics(draws, "toxic", "p", ["draw"])
    kind = F.when(F.col("draw") < 0, "real").otherwise("balanced").alias("kind")
    return ap.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg("auc_pr"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("auc_pr"), F.lit(0.0)), 6).alias("sd"))


@query("txt_13_ordering_claims", f"WITH {_TERMS}, {_VOCAB}, {_WEIGHTS}, m AS (SELECT source, term, sum(w) / any_value(k.n) AS mean FROM z JOIN d USING (doc_id) JOIN (SELECT source, count(*) AS n FROM d GROUP BY 1) AS k USING (source) GROUP BY 1, 2), q AS (SELECT * FROM (VALUES ('the', 'src0', 'src1'), ('de', 'src1', 'src0'), ('nowhere', 'src0', 'src1')) AS q(term, high, low)) SELECT q.*, CASE WHEN a.mean IS NULL OR b.mean IS NULL THEN 'skipped' WHEN a.mean > b.mean THEN 'holds' ELSE 'contradicted' END AS verdict FROM q LEFT JOIN m AS a ON a.term = q.term AND a.source = high LEFT JOIN m AS b ON b.term = q.term AND b.source = low")
def _(spark, d):
    docs, tf = _terms(spark, d)
    w = terms.weights(tf, _vocab(docs, tf), "doc_id")
    matrix = terms.tag_means(w, docs.select("doc_id", F.col("source").alias("tag")), "doc_id", ["the", "de"])
    claims = terms.ordering_claims(matrix, [("the", "src0", "src1"), ("de", "src1", "src0"), ("nowhere", "src0", "src1")])
    return spark.createDataFrame(claims, "term string, high string, low string, verdict string")
