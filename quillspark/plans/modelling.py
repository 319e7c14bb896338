"""Queries: feature tables, vectors, models, external models and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import hashing, labels, parsing, text
from quillspark.operators import bootstrap, buckets, chunking, features, inference, language, models, sampling, semantic, sketches, statistics, terms, toxicity
from quillspark.plans.registry import query
from quillspark.plans.roles import CLEAN, MD5, P, R, TOXIC, labelled, profiles, reviews, table
from quillspark.sources import npy
from quillspark.sources.staging import shared_path, staged
from quillspark.streaming import incremental


def _resolved(spark, d):
    r = reviews(spark, d).select(
        F.col("review_url"), F.concat(F.lit("https://host/profiles/"), "user_id").alias("user_url"), "game_id", F.concat_ws(" ", "review_lang", "declared", "game_id").alias("review_text"),
        "is_recommended", "hours_played", "review_date", F.col("perspective").alias("perspective_score"), F.col("detoxify").alias("toxicity"),
    )
    users = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("steam_id"))
    g = table(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.array(F.when(F.col("p_size") > 25, "PvP").otherwise("Comedy"), F.lit("Gore")).alias("popular_tags"), F.when(F.col("p_size") == 1, 1).alias("has_review_bombing"))
    return features.resolve_reviews(r.groupBy("review_url").agg(*(F.min(c).alias(c) for c in r.columns[1:])), users, g)


@query("fea_01_resolved_reviews", f"WITH {R}, m AS (SELECT review_url, min('https://host/profiles/' || user_id) AS uu, min(game_id) AS game_id, min(review_lang || ' ' || declared || ' ' || game_id) AS txt, min(hours_played) AS hours_played, min(review_date) AS review_dt, min(perspective) AS perspective, min(detoxify) AS detoxify FROM r GROUP BY 1) SELECT review_url AS review_id, regexp_extract(uu, 'profiles/([0-9]+)', 1) AS user_key, {TOXIC} AS y_review, length(txt)::INT AS len_chars, len(string_split(txt, ' '))::INT AS len_words, year(review_dt)::INT AS review_year, (regexp_extract(uu, 'profiles/([0-9]+)', 1)::BIGINT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS joinable, coalesce(p_size > 25, false) AS g_competitive, (p_size IS NOT NULL) AS g_violent, coalesce(p_size <= 25, false) AS g_comedy, coalesce((p_size = 1)::INT, 0) AS g_review_bombing FROM m LEFT JOIN part ON game_id = p_partkey")
def _(spark, d):
    out = _resolved(spark, d)
    return out.select("review_id", "user_key", "y_review", "len_chars", "len_words", "review_year", "joinable", "g_competitive", "g_violent", "g_comedy", "g_review_bombing")


def _user_profiles(spark, d):
    p = profiles(spark, d)
    return p.select(F.col("user_id").cast("string").alias("user_key"), "profile_level", "library_size", "country", "has_ban", *(F.lit(None).cast("long").alias(c) for c in ("awards", "insignias", "screenshots", "workshop_items", "guides", "arts", "groups")), F.when(F.col("has_ban"), 10).alias("days_since_last_ban"), F.lit("en,fr").alias("reviews_langs"))


@query("fea_02_user_features", f"WITH {P}, o AS (SELECT o_custkey AS user_id, max((o_totalprice > 300000)::INT) AS y_user, sum((o_totalprice > 300000)::INT)::BIGINT AS n_toxic, count(*) AS n_reviews, count(DISTINCT o_orderkey % 50) AS n_distinct_games, round(quantile_cont(o_totalprice, 0.5), 4) AS hours_med, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INT AS tenure_days FROM orders GROUP BY 1), m AS (SELECT median(profile_level) AS lv FROM p) SELECT o.user_id::VARCHAR AS user_key, y_user, n_toxic, n_reviews, n_distinct_games, hours_med, tenure_days, round(coalesce(n_reviews::DOUBLE / nullif(tenure_days, 0) * 365, 0), 6) AS reviews_per_year, round(coalesce(profile_level, lv), 4)::DOUBLE AS profile_level, (profile_level IS NULL)::INT AS profile_level_missing, coalesce(CASE WHEN has_ban THEN 10 END, 9999) AS ban_recency_days, 2 AS n_review_langs, CASE WHEN {MD5.format('o.user_id::VARCHAR')} % 100 < 70 THEN 'train' WHEN {MD5.format('o.user_id::VARCHAR')} % 100 < 85 THEN 'val' ELSE 'test' END AS split FROM o LEFT JOIN p USING (user_id) CROSS JOIN m")
def _(spark, d):
    o = table(spark, d, "orders")
    r = o.select(F.col("o_custkey").cast("string").alias("user_key"), F.lit(True).alias("joinable"), (F.col("o_totalprice") > 300000).cast("int").alias("y_review"), (F.col("o_orderkey") % 50).alias("game_id_int"), F.lit(True).alias("is_recommended"), F.col("o_totalprice").alias("hours_played"), F.col("o_orderdate").cast("date").alias("review_dt"), *(F.lit(False).alias(f"g_{k}") for k in ("competitive", "violent", "comedy")))
    out = features.user_features(r, _user_profiles(spark, d), "2024-06-30")
    return out.select("user_key", "y_user", "n_toxic", "n_reviews", "n_distinct_games", F.round("hours_med", 4).alias("hours_med"), "tenure_days", F.round("reviews_per_year", 6).alias("reviews_per_year"), F.round("profile_level", 4).alias("profile_level"), "profile_level_missing", "ban_recency_days", "n_review_langs", "split")


@query("fea_04_labels", f"WITH {R}, u AS (SELECT user_id, count(*) AS n_reviews, sum({TOXIC})::BIGINT AS n_toxic FROM r GROUP BY 1) SELECT user_id, (n_toxic >= 1)::INT AS y_count, (n_toxic / greatest(1, n_reviews) >= 0.1)::INT AS y_rate, (n_reviews >= 5)::INT AS rate_pop FROM u")
def _(spark, d):
    u = reviews(spark, d).groupBy("user_id").agg(F.count("*").alias("n_reviews"), F.sum(labels.toxic(F.col("perspective"), F.col("detoxify"))).alias("n_toxic"))
    return features.modeling_labels(u).select("user_id", "y_count", "y_rate", "rate_pop")


#: (column, type, role) of the resolved reviews, in the order of the columns.
_ROLES = """
review_id string key, review_text string feature_text, is_recommended boolean gray,
hours_played double gray, perspective_score double FORBIDDEN, toxicity double FORBIDDEN, review_dt date meta,
user_key string key, group_key string key, url_type string meta, game_id_int bigint meta, y_review int label, tox_source string analysis,
len_chars int feature, len_words int feature, caps_ratio double feature, upper_word_count int feature, rrun_count int feature,
excl_count int feature, ques_count int feature, review_year int gray, joinable boolean meta, g_competitive boolean gray,
g_violent boolean gray, g_comedy boolean gray, g_review_bombing int gray, split string meta
"""


@query("fea_05_column_roles", f"SELECT 'reviews_resolved' AS \"table\", w[1] AS \"column\", w[2] AS type, w[3] AS role FROM (SELECT string_split(trim(unnest(string_split(replace('{_ROLES}', chr(10), ' '), ','))), ' ') AS w)")
def _(spark, d):
    written = staged(features.role_table(_resolved(spark, d), "reviews_resolved", features.REVIEW_ROLES), "roles")
    return written.select("table", "column", "type", "role")


@query("fea_06_sanity_report", f"WITH {R}, s AS (SELECT CASE WHEN {MD5.format('user_id::VARCHAR')} % 100 < 70 THEN 'train' WHEN {MD5.format('user_id::VARCHAR')} % 100 < 85 THEN 'val' ELSE 'test' END AS split, {TOXIC} AS y, is_recommended FROM r) SELECT split, count(*) AS n, round(100.0::DOUBLE * sum(y) / count(*), 3) AS pct_toxic, count(*) FILTER (WHERE is_recommended IS NULL) AS n_unrated FROM s GROUP BY 1")
def _(spark, d):
    s = reviews(spark, d).select(hashing.split_name(F.col("user_id")).alias("split"), labels.toxic(F.col("perspective"), F.col("detoxify")).alias("y"), "is_recommended")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.round(100 * F.sum("y") / F.count("*"), 3).alias("pct_toxic"), F.count_if(F.col("is_recommended").isNull()).alias("n_unrated"))


@query("agg_26_vector_means", "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE embedding[1] > 0) SELECT label, pos::INT - 1 AS pos, round(avg(x::DOUBLE), 5) AS x FROM e GROUP BY 1, 2")
def _(spark, d):
    m = features.vector_mean(table(spark, d, "embeddings"), "label", "embedding", F.col("embedding")[0] > 0)
    return m.select("label", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 5))


def _users(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("user_key"), "embedding", (F.col("label") < 4).cast("int").alias("y"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)), F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("c"), F.col("vec_id") % 20)).alias("country"))


@query("ml_01_06_out_of_fold")
def _(spark, d):
    data = sampling.folds(_users(spark, d), "y", "user_key", 3)
    kinds = {"profile": {"numeric": ["x0", "x1", "x2", "x3"], "categorical": ["country"]}, "content": {"numeric": [], "vector": "embedding"}}
    oof = models.arms(data, "user_key", "fold", ["y"], kinds, ["logreg"])
    return statistics.ranking_metrics(oof, "y", "score", ["arm", "model"]).withColumns({c: F.round(c, 4) for c in ("auc_pr", "auc_roc")})


@query("ml_04_forest")
def _(spark, d):
    data = sampling.folds(_users(spark, d), "y", "user_key", 2)
    return statistics.ranking_metrics(models.out_of_fold(data, "user_key", "y", "fold", "forest", ["x0", "x1", "x2", "x3"]), "y", "score", ["fold"])


@query("ml_04_hist_boosting")
def _(spark, d):
    data = sampling.folds(_users(spark, d), "y", "user_key", 2)
    oof = models.out_of_fold(data, "user_key", "y", "fold", "hist_boosted", [], vector="embedding")
    return statistics.ranking_metrics(oof, "y", "score", ["fold"])


@query("ml_04_extra_trees")
def _(spark, d):
    data = sampling.folds(_users(spark, d), "y", "user_key", 2)
    oof = models.out_of_fold(data, "user_key", "y", "fold", "extra_trees", [], vector="embedding")
    return statistics.ranking_metrics(oof, "y", "score", ["fold"])


@query("ml_05_rbf_machine")
def _(spark, d):
    data = sampling.folds(_users(spark, d), "y", "user_key", 2)
    oof = models.out_of_fold(data, "user_key", "y", "fold", "rbf", [], vector="embedding")
    return statistics.ranking_metrics(oof, "y", "score", ["fold"])


_MARKED = ", ".join(f"len([x for x in w if x IN ({', '.join(map(repr, marks))})]) AS {lang}" for lang, marks in sorted(inference.MARKERS.items()))


@query("udf_01_02_language_detection", rf"WITH c AS (SELECT lang, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(coalesce(text, ''), 2000), 'http\S+|www\.\S+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[0-9_]+', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents), w AS (SELECT lang, CASE WHEN length(c) >= 20 THEN string_split(lower(c), ' ') ELSE [] END AS w FROM c), n AS (SELECT lang, {_MARKED} FROM w) SELECT lang, CASE greatest(de, en, es, fr, pt) WHEN 0 THEN 'und' WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' WHEN fr THEN 'fr' ELSE 'pt' END AS review_lang, count(*) AS n FROM n GROUP BY 1, 2")
def _(spark, d):
    found = inference.detect_language(table(spark, d, "documents").select("doc_id", "lang", "text"), "text")
    return found.groupBy("lang", "review_lang").agg(F.count("*").alias("n"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(coalesce(text, ''), 2000), 'http\S+|www\.\S+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[0-9_]+', ' ', 'g'), '\s+', ' ', 'g'))"
_GRAMS = "list_filter(flatten([[substr(' ' || word || ' ', i, k) FOR i IN range(1, length(word) + 4 - k)] FOR k IN [1, 2, 3]]), lambda x: length(x) > 0)"
#: Log-probabilities of n-grams by language, as fitted on the documents that aren't held out, and their sums over each text.
_FITTED_LANGUAGE = f"""
WITH c AS (SELECT doc_id, lang, {MD5.format('doc_id::VARCHAR')} % 5 = 0 AS held_out, {_CLEAN} AS c FROM documents),
w AS (SELECT doc_id, lang, held_out, unnest(string_split(lower(c), ' ')) AS word FROM c WHERE length(c) >= 20),
l AS (SELECT DISTINCT lang FROM c WHERE lang IS NOT NULL AND NOT held_out),
g AS (SELECT lang, unnest({_GRAMS}) AS gram FROM w WHERE lang IS NOT NULL AND NOT held_out),
n AS (SELECT gram, lang, count(*) AS n FROM g GROUP BY 1, 2),
kept AS (SELECT gram FROM n GROUP BY 1 ORDER BY sum(n) DESC, gram LIMIT {language.MOST_GRAMS}),
t AS (SELECT lang, sum(n) AS t FROM n JOIN kept USING (gram) GROUP BY 1),
m AS (SELECT kept.gram, l.lang, round(1000 * ln((coalesce(n, 0) + 0.5) / (t + 0.5 * (SELECT count(*) FROM kept))))::BIGINT AS s FROM kept CROSS JOIN l JOIN t ON t.lang = l.lang LEFT JOIN n ON n.gram = kept.gram AND n.lang = l.lang),
d AS (SELECT doc_id, unnest({_GRAMS}) AS gram FROM w),
f AS (SELECT doc_id, gram, count(*) AS n FROM d GROUP BY 1, 2),
s AS (SELECT doc_id, m.lang, sum(f.n * s)::BIGINT AS s FROM f JOIN m USING (gram) GROUP BY 1, 2),
b AS (SELECT doc_id, first(lang ORDER BY s DESC, lang) AS review_lang, max(s) AS best FROM s GROUP BY 1),
p AS (SELECT doc_id, any_value(review_lang) AS review_lang, 1 / sum(exp((s - best) / 1000.0)) AS confidence FROM s JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(review_lang, 'und') AS review_lang, round(coalesce(confidence, 0), 5) AS detection_confidence, held_out FROM c LEFT JOIN p USING (doc_id)
"""


@query("udf_01_02_fitted_language", _FITTED_LANGUAGE)
def _(spark, d):
    """Fitted on four fifths of the documents by the md5 of their ids, applied to all."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = hashing.md5_bucket(F.col("doc_id"), 5) == 0
    path = shared_path(spark, "languages")
    language.fit(docs.where(~held_out), "text", "lang").save(path)
    found = language.detect(docs, "doc_id", "text", language.LanguageModel.load(spark, path))
    return found.select("doc_id", "review_lang", F.round("detection_confidence", 5).alias("detection_confidence"), held_out.alias("held_out"))


@query("udf_01_detection_gate", r"SELECT count(*) AS n, count(*) FILTER (WHERE length(c) < 20) AS n_short FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(text, 2000), 'http\S+|www\.\S+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[0-9_]+', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents)")
def _(spark, d):
    from quillspark.functions.text import for_detection

    c = F.length(for_detection(F.col("text")))
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(c < 20).alias("n_short"))


_RUDE = r"(?i)\b(idiot|stupid|worthless|pathetic|scum|trash|moron|loser)\b"


@query("scr_01_toxicity_scores", f"SELECT doc_id, round(1 - exp(-len(regexp_extract_all(left(trim(coalesce(text, '')), 1200), '{_RUDE}'))), 6)::DOUBLE AS detoxify_score FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(inference.toxicity(F.col("text")), 6).alias("detoxify_score"))


@query("scr_01_fitted_toxicity")
def _(spark, d):
    """Fitted on four fifths of the labelled documents by the md5 of their ids, saved, read and applied to all documents."""
    known, path = labelled(spark, d), shared_path(spark, "toxicity")
    toxicity.fit(known.where(hashing.md5_bucket(F.col("doc_id"), 5) != 0), "doc_id", "text", "toxic").save(path)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return toxicity.ToxicityModel.load(path).transform(docs, "text").select("doc_id", F.round("detoxify_score", 6).alias("detoxify_score"), (hashing.md5_bucket(F.col("doc_id"), 5) == 0).alias("held_out"))


@query("scr_02_snk_06_07_cached_scores", "SELECT doc_id, CASE WHEN lang = 'en' AND NOT regexp_matches(text, '(?i)license') THEN 0.25 ELSE round(1 - exp(-len(regexp_extract_all(left(trim(text), 1200), '(?i)\\b(idiot|stupid|worthless|pathetic|scum|trash|moron|loser)\\b'))), 6) END::DOUBLE AS detoxify_score FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    cache = docs.where("lang = 'en'").select("doc_id", F.lit(0.25).alias("score"))
    return inference.score_with_cache(docs, cache, "doc_id", "text", exclude="license").select("doc_id", F.round("detoxify_score", 6).alias("detoxify_score"))


@query("emb_01_embeddings", r"WITH w AS (SELECT doc_id, md5(unnest(regexp_split_to_array(lower(text), '\s+'))) AS h FROM documents WHERE regexp_matches(text, '\S')), b AS (SELECT doc_id, ('0x' || substr(h, 15, 2))::INT % 64 AS i, sum(CASE WHEN ('0x' || substr(h, 1, 1))::INT >= 8 THEN 1 ELSE -1 END) AS v FROM w WHERE h <> md5('') GROUP BY 1, 2), v AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << i ELSE 0 END) AS up, bit_or(CASE WHEN v < 0 THEN 1::UBIGINT << i ELSE 0 END) AS down FROM b GROUP BY 1) SELECT doc_id, 64 AS size, CASE WHEN coalesce(up | down, 0) = 0 THEN 0 ELSE 1 END::DOUBLE AS norm, coalesce([i for i in range(64) if (up >> i) & 1 = 1], [])::INT[] AS positive, coalesce([i for i in range(64) if (down >> i) & 1 = 1], [])::INT[] AS negative FROM documents LEFT JOIN v USING (doc_id)")
def _(spark, d):
    e = table(spark, d, "documents").select("doc_id", inference.embed(F.col("text")).alias("v"))
    places = lambda keep: F.filter(F.transform("v", lambda x, i: F.when(keep(x), i)), lambda i: i.isNotNull())
    return e.select("doc_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("norm"), places(lambda x: x > 0).alias("positive"), places(lambda x: x < 0).alias("negative"))


@query("emb_01_semantic_vectors")
def _(spark, d):
    """Latent semantic vectors of all documents; the TF-IDF rows are staged, as every pass reads them."""
    docs = table(spark, d, "documents").select("doc_id", terms.tokens(text.for_terms(F.col("text")), terms.STOP_WORDS).alias("words"))
    tf = staged(terms.term_frequencies(docs, "doc_id", "words"), "tf")
    vocab = staged(terms.vocabulary(terms.term_counts(tf), docs.count(), min_df=5, max_features=20_000), "vocabulary")
    rows = staged(semantic.sparse_rows(terms.weights(tf, vocab, "doc_id"), vocab, "doc_id"), "rows")
    model = semantic.fit(rows, vocab.count(), size=32)
    return model.embed(rows, "doc_id").select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query("llm_01_02_classification", f"WITH s AS (SELECT conv_id, round(100 * (1 - exp(-sum(len(regexp_extract_all(coalesce(text, ''), '{_RUDE}')))))) / 100 AS s FROM conversations GROUP BY 1) SELECT conv_id, (s > 0.5)::INT AS _pred, s::DOUBLE AS _score, -1 AS _worst FROM s")
def _(spark, d):
    prompts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("prompt"))
    raw = inference.ask(prompts, "prompt", "Is this user toxic?")
    label = parsing.answer_label(F.col("_raw"))
    return raw.select("conv_id", F.coalesce(label, F.lit(0)).alias("_pred"), parsing.answer_score(F.col("_raw"), label).alias("_score"), parsing.answer_worst(F.col("_raw")).alias("_worst"))


@query("llm_03_chunks", "WITH RECURSIVE t AS (SELECT c_nationkey AS g, c_custkey AS k, c_custkey % 37 + 1 AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer), w AS (SELECT g, k, n, i, n AS used, 0 AS chunk FROM t WHERE i = 1 UNION ALL SELECT t.g, t.k, t.n, t.i, CASE WHEN w.used + t.n > 60 THEN t.n ELSE w.used + t.n END, CASE WHEN w.used + t.n > 60 THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN t ON t.i = w.i + 1 AND t.g = w.g) SELECT g, k, n, chunk FROM w")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_nationkey AS g", "c_custkey AS k", "c_custkey % 37 + 1 AS n")
    return chunking.chunk_by_budget(c, "k", "n", 60, group="g")


@query("llm_03_resumed_requests", "SELECT conv_id, turn FROM conversations WHERE turn <> 0")
def _(spark, d):
    """Requests of which the first turns are done and the second ones failed once."""
    requests, path = table(spark, d, "conversations").select("conv_id", "turn"), shared_path(spark, "requests")
    chunking.record(requests.where("turn < 2"), path, "sent")
    chunking.record(requests.where("turn = 0"), path, "done")
    chunking.record(requests.where("turn = 1"), path, "failed")
    return chunking.outstanding(requests, spark.read.parquet(path), ["conv_id", "turn"])


@query("agg_14_15_merged_sketches", "SELECT o_orderstatus, count(*) AS n_rows, true AS near_distinct, true AS near_median FROM orders GROUP BY 1")
def _(spark, d):
    """Sketches of three parts, merged, against the exact values: distinct customers within 6 %, the median's rank within 2 %."""
    o, path = table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_totalprice", (F.col("o_orderkey") % 3).alias("part")), shared_path(spark, "sketches")
    for p in range(3):
        sketches.add_part(o.where(F.col("part") == p), path, str(p), ["o_orderstatus"], ["o_custkey"], ["o_totalprice"])
    merged = sketches.estimates(sketches.merge(spark.read.parquet(path), ["o_orderstatus"]), ["o_orderstatus"], [0.5])
    joined = o.join(F.broadcast(merged.select(F.col("o_orderstatus").alias("s"), "n_o_custkey", F.get("q_o_totalprice", F.lit(0)).alias("median"))), F.col("o_orderstatus") == F.col("s"))  # a row for each status
    exact = joined.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n"), F.max("n_o_custkey").alias("near"), F.avg((F.col("o_totalprice") <= F.col("median")).cast("int")).alias("rank"))
    return exact.select("o_orderstatus", "n_rows", (F.abs(F.col("near") / F.col("n") - 1) < 0.06).alias("near_distinct"), (F.abs(F.col("rank") - 0.5) < 0.02 + 1 / F.col("n_rows")).alias("near_median"))


@query("ddp_02_jon_05_stored_buckets", "WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) SELECT c_nationkey, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM f JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _(spark, d):
    """Orders and customers stored in buckets by customer: the dearest order of each, joined without an exchange."""
    import uuid

    tag = uuid.uuid4().hex
    o = buckets.store(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), f"orders_{tag}", "c_custkey", 8, shared_path(spark, "orders"))
    c = buckets.store(table(spark, d, "customer").select("c_custkey", "c_nationkey"), f"customers_{tag}", "c_custkey", 8, shared_path(spark, "customers"))
    first = buckets.keep_first(o, "c_custkey", [-F.col("o_totalprice"), F.col("o_orderkey")])
    return first.join(c, "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("src_17_npy_vectors", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, d):
    """Vectors written as .npy files beside an index of keys, and read by file and row."""
    path = shared_path(spark, "npy")
    index = staged(npy.write_npy(table(spark, d, "embeddings"), "vec_id", "embedding", path), "index")
    files = sorted(r["file"] for r in index.select("file").distinct().collect())  # a file for each partition
    out = None
    for f in files:
        part = npy.read_npy(spark, f).withColumn("file", F.lit(f))
        out = part if out is None else out.unionByName(part)
    found = index.join(out, ["file", "row"])
    return found.select("vec_id", F.size("vector").cast("long").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("llm_04_curated_cells", f"WITH {R}, s AS (SELECT review_url, game_id, hours_played, CASE WHEN {TOXIC} = 1 AND hours_played > 40000 THEN 'TP' WHEN {TOXIC} = 0 AND hours_played > 40000 THEN 'FP' WHEN {TOXIC} = 1 THEN 'FN' ELSE 'TN' END AS cell FROM r) SELECT cell, review_url, game_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY hours_played DESC, review_url, game_id) AS rank FROM s) WHERE rank <= 3")
def _(spark, d):
    r = reviews(spark, d)
    cell = labels.confusion_cell(labels.toxic(F.col("perspective"), F.col("detoxify")), (F.col("hours_played") > 40000).cast("int"))
    return sampling.top_k(r.withColumn("cell", cell), ["cell"], [F.desc("hours_played"), F.col("review_url"), F.col("game_id")], 3).select("cell", "review_url", "game_id", "rank")


@query("llm_05_judge_pairs", "SELECT conv_id::VARCHAR AS user_key, g AS generator, j AS judge FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['a', 'b', 'c']) AS g), (SELECT unnest(['a', 'b', 'c']) AS j) WHERE g <> j AND NOT (conv_id IN (SELECT conv_id FROM conversations WHERE turn >= 4) AND g = 'a' AND j = 'b')")
def _(spark, d):
    keys = table(spark, d, "conversations").select("conv_id").distinct()
    narratives = keys.select(F.col("conv_id").cast("string").alias("user_key"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("generator"))
    done = table(spark, d, "conversations").where("turn >= 4").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("user_key"), F.lit("a").alias("generator"), F.lit("b").alias("judge"))
    return inference.judge_pairs(narratives, ["a", "b", "c"], done)


@query("snk_05_incremental_counts", "SELECT user_id, count(*) AS n, sum((value >= 50)::INT)::BIGINT AS n_toxic FROM events GROUP BY 1")
def _(spark, d):
    import uuid

    source = table(spark, d, "events").selectExpr("user_id", "CASE WHEN value >= 50 THEN 1.0D ELSE 0.0D END AS perspective", "0.0D AS detoxify")
    path = shared_path(spark, "events")
    source.write.parquet(path)
    stream = incremental.new_files(spark, path, source.schema)
    return incremental.latest_counts(spark, incremental.running_counts(stream, "user_id"), f"counts_{uuid.uuid4().hex}")


@query("ml_03_05_linear_and_mlp")
def _(spark, d):
    data = sampling.folds(_users(spark, d), "y", "user_key", 2)
    kinds = {"profile": {"numeric": ["x0", "x1", "x2", "x3"]}}
    oof = models.arms(data, "user_key", "fold", ["y"], kinds, ["logreg", "svm", "mlp"])
    return statistics.ranking_metrics(oof, "y", "score", ["model"])


@query("ml_07_sta_13_leave_toxic_out")
def _(spark, d):
    users = _users(spark, d).withColumns({"n_reviews": F.lit(3), "n_toxic": F.col("y")})
    data = sampling.folds(models.clean_population(users), "y", "user_key", 2)
    a = models.out_of_fold(data, "user_key", "y", "fold", "logreg", ["x0", "x1"]).select("user_key", "y", F.col("score").alias("a"))
    b = models.out_of_fold(data, "user_key", "y", "fold", "logreg", [], vector="embedding").select("user_key", F.col("score").alias("b"))
    return bootstrap.paired_bootstrap(a.join(b, "user_key"), "user_key", "y", "a", "b", rounds=100)


@query("smp_10_capped_training", f"WITH f AS (SELECT (row_number() OVER (PARTITION BY label < 4 ORDER BY {MD5.format('vec_id::VARCHAR')}) - 1) % 2 AS fold FROM embeddings) SELECT fold::INT AS fold, count(*) AS n FROM f GROUP BY 1")
def _(spark, d):
    data = sampling.folds(_users(spark, d), "y", "user_key", 2)
    return models.out_of_fold(data, "user_key", "y", "fold", "logreg", ["x0", "x1"], train_cap=100).groupBy("fold").agg(F.count("*").alias("n"))


@query("snk_13_saved_vocabulary", f"WITH w AS (SELECT doc_id, unnest(list_filter(string_split({CLEAN}, ' '), lambda t: length(t) >= 2)) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM t GROUP BY 1), k AS (SELECT term, tf, df FROM v, n WHERE df >= 5 AND df <= 0.8 * n ORDER BY tf DESC, term LIMIT 5000) SELECT term, row_number() OVER (ORDER BY term)::INT - 1 AS idx, tf, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf, n AS n_docs FROM k, n")
def _(spark, d):
    """The vocabulary of all documents, saved with their number and read again."""
    from quillspark.sources import writers

    path = shared_path(spark, "vocabulary")
    docs = table(spark, d, "documents").select("doc_id", terms.tokens(text.for_terms(F.col("text")), ()).alias("words"))
    vocab = terms.vocabulary(terms.term_counts(terms.term_frequencies(docs, "doc_id", "words")), n := docs.count(), min_df=5, max_features=5000)
    writers.vocabulary(vocab, n, path)
    saved = spark.read.parquet(path)
    return saved.select("term", F.col("idx").cast("int").alias("idx"), "tf", "df", F.round("idf", 6).alias("idf"), F.col("n_docs").cast("long").alias("n_docs"))


@query("udf_04_snk_05_parts", "SELECT o_orderstatus AS part_name, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    from quillspark.sources import writers

    path = shared_path(spark, "parts")
    o = table(spark, d, "orders")
    for s in ("F", "O", "P", "F"):
        writers.part_once(o.where(F.col("o_orderstatus") == s), path, s)
    return spark.read.parquet(path).groupBy("part_name").agg(F.count("*").alias("n"))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    import uuid

    path = shared_path(spark, "events")
    table(spark, d, "events").select("ts", "event_type").write.parquet(path)
    stream = incremental.new_files(spark, path, spark.read.parquet(path).schema)
    counts = incremental.latest_counts(spark, incremental.windowed_counts(stream, "ts", "event_type"), f"windows_{uuid.uuid4().hex}")
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
