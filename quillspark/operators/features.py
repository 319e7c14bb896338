"""Review-level and user-level feature tables, roles of columns, labels and vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import labels, parsing, text
from quillspark.functions.hashing import split_name
from quillspark.operators.dedup import keep_earliest
from quillspark.operators.ordering import exact_quantiles

#: Tags that make up a game's context flags.
TAG_FLAGS = {
    "g_competitive": ("PvP", "Team-Based", "Online Co-Op"),
    "g_violent": ("Gore", "Violent", "Shooter", "FPS"),
    "g_comedy": ("Comedy",),
}
#: Fixed value: ban recency of users without a ban.
NO_BAN_DAYS = 9999
#: Roles of columns; only `feature` and `gray` ones may enter a model.
REVIEW_ROLES = {
    "review_id": "key",
    "user_key": "key",
    "group_key": "key",
    "url_type": "meta",
    "review_lang": "meta",
    "joinable": "meta",
    "split": "meta",
    "review_dt": "meta",
    "game_id_int": "meta",
    "y_review": "label",
    "y_review_gold": "label",
    "tox_source": "analysis",
    "toxicity": "FORBIDDEN",
    "perspective_score": "FORBIDDEN",
    "severe_toxicity": "FORBIDDEN",
    "obscene": "FORBIDDEN",
    "identity_attack": "FORBIDDEN",
    "insult": "FORBIDDEN",
    "threat": "FORBIDDEN",
    "sexual_explicit": "FORBIDDEN",
    "review_text": "feature_text",
    "is_recommended": "gray",
    "hours_played": "gray",
    "review_year": "gray",
    "g_competitive": "gray",
    "g_violent": "gray",
    "g_comedy": "gray",
    "g_review_bombing": "gray",
    "len_chars": "feature",
    "len_words": "feature",
    "caps_ratio": "feature",
    "upper_word_count": "feature",
    "rrun_count": "feature",
    "excl_count": "feature",
    "ques_count": "feature",
}
#: The same for columns of users.
USER_ROLES = {
    "user_key": "key",
    "split": "meta",
    "y_user": "label",
    "n_toxic": "DIAGNOSTIC",
    "n_reviews_diag": "DIAGNOSTIC",
    "country": "gray",
    "country_is_brazil": "gray",
    "has_ban": "gray",
    "ban_recency_days": "gray",
    "y_count": "label",
    "y_rate": "label",
    "rate_pop": "meta",
    "n_reviews": "feature",
    "n_distinct_games": "feature",
    "pct_recommended": "feature",
    "hours_med": "feature",
    "hours_p90": "feature",
    "hours_total": "feature",
    "tenure_days": "feature",
    "days_since_last_review": "feature",
    "pct_competitive": "feature",
    "pct_violent": "feature",
    "pct_comedy": "feature",
    "reviews_per_year": "feature",
    "profile_level": "feature",
    "profile_level_missing": "feature",
    "library_size": "feature",
    "library_size_missing": "feature",
    "awards": "feature",
    "insignias": "feature",
    "screenshots": "feature",
    "workshop_items": "feature",
    "guides": "feature",
    "arts": "feature",
    "groups": "feature",
    "n_review_langs": "feature",
    "profile_visibility": "feature",
}


def has_any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def tag_flags(tags: Column, flags: Mapping[str, Sequence[str]] = TAG_FLAGS) -> dict[str, Column]:
    return {name: has_any_tag(tags, wanted) for name, wanted in flags.items()}


def resolve_reviews(reviews: DataFrame, users: DataFrame, games: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """The review-level table: earliest review of each URL with its user's and game's context.

    reviews has review_url, user_url, game_id, review_text, is_recommended, hours_played, review_date,
    perspective_score, toxicity; users has steam_id; games has game_id, popular_tags,
    has_review_bombing; gold has review_url, y_review_gold. Dates that don't parse count as last. The result has
    the columns of REVIEW_ROLES alone: addresses and raw forms of what it holds go.
    """
    dated = reviews.withColumn("review_dt", F.col("review_date").cast("string").try_cast("date"))
    first = keep_earliest(dated, ["review_url"], "review_dt", [F.xxhash64(*reviews.columns)])
    keyed = first.withColumns({"user_key": parsing.profile_id(F.col("user_url")), "group_key": parsing.group_key(F.col("user_url")), "url_type": parsing.url_type(F.col("user_url")), "game_id_int": F.col("game_id").cast("string").try_cast("bigint")})
    known = users.select(F.col("steam_id").alias("_uid")).distinct()
    context = games.select(F.col("game_id").alias("_gid"), "popular_tags", "has_review_bombing")
    out = keyed.join(known, F.col("user_key") == F.col("_uid"), "left").join(context, F.col("game_id_int") == F.col("_gid"), "left")
    if gold is not None:
        out = out.join(gold.select("review_url", "y_review_gold").dropDuplicates(["review_url"]), "review_url", "left")
    p, d = F.col("perspective_score"), F.col("toxicity")
    made = {
        "y_review": labels.toxic(p, d),
        "tox_source": labels.label_source(p, d),
        **text.surface_features(F.col("review_text")),
        "review_year": F.year("review_dt"),
        "joinable": F.col("_uid").isNotNull(),
        **tag_flags(F.col("popular_tags")),
        "g_review_bombing": F.coalesce("has_review_bombing", F.lit(0)),
        "split": split_name(F.col("group_key")),
    }
    named = out.withColumns(made).withColumnRenamed("review_url", "review_id")
    return named.select(*(c for c in named.columns if c in REVIEW_ROLES))


def user_features(reviews: DataFrame, profiles: DataFrame, as_of: str) -> DataFrame:
    """The user-level table from resolved reviews and profiles(user_key, ...), one aggregation and one join.

    Quantiles and distinct counts are exact. Missing counts become 0, profile_level and library_size
    the exact median of all profiles with a flag, and ban recency NO_BAN_DAYS; country stays null.
    Days since the last review count up to as_of.
    """
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    agg = reviews.where("user_key IS NOT NULL AND joinable").groupBy("user_key").agg(
        F.max("y_review").alias("y_user"), F.sum("y_review").alias("n_toxic"), F.count("*").alias("n_reviews"), F.count_distinct("game_id_int").alias("n_distinct_games"),
        F.coalesce(F.avg(F.when(F.col("is_recommended"), 1.0).when(~F.col("is_recommended"), 0.0)), F.lit(0.0)).alias("pct_recommended"),
        F.percentile("hours_played", 0.5).alias("hours_med"), F.percentile("hours_played", 0.9).alias("hours_p90"), F.sum("hours_played").alias("hours_total"),
        F.datediff(F.max("review_dt"), F.min("review_dt")).alias("tenure_days"), F.datediff(F.lit(as_of).cast("date"), F.max("review_dt")).alias("days_since_last_review"),
        *(share(F.col(f"g_{k}")).alias(f"pct_{k}") for k in ("competitive", "violent", "comedy")),
    )
    level, library = (exact_quantiles(profiles, c, [0.5]).select(F.get("q", F.lit(0)).alias(n)) for c, n in (("profile_level", "_level"), ("library_size", "_library")))
    out = agg.join(profiles, "user_key", "left").crossJoin(F.broadcast(level)).crossJoin(F.broadcast(library))  # one row each
    seen = [F.col(c).isNotNull().cast("int") for c in ("country", "profile_level", "library_size", "screenshots", "groups", "insignias")]
    visible = seen[0]
    for s in seen[1:]:
        visible = visible + s
    made = {
        "n_reviews_diag": F.col("n_reviews"),
        "reviews_per_year": F.coalesce(F.col("n_reviews") / F.nullif(F.col("tenure_days"), F.lit(0)) * 365, F.lit(0.0)),
        "profile_level_missing": F.col("profile_level").isNull().cast("int"),
        "library_size_missing": F.col("library_size").isNull().cast("int"),
        "profile_level": F.coalesce(F.col("profile_level").cast("double"), F.col("_level")),
        "library_size": F.coalesce(F.col("library_size").cast("double"), F.col("_library")),
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("awards", "insignias", "screenshots", "workshop_items", "guides", "arts", "groups")},
        "n_review_langs": parsing.value_count(F.col("reviews_langs")),
        "profile_visibility": visible / 6,
        "country_is_brazil": (F.col("country") == "Brazil").cast("int"),
        "has_ban": F.col("has_ban").cast("int"),
        "ban_recency_days": F.coalesce("days_since_last_ban", F.lit(NO_BAN_DAYS)),
        "split": split_name(F.col("user_key")),
    }
    return out.withColumns(made).drop("_level", "_library", "reviews_langs", "days_since_last_ban")


def modeling_labels(users: DataFrame, rho: float = 0.1, k_min: int = 5) -> DataFrame:
    """users with y_count, y_rate (toxic share of at least rho) and rate_pop (k_min reviews or more)."""
    rate = F.col("n_toxic") / F.greatest(F.lit(1), F.col("n_reviews")) >= rho
    return users.withColumns({"y_count": (F.col("n_toxic") >= 1).cast("int"), "y_rate": rate.cast("int"), "rate_pop": (F.col("n_reviews") >= k_min).cast("int")})


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, n_values) of a table's columns: the rows that have a value there, by one aggregation of the table."""
    each = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count(df[f"`{c}`"]).alias("n_values")) for c, t in df.dtypes]
    return df.agg(F.array(*each).alias("each")).select(F.inline("each"))


def role_table(df: DataFrame, table: str, roles: Mapping[str, str]) -> DataFrame:
    """(table, column, type, role, n_values) of a table's columns; unlisted ones are unlisted, and no model's."""
    listed = [(c, roles.get(c, "unlisted")) for c in df.columns]
    role = F.create_map(*(F.lit(x) for pair in listed for x in pair))[F.col("column")]
    return column_profile(df).select(F.lit(table).alias("table"), "column", "type", role.alias("role"), "n_values")


def model_columns(df: DataFrame, roles: Mapping[str, str]) -> list[str]:
    """The columns that may enter a model; a column without a role is a ValueError, so that none gets in unseen."""
    if unlisted := [c for c in df.columns if c not in roles]:
        raise ValueError(f"columns without a role: {', '.join(unlisted)}")
    return [c for c in df.columns if roles[c] in ("feature", "gray")]


def vector_mean(df: DataFrame, by: str, vector: str, where: Column | None = None) -> DataFrame:
    """(by, n, vec): the element-wise mean over a group's rows (those of `where`), null without any.

    Elements are averaged by (group, position), so no task holds a group's vectors.
    """
    kept = df if where is None else df.where(where)
    cells = kept.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    counts = df.groupBy(by).agg(F.count_if(F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("n"))
    return counts.join(means, by, "left")


def l2_normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0)))
