"""TF-IDF lexicon: smoothed idf, rows of unit length, class means, and tag profiles over a long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Generic words that say nothing about a review, beside a language's stop words.
EXTRA_STOP_WORDS = {
    "en": ("game", "steam", "play", "playing", "games"),
    "pt": ("jogo", "game", "steam", "jogar", "pra", "jogos", "games"),
}
#: A basic English stop list; the list is a parameter wherever it matters.
STOP_WORDS = tuple(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our ours out over own same she so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours".split()
)


def tokens(clean: Column, stop_words: Sequence[str]) -> Column:
    """Words of two letters or more of a cleaned text, without stop words."""
    stop = list(stop_words)
    return F.filter(F.split(clean, " "), lambda t: (F.length(t) >= 2) & ~t.isin(stop) if stop else F.length(t) >= 2)


def term_frequencies(docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, term, tf), one row for each term of a document."""
    return docs.select(id_col, F.explode(tokens_col).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def term_counts(tf: DataFrame) -> DataFrame:
    """(term, tf, df) over all documents."""
    return tf.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 100, max_df: float = 0.8, max_features: int = 100_000) -> DataFrame:
    """(term, idx, tf, df, idf): terms within the df bounds, the most frequent of them (ties by term), in term order.

    idf is ln((1 + N) / (1 + df)) + 1. At most max_features rows meet in one task, to be numbered.
    """
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).orderBy(F.desc("tf"), "term").limit(max_features)
    idf = F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1
    return kept.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "tf", "df", idf.alias("idf"))


def weights(tf: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, term, w): tf * idf over in-vocabulary terms, each document at unit length.

    A vocabulary has at most its max_features rows, and is broadcast.
    """
    raw = tf.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / norm).alias("w"))


def class_means(w: DataFrame, docs: DataFrame, id_col: str, label: str) -> DataFrame:
    """(term, toxic, neutral): mean weights over all documents of a class, absent ones being 0."""
    n = docs.agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    sums = w.join(docs.select(id_col, label), id_col).groupBy("term").agg(F.sum(F.when(F.col(label) == 1, F.col("w")).otherwise(0.0)).alias("s1"), F.sum(F.when(F.col(label) == 0, F.col("w")).otherwise(0.0)).alias("s0"))
    mean = lambda s, k: F.coalesce(F.col(s) / F.nullif(F.col(k), F.lit(0)), F.lit(0.0))
    return sums.crossJoin(F.broadcast(n)).select("term", mean("s1", "n1").alias("toxic"), mean("s0", "n0").alias("neutral"))


def lexicon(means: DataFrame) -> DataFrame:
    """means with the difference, the smoothed ratio and its log2."""
    ratio = F.col("toxic") / (F.col("neutral") + 1e-9)
    log_ratio = F.log2((F.col("toxic") + 1e-9) / (F.col("neutral") + 1e-9))
    return means.withColumns({"difference": F.col("toxic") - F.col("neutral"), "ratio": ratio, "log_ratio": log_ratio})


def top_terms(words: DataFrame, by: str, n: int) -> DataFrame:
    """(class, rank, term, value): the n terms of either class by `difference`, `log_ratio` or the class's own mean.

    Values are compared at ten decimals, so sums taken in another order don't change the ranks.
    """
    own = by == "mean"
    both = []
    for label, column, sign in (("toxic", "toxic", 1), ("neutral", "neutral", -1)):
        value = F.col(column) if own else sign * F.col(by)
        best = words.withColumn("_v", F.round(value, 10)).orderBy(F.desc("_v"), "term").limit(n)
        both.append(best.select(F.lit(label).alias("class"), F.row_number().over(Window.orderBy(F.desc("_v"), "term")).alias("rank"), "term", (F.col(column) if own else F.col(by)).alias("value")))
    return both[0].unionByName(both[1])


def tag_means(w: DataFrame, doc_tags: DataFrame, id_col: str, terms: Sequence[str]) -> DataFrame:
    """(tag, term, mean): mean weight of each term over all documents of a tag, from doc_tags(id, tag)."""
    n = doc_tags.groupBy("tag").agg(F.count("*").alias("n"))
    sums = doc_tags.join(w.where(F.col("term").isin(list(terms))), id_col).groupBy("tag", "term").agg(F.sum("w").alias("s"))
    return sums.join(n, "tag").select("tag", "term", (F.col("s") / F.col("n")).alias("mean"))


def ordering_claims(matrix: DataFrame, claims: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str, str]]:
    """For each claim (term, higher tag, lower tag): holds, contradicted or skipped (a cell is missing)."""
    cells = {(r["tag"], r["term"]): r["mean"] for r in matrix.where(F.col("term").isin([c[0] for c in claims])).collect()}
    out = []
    for term, high, low in claims:
        a, b = cells.get((high, term)), cells.get((low, term))
        out.append((term, high, low, "skipped" if a is None or b is None else "holds" if a > b else "contradicted"))
    return out
