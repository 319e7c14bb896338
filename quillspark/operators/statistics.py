"""Correlation, agreement and evaluation statistics that order distinct values, never rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ordering import group_totals, running_sums


def _average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank) of a column's distinct values, tied rows sharing their mean rank."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = running_sums(counts, "v", {"upto": "c"})
    return upto.select("v", (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, pearson, spearman) over rows with both values; null for under two rows or a constant."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    pairs = rows.groupBy(x, y).agg(F.count("*").alias("n"))  # equal pairs share ranks
    rx, ry = _average_ranks(rows, x).toDF("_x", "rx"), _average_ranks(rows, y).toDF("_y", "ry")
    ranked = pairs.join(rx, F.col(x) == F.col("_x")).join(ry, F.col(y) == F.col("_y"))

    def weighted(a: str, b: str) -> Column:
        n = F.sum("n")
        s = lambda e: F.sum(F.col("n") * e)
        a_, b_ = F.col(a).cast("double"), F.col(b).cast("double")
        cov = s(a_ * b_) - s(a_) * s(b_) / n
        va, vb = s(a_ * a_) - s(a_) * s(a_) / n, s(b_ * b_) - s(b_) * s(b_) / n
        return F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))

    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), weighted(x, y).alias("pearson"), weighted("rx", "ry").alias("spearman"))


def score_curve(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg, tp, fp, n_pos, n_neg) at each distinct score, cumulated from the highest."""
    counts = df.groupBy(*by, score).agg(F.sum(F.col(truth)).alias("pos"), F.sum(1 - F.col(truth)).alias("neg"))
    curve = running_sums(counts, score, {"tp": "pos", "fp": "neg"}, by, descending=True)
    return group_totals(curve, {"n_pos": F.sum("pos"), "n_neg": F.sum("neg")}, by)


def ranking_metrics(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, prevalence, auc_pr, auc_roc): average precision as a step sum, and the ROC area with ties
    as half; both null with one class only."""
    curve = score_curve(df, truth, score, by)
    two = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    ap = F.sum(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp")))
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.nullif(F.max("n_pos") * F.max("n_neg"), F.lit(0))
    n = F.max("n_pos") + F.max("n_neg")
    return curve.groupBy(*by).agg(n.alias("n"), (F.max("n_pos") / n).alias("prevalence"), F.when(two, ap).alias("auc_pr"), F.when(two, roc).alias("auc_roc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def decision_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, tn, precision_pos, recall_pos, f1_pos, f1_macro, accuracy, kappa); 0 where a ratio is undefined."""
    y, p = F.col(truth), F.col(predicted)
    out = df.groupBy(*by).agg(*(F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agree = _ratio(tp + tn, n)
    chance = _ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_neg = _ratio(2 * tn, 2 * tn + fp + fn)
    return out.withColumns({"precision_pos": _ratio(tp, tp + fp), "recall_pos": _ratio(tp, tp + fn), "f1_pos": f1, "f1_macro": (f1 + f1_neg) / 2, "accuracy": agree, "kappa": F.coalesce((agree - chance) / F.nullif(1 - chance, F.lit(0.0)), F.lit(0.0))})


def best_threshold(df: DataFrame, truth: str, score: str, grid: int = 200, low: float = 0.01, high: float = 0.999) -> DataFrame:
    """One row (threshold, f1_macro): the first of the distinct score quantiles that maximises macro-F1.

    A quantile lies between two rows in order, so between two neighbouring scores of the cumulated curve (or on
    one). Each score tells by its place which quantiles it bounds, and brings its counts along: the curve is
    never compared with all thresholds. The result is null for no rows.
    """
    known = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    counts = known.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(truth)).alias("pos"), F.sum(1 - F.col(truth)).alias("neg"))
    curve = group_totals(running_sums(counts, "s", {"pos_upto": "pos", "neg_upto": "neg"}), {"n_pos": F.sum("pos"), "n_neg": F.sum("neg")})
    last = F.col("n_pos") + F.col("n_neg") - 1
    step = (high - low) / max(1, grid - 1)
    place = lambda i: last * (low + step * i)
    upto = F.col("pos_upto") + F.col("neg_upto")
    first = upto - F.col("pos") - F.col("neg")
    near = lambda at, more: F.least(F.greatest(F.floor((at / F.nullif(last, F.lit(0)) - low) / step) + more, F.lit(0)), F.lit(grid - 1)).cast("int")
    steps = F.sequence(F.coalesce(near(first - 1, -1), F.lit(0)), F.coalesce(near(upto, 2), F.lit(grid - 1)))
    bounds = curve.select("*", F.explode(steps).alias("i"))
    below, above = F.floor(place(F.col("i"))), F.ceil(place(F.col("i")))
    is_low, is_high = (below >= first) & (below < upto), (above >= first) & (above < upto)
    at = F.struct("s", (F.col("n_pos") - F.col("pos_upto") + F.col("pos")).alias("tp"), (F.col("n_neg") - F.col("neg_upto") + F.col("neg")).alias("fp"))
    pairs = bounds.where(is_low | is_high).groupBy("i").agg(F.max(F.when(is_low, at)).alias("lo"), F.max(F.when(is_high, at)).alias("hi"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    exact = place(F.col("i"))
    threshold = F.col("lo.s") + (exact - F.floor(exact)) * (F.col("hi.s") - F.col("lo.s"))
    sums = pairs.withColumn("threshold", threshold)
    side = F.when(F.col("threshold") <= F.col("lo.s"), F.col("lo")).otherwise(F.col("hi"))
    tp, fp = side["tp"], side["fp"]
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    f1 = (_ratio(2 * tp, 2 * tp + fp + fn) + _ratio(2 * tn, 2 * tn + fp + fn)) / 2
    return sums.withColumn("f1_macro", F.round(f1, 12)).agg(F.max_by("threshold", F.struct("f1_macro", -F.col("threshold"))).alias("threshold"), F.max("f1_macro").alias("f1_macro"))


def kappas(votes: DataFrame, by: str, item: str, vote: str) -> DataFrame:
    """(by, n_items, n_raters, n_categories, observed, kappa_randolph, kappa_fleiss, forced) from long votes.

    Chance is 1 / categories seen for Randolph's kappa and the sum of squared shares for Fleiss's. With
    one category only both are undefined and set to 1, with `forced` true.
    """
    cells = votes.groupBy(by, item, vote).agg(F.count("*").alias("c"))
    items = cells.groupBy(by, item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    p_bar = items.groupBy(by).agg(F.count("*").alias("n_items"), F.max("r").alias("n_raters"), F.avg(F.col("pairs") / F.nullif(F.col("r") * (F.col("r") - 1), F.lit(0))).alias("observed"))
    shares = cells.groupBy(by, vote).agg(F.sum("c").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(by))
    chance = shares.withColumn("p", share).groupBy(by).agg(F.count("*").alias("n_categories"), F.sum(F.col("p") * F.col("p")).alias("pe"))
    kappa = lambda pe: F.when(F.col("n_categories") == 1, 1.0).otherwise((F.col("observed") - pe) / F.nullif(1 - pe, F.lit(0.0)))
    out = p_bar.join(chance, by)
    return out.select(by, "n_items", "n_raters", "n_categories", "observed", kappa(1 / F.col("n_categories")).alias("kappa_randolph"), kappa(F.col("pe")).alias("kappa_fleiss"), (F.col("n_categories") == 1).alias("forced"))


def majorities(votes: DataFrame, by: str, item: str, vote: str) -> DataFrame:
    """(by, n_unanimous, n_toxic_items, n_neutral_items, majority) of 0/1 votes; equal counts are a tie."""
    items = votes.groupBy(by, item).agg(F.count_distinct(vote).alias("kinds"), F.avg(F.col(vote)).alias("m"))
    out = items.groupBy(by).agg(F.count_if(F.col("kinds") == 1).alias("n_unanimous"), F.count_if(F.col("m") > 0.5).alias("n_toxic_items"), F.count_if(F.col("m") < 0.5).alias("n_neutral_items"))
    return out.withColumn("majority", F.when(F.col("n_toxic_items") > F.col("n_neutral_items"), "toxic").when(F.col("n_toxic_items") < F.col("n_neutral_items"), "neutral").otherwise("tie"))


def resolve_missing(votes: DataFrame, item: str, vote: str, fill: bool) -> DataFrame:
    """Votes of complete items; with fill, a missing vote takes its item's strict majority, and items without one go."""
    per = votes.groupBy(item).agg(F.count_if(F.col(vote).isNull()).alias("_missing"), F.count_if(F.col(vote) == 1).alias("_ones"), F.count_if(F.col(vote) == 0).alias("_zeros"))
    out = votes.join(per, item)
    if not fill:
        return out.where("_missing = 0").select(*votes.columns)
    major = F.when(F.col("_ones") > F.col("_zeros"), 1).when(F.col("_zeros") > F.col("_ones"), 0)
    filled = out.withColumn("_major", major).where("_missing = 0 OR _major IS NOT NULL")
    return filled.withColumn(vote, F.coalesce(F.col(vote), F.col("_major"))).select(*votes.columns)


def equal_bins(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """The columns whose values all have the same count."""
    out = []
    for c in candidates:
        r = df.groupBy(c).agg(F.count("*").alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k")).first()
        if r["k"] > 1 and r["lo"] == r["hi"]:
            out.append(c)
    return out


def claim_table(claims: DataFrame, computed: DataFrame) -> DataFrame:
    """claims(claim, published, decimals) with the recomputed value and whether they agree at those decimals."""
    scale = F.pow(F.lit(10.0), F.col("decimals"))
    same = F.round(F.col("published") * scale) == F.round(F.col("value") * scale)
    return claims.join(computed, "claim", "left").withColumn("agrees", F.coalesce(same, F.lit(False)))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, repeats included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
