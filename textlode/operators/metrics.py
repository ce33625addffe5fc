"""Metrics of scores against 0/1 labels, from counts at distinct scores and running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Add before_x, the sum of x over the rows that come earlier in ``order``, for each x of ``sums``.

    Rows are dealt by ranges of the order; each range is summed alone and starts
    with the total of the ranges before it, a row for each range.
    """
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    # the parts must not change between the two readings
    ranged = ranged.persist()
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    starts = totals.select("__part", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums))
    inside = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "__part")
    return out.select(*df.columns, *((F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in sums))


def _counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) for each distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))


def auroc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (auroc): the chance that a positive scores over a negative, ties half; NaN for one class."""
    c = running(_counts(df, score, label), ["score"], ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos") * F.sum("neg")
    return c.agg(F.when(pairs > 0, wins / pairs).otherwise(NAN).alias("auroc"))


def roc_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows (fpr, tpr, threshold) at every distinct score, with (0, 0, infinity); none for one class."""
    c = running(_counts(df, score, label), ["score"], ["pos", "neg"], descending=True)
    totals = F.broadcast(c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))  # one row
    out = c.crossJoin(totals).filter("p > 0 and n > 0")
    points = out.select(((F.col("before_neg") + F.col("neg")) / F.col("n")).alias("fpr"), ((F.col("before_pos") + F.col("pos")) / F.col("p")).alias("tpr"), F.col("score").alias("threshold"))
    first = totals.filter("p > 0 and n > 0").select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return points.union(first)


def fpr_at_tpr(points: DataFrame, target: float) -> DataFrame:
    """One row (fpr, threshold): the lowest fpr with at least the target's recall, at its highest threshold; NaN if none."""
    best = points.filter(F.col("tpr") >= target).agg(F.min(F.struct("fpr", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.coalesce("b.fpr", F.lit(NAN)).alias("fpr"), F.coalesce(-F.col("b.t"), F.lit(NAN)).alias("threshold"))


def tpr_at_fpr(points: DataFrame, budget: float) -> DataFrame:
    """One row (tpr, threshold): the highest recall within the budget, at its highest threshold; (0, infinity) if none."""
    best = points.filter((F.col("fpr") <= budget) & (F.col("tpr") > 0)).agg(F.max(F.struct("tpr", "threshold")).alias("b"))
    return best.select(F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"), F.coalesce("b.threshold", F.lit(float("inf"))).alias("threshold"))


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1, accuracy."""
    from textlode.operators.windows import ratios

    yes, one = F.col(score) >= threshold, F.col(label) == 1
    zero = F.col(label) == 0
    c = df.agg(*(F.count(F.when(x, 1)).alias(k) for k, x in (("tp", yes & one), ("fp", yes & zero), ("fn", ~yes & one), ("tn", ~yes & zero))), F.count(F.lit(1)).alias("rows"))
    out = ratios(c)
    return out.select("tp", "fp", "tn", "fn", "precision", "recall", "f1", ((F.col("tp") + F.col("tn")) / F.greatest("rows", F.lit(1))).alias("accuracy"))


def losses(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: log_loss, brier, margin, n; NaN where undefined."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))
    low, high = F.min(F.when(F.col(label) == 1, F.col(score))), F.max(F.when(F.col(label) == 0, F.col(score)))
    square = (F.col(score) - F.col(label)) * (F.col(score) - F.col(label))
    return df.agg(F.coalesce(F.avg(loss), F.lit(NAN)).alias("log_loss"), F.coalesce(F.avg(square), F.lit(NAN)).alias("brier"), F.coalesce(low - high, F.lit(NAN)).alias("margin"), F.count(F.lit(1)).alias("n"))


def ece(df: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """One row (ece): the mean gap of score and share of positives over equal bins, the last one closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    by = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(score) - F.avg(label)).alias("gap"))
    return by.agg(F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), F.lit(NAN)).alias("ece"))
