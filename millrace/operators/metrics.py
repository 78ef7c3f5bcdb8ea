"""Evaluation of predictions and clusterings as grouped aggregates."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(rows: DataFrame, by: list[str], truth_log: Column, predicted_log: Column, in_log: bool = True) -> DataFrame:
    """Errors in seconds, back from log1p, and the mean absolute error of logs."""
    t, p = (F.expm1(truth_log), F.expm1(predicted_log)) if in_log else (truth_log, predicted_log)
    lt, lp = (truth_log, predicted_log) if in_log else (F.log1p(truth_log), F.log1p(predicted_log))
    e = F.abs(t - p)
    return rows.groupBy(*by).agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(e).alias("median_ae"), F.avg(F.abs(lt - lp)).alias("log_mae"), F.count("*").alias("n"))


def decision_metrics(rows: DataFrame, by: list[str], truth: str, predicted: str, thresholds: list[float], scopes: dict[str, Column]) -> DataFrame:
    """For each threshold and scope: counts of long durations found and missed, precision, recall (null without any), accuracy."""
    spread = rows.withColumn("tt_seconds", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    in_scope = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]))
    spread = spread.withColumn("scope", F.explode(in_scope))
    t, p = F.col(truth) >= F.col("tt_seconds"), F.col(predicted) >= F.col("tt_seconds")
    out = spread.groupBy(*by, "scope", "tt_seconds").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count("*").alias("n"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "accuracy": (tp + tn) / F.col("n")})


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro precision, recall and F1 over the classes of truth and predictions."""
    c = confusion(rows, truth, predicted)
    hits = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    actual = c.groupBy(F.col(truth).alias("k")).agg(F.sum("n").alias("actual"), hits.alias("tp"))
    guessed = c.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("guessed"))
    each = actual.join(guessed, "k", "full").select("k", *[F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("actual", "guessed", "tp")])
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("guessed")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("actual")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return each.agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg(F.when(F.col("actual") > 0, r)).alias("balanced_accuracy"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f1).alias("macro_f1"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(rows: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information of two labellings, from their contingency table."""
    c = rows.groupBy(truth, cluster).agg(F.count("*").cast("double").alias("__n"))
    a, b = c.groupBy(truth).agg(F.sum("__n").alias("na")), c.groupBy(cluster).agg(F.sum("__n").alias("nb"))
    total = c.agg(F.sum("__n").alias("__t"), F.sum(_pairs(F.col("__n"))).alias("nij"))
    ha = a.crossJoin(F.broadcast(total.select("__t"))).agg(F.sum(_pairs(F.col("na"))).alias("pa"), (-F.sum(F.col("na") / F.col("__t") * F.log(F.col("na") / F.col("__t")))).alias("ha"))
    hb = b.crossJoin(F.broadcast(total.select("__t"))).agg(F.sum(_pairs(F.col("nb"))).alias("pb"), (-F.sum(F.col("nb") / F.col("__t") * F.log(F.col("nb") / F.col("__t")))).alias("hb"))
    mutual = c.join(a, truth).join(b, cluster).crossJoin(F.broadcast(total.select("__t"))).agg(F.sum(F.col("__n") / F.col("__t") * F.log(F.col("__n") * F.col("__t") / (F.col("na") * F.col("nb")))).alias("mi"))
    one = total.crossJoin(ha).crossJoin(hb).crossJoin(mutual)  # single rows
    expected = F.col("pa") * F.col("pb") / _pairs(F.col("__t"))
    return one.select(F.coalesce(F.try_divide(F.col("nij") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)).alias("ari"), F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("nmi"))


def matched_accuracy(rows: DataFrame, truth: str, cluster: str, most: int = 8) -> float:
    """Accuracy under the best one-to-one match of clusters to labels; a cluster without a label counts as wrong."""
    table = {(r[0], r[1]): r[2] for r in rows.groupBy(truth, cluster).count().limit(most * most + 1).collect()}
    labels, clusters = sorted({t for t, _ in table}), sorted({c for _, c in table})
    if max(len(labels), len(clusters)) > most:
        raise ValueError(f"at most {most} labels and clusters are matched")
    wide = [*labels, *[None] * max(0, len(clusters) - len(labels))]
    best = max(sum(table.get((t, c), 0) for t, c in zip(p, clusters)) for p in permutations(wide, len(clusters)))
    return best / sum(table.values())
