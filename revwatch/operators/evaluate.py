"""Scores and flags against labels: confusion metrics, threshold sweep, ROC and precision-recall curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.numeric import ratio
from revwatch.functions.subquery import only_row

# The sweep runs from 1.00 to 4.00 in steps of 0.25.
SWEEP = tuple(1 + 0.25 * i for i in range(13))


def _rate(num: Column, den: Column) -> Column:
    """Four-digit rate; 0 when the denominator is empty."""
    return F.coalesce(ratio(num, den, 4), F.lit(0.0))


def confusion_metrics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The eleven metrics of a frame that holds tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cells.select(
        *keys,
        _rate(tp, tp + fp).alias("precision"),
        _rate(tp, tp + fn).alias("recall"),
        _rate(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _rate(tn, tn + fp).alias("specificity"),
        _rate(fp, fp + tn).alias("false_positive_rate"),
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        tn.alias("true_negatives"),
        fn.alias("false_negatives"),
        (tp + fp).alias("total_flagged"),
        (tp + fn).alias("total_anomalies"),
    )


def _confusion(truth: Column, flag: Column) -> list[Column]:
    positive, flagged = truth == 1, F.coalesce(flag, F.lit(False))
    return [
        F.count_if(positive & flagged).alias("tp"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count_if(positive & ~flagged).alias("fn"),
    ]


def evaluate_detector(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = (), method: str | None = None):
    """Confusion metrics of one prediction column, per key."""
    base = df.withColumn("method", F.lit(method)) if method else df
    keys = [*keys, "method"] if method else list(keys)
    return confusion_metrics(base.groupBy(*keys).agg(*_confusion(F.col(truth), F.col(pred) == 1)), keys)


def evaluate_all(df: DataFrame, columns: Mapping[str, str], truth: str = "is_true_anomaly", keys=()) -> DataFrame:
    """Metrics of every prediction column that exists, best F1 first."""
    present = {m: c for m, c in columns.items() if c in df.columns}
    long = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("pred")) for m, c in present.items()])
    stacked = df.select(*keys, truth, F.inline(long))
    return evaluate_detector(stacked, truth, "pred", [*keys, "method"]).orderBy(F.desc("f1_score"), "method")


def threshold_sweep(
    df: DataFrame, score: str = "z_score", truth: str = "is_true_anomaly", thresholds=SWEEP, keys=()
) -> DataFrame:
    """Metrics at every threshold, from one pass over the days."""
    aggs = []
    for i, t in enumerate(thresholds):
        cells = _confusion(F.col(truth), F.abs(score) > t)
        aggs.append(F.struct(F.lit(float(t)).alias("threshold"), *cells).alias(f"t{i}"))
    wide = df.groupBy(*keys).agg(*aggs)
    cells = wide.select(*keys, F.inline(F.array(*[F.col(f"t{i}") for i in range(len(thresholds))])))
    return confusion_metrics(cells, [*keys, "threshold"])


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row with the highest F1; the lowest threshold wins a tie."""
    best = F.max_by(F.struct(*[c for c in sweep.columns if c not in keys]), F.struct("f1_score", -F.col("threshold")))
    return sweep.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def _cumulative(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score, highest first: true and false positives so far, and the totals.

    Days are counted per distinct score before the windows; a window sees the scores of one (series, method).
    """
    distinct = scores.groupBy(*keys, "score").agg(
        F.count_if(F.col("is_true_anomaly") == 1).alias("pos"), F.count_if(F.col("is_true_anomaly") != 1).alias("neg")
    )
    group = Window.partitionBy(*keys)
    down = group.orderBy(F.desc("score"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return distinct.select(
        *keys,
        "score",
        F.row_number().over(down).cast("bigint").alias("point"),
        F.sum("pos").over(upto).alias("tp"),
        F.sum("neg").over(upto).alias("fp"),
        F.sum("pos").over(group).alias("positives"),
        F.sum("neg").over(group).alias("negatives"),
    )


def _with_start(curve: DataFrame, keys: Sequence[str], start: Mapping[str, Column]) -> DataFrame:
    """The first row of a curve also yields its starting point, so the scores are read once."""
    columns = [c for c in curve.columns if c not in keys]
    own = F.struct(*columns)
    first = F.struct(*[start.get(c, F.lit(None)).cast(curve.schema[c].dataType).alias(c) for c in columns])
    return curve.select(*keys, F.inline(F.when(F.col("point") == 1, F.array(first, own)).otherwise(F.array(own))))


def roc_curve(scores: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """(fpr, tpr) after each distinct score, starting at the origin."""
    curve = _cumulative(scores, keys).select(
        *keys,
        F.col("point"),
        F.col("score"),
        F.try_divide(F.col("fp").cast("double"), F.col("negatives").cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")).alias("tpr"),
    )
    return _with_start(curve, keys, {"point": F.lit(0).cast("bigint"), "fpr": F.lit(0.0), "tpr": F.lit(0.0)})


def pr_curve(scores: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """(recall, precision) after each distinct score, starting at recall 0 with precision 1."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    curve = _cumulative(scores, keys).select(
        *keys,
        F.col("point"),
        F.col("score"),
        F.try_divide(tp, F.col("positives").cast("double")).alias("recall"),
        F.try_divide(tp, tp + fp).alias("precision"),
    )
    return _with_start(curve, keys, {"point": F.lit(0).cast("bigint"), "recall": F.lit(0.0), "precision": F.lit(1.0)})


def trapezoid(curve: DataFrame, x: str, y: str, keys: Sequence[str], name: str) -> DataFrame:
    walk = Window.partitionBy(*keys).orderBy("point")
    area = (F.col(x) - F.lag(x).over(walk)) * (F.col(y) + F.lag(y).over(walk)) / 2
    return curve.withColumn("area", area).groupBy(*keys).agg(F.round(F.sum("area"), 6).alias(name))


def roc_auc(scores: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    return trapezoid(roc_curve(scores, keys), "fpr", "tpr", keys, "roc_auc")


def pr_auc(scores: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    return trapezoid(pr_curve(scores, keys), "recall", "precision", keys, "pr_auc")


def eval_report(labelled: DataFrame) -> DataFrame:
    """Sweep rows plus the optimum, with the day counts on every row."""
    sweep = threshold_sweep(labelled).select("threshold", "precision", "recall", "f1_score", "total_flagged")
    totals = labelled.agg(
        F.count("*").alias("days"),
        F.sum("is_true_anomaly").alias("anomaly_days"),
        F.count_if(F.col("is_true_anomaly") == 0).alias("normal_days"),
    )
    best, count = only_row(best_threshold(sweep)), only_row(totals)
    return sweep.withColumns(
        {
            **{c: count[c] for c in totals.columns},
            "is_optimum": (F.col("threshold") == best["threshold"]).cast("int"),
        }
    )
