"""Set metrics over arguments and pairs; classifier metrics over a full class grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import f1, ratio


def set_metrics(predicted: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: tp, predicted, gold, iou, precision, recall, f1 over distinct keys; 0 for zero denominators."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, list(keys), "full_outer")
    c = both.agg(*[F.coalesce(F.sum(F.coalesce(x, F.lit(0))), F.lit(0)).alias(n) for n, x in (("tp", F.col("_p") * F.col("_g")), ("np", F.col("_p")), ("ng", F.col("_g")))])
    tp, n, m = F.col("tp"), F.col("np"), F.col("ng")
    precision, recall = ratio(tp.cast("double"), n), ratio(tp.cast("double"), m)
    return c.select("tp", n.alias("predicted"), m.alias("gold"), ratio(tp.cast("double"), n + m - tp).alias("iou"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"))


def unordered(a: Column, b: Column) -> Column:
    """A key that does not depend on the pair's order."""
    return F.array_sort(F.array(a, b))


def benchmark_metrics(predicted: DataFrame, gold: DataFrame, predicted_pairs: DataFrame, gold_pairs: DataFrame) -> DataFrame:
    """The seven benchmark figures in one row: arguments by (claim, evidence), pairs by ``pair``."""
    a = set_metrics(predicted, gold, ["claim", "evidence"])
    b = set_metrics(predicted_pairs, gold_pairs, ["pair"])
    a = a.select("iou", F.col("precision").alias("argument_precision"), F.col("recall").alias("argument_recall"), F.col("f1").alias("argument_f1"))
    return a.crossJoin(b.select(F.col("precision").alias("pair_precision"), F.col("recall").alias("pair_recall"), F.col("f1").alias("pair_f1")))


def confusion(df: DataFrame, classes: DataFrame, true: str = "y_true", pred: str = "y_pred", name: str = "class") -> DataFrame:
    """(y_true, y_pred, n) over all pairs of classes, zeros kept.  ``classes``: one small column ``name``."""
    grid = classes.select(F.col(name).alias("y_true")).crossJoin(F.broadcast(classes.select(F.col(name).alias("y_pred"))))
    n = df.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    return grid.join(n, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(cells: DataFrame, classes: Sequence) -> DataFrame:
    """Rows true, columns predicted, in the given order."""
    return cells.groupBy("y_true").pivot("y_pred", list(classes)).agg(F.sum("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) from confusion cells; zero denominators give 0."""
    t = cells.groupBy(F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col("y_pred").alias("class")).agg(F.sum("n").alias("predicted"))
    precision, recall = ratio(F.col("tp").cast("double"), F.col("predicted")), ratio(F.col("tp").cast("double"), F.col("support"))
    return t.join(p, "class").select("class", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), "support")


def summary_metrics(cells: DataFrame) -> DataFrame:
    """One row: accuracy, micro_f1, macro_f1, macro_precision, macro_recall, n."""
    each = class_metrics(cells).agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).cast("double")
    whole = cells.agg(ratio(right, F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return whole.crossJoin(each).select("accuracy", F.col("accuracy").alias("micro_f1"), "macro_f1", "macro_precision", "macro_recall", "n")
