"""Evaluation metrics as aggregates over predictions joined with ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_match(prediction: Column, answer: Column) -> Column:
    """Equal without regard to case; null counts as wrong."""
    return F.coalesce(F.lower(prediction) == F.lower(answer), F.lit(False))


def letter_match(prediction: Column, index: Column) -> Column:
    """Whether the letter is that of the right choice, counted from 0."""
    return F.coalesce(prediction == F.char(index.cast("int") + 65), F.lit(False))


def encode_label(text: Column, negative: str, *, normalized: bool = False) -> Column:
    """0 for the negative label, 1 for all else; ``normalized`` drops case, white space and final stops first."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"[.!]+$", "") if normalized else text
    return F.when(t == negative, 0).otherwise(1)


def accuracy(df: DataFrame, correct: Column, *, by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """The mean of an indicator in percent; null over no rows."""
    value = F.round(F.avg(correct.cast("double")) * 100, digits).alias("accuracy")
    return df.groupBy(*by).agg(value) if by else df.agg(value)


def soft_vote(answers: Column, prediction: Column) -> Column:
    """``min(1, 0.3 c)`` to one digit, c being how many annotators gave the prediction."""
    c = F.size(F.filter(answers, lambda a: a == prediction))
    return F.least(F.lit(1.0), F.round(0.3 * c, 1))


def confusion(df: DataFrame, prediction: str, label: str, *, by: list[str] | None = None) -> DataFrame:
    """``tp, fp, tn, fn`` of columns that hold 0 and 1."""
    p, y = F.col(prediction), F.col(label)
    counts = [F.count_if((p == a) & (y == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("tn", 0, 0), ("fn", 0, 1))]
    return df.groupBy(*by).agg(*counts) if by else df.agg(*counts)


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and share of yes from a confusion table; null where a divisor is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    whole = tp + fp + tn + fn
    return counts.select(
        *[c for c in counts.columns if c not in ("tp", "fp", "tn", "fn")], F.try_divide(tp + tn, whole).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp + fp, whole).alias("yes_share"),
    )


def running_mean(df: DataFrame, value: str, order: list[str], *, by: list[str]) -> DataFrame:
    """Adds ``running``: the mean of the rows up to this one, within each group of ``by``."""
    return df.withColumn("running", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def mean_of_means(df: DataFrame, sequence: str, loss: str, label: str, *, masked: int = -100, by: list[str] | None = None) -> DataFrame:
    """The mean loss of each sequence's unmasked places, then the mean over sequences; a fully masked one counts as 0."""
    each = df.groupBy(*(by or []), sequence).agg(F.coalesce(F.avg(F.when(F.col(label) != masked, F.col(loss))), F.lit(0.0)).alias("_m"))
    value = F.avg("_m").alias("mean_loss")
    return each.groupBy(*by).agg(value) if by else each.agg(value)


def shifted_labels(df: DataFrame, sequence: str, pos: str, label: str) -> DataFrame:
    """Each place with the label of the next one; the last place of a sequence goes."""
    following = F.lead(label).over(Window.partitionBy(sequence).orderBy(pos))
    last = F.lead(F.lit(1)).over(Window.partitionBy(sequence).orderBy(pos)).isNull()
    return df.withColumn("_next", following).withColumn("_last", last).filter("NOT _last").withColumn(label, F.col("_next")).drop("_next", "_last")


def caption_overlap(candidates: DataFrame, references: DataFrame, key: str, *, order: int = 2) -> DataFrame:
    """``key, precision, recall`` of the candidate's word n-grams against its best reference: a stand-in where no external scorer is at hand."""

    def grams(c: str) -> Column:
        words = F.split(F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " ")), " ")
        joined = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - order, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(order)), " "))
        return F.array_distinct(joined)

    pairs = candidates.select(key, grams("caption").alias("c")).join(references.select(key, grams("reference").alias("r")), key)
    common = F.size(F.array_intersect("c", "r"))
    return pairs.groupBy(key).agg(F.max(F.try_divide(common, F.size("c"))).alias("precision"), F.max(F.try_divide(common, F.size("r"))).alias("recall"))
