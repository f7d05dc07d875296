"""Aggregates of evaluation: accuracies, entropy, AUC, F1, fits, baselines, bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.windows import running_total


def accuracy(correct: str = "correct", places: int = 4) -> Column:
    return F.round(F.avg(F.col(correct).cast("double")), places)


def by_family_and_subset(df: DataFrame, family: str, subsets: dict[str, list[str]]) -> DataFrame:
    """One row: accuracy of all, and accuracy and count of each named subset of families."""
    cols = [accuracy().alias("all")]
    for name, members in subsets.items():
        inside = F.when(F.col(family).isin(members), F.col("correct"))
        cols += [F.round(F.avg(inside.cast("double")), 4).alias(f"acc_{name}"), F.count(inside).alias(f"n_{name}")]
    return df.agg(*cols)


def weighted(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def dense_histogram(df: DataFrame, label: str, labels: DataFrame, name: str) -> DataFrame:
    """A count for each label of the dimension, zero where none."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    return labels.join(n, F.col(name) == F.col("_l"), "left").select(name, F.coalesce("_n", F.lit(0)).alias("n"))


def majority(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """The most frequent label (ties: the least), its count."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("label"))).alias("b"))
    return best.select(*by, F.col("b.label").alias("majority"), (-F.col("b.m")).alias("n"))


def entropy(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Shannon entropy in bits of a label column per group, from grouped counts."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    # H = log2 N - sum(n log2 n) / N needs one aggregate and no window
    return n.groupBy(*by).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias("entropy"))


def binary_rule(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, tpr, fpr and the AUC of a yes/no rule, 0.5 (1 + tpr - fpr)."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")
    )
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return counts.withColumn("tpr", rate("tp", "fn")).withColumn("fpr", rate("fp", "tn")).withColumn("auc", F.lit(0.5) * (F.lit(1.0) + F.col("tpr") - F.col("fpr")))


def rank_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC with tied scores at half: distinct scores are counted first, and negatives
    below each score are a running total in parallel ranges."""
    per = df.groupBy(score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q"))
    per = running_total(per, score, "_q", "_upto")
    u = per.agg(F.sum(F.col("_p") * (F.col("_upto") - F.col("_q") / 2.0)).alias("u"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    return u.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def per_class(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn per class of the union of predicted and actual labels."""
    marks = F.array(F.struct(F.col(actual).alias("class"), (F.col(actual) == F.col(predicted)).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col(actual) != F.col(predicted)).cast("int").alias("fn")),
                    F.struct(F.col(predicted).alias("class"), F.lit(0).alias("tp"), (F.col(actual) != F.col(predicted)).cast("int").alias("fp"), F.lit(0).alias("fn")))
    return df.select(F.explode(marks).alias("m")).groupBy("m.class").agg(F.sum("m.tp").alias("tp"), F.sum("m.fp").alias("fp"), F.sum("m.fn").alias("fn"))


def macro_f1(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Mean F1 over the union of labels, an empty class counting 0."""
    total = F.col("tp") * 2 + F.col("fp") + F.col("fn")
    return per_class(df, predicted, actual).agg(F.avg(F.when(total > 0, F.col("tp") * 2.0 / total).otherwise(0.0)).alias("macro_f1"), F.count("*").alias("n_classes"))


def balanced_accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Mean recall over the classes that occur in truth."""
    per = per_class(df, predicted, actual).where(F.col("tp") + F.col("fn") > 0)
    return per.agg(F.avg(F.col("tp") / (F.col("tp") + F.col("fn"))).alias("balanced_accuracy"), F.count("*").alias("n_classes"))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation, 0 where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.covar_pop(x, y) / F.when(spread > 0, spread), F.lit(0.0))


def with_group_mean(df: DataFrame, train: Column, key: str, value: str, out: str) -> DataFrame:
    """df with the key's mean over train rows, the mean of all train rows where the key has none."""
    per = df.where(train).groupBy(key).agg(F.avg(value).alias("_m"))
    over_all = df.where(train).agg(F.avg(value).alias("_all"))
    return df.join(per, key, "left").crossJoin(F.broadcast(over_all)).withColumn(out, F.coalesce("_m", "_all")).drop("_m", "_all")  # one row


def debiased(df: DataFrame, train: Column, key: str, value: str, out: str) -> DataFrame:
    """value less its key's median over train rows; over all the key's rows where no train row is."""
    marked = df.withColumn("_v", F.col(value).cast("double")).withColumn("_t", F.when(train, F.col("_v")))
    per = marked.groupBy(key).agg(F.percentile("_t", 0.5).alias("_own"), F.percentile("_v", 0.5).alias("_every"))
    return marked.join(per, key).withColumn(out, F.col("_v") - F.coalesce("_own", "_every")).drop("_v", "_t", "_own", "_every")


def fit_line(x: str, y: str) -> list[Column]:
    """slope, intercept, r2 of least squares; NaN where x (and for r2 also y) is constant."""
    x_flat, y_flat = F.min(x) == F.max(x), F.min(y) == F.max(y)
    nan = F.lit(float("nan"))
    return [
        F.when(x_flat, nan).otherwise(F.regr_slope(y, x)).alias("slope"),
        F.when(x_flat, nan).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        F.when(x_flat | y_flat, nan).otherwise(F.regr_r2(y, x)).alias("r2"),
    ]


def log_error(mean: Column) -> Column:
    """log10(1 - score), clipped away from 1."""
    return F.log10(F.greatest(F.lit(1.0) - mean, F.lit(1e-6)))


def margins(df: DataFrame, model: str, baseline: str, bar: float) -> DataFrame:
    out = df.withColumn("margin", F.round(F.col(model) - F.col(baseline), 4))
    return out.withColumn("clears", F.col("margin") >= bar).withColumn("distance", F.round(F.col("margin") - bar, 4))


def best_listed(df: DataFrame, by: list[str], score: str, listing: str, name: str) -> DataFrame:
    """The best of each set; the first listed wins ties."""
    best = df.groupBy(*by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(listing)).alias("o"), F.col(name).alias("n"))).alias("b"))
    return best.select(*by, F.col("b.n").alias("best"), F.col("b.s").alias("best_score"))


def floored_bar(df: DataFrame, by: list[str], measured: str, floor: str, head: str) -> DataFrame:
    """max(measured, floor) per head, then the largest; ties go to the higher raw, then larger id."""
    best = df.groupBy(*by).agg(F.max(F.struct(F.greatest(measured, floor).alias("f"), F.col(measured).alias("r"), F.col(head).alias("h"))).alias("b"))
    return best.select(*by, F.col("b.h").alias("head"), F.col("b.f").alias("bar"), F.col("b.r").alias("raw"))


def short_digest(*columns: str, digits: int = 16) -> Column:
    """The start of a digest over columns in name order, as `name=value` lines."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]
    return F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(digits))
