"""Baselines, model fits and searches over feature columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, OneVsRest, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.portable import draw
from plumbline.operators.joins import nearest
from plumbline.operators.metrics import majority

#: Estimators by family name; parameters go to the constructor. Callers may add their own.
ESTIMATORS: dict[str, Callable] = {
    "tree": lambda **p: DecisionTreeClassifier(**p),
    "logistic": lambda **p: LogisticRegression(**p),
    "forest": lambda **p: RandomForestClassifier(**p),
    "boosted": lambda **p: OneVsRest(classifier=GBTClassifier(**p)),  # boosting in Spark is binary
}


def standardised(df: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """Columns less the fit rows' mean, over their population deviation (1 where it is 0)."""
    stats = df.where(fit).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)  # one row


def min_class(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows whose label has at least so many rows; labels are counted, not windowed."""
    enough = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(enough, label, "left_semi")


def stratified_guess(df: DataFrame, train: Column, key: str, label: str, seed: int) -> DataFrame:
    """key, guess for rows not in train: labels drawn in the train rows' proportions."""
    n = df.where(train).groupBy(label).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy(label))  # a row a label
    cuts = n.withColumn("upto", upto).agg(F.array_sort(F.collect_list(F.struct("upto", F.col(label).alias("l")))).alias("cuts"), F.sum("c").alias("total"))
    drawn = df.where(~train).crossJoin(F.broadcast(cuts)).withColumn("_d", draw(F.col("total"), seed, key))  # one row
    return drawn.select(key, F.array_min(F.filter("cuts", lambda x: x["upto"] > F.col("_d")))["l"].alias("guess"))


def uniform_guess(df: DataFrame, key: str, n_classes: int, seed: int) -> DataFrame:
    return df.select(key, draw(n_classes, seed, key).cast("int").alias("guess"))


def fitted(train: DataFrame, family: str, features: str, label: str, **params):
    """An estimator of the registry, fitted on array features."""
    held = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return ESTIMATORS[family](**params).fit(held)


def predicted(model, rows: DataFrame, key: str, features: str, probability: bool = False) -> DataFrame:
    """key, prediction (and the class probabilities): scored where the rows are."""
    held = rows.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    out = model.transform(held)
    return out.select(key, F.col("prediction").cast("int").alias("prediction"), *([vector_to_array("probability").alias("probability")] if probability else []))


def trivial_baselines(df: DataFrame, train: Column, key: str, features: str, label: str, seed: int, extended: bool = False) -> DataFrame:
    """name, listing, accuracy of each baseline on the rows that are not train; `extended` adds the
    deep trees."""
    fit, rest = df.where(train), df.where(~train)
    top = majority(fit.withColumn("_one", F.lit(1)), label, ["_one"]).select(F.col("majority").alias("guess"))
    guesses = [
        ("majority", rest.select(key).crossJoin(F.broadcast(top))),  # one row
        ("stratified", stratified_guess(df, train, key, label, seed)),
        ("uniform", uniform_guess(rest, key, df.select(label).distinct().count(), seed)),
    ]
    trees = [("depth-1", 1), ("depth-3", 3)] + ([("depth-8", 8), ("depth-16", 16)] if extended else [])
    guesses += [(n, predicted(fitted(fit, "tree", features, label, maxDepth=k, seed=seed), rest, key, features).withColumnRenamed("prediction", "guess")) for n, k in trees]
    guesses.append(("1-nn", nearest(rest, fit, key, features, label).select(key, F.col("label").alias("guess"))))
    guesses.append(("logistic", predicted(fitted(fit, "logistic", features, label, maxIter=30), rest, key, features).withColumnRenamed("prediction", "guess")))
    out = None
    for i, (name, g) in enumerate(guesses):
        one = rest.select(key, label).join(g.select(key, F.col("guess").cast("long").alias("guess")), key)
        one = one.agg(F.lit(name).alias("name"), F.lit(i).alias("listing"), F.round(F.avg((F.col("guess") == F.col(label)).cast("double")), 4).alias("accuracy"))
        out = one if out is None else out.unionAll(one)
    return out


def search(train: DataFrame, holdout: DataFrame, key: str, features: str, label: str, candidates: list[tuple[str, str, dict]], keep: int = 1) -> DataFrame:
    """name, listing, accuracy, selected: each candidate fitted once and read on the holdout; the
    best `keep` are selected, the first listed winning ties. A candidate that fails to fit is
    listed without accuracy and never selected."""
    out = None
    for i, (name, family, params) in enumerate(candidates):
        try:
            p = predicted(fitted(train, family, features, label, **params), holdout, key, features)
            one = holdout.select(key, label).join(p, key).agg(F.round(F.avg((F.col("prediction") == F.col(label)).cast("double")), 4).alias("accuracy"))
        except (ValueError, TypeError, KeyError):
            one = train.sparkSession.createDataFrame([(None,)], "accuracy double")
        one = one.select(F.lit(name).alias("name"), F.lit(i).alias("listing"), "accuracy")
        out = one if out is None else out.unionAll(one)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("accuracy"), "listing"))  # a row a candidate
    return out.withColumn("selected", (place <= keep) & F.col("accuracy").isNotNull())


def boosted_with_validation(train: DataFrame, validation: DataFrame, features: str, label: str, classes: list[int], tolerance: float = 0.001, **params) -> list:
    """One boosted model a class (boosting in Spark is binary), each stopped early where the rows of
    the explicit validation set no longer gain by `tolerance`. classes: the labels, a short list."""
    both = train.withColumn("_val", F.lit(False)).unionByName(validation.withColumn("_val", F.lit(True)))
    held = both.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).alias("_y"), "_val")

    def fit(c: int):
        model = GBTClassifier(validationIndicatorCol="_val", validationTol=tolerance, **params).fit(held.withColumn("label", (F.col("_y") == c).cast("double")))
        return model.setRawPredictionCol(f"_r{c}").setProbabilityCol(f"_p{c}").setPredictionCol(f"_c{c}")

    return [(c, fit(c)) for c in classes]


def predicted_by_class(models: list, rows: DataFrame, key: str, features: str) -> DataFrame:
    """key, prediction (the class of the highest probability, the first listed wins ties) and the
    probabilities by class, scaled to 1: all models score a row where it is."""
    out = rows.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    for _, m in models:
        out = m.transform(out)
    p = F.array(*[vector_to_array(f"_p{c}")[1] for c, _ in models])
    best = F.element_at(F.array(*[F.lit(c) for c, _ in models]), F.array_position("_p", F.array_max("_p")).cast("int"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    return out.select(key, p.alias("_p")).select(key, best.alias("prediction"), F.transform("_p", lambda x: x / total).alias("probability"))
