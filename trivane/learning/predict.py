"""Model scoring inside queries, model choice, and prediction write-back."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.operators.wide import scan_star
from trivane.sources.feeds import to_triples
from trivane.store import TripleStore
from trivane.terms import Pattern, twin

# Models of this module travel with the task, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Weights of the resource score by which models are compared.
SCORE_WEIGHTS = {"cpu_usage_percent": 0.5, "memory_usage_mb": 0.4, "prediction_time": 0.1}


@dataclass(frozen=True)
class LinearModel:
    """``bias + sum(weight * feature)``, with the share of each term as its importance."""

    weights: Mapping[str, float]
    bias: float = 0.0

    def predict(self, frame):
        out = frame[next(iter(self.weights))] * 0.0 + self.bias
        for name, weight in self.weights.items():
            out = out + weight * frame[name]
        return out


@dataclass(frozen=True)
class LogisticModel:
    """Two classes by a linear score: class 1 where its probability is at least one half."""

    score: LinearModel

    def predict_proba(self, frame):
        import numpy as np

        one = 1.0 / (1.0 + np.exp(-np.asarray(self.score.predict(frame), float)))
        return np.column_stack([1.0 - one, one])

    def predict(self, frame):
        return (self.predict_proba(frame)[:, 1] >= 0.5).astype(float)


def features(store: TripleStore, predicates: Mapping[str, str], key: str = "s") -> DataFrame:
    """One row per subject with a numeric column per predicate; subjects that lack one are left out.

    Over property tables this is a projection, otherwise a single pass and a single shuffle, whatever the
    number of features.  ``predicates`` maps column names to predicates; of several values the largest is
    taken.
    """
    wanted = {name: store.prefixes.expand(p) for name, p in predicates.items()}
    star = scan_star(store.tables, [Pattern("?s", p, f"?{name}") for name, p in wanted.items()])
    if star is not None:
        rows = star.select(F.col("s").alias(key), *[F.col(twin(n)).alias(n) for n in wanted])
        return rows.dropna(subset=list(wanted))
    rows = store.df.filter(F.col("p").isin(*wanted.values()))
    columns = [F.max(F.when(F.col("p") == p, F.col("o_num"))).alias(n) for n, p in wanted.items()]
    wide = rows.groupBy(F.col("s").alias(key)).agg(*columns)
    return wide.dropna(subset=list(wanted))


def predict(
    rows: DataFrame,
    model: Any,
    inputs: Sequence[str],
    output: str = "prediction",
    probability: str | None = None,
) -> DataFrame:
    """Score rows with any picklable model that has ``predict(frame)``.

    The model ships with the task closure and scores Arrow batches.  With ``probability`` the model must
    also have ``predict_proba(frame)``; the column holds the largest class probability.
    """
    fields = [*rows.schema.fields, T.StructField(output, T.DoubleType())]
    if probability:
        fields.append(T.StructField(probability, T.DoubleType()))
    names = list(inputs)

    def score(batches: Iterator) -> Iterator:
        for batch in batches:
            frame = batch[names].astype("float64")
            batch[output] = model.predict(frame)
            if probability:
                batch[probability] = [max(p) for p in model.predict_proba(frame)]
            yield batch

    return rows.mapInPandas(score, T.StructType(fields))


def own_importances(model: Any, inputs: Sequence[str]) -> dict[str, float] | None:
    """Importances that a model states itself, as ``feature_importances_`` of it or of the model it wraps."""
    for holder in (model, getattr(model, "model", None)):
        stated = getattr(holder, "feature_importances_", None)
        if stated is not None:
            return {name: float(value) for name, value in zip(inputs, stated, strict=True)}
    return None


def importances(rows: DataFrame, model: Any, inputs: Sequence[str]) -> DataFrame:
    """One row per feature: (feature, importance).

    A model's own importances, if it states them.  Else they are measured on all rows: how far predictions move on average
    when a feature is replaced by its mean.  Tasks send sums only, one row per feature and batch of rows.
    """
    names = list(inputs)
    stated = own_importances(model, names)
    if stated is not None:
        return rows.sparkSession.createDataFrame(list(stated.items()), "feature string, importance double")
    means = rows.agg(*[F.avg(n).alias(n) for n in names]).first().asDict()

    def moved(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            frame = batch[names].astype("float64")
            here = model.predict(frame)
            away = [abs(model.predict(frame.assign(**{n: means[n]})) - here).sum() for n in names]
            yield pd.DataFrame({"feature": names, "total": away, "rows": len(frame)})

    sums = rows.select(*names).mapInPandas(moved, "feature string, total double, rows bigint")
    return sums.groupBy("feature").agg((F.sum("total") / F.sum("rows")).alias("importance"))


def model_metrics(store: TripleStore, labels: Sequence[str], measure: str, label: str, value: str) -> DataFrame:
    """One row per model with a column per metric, from ``model measure m . m label name . m value x``."""
    expand = store.prefixes.expand
    owner = store.df.filter(F.col("p") == expand(measure)).select(F.col("s").alias("model"), F.col("o").alias("m"))
    named = store.df.filter((F.col("p") == expand(label)) & F.col("o").isin(*labels))
    named = named.select(F.col("s").alias("m"), F.col("o").alias("label"))
    valued = store.df.filter(F.col("p") == expand(value)).select(F.col("s").alias("m"), F.col("o_num").alias("value"))
    facts = owner.join(named, "m").join(valued, "m")
    return facts.groupBy("model").pivot("label", list(labels)).agg(F.max("value"))


def choose_model(metrics: DataFrame) -> DataFrame:
    """The model with the lowest weighted resource use; ties go to the first name."""
    score = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        score = score + F.lit(weight) * F.col(name)
    return metrics.select("model", score.alias("score")).orderBy("score", "model").limit(1)


def write_back(scored: DataFrame, subject: str, outputs: Mapping[str, str]) -> DataFrame:
    """Predictions as triples: ``outputs`` maps predicates to columns."""
    return to_triples(scored, F.col(subject), {p: F.col(c) for p, c in outputs.items()})
