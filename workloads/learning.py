"""Scoring inside queries, model metrics, model choice and write-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions.expressions import compare
from trivane.learning.predict import LinearModel, LogisticModel, choose_model, features, importances, model_metrics, predict, write_back
from trivane.plans.rules import Rule, RuleBase
from trivane.query import Select
from trivane.sources.feeds import to_triples
from trivane.store import TripleStore
from workloads.registry import query
from workloads.tables import LINE, store, table

MODEL = LinearModel({"quantity": 1.5, "discount": -20.0, "tax": 10.0}, bias=2.0)
SCORE = "l_quantity * 0.0 + 2.0 + 1.5 * l_quantity + -20.0 * l_discount + 10.0 * l_tax"
INPUTS = {"quantity": "quantity", "discount": "discount", "tax": "tax"}


def scored(spark, sf):
    rows = features(store(spark, sf, "lineitem"), INPUTS, "line")
    return predict(rows, MODEL, list(INPUTS), "y")


@query("ml_predict_linear", f"SELECT {LINE} AS line, round({SCORE}, 6) AS y FROM lineitem")
def ml_predict_linear(spark, sf):
    return scored(spark, sf).select("line", F.round("y", 6).alias("y"))


CENTRED = LogisticModel(LinearModel({"quantity": 0.1, "discount": -4.0, "tax": 2.0}, bias=-2.0))
CHANCE = "1 / (1 + exp(-(l_quantity * 0.0 - 2.0 + 0.1 * l_quantity + -4.0 * l_discount + 2.0 * l_tax)))"


@query(
    "ml_probability",
    f"""SELECT {LINE} AS line, CASE WHEN {CHANCE} >= 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y, round(greatest({CHANCE}, 1 - {CHANCE}), 6) AS sure
        FROM lineitem""",
)
def ml_probability(spark, sf):
    """The class of every line, and how probable it is."""
    rows = features(store(spark, sf, "lineitem"), INPUTS, "line")
    found = predict(rows, CENTRED, list(INPUTS), "y", "sure")
    return found.select("line", "y", F.round("sure", 6).alias("sure"))


@query(
    "ml_importances",
    """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem)
       SELECT 'quantity' AS feature, round(avg(abs(1.5 * (l_quantity - q))), 6) AS importance FROM lineitem, m
       UNION ALL SELECT 'discount', round(avg(abs(-20.0 * (l_discount - d))), 6) FROM lineitem, m
       UNION ALL SELECT 'tax', round(avg(abs(10.0 * (l_tax - t))), 6) FROM lineitem, m""",
)
def ml_importances(spark, sf):
    """What each feature contributes to a model that states no importances, measured on all lines."""
    rows = features(store(spark, sf, "lineitem"), INPUTS, "line")
    return importances(rows, MODEL, list(INPUTS)).select("feature", F.round("importance", 6).alias("importance"))


@query("ml_writeback", f"SELECT {LINE} AS s, 'predictedCost' AS p, round({SCORE}, 6) AS o_num FROM lineitem")
def ml_writeback(spark, sf):
    triples = write_back(scored(spark, sf), "line", {"predictedCost": "y"})
    return triples.select("s", "p", F.round("o_num", 6).alias("o_num"))


@query(
    "ml_predict_rule",
    f"""SELECT DISTINCT concat('order/', l_orderkey) AS s, 'costly' AS p, 'true' AS o FROM lineitem
        WHERE l_quantity > 30 AND {SCORE} > 70""",
)
def ml_predict_rule(spark, sf):
    """A rule whose conclusion depends on a model's output for the body's solutions."""

    def add_score(solutions):
        frame = solutions.withColumnsRenamed({"q__num": "quantity", "d__num": "discount", "t__num": "tax"})
        return predict(frame, MODEL, list(INPUTS), "y").filter("y > 70")

    body = [("?l", "inOrder", "?o"), ("?l", "quantity", "?q"), ("?l", "discount", "?d"), ("?l", "tax", "?t")]
    rule = Rule(body, [("?o", "costly", "true")], [compare("?q", ">", 30)], transform=add_score)
    return RuleBase(store(spark, sf, "lineitem"), [rule]).infer_semi_naive().select("s", "p", "o")


def metadata(spark, sf):
    """One model per event type with three measurements, as triples: model evaluates m . m label n . m value x."""
    stats = table(spark, sf, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").cast("double").alias("cpu_usage_percent"),
        F.max("value").alias("memory_usage_mb"),
        F.count("*").cast("double").alias("prediction_time"),
    )
    labels = ["cpu_usage_percent", "memory_usage_mb", "prediction_time"]
    measured = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("value")) for n in labels])
    long = stats.select("event_type", F.explode(measured).alias("m")).select("event_type", "m.*")
    node = F.concat(F.lit("eval/"), "event_type", F.lit("/"), "label")
    named = to_triples(long, node, {"label": F.col("label"), "value": F.col("value")})
    owned = to_triples(long, F.concat(F.lit("model/"), "event_type"), {"evaluates": node})
    return TripleStore(named.select("s", "p", "o", "o_num").union(owned.select("s", "p", "o", "o_num"))), labels


METRICS = """SELECT concat('model/', event_type) AS model, cast(count(DISTINCT user_id) AS double) AS cpu_usage_percent,
    max(value) AS memory_usage_mb, cast(count(*) AS double) AS prediction_time FROM events GROUP BY event_type"""


@query("ml_metrics_pivot", METRICS)
def ml_metrics_pivot(spark, sf):
    data, labels = metadata(spark, sf)
    return model_metrics(data, labels, "evaluates", "label", "value")


@query(
    "ml_select_model",
    f"""SELECT model, round(0.5 * cpu_usage_percent + 0.4 * memory_usage_mb + 0.1 * prediction_time, 6) AS score
        FROM ({METRICS}) ORDER BY score, model LIMIT 1""",
)
def ml_select_model(spark, sf):
    return choose_model(ml_metrics_pivot(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "ml_input_query",
    f"""SELECT concat('order/', l_orderkey) AS o, {LINE} AS l, round({SCORE}, 6) AS y FROM lineitem
        WHERE l_returnflag = 'R'""",
)
def ml_input_query(spark, sf):
    """The model's input is any query: here returned lines, with the key columns passed through."""
    asked = Select("?o", "?l", "?q", "?d", "?t").where(
        ("?l", "flag", "R"), ("?l", "inOrder", "?o"), ("?l", "quantity", "?q"), ("?l", "discount", "?d"), ("?l", "tax", "?t")
    )
    rows = asked.solutions(store(spark, sf, "lineitem")).selectExpr(
        "o", "l", "q__num AS quantity", "d__num AS discount", "t__num AS tax"
    )
    return predict(rows, MODEL, list(INPUTS), "y").select("o", "l", F.round("y", 6).alias("y"))
