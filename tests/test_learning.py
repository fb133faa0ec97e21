from tests.conftest import tuples
from trivane.learning.predict import LinearModel, choose_model, features, model_metrics, predict, write_back


def test_features_and_prediction(make_store):
    class Threshold:
        """Any picklable object with the two methods is a model."""

        def predict(self, frame):
            return (frame["x"] > 1).astype(float)

        def predict_proba(self, frame):
            return [[0.2, 0.8] if v > 1 else [0.9, 0.1] for v in frame["x"]]

    data = make_store([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3"), ("b", "y", "4"), ("c", "x", "5"), ("a", "room", "r1")])
    rows = features(data, {"x": "x", "y": "y"}, "id")
    assert tuples(rows) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    scored = predict(rows, LinearModel({"x": 2.0, "y": -1.0}, 0.5), ["x", "y"], "z")
    assert tuples(scored, "id", "z") == [("a", 0.5), ("b", 2.5)]
    judged = predict(rows, Threshold(), ["x"], "class", "confidence")
    assert tuples(judged, "id", "class", "confidence") == [("a", 0.0, 0.9), ("b", 1.0, 0.8)]
    back = write_back(judged, "id", {"predicted": "class", "confidence": "confidence"})
    assert ("b", "confidence", "0.8", 0.8) in tuples(back) and back.count() == 4


def test_model_choice(spark, make_store):
    labels = ["cpu_usage_percent", "memory_usage_mb", "prediction_time"]
    numbers = {"m2": (10, 20, 30), "m1": (10, 20, 30), "m3": (90, 1, 1)}
    rows = []
    for model, values in numbers.items():
        for label, value in zip(labels, values):
            rows += [(model, "ev", f"{model}/{label}"), (f"{model}/{label}", "label", label), (f"{model}/{label}", "value", str(value))]
    metrics = model_metrics(make_store(rows), labels, "ev", "label", "value")
    assert tuples(metrics)[0] == ("m1", 10.0, 20.0, 30.0)
    assert tuples(choose_model(metrics)) == [("m1", 16.0)]


def test_importances_stated_or_measured(spark):
    from trivane.learning.predict import LinearModel, importances

    class Forest:
        feature_importances_ = [0.25, 0.75]

        def predict(self, frame):
            return frame["a"]

    rows = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    assert {r["feature"]: r["importance"] for r in importances(rows, Forest(), ["a", "b"]).collect()} == {"a": 0.25, "b": 0.75}
    measured = importances(rows, LinearModel({"a": 3.0, "b": 9.0}), ["a", "b"])
    assert {r["feature"]: round(r["importance"], 9) for r in measured.collect()} == {"a": 4.0, "b": 0.0}
