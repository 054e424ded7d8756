from barweave.operators import learn as ml
from barweave.plans import learning


def test_importance_is_that_of_the_whole_stack(spark, monkeypatch):
    rows = [(f"s{i % 5}", i, float(i % 7), float(i % 7 > 3), "train" if i < 60 else "test") for i in range(80)]
    frame = spark.createDataFrame(rows, "symbol string, datetime long, x1 double, future_direction double, split string")
    models = []
    monkeypatch.setattr(learning, "dataset", lambda spark, folder: frame)
    monkeypatch.setattr(learning, "FEATURES", ["x1"])
    real = ml.permutation_importance
    monkeypatch.setattr(ml, "permutation_importance", lambda model, rows: (models.append(model), real(model, rows))[1])
    found = learning.permutation_importance(spark, "").collect()
    assert [r.feature for r in found] == ["x1"]
    assert len(models[0].bases) == 3 and models[0].blend is not None
