import math

from tessera.operators import evaluate as EV


def test_metrics_edge_cases(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "actual int, predicted int")
    pred = pred.unionByName(spark.createDataFrame([(1, 3)], "actual int, predicted int"))
    per = {r["cls"]: r for r in EV.class_metrics(EV.confusion_matrix(pred)).collect()}
    assert per[1]["precision"] is None and per[1]["recall"] == 0.0      # never predicted
    assert per[3]["recall"] is None and per[3]["precision"] == 0.0      # never present
    assert per[2]["f1"] == 1.0
    s = EV.classification_metrics(EV.confusion_matrix(pred)).first()
    assert math.isclose(s["accuracy"], 3 / 5)
    assert math.isclose(s["macro_precision"], (2 / 3 + 1.0 + 0.0) / 3)


def test_all_correct(spark):
    pred = spark.createDataFrame([(0, 0), (1, 1)], "actual int, predicted int")
    s = EV.classification_metrics(EV.confusion_matrix(pred)).first()
    assert (s["accuracy"], s["macro_f1"]) == (1.0, 1.0)
    wide = EV.confusion_wide(EV.confusion_matrix(pred), [0, 1]).orderBy("actual").collect()
    assert [tuple(r) for r in wide] == [(0, 1, 0), (1, 0, 1)]
