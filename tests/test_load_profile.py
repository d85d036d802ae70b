import random

from pyspark.sql import functions as F

from tessaryn.operators.load_profile import auc, column_auc, fit_logistic, profile


def make(spark, odd):
    rnd, rows = random.Random(3), []
    for load in range(14):
        for _ in range(260):
            a, b = rnd.betavariate(2, 4), rnd.lognormvariate(8, 1)
            a, b = odd.get(load, lambda a, b: (a, b))(a, b)
            rows.append((f"L{load:02d}", len(rows), None if a is None or rnd.random() < 0.05 else round(a, 3), None if b is None else round(b, 2)))
    return spark.createDataFrame(rows, "load string, id bigint, a double, b double")


def test_planted_departures_and_nothing_else(spark):
    odd = {1: lambda a, b: (1 - a, b), 3: lambda a, b: (a if hash((a, b)) % 2 else None, b), 5: lambda a, b: (a, round(b, -3)), 7: lambda a, b: (a, b * 100), 9: lambda a, b: (round(a, 1), min(b, 2500.0))}
    out = profile(make(spark, odd), "t", "load", ["a", "b"], F.xxhash64("id"))
    assert sorted((r.load_id, r.column_name) for r in out.where("found").collect()) == [("L01", "a"), ("L03", "a"), ("L05", "b"), ("L07", "b"), ("L09", "a"), ("L09", "b")]
    one = out.where("load_id = 'L00' AND column_name = 'b'").first()
    assert (one.n_rows, one.missing) == (260, 0.0) and one.low > 0 and one.n_distinct > 200


def test_null_empty_tie_and_nan(spark):
    rows = [("x", i, None, float("nan")) for i in range(5)] + [("y", i, 1.0, 2.0) for i in range(5)] + [(None, 9, 1.0, 1.0)]
    out = {(r.load_id, r.column_name): r for r in profile(spark.createDataFrame(rows, "load string, id bigint, a double, b double"), "t", "load", ["a", "b"], F.xxhash64("id")).collect()}
    assert len(out) == 4 and out["x", "b"].missing == 1 and out["x", "a"].low is None and out["y", "a"].n_distinct == 1
    assert profile(make(spark, {}).limit(0), "t", "load", ["a"], F.xxhash64("id")).count() == 0


def test_measures():
    import numpy as np

    assert auc(np.array([1.0, 2, 2, 3]), np.array([0.0, 0, 1, 1]), np.array([1.0, 1, 0, 0])) == 0.875
    x = np.array([[0.0], [1.0]])
    assert fit_logistic(np.vstack([x, x]), np.array([1, 1, 0, 0.0]), np.array([1, 9, 9, 1.0]), ridge=1e-6)[0] > 3
    same = np.ones((5, 181))
    assert abs(column_auc(same, same) - 0.5) < 0.02


def test_joint_model_sees_every_row(spark):
    df = make(spark, {1: lambda a, b: (1 - a, b), 7: lambda a, b: (a, b * 100)})
    # the same folds, but other hashes: a hashed sample would be another
    one, two = ({(r.load_id, r.column_name): (r.joint_auc, r.ablation) for r in profile(df, "t", "load", ["a", "b"], F.col("id") + k).collect()} for k in (0, 1000))
    assert all(abs(x - y) < 1e-6 for k in one for x, y in zip(one[k], two[k], strict=True))
    assert one["L01", "a"][0] > 0.7 and one["L01", "a"][1] > 0.1 > abs(one["L01", "b"][1]) and one["L07", "b"][1] > 0.1
    assert 0.35 < one["L00", "a"][0] < 0.65
