from barloom.operators import boosting as G
from barloom.plans import study


def test_boosted_importance_of_every_fold(spark):
    rows, folds = study.grown(spark, "/root/testdata/sf0.01")
    names = [*study.BOOSTED, "root"]
    gains = G.gains(spark, folds, names).toPandas()
    assert len(folds) > 20 and len(gains) == len(folds) * 18
    assert gains.groupby("fold_id").gain.sum().gt(0).mean() > 0.9
    tested = G.forecast(rows, folds).toPandas()
    assert not tested.duplicated(["root", "instrument_id", "ts"]).any()  # each row is tested once
    # better than the mean of each fold, if only a little: prices of line items are drawn independently
    first = tested.fold_id.map({f.fold_id: f.first for f in folds})
    assert ((tested.target - tested.pred_gbt) ** 2).mean() < 0.99 * ((tested.target - first) ** 2).mean()


def test_quantile_forecasts_cover(spark):
    got = {r.root: r.coverage for r in study.m11(spark, "/root/testdata/sf0.01").collect()}
    assert abs(got["all"] - 0.9) < 0.02
