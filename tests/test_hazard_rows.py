"""The hazard is fitted over the different rows of the periods, however many periods have them."""

from pyspark.sql import functions as F

from dunlin.operators import models


def _promises(spark):
    n = F.col("id")
    kept = n % 3 != 0
    return spark.range(6000).select((n % 10).cast("double").alias("f_size"), F.when(n % 2 == 0, 5.0).otherwise(9.0).alias("horizon_days"),
                                    F.when(kept, n % 4 + 1).otherwise(F.when(n % 2 == 0, 5).otherwise(9)).alias("observed_days"), kept.alias("kept"), F.lit(0.5).alias("selection_propensity"))


def test_trees_read_different_rows_once(spark, monkeypatch):
    seen, write = {}, models.materialise

    def kept(df, label):
        seen[label] = write(df, label)
        return seen[label]
    monkeypatch.setattr(models, "materialise", kept)
    periods = models.person_periods(_promises(spark))
    model = models.fit_hazard(periods, ["f_size"], trees=2)
    assert seen["hazard"].count() == periods.select("f_size", "period", "horizon_days", "label", "weight").distinct().count() < periods.count() / 20
    assert seen["hazard"].agg(F.sum("_n")).first()[0] == periods.count()

    cells = _promises(spark).groupBy("f_size", "horizon_days", "observed_days", "kept", "selection_propensity").agg(F.count(F.lit(1)).alias("n"))
    counted = models.fit_hazard(models.person_periods(cells), ["f_size"], trees=2, count="n")
    rows = _promises(spark).select("f_size", "horizon_days", "kept")
    a, b = ({(r.f_size, r.horizon_days): r.p_kept for r in models.survival(m, rows).distinct().collect()} for m in (model, counted))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert models.survival(model, rows).count() == 6000
    assert all(0 < p < 1 for p in a.values())
