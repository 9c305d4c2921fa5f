"""Learned estimates with Spark ML trees: bounce, uplift, promise; and the discipline around them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin.functions import hashing, stats
from dunlin.operators import scale
from dunlin.session import materialise

COLD_MIN, COLD_BOOST, DEGRADED_BOOST, MIN_WIDTH = 50, 0.15, 0.05, 0.10
MIN_ARM = 60
MAX_HORIZON = 21
CONTROL = "do_nothing"


def split_by_account(rows: DataFrame, holdout: float, seed: int, key: str = "account") -> DataFrame:
    """Add ``is_train``: a fixed share of accounts in hash order; rows of an account stay together."""
    acc = rows.select(key).distinct().withColumn("_h", F.sha2(F.concat_ws(hashing.SEP, F.lit(str(seed)), F.col(key).cast("string")), 256))
    acc = acc.withColumn("_n", F.conv(F.substring("_h", 1, 12), 16, 10).cast("long"))
    r = scale.running(acc, [], F.floor(F.col("_n") / (1 << 40)), [F.col("_n"), F.col("_h")], rank="_p", totals={"_t": F.lit(1).cast("long")}, split=scale.BUCKET_ROWS)
    cut = F.bround(F.col("_t") * (1.0 - holdout), 0)
    return rows.join(r.select(key, (F.col("_p") <= cut).alias("is_train")), key)


def require_propensity(rows: DataFrame, column: str = "propensity") -> DataFrame:
    """Refuse a log with a missing or impossible propensity (checked row by row while it runs)."""
    ok = F.coalesce((F.col(column) > 0) & (F.col(column) <= 1) & ~F.isnan(column), F.lit(False))
    return rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit("propensity must be a number above 0 and not above 1")).cast("double")))


def with_missing(rows: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """NULL becomes zero plus an indicator column: Spark trees have no branch for missing values."""
    out = rows.select("*", *[F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in names]).na.fill(0.0, names)
    return out, names + [f"{n}_missing" for n in names]


def fit_bounce(rows: DataFrame, names: list[str], seed: int = 7, trees: int = 10, depth: int = 4) -> tuple[DataFrame, dict]:
    """Classifier on one set of accounts, isotonic map on a second, scores on a third (disjoint)."""
    data, cols = with_missing(rows, names)
    a = split_by_account(data, 0.25, seed).withColumnRenamed("is_train", "working")
    b = split_by_account(a.filter("working"), 0.25 / 0.75, seed + 1)
    asm = VectorAssembler(inputCols=cols, outputCol="features")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.85, seed=seed)
    train = asm.transform(b.filter("is_train")).select("features", F.col("label").cast("double").alias("label"))
    model = gbt.fit(train)

    def raw(df: DataFrame) -> DataFrame:
        return model.transform(asm.transform(df)).withColumn("raw", vector_to_array("probability")[1])
    cal = raw(b.filter(~F.col("is_train"))).select(F.col("raw").alias("f"), F.col("label").cast("double").alias("label"))
    iso = IsotonicRegression(labelCol="label", featuresCol="f").fit(cal)
    held = raw(a.filter(~F.col("working"))).select(*rows.columns, "raw", F.col("raw").alias("f"))
    out = iso.transform(held).withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
    return out.select(*rows.columns, "raw", "score"), {"trees": trees}


class XLearner:
    """Per-action effect: shared control model, treated model, two effect models blended by the logged propensity."""

    def __init__(self, names: list[str], trees: int = 5, depth: int = 3, min_leaf: int = 150, seed: int = 11):
        self.names, self.trees, self.depth, self.min_leaf, self.seed = names, trees, depth, min_leaf, seed
        self.models: dict[str, tuple] = {}
        self.support: dict[str, dict] = {}

    def _fit(self, df: DataFrame, label: str):
        asm = VectorAssembler(inputCols=self.cols, outputCol="features")
        gbt = GBTRegressor(labelCol=label, featuresCol="features", maxIter=self.trees, maxDepth=self.depth, stepSize=0.2, minInstancesPerNode=self.min_leaf, seed=self.seed)
        return Pipeline(stages=[asm, gbt]).fit(df)

    @staticmethod
    def _predict(model, df: DataFrame, name: str) -> DataFrame:
        return model.transform(df).withColumnRenamed("prediction", name).drop("features")

    def fit(self, rows: DataFrame, actions: list[str]) -> "XLearner":
        data, self.cols = with_missing(require_propensity(rows), self.names)
        data = data.withColumn("y", F.col("paid").cast("double"))
        means = {r["action"]: (r["n"], r["m"]) for r in data.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).collect()}   # a row per action
        n0, m0 = means.get(CONTROL, (0, 0.0))
        if n0 < MIN_ARM:
            raise ValueError(f"the control arm has fewer than {MIN_ARM} rows")
        control = data.filter(F.col("action") == CONTROL)
        mu0 = self._fit(control, "y")
        for a in actions:
            n1, m1 = means.get(a, (0, m0))
            self.support[a] = {"treated": n1, "control": n0, "mean_effect": m1 - m0, "cold": n1 < MIN_ARM}
            if n1 < MIN_ARM:
                continue
            treated = data.filter(F.col("action") == a)
            mu1 = self._fit(treated, "y")
            d1 = self._predict(mu0, treated, "_mu0").withColumn("d", F.col("y") - F.col("_mu0"))
            d0 = self._predict(mu1, control, "_mu1").withColumn("d", F.col("_mu1") - F.col("y"))
            self.models[a] = (self._fit(d1, "d"), self._fit(d0, "d"))
        return self

    def tau(self, rows: DataFrame, action: str) -> DataFrame:
        """Add ``tau``: g·tau0 + (1-g)·tau1 with the logged propensity g; the arm mean when cold."""
        s = self.support[action]
        if s["cold"]:
            return rows.withColumn("tau", F.lit(float(s["mean_effect"])))
        data, _ = with_missing(rows, self.names)
        t1, t0 = self.models[action]
        x = self._predict(t0, self._predict(t1, data, "_t1"), "_t0")
        g = F.least(F.greatest(F.col("propensity"), F.lit(0.0)), F.lit(1.0))
        return x.withColumn("tau", g * F.col("_t0") + (1 - g) * F.col("_t1")).drop("_t0", "_t1", *[f"{n}_missing" for n in self.names])


def serve(value: Column, prior: Column, half_width: Column, observations: Column, stale: Column) -> Column:
    """Estimate struct: a model point with its interval, or the segment prior when cold or stale."""
    cold = observations < COLD_MIN
    use_prior = cold | stale
    point = F.when(use_prior, prior).otherwise(value)
    width = F.when(use_prior, F.greatest(half_width * 0, F.lit(MIN_WIDTH))).otherwise(half_width)
    return F.struct(point.alias("value"), (point - width).alias("lower"), (point + width).alias("upper"), F.when(use_prior, "segment_prior").otherwise("model").alias("basis"),
                    (~cold & stale).alias("degraded"), cold.alias("cold_start"), F.when(cold, COLD_BOOST).when(stale, DEGRADED_BOOST).otherwise(0.0).alias("exploration_boost"))


def estimate_violations(e: Column) -> Column:
    soft = e["degraded"] | e["cold_start"]
    width = (e["upper"] - e["lower"]) / 2
    checks = [("interval", ~((e["lower"] <= e["value"]) & (e["value"] <= e["upper"]))), ("basis", soft & (e["basis"] == "model")),
              ("width", soft & (width < MIN_WIDTH - 1e-12)), ("boost", soft & (e["exploration_boost"] <= 0))]
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]), lambda x: x.isNotNull())


def person_periods(promises: DataFrame) -> DataFrame:
    """One row per observed day of a promise, stopping at censoring; the label marks the day it was kept."""
    n = F.least(F.col("observed_days"), F.lit(MAX_HORIZON))
    x = promises.filter(n > 0).withColumn("_n", n.cast("int")).withColumn("period", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return x.withColumn("label", (F.col("kept") & (F.col("period") == F.col("_n"))).cast("double")).withColumn("weight", stats.inverse_weight(F.col("selection_propensity"))).drop("_n")


def fit_hazard(periods: DataFrame, names: list[str], trees: int = 8, seed: int = 5, count: str | None = None):
    """Boosted trees over the different (features, label, weight) of the periods, each weighed by how many periods have it, so
    that what the trees read and keep grows with the different rows only.  ``count`` names a column of how many periods a row
    stands for.  A leaf holds the weight of 40 periods at least (not in tables of fewer than 80 periods)."""
    columns = [*names, "period", "horizon_days"]
    n = F.sum(F.col(count)) if count else F.count(F.lit(1))
    rows = periods.groupBy(*columns, "label", "weight").agg(n.alias("_n")).withColumn("weight", F.col("weight") * F.col("_n"))
    rows = materialise(rows.sortWithinPartitions(*columns, "label", "weight"), "hazard")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    asm = VectorAssembler(inputCols=columns, outputCol="features")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.3, minWeightFractionPerNode=min(40 / max(total, 1), 0.49), seed=seed)
    return Pipeline(stages=[asm, gbt]).fit(rows)


def survival(model, promises: DataFrame) -> DataFrame:
    """Add ``p_kept``, the probability of being kept within the horizon: one minus the product of (1 - hazard).

    The model is asked once for each different (features, horizon)."""
    names = [c for c in model.stages[0].getInputCols() if c not in ("period", "horizon_days")]
    keys = [*names, "horizon_days"]
    h = F.greatest(F.least(F.col("_given"), F.lit(MAX_HORIZON)), F.lit(1)).cast("int")
    x = promises.select(*names, F.col("horizon_days").alias("_given")).distinct().withColumn("horizon_days", h).withColumn("period", F.explode(F.sequence(F.lit(1), h)))
    p = model.transform(x).withColumn("_h", F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.0)), F.lit(1.0 - 1e-12)))
    p = p.groupBy(*names, F.col("_given").alias("horizon_days")).agg((1 - F.exp(F.sum(F.log1p(-F.col("_h"))))).alias("p_kept"))
    return promises.join(p, keys)


def promise_report(promises: DataFrame) -> DataFrame:
    kept, cens = F.count_if("kept"), F.count_if("censored")
    broken = F.count_if(~F.col("kept") & ~F.col("censored"))
    n = F.count(F.lit(1))
    return promises.agg(n.alias("promises"), kept.alias("kept_n"), broken.alias("broken"), cens.alias("censored_n"),
                        stats.rate(n - kept, n).alias("naive_broken_rate"), stats.rate(broken, kept + broken).alias("resolved_broken_rate"))
