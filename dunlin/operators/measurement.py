"""What was recovered: composed propensities, outcome model, doubly-robust value, intervals, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, stats
from dunlin.operators import scale

CLIP, SHRINK = 20.0, 25.0
RESAMPLES = 400
NOTHING = "do_nothing"


def compose(branches: DataFrame, key: str = "row_no") -> DataFrame:
    """Resolve allocator branches: refused by admission first, then by the rules; refused mass goes to do_nothing.

    Input columns: key, action, mass, admissible, rank (0 allows), blocking.
    """
    nothing = F.col("action") == NOTHING
    held = ~nothing & ~F.col("admissible")
    refused = ~nothing & F.col("admissible") & (F.col("rank") > 0)
    return (branches.withColumn("resolved_to", F.when(held | refused, NOTHING).otherwise(F.col("action")))
            .withColumn("vetoed", held | refused)
            .withColumn("why", F.when(held, "ALLOC-ADMISSION").when(refused, F.col("blocking")).otherwise("")))


def executed(resolved: DataFrame, key: str = "row_no") -> DataFrame:
    return resolved.groupBy(key, F.col("resolved_to").alias("action")).agg(F.sum("mass").alias("p"))


def outcome_cells(logs: DataFrame, shrinkage: float = SHRINK) -> DataFrame:
    """(stratum, action, q): mean reward shrunk to the action mean.  Strata and actions are closed sets,
    so both aggregates are small after the map-side combine."""
    cell = logs.groupBy("stratum", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("reward_paise").alias("s"))
    act = cell.groupBy("action").agg((F.sum("s") / F.sum("n")).alias("parent"))
    w = F.col("n") / (F.col("n") + shrinkage)
    return cell.join(act, "action").select("stratum", "action", "n", (w * F.col("s") / F.col("n") + (1 - w) * F.col("parent")).alias("q"), "parent")


def predict(rows: DataFrame, cells: DataFrame, grand: Column | float) -> DataFrame:
    """q for (stratum, action): the cell, else the action mean, else the grand mean."""
    c = cells.select("stratum", "action", F.col("q").alias("_q"))
    a = cells.select("action", F.col("parent").alias("_p")).distinct()
    g = grand if isinstance(grand, Column) else F.lit(grand)
    return rows.join(c, ["stratum", "action"], "left").join(a, "action", "left").withColumn("q", F.coalesce("_q", "_p", g)).drop("_q", "_p")


def grand_mean(logs: DataFrame) -> float:
    return float(logs.agg(F.avg("reward_paise").alias("g")).first()["g"] or 0.0)


def tilt(dist: DataFrame, exponent: float, key: str = "row_no") -> DataFrame:
    raised = dist.withColumn("_r", F.pow("p", F.lit(exponent)))
    tot = raised.groupBy(key).agg(F.sum("_r").alias("_t"))
    return raised.join(tot, key).withColumn("p", F.col("_r") / F.col("_t")).drop("_r", "_t")


def null_target(logs: DataFrame, key: str = "row_no") -> DataFrame:
    return logs.select(key, F.lit(NOTHING).alias("action"), F.lit(1.0).alias("p"))


def row_values(logs: DataFrame, target: DataFrame, cells: DataFrame, grand: float, clip: float = CLIP, key: str = "row_no") -> DataFrame:
    """Doubly-robust value of each logged row: direct part plus clipped correction."""
    base = logs.select(key, "subject_token", "stratum", F.col("action").alias("realized"), "pi_realized", "reward_paise")
    t = predict(target.join(logs.select(key, "stratum"), key), cells, grand)
    direct = t.groupBy(key).agg(F.sum(F.col("p") * F.col("q")).alias("direct"))
    hit = target.select(key, F.col("action").alias("realized"), F.col("p").alias("p_target"))
    j = base.join(direct, key).join(hit, [key, "realized"], "left")
    j = predict(j.withColumnRenamed("realized", "action"), cells, grand)
    raw = F.coalesce("p_target", F.lit(0.0)) / F.col("pi_realized")
    w = F.least(raw, F.lit(clip))
    return j.select(key, "subject_token", w.alias("weight"), (raw > clip).alias("clipped"), "reward_paise",
                    (F.col("direct") + w * (F.col("reward_paise") - F.col("q"))).alias("value"))


def estimate(values: DataFrame) -> DataFrame:
    return values.agg(
        F.avg("value").alias("point"), F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("clipped").cast("double")).alias("clipped_share"),
        F.coalesce(F.try_divide(F.sum("weight") * F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("effective_sample_size"),
        F.avg(F.col("weight") * F.col("reward_paise")).alias("ips"))


def poisson_weight(draw16: Column) -> Column:
    """Poisson(1) count of a 16-bit uniform draw (inverse distribution function)."""
    p, cum, cuts = 0.36787944117144233, 0.0, []
    for k in range(1, 9):
        cum += p
        cuts.append(int(round(cum * 65536)))
        p /= k
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(draw16 >= c, 1).otherwise(0)
    return out


def bootstrap(values: DataFrame, resamples: int = RESAMPLES, seed: str = "boot") -> DataFrame:
    """Subject-cluster bootstrap of the row mean, one row per draw.

    Rows are first summed per subject.  Each subject then draws its own Poisson(1) multiplicity per
    resample from a digest (sixteen draws per digest), so no resample is materialised, nothing is
    joined, and the partial sums of all draws are combined on the map side.
    """
    per = values.groupBy("subject_token").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    blocks = (resamples + 15) // 16
    e = per.select("s", "c", "subject_token", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    e = e.withColumn("h", F.sha2(F.concat_ws(hashing.SEP, F.lit(seed), F.col("subject_token"), F.col("blk").cast("string")).cast("binary"), 256))
    w = [poisson_weight(F.conv(F.substring("h", 1 + 4 * j, 4), 16, 10).cast("long")) for j in range(16)]
    agg = e.groupBy("blk").agg(*[F.sum(x * F.col("s")).alias(f"s{j}") for j, x in enumerate(w)], *[F.sum(x * F.col("c")).alias(f"c{j}") for j, x in enumerate(w)])
    rows = F.array(*[F.struct((F.col("blk") * 16 + j).alias("draw"), F.coalesce(F.try_divide(f"s{j}", f"c{j}"), F.lit(0.0)).alias("mean")) for j in range(16)])
    return agg.select(F.inline(rows)).filter(F.col("draw") < resamples)


def interval(draws: DataFrame) -> DataFrame:
    return draws.agg(F.expr("percentile(mean, 0.025)").alias("lo"), F.expr("percentile(mean, 0.975)").alias("hi"))


# ---- curves --------------------------------------------------------------------------------------
def reliability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Ten equal bins, the last one closed; empty bins are kept."""
    b = F.greatest(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    g = scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("predicted"), F.avg("label").alias("observed"))
    spine = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(g, "bin", "left").na.fill(0)


def calibration_error(curve: DataFrame) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return curve.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")), F.lit(0.0)).alias("ece"), F.max(F.when(F.col("n") > 0, gap)).alias("mce"))


def ranked(scores: DataFrame, tie: str, sums: dict[str, Column] | None = None, totals: dict[str, Column] | None = None, descending: bool = True) -> DataFrame:
    """Exact rank and running sums in score order over the whole table, two-level."""
    order = [F.col("score").desc() if descending else F.col("score"), F.col(tie)]
    return scale.running(scores, [], scale.value_bucket(scores, "score", tie, descending), order, sums=sums, rank="place",
                         totals={"n": F.lit(1).cast("long"), **(totals or {})})


def average_precision(scores: DataFrame, tie: str) -> DataFrame:
    r = ranked(scores, tie, {"tp": F.col("label").cast("long")}, {"pos": F.col("label").cast("long")})
    return r.filter(F.col("label") == 1).agg((F.sum(F.col("tp") / F.col("place")) / F.max("pos")).alias("average_precision"), F.max("pos").alias("positives"))


def ntile_of(place: Column, n: Column, k: int = 10) -> Column:
    q, rem = F.floor(n / k), n % k
    big = rem * (q + 1)
    return F.when(place <= big, F.floor((place - 1) / (q + 1)) + 1).otherwise(rem + F.floor((place - big - 1) / F.greatest(q, F.lit(1))) + 1).cast("int")


def decile_uplift(scores: DataFrame, tie: str) -> DataFrame:
    r = ranked(scores, tie, descending=False).withColumn("decile", ntile_of(F.col("place"), F.col("n")))
    return r.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("predicted"), F.avg("truth").alias("observed"))


def qini(scores: DataFrame, tie: str, points: int = 20) -> DataFrame:
    """Gain at the sampled ranks of the score order: treated responses minus scaled control responses."""
    t = F.col("treated").cast("long")
    r = ranked(scores, tie, {"tr": F.col("outcome") * t, "cr": F.col("outcome") * (1 - t), "tc": t, "cc": 1 - t})
    wanted = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda j: F.struct(j.alias("j"), F.greatest(F.floor(j * F.col("n") / points), F.lit(1)).alias("rk")))
    at = r.select("n", "place", "tr", "cr", "tc", "cc", F.inline(F.filter(wanted, lambda x: x["rk"] == F.col("place"))))
    gain = F.col("tr") - F.col("cr") * F.when(F.col("cc") > 0, F.col("tc") / F.col("cc")).otherwise(0.0)
    return at.select("j", "n", gain.alias("gain"))


def qini_area(curve: DataFrame, points: int = 20) -> DataFrame:
    """Trapezoid area between the curve and the straight line to its last gain."""
    g = F.max_by("gain", "j")
    inner = F.sum(F.when(F.col("j") < points, F.col("gain")).otherwise(F.col("gain") / 2)) / points
    return curve.agg((inner - g / 2).alias("area"), g.alias("overall_gain"), ((inner - g / 2) / F.max("n") * 1000).alias("coefficient"))


# ---- scoreboard ----------------------------------------------------------------------------------
def arm_totals(rows: DataFrame) -> DataFrame:
    """Counts and money per arm from outcome rows (contact, right_party, ... are booleans)."""
    treated = rows.filter("contact").select("arm", "subject_token").distinct().groupBy("arm").agg(F.count(F.lit(1)).alias("treated_subjects"))
    people = rows.select("arm", "subject_token").distinct().groupBy("arm").agg(F.count(F.lit(1)).alias("subjects"))
    g = rows.groupBy("arm").agg(
        F.count_if("contact").alias("contacts"), F.count_if(F.col("contact") & F.col("right_party")).alias("right_party_contacts"), F.sum("cost_paise").alias("spend_paise"),
        F.sum("reward_paise").alias("recovered_paise"), F.count_if("complained").alias("complaints"), F.count_if("opted_out").alias("opt_outs"),
        F.count_if("cancelled").alias("cancellations"), F.count_if("promised").alias("promises_made"), F.count_if(F.col("promised") & F.col("kept")).alias("promises_kept"),
        F.count_if("disputed").alias("disputes"))
    return g.join(people, "arm", "left").join(treated, "arm", "left").na.fill(0)


def guardrails(totals: DataFrame, control: str = "null") -> DataFrame:
    """The eight rates that must stand beside every recovery figure."""
    ctl = totals.filter(F.col("arm") == control).agg(F.max("subjects").alias("_cs"), F.max("cancellations").alias("_cc"))
    # the five arm rows carry the control counts by way of a constant key
    j = totals.withColumn("_k", F.lit(1)).join(ctl.withColumn("_k", F.lit(1)), "_k").drop("_k")
    c = F.col
    return j.select("*", stats.rate(c("complaints"), c("contacts"), 1000.0).alias("complaint_rate_per_1000"), stats.rate(c("opt_outs"), c("contacts"), 1000.0).alias("opt_out_rate_per_1000"),
                    stats.rate(c("cancellations"), c("treated_subjects")).alias("voluntary_cancel_rate_treated"), stats.rate(c("_cc"), c("_cs")).alias("voluntary_cancel_rate_control"),
                    stats.rate(c("spend_paise"), c("recovered_paise")).alias("cost_per_rupee_collected"), stats.rate(c("promises_made"), c("contacts")).alias("promise_made_rate"),
                    stats.rate(c("promises_kept"), c("promises_made")).alias("promise_kept_rate"), stats.rate(c("right_party_contacts"), c("contacts")).alias("right_party_contact_rate")).drop("_cs", "_cc")


def headline(totals: DataFrame, comparator: str = dims.COMPARATOR) -> DataFrame:
    base = totals.filter(F.col("arm") == comparator).select(F.lit(1).alias("_k"), F.col("recovered_paise").alias("comparator_recovered_paise"))
    j = totals.withColumn("_k", F.lit(1)).join(base, "_k").drop("_k")
    inc = F.col("recovered_paise") - F.col("comparator_recovered_paise")
    return j.withColumn("incremental_paise", inc).withColumn("incremental_per_rupee_spent", F.when(F.col("spend_paise") > 0, inc / F.col("spend_paise")).otherwise(0.0))
