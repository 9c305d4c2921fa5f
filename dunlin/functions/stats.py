"""Small numeric rules used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """NULL on a zero denominator."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def rate(n: Column, d: Column, scale: float = 1.0) -> Column:
    """Zero on a zero or missing denominator (report rates)."""
    return F.when(d > 0, F.lit(scale) * n / d).otherwise(F.lit(0.0))


def inverse_weight(p: Column, cap: float = 20.0) -> Column:
    return F.when(p.isNull() | F.isnan(p), 1.0).when(p <= 0, cap).otherwise(F.least(F.try_divide(F.lit(1.0), p), F.lit(cap)))


def binomial_half_width(p: Column, n: Column) -> Column:
    spread = 2.0 * F.sqrt(F.greatest(p * (1.0 - p), F.lit(1e-6)) / F.greatest(n, F.lit(1)))
    return F.when(n <= 0, 0.5).otherwise(F.greatest(spread, F.lit(0.01)))


def effect_half_width(treated: Column, control: Column) -> Column:
    units = F.greatest(F.least(treated, control), F.lit(1))
    return F.greatest(1.0 / F.sqrt(units), F.lit(0.01))


def claim_count_bucket(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 3, "2_3").otherwise("4_plus")


def value_decile(total: Column, cutoffs: list) -> Column:
    """Cut-offs not above the total, at most nine; the cut-offs are an ascending literal list."""
    out = F.lit(0)
    for c in cutoffs:
        out = out + F.when(total >= F.lit(c), 1).otherwise(0)
    return F.least(out, F.lit(9))


def ltv_weight(amount: Column, ltv: Column, sensitivity: float = 0.35) -> Column:
    return 1.0 + sensitivity * F.log1p(F.greatest(ltv / F.greatest(amount, F.lit(1)), F.lit(0.0)))


def annoyance(intrusion: Column, contacts_7d: Column, ltv: Column) -> Column:
    pressure = F.pow((F.greatest(contacts_7d, F.lit(0)) + 1).cast("double"), F.lit(1.3))
    return F.when(intrusion == 0, 0.0).otherwise(intrusion * pressure * ltv.cast("double"))


def candidate_value(tau: Column, amount: Column, ltv: Column, rupee: Column, intrusion: Column, contacts: Column) -> Column:
    return tau * amount.cast("double") * ltv_weight(amount, ltv) - rupee.cast("double") - annoyance(intrusion, contacts, ltv)


def ewma(rates: Column, alpha: float = 0.25) -> Column:
    """struct<mu,var> folded over an array of rates, oldest first; (0, 0) when empty."""
    start = F.struct(F.coalesce(F.get(rates, F.lit(0)), F.lit(0.0)).alias("mu"), F.lit(0.0).alias("var"))
    rest = F.when(F.size(rates) > 1, F.slice(rates, 2, F.greatest(F.size(rates) - 1, F.lit(1)))).otherwise(
        F.array().cast("array<double>"))
    return F.aggregate(rest, start, lambda s, r: F.struct(
        (alpha * r + (1 - alpha) * s["mu"]).alias("mu"),
        (alpha * (r - s["mu"]) * (r - s["mu"]) + (1 - alpha) * s["var"]).alias("var")))
