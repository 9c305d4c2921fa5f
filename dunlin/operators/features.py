"""The 43 model features, and the engagement history behind some of them.

Histories are aggregated to counts and extremes before the feature row is built, so a feature row never
carries an array that grows with the account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, stats, times


def engagement(log: DataFrame, key: str, at: Column) -> DataFrame:
    """Ten conditional counters and the last contact, as of a moment (one partially aggregated pass)."""
    a, past = F.col("action"), log.filter(F.col("at_ts") < at)
    contact, silent = a.isin(*dims.CONTACT_ACTIONS), a.isin(*dims.SILENT_ACTIONS)
    return past.groupBy(key).agg(
        F.count_if(a.isin(*dims.NUDGE_ACTIONS)).alias("nudges_sent"), F.count_if(a.isin(*dims.VOICE_ACTIONS)).alias("voice_attempts"), F.count_if(silent).alias("silent_attempts"),
        F.count_if(F.col("paid") & contact).alias("payments_after_contact"), F.count_if(F.col("paid") & silent).alias("payments_after_silent"),
        F.count_if("adverse").alias("adverse_events"), F.count_if("opted_out").alias("opt_outs"), F.count_if("complained").alias("complaints"),
        F.count_if("promised").alias("promises_made"), F.count_if(F.col("promised") & F.col("kept")).alias("promises_kept"), F.max(F.when(contact, F.col("at_ts"))).alias("last_contact_at"))


def mode_day(moments: DataFrame, key: str, zone: Column) -> DataFrame:
    """Most frequent local day of the month, the smallest on ties: at most 31 rows per key after the first step."""
    day = F.dayofmonth(times.local(F.col("at_ts"), zone)).alias("day")
    n = moments.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max_by("day", F.struct(F.col("n"), (-F.col("day")).alias("d"))).alias("salary_day"))


def extract(obs: DataFrame, at: Column, zone: Column, keep: list[str]) -> DataFrame:
    """One double per feature, NULL where nothing was observed; the order is fixed by the vocabulary."""
    c, local = F.col, times.local(at, zone)

    def days(ts: str) -> Column:
        return times.seconds_between(at, c(ts)) / 86400.0

    def flag(cond: Column) -> Column:
        return F.when(cond, 1.0).otherwise(0.0)
    cap, amount = c("mandate_cap_paise"), c("amount_paise")
    contacts = c("nudges_sent") + c("voice_attempts")
    exprs = {
        "prior_bounces_90d": c("bounces_90d"), "bounce_streak": F.greatest(c("declines") - c("payments"), F.lit(0)), "tenure_days": c("tenure_days"),
        "rail": hashing.category_bucket(c("rail_name")), "plan_value_paise": c("plan_paise"), "invoice_ageing_bucket": hashing.category_bucket(c("ageing")),
        "consents_granted": c("consents_granted"), "days_since_last_credit": days("last_payment_at"), "payments_90d": c("payments"), "day_of_month": F.dayofmonth(local),
        "is_month_end": flag(F.dayofmonth(local) >= 26), "inferred_salary_day": c("salary_day"), "days_to_inferred_salary_day": times.days_to_day_of_month(F.dayofmonth(local), c("salary_day")),
        "mandate_headroom_paise": cap - amount, "mandate_over_cap": F.when(cap.isNotNull(), flag(amount > cap)), "mandate_age_days": days("registered_at"),
        "reissue_flag": flag(c("reissued_at").isNotNull()), "days_since_reissue": days("reissued_at"), "mandate_active": flag(c("mandate_status") == "active"),
        "issuer_id": hashing.category_bucket(c("issuer_ref")), "issuer_7d_decline_rate": c("issuer_rate_7d"), "live_degradation_flag": flag(c("degraded")), "amount_paise": amount,
        "amount_vs_median_ratio": stats.ratio(amount, c("median_paise")), "is_first_charge_of_cycle": flag(c("declines") == 0), "hard_decline_seen": flag(c("mac03_seen")),
        "do_not_retry_seen": flag(c("advice_seen")), "contact_history_7d": c("contacts_7d"), "contact_history_30d": c("contacts_30d"), "nudges_sent": c("nudges_sent"),
        "voice_attempts": c("voice_attempts"), "silent_attempts": c("silent_attempts"), "payments_after_contact": c("payments_after_contact"), "payments_after_silent": c("payments_after_silent"),
        "contact_conversion": stats.ratio(c("payments_after_contact"), contacts), "adverse_events": c("adverse_events"), "adverse_per_contact": stats.ratio(c("adverse_events"), contacts),
        "opt_outs": c("opt_outs"), "complaints": c("complaints"), "hours_since_last_contact": times.seconds_between(at, c("last_contact_at")) / 3600.0,
        "prior_promises": c("promises_made") + c("ptp_total"), "prior_promises_kept": c("promises_kept") + c("ptp_kept"), "prior_kept_ratio": stats.ratio(c("ptp_kept"), c("ptp_total")),
    }
    return obs.select(*keep, *[exprs[n].cast("double").alias(n) for n in dims.FEATURES])
