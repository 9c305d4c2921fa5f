"""Which layer caused a failure: issuer cells with power, mandate faults, code lookup, free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dunlin import dims
from dunlin.functions import stats, times
from dunlin.operators import scale

FINEST = dims.LADDER[0][1]
_SECONDS = {n: s for n, s, _ in dims.LADDER}


def _key(level: str, issuer: Column, rail: Column) -> Column:
    who = F.coalesce(F.when(issuer != "", issuer), F.lit("unknown"))
    if level == "issuer_day":
        return who
    if level == "instrument_network_15m":
        return rail
    return F.concat_ws("|", who, rail)


def level_rows(issuer: Column, rail: Column, finest_bucket: Column) -> Column:
    """array<struct<lvl_no, level, key, bucket>>: where a presentation counts, at the four grains.

    Every coarser bucket is a whole multiple of the finest, so it follows from the finest bucket.
    """
    return F.array(*[
        F.struct(F.lit(i).alias("lvl_no"), F.lit(n).alias("level"), _key(n, issuer, rail).alias("key"),
                 F.floor(finest_bucket / F.lit(s // FINEST)).cast("long").alias("bucket"))
        for i, (n, s, _) in enumerate(dims.LADDER)])


def cohort_cells(presentations: DataFrame) -> DataFrame:
    """Attempts and declines per (level, key, bucket).

    The finest grain is aggregated first (map side, then once across the cluster), and only those
    cells are multiplied by the four levels, so hot issuers cost one partial aggregate per task.
    """
    fine = presentations.withColumn("_b", times.bucket(F.col("at_ts"), FINEST)).groupBy("issuer_ref", "rail", "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("succeeded")).alias("_d"))
    spread = fine.select("_n", "_d", F.inline(level_rows(F.col("issuer_ref"), F.col("rail"), F.col("_b"))))
    return spread.groupBy("lvl_no", "level", "key", "bucket").agg(F.sum("_n").alias("attempts"), F.sum("_d").alias("declines"))


def baselines(cells: DataFrame) -> DataFrame:
    """z of each cell with power against the EWMA of the earlier buckets that carry enough attempts.

    One window partition holds the buckets of one cell key, so its size is bounded by time, not by
    traffic, and cells below the baseline minimum are gone before the window.
    """
    use = cells.filter(F.col("attempts") >= dims.BASELINE_MIN).withColumn("rate", F.col("declines") / F.col("attempts"))
    longest = max(back for _, _, back in dims.LADDER)
    w = W.partitionBy("lvl_no", "level", "key").orderBy("bucket").rangeBetween(-longest, -1)
    back = dims.lookup(F.col("level"), {n: b for n, _, b in dims.LADDER})
    past = F.collect_list(F.struct(F.col("bucket").alias("b"), F.col("rate").alias("r"))).over(w)
    hist = use.withColumn("_past", past).filter(F.col("attempts") >= dims.N_MIN)
    rates = F.transform(F.filter("_past", lambda p: p["b"] >= F.col("bucket") - back), lambda p: p["r"])
    scored = hist.withColumn("_e", stats.ewma(rates, dims.EWMA_ALPHA))
    z = (F.col("rate") - F.col("_e.mu")) / F.greatest(F.sqrt("_e.var"), F.lit(dims.SIGMA_FLOOR))
    return scored.withColumn("baseline", F.col("_e.mu")).withColumn("z", z).drop("_past", "_e")


def ladder(points: DataFrame, cells: DataFrame, scored: DataFrame) -> DataFrame:
    """For each (issuer, rail, finest bucket): the first level with power, its verdict and shrunk rate."""
    keyed = points.select("issuer_ref", "rail", "b15", F.inline(level_rows(F.col("issuer_ref"), F.col("rail"), F.col("b15"))))
    cellside = scored.select("lvl_no", "key", "bucket", F.struct("lvl_no", "level", "attempts", "rate", "baseline", "z").alias("c"))
    found = keyed.join(cellside, ["lvl_no", "key", "bucket"], "left")
    finest = cells.filter(F.col("lvl_no") == 0).select(F.lit(0).alias("lvl_no"), "key", "bucket", F.col("attempts").alias("f_n"), F.col("declines").alias("f_d"))
    found = found.join(finest, ["lvl_no", "key", "bucket"], "left")
    g = found.groupBy("issuer_ref", "rail", "b15").agg(F.min_by("c", F.when(F.col("c").isNotNull(), F.col("lvl_no"))).alias("c"),
                                                     F.max("f_n").alias("f_n"), F.max("f_d").alias("f_d"))
    f_n = F.coalesce("f_n", F.lit(0))
    f_rate = F.coalesce(F.try_divide("f_d", "f_n"), F.lit(0.0))
    w = f_n / (f_n + F.lit(float(dims.SHRINK_K)))
    shrunk = (F.when(F.col("c").isNull(), 0.0).when(f_n == 0, F.col("c.rate")).when(F.col("c.lvl_no") == 0, f_rate)
              .otherwise(w * f_rate + (1 - w) * F.col("c.rate")))
    verdict = (F.when(F.col("c").isNull(), "insufficient_power")
               .when((F.col("c.z") > dims.Z_TAU) & (F.col("c.rate") > F.col("c.baseline")), "degraded").otherwise("normal"))
    return g.select("issuer_ref", "rail", "b15", verdict.alias("verdict"), F.col("c.level").alias("level"),
                    F.coalesce(F.col("c.attempts"), f_n).cast("long").alias("attempts"), F.coalesce(F.col("c.rate"), f_rate).alias("rate"),
                    F.coalesce("c.baseline", F.lit(0.0)).alias("baseline"), F.coalesce("c.z", F.lit(0.0)).alias("z"), shrunk.alias("shrunk_rate"))


def cohort_verdicts(presentations: DataFrame) -> DataFrame:
    """Verdicts for every (issuer, finest bucket) that saw a presentation, on every sweepable rail."""
    cells = cohort_cells(presentations)
    scored = baselines(cells)
    seen = presentations.select("issuer_ref", times.bucket(F.col("at_ts"), FINEST).alias("b15")).distinct()
    points = seen.select("*", F.explode(F.array(*map(F.lit, dims.SWEEP_RAILS))).alias("rail"))
    return ladder(points, cells, scored)


def with_siblings(verdicts: DataFrame) -> DataFrame:
    """Own verdict, or the first degraded sibling rail of the same issuer and bucket.

    The three rails of one (issuer, bucket) meet in one small group (three rows).
    """
    order = dims.lookup(F.col("rail"), {r: i for i, r in enumerate(dims.SWEEP_RAILS)})
    body = F.struct("rail", "verdict", "level", "attempts", "rate", "baseline", "z", "shrunk_rate")
    hit = F.when(F.col("verdict") == "degraded", order)
    g = verdicts.groupBy("issuer_ref", "b15").agg(F.min_by(body, hit).alias("sib"), F.collect_list(body).alias("rails"))
    own = g.select("issuer_ref", "b15", "sib", F.explode("rails").alias("own"))
    use_sib = (F.col("own.verdict") != "degraded") & (F.col("sib.verdict") == "degraded")
    pick = F.when(use_sib, F.col("sib")).otherwise(F.col("own"))
    flat = own.withColumn("pick", pick)
    return flat.select("issuer_ref", "b15", F.col("own.rail").alias("rail"), "pick.verdict", "pick.level", "pick.attempts", "pick.rate", "pick.baseline",
                       "pick.z", "pick.shrunk_rate", F.when(F.col("pick.verdict") == "degraded", F.col("pick.rail")).alias("detected_on"))


def downtime(claims: DataFrame, feed: DataFrame) -> DataFrame:
    """Latest end of an announced outage covering the claim's instant.

    Of the outages that have begun only the latest end matters: claims and outages stand in one order per
    issuer, and a running maximum, cut along the time, answers every claim.
    """
    rows = feed.select(F.col("issuer").alias("issuer_ref"), F.unix_micros("start_ts").alias("t"), F.lit(0).alias("k"), F.lit(None).cast(claims.schema["event_id"].dataType).alias("event_id"), "end_ts").unionByName(
        claims.select("issuer_ref", F.unix_micros("at_ts").alias("t"), F.lit(1).alias("k"), "event_id", F.lit(None).cast("timestamp").alias("end_ts"))).filter("issuer_ref is not null and t is not null")
    last = scale.running(rows, ["issuer_ref"], scale.value_bucket(rows, "t"), [F.col("t"), F.col("k")], maxes={"until": F.col("end_ts")})
    hit = last.filter((F.col("k") == 1) & (F.unix_micros("until") > F.col("t")))
    return hit.groupBy("event_id").agg(F.max("until").alias("down_until"))


def attempts_since(mandates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts and any success strictly after the reissue, per mandate.

    Whole days after the reissue come from a per-day aggregate; only the day of the reissue itself
    is compared row by row.  A mandate with very many attempts therefore joins as a row per day.
    """
    day = F.to_date("at_ts")
    daily = attempts.groupBy("mandate_ref", day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.bool_or("succeeded").alias("_s"))
    m = mandates.select("mandate_ref", "instrument_reissued_at", F.to_date("instrument_reissued_at").alias("_rd"))
    later = m.join(daily, "mandate_ref").filter(F.col("_d") > F.col("_rd")).select("mandate_ref", "instrument_reissued_at", "_n", "_s")
    same = m.join(attempts.withColumn("_rd", day), ["mandate_ref", "_rd"]).filter(F.col("at_ts") > F.col("instrument_reissued_at"))
    same = same.select("mandate_ref", "instrument_reissued_at", F.lit(1).cast("long").alias("_n"), F.col("succeeded").alias("_s"))
    return later.unionByName(same).groupBy("mandate_ref", "instrument_reissued_at").agg(F.sum("_n").alias("since_n"), F.bool_or("_s").alias("since_ok"))


def mandate_label() -> Column:
    """First mandate fault in the fixed order; NULL when healthy."""
    orphan = ((F.col("instrument_reissued_at") > F.col("registered_at")) & (F.col("since_n") >= 2) & ~F.col("since_ok"))
    notice = F.col("predebit_required") & (F.col("predebit_notice_at").isNull()
                                           | (times.seconds_between(F.col("at_ts"), F.col("predebit_notice_at")) < 86400))
    return (F.when(F.col("cap_paise").isNotNull() & (F.col("amount_paise") > F.col("cap_paise")), "mandate_cap_exceeded")
            .when(F.col("expires_at") <= F.col("at_ts"), "mandate_expired").when(orphan, "mandate_orphaned")
            .when(notice, "predebit_notice_missing")
            .when(F.col("scheduled_debit_day").isNotNull() & (F.dayofmonth("at_ts") != F.col("scheduled_debit_day")), "wrong_debit_date"))


def with_code_meaning(claims: DataFrame, codes: DataFrame) -> DataFrame:
    """Meaning of the decline code; a stop advice overrides it; unmapped is unknown at confidence zero.

    The code table has a fixed size (its rows are listed in the vocabulary), so it is broadcast.
    """
    j = claims.join(F.broadcast(codes.select("rail", F.col("code").alias("decline_code"), F.struct("label", "layer", "confidence").alias("_m"))),
                    ["rail", "decline_code"], "left")
    stop = F.col("advice_code").isin(*dims.STOP_ADVICE)
    none = F.struct(F.lit("unknown").alias("label"), F.lit("unknown").alias("layer"), F.lit(0.0).alias("confidence"))
    s = dims.STOP_MEANING
    stop_m = F.struct(F.lit(s[0]).alias("label"), F.lit(s[1]).alias("layer"), F.lit(s[2]).alias("confidence"))
    return j.withColumn("code", F.when(F.coalesce(stop, F.lit(False)), stop_m).otherwise(F.coalesce("_m", none))).drop("_m")


def with_type_fallback(df: DataFrame) -> DataFrame:
    """Where there is no code at all, the claim type may carry a meaning."""
    fb = F.lit(None)
    for ctype, label, layer, conf in dims.CLAIM_TYPE_MEANINGS:
        m = F.struct(F.lit(label).alias("label"), F.lit(layer).alias("layer"), F.lit(conf).alias("confidence"))
        fb = F.when(F.col("claim_type") == ctype, m).otherwise(fb)
    use = (F.col("code.confidence") == 0) & F.col("decline_code").isNull()
    return df.withColumn("code", F.when(use, F.coalesce(fb, F.col("code"))).otherwise(F.col("code")))


def decline_category(label: Column, has_code: Column) -> Column:
    return (F.when(~has_code, "none").when(label == "hard_decline", "lost_or_stolen").when(label == "do_not_retry", "stop_payment")
            .otherwise("soft"))


def diagnose(df: DataFrame, free_text: Column | None = None) -> DataFrame:
    """Cohort, mandate, code, free text: the first confident finding that the domain accepts.

    Expects columns ``verdict`` (cohort), ``mandate_label``, ``code`` and the claim's own.  ``free_text``
    is a provider expression: struct<label, layer, confidence> or NULL.
    """
    power = F.col("verdict") == "insufficient_power"

    def finding(path: str, label: Column, layer: Column, conf: Column) -> Column:
        capped = power & (layer == "customer") & (conf > dims.NO_POWER_CAP)
        c = F.when(capped, F.lit(dims.NO_POWER_CAP)).otherwise(conf)
        return F.struct(label.alias("label"), layer.alias("layer"), c.alias("confidence"), F.lit(path).alias("derived_from"), capped.alias("capped"))

    cohort = F.when(F.col("verdict") == "degraded", finding("cohort", F.lit("issuer_outage"), F.lit("issuer"), F.lit(0.93)))
    mandate = F.when(F.col("mandate_label").isNotNull(), finding("mandate", F.col("mandate_label"), F.lit("merchant"),
                                                                 dims.lookup(F.col("mandate_label"), dims.MANDATE_CONFIDENCE)))
    code = F.when(F.col("code.confidence") > 0, finding("code_map", F.col("code.label"), F.col("code.layer"), F.col("code.confidence")))
    out = df
    if free_text is None:
        text = F.lit(None)
        rejected = F.lit(False)
    else:
        out = out.withColumn("_ft", F.when(free_text["confidence"] > 0, free_text))
        raw = F.when(F.col("_ft").isNotNull(), finding("llm", F.col("_ft.label"), F.col("_ft.layer"), F.col("_ft.confidence")))
        text = F.when(raw["confidence"] <= dims.FREE_TEXT_CAP, raw)
        rejected = F.coalesce(raw["confidence"] > dims.FREE_TEXT_CAP, F.lit(False))
    unresolved = F.struct(F.lit("unknown").alias("label"), F.lit("unknown").alias("layer"), F.lit(0.0).alias("confidence"),
                          F.lit("code_map").alias("derived_from"), F.lit(False).alias("capped"))
    earlier = F.coalesce(cohort, mandate, code)
    out = out.withColumn("cause", F.coalesce(cohort, mandate, code, text, unresolved)).withColumn("rejected", rejected & earlier.isNull())
    return route(out.drop("_ft") if free_text is not None else out)


def route(df: DataFrame) -> DataFrame:
    layer = F.col("cause.layer")
    return (df.withColumn("next_state", dims.lookup(layer, dims.LAYER_ROUTE)).withColumn("contact_permitted", ~layer.isin("issuer", "merchant"))
            .withColumn("review_required", F.col("cause.label") == "unknown"))
