"""Diagnosis queries: cohort ladder, mandate health, code map, ordered diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import stats, times
from dunlin.operators import diagnosis as X
from dunlin.plans.registry import query
from dunlin.session import staged
from dunlin.sources import bridge as B

_KEY = "case level when 'issuer_day' then issuer_ref when 'instrument_network_15m' then rail else issuer_ref || '|' || rail end"
_CELLS = f"""cells as (select lvl_no, level, secs, lookback, {_KEY} as key, cast(floor(epoch_us(at_ts) / 1000000 / secs) as bigint) as bucket,
      count(*) as attempts, count(*) filter (where not succeeded) as declines from presentations, ladder group by all)"""
_SCORED = f"""{_CELLS},
    elig as (select * from cells where attempts >= 12),
    series as (select e.lvl_no, e.key, e.bucket, c.declines / cast(c.attempts as double) as r, row_number() over (partition by e.lvl_no, e.key, e.bucket order by c.bucket) as rn
      from elig e join cells c on c.lvl_no = e.lvl_no and c.key = e.key and c.bucket >= e.bucket - e.lookback and c.bucket < e.bucket and c.attempts >= 3),
    ew as (select lvl_no, key, bucket, rn, r as mu, cast(0 as double) as v from series where rn = 1
      union all select s.lvl_no, s.key, s.bucket, s.rn, 0.25 * s.r + 0.75 * e.mu, 0.25 * (s.r - e.mu) * (s.r - e.mu) + 0.75 * e.v
      from ew e join series s on s.lvl_no = e.lvl_no and s.key = e.key and s.bucket = e.bucket and s.rn = e.rn + 1),
    lastew as (select lvl_no, key, bucket, arg_max(mu, rn) as mu, arg_max(v, rn) as v from ew group by all),
    scored as (select e.lvl_no, e.level, e.key, e.bucket, e.attempts, e.declines / cast(e.attempts as double) as rate, coalesce(l.mu, 0.0) as baseline,
      (e.declines / cast(e.attempts as double) - coalesce(l.mu, 0.0)) / greatest(sqrt(coalesce(l.v, 0.0)), 0.02) as z from elig e left join lastew l using (lvl_no, key, bucket))"""
_POINTS = """points as (select distinct issuer_ref, cast(floor(epoch_us(at_ts) / 1000000 / 900) as bigint) as b15 from presentations),
    grid as (select issuer_ref, b15, r.rail, r.ro from points, (values ('card', 0), ('enach', 1), ('upi_autopay', 2)) r(rail, ro)),
    keyed as (select g.*, l.lvl_no, l.secs, case l.level when 'issuer_day' then issuer_ref when 'instrument_network_15m' then rail else issuer_ref || '|' || rail end as key,
      b15 * 900 // l.secs as bucket from grid g, ladder l)"""
_VERDICTS = f"""{_SCORED}, {_POINTS},
    hits as (select k.issuer_ref, k.b15, k.rail, k.ro, s.*, row_number() over (partition by k.issuer_ref, k.b15, k.rail order by s.lvl_no) as pick
      from keyed k join scored s on s.lvl_no = k.lvl_no and s.key = k.key and s.bucket = k.bucket),
    fine as (select k.issuer_ref, k.b15, k.rail, c.attempts as f_n, c.declines / cast(c.attempts as double) as f_rate from keyed k join cells c on k.lvl_no = 0 and c.lvl_no = 0 and c.key = k.key and c.bucket = k.bucket),
    verdicts as (select g.issuer_ref, g.b15, g.rail, g.ro, case when h.lvl_no is null then 'insufficient_power' when h.z > 3.0 and h.rate > h.baseline then 'degraded' else 'normal' end as verdict,
      h.level, coalesce(h.attempts, f.f_n, 0) as attempts, coalesce(h.rate, f.f_rate, 0.0) as rate, coalesce(h.baseline, 0.0) as baseline, coalesce(h.z, 0.0) as z,
      case when h.lvl_no is null then 0.0 when coalesce(f_n, 0) = 0 then h.rate when h.lvl_no = 0 then f_rate
        else f_n / (f_n + 20.0) * f_rate + (1 - f_n / (f_n + 20.0)) * h.rate end as shrunk_rate
      from grid g left join hits h on h.issuer_ref = g.issuer_ref and h.b15 = g.b15 and h.rail = g.rail and h.pick = 1
      left join fine f on f.issuer_ref = g.issuer_ref and f.b15 = g.b15 and f.rail = g.rail)"""
_FINAL = f"""{_VERDICTS},
    sib as (select issuer_ref, b15, min(ro) as sro from verdicts where verdict = 'degraded' group by 1, 2),
    final as (select v.issuer_ref, v.b15, v.rail, p.verdict, p.level, p.attempts, p.rate, p.baseline, p.z, p.shrunk_rate, case when p.verdict = 'degraded' then p.rail end as detected_on
      from verdicts v left join sib s on v.verdict <> 'degraded' and s.issuer_ref = v.issuer_ref and s.b15 = v.b15
      join verdicts p on p.issuer_ref = v.issuer_ref and p.b15 = v.b15 and p.ro = coalesce(s.sro, v.ro))"""


def verdicts(spark, d) -> DataFrame:
    return X.cohort_verdicts(B.presentations(spark, d))


@query("a01_cohort_cells", f"with {_CELLS} select level, key, bucket, attempts, declines from cells")
def a01(spark, d):
    return X.cohort_cells(B.presentations(spark, d)).select("level", "key", "bucket", "attempts", "declines")


@query("w04_ewma_baseline", f"with recursive {_SCORED} select level, key, bucket, round(baseline, 6) as baseline from scored")
def w04(spark, d):
    return X.baselines(X.cohort_cells(B.presentations(spark, d))).select("level", "key", "bucket", F.round("baseline", 6).alias("baseline"))


@query("w05_z_score", f"with recursive {_SCORED} select level, key, bucket, attempts, round(rate, 6) as rate, round(z, 5) as z from scored")
def w05(spark, d):
    return X.baselines(X.cohort_cells(B.presentations(spark, d))).select("level", "key", "bucket", "attempts", F.round("rate", 6).alias("rate"), F.round("z", 5).alias("z"))


_OUT = "issuer_ref, rail, b15, verdict, coalesce(level, '') as level, attempts, round(rate, 6) as rate, round(baseline, 6) as baseline, round(z, 5) as z"


def _show(v: DataFrame, *more) -> DataFrame:
    return v.select("issuer_ref", "rail", "b15", "verdict", F.coalesce("level", F.lit("")).alias("level"), "attempts", F.round("rate", 6).alias("rate"),
                    F.round("baseline", 6).alias("baseline"), F.round("z", 5).alias("z"), *more)


@query("w06_ladder", f"with recursive {_VERDICTS} select {_OUT} from verdicts")
def w06(spark, d):
    return _show(verdicts(spark, d))


@query("a02_shrunk_rate", f"with recursive {_VERDICTS} select issuer_ref, rail, b15, round(shrunk_rate, 6) as shrunk_rate from verdicts where verdict <> 'insufficient_power'")
def a02(spark, d):
    return verdicts(spark, d).filter(F.col("verdict") != "insufficient_power").select("issuer_ref", "rail", "b15", F.round("shrunk_rate", 6).alias("shrunk_rate"))


@query("j04_claim_cells", f"""with {_CELLS} select f.event_id, c.level, c.attempts, c.declines from failures f join cells c
      on c.key = case c.level when 'issuer_day' then issuer_ref when 'instrument_network_15m' then rail else issuer_ref || '|' || rail end
      and c.bucket = cast(floor(epoch_us(f.at_ts) / 1000000 / c.secs) as bigint)""")
def j04(spark, d):
    cells = X.cohort_cells(B.presentations(spark, d))
    f = B.failures(spark, d).select("event_id", F.inline(X.level_rows(F.col("issuer_ref"), F.col("rail"), times.bucket(F.col("at_ts"), X.FINEST))))
    return f.join(cells.drop("level"), ["lvl_no", "key", "bucket"]).select("event_id", "level", "attempts", "declines")


@query("j06_sibling_rails", f"with recursive {_FINAL} select {_OUT}, coalesce(detected_on, '') as detected_on from final")
def j06(spark, d):
    v = X.with_siblings(verdicts(spark, d))
    return _show(v, F.coalesce("detected_on", F.lit("")).alias("detected_on"))


_FEED = """feed as (select issuer_ref as issuer, date_trunc('hour', at_ts) as start_ts, date_trunc('hour', at_ts) + to_hours(1 + (event_id % 30)) as end_ts from presentations where k % 50 = 7)"""


def feed_of(spark, d) -> DataFrame:
    """Announced outages, one per event with a certain number."""
    p = B.presentations(spark, d).filter(F.col("k") % 50 == 7)
    start = F.date_trunc("hour", "at_ts")
    return p.select(F.col("issuer_ref").alias("issuer"), start.alias("start_ts"), times.add_seconds(start, (1 + F.col("event_id") % 30) * 3600.0).alias("end_ts"))


@query("j05_downtime_windows", f"""with {_FEED} select f.event_id, max(epoch_us(w.end_ts)) as down_until_us from failures f join feed w on w.issuer = f.issuer_ref and f.at_ts >= w.start_ts and f.at_ts < w.end_ts group by 1""")
def j05(spark, d):
    return X.downtime(B.failures(spark, d), feed_of(spark, d)).select("event_id", F.unix_micros("down_until").alias("down_until_us"))


@query("j02_code_meaning", """
    select event_id, case when advice_code in ('MAC03', 'MAC21') then 'do_not_retry' else coalesce(label, 'unknown') end as label,
      case when advice_code in ('MAC03', 'MAC21') then 'customer' else coalesce(layer, 'unknown') end as layer,
      case when advice_code in ('MAC03', 'MAC21') then 0.95::double else coalesce(confidence, 0.0) end as confidence
    from failures f left join code_dim c on c.rail = f.rail and c.code = f.decline_code""")
def j02(spark, d):
    return X.with_code_meaning(B.failures(spark, d), dims.code_dim(spark)).select("event_id", "code.label", "code.layer", "code.confidence")


@query("j03_type_fallback", """
    select claim_no, case claim_type when 'invoice_overdue' then 'invoice_awaiting_approval' else 'unknown' end as label, case claim_type when 'invoice_overdue' then 0.6::double else 0.0::double end as confidence from claims""")
def j03(spark, d):
    c = B.claims(spark, d).withColumn("decline_code", F.lit(None).cast("string")).withColumn("advice_code", F.lit(None).cast("string"))
    return X.with_type_fallback(X.with_code_meaning(c, dims.code_dim(spark))).select("claim_no", "code.label", "code.confidence")


@query("p14_decline_category", """
    select event_id, case when decline_code is null then 'none' when label = 'hard_decline' then 'lost_or_stolen' when label = 'do_not_retry' then 'stop_payment' else 'soft' end as category
    from failures f left join code_dim c on c.rail = f.rail and c.code = f.decline_code""")
def p14(spark, d):
    c = X.with_code_meaning(B.failures(spark, d).withColumn("advice_code", F.lit(None).cast("string")), dims.code_dim(spark))
    return c.select("event_id", X.decline_category(F.col("code.label"), F.col("decline_code").isNotNull()).alias("category"))


_SINCE = """mand as (select distinct mandate_ref, user_id, instrument_reissued_at from failures where instrument_reissued_at is not null),
    since as (select m.mandate_ref, count(*) as since_n, bool_or(p.succeeded) as since_ok from mand m join presentations p on p.user_id = m.user_id and p.at_ts > m.instrument_reissued_at group by 1)"""


def since(spark, d) -> DataFrame:
    f = B.failures(spark, d)
    m = f.filter(F.col("instrument_reissued_at").isNotNull()).select("mandate_ref", "instrument_reissued_at").distinct()
    att = B.presentations(spark, d).select(B.mandate_ref_of().alias("mandate_ref"), "at_ts", "succeeded")
    return X.attempts_since(m, att)


@query("j07_attempts_since_reissue", f"with {_SINCE} select mandate_ref, since_n, since_ok from since")
def j07(spark, d):
    return since(spark, d).select("mandate_ref", "since_n", "since_ok")


@query("w07_orphan_run", f"with {_SINCE} select mandate_ref, since_n >= 2 and not since_ok as orphaned from since")
def w07(spark, d):
    return since(spark, d).select("mandate_ref", ((F.col("since_n") >= 2) & ~F.col("since_ok")).alias("orphaned"))


_MHEALTH = """case when amount_paise > cap_paise then 'mandate_cap_exceeded' when expires_at <= at_ts then 'mandate_expired'
      when instrument_reissued_at > registered_at and since_n >= 2 and not since_ok then 'mandate_orphaned'
      when predebit_required and (predebit_notice_at is null or at_ts - predebit_notice_at < interval 24 hour) then 'predebit_notice_missing'
      when scheduled_debit_day is not null and day(at_ts) <> scheduled_debit_day then 'wrong_debit_date' end"""


def with_mandate(spark, d) -> DataFrame:
    f = B.failures(spark, d)
    return f.join(since(spark, d), ["mandate_ref", "instrument_reissued_at"], "left").withColumn("mandate_label", X.mandate_label())


@query("m22_mandate_health", f"with {_SINCE} select event_id, coalesce({_MHEALTH}, '') as label from failures left join since using (mandate_ref)")
def m22(spark, d):
    return with_mandate(spark, d).select("event_id", F.coalesce("mandate_label", F.lit("")).alias("label"))


def diagnosed(spark: SparkSession, d: str) -> DataFrame:
    """Every failed presentation diagnosed at its own instant."""
    def build():
        f = X.with_type_fallback(X.with_code_meaning(with_mandate(spark, d), dims.code_dim(spark)))
        v = X.with_siblings(verdicts(spark, d))
        f = f.withColumn("b15", times.bucket(F.col("at_ts"), X.FINEST)).join(v, ["issuer_ref", "rail", "b15"], "left")
        f = f.withColumn("verdict", F.coalesce("verdict", F.lit("insufficient_power")))
        ft = F.when(F.col("decline_code").isin("XX", "57"), F.struct(F.lit("insufficient_funds").alias("label"), F.lit("customer").alias("layer"),
                                                                     F.when(F.col("k") % 2 == 0, 0.65).otherwise(0.9).alias("confidence")))
        g = X.diagnose(f, ft)
        return g.withColumn("suppress_until", F.when(F.col("cause.derived_from") == "cohort", times.add_seconds(F.col("at_ts"), dims.lookup(F.col("level"), {n: float(s) for n, s, _ in dims.LADDER})))) \
            .select("event_id", "account_ref", "user_id", "issuer_ref", "rail", "at_ts", "amount_paise", "cause", "verdict", "level", "rejected", "next_state",
                    "contact_permitted", "review_required", "suppress_until", "decline_code", "k")
    return staged(spark, d, "diagnosed", build)


_DIAG = f"""{_FINAL}, {_SINCE},
    base as (select f.*, {_MHEALTH} as mandate_label, v.verdict, v.level,
        case when advice_code in ('MAC03', 'MAC21') then 'do_not_retry' else coalesce(c.label, 'unknown') end as c_label,
        case when advice_code in ('MAC03', 'MAC21') then 'customer' else coalesce(c.layer, 'unknown') end as c_layer,
        case when advice_code in ('MAC03', 'MAC21') then 0.95 else coalesce(c.confidence, 0.0) end as c_conf
      from failures f left join since using (mandate_ref) left join code_dim c on c.rail = f.rail and c.code = f.decline_code
      left join final v on v.issuer_ref = f.issuer_ref and v.rail = f.rail and v.b15 = cast(floor(epoch_us(f.at_ts) / 1000000 / 900) as bigint)),
    found as (select *, case when verdict = 'degraded' then 'cohort' when mandate_label is not null then 'mandate' when c_conf > 0 then 'code_map'
        when decline_code in ('XX', '57') and k % 2 = 0 then 'llm' else 'none' end as path,
        decline_code in ('XX', '57') and k % 2 <> 0 and not (verdict = 'degraded' or mandate_label is not null or c_conf > 0) as rejected from base),
    pre as (select *, case path when 'cohort' then 'issuer_outage' when 'mandate' then mandate_label when 'code_map' then c_label when 'llm' then 'insufficient_funds' else 'unknown' end as label,
        case path when 'cohort' then 'issuer' when 'mandate' then 'merchant' when 'code_map' then c_layer when 'llm' then 'customer' else 'unknown' end as layer,
        case path when 'cohort' then 0.93 when 'mandate' then case mandate_label when 'mandate_cap_exceeded' then 0.96 when 'mandate_expired' then 0.94 when 'mandate_orphaned' then 0.88 when 'predebit_notice_missing' then 0.9 else 0.82 end
          when 'code_map' then c_conf when 'llm' then 0.65 else 0.0 end as conf from found),
    diag as (select *, verdict = 'insufficient_power' and layer = 'customer' and conf > 0.75 as capped, case when verdict = 'insufficient_power' and layer = 'customer' and conf > 0.75 then 0.75 else conf end as confidence,
        case layer when 'issuer' then 'suppressed' when 'merchant' then 'self_healing' else 'planned' end as next_state from pre)"""


@query("m21_diagnose", f"""with recursive {_DIAG} select event_id, label, layer, round(cast(confidence as double), 4) as confidence, case path when 'none' then 'code_map' else path end as derived_from, verdict, rejected, capped from diag""")
def m21(spark, d):
    return diagnosed(spark, d).select("event_id", "cause.label", "cause.layer", F.round("cause.confidence", 4).alias("confidence"), "cause.derived_from", "verdict", "rejected", "cause.capped")


@query("p12_route", f"""with recursive {_DIAG} select event_id, next_state, layer not in ('issuer', 'merchant') as contact_permitted, label = 'unknown' as review_required,
      coalesce(case when path = 'cohort' then epoch_us(at_ts) + case level when 'issuer_day' then 86400 when 'issuer_instrument_2h' then 7200 else 900 end * cast(1000000 as bigint) end, -1) as suppress_until_us from diag""")
def p12(spark, d):
    return diagnosed(spark, d).select("event_id", "next_state", "contact_permitted", "review_required", F.coalesce(F.unix_micros("suppress_until"), F.lit(-1)).alias("suppress_until_us"))


@query("p13_power_cap", f"with recursive {_DIAG} select verdict, layer, capped, count(*) as n, round(max(cast(confidence as double)), 4) as max_confidence from diag group by 1, 2, 3")
def p13(spark, d):
    return diagnosed(spark, d).groupBy("verdict", "cause.layer", "cause.capped").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("cause.confidence"), 4).alias("max_confidence"))


@query("a09_blind_share", f"with recursive {_DIAG} select round(avg(case when verdict = 'insufficient_power' then 1.0 else 0.0 end), 6) as blind_share, count(*) as n from diag")
def a09(spark, d):
    return diagnosed(spark, d).agg(F.round(F.avg(F.when(F.col("verdict") == "insufficient_power", 1.0).otherwise(0.0)), 6).alias("blind_share"), F.count(F.lit(1)).alias("n"))


@query("a10_layer_split", f"""with recursive {_DIAG}, lay as (select unnest(['issuer', 'merchant', 'customer', 'unknown']) as layer)
      select lay.layer, count(event_id) as n, count(*) filter (where next_state = 'suppressed') as suppressed, count(*) filter (where next_state = 'self_healing') as self_healing, count(*) filter (where capped) as capped,
        count(*) filter (where verdict = 'insufficient_power') as no_power from lay left join diag using (layer) group by 1""")
def a10(spark, d):
    g = diagnosed(spark, d).groupBy(F.col("cause.layer").alias("layer")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("next_state") == "suppressed").alias("suppressed"), F.count_if(F.col("next_state") == "self_healing").alias("self_healing"),
        F.count_if("cause.capped").alias("capped"), F.count_if(F.col("verdict") == "insufficient_power").alias("no_power"))
    return dims.small(spark, [(x,) for x in ["issuer", "merchant", "customer", "unknown"]], "layer string").join(g, "layer", "left").na.fill(0)


@query("a37_issuer_decline_rate", """
    with dd as (select issuer_ref, cast(at_ts as date) as day, count(*) as n, count(*) filter (where not succeeded) as f from presentations group by 1, 2)
    select a.issuer_ref, strftime(a.day, '%Y-%m-%d') as day, coalesce(round(sum(b.f) / cast(sum(b.n) as double), 6), -1) as rate_7d from dd a left join dd b on b.issuer_ref = a.issuer_ref and b.day < a.day and b.day >= a.day - 7 group by 1, a.day""")
def a37(spark, d):
    p = B.presentations(spark, d).groupBy("issuer_ref", F.to_date("at_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("succeeded")).alias("f"))
    w = X.W.partitionBy("issuer_ref").orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    return p.select("issuer_ref", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce(F.round(stats.ratio(F.sum("f").over(w), F.sum("n").over(w)), 6), F.lit(-1.0)).alias("rate_7d"))
