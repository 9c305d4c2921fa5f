"""Measurement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import money, stats
from dunlin.operators import measurement as M
from dunlin.operators import scale
from dunlin.plans import q_allocation as QA
from dunlin.plans.q_ingest import _STRATA, armed
from dunlin.plans.registry import query
from dunlin.plans.sqlbridge import CTES
from dunlin.session import staged, table
from dunlin.sources import bridge as B

_SH = " union all ".join(f"select '{a}' as action, cast({p} as double) as mass" for a, p in B.SHARES.items())
_BR = f"""br as (select d.row_no, d.subject_token, d.stratum, d.cust, d.k, s.action, s.mass, not (s.action = 'email' and k % 5 = 0) as admissible,
      case when s.action = 'sms' and cust % 4 = 0 then 2 when s.action = 'voice_call' and k % 3 = 0 then 1 else 0 end as rank from decisions d, ({_SH}) s),
    res as (select *, case when action <> 'do_nothing' and (not admissible or rank > 0) then 'do_nothing' else action end as resolved_to,
      action <> 'do_nothing' and (not admissible or rank > 0) as vetoed, case when action <> 'do_nothing' and not admissible then 'ALLOC-ADMISSION' when action <> 'do_nothing' and rank > 0 then case when rank = 2 then 'ABS-CONSENT' else 'TIME-WINDOW' end else '' end as why from br),
    ex as (select row_no, resolved_to as action, sum(mass) as p from res group by 1, 2),
    logs as (select d.row_no, d.subject_token, d.stratum, d.cust, d.k, d.cycle, d.at_ts, d.action as intended, r.resolved_to as action, r.mass as pi_intended, e.p as pi_realized, r.vetoed, r.why, d.reward_paise, d.adverse, d.opted_out, d.complained, d.promised, d.paid
      from decisions d join res r on r.row_no = d.row_no and r.action = d.action join ex e on e.row_no = d.row_no and e.action = r.resolved_to)"""


def branches(spark, d) -> DataFrame:
    """Allocator branches of every logged row (long form), with the planted refusals."""
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(p).alias("mass")) for a, p in B.SHARES.items()])
    b = B.decisions(spark, d).select("row_no", "subject_token", "stratum", "cust", "k", F.inline(rows))
    sms, call = (F.col("action") == "sms") & (F.col("cust") % 4 == 0), (F.col("action") == "voice_call") & (F.col("k") % 3 == 0)
    return b.withColumn("admissible", ~((F.col("action") == "email") & (F.col("k") % 5 == 0))).withColumn("rank", F.when(sms, 2).when(call, 1).otherwise(0)).withColumn(
        "blocking", F.when(sms, "ABS-CONSENT").when(call, "TIME-WINDOW").otherwise(""))


def resolved(spark, d) -> DataFrame:
    return staged(spark, d, "resolved", lambda: M.compose(branches(spark, d)))


def pi_exec(spark, d) -> DataFrame:
    return staged(spark, d, "pi_exec", lambda: M.executed(resolved(spark, d)))


def logs(spark, d) -> DataFrame:
    """Decision joined with its outcome and its executed propensity."""
    def build():
        dec = B.decisions(spark, d)
        r = resolved(spark, d).select("row_no", "action", "resolved_to", F.col("mass").alias("pi_intended"), "vetoed", "why")
        j = dec.join(r, ["row_no", "action"]).withColumnRenamed("action", "intended").withColumnRenamed("resolved_to", "action")
        return j.join(pi_exec(spark, d).withColumnRenamed("p", "pi_realized"), ["row_no", "action"])
    return staged(spark, d, "logs", build)


@query("m13_composed_policy", f"with {_BR} select row_no, action, round(p, 9) as p from ex")
def m13(spark, d):
    return pi_exec(spark, d).select("row_no", "action", F.round("p", 9).alias("p"))


@query("f16_mass_conserved", f"with {_BR}, t as (select row_no, sum(p) as s from ex group by 1) select count(*) as n, count(*) filter (where abs(s - 1) > 1e-9) as violations from t")
def f16(spark, d):
    t = pi_exec(spark, d).groupBy("row_no").agg(F.sum("p").alias("s"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("s") - 1) > 1e-9).alias("violations"))


@query("u02_unresolved_branches", "select 5 * count(*) as branches, 0 as missing from decisions")
def u02(spark, d):
    want = branches(spark, d).select("row_no", "action")
    have = resolved(spark, d).select("row_no", "action")
    miss = want.exceptAll(have).agg(F.count(F.lit(1)).cast("int").alias("missing"), F.lit(0).cast("long").alias("branches"))
    n = want.agg(F.lit(0).alias("missing"), F.count(F.lit(1)).alias("branches"))
    return miss.unionByName(n).agg(F.sum("branches").alias("branches"), F.sum("missing").cast("int").alias("missing"))


@query("a29_veto_diagnostics", f"with {_BR} select count(*) as branches, count(*) filter (where vetoed) as vetoed_branches, round(avg(case when vetoed then 1.0 else 0.0 end), 9) as veto_rate, round(sum(case when vetoed then mass else 0 end) / count(distinct row_no), 9) as mean_veto_mass from res")
def a29(spark, d):
    r = resolved(spark, d)
    n = r.agg(F.count(F.lit(1)).alias("branches"), F.count_if("vetoed").alias("vetoed_branches"), F.round(F.avg(F.col("vetoed").cast("double")), 9).alias("veto_rate"),
              F.sum(F.when(F.col("vetoed"), F.col("mass")).otherwise(0.0)).alias("m"), F.count_if(F.col("action") == "do_nothing").alias("rows"))
    return n.select("branches", "vetoed_branches", "veto_rate", F.round(F.col("m") / F.col("rows"), 9).alias("mean_veto_mass"))


@query("j12_decision_outcome", f"with {_BR} select row_no, action, round(pi_realized, 9) as pi_realized, vetoed, why, reward_paise from logs")
def j12(spark, d):
    return logs(spark, d).select("row_no", "action", F.round("pi_realized", 9).alias("pi_realized"), "vetoed", "why", "reward_paise")


_Q = """gm as (select avg(reward_paise) as g from logs), act as (select action, avg(reward_paise) as parent from logs group by 1),
    cell as (select stratum, action, count(*) as n, count(*) / (count(*) + 25.0) * avg(reward_paise) + (1 - count(*) / (count(*) + 25.0)) * any_value(parent) as q from logs join act using (action) group by 1, 2)"""


def cells(spark, d) -> DataFrame:
    return staged(spark, d, "cells", lambda: M.outcome_cells(logs(spark, d)))


@query("a26_outcome_cells", f"with {_BR}, {_Q} select stratum, action, n, round(q, 4) as q from cell")
def a26(spark, d):
    return cells(spark, d).select("stratum", "action", "n", F.round("q", 4).alias("q"))


@query("j13_hierarchical_fallback", f"with {_BR}, {_Q} select row_no, a.action, round(coalesce(c.q, act.parent, g), 4) as q from logs l, (select action from action_dim) a, gm left join cell c on c.stratum = l.stratum and c.action = a.action left join act on act.action = a.action".replace("from logs l, (select action from action_dim) a, gm left", "from logs l cross join (select action from action_dim) a cross join gm left"))
def j13(spark, d):
    rows = logs(spark, d).select("row_no", "stratum", F.explode(F.array(*map(F.lit, dims.ACTION_NAMES))).alias("action"))
    return M.predict(rows, cells(spark, d), M.grand_mean(logs(spark, d))).select("row_no", "action", F.round("q", 4).alias("q"))


_DR = f"""{_BR}, {_Q}, til as (select row_no, action, pow(p, 2) / sum(pow(p, 2)) over (partition by row_no) as p from ex),
    tgt as (select 'on_policy' as target, row_no, action, p from ex union all select 'null', row_no, 'do_nothing', 1.0 from logs union all select 'tilted', row_no, action, p from til),
    dirv as (select t.target, t.row_no, sum(t.p * coalesce(c.q, act.parent, g)) as direct from tgt t join logs l using (row_no) cross join gm left join cell c on c.stratum = l.stratum and c.action = t.action left join act on act.action = t.action group by 1, 2),
    val as (select d.target, l.row_no, l.subject_token, l.reward_paise, least(coalesce(t.p, 0) / l.pi_realized, 20) as w, coalesce(t.p, 0) / l.pi_realized > 20 as clipped,
        d.direct + least(coalesce(t.p, 0) / l.pi_realized, 20) * (l.reward_paise - coalesce(c.q, act.parent, g)) as value
      from logs l join dirv d using (row_no) cross join gm left join tgt t on t.target = d.target and t.row_no = l.row_no and t.action = l.action left join cell c on c.stratum = l.stratum and c.action = l.action left join act on act.action = l.action)"""


def targets(spark, d) -> dict[str, DataFrame]:
    ex, lg = pi_exec(spark, d), logs(spark, d)
    return {"on_policy": ex, "null": M.null_target(lg), "tilted": M.tilt(ex, 2.0)}


def values(spark, d, name: str) -> DataFrame:
    return staged(spark, d, f"dr_{name}", lambda: M.row_values(logs(spark, d), targets(spark, d)[name], cells(spark, d), M.grand_mean(logs(spark, d))))


def _all_targets(spark, d, fn) -> DataFrame:
    out = None
    for t in ["on_policy", "null", "tilted"]:
        x = fn(values(spark, d, t)).withColumn("target", F.lit(t))
        out = x if out is None else out.unionByName(x)
    return out


@query("m14_doubly_robust", f"with {_DR} select target, count(*) as n_rows, round(avg(value), 4) as point from val group by 1")
def m14(spark, d):
    return _all_targets(spark, d, M.estimate).select("target", "n_rows", F.round("point", 4).alias("point"))


@query("a33_clip_and_ess", f"with {_DR} select target, round(avg(case when clipped then 1.0 else 0.0 end), 9) as clipped_share, round(coalesce(sum(w) * sum(w) / nullif(sum(w * w), 0), 0), 4) as ess from val group by 1")
def a33(spark, d):
    return _all_targets(spark, d, M.estimate).select("target", F.round("clipped_share", 9).alias("clipped_share"), F.round("effective_sample_size", 4).alias("ess"))


@query("m16_ips_and_truth", f"""with {_DR}, tr as (select t.target, t.row_no, sum(t.p * (1000 + 10 * l.k * case t.action when 'do_nothing' then 0 when 'sms' then 1 when 'email' then 2 when 'retry' then 3 else 4 end)) as truth from tgt t join logs l using (row_no) group by 1, 2),
      a as (select target, avg(w * reward_paise) as ips from val group by 1), b as (select target, avg(truth) as truth from tr group by 1) select target, round(ips, 4) as ips, round(truth, 4) as truth from a join b using (target)""")
def m16(spark, d):
    ips = _all_targets(spark, d, M.estimate).select("target", "ips")
    lg = logs(spark, d).select("row_no", "k")
    worth = dims.lookup(F.col("action"), {"do_nothing": 0, "sms": 1, "email": 2, "retry": 3}, 4)
    out = None
    for name, t in targets(spark, d).items():
        x = t.join(lg, "row_no").groupBy("row_no").agg(F.sum(F.col("p") * (1000 + 10 * F.col("k") * worth)).alias("tr")).agg(F.avg("tr").alias("truth")).withColumn("target", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return ips.join(out, "target").select("target", F.round("ips", 4).alias("ips"), F.round("truth", 4).alias("truth"))


def _pois_sql(e: str) -> str:
    p, cum, cuts = 0.36787944117144233, 0.0, []
    for k in range(1, 9):
        cum += p
        cuts.append(int(round(cum * 65536)))
        p /= k
    return " + ".join(f"case when {e} >= {c} then 1 else 0 end" for c in cuts)


_BOOT = f"""{_DR}, per as (select subject_token, sum(value) as s, count(*) as c from val where target = 'tilted' group by 1),
    hb as (select s, c, blk, sha256('boot' || chr(31) || subject_token || chr(31) || blk) as h from per, range(0, 25) r(blk)),
    dr as (select blk * 16 + j as draw, s, c, cast('0x' || substr(h, cast(1 + 4 * j as bigint), 4) as bigint) as u from hb, range(0, 16) q(j)),
    wd as (select draw, s, c, {_pois_sql('u')} as w from dr),
    dm as (select draw, coalesce(sum(w * s) / nullif(sum(w * c), 0), 0) as mean from wd group by 1)"""


@query("m15_cluster_bootstrap", f"with {_BOOT} select round(quantile_cont(mean, 0.025), 3) as lo, round(quantile_cont(mean, 0.975), 3) as hi, count(*) as draws from dm")
def m15(spark, d):
    dr = M.bootstrap(values(spark, d, "tilted"))
    return dr.agg(F.round(F.expr("percentile(mean, 0.025)"), 3).alias("lo"), F.round(F.expr("percentile(mean, 0.975)"), 3).alias("hi"), F.count(F.lit(1)).alias("draws"))


@query("m20_recovered_interval", f"with {_BOOT}, n as (select count(*) as n from logs) select cast(floor(quantile_cont(mean, 0.025) * any_value(n)) as bigint) as lo_paise, cast(floor(quantile_cont(mean, 0.975) * any_value(n)) as bigint) as hi_paise from dm, n")
def m20(spark, d):
    iv = M.interval(M.bootstrap(values(spark, d, "tilted")))
    n = logs(spark, d).count()
    return iv.select(F.floor(F.col("lo") * n).cast("long").alias("lo_paise"), F.floor(F.col("hi") * n).cast("long").alias("hi_paise"))


# ---- arms and scoreboard -----------------------------------------------------------------------------
CTES["arm_rows"] = f"""select *, ['null', 'naive_dunning', 'gateway_default', 'greedy_unconstrained', 'priced'][cust % 5 + 1] as arm, action in ('sms', 'voice_call', 'email') as contact, k % 9 <> 0 as right_party,
      case action when 'sms' then 18 when 'voice_call' then 210 when 'email' then 4 when 'retry' then 30 else 0 end as cost_paise, adverse as cancelled, k % 4 = 0 as kept, k % 31 = 0 as disputed from decisions"""


def arm_rows(spark, d) -> DataFrame:
    r = B.decisions(spark, d)
    return r.select("*", F.get(F.array(*map(F.lit, dims.ARMS)), (F.col("cust") % 5).cast("int")).alias("arm"), F.col("action").isin("sms", "voice_call", "email").alias("contact"),
                    (F.col("k") % 9 != 0).alias("right_party"), dims.lookup(F.col("action"), {"sms": 18, "voice_call": 210, "email": 4, "retry": 30}, 0).cast("long").alias("cost_paise"),
                    F.col("adverse").alias("cancelled"), (F.col("k") % 4 == 0).alias("kept"), (F.col("k") % 31 == 0).alias("disputed"))


_TOT = """tot as (select arm, count(*) filter (where contact) as contacts, count(*) filter (where contact and right_party) as right_party_contacts, cast(sum(cost_paise) as bigint) as spend_paise, cast(sum(reward_paise) as bigint) as recovered_paise,
      count(*) filter (where complained) as complaints, count(*) filter (where opted_out) as opt_outs, count(*) filter (where cancelled) as cancellations, count(*) filter (where promised) as promises_made, count(*) filter (where promised and kept) as promises_kept,
      count(*) filter (where disputed) as disputes, count(distinct subject_token) as subjects, count(distinct case when contact then subject_token end) as treated_subjects from arm_rows group by 1)"""


@query("a22_arm_totals", f"with {_TOT} select * from tot")
def a22(spark, d):
    return M.arm_totals(arm_rows(spark, d))


def _r(n: str, dn: str, scale: float = 1.0) -> str:
    return f"case when {dn} > 0 then {scale} * {n} / cast({dn} as double) else 0.0 end"


_GUARD = f"""guard as (select t.*, {_r('complaints', 'contacts', 1000.0)} as complaint_rate_per_1000, {_r('opt_outs', 'contacts', 1000.0)} as opt_out_rate_per_1000, {_r('cancellations', 'treated_subjects')} as voluntary_cancel_rate_treated,
      {_r('(select cancellations from tot where arm = $$null$$)', '(select subjects from tot where arm = $$null$$)')} as voluntary_cancel_rate_control, {_r('spend_paise', 'recovered_paise')} as cost_per_rupee_collected, {_r('promises_made', 'contacts')} as promise_made_rate,
      {_r('promises_kept', 'promises_made')} as promise_kept_rate, {_r('right_party_contacts', 'contacts')} as right_party_contact_rate from tot t)""".replace("$$null$$", "'null'")
_GCOLS = ", ".join(f"round({k}, 8) as {k}" for k in dims.GUARDRAIL_KEYS)


def guard(spark, d) -> DataFrame:
    return staged(spark, d, "guardrails", lambda: M.guardrails(M.arm_totals(arm_rows(spark, d))))


@query("a23_guardrail_rates", f"with {_TOT}, {_GUARD} select arm, {_GCOLS} from guard")
def a23(spark, d):
    return guard(spark, d).select("arm", *[F.round(k, 8).alias(k) for k in dims.GUARDRAIL_KEYS])


_HEAD = """head as (select g.*, (select recovered_paise from tot where arm = 'naive_dunning') as comparator_recovered_paise, recovered_paise - (select recovered_paise from tot where arm = 'naive_dunning') as incremental_paise,
      case when spend_paise > 0 then (recovered_paise - (select recovered_paise from tot where arm = 'naive_dunning')) / cast(spend_paise as double) else 0.0 end as incremental_per_rupee_spent from guard g)"""


@query("a24_headline", f"with {_TOT}, {_GUARD}, {_HEAD} select arm, recovered_paise, comparator_recovered_paise, incremental_paise, round(incremental_per_rupee_spent, 6) as incremental_per_rupee_spent from head")
def a24(spark, d):
    return M.headline(guard(spark, d)).select("arm", "recovered_paise", "comparator_recovered_paise", "incremental_paise", F.round("incremental_per_rupee_spent", 6).alias("incremental_per_rupee_spent"))


_BREACH = ["complaint_rate_per_1000", "opt_out_rate_per_1000", "voluntary_cancel_rate_treated"]


@query("a25_guardrail_breaches", f"with {_TOT}, {_GUARD}, b as (select * from guard where arm = 'naive_dunning') select g.arm, concat_ws(',', " + ", ".join(f"case when (b.{k} <= 0 and g.{k} > 0) or (b.{k} > 0 and g.{k} > 1.5 * b.{k}) then '{k}' end" for k in _BREACH) + ") as breached from guard g, b")
def a25(spark, d):
    g = guard(spark, d)
    b = g.filter(F.col("arm") == dims.COMPARATOR).select(F.lit(1).alias("_k"), *[F.col(k).alias(f"b_{k}") for k in _BREACH])
    j = g.withColumn("_k", F.lit(1)).join(b, "_k")
    hit = [F.when(((F.col(f"b_{k}") <= 0) & (F.col(k) > 0)) | ((F.col(f"b_{k}") > 0) & (F.col(k) > 1.5 * F.col(f"b_{k}"))), F.lit(k)) for k in _BREACH]
    return j.select("arm", F.concat_ws(",", *hit).alias("breached"))


@query("t06_cheapest_arm", f"with {_TOT} select arg_min(arm, (spend_paise, arm)) as arm from tot")
def t06(spark, d):
    return M.arm_totals(arm_rows(spark, d)).agg(F.min_by("arm", F.struct("spend_paise", "arm")).alias("arm"))


@query("a14_recovery_by_cycle", "select arm, " + ", ".join(f"cast(coalesce(sum(reward_paise) filter (where cycle = {c}), 0) as bigint) as c{c}" for c in range(4)) + " from arm_rows group by 1")
def a14(spark, d):
    p = arm_rows(spark, d).groupBy("arm").pivot("cycle", [0, 1, 2, 3]).agg(F.sum("reward_paise")).na.fill(0)
    return p.select("arm", *[F.col(str(c)).alias(f"c{c}") for c in range(4)])


@query("m19_scoreboard", f"with {_TOT}, {_GUARD}, {_HEAD} select arm, subjects, recovered_paise, incremental_paise, spend_paise, contacts, {_GCOLS} from head")
def m19(spark, d):
    return M.headline(guard(spark, d)).select("arm", "subjects", "recovered_paise", "incremental_paise", "spend_paise", "contacts", *[F.round(k, 8).alias(k) for k in dims.GUARDRAIL_KEYS])


@query("s14_scoreboard_payload", f"""with {_TOT}, {_GUARD}, {_HEAD} select arm, '{{"arm":"' || arm || '","recovered_paise":' || recovered_paise || ',"incremental_paise":' || incremental_paise || ',"spend_paise":' || spend_paise || ',"guardrails":{{"contacts":' || contacts || ',"complaints":' || complaints || ',"opt_outs":' || opt_outs || '}}}}' as payload from head""")
def s14(spark, d):
    from dunlin.session import scratch_path
    h = M.headline(guard(spark, d))
    rec = F.named_struct(F.lit("arm"), F.col("arm"), F.lit("recovered_paise"), F.col("recovered_paise"), F.lit("incremental_paise"), F.col("incremental_paise"), F.lit("spend_paise"), F.col("spend_paise"),
                         F.lit("guardrails"), F.named_struct(F.lit("contacts"), F.col("contacts"), F.lit("complaints"), F.col("complaints"), F.lit("opt_outs"), F.col("opt_outs")))
    path = scratch_path(spark, "scoreboard")
    h.select("arm", F.to_json(rec).alias("payload")).write.json(path)
    return spark.read.schema("arm string, payload string").json(path)


_KV = ["recovered_paise", "incremental_paise", "spend_paise", "contacts", "complaints", "opt_outs"]


@query("s15_run_fingerprint", f"with {_TOT}, {_GUARD}, {_HEAD}, kv as (" + " union all ".join(f"select arm || '.{k}=' || {k} as t from head" for k in _KV) + ") select sha256(string_agg(t, chr(10) order by t)) as fingerprint, count(*) as figures from kv")
def s15(spark, d):
    h = M.headline(guard(spark, d))   # five arms: the report has a fixed number of figures
    kv = h.select(F.explode(F.array(*[F.concat(F.col("arm"), F.lit(f".{k}="), F.col(k).cast("string")) for k in _KV])).alias("t"))
    return kv.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("t")), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("figures"))


@query("f14_guardrails_present", f"with {_TOT}, {_GUARD}, {_HEAD} select arm, '' as problems from head")
def f14(spark, d):
    h = M.headline(guard(spark, d))
    checks = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in dims.GUARDRAIL_KEYS]
    checks += [F.when(F.col("promises_kept") > F.col("promises_made"), F.lit("kept before made")),
               F.when(F.col("incremental_paise") != F.col("recovered_paise") - F.col("comparator_recovered_paise"), F.lit("prevention merged"))]
    return h.select("arm", F.concat_ws(",", *checks).alias("problems"))


@query("m18_arm_policies", f"""with {_STRATA}, first as (select subject_token, min(claim_id) as claim_id from claims group by 1), g as (select subject_token, claim_id, action, base_uplift * {QA._FAULT} * amount_paise - rupee_paise as v, claim_no from eff where action <> 'do_nothing'),
      gr as (select * from (select *, row_number() over (partition by subject_token order by v desc, claim_no, list_position({list(dims.ACTION_NAMES)!r}, action)) as rn from g) where rn = 1), cyc as (select unnest([0, 1, 2, 3]) as cycle)
      select 'null' as arm, cycle, 'do_nothing' as action, count(*) as n from first, cyc group by 1, 2, 3
      union all select 'naive_dunning', cycle, coalesce(['sms', 'whatsapp_utility', 'voice_call'][cycle + 1], 'do_nothing'), count(*) from first, cyc group by 1, 2, 3
      union all select 'gateway_default', cycle, case when cycle = 0 then 'retry' else 'do_nothing' end, count(*) from first, cyc group by 1, 2, 3
      union all select 'greedy_unconstrained', cycle, case when v > 0 then action else 'do_nothing' end, count(*) from gr, cyc group by 1, 2, 3""")
def m18(spark, d):
    """Four of the arms as decision rules for four cycles; the priced arm is the cycle query itself."""
    first = B.claims(spark, d).groupBy("subject_token").agg(F.min("claim_id").alias("claim_id"))
    cyc = F.explode(F.array(*map(F.lit, range(4)))).alias("cycle")
    s = first.select("subject_token", cyc)
    sched = F.coalesce(F.get(F.array(*map(F.lit, dims.DUNNING_SCHEDULE)), F.col("cycle")), F.lit("do_nothing"))
    parts = [s.select(F.lit("null").alias("arm"), "cycle", F.lit("do_nothing").alias("action")), s.select(F.lit("naive_dunning").alias("arm"), "cycle", sched.alias("action")),
             s.select(F.lit("gateway_default").alias("arm"), "cycle", F.when(F.col("cycle") == 0, "retry").otherwise("do_nothing").alias("action")),
             QA.greedy(spark, d).select(F.lit("greedy_unconstrained").alias("arm"), cyc, "action")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("arm", "cycle", "action").agg(F.count(F.lit(1)).alias("n"))


@query("j20_labelled_reached", "select arm, count(distinct subject_token) as reached from arm_rows where contact and cust % 8 = 0 group by 1")
def j20(spark, d):
    r = arm_rows(spark, d)
    labelled = r.filter(F.col("cust") % 8 == 0).select("subject_token").distinct()
    return r.filter("contact").join(labelled, "subject_token", "left_semi").select("arm", "subject_token").distinct().groupBy("arm").agg(F.count(F.lit(1)).alias("reached"))


@query("u04_cohort_intersection", "select count(*) as n from (select subject_token from arm_rows where contact intersect select subject_token from arm_rows where cust % 8 = 0)")
def u04(spark, d):
    r = arm_rows(spark, d)
    return r.filter("contact").select("subject_token").intersect(r.filter(F.col("cust") % 8 == 0).select("subject_token")).agg(F.count(F.lit(1)).alias("n"))


@query("a41_diagnostics", f"with {_BR} select cycle, round(avg(case when k % 5 = 0 then 1.0 else 0.0 end), 8) as degraded_share, round(avg(case when vetoed then 1.0 else 0.0 end), 8) as veto_rate, round(avg(1 - pi_realized), 8) as explore_share from logs group by 1")
def a41(spark, d):
    return logs(spark, d).groupBy("cycle").agg(F.round(F.avg((F.col("k") % 5 == 0).cast("double")), 8).alias("degraded_share"), F.round(F.avg(F.col("vetoed").cast("double")), 8).alias("veto_rate"),
                                               F.round(F.avg(1 - F.col("pi_realized")), 8).alias("explore_share"))


@query("a12_funnel", f"with {_BR} select count(*) as proposed, count(*) filter (where why = 'ABS-CONSENT') as blocked, count(*) filter (where why in ('TIME-WINDOW', 'ALLOC-ADMISSION')) as deferred, count(*) filter (where why = '' and action = 'do_nothing') as declined, count(*) filter (where why = '' and action <> 'do_nothing') as executed from logs")
def a12(spark, d):
    w, dn = F.col("why"), F.col("action") == "do_nothing"
    return logs(spark, d).agg(F.count(F.lit(1)).alias("proposed"), F.count_if(w == "ABS-CONSENT").alias("blocked"), F.count_if(w.isin("TIME-WINDOW", "ALLOC-ADMISSION")).alias("deferred"),
                              F.count_if((w == "") & dn).alias("declined"), F.count_if((w == "") & ~dn).alias("executed"))


@query("t07_latest_vetoed", f"with {_BR} select row_no, subject_token, why from logs where vetoed order by at_ts desc, row_no limit 1")
def t07(spark, d):
    return logs(spark, d).filter("vetoed").orderBy(F.desc("at_ts"), "row_no").limit(1).select("row_no", "subject_token", "why")


@query("a35_batch_view", "select count(*) as claims, count(distinct subject_token) as subjects, cast(sum(amount_paise) as bigint) as at_risk_paise from claims")
def a35(spark, d):
    c = B.claims(spark, d)
    per = c.groupBy("subject_token").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("s"))
    return per.agg(F.sum("n").alias("claims"), F.count(F.lit(1)).alias("subjects"), F.sum("s").alias("at_risk_paise"))


@query("a38_median_amount", "select rail, quantile_cont(amount_paise, 0.5) as median_paise from claims group by 1")
def a38(spark, d):
    return scale.exact_quantile(B.claims(spark, d), ["rail"], "amount_paise", 0.5, "median_paise")


# ---- model metrics ------------------------------------------------------------------------------------
_SC = "sc as (select doc_id, round(1 - 1 / (1 + n_chars / 1000.0), 6) as score, quality as label, toxic as toxic from labels join documents using (doc_id))"


def scores(spark, d) -> DataFrame:
    def build():
        x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
        return x.select("doc_id", F.round(1 - 1 / (1 + F.col("n_chars") / 1000.0), 6).alias("score"), F.col("quality").alias("label"), "toxic")
    return staged(spark, d, "scores", build)


@query("a27_reliability", f"with {_SC}, b as (select least(cast(floor(score * 10) as int), 9) as bin, count(*) as n, avg(score) as p, avg(label) as o from sc group by 1) select cast(r.bin as int) as bin, coalesce(n, 0) as n, round(coalesce(p, 0), 6) as predicted, round(coalesce(o, 0), 6) as observed from range(10) r(bin) left join b on b.bin = r.bin")
def a27(spark, d):
    return M.reliability(scores(spark, d)).select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


@query("a27_calibration_error", f"with {_SC}, b as (select least(cast(floor(score * 10) as int), 9) as bin, count(*) as n, abs(avg(score) - avg(label)) as gap from sc group by 1) select round(sum(n * gap) / sum(n), 6) as ece, round(max(gap), 6) as mce from b")
def a27e(spark, d):
    return M.calibration_error(M.reliability(scores(spark, d))).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("a28_brier", f"with {_SC} select round(avg((score - label) * (score - label)), 8) as brier, round(avg(label), 8) as prevalence from sc")
def a28(spark, d):
    e = F.col("score") - F.col("label")
    return scores(spark, d).agg(F.round(F.avg(e * e), 8).alias("brier"), F.round(F.avg("label"), 8).alias("prevalence"))


@query("w14_average_precision", f"with {_SC}, r as (select *, row_number() over (order by score desc, doc_id) as place, sum(label) over (order by score desc, doc_id rows unbounded preceding) as tp from sc) select round(sum(tp / cast(place as double)) filter (where label = 1) / sum(label), 8) as average_precision, cast(sum(label) as bigint) as positives from r")
def w14(spark, d):
    return M.average_precision(scores(spark, d), "doc_id").select(F.round("average_precision", 8).alias("average_precision"), "positives")


@query("w13_decile_uplift", f"with {_SC}, r as (select score, toxic, ntile(10) over (order by score, doc_id) as decile from sc) select cast(decile as int) as decile, count(*) as n, round(avg(score), 6) as predicted, round(avg(toxic), 6) as observed from r group by 1")
def w13(spark, d):
    x = M.decile_uplift(scores(spark, d).withColumn("truth", F.col("toxic")), "doc_id")
    return x.select("decile", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


_QN = f"""{_SC}, o as (select doc_id, score, label as outcome, doc_id % 2 as treated from sc), r as (select *, count(*) over () as n, row_number() over w as place, sum(outcome * treated) over w as tr, sum(outcome * (1 - treated)) over w as cr, sum(treated) over w as tc, sum(1 - treated) over w as cc
      from o window w as (order by score desc, doc_id rows unbounded preceding)), q as (select cast(j as int) as j, n, tr - cr * case when cc > 0 then tc / cast(cc as double) else 0 end as gain from r, range(1, 21) s(j) where place = greatest(j * n // 20, 1))"""


def qini_curve(spark, d) -> DataFrame:
    return M.qini(scores(spark, d).select("doc_id", "score", F.col("label").cast("long").alias("outcome"), (F.col("doc_id") % 2).alias("treated")), "doc_id")


@query("w16_qini_curve", f"with {_QN} select j, round(gain, 6) as gain from q")
def w16(spark, d):
    return qini_curve(spark, d).select("j", F.round("gain", 6).alias("gain"))


@query("w16_qini_area", f"with {_QN}, g as (select arg_max(gain, j) as last, sum(case when j < 20 then gain else gain / 2 end) / 20 as a, max(n) as n from q) select round(a - last / 2, 6) as area, round(last, 6) as overall_gain, round((a - last / 2) / n * 1000, 6) as coefficient from g")
def w16a(spark, d):
    return M.qini_area(qini_curve(spark, d)).select(F.round("area", 6).alias("area"), F.round("overall_gain", 6).alias("overall_gain"), F.round("coefficient", 6).alias("coefficient"))


@query("m28_claim_narrative", f"""with {_STRATA}, mx as (select cust, sum(reward_paise) as reward, count(*) as n, arg_max(action, (at_ts, row_no)) as last_action from decisions group by 1)
      select c.claim_id, c.state, c.rail, a.computed as arm, a.stratum, coalesce(m.last_action, '') as last_action, coalesce(cast(m.reward as bigint), 0) as reward_paise, o.status from claims c join armed a using (subject_token) left join mx m on m.cust = c.cust join outbox o on o.claim_id = c.claim_id""")
def m28(spark, d):
    """One wide row per claim: state, arm, last decision and outcome, queue status."""
    m = B.decisions(spark, d).groupBy("cust").agg(F.sum("reward_paise").alias("reward_paise"), F.max_by("action", F.struct("at_ts", "row_no")).alias("last_action"))
    j = B.claims(spark, d).join(armed(spark, d).select("subject_token", "arm", "stratum"), "subject_token").join(m, "cust", "left").join(B.outbox(spark, d).select("claim_id", "status"), "claim_id")
    return j.select("claim_id", "state", "rail", "arm", "stratum", F.coalesce("last_action", F.lit("")).alias("last_action"), F.coalesce("reward_paise", F.lit(0)).alias("reward_paise"), "status")
