"""The domain views of :mod:`dunlin.sources.bridge`, written a second time as ANSI-style SQL.

Only the correctness gate uses these; they are plain common table expressions over the given tables.
"""

from __future__ import annotations

import re

from dunlin import dims

_TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations"}
AT = "timestamp '2024-01-24 06:30:00'"


def values(rows, cols: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"cast({v!r} as double)"
        if isinstance(v, int):
            return f"cast({v} as bigint)"
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) t({cols})"


def pick(items, index: str) -> str:
    return "[" + ", ".join("'" + i + "'" for i in items) + f"][({index}) + 1]"


def token(e: str) -> str:
    return f"'sub_' || substr(sha256(cast({e} as varchar)), 1, 32)"


CTES: dict[str, str] = {
    "action_dim": values(dims.ACTIONS, ", ".join(dims.ACTION_FIELDS)),
    "code_dim": values(dims.DECLINE_CODES, "rail, code, label, layer, confidence"),
    "ladder": values([(i, *r) for i, r in enumerate(dims.LADDER)], "lvl_no, level, secs, lookback"),
    "state_edges": values(dims.STATE_EDGES, "frm, dest"),
    "money_edges": values(dims.MONEY_EDGES, "frm, dest"),
    "breaker_specs": values(dims.BREAKERS, "breaker_id, metric, comparison, threshold, self_monitoring"),
    "provider_dim": values(dims.PROVIDER_STATUS, "provider_status, outcome"),
    "presentations": """
        select event_id, ts as at_ts, user_id, 'acct_' || user_id as account_ref, 'ISS_' || (user_id % 5) as issuer_ref,
          case (user_id // 5) % 3 when 0 then 'card' when 1 then 'enach' else 'upi_autopay' end as rail,
          case (user_id // 5) % 3 when 0 then 'pgw' when 1 then 'npci_nach' else 'upi_autopay' end as source,
          event_type, cast(round(value * 100) as bigint) as amount_paise, cast(json_extract_string(props, '$.k') as int) as k,
          not (event_type = 'error' or (user_id % 5 = 2 and ts >= timestamp '2024-01-17' and ts < timestamp '2024-01-18'
               and event_type <> 'purchase')) as succeeded
        from events""",
    "failures": f"""
        select event_id, at_ts, user_id, account_ref, issuer_ref, rail, amount_paise, k,
          case when rail = 'card' then {pick(["51", "54", "41", "05", "61", "91", "57", "XX"], "k % 8")}
               when rail = 'enach' then {pick(["AM04", "AC01", "MD06", "MD01", "AG01", "MS03", "FF01"], "k % 7")}
               else {pick(["Z9", "ZM", "U69", "91", "U30"], "k % 5")} end as decline_code,
          case when k % 23 = 0 then 'MAC03' when k % 23 = 1 then 'MAC21' end as advice_code,
          case when k % 19 = 0 then 'checkout_abandon' when k % 19 = 1 then 'invoice_overdue'
               when rail = 'card' then 'card_decline' else 'mandate_failure' end as claim_type,
          'mnd_' || substr(sha256(cast(user_id as varchar)), 1, 32) as mandate_ref,
          case when k % 9 = 0 then 2000 else 100000 end as cap_paise,
          case when k % 29 = 0 then timestamp '2024-01-10' end as expires_at,
          timestamp '2023-06-01' as registered_at,
          case when user_id % 4 = 0 then timestamp '2024-01-20' end as instrument_reissued_at,
          (k % 11 = 0) as predebit_required,
          case when k % 2 = 0 then at_ts - interval 2 day end as predebit_notice_at,
          case when k % 31 = 0 then k % 28 + 1 end as scheduled_debit_day
        from presentations where not succeeded""",
    "wire": f"""
        select p.*, f.decline_code as code, f.advice_code as advice, 'evt_' || p.event_id as eid, cast(floor(epoch_us(p.at_ts) / 1000000) as bigint) as sec,
          case when p.k % 47 = 3 then 'mystery' when p.k % 19 = 1 and not p.succeeded then 'billing' else p.source end as src,
          p.k % 43 = 2 as broken, p.k % 37 = 0 as tampered, p.k % 41 = 1 as old, c.copy, p.event_id * 2 + c.copy as archive_id
        from presentations p left join failures f on p.event_id = f.event_id
        join (select 0 as copy union all select 1) c on c.copy = 0 or p.k % 10 = 0""",
    "judged": """
        select *, case when src = 'mystery' then 'unknown_source' when tampered then 'signature_invalid' when old then 'signature_stale'
            when broken then 'malformed' else 'accepted' end as pre,
          case when not succeeded and k % 19 = 0 and src = 'pgw' then 'checkout_abandoned' when src = 'billing' then 'invoice_overdue'
            when succeeded then 'debit_captured' else 'debit_failed' end as kind,
          case src when 'pgw' then 'card' when 'npci_nach' then 'enach' when 'billing' then 'invoice' else 'upi_autopay' end as wire_rail,
          to_timestamp(case when src = 'npci_nach' then sec + copy * 60 else sec end)::timestamp as event_ts
        from wire""",
    "admitted": """
        select *, case when pre = 'accepted' and archive_id > min(case when pre = 'accepted' then archive_id end) over (partition by src, eid)
            then 'duplicate' else pre end as verdict
        from judged""",
    "accepted": "select * from admitted where verdict = 'accepted'",
    "claims": f"""
        select 'clm-' || lpad(cast(o_orderkey as varchar), 12, '0') as claim_id, o_orderkey as claim_no, o_custkey as cust,
          {token('o_custkey')} as subject_token, cast(round(o_totalprice * 100) as bigint) as amount_paise,
          cast(round(o_totalprice * 100) as bigint) * 12 as ltv_remaining_paise,
          {pick(["card", "enach", "upi_autopay", "invoice"], "o_orderkey % 4")} as rail,
          case o_orderkey % 4 when 0 then 'card_decline' when 3 then 'invoice_overdue' else 'mandate_failure' end as claim_type,
          o_orderdate + interval 9444 day as detected_at,
          case o_orderstatus when 'F' then 'in_treatment' when 'O' then 'planned' else 'promised' end as state,
          o_orderpriority as priority_text
        from orders""",
    "subjects": f"""
        select c_custkey as cust, {token('c_custkey')} as subject_token, c_nationkey as nation, c_mktsegment as segment,
          cast(round(c_acctbal * 100) as bigint) as balance_paise,
          {', '.join(f"case when (c_custkey * 7 + {i}) % 5 = 0 then 'withdrawn' when (c_custkey + {i}) % 11 = 0 then 'never_given' else 'granted' end as consent_{n}" for i, n in enumerate(["voice", "whatsapp", "sms", "email"]))},
          case when c_custkey % 17 = 0 then ['sms'] when c_custkey % 19 = 0 then ['voice', 'email'] else cast([] as varchar[]) end as opted_out,
          case when c_custkey % 23 = 0 then null when c_custkey % 6 = 0 then 'Asia/Dubai' when c_custkey % 6 = 1 then 'America/New_York' else 'Asia/Kolkata' end as tz_zone,
          case when c_custkey % 13 = 0 then 1260 when c_custkey % 13 = 1 then 690 end as quiet_start_min,
          case when c_custkey % 13 = 0 then 420 when c_custkey % 13 = 1 then 780 end as quiet_end_min,
          case when c_nationkey % 5 = 0 then [date '2024-01-24', date '2024-01-26'] else [date '2024-01-26'] end as bank_holidays,
          case when c_custkey % 29 = 0 then 'guarantor' when c_custkey % 31 = 0 then 'third_party' when c_custkey % 37 = 0 then 'employer'
               when c_custkey % 41 = 0 then 'unknown' else 'obligor' end as target,
          c_custkey % 43 = 0 as f_forborne, c_custkey % 47 = 0 as f_minor, c_custkey % 53 = 0 as f_erasure_requested,
          c_custkey % 59 = 0 as f_hardship, c_custkey % 61 = 0 as f_complaint_open, c_custkey % 67 = 0 as f_disputed,
          c_custkey % 3 <> 0 as f_identity_verified, c_custkey % 21 = 0 as f_ptp_active,
          case when c_custkey % 2 = 0 then {AT} - interval 10 hour else {AT} + interval 48 hour end as f_ptp_freeze_until,
          c_custkey % 33 = 0 as f_payment_pending,
          case when c_custkey % 2 = 1 then {AT} + interval 2 hour end as f_payment_pending_until,
          c_custkey % 71 = 0 as f_issuer_degraded, {AT} - interval 1 hour as f_issuer_degraded_until
        from customer""",
    "contacts": f"""
        select o_custkey as cust, o_orderkey as claim_no, {token('o_custkey')} as subject_token, l_shipdate + interval 9444 day as at_ts,
          {pick(["voice", "whatsapp", "sms", "email"], "l_linenumber % 4")} as channel,
          case l_returnflag when 'R' then 'no_answer' when 'A' then 'connected' else 'delivered' end as outcome,
          cast(l_linenumber as bigint) as line_no
        from lineitem join orders on l_orderkey = o_orderkey""",
    "retries": f"""
        select user_id as cust, {token('user_id')} as subject_token, 'ins_' || user_id as instrument_ref,
          'att_' || event_id as attempt_ref, at_ts, rail, case when event_id % 3 = 0 then 'gateway' else 'platform' end as initiated_by
        from presentations""",
    "decisions": f"""
        select event_id as row_no, {token('user_id')} as subject_token, user_id as cust, day(at_ts) % 4 as cycle, at_ts,
          's' || (user_id % 4) as stratum,
          case event_type when 'view' then 'do_nothing' when 'click' then 'sms' when 'signup' then 'voice_call'
               when 'purchase' then 'retry' else 'email' end as action,
          case when k % 2 = 0 or succeeded then amount_paise else 0 end as reward_paise,
          k % 7 = 0 as adverse, k % 13 = 0 as opted_out, k % 17 = 0 as complained, k % 5 = 0 as promised,
          succeeded as paid, k, issuer_ref, rail, amount_paise
        from presentations""",
    "promises": f"""
        select o_orderkey as claim_no, {token('o_custkey')} as subject_token, o_custkey as cust, o_orderdate as made_at,
          o_orderdate + interval 7 day as due_at, cast(round(o_totalprice * 100) as bigint) as amount_paise
        from orders""",
    "payments": """
        select l_orderkey as claim_no, l_shipdate as paid_at, cast(round(l_extendedprice * 100) as bigint) as amount_paise,
          cast(l_linenumber as bigint) as line_no
        from lineitem""",
    "money_moves": """
        select 'o' || o_orderkey as group_id, o_orderkey as claim_no, 'external' as frm, 'at_risk' as dest,
          cast(round(o_totalprice * 100) as bigint) as amount, o_orderdate as occurred_at
        from orders
        union all
        select 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, l_orderkey, 'at_risk',
          case l_returnflag when 'R' then 'in_treatment' else 'recovered' end,
          cast(round(l_extendedprice / 10 * 100) as bigint), l_shipdate
        from lineitem""",
    "money_entries": """
        select group_id, claim_no, occurred_at, frm as account, -amount as delta_paise from money_moves
        union all select group_id, claim_no, occurred_at, dest, amount from money_moves""",
    "outbox": f"""
        select claim_id, claim_no, subject_token, cust, state, {pick(dims.ACTION_NAMES, "claim_no % 13")} as action,
          {pick(["pending", "in_flight", "sent", "failed", "dead", "cancelled"], "claim_no % 6")} as status,
          cast(substr(priority_text, 1, 1) as int) as priority,
          {AT} + to_seconds(((claim_no % 41) - 30) * 600) as not_before, cast(claim_no % 8 as int) as attempts,
          {AT} + to_seconds(((claim_no % 37) - 20) * 300 - 900) as cert_valid_from,
          {AT} + to_seconds(((claim_no % 37) - 20) * 300 + 900) as cert_valid_until,
          claim_id || ':' || {pick(dims.ACTION_NAMES, "claim_no % 13")} as idempotency_key
        from claims""",
}


def compose(sql: str) -> str:
    """Prefix a statement with the views it uses, in dependency order.

    A statement may start with its own ``with`` list; the views are put in front of it.
    """
    needed: list[str] = []

    def visit(text: str, seen: tuple = ()):
        for name, body in CTES.items():
            if name not in needed and name not in seen and re.search(rf"\b{name}\b", text):
                visit(body, (*seen, name))
                needed.append(name)
    visit(sql)
    body = sql.strip()
    own = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if not needed:
        return body
    head = ",\n".join(f"{n} as ({CTES[n].strip()})" for n in needed)
    recursive = "recursive " if own and own.group(1) else ""
    if own:
        return f"with {recursive}{head},\n{body[own.end():]}"
    return f"with {head}\n{body}"
