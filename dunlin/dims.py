"""Fixed vocabularies and lookup tables of the payment-recovery domain.

These are agreed values (word lists, codes, costs, thresholds); the operators read them as literals
or as small dimension tables whose size does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: actions ------------------------------------------------------------------
# action, channel, reversibility, contact, voice_minutes, rupee_paise, retry_attempts,
# human_minutes, concession_paise, intrusion, base_uplift
ACTIONS = [
    ("do_nothing", "none", "cancellable", 0, 0, 0, 0, 0, 0, 0.0, 0.0),
    ("retry", "silent", "cancellable", 0, 0, 30, 1, 0, 0, 0.0, 0.085),
    ("card_updater", "silent", "cancellable", 0, 0, 250, 1, 0, 0, 0.0, 0.13),
    ("mandate_re_register", "silent", "cancellable", 0, 0, 400, 1, 0, 0, 0.0, 0.12),
    ("rail_fallback", "silent", "cancellable", 0, 0, 60, 1, 0, 0, 0.0, 0.075),
    ("whatsapp_utility", "whatsapp", "irreversible", 1, 0, 115, 0, 0, 0, 0.001, 0.07),
    ("sms", "sms", "irreversible", 1, 0, 18, 0, 0, 0, 0.0012, 0.042),
    ("email", "email", "irreversible", 1, 0, 4, 0, 0, 0, 0.0008, 0.026),
    ("payment_link", "payment_link", "revocable", 1, 0, 90, 0, 0, 0, 0.0009, 0.078),
    ("voice_call", "voice", "irreversible", 1, 3, 210, 0, 0, 0, 0.0045, 0.115),
    ("instalment_offer", "instalment", "revocable", 1, 4, 280, 0, 0, 1, 0.003, 0.098),
    ("human_handoff", "human", "irreversible", 1, 0, 900, 0, 8, 0, 0.005, 0.125),
    ("statutory_notice", "postal", "irreversible", 1, 0, 4500, 0, 0, 0, 0.015, 0.055),
]
ACTION_FIELDS = ["action", "channel", "reversibility", "contact", "voice_minutes", "rupee_paise",
                 "retry_attempts", "human_minutes", "concession_paise", "intrusion", "base_uplift"]
ACTION_NAMES = [a[0] for a in ACTIONS]
CHANNEL_OF = {a[0]: a[1] for a in ACTIONS}
COST_COLUMNS = ["contact", "voice_minutes", "rupee_paise", "retry_attempts", "human_minutes", "concession_paise"]
# budget name for each cost column, in pricing order
BUDGETS = ["contact", "voice", "rupee", "retry", "human", "concession"]
CONTACT_CHANNELS = ["voice", "whatsapp", "sms", "email", "payment_link", "instalment", "human", "postal"]
NUDGE_ACTIONS = ["whatsapp_utility", "sms", "email", "payment_link"]
VOICE_ACTIONS = ["voice_call", "instalment_offer", "human_handoff"]
SILENT_ACTIONS = ["retry", "card_updater", "mandate_re_register", "rail_fallback"]
CONTACT_ACTIONS = NUDGE_ACTIONS + VOICE_ACTIONS + ["statutory_notice"]
REPAIR_MISS = 0.12

# ---- fixed values: claim states and legal moves ------------------------------------------------
STATE_EDGES = [
    ("detected", "diagnosed"),
    ("diagnosed", "suppressed"), ("diagnosed", "self_healing"), ("diagnosed", "planned"), ("diagnosed", "written_off"),
    ("suppressed", "planned"), ("suppressed", "diagnosed"),
    ("self_healing", "recovered"), ("self_healing", "planned"),
    ("planned", "in_treatment"), ("planned", "written_off"),
    ("in_treatment", "promised"), ("in_treatment", "escalated"), ("in_treatment", "disputed"),
    ("in_treatment", "recovered"), ("in_treatment", "written_off"), ("in_treatment", "forborne"),
    ("promised", "recovered"), ("promised", "in_treatment"), ("promised", "written_off"), ("promised", "forborne"),
    ("escalated", "recovered"), ("escalated", "written_off"), ("escalated", "forborne"),
    ("disputed", "in_treatment"), ("disputed", "written_off"),
    ("recovered", "reversed"),
    ("reversed", "in_treatment"), ("reversed", "written_off"),
]
CLAIM_STATES = ["detected", "diagnosed", "suppressed", "self_healing", "planned", "in_treatment", "promised",
                "escalated", "disputed", "recovered", "reversed", "written_off", "forborne"]
ABSORBING_STATES = ["forborne", "written_off"]
TERMINAL_STATES = ["recovered", "written_off", "forborne"]
MONEY_EDGES = [
    ("external", "at_risk"),
    ("at_risk", "in_treatment"), ("at_risk", "recovered"),
    ("in_treatment", "recovered"), ("in_treatment", "at_risk"),
    ("recovered", "settled"), ("recovered", "reversed"),
    ("settled", "reversed"),
    ("reversed", "at_risk"), ("reversed", "in_treatment"),
]

# ---- fixed values: cohort ladder -----------------------------------------------------------
# level, bucket seconds, lookback buckets
LADDER = [
    ("issuer_instrument_15m", 900, 96),
    ("issuer_instrument_2h", 7200, 84),
    ("issuer_day", 86400, 14),
    ("instrument_network_15m", 900, 96),
]
EWMA_ALPHA, Z_TAU, SIGMA_FLOOR, N_MIN, SHRINK_K, BASELINE_MIN = 0.25, 3.0, 0.02, 12, 20, 3
SWEEP_RAILS = ["card", "enach", "upi_autopay"]
RAILS = ["upi_autopay", "enach", "card", "invoice"]

# ---- fixed values: decline codes -----------------------------------------------------------
# rail, code, label, layer, confidence
DECLINE_CODES = [
    ("card", "51", "insufficient_funds", "customer", 0.92),
    ("card", "54", "card_expired", "customer", 0.95),
    ("card", "41", "hard_decline", "customer", 0.97),
    ("card", "43", "hard_decline", "customer", 0.97),
    ("card", "14", "hard_decline", "customer", 0.97),
    ("card", "05", "do_not_retry", "customer", 0.95),
    ("card", "61", "mandate_cap_exceeded", "merchant", 0.9),
    ("card", "91", "issuer_degraded", "issuer", 0.8),
    ("card", "57", "unknown", "unknown", 0.0),
    ("card", "62", "unknown", "unknown", 0.0),
    ("card", "96", "unknown", "unknown", 0.0),
    ("enach", "AM04", "insufficient_funds", "customer", 0.92),
    ("enach", "AC01", "hard_decline", "customer", 0.97),
    ("enach", "AC04", "hard_decline", "customer", 0.97),
    ("enach", "AC06", "hard_decline", "customer", 0.97),
    ("enach", "R16", "hard_decline", "customer", 0.97),
    ("enach", "MD06", "do_not_retry", "customer", 0.95),
    ("enach", "R08", "do_not_retry", "customer", 0.95),
    ("enach", "MD01", "mandate_revoked", "customer", 0.68),
    ("enach", "AG01", "mandate_cap_exceeded", "merchant", 0.9),
    ("enach", "MS03", "issuer_degraded", "issuer", 0.8),
    ("enach", "FF01", "unknown", "unknown", 0.0),
    ("enach", "RR04", "unknown", "unknown", 0.0),
    ("upi_autopay", "Z9", "insufficient_funds", "customer", 0.92),
    ("upi_autopay", "ZM", "mandate_revoked", "customer", 0.68),
    ("upi_autopay", "U69", "mandate_cap_exceeded", "merchant", 0.9),
    ("upi_autopay", "91", "issuer_degraded", "issuer", 0.8),
    ("upi_autopay", "U30", "unknown", "unknown", 0.0),
    ("upi_autopay", "U16", "unknown", "unknown", 0.0),
]
STOP_ADVICE = ["MAC03", "MAC21"]
STOP_MEANING = ("do_not_retry", "customer", 0.95)
CLAIM_TYPE_MEANINGS = [
    ("checkout_abandon", "checkout_abandoned", "customer", 0.88),
    ("invoice_overdue", "invoice_awaiting_approval", "customer", 0.6),
]
FREE_TEXT_CAP = 0.70
NO_POWER_CAP = 0.75
LAYER_ROUTE = {"issuer": "suppressed", "merchant": "self_healing", "customer": "planned", "unknown": "planned"}
MANDATE_CONFIDENCE = {"mandate_cap_exceeded": 0.96, "mandate_expired": 0.94, "mandate_orphaned": 0.88,
                      "predebit_notice_missing": 0.90, "wrong_debit_date": 0.82}

# ---- fixed values: experiment arms ---------------------------------------------------------
ARMS = ["null", "naive_dunning", "gateway_default", "greedy_unconstrained", "priced"]
CONTROL_ARMS = ["null"]
COMPARATOR = "naive_dunning"
DUNNING_SCHEDULE = ["sms", "whatsapp_utility", "voice_call"]

# ---- fixed values: provider statuses, stop events, breakers ------------------------------------
PROVIDER_STATUS = [
    ("accepted", "delivered"), ("opened", "read"), ("responded", "replied"), ("undeliverable", "bounced"),
    ("reached_third_party", "wrong_number"), ("recipient_unsubscribed", "opted_out"), ("carrier_rejected", "failed"),
]
EVENT_MATCH = {
    "claim.recovered": "claim_id", "claim.disputed": "claim_id", "claim.retry_scheduled": "claim_id",
    "claim.needs_allocation": "claim_id", "subject.hardship": "subject_token", "subject.erasure": "subject_token",
    "consent.withdrawn": "subject_token", "payment.received": "subject_token", "ptp.recorded": "claim_id",
    "system.freeze": "tenant_id",
}
STOP_EVENTS = ["claim.recovered", "claim.disputed", "subject.hardship", "subject.erasure", "consent.withdrawn",
               "system.freeze"]
# breaker, metric, comparison, threshold, self monitoring
BREAKERS = [
    ("CB-COMPLAINT", "complaints_per_1000_contacts", "ratio_of_baseline", 1.5, False),
    ("CB-OPTOUT", "opt_outs_per_1000_contacts", "ratio_of_baseline", 1.5, False),
    ("CB-CANCEL", "voluntary_cancel_rate_treated_over_control", "ratio_of_baseline", 1.5, False),
    ("CB-VOLUME", "outbound_volume", "ratio_of_baseline", 3.0, False),
    ("CB-VETO", "post_allocation_veto_rate", "absolute_share", 0.02, True),
    ("CB-DEGRADED", "degraded_decision_share", "absolute_share", 0.2, True),
    ("CB-COHORT-BLIND", "cohort_blindspot_share", "absolute_share", 0.4, True),
    ("CB-CHANNEL-FAIL", "channel_dispatch_failure_rate", "absolute_share", 0.1, False),
    ("CB-RESUME-RAMP", "post_resume_admission_over_cap", "absolute_share", 1.0, False),
    ("CB-SENTIMENT", "negative_sentiment_share_on_calls", "ratio_of_baseline", 1.5, False),
]
BREAKER_MIN_SAMPLE = 30
RAMP = [0.05, 0.25, 0.6, 1.0]
GUARDRAIL_KEYS = ["complaint_rate_per_1000", "opt_out_rate_per_1000", "voluntary_cancel_rate_treated",
                  "voluntary_cancel_rate_control", "cost_per_rupee_collected", "promise_made_rate",
                  "promise_kept_rate", "right_party_contact_rate"]

# ---- fixed values: text ------------------------------------------------------------------------
#: What a customer's turn may mean, in order of precedence on equal scores: (intent, phrase, weight).  Words are a-z and
#: apostrophes; a phrase after a negator, with two words between at most, does not count.
INTENT_PHRASES = [
    ("hardship", "lost my job", 3), ("hardship", "can't afford", 3), ("hardship", "cannot afford", 3), ("hardship", "in hospital", 2), ("hardship", "no money", 2), ("hardship", "medical emergency", 3),
    ("wrong_party", "wrong number", 3), ("wrong_party", "wrong person", 3), ("wrong_party", "not my loan", 3), ("wrong_party", "don't know this person", 3),
    ("request_human", "speak to a human", 3), ("request_human", "talk to a person", 3), ("request_human", "real person", 2), ("request_human", "your manager", 2), ("request_human", "call me back", 1),
    ("dispute", "never took this loan", 3), ("dispute", "this is fraud", 3), ("dispute", "not authorised", 3), ("dispute", "wrong amount", 2), ("dispute", "charged twice", 3),
    ("already_paid", "already paid", 3), ("already_paid", "paid it yesterday", 3),
    ("promise_to_pay", "will pay", 2), ("promise_to_pay", "pay tomorrow", 2), ("promise_to_pay", "pay on friday", 2),
    ("refuse", "won't pay", 3), ("refuse", "stop calling", 3), ("refuse", "leave me alone", 3),
]
NEGATORS = ["not", "never", "isn't", "wasn't", "aren't", "didn't", "haven't"]
STOP_INTENTS = ["hardship", "wrong_party", "request_human", "dispute"]
UNSAFE_PHRASES = [
    r"\blegal action\b", r"\bcourt\b", r"\barrest\b", r"\bpolice\b", r"\bcriminal\b", r"\bblacklist",
    r"\bcredit score will\b", r"\bseize\b", r"\bwe will inform your (employer|family|neighbou?rs)\b",
    r"\byou must pay (today|immediately)\b",
]
FIGURE = r"[₹$]?\s?\d[\d,]*(?:\.\d+)?"
REDACTIONS = [
    ("card", r"\b(?:\d[ -]?){13,19}\b"),
    ("aadhaar", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b"),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("mobile", r"(?:\+91[\s-]?)?\b[6-9]\d{9}\b"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
    ("account", r"\b\d{9,18}\b"),
]
PII_MASKS = [
    r"\bsub_[0-9a-f]{32}\b",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,128}(?![0-9a-fA-F])",
]
PII_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("pan_card", r"(?<![A-Z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![A-Z0-9])"),
    ("ifsc", r"(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])"),
    ("card_pan", r"(?<![\d\-])(?:\d[ \-]?){12,18}\d(?![\d\-])"),
    ("aadhaar", r"(?<!\d)\d{4}[ \-]?\d{4}[ \-]?\d{4}(?!\d)"),
    ("phone_in", r"(?<!\d)(?:\+?91[ \-]?)?[6-9]\d{9}(?!\d)"),
    ("bank_account", r"(?<!\d)\d{9,18}(?!\d)"),
]
NUMERIC_PII = ["card_pan", "aadhaar", "phone_in", "bank_account"]
NON_NAMES = """
ACC ACCOUNT ACCT ACH AND AUTO AUTOPAY AVAILABLE BAL BALANCE BANK BLOCKED CANCELLED CARD CHARGE CHEQUE CLOSED
COLLECT CRD CREDIT DATE DEBIT DECLINE DECLINED DISHONOUR DISHONOURED ECS EMI EXCEEDED EXPIRED FAILED FOR FROM
FUND FUNDS IMPS INR INSUF INSUFF INSUFFICIENT LIMIT LOST MANDATE MAX MIN NACH NEFT NOT PAY PAYMENT PAYMENTS REF
REFUND RETURN RETURNED REVERSAL RTGS STOLEN STOP SUCCESS THE TRAN TRANSACTION TRANSFER TXN UPI VIA WITH
ABANDONED ALLOW BLOCK CERT CERTIFICATE CLAIM CUSTOMER DEFER DEFERRED DEGRADED DETECTED DIAGNOSED DISPUTED DRAIN
ESCALATED FORBORNE FREEZE GATE HEALING ISSUER KILL MERCHANT NORMAL OFF PERMANENT PLANNED POWER PROMISED
RECOVERED RETRY REVERSED SELF SETTLED SHADOW SUBJECT SUPPRESSED SWITCH TOMBSTONE TREATMENT UNEXECUTED UNKNOWN
VETO WRITTEN
""".split()
NUMERIC_SAFE_SUFFIXES = ["_paise", "_count", "_attempts", "_days", "_hours", "_minutes", "_seconds", "_ms", "_bps",
                         "_index", "_version", "_size", "_bytes", "_seq"]

# ---- fixed values: features ------------------------------------------------------------------
FRESHNESS_TTL = [("issuer_health", 900), ("contact_history", 3600), ("payment_history", 86400),
                 ("account_attributes", 604800)]
FEATURES = [
    "prior_bounces_90d", "bounce_streak", "tenure_days", "rail", "plan_value_paise", "invoice_ageing_bucket",
    "consents_granted", "days_since_last_credit", "payments_90d", "day_of_month", "is_month_end",
    "inferred_salary_day", "days_to_inferred_salary_day", "mandate_headroom_paise", "mandate_over_cap",
    "mandate_age_days", "reissue_flag", "days_since_reissue", "mandate_active", "issuer_id",
    "issuer_7d_decline_rate", "live_degradation_flag", "amount_paise", "amount_vs_median_ratio",
    "is_first_charge_of_cycle", "hard_decline_seen", "do_not_retry_seen", "contact_history_7d",
    "contact_history_30d", "nudges_sent", "voice_attempts", "silent_attempts", "payments_after_contact",
    "payments_after_silent", "contact_conversion", "adverse_events", "adverse_per_contact", "opt_outs",
    "complaints", "hours_since_last_contact", "prior_promises", "prior_promises_kept", "prior_kept_ratio",
]


# ---- dimension tables --------------------------------------------------------------------------
def small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A constant table; its size is fixed by this module, so a broadcast of it is always bounded."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def action_dim(spark: SparkSession) -> DataFrame:
    return small(spark, ACTIONS, "action string, channel string, reversibility string, contact long, "
                 "voice_minutes long, rupee_paise long, retry_attempts long, human_minutes long, "
                 "concession_paise long, intrusion double, base_uplift double")


def action_structs(fields: list[str] | None = None, skip_nothing: bool = False) -> Column:
    """The action table as an array literal, so that a row is multiplied by ``inline``, not a join."""
    keep = fields or ACTION_FIELDS
    rows = []
    for a in ACTIONS:
        if skip_nothing and a[0] == "do_nothing":
            continue
        rec = dict(zip(ACTION_FIELDS, a))
        rows.append(F.struct(*[
            (F.lit(rec[f]).cast("long") if isinstance(rec[f], int) else F.lit(rec[f])).alias(f) for f in keep
        ]))
    return F.array(*rows)


def code_dim(spark: SparkSession) -> DataFrame:
    return small(spark, DECLINE_CODES, "rail string, code string, label string, layer string, confidence double")


def lookup(key: Column, pairs: dict, default=None) -> Column:
    """Literal map lookup inside generated code."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out
