"""The compliance rules as data.

A rule is (id, class, scope channels, actions or None, basis, status, check, parameters, remedy).
The list below is the agreed rule table (fixed values); operators compile it to columns.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from dunlin import dims

_CONTACT = ["voice", "whatsapp", "sms", "email", "payment_link", "instalment", "human", "postal"]
_ALL = ["silent", *_CONTACT]
_MESSAGE = ["voice", "whatsapp", "sms", "email", "payment_link", "instalment"]
_TIMED = [*_MESSAGE, "human"]
_DEBIT = ["retry", "rail_fallback"]


@dataclass(frozen=True)
class Rule:
    id: str
    rule_class: str
    scope: list[str]
    actions: list[str] | None
    basis: str
    status: str
    check: str
    params: dict = field(default_factory=dict)
    remedy: str = "BLOCK"
    in_force_from: str | None = None

    def applies(self, action: str) -> bool:
        return action in self.actions if self.actions is not None else dims.CHANNEL_OF[action] in self.scope

    @property
    def binding_law(self) -> bool:
        return self.basis == "statutory" and self.status == "in_force"

    @property
    def force_label(self) -> str:
        by_status = {"draft": "draft, not in force; we apply it anyway", "advisory": "advisory, not binding; we apply it as policy",
                     "contested": "contested: published guidance disagrees, we take the conservative reading"}
        by_basis = {"statutory": "statutory, in force", "network_rule": "network rule, in force", "policy_choice": "our policy choice",
                    "heuristic": "heuristic"}
        return by_status.get(self.status) or by_basis[self.basis]


# ---- fixed values: the rule table -----------------------------------------------------------------
_POLICY, _LAW, _NET = "policy_choice", "statutory", "network_rule"
RULES = [
    Rule("ABS-THIRD-PARTY", "INVARIANT", _CONTACT, None, _LAW, "in_force", "target_is_obligor", {}, "BLOCK_PERMANENT"),
    Rule("ABS-EMPLOYER", "INVARIANT", _CONTACT, None, _POLICY, "draft", "target_is_employer", {}, "BLOCK_PERMANENT"),
    Rule("ABS-OPTOUT", "INVARIANT", _MESSAGE, None, _LAW, "in_force", "channel_opted_out", {}, "BLOCK_PERMANENT"),
    Rule("ABS-CONSENT", "INVARIANT", _MESSAGE, None, _POLICY, "in_force", "channel_consent", {}, "BLOCK"),
    Rule("ABS-FORBORNE", "INVARIANT", _ALL, None, _POLICY, "in_force", "subject_flag", {"flag": "forborne"}, "BLOCK_PERMANENT"),
    Rule("ABS-DISCLOSE", "INVARIANT", ["voice", "human", "instalment", "postal"], None, _LAW, "in_force", "identity_verified", {}, "BLOCK"),
    Rule("ABS-MINOR", "INVARIANT", _ALL, None, _LAW, "in_force", "subject_flag", {"flag": "minor"}, "BLOCK_PERMANENT"),
    Rule("FRZ-PTP", "TEMPORAL", _CONTACT, None, _POLICY, "in_force", "freeze_until",
         {"flag": "ptp_active", "until_field": "ptp_freeze_until", "extra_hours": 24}, "DEFER"),
    Rule("FRZ-DISPUTE", "INVARIANT", _ALL, None, _POLICY, "in_force", "subject_flag", {"flag": "disputed"}, "BLOCK"),
    Rule("FRZ-HARDSHIP", "INVARIANT", _ALL, None, _POLICY, "in_force", "subject_flag", {"flag": "hardship"}, "BLOCK_PERMANENT"),
    Rule("FRZ-COMPLAINT", "INVARIANT", _CONTACT, None, _POLICY, "in_force", "subject_flag", {"flag": "complaint_open"}, "BLOCK"),
    Rule("FRZ-PAYMENT-PENDING", "TEMPORAL", _ALL, None, _POLICY, "in_force", "freeze_until",
         {"flag": "payment_pending", "until_field": "payment_pending_until", "extra_hours": 0}, "DEFER"),
    Rule("FRZ-ISSUER", "TEMPORAL", _ALL, None, _POLICY, "in_force", "freeze_until",
         {"flag": "issuer_degraded", "until_field": "issuer_degraded_until", "extra_hours": 2}, "DEFER"),
    Rule("FRZ-ERASURE", "INVARIANT", _ALL, None, _LAW, "in_force", "subject_flag", {"flag": "erasure_requested"}, "BLOCK_PERMANENT"),
    Rule("NET-CAT1", "INVARIANT", ["silent"], _DEBIT, _NET, "in_force", "hard_decline_category", {}, "BLOCK_PERMANENT"),
    Rule("NET-MAC03", "INVARIANT", ["silent"], _DEBIT, _NET, "in_force", "do_not_retry_advice", {}, "BLOCK_PERMANENT"),
    Rule("NET-RETRY-30D", "RESERVED", ["silent"], _DEBIT, _NET, "contested", "attempt_budget", {"window_days": 30, "max_attempts": 15}, "BLOCK"),
    Rule("NET-RETRY-DAY", "TEMPORAL", ["silent"], _DEBIT, _NET, "in_force", "attempts_per_day", {"max_per_day": 1}, "DEFER"),
    Rule("NET-MANDATE-CAP", "INVARIANT", ["silent"], _DEBIT, _LAW, "in_force", "amount_within_mandate_cap", {}, "BLOCK"),
    Rule("NET-PREDEBIT", "TEMPORAL", ["silent"], _DEBIT, _LAW, "in_force", "predebit_notice_lead", {"hours": 24}, "DEFER"),
    Rule("TIME-WINDOW", "TEMPORAL", _TIMED, None, _LAW, "in_force", "contact_window", {"open": "08:00", "close": "19:00"}, "DEFER"),
    Rule("TIME-QUIET", "TEMPORAL", _TIMED, None, _POLICY, "in_force", "quiet_hours", {}, "DEFER"),
    Rule("TIME-DAY", "TEMPORAL", ["voice"], None, _POLICY, "advisory", "blocked_days",
         {"weekdays": [6], "include_bank_holidays": True, "open": "08:00"}, "DEFER"),
    Rule("TIME-CERT-WINDOW", "RUNTIME", _ALL, None, _POLICY, "in_force", "certificate_window", {"half_window_minutes": 15}, "BLOCK"),
    Rule("CD-VOICE", "TEMPORAL", ["voice"], None, _POLICY, "in_force", "channel_cooldown", {"channel": "voice", "hours": 48}, "DEFER"),
    Rule("CD-VOICE-CONNECTED", "TEMPORAL", ["voice"], None, _POLICY, "in_force", "channel_cooldown",
         {"channel": "voice", "hours": 96, "outcomes": ["connected", "replied"]}, "DEFER"),
    Rule("CD-WHATSAPP", "TEMPORAL", ["whatsapp"], None, _POLICY, "in_force", "channel_cooldown", {"channel": "whatsapp", "hours": 24}, "DEFER"),
    Rule("CD-SMS", "TEMPORAL", ["sms"], None, _POLICY, "in_force", "channel_cooldown", {"channel": "sms", "hours": 24}, "DEFER"),
    Rule("CD-EMAIL", "TEMPORAL", ["email"], None, _POLICY, "in_force", "channel_cooldown", {"channel": "email", "hours": 12}, "DEFER"),
    Rule("CD-CROSS", "TEMPORAL", _CONTACT, None, _POLICY, "in_force", "cross_channel_cooldown", {"hours": 6}, "DEFER"),
    Rule("FREQ-24H", "TEMPORAL", _CONTACT, None, _POLICY, "in_force", "contact_frequency", {"window_hours": 24, "max_contacts": 1}, "DEFER"),
    Rule("FREQ-7D", "TEMPORAL", _CONTACT, None, _POLICY, "in_force", "contact_frequency", {"window_hours": 168, "max_contacts": 3}, "DEFER"),
    Rule("FREQ-30D", "TEMPORAL", _CONTACT, None, _POLICY, "in_force", "contact_frequency", {"window_hours": 720, "max_contacts": 8}, "DEFER"),
]
PROJECT_CLASSES = ["INVARIANT", "TEMPORAL", "RESERVED"]
ALL_CLASSES = [*PROJECT_CLASSES, "RUNTIME"]
VERDICTS = ["allow", "defer", "block", "block_permanent"]
HARD_DECLINES = ["lost_or_stolen", "account_closed", "stop_payment"]
DO_NOT_RETRY = ["MAC03", "MD06", "R08", "R16", "AC03"]


def load(rules: list[Rule] | None = None) -> list[Rule]:
    """Rules in id order; an empty table or a repeated id is refused."""
    out = sorted(rules if rules is not None else RULES, key=lambda r: r.id)
    if not out:
        raise ValueError("an empty rule table would allow everything")
    if len({r.id for r in out}) != len(out):
        raise ValueError("duplicate rule id")
    return out


def version(rules: list[Rule] | None = None) -> str:
    """``rr-`` and twelve hex digits over the canonical JSON of the ordered rules."""
    body = [{"id": r.id, "class": r.rule_class, "basis": r.basis, "status": r.status, "check": r.check, "on_violation": r.remedy.lower(),
             "scope": sorted(r.scope), "actions": sorted(r.actions) if r.actions else None, "params": r.params,
             "in_force_from": r.in_force_from} for r in load(rules)]
    return "rr-" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def from_json(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from a JSON-lines table of the same fields (small: one line per rule)."""
    rows = spark.read.schema("id string, `class` string, scope array<string>, actions array<string>, basis string, status string, "
                             "`check` string, params string, on_violation string, in_force_from string").json(path).collect()
    return load([Rule(r["id"], r["class"], list(r["scope"] or []), list(r["actions"]) if r["actions"] else None, r["basis"], r["status"],
                      r["check"], json.loads(r["params"] or "{}"), r["on_violation"], r["in_force_from"]) for r in rows])


def rule_dim(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    rows = [(r.id, r.rule_class, r.basis, r.status, r.check, r.remedy.lower(), r.force_label, r.binding_law) for r in load(rules)]
    return dims.small(spark, rows, "rule_id string, rule_class string, basis string, status string, check_name string, on_violation string, "
                      "force_label string, binding_law boolean")
