"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # ingest
    "s01_admit", "a03_fold_account", "p01_redaction_split", "m23_batch_arms",
    # diagnosis
    "a01_cohort_cells", "w06_ladder", "m21_diagnose",
    # rules
    "f04_project", "f05_certify", "f06_certificate_window", "a13_rule_fired_counts",
    # allocation
    "p07_candidate_value", "m09_propensity", "m08_admission", "m07_single_budget", "m07_shadow_prices", "m12_cycle",
    # measurement
    "m13_composed_policy", "m14_doubly_robust", "m15_cluster_bootstrap", "m19_scoreboard", "w14_average_precision", "w16_qini_curve",
    # ledgers and state
    "a15_money_balances", "f11_money_transition", "w10_ledger_verify", "w11_chain_fold", "j22_conditional_update",
    # features and text
    "p11_features", "x01_pii_scan", "x03_redact",
    # streams
    "r05_decline_windows", "r04_account_state",
]


def main() -> None:
    from dunlin.plans import catalogue
    from dunlin.session import get_spark
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()   # warm start
    times: dict[str, float] = {}
    for key in HEADLINE if not only else [k for k in catalogue.QUERIES if any(k.startswith(o) for o in only)]:
        t = time.time()
        try:
            catalogue.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[key] = round(time.time() - t, 3)
        except Exception as ex:  # noqa: BLE001
            times[key] = -1.0
            print(f"{key}: {type(ex).__name__} {str(ex)[:300]}", file=sys.stderr)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    total = round(sum(v for v in times.values() if v > 0), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
