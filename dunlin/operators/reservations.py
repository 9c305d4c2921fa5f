"""Reserving what actions cost, in six budgets: the whole cost of a request or nothing, once per key.

The reservation table is a snapshot; :func:`reserve` returns the outcome of every request and the next
snapshot.  Applied to its own next snapshot, the same batch takes nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.operators import allocation
from dunlin.operators.state import remaining
from dunlin.session import materialise

_COST = dict(zip(dims.BUDGETS, dims.COST_COLUMNS))


def _priced(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    """One row per key that asks for something and holds nothing yet: its first request, with the costs."""
    dim = dims.action_dim(requests.sparkSession).select("action", *dims.COST_COLUMNS)
    first = requests.groupBy("idempotency_key").agg(F.min_by(F.struct("ord", "subject_token", "claim_id", "action", "tier"), F.struct("ord", "claim_id")).alias("r"))
    known = reservations.select("idempotency_key").distinct()
    asks = sum((F.col(c) for c in dims.COST_COLUMNS[1:]), F.col(dims.COST_COLUMNS[0])) > 0
    return first.join(known, "idempotency_key", "left_anti").select("idempotency_key", "r.*").join(F.broadcast(dim), "action").filter(asks)


def reserve(requests: DataFrame, reservations: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome of every request, next reservations).

    ``requests``: idempotency_key, ord (unique per key, below 2^53; the order of service), subject_token, claim_id,
    action, tier (``hard`` draws on the caps, ``soft`` only announces demand).  ``reservations``: idempotency_key,
    claim_id, budget, amount, status.  ``caps``: budget, cap.

    Outcomes: ``free`` (the action costs nothing), ``reused`` (the key holds its reservation, from before or from an
    earlier request of the batch), ``soft``, ``hard``, ``refused`` (some budget cannot take it), ``undeclared`` (it draws
    hard on a budget without a cap).  An action that nobody listed is ``unknown_action``.  What is left of a
    cap counts hard reservations only and is never below nothing.
    """
    left = {r["budget"]: max(int(r["remaining"]), 0) for r in remaining(reservations, caps.filter("cap is not null")).collect()}   # a row per budget
    new = materialise(_priced(requests, reservations), "requests")
    closed = F.lit(False)
    for b in dims.BUDGETS:
        if b not in left:
            closed = closed | (F.col(_COST[b]) > 0)
    hard = new.filter((F.col("tier") == "hard") & ~closed).withColumn("adjusted", -F.col("ord").cast("double"))
    served = allocation.admit(hard, left).select("idempotency_key", F.when(F.col("admitted"), "hard").otherwise("refused").alias("got"))
    other = new.filter((F.col("tier") != "hard") | closed).select("idempotency_key", F.when(F.col("tier") != "hard", "soft").otherwise("undeclared").alias("got"))
    settled = materialise(new.join(served.unionByName(other), "idempotency_key"), "settled")

    costs = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(c).alias("amount")) for b, c in _COST.items()])
    taken = settled.filter(F.col("got").isin("hard", "soft")).select(
        "idempotency_key", "claim_id", F.col("got").alias("status"), F.inline(F.filter(costs, lambda c: c["amount"] > 0)))
    after = reservations.select("idempotency_key", "claim_id", "status", "budget", "amount").unionByName(taken)

    known = reservations.select("idempotency_key").distinct().withColumn("_held", F.lit(True))
    free = [a for a, *rest in dims.ACTIONS if not any(rest[2:8])]
    j = requests.join(known, "idempotency_key", "left").join(settled.select("idempotency_key", F.col("ord").alias("_first"), "got"), "idempotency_key", "left")
    again = (F.col("ord") > F.col("_first")) & F.col("got").isin("hard", "soft")
    outcome = (F.when(~F.coalesce(F.col("action").isin(dims.ACTION_NAMES), F.lit(False)), "unknown_action").when(F.col("action").isin(free), "free")
               .when(F.col("_held") | again, "reused").otherwise(F.col("got")))
    return j.select(*requests.columns, outcome.alias("outcome")), after
