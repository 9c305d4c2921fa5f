"""Choosing actions for a whole portfolio under shared budgets.

Prices are found without moving candidates: what an action costs depends only on the action, so for
any prices a subject's best candidate is among its best-valued candidate *per action*.  The candidates
are therefore aggregated once to one row per subject with thirteen values, however many claims the
subject holds, and every probe of the search is one scan of that compact table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, stats
from dunlin.operators import scale
from dunlin.session import materialise

LAMBDA_MAX = 1.0e9
STEPS = 28
GRID = 1 << STEPS
DELTA = LAMBDA_MAX / GRID
COARSE = 1 << 14
MAX_PASSES = 40
TOL = 1.0e-4
TEMPERATURE, EPSILON, SPREAD_FLOOR = 0.05, 0.05, 1.0e-9
_COST = {a[0]: dict(zip(dims.BUDGETS, a[3:9])) for a in dims.ACTIONS}
NOTHING_ORD = 1 << 62


def default_caps(subjects: int) -> dict[str, int]:
    return {"contact": max(subjects // 4, 1), "voice": max(subjects // 12, 1), "rupee": max(subjects * 60, 1), "retry": max(subjects // 2, 1)}


def fault_multiplier() -> Column:
    """How much of an action's base effect the instrument's state leaves (columns reissued, mandate_status, over_cap)."""
    broken = (F.col("mandate_status") != "active") | F.col("over_cap")
    a = F.col("action")
    return (F.when(a == "card_updater", F.when(F.col("reissued"), 1.0).otherwise(dims.REPAIR_MISS))
            .when(a == "mandate_re_register", F.when(broken, 1.0).otherwise(dims.REPAIR_MISS))
            .when(a == "rail_fallback", F.when(broken, 1.0).otherwise(0.6))
            .when(a == "retry", F.when(F.col("reissued") | F.col("over_cap"), dims.REPAIR_MISS).otherwise(1.0)).otherwise(1.0))


def action_rank() -> Column:
    """Position of the action in name order, do_nothing last."""
    names = sorted(a for a in dims.ACTION_NAMES if a != "do_nothing")
    return dims.lookup(F.col("action"), {n: i for i, n in enumerate(names)}, 15)


def pool(claims: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subjects with a claim and not of a control arm, once each: those that get a do_nothing."""
    treat = subjects.filter(~F.col("arm").isin(*dims.CONTROL_ARMS)).select("subject_token")
    return claims.select("subject_token").distinct().join(treat.distinct(), "subject_token", "left_semi")


def build_candidates(eligible: DataFrame, claims: DataFrame, subjects: DataFrame, uplift: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, drops).

    ``eligible`` has a row per claim with its facts, ``subject_token``, ``claim_no`` and ``actions``, those that survived
    projection; ``claims`` every claim (claim_id, subject_token); ``subjects`` (subject_token, arm, contacts_7d).  Control-arm
    subjects leave, every other subject gets exactly one do_nothing.  Claims meet their subjects before they become a row
    per action, and the subjects' side is hashed, so that no row per action is exchanged or sorted.
    """
    treat = subjects.filter(~F.col("arm").isin(*dims.CONTROL_ARMS))
    control = subjects.filter(F.col("arm").isin(*dims.CONTROL_ARMS)).select(
        "subject_token", F.lit(None).cast("string").alias("claim_id"), F.lit("control_arm").alias("reason"))
    actionable = eligible.withColumn("actions", F.array_remove("actions", "do_nothing")).filter(F.size("actions") > 0)
    rich = actionable.join(treat.hint("shuffle_hash"), "subject_token").withColumn("action", F.explode("actions"))
    fields = ["rupee_paise", "intrusion", "base_uplift", "contact", "voice_minutes", "retry_attempts", "human_minutes", "concession_paise"]
    rich = rich.withColumn("_a", F.get(F.filter(dims.action_structs(["action", *fields]), lambda s: s["action"] == F.col("action")), F.lit(0)))
    rich = rich.select("*", *[F.col("_a")[f].alias(f) for f in fields])
    rich = rich.withColumn("uplift", uplift)
    value = stats.candidate_value(F.col("uplift"), F.col("amount_paise"), F.col("ltv_remaining_paise"), F.col("rupee_paise"), F.col("intrusion"), F.col("contacts_7d"))
    cand = rich.select("subject_token", "claim_id", "claim_no", "action", value.alias("value"), *dims.COST_COLUMNS, "uplift",
                       (F.col("contact") == 0).alias("is_silent"), (F.col("claim_no") * 16 + action_rank()).alias("ord"))
    gone = (claims.select("claim_id", "subject_token").join(actionable.select("claim_id"), "claim_id", "left_anti").join(treat.select("subject_token"), "subject_token")
            .select("subject_token", "claim_id", F.lit("gate_ineligible").alias("reason")))
    people = pool(claims, subjects)
    nothing = people.select("subject_token", F.lit(None).cast("string").alias("claim_id"), F.lit(-1).cast("long").alias("claim_no"), F.lit("do_nothing").alias("action"),
                            F.lit(0.0).alias("value"), *[F.lit(0).cast("long").alias(c) for c in dims.COST_COLUMNS], F.lit(0.0).alias("uplift"),
                            F.lit(True).alias("is_silent"), F.lit(NOTHING_ORD).alias("ord"))
    empty = people.join(actionable.select("subject_token").distinct(), "subject_token", "left_anti").select(
        "subject_token", F.lit(None).cast("string").alias("claim_id"), F.lit("no_eligible_action").alias("reason"))
    return cand.unionByName(nothing), control.unionByName(gone).unionByName(empty)


# ---- prices ---------------------------------------------------------------------------------------
def compact(candidates: DataFrame) -> DataFrame:
    """One row per subject: the best value of each action (NULL when not eligible)."""
    per = candidates.groupBy("subject_token").agg(*[F.max(F.when(F.col("action") == a, F.col("value"))).alias(f"v_{a}") for a in dims.ACTION_NAMES])
    table = materialise(per.withColumn("v_do_nothing", F.coalesce("v_do_nothing", F.lit(0.0))), "portfolio")
    # the search reads it many times: as many files as it has work for, which a scan packs into a task or so for each core
    parts = min(-(-table.count() // PART_ROWS), 4 * table.sparkSession.sparkContext.defaultParallelism)
    return materialise(table.repartition(parts), "parts") if parts > 1 else table.coalesce(1)


#: Subjects that are worth a task of the price search, and tasks whose (bounded) histograms are summed without a shuffle.
PART_ROWS, FEW_PARTS = 10_000, 64
_NAMES = [a for a in dims.ACTION_NAMES]
_COSTS = np.array([[_COST[a][b] for b in dims.BUDGETS] for a in _NAMES], dtype=float)      # 13 x 6


def _charged(batch, prices: np.ndarray) -> np.ndarray:
    """Values of a batch of portfolio rows minus what the prices charge; minus infinity if not eligible."""
    values = batch[[f"v_{a}" for a in _NAMES]].to_numpy(dtype=float)
    return np.where(np.isnan(values), -np.inf, values - _COSTS @ prices)


def _steps(base: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(threshold prices, spend weights): each row's spend in one dimension as steps of its own price.

    With the other prices fixed every cost level is a line in this price; a level is the best choice
    from the price where it overtakes all dearer levels to the price where a cheaper one overtakes it.
    """
    levels = np.unique(cost)[::-1]
    best = np.stack([base[:, cost == c].max(axis=1) for c in levels], axis=1)
    at, weight = [], []
    with np.errstate(invalid="ignore"):
        for n, c in enumerate(levels[:-1]):
            leave = np.min((best[:, [n]] - best[:, n + 1:]) / (c - levels[n + 1:]), axis=1)
            enter = np.zeros(len(best))
            if n:
                enter = np.maximum(np.max((best[:, :n] - best[:, [n]]) / (levels[:n] - c), axis=1), 0.0)
            on = np.isfinite(best[:, n]) & (leave > enter)
            at += [leave[on], enter[on & (enter > 0)]]
            weight += [np.full(on.sum(), c), np.full((on & (enter > 0)).sum(), -c)]
    return np.concatenate(at), np.concatenate(weight)


def _histogram(table: DataFrame, dim: str, prices: Mapping[str, float], hint: int, only: bool = False) -> list:
    """Spend steps per search cell; ``fine`` keeps single grid prices inside the hinted cell.

    A task's batches are reduced to its cells, so what is shuffled and collected is bounded
    by the number of tasks and cells (2^14), not by the portfolio.
    """
    k = dims.BUDGETS.index(dim)
    others = np.array([0.0 if b == dim else prices.get(b, 0.0) for b in dims.BUDGETS])

    def run(batches):
        coarse, fine = np.zeros((GRID + 1) // COARSE + 1), np.zeros(COARSE)      # whole numbers, exact below 2^53
        for pdf in batches:
            t, w = _steps(_charged(pdf, others), _COSTS[:, k])
            i = np.minimum(np.ceil(t / DELTA), GRID + 1).astype(np.int64)
            cell = i // COARSE
            if hint >= 0:
                at = cell == hint
                fine += np.bincount(i[at] - hint * COARSE, w[at], len(fine))
            if not only:
                at = cell != hint
                coarse += np.bincount(cell[at], w[at], len(coarse))
        c, f = np.flatnonzero(coarse), np.flatnonzero(fine)
        yield pd.DataFrame({"c": np.append(c, np.full(len(f), hint)), "f": np.append(np.full(len(c), -1), f + hint * COARSE), "w": np.append(coarse[c], fine[f]).astype(np.int64)})
    cells = table.mapInPandas(run, "c long, f long, w long")
    if table.rdd.getNumPartitions() > FEW_PARTS:
        return cells.groupBy("c", "f").agg(F.sum("w").alias("w")).collect()
    sums: dict[tuple[int, int], int] = {}
    for r in cells.collect():
        sums[r["c"], r["f"]] = sums.get((r["c"], r["f"]), 0) + r["w"]
    return [{"c": c, "f": f, "w": w} for (c, f), w in sums.items()]


def price_of(table: DataFrame, dim: str, cap: int, prices: Mapping[str, float], hint: int = -1) -> float:
    """Smallest grid price at which the spend of one dimension fits its cap, the other prices fixed.

    A histogram over 2^14 coarse cells (with the single prices of the cell where the price was last
    time) comes to the driver; if the cell has moved, a second, equally bounded one refines it.
    """
    rows = _histogram(table, dim, prices, hint)
    left = sum(r["w"] for r in rows)
    if left <= cap:                        # every step lies above price zero: slack dimensions cost nothing
        return 0.0
    cells: dict[int, int] = {}
    for r in rows:
        cells[r["c"]] = cells.get(r["c"], 0) + r["w"]
    cell = None
    for c in sorted(cells):
        if left - cells[c] <= cap:
            cell = c
            break
        left -= cells[c]
    if cell is None:
        return LAMBDA_MAX
    if cell != hint:
        rows = _histogram(table, dim, prices, cell, only=True)
    for f, w in sorted((r["f"], r["w"]) for r in rows if r["c"] == cell):
        left -= w
        if left <= cap:
            return min(max(f, 1) * DELTA, LAMBDA_MAX)
    return LAMBDA_MAX


def spend(table: DataFrame, prices: Mapping[str, float]) -> dict[str, int]:
    """Spend per budget when every subject takes its best action at these prices."""
    vector = np.array([prices.get(b, 0.0) for b in dims.BUDGETS])

    def run(batches):
        for pdf in batches:
            adj = _charged(pdf, vector)
            pick = np.where(adj.max(axis=1) > 0, adj.argmax(axis=1), 0)
            yield pd.DataFrame({"a": pick.astype(np.int64), "n": 1}).groupby("a", as_index=False).sum()
    rows = table.mapInPandas(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()      # thirteen rows
    total = sum(r["n"] * _COSTS[r["a"]] for r in rows) if rows else np.zeros(len(dims.BUDGETS))
    return {b: int(v) for b, v in zip(dims.BUDGETS, total)}


def solve(candidates: DataFrame, caps: Mapping[str, int], max_shrink: int = 24) -> tuple[dict[str, float], DataFrame, DataFrame | None]:
    """(prices, active candidates, shrunk candidates or None): coordinate ascent, then the tenth with the
    least adjusted value leaves whenever the plan still exceeds a cap.  A plan that still does after
    ``max_shrink`` rounds, or when nobody is left to leave, is an error: it is never returned."""
    active, dropped = candidates, None
    table = compact(active)
    prices = _coordinate(table, caps)
    for left in range(max_shrink, -1, -1):
        used = spend(table, prices)
        over = {b: (used[b], c) for b, c in caps.items() if used[b] > c}
        if not over:
            break
        cut = bottom_tenth(active, prices) if left else None
        if cut is None:
            raise ValueError(f"no plan within the caps after {max_shrink - left} rounds: (spend, cap) {over}")
        cut = materialise(cut, "shrunk")
        dropped = cut if dropped is None else dropped.unionByName(cut)
        active = materialise(active.join(cut.select("subject_token", "ord"), ["subject_token", "ord"], "left_anti"), "active")
        table = compact(active)
        prices = _coordinate(table, caps)       # from zero again: the ascent may stop elsewhere if it comes from above
    return prices, active, dropped


def _coordinate(table: DataFrame, caps: Mapping[str, int]) -> dict[str, float]:
    prices = {b: 0.0 for b in dims.BUDGETS}
    for _ in range(MAX_PASSES):
        before = dict(prices)
        for b in dims.BUDGETS:
            if b in caps:
                hint = int(round(prices[b] / DELTA)) // COARSE if prices[b] > 0 else -1
                prices[b] = price_of(table, b, caps[b], prices, hint)
        top = max(1.0, max(abs(v) for v in prices.values()))
        if max(abs(prices[b] - before[b]) for b in prices) <= TOL * top:
            break
    return prices


def adjusted(prices: Mapping[str, float]) -> Column:
    out = F.col("value")
    for b, c in zip(dims.BUDGETS, dims.COST_COLUMNS):
        if prices.get(b, 0.0):
            out = out - F.lit(float(prices[b])) * F.col(c)
    return out


def best_per_subject(candidates: DataFrame, prices: Mapping[str, float], columns: Sequence[str] | None = None) -> DataFrame:
    """Argmax of adjusted value, the earliest on ties (a partially aggregated max, no window): ``adjusted`` and the
    columns named (all but the costs' and the like are worth leaving out: what is kept is sorted in every map task)."""
    keep = [c for c in columns or candidates.columns if c != "subject_token"]
    a = candidates.select("subject_token", *keep, adjusted(prices).alias("adjusted"), F.col("ord").alias("_ord"))
    g = a.groupBy("subject_token").agg(F.max_by(F.struct(*keep, "adjusted"), F.struct(F.col("adjusted"), (-F.col("_ord")).alias("o"))).alias("b"))
    return g.select("subject_token", "b.*")


def bottom_tenth(candidates: DataFrame, prices: Mapping[str, float]) -> DataFrame | None:
    """The lowest tenth (at least one) of treated subjects by adjusted value, ties in token order: claim_id, action, ord, adjusted."""
    t = best_per_subject(candidates, prices, ["claim_id", "action", "ord"]).filter((F.col("action") != "do_nothing") & (F.col("adjusted") > 0)).withColumn("_tok", scale.token_number(F.col("subject_token")))
    t = materialise(t, "treated")
    if t.limit(1).count() == 0:
        return None
    r = scale.running(t, [], scale.value_bucket(t, "adjusted", "_tok"), [F.col("adjusted"), F.col("subject_token")], rank="place", totals={"n": F.lit(1).cast("long")})
    return r.filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))).drop("_tok", "place", "n")


# ---- stochastic policy ------------------------------------------------------------------------------
def propensities(candidates: DataFrame, prices: Mapping[str, float], temperature: float = TEMPERATURE, epsilon: float = EPSILON) -> DataFrame:
    """Soft-max of adjusted values on the subject's own spread, mixed with a uniform floor.

    Subject maxima and sums are partially aggregated and joined back, so a subject with very many
    candidates is never sorted or collected; of each join the side with a row per subject is hashed, so that the
    candidates are exchanged once, for both joins, and not sorted.
    """
    a = candidates.withColumn("adjusted", adjusted(prices))
    s = a.groupBy("subject_token").agg(F.max("adjusted").alias("_hi"), F.min("adjusted").alias("_lo"), F.count(F.lit(1)).alias("n_options"))
    j = a.join(s.hint("shuffle_hash"), "subject_token")
    spread = F.col("_hi") - F.col("_lo")
    j = j.withColumn("_w", F.when(spread <= SPREAD_FLOOR, 1.0).otherwise(F.exp((F.col("adjusted") - F.col("_hi")) / (temperature * spread))))
    tot = j.groupBy("subject_token").agg(F.sum("_w").alias("_t"))
    j = j.join(tot.hint("shuffle_hash"), "subject_token")
    return j.withColumn("p", (1 - epsilon) * F.col("_w") / F.col("_t") + epsilon / F.col("n_options")).drop("_lo", "_w", "_t").withColumnRenamed("_hi", "best_adjusted")


def sample(dist: DataFrame, seed: str) -> DataFrame:
    """One branch per subject: the first, in candidate order, whose cumulative probability exceeds the
    subject's reproducible draw."""
    # a bucket for each subject, cut only where one has very many candidates; only what the draw needs goes through the order
    run = scale.running(dist.select("subject_token", "ord", "p"), ["subject_token"], F.lit(0).cast("long"), [F.col("ord")], sums={"_cum": F.col("p")}, split=scale.BUCKET_ROWS)
    draw = hashing.unit_draw(F.concat_ws(hashing.SEP, F.lit(seed), F.col("subject_token")))
    hit = run.filter((F.col("_cum") > draw) | (F.col("ord") == NOTHING_ORD))
    pick = hit.groupBy("subject_token").agg(F.min(F.struct("_cum", "ord")).alias("b")).select("subject_token", F.col("b.ord").alias("_ord"))
    keep = [c for c in dist.columns if c != "subject_token"]
    g = dist.join(pick.hint("shuffle_hash"), "subject_token").filter(F.col("ord") == F.col("_ord")).groupBy("subject_token").agg(F.min_by(F.struct(*keep), "p").alias("b"))
    return g.select("subject_token", "b.*")


def exploration(dist: DataFrame) -> DataFrame:
    """Per subject: value given up by exploring, mass off the best branch, and the sleeping-dog flag."""
    first = F.max_by("p", F.struct(F.col("adjusted"), (-F.col("ord")).alias("o")))
    touch = ~F.col("is_silent")
    return dist.groupBy("subject_token").agg(
        (F.max("adjusted") - F.sum(F.col("p") * F.col("adjusted"))).alias("explore_value"), (1 - first).alias("explore_mass"),
        (F.bool_or(touch) & ~F.coalesce(F.bool_or(touch & (F.col("uplift") >= 0)), F.lit(False))).alias("sleeping_dog"))


# ---- admission ------------------------------------------------------------------------------------
def admit(sampled: DataFrame, caps: Mapping[str, int], chunk: int = 65536) -> DataFrame:
    """Admission in value order within the caps, skipping misfits.

    Remaining capacity only shrinks and a cost depends only on the action, so an action that does not fit once never
    fits again.  The table is ranked once; how often each action stands in each chunk of places (at most 4,096 chunks)
    says in which chunk the next overrun is, and only that chunk is read to find its row: one small job per closed action.
    """
    cost = dict(zip(dims.BUDGETS, dims.COST_COLUMNS))
    base = sampled.withColumn("_tok", scale.token_number(F.col("subject_token")))
    ranked = scale.running(base, [], scale.value_bucket(base, "adjusted", "_tok", descending=True), [F.col("adjusted").desc(), F.col("subject_token")], rank="place")
    ranked = materialise(ranked.drop("_tok"), "ranked")
    size = max(chunk, -(-ranked.count() // 4096))
    number = F.floor((F.col("place") - 1) / size).cast("long")
    per = ranked.groupBy(number.alias("chunk"), "action").agg(F.count(F.lit(1)).alias("n"), *[F.max(cost[b]).alias(b) for b in caps]).collect()
    names = sorted({r["action"] for r in per})
    price = np.zeros((len(names), len(caps)), np.int64)
    count = np.zeros((1 + max((r["chunk"] for r in per), default=0), len(names)), np.int64)
    for r in per:
        count[r["chunk"], names.index(r["action"])] = r["n"]
        price[names.index(r["action"])] = [r[b] for b in caps]
    limit = np.array(list(caps.values()), np.int64)
    closed: dict[str, int] = {}
    while True:
        used = np.cumsum(count @ price, axis=0)
        over = np.flatnonzero((used > limit).any(axis=1))
        if not len(over):
            break
        c = int(over[0])
        before = dict(zip(caps, (used[c] - count[c] @ price).tolist()))
        inside = ranked.filter(F.col("place").between(c * size + 1, (c + 1) * size)).filter(_open(closed))
        wi = scale.W.orderBy("place").rowsBetween(scale.W.unboundedPreceding, scale.W.currentRow)       # the rows of one chunk
        run = inside.select("place", "action", *[(F.sum(cost[b]).over(wi) + F.lit(before[b])).alias(b) for b in caps],
                            F.row_number().over(scale.W.partitionBy("action").orderBy("place")).alias("_nth"))
        miss = run.filter(_any_over(caps)).orderBy("place").limit(1).collect()[0]
        closed[miss["action"]] = miss["place"]
        k = names.index(miss["action"])
        count[c, k], count[c + 1:, k] = miss["_nth"] - 1, 0
    fits = _open(closed)
    use = {b: F.when(fits, F.col(cost[b])).otherwise(0) for b in dims.BUDGETS}
    done = scale.running(ranked, [], number, [F.col("place")], sums={f"_used_{b}": c for b, c in use.items()})
    out = done.withColumn("admitted", fits)
    for b in dims.BUDGETS:
        room = F.lit(int(caps[b])) - (F.col(f"_used_{b}") - use[b]) if b in caps else F.lit(NOTHING_ORD)
        out = out.withColumn(f"room_{b}", room.cast("long"))
    return out.drop(*[f"_used_{b}" for b in dims.BUDGETS]).withColumn("intended_action", F.when(fits, F.col("action")).otherwise("do_nothing"))


def _open(closed: Mapping[str, int]) -> Column:
    out = F.lit(True)
    for a, place in closed.items():
        out = out & ((F.col("action") != a) | (F.col("place") < place))
    return out


def _any_over(caps: Mapping[str, int]) -> Column:
    out = F.lit(False)
    for b, c in caps.items():
        out = out | (F.col(b) > c)
    return out


def allocate(candidates: DataFrame, caps: Mapping[str, int], seed: str) -> tuple[DataFrame, dict[str, float], DataFrame | None]:
    """Prices, soft-max sampling with logged propensity, admission.  (decisions, prices, shrunk)"""
    prices, _, shrunk = solve(candidates, caps)
    pool = candidates if shrunk is None else drop_claims(candidates, shrunk)
    # several jobs read each of them
    dist = materialise(propensities(pool, prices), "dist")
    decided = admit(materialise(sample(dist, seed), "sampled"), caps)
    return decided.join(exploration(dist), "subject_token"), prices, shrunk


def drop_claims(candidates: DataFrame, shrunk: DataFrame) -> DataFrame:
    """Sampling leaves out every action of a shrunk claim but keeps do_nothing."""
    gone = shrunk.select("subject_token", "claim_id").distinct()
    keep = candidates.filter(F.col("action") != "do_nothing").join(gone, ["subject_token", "claim_id"], "left_anti")
    return keep.unionByName(candidates.filter(F.col("action") == "do_nothing"))
