"""Source breakers as a composable automaton: one source is many tasks.

A breaker opens at so many failures in a row, ignores its source for a while, and closes with the first success after
that.  Whether a failure run is long enough does not depend on the breaker: a run's `threshold`-th failure is a
*candidate*, found by run lengths that are cut along time.  A candidate opens the breaker if the success before its run
was heard, that is if it came no earlier than the last opening plus the cool-down.  So what a stretch of candidates does
is a function from the moment at which the breaker hears again to the moment at which it will hear again afterwards: a
small table of steps.  Tables are made stretch by stretch, composed in order (one row for each stretch), and each
stretch is then replayed from what it was handed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.operators import scale
from dunlin.session import materialise

#: Candidates of a stretch, and microseconds of a time cell.
STRETCH, CELL_US = 256, 3_600_000_000
NEVER = -(1 << 62)
STATE = "source string, run long, ok_us long, hears_us long"


def openings(t: np.ndarray, s: np.ndarray, hears: int, cooldown: int) -> tuple[list[int], int]:
    """Candidates that open the breaker, and when it hears again; s (the successes before) does not decrease."""
    out, i = [], int(np.searchsorted(s, hears))
    while i < len(t):
        out.append(int(t[i]))
        hears = int(t[i]) + cooldown
        i = max(i + 1, int(np.searchsorted(s, hears)))
    return out, hears


def step_table(t: np.ndarray, s: np.ndarray, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the breaker hears again after a stretch, by the first candidate it listens to.

    What comes in is at most the stretch's first moment plus the cool-down, so only those steps are kept, and one more."""
    after = np.maximum(np.searchsorted(s, t + cooldown), np.arange(1, len(t) + 1))
    out = t + cooldown
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            out[i] = out[after[i]]
    keep = min(len(t), int(np.searchsorted(s, t[0] + cooldown)) + 1)
    return s[:keep], out[:keep]


def compose(hears: int, steps: np.ndarray, out: np.ndarray) -> int:
    i = int(np.searchsorted(steps, hears))
    return hears if i >= len(steps) else int(out[i])


def _same(value: str | None, n: int) -> pd.Series:
    return pd.Series([value] * n, dtype=object)


def breaker_trips(events: DataFrame, threshold: int, cooldown_us: int, carried: DataFrame | None = None, split: int = scale.BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(source, tripped_us) of every opening, and the state per source to carry into later events.

    `events` has source, event_id, at_us, succeeded; later calls must get later events."""
    spark = events.sparkSession
    carried = carried if carried is not None else spark.createDataFrame([], STATE)
    runs = scale.run_length(events.select("source", "event_id", "at_us", "succeeded"), ["source"], F.floor(F.col("at_us") / CELL_US), [F.col("at_us"), F.col("event_id")],
                            ~F.col("succeeded"), F.col("succeeded"), "here", split=split, since=(F.col("at_us"), "ok_here"))
    held = carried.select(F.col("source").alias("_src"), "run", "ok_us", "hears_us")                   # one row for each source
    runs = runs.join(held, F.col("source").eqNullSafe(F.col("_src")), "left").select(
        "source", "event_id", "at_us", "succeeded", F.col("ok_here").isNotNull().alias("own"),
        (F.col("here") + F.when(F.col("ok_here").isNull(), F.coalesce("run", F.lit(0))).otherwise(0)).alias("k"), F.coalesce("ok_here", "ok_us", F.lit(NEVER)).alias("s"))
    runs = materialise(runs, "failure-runs")
    found = runs.where(~F.col("succeeded") & (F.col("k") == threshold)).select("source", F.col("at_us").alias("t"), "s", "event_id")
    ranked = scale.running(found, ["source"], F.floor(F.col("t") / CELL_US), [F.col("t"), F.col("event_id")], rank="n", split=split)
    ranked = materialise(ranked.select("source", "t", "s", F.floor((F.col("n") - 1) / STRETCH).cast("long").alias("stretch")), "candidates")

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "s"])
        steps, out = step_table(rows["t"].to_numpy(np.int64), rows["s"].to_numpy(np.int64), cooldown_us)
        return pd.DataFrame({"source": _same(rows["source"].iloc[0], 1), "stretch": [int(rows["stretch"].iloc[0])], "steps": [steps.tolist()], "out": [out.tolist()]})

    def walk(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        hears = int(state["hears_us"].iloc[0]) if len(state) else NEVER
        source, out = (state if len(state) else rows)["source"].iloc[0], []
        for stretch, steps, after in rows.sort_values("stretch")[["stretch", "steps", "out"]].itertuples(index=False):
            out.append((int(stretch), hears))
            hears = compose(hears, np.asarray(steps), np.asarray(after))
        numbers = pd.DataFrame([*out, (-1, hears)], columns=["stretch", "hears_us"])
        return numbers.assign(source=_same(source, len(numbers)))[["source", "stretch", "hears_us"]]

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "s"])
        trips, _ = openings(rows["t"].to_numpy(np.int64), rows["s"].to_numpy(np.int64), int(rows["hears_us"].iloc[0]), cooldown_us)
        return pd.DataFrame({"source": _same(rows["source"].iloc[0], len(trips)), "tripped_us": trips})
    tables = ranked.groupBy("source", "stretch").applyInPandas(table, "source string, stretch long, steps array<long>, out array<long>")
    handed = materialise(tables.groupBy("source").cogroup(carried.groupBy("source")).applyInPandas(walk, "source string, stretch long, hears_us long"), "handed")
    trips = (ranked.join(handed.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src")) & (ranked["stretch"] == handed["stretch"])).drop("_src").drop(handed["stretch"])
             .groupBy("source", "stretch").applyInPandas(replay, "source string, tripped_us long"))
    last = runs.groupBy("source").agg(F.max_by("k", F.struct("at_us", "event_id")).alias("run"), F.max_by("s", F.struct("at_us", "event_id")).alias("ok_us"), F.lit(None).cast("long").alias("hears_us"), F.lit(1).alias("newer"))
    rest = carried.select("source", "run", "ok_us", F.lit(None).cast("long").alias("hears_us"), F.lit(0).alias("newer"))
    ends = handed.where("stretch = -1").select("source", F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("ok_us"), "hears_us", F.lit(0).alias("newer"))
    state = last.unionByName(rest).unionByName(ends).groupBy("source").agg(F.max_by("run", F.when(F.col("run").isNotNull(), F.col("newer"))).alias("run"), F.max("ok_us").alias("ok_us"),
                                                                          F.coalesce(F.max("hears_us"), F.lit(NEVER)).alias("hears_us"))
    return trips, state
