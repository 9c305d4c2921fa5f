"""Ordered running totals and exact ranks that never put a whole key, or a whole table, in one task.

A plain window over ``partitionBy(key)`` sorts all rows of a key in one task, and a window without a
key sorts the whole table in one.  The helpers here cut the order into *buckets* that are monotone in
the sort order: the window runs inside (key, bucket), and the totals of earlier buckets, one small row
each, are added as an offset.  Buckets are plain expressions over the row, so a recomputed task always
lands in the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dunlin.session import materialise


def running(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            rank: str | None = None, totals: dict[str, Column] | None = None, split: int | None = None) -> DataFrame:
    """Add inclusive running sums, *exclusive* running maxima and the row number within ``keys``.

    ``bucket`` must be non-decreasing along ``order``.  ``totals`` adds whole-key sums as well.  With ``split``, buckets
    of more rows than that are cut further along the (ascending) order.
    """
    sums, maxes, totals, keys = dict(sums or {}), dict(maxes or {}), dict(totals or {}), list(keys)
    if rank:
        sums[rank] = F.lit(1).cast("long")
    base = df.withColumn("_bkt", bucket)
    if split:
        base = split_hot(base, keys, order, split)
    inside = W.partitionBy(*keys, "_bkt").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    local = base.select("*", *[F.sum(c).over(upto).alias(f"_in_{n}") for n, c in sums.items()],
                        *[F.max(c).over(before).alias(f"_in_{n}") for n, c in maxes.items()])
    per_bucket = base.groupBy(*keys, "_bkt").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxes.items()], *[F.sum(c).alias(f"_w_{n}") for n, c in totals.items()])
    earlier = W.partitionBy(*keys).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_bucket.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bkt").alias("_k_bkt"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_off_{n}") for n in maxes],
        *[F.sum(f"_w_{n}").over(whole).alias(n) for n in totals])
    cond = F.col("_bkt").eqNullSafe(F.col("_k_bkt"))
    for k in keys:
        cond = cond & local[k].eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(offsets, cond, "inner")
    return out.select(*[c for c in df.columns], *[F.col(n) for n in totals],
                      *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums],
                      *[F.greatest(F.col(f"_in_{n}"), F.col(f"_off_{n}")).alias(n) for n in maxes])


#: Rows that one bucket should hold, and the finest grid of quantiles that is ever asked for.
BUCKET_ROWS, GRID = 250_000, 4096


def cut_points(df: DataFrame, column: str, n: int | None = None) -> list:
    """Approximate quantiles of a numeric column: as many as the number of rows calls for, 8 at least.

    One aggregation gives the row count and the grid; only the balance of the buckets depends on their
    accuracy, never a result.
    """
    grid = ", ".join(f"{i / GRID!r}D" for i in range(1, GRID))       # one text to parse, not a call to the JVM per number
    row = df.agg(F.expr(f"percentile_approx(`{column}`, array({grid}), {4 * GRID})").alias("q"), F.count(column).alias("n")).first()
    n = n or min(GRID, max(8, row["n"] // BUCKET_ROWS))
    every = row["q"] or []
    return sorted(set(every[i * len(every) // n] for i in range(1, n) if every))


def order_bucket(column: Column, cuts: list, descending: bool = False) -> Column:
    """Bucket of a value between literal cut points; a value equal to a cut has a bucket of its own.

    Even numbers are the single-value buckets.  The search is a balanced tree of comparisons.
    """
    def tree(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(2 * lo + 1)
        mid = (lo + hi) // 2
        return (F.when(column == F.lit(cuts[mid]), F.lit(2 * mid + 2))
                .when(column < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi)))
    b = tree(0, len(cuts)) if cuts else F.lit(1)
    return -b if descending else b


def value_bucket(df: DataFrame, column: str, tie: str | None = None, descending: bool = False, n: int | None = None) -> Column:
    """Order bucket of ``column``, in which one heavily repeated value is split further by ``tie``.

    Rows that share a value sit in a single-value bucket; those are divided along the ascending tie
    key, so that even a value held by a third of all rows is sorted by many tasks.
    """
    vb = order_bucket(F.col(column), cut_points(df, column, n), descending)
    if tie is None:
        return vb.cast("long") * 10_000
    tb = order_bucket(F.col(tie), cut_points(df, tie, n))
    return vb.cast("long") * 10_000 + F.when(vb % 2 == 0, tb).otherwise(0)


def token_number(token: Column) -> Column:
    """A number that sorts like a ``sub_<hex>`` token, for bucketing ties."""
    return F.conv(F.substring(token, 5, 8), 16, 10).cast("long")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key.  Spark limits each map task to k rows per key before the
    shuffle (window group limit), so a hot key never travels whole."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


#: Sampled rows for each bucket into which a hot one is cut.
SAMPLES = 32


def split_hot(base: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows with ``_bkt`` cut along the order wherever a (key, bucket) holds more than about ``rows`` rows.

    The sketch of a (key, bucket) is a sample of its order keys, chosen by their hash at one rate for all; where it has
    two buckets' worth, every 32nd of the sorted sample is a cut.  Cuts are whole order keys, so rows of one moment part
    by the tie columns.  There is one cut for each ``rows`` rows; they are sent to every task up to 2^17 of them, and
    joined by key beyond.  Only the balance depends on the sample, never a result.
    """
    keys, every = list(keys), max(rows // SAMPLES, 1)
    if base.schema["_bkt"].dataType.simpleString() == "date":
        base = base.withColumn("_bkt", F.unix_date("_bkt"))
    picked = base.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
    cuts = picked.groupBy(*keys, "_bkt").agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))).alias("_s")).where(F.size("_s") >= 2 * SAMPLES)
    places = F.sequence(F.lit(SAMPLES), F.size("_s") - SAMPLES // 2, F.lit(SAMPLES))
    cuts = materialise(cuts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bkt").alias("_k_bkt"), F.array_distinct(F.transform(places, lambda i: F.get("_s", i))).alias("_cuts")), "cuts")
    size = cuts.agg(F.sum(F.size("_cuts")).alias("n"), F.max(F.size("_cuts")).alias("most")).first()
    if not size["n"]:
        return base
    cond = F.col("_bkt").eqNullSafe(F.col("_k_bkt"))
    for k in keys:
        cond = cond & base[k].eqNullSafe(F.col(f"_k_{k}"))
    out = base.join(F.broadcast(cuts) if size["n"] <= 1 << 17 else cuts, cond, "left").withColumn("_at", F.lit(0))
    mine = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    for step in reversed(range(size["most"].bit_length())):         # how many cuts are not above the row
        out = out.withColumn("_at", F.when(F.get("_cuts", F.col("_at") + ((1 << step) - 1)) <= mine, F.col("_at") + (1 << step)).otherwise(F.col("_at")))
    return out.select(*[c for c in base.columns if c != "_bkt"], (F.col("_bkt").cast("long") * (1 << 32) + F.col("_at")).alias("_bkt"))


def run_length(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], hit: Column, reset: Column,
               alias: str, split: int | None = None, since: tuple[Column, str] | None = None) -> DataFrame:
    """Hits since the last reset, along the order, in one two-level pass.

    Inside a bucket it is the running hit count minus its value at the last reset; earlier buckets
    contribute their hit total and the (global) hit count at their last reset.  ``since`` adds, under the name given, the
    largest value that a column has had at a reset so far.  ``split`` is as in :func:`running`.
    """
    keys = list(keys)
    h = F.when(hit, 1).otherwise(0).cast("long")
    value, name = since or (F.lit(None).cast("long"), None)
    base = df.withColumn("_bkt", bucket)
    if split:
        base = split_hot(base, keys, order, split)
    upto = W.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = (base.withColumn("_f", F.sum(h).over(upto)).withColumn("_s", F.max(F.when(reset, value)).over(upto))
             .withColumn("_m", F.max(F.when(reset, F.col("_f"))).over(upto)))
    per = local.groupBy(*keys, "_bkt").agg(F.max("_f").alias("_tf"), F.max("_m").alias("_tm"), F.max("_s").alias("_ts"))
    earlier = W.partitionBy(*keys).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    off = per.withColumn("_o", F.coalesce(F.sum("_tf").over(earlier), F.lit(0)))
    off = off.withColumn("_p", F.max(F.col("_o") + F.col("_tm")).over(earlier)).withColumn("_q", F.max("_ts").over(earlier))
    off = off.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bkt").alias("_k_bkt"), "_o", "_p", "_q")
    cond = F.col("_bkt").eqNullSafe(F.col("_k_bkt"))
    for k in keys:
        cond = cond & local[k].eqNullSafe(F.col(f"_k_{k}"))
    total = F.col("_o") + F.col("_f")
    last = F.coalesce(F.greatest(F.col("_p"), F.col("_o") + F.col("_m")), F.lit(0))
    extra = [F.greatest("_s", "_q").alias(name)] if name else []
    return local.join(off, cond).select(*df.columns, (total - last).alias(alias), *extra)


def exact_quantile(df: DataFrame, keys: Sequence[str], column: str, q: float, alias: str) -> DataFrame:
    """Interpolated quantile per key from value counts and their running total.

    ``percentile`` keeps every distinct value of a group in one buffer; here a group is only ever a
    list of (value, count) rows cut into buckets.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    r = running(counts, keys, value_bucket(counts, column), [F.col(column)], sums={"_hi": F.col("_c")}, totals={"_n": F.col("_c")})
    pos = (F.col("_n") - 1) * F.lit(q)
    lo, hi = F.floor(pos), F.ceil(pos)

    def at(p: Column) -> Column:
        return F.max(F.when((p < F.col("_hi")) & (p >= F.col("_hi") - F.col("_c")), F.col(column)).cast("double"))
    g = r.groupBy(*keys, "_n").agg(at(lo).alias("_a"), at(hi).alias("_b"))
    frac = (F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q))
    return g.select(*keys, (F.col("_a") + frac * (F.col("_b") - F.col("_a"))).alias(alias))
