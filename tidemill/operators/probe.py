"""Prefix invariance: whether values of a plan change when later rows are taken away.

A plan that looks ahead (a lead, a centred window, a mean of the whole sample) gives past rows other values
on a shorter input. A few cuts are run at once: each row is repeated for those cuts that still hold it, under a
symbol of the cut's own, so that one run of the plan serves several. Where a plan works across symbols, the cuts
are also set apart in time, by whole cycles of the calendar (400 years), within which weekdays and months repeat.

The probe can't prove that the input itself was known in time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.shared import shuffles_dropped

#: Microseconds of 400 years of the Gregorian calendar, a whole number of weeks. Fixed value.
CYCLE = 146_097 * 86_400 * 1_000_000


def cut_points(df: DataFrame, n: int = 9, ts: str = "ts") -> list:
    """`n` instants spread over the last three quarters of the instants, without the last one."""
    instants = df.select(ts).distinct().withColumn("_k", F.row_number().over(Window.orderBy(ts)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    first, last = F.greatest(F.lit(2), F.floor(F.col("_n") / 4)), F.col("_n") - 2
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(first + (last - first) * i / max(1, n - 1)))
    return [r[0] for r in instants.filter((last >= first) & F.array_contains(steps, F.col("_k"))).orderBy(ts).select(ts).collect()]  # n numbers at most


def prefix_invariance(df: DataFrame, plan: Callable[[DataFrame], DataFrame], columns: Sequence[str], cuts: Sequence | None = None, across: bool = False, tolerance: float = 1e-9, by: str = "symbol", ts: str = "ts", at_once: int = 2) -> DataFrame:
    """(column, compared, differing, first_cut, same): how many known values of the whole run a shorter input changes.

    `plan` maps rows (symbol, ts, ...) to rows with the same keys. A value differs if it is NULL on one side only, or by more than
    `tolerance` of its size and of 1. first_cut is the first cut at which one does. `at_once` cuts run beside a whole run; what
    they shuffled is dropped before the next ones run, so that disk does not grow with the number of cuts.
    """
    cuts = list(cut_points(df, ts=ts) if cuts is None else cuts)
    if not cuts:
        raise ValueError("too few instants for a cut")
    spark, found = df.sparkSession, {}
    for k in range(0, len(cuts), at_once):
        with shuffles_dropped(spark):
            some = list(enumerate(cuts, 1))[k : k + at_once]
            for r in _compared(df, plan, columns, some, across, tolerance, by, ts).collect():  # a row for each column
                compared, differing, first = found.get(r["column"], (0, 0, None))
                found[r["column"]] = (compared + r["compared"], differing + r["differing"], r["_cut"] if first is None else first)
    rows = [(c, n, d, None if i is None else cuts[i - 1], d == 0) for c, (n, d, i) in found.items()]
    return spark.createDataFrame(rows, f"column string, compared bigint, differing bigint, first_cut {df.schema[ts].dataType.simpleString()}, same boolean")


def _compared(df: DataFrame, plan: Callable[[DataFrame], DataFrame], columns: Sequence[str], cuts: Sequence[tuple], across: bool, tolerance: float, by: str, ts: str) -> DataFrame:
    """(column, compared, differing, _cut) of some numbered cuts, run at once with the whole."""
    number = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("t")) for i, c in cuts])
    kept = F.transform(F.filter(number, lambda x: F.col(ts) <= x["t"]), lambda x: x["i"])
    marked = df.withColumn("_cut", F.explode(F.concat(F.array(F.lit(0)), kept)))
    shift = lambda sign: F.timestamp_micros(F.unix_micros(F.col(ts)) + sign * F.col("_cut") * F.lit(CYCLE))
    marked = marked.withColumn(by, F.concat(F.col("_cut").cast("string"), F.lit("|"), F.col(by)))
    marked = (marked.withColumn(ts, shift(1)) if across else marked).drop("_cut")
    got = plan(marked).select(by, ts, *columns)
    got = got.withColumn("_cut", F.substring_index(by, "|", 1).cast("int")).withColumn(by, F.expr(f"substring({by}, length(_cut) + 2)"))
    got = got.withColumn(ts, shift(-1)) if across else got
    got = got.filter(F.col(ts) <= F.lit(max(t for _, t in cuts)))  # later rows have nothing to be compared with
    # the whole run and its prefixes stand in one group of a row
    values = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = got.groupBy(by, ts).agg(F.max(F.when(F.col("_cut") == 0, values)).alias("_whole"), F.collect_list(F.when(F.col("_cut") > 0, F.struct("_cut", values.alias("v")))).alias("_cuts"))
    pairs = rows.select("_whole", F.explode("_cuts").alias("c"))
    checks = []
    for c in columns:
        a, b = F.col(f"_whole.`{c}`"), F.col(f"c.v.`{c}`")
        differs = F.when(a.isNull() & b.isNull(), False).otherwise(F.coalesce(F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a)), F.lit(True)))
        checks.append(F.struct(F.lit(c).alias("column"), a.isNotNull().alias("known"), differs.alias("differs")))
    flat = pairs.select("c._cut", F.explode(F.array(*checks)).alias("x")).select("_cut", "x.*")
    return flat.groupBy("column").agg(F.count_if("known").alias("compared"), F.count_if("differs").alias("differing"), F.min(F.when(F.col("differs"), F.col("_cut"))).alias("_cut"))
