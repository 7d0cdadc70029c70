"""Choosing factors that are unlike: rank correlations of all pairs at once, then the strongest of each kind.

One aggregation by instant has the correlations of all pairs. The choice then goes by rounds over a graph of
factors that are too much alike: each round keeps those that are stronger than all undecided ones like them, and
drops what is like a kept one. That is the set that trying one by one, strongest first, would keep.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.factors import pct_rank
from tidemill.sources.shared import cut


def rank_correlations(df: DataFrame, factors: Sequence[str], ts: str = "ts") -> DataFrame:
    """(a, b, corr) for each two factors, both ways: the mean over instants of their rank correlation, over symbols that have both."""
    names = list(factors)
    ranked = df.select(ts, *[pct_rank(x).alias(f"_r{i}") for i, x in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    both = lambda i, j: F.col(f"_r{i}").isNotNull() & F.col(f"_r{j}").isNotNull()

    def corr(i: int, j: int):
        x, y = F.when(both(i, j), F.col(f"_r{i}")), F.when(both(i, j), F.col(f"_r{j}"))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(spread > 1e-12, F.covar_pop(x, y) / spread)

    by = ranked.groupBy(ts).agg(*[corr(i, j).alias(f"_c{i}_{j}") for i, j in pairs])
    means = by.agg(*[F.avg(f"_c{i}_{j}").alias(f"_c{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit(names[a]).alias("a"), F.lit(names[b]).alias("b"), F.col(f"_c{min(a, b)}_{max(a, b)}").alias("corr")) for i, j in pairs for a, b in ((i, j), (j, i))]
    return means.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def choose_unlike(corr: DataFrame, strength: Mapping[str, float | None], most: float = 0.8) -> DataFrame:
    """(factor, kept, clash, corr): a factor goes if it is correlated by more than `most` with a stronger one that stays.

    `clash` is the strongest such. Strength counts without its sign, ties and unknown ones (weakest) go by the order of the mapping.
    """
    if not 0 < most <= 1:
        raise ValueError("most is in (0, 1]")
    size = lambda v: -1.0 if v is None or v != v else abs(v)
    order = sorted(strength, key=lambda k: (-max(size(strength[k]), 0.0), list(strength).index(k)))
    spark = corr.sparkSession
    places = spark.createDataFrame([(k, i) for i, k in enumerate(order)], "factor string, place int")
    if len(order) < 2:
        return places.select("factor", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("clash"), F.lit(None).cast("double").alias("corr"))
    alike = corr.filter(F.abs("corr") > most).select(F.col("a").alias("factor"), F.col("b").alias("other"), "corr")
    edges = cut(alike.join(places, "factor").join(places.select(F.col("factor").alias("other"), F.col("place").alias("before")), "other").filter("before < place"))
    state = cut(places.withColumn("kept", F.lit(None).cast("boolean")))
    while not state.filter("kept is null").isEmpty():
        of = state.select(F.col("factor").alias("other"), F.col("kept").alias("other_kept"))
        # stronger ones alike: any that stays drops it, any undecided makes it wait
        above = edges.join(of, "other").groupBy("factor").agg(F.count_if("other_kept").alias("stay"), F.count_if(F.col("other_kept").isNull()).alias("wait"))
        now = F.when(F.coalesce("stay", F.lit(0)) > 0, False).when(F.coalesce("wait", F.lit(0)) == 0, True)
        state = cut(state.join(above, "factor", "left").select("factor", "place", F.coalesce("kept", now).alias("kept")))
    clash = edges.join(state.filter("kept").select(F.col("factor").alias("other")), "other").groupBy("factor").agg(F.min_by(F.struct("other", "corr"), "before").alias("c"))
    return state.join(clash, "factor", "left").select("factor", "kept", F.col("c.other").alias("clash"), F.col("c.corr").alias("corr"))
