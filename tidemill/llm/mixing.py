"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each source has a token target. Among all document rates w between 0 and `max_repeat` whose tokens
meet the targets, entropy balancing takes those nearest to one copy of everything (relative
entropy). The dual has one multiplier for each source, and the rates are exponentially tilted:
w = min(max_repeat, exp(lambda * size / mean size)). Newton steps on the dual run as one
aggregation each over the (source, size) histogram, all sources at once, kept inside a bracket.
The rates are then rounded to whole copies: running sums of rates down the sizes are rounded, in
salted parts of a source, and a few single copies are added or taken away where that brings a
source nearer to its target.

Defined results: a null or blank text has size 0 and is never taken; null is a source of its own;
repeated rows are separate documents with the same rate; equal sizes are ordered by a hash of the
id, so reruns agree; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, small, with_row_key, word_count

#: Rows of a source that one task rounds together.
PART_ROWS = 4096


def source_key(source: Column) -> Column:
    """A text that stands for a source in joins, so that null is a source like others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(per_source: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Add weight and target to a table with one row per source (key, source, source_size, rows).

    Sources in order of code points, null last, get the weights in turn. The total is shared out by
    weight; no source gets more than `max_repeat` times its size, and what is too much goes to the
    others by weight until all fit (found in one pass over the sources by rising cap per weight).
    """
    ranked = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    before = Window.orderBy("_fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = F.try_divide(F.col("_left"), F.col("_weight_left"))
    return (
        per_source.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), ranked % len(weights)))
        .withColumn("_cap", max_repeat * F.col("source_size"))
        .withColumn("_fill", F.col("_cap") / F.col("weight"))
        .withColumn("_left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_full", F.col("_fill") <= level)
        .withColumn("_level", F.max(F.when(~F.col("_full"), level)).over(everything))
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * F.col("_level")))
        .select("key", "source", "source_size", "rows", "weight", "target")
    )


def tilted(lam: Column, size: Column, mean: Column) -> Column:
    return F.exp(lam * size / mean)


def solve_dual(histogram: DataFrame, sources: DataFrame, max_repeat: float, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """(key, lam, mean) of every source whose target lies strictly inside its bounds.

    `histogram` has (key, size, n) with size > 0. A round is one aggregation over it: tokens and
    their derivative at lam, then a Newton step on the logarithm, or half of the bracket where the
    step would leave it. The driver sees only the largest relative error.
    """
    ratio = F.col("source_size") / F.col("target")
    mean = F.col("_tokens") / F.col("_n")
    state = cut(
        histogram.groupBy("key")
        .agg(F.min("size").alias("least"), F.sum(F.col("n") * F.col("size")).alias("_tokens"), F.sum("n").alias("_n"))
        .join(sources.filter((F.col("target") > 0) & (F.col("target") < max_repeat * F.col("source_size"))), "key")
        .select(
            "key", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(1.0).alias("error"),
            F.when(ratio > 1, -mean * F.log(ratio) / F.col("least") - 1).otherwise(0.0).alias("lo"),
            F.when(ratio > 1, 0.0).otherwise(math.log(max_repeat) * mean / F.col("least") + 1).alias("hi"),
        )
    )
    e = tilted(F.col("lam"), F.col("size"), F.col("mean"))
    tokens = F.col("n") * F.col("size")
    for _ in range(rounds):
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= tolerance:
            break
        sums = histogram.join(small(state), "key").groupBy("key", "target", "mean", "lam", "lo", "hi").agg(
            F.sum(tokens * F.least(F.lit(max_repeat), e)).alias("f"),
            F.sum(F.when(e < max_repeat, tokens * F.col("size") / F.col("mean") * e).otherwise(0.0)).alias("df"),
        )
        gap = F.log(F.col("f") / F.col("target"))
        step = F.col("lam") - F.try_divide(gap * F.col("f"), F.col("df"))
        state = cut(
            sums.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("error", F.abs(gap))
            .withColumn(
                "lam",
                F.when(F.abs(gap) <= tolerance, F.col("lam"))
                .when((step > F.col("lo")) & (step < F.col("hi")), step)
                .otherwise((F.col("lo") + F.col("hi")) / 2),
            )
            .select("key", "target", "mean", "lam", "error", "lo", "hi")
        )
    return state.select("key", "mean", "lam")


def correct(rows: DataFrame, sources: DataFrame, max_repeat: int) -> DataFrame:
    """Change one document of each source by one copy, if that brings its tokens nearer to the target."""
    left = (
        rows.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"))
        .join(sources.select("key", "target"), "key")
        .select("key", (F.col("target") - F.col("_taken")).alias("_gap"))
    )
    free = F.when(F.col("_gap") > 0, F.col("copies") < max_repeat).otherwise(F.col("copies") > 0)
    miss = F.abs(F.abs(F.col("_gap")) - F.col("size"))
    best = (
        rows.join(small(left), "key")
        .filter(free & (F.col("size") > 0) & (miss < F.abs("_gap")))
        .groupBy("key")
        .agg(F.min(F.struct(miss.alias("miss"), "_part", "_place", F.signum("_gap").cast("long").alias("by"))).alias("_best"))
        .select("key", "_best._part", "_best._place", F.col("_best.by").alias("_by"))
    )
    return rows.join(small(best), ["key", "_part", "_place"], "left").withColumn(
        "copies", F.col("copies") + F.coalesce("_by", F.lit(0))
    ).drop("_by")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_repeat: int = 2,
    corrections: int = 4,
) -> DataFrame:
    """One row per document: id, size, source_size, target, rate, copies, taken (copies times size)."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"),
            word_count(F.col(text_col)).alias("size"),
        )
    )
    sources = cut(
        targets(
            rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")),
            weights, share, float(max_repeat),
        )
    )
    histogram = cut(rows.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    dual = solve_dual(histogram, sources, float(max_repeat))
    by_source = sources.join(dual, "key", "left").select(
        "key", "source_size", "target", "mean", "lam",
        F.greatest(F.lit(1), F.ceil(F.col("rows") / PART_ROWS)).alias("_parts"),
    )
    mixed_hash = F.xxhash64(F.col("id").cast("string"), F.lit("mix"))
    wanted = (
        F.when(F.col("target") <= 0, F.lit(0.0))
        .when(F.col("target") >= max_repeat * F.col("source_size"), F.lit(float(max_repeat)))
        .otherwise(F.least(F.lit(float(max_repeat)), tilted(F.col("lam"), F.col("size"), F.col("mean"))))
    )
    part = Window.partitionBy("key", "_part").orderBy(F.col("size").desc(), "_hash", "id")
    total = F.sum("rate").over(part.rowsBetween(Window.unboundedPreceding, 0))
    rounded = (
        rows.join(small(by_source), "key")
        .withColumn("rate", wanted)
        .withColumn("_hash", mixed_hash)
        .withColumn("_part", F.pmod("_hash", "_parts"))
        .withColumn("_place", F.row_number().over(part))
        .withColumn("_sum", F.floor(total + 0.5))
        .withColumn("copies", F.least(F.lit(max_repeat), F.col("_sum") - F.coalesce(F.lag("_sum").over(part), F.lit(0))).cast("long"))
        .drop("_sum", "_parts", "mean", "lam")
    )
    rounded = cut(rounded)
    for _ in range(corrections):
        rounded = cut(correct(rounded, sources, max_repeat))
    return rounded.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with the columns of `docs`."""
    keyed = with_row_key(docs, id_col)
    mix = mix_sources(keyed, "_tm_row", **settings).filter("copies > 0").select("_tm_row", F.col("copies").alias("_tm_copies"))
    return (
        keyed.join(mix, "_tm_row")
        .withColumn("_tm_copy", F.explode(F.sequence(F.lit(1), F.col("_tm_copies"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs)
