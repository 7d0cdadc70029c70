"""Points in intervals: masks, pairs and cells of time, without joins on ranges.

For a mask (is any interval open?) the largest end among the intervals that began so far decides. Time is cut into
pieces; each piece carries the largest end of all pieces before it, so that an interval of years costs one
row, and a key with many rows is worked on by many tasks.

For pairs (which intervals are open?) each interval stands at the level whose blocks are at least as long as
it, in two blocks at most; a point looks at its block of each level that is in use. Levels double, so that there are
few, and each level is a join by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def inside(points: DataFrame, intervals: DataFrame, key: str = "symbol", ts: str = "ts", start: str = "start", end: str = "end", bar: float = 0.0, piece: float = 86400.0, out: str = "inside") -> DataFrame:
    """Add a flag to points: some interval of the key has start <= ts and ts + bar <= end (ts < end if bar is 0).

    A null end is open, a null start began at all times; null keys and points are inside nothing. Rows of points stay as
    they are, repeated ones too.
    """
    size, width = int(piece * 1_000_000), int(bar * 1_000_000)
    slot = lambda t: F.floor(t / size)
    low, high = F.lit(-(1 << 62)).cast("bigint"), F.lit(1 << 62).cast("bigint")
    open_ = intervals.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.coalesce(micros(F.col(start)), low).alias("_t"), F.coalesce(micros(F.col(end)), high).alias("_end"))
    rows = points.withColumns({"_key": F.col(key), "_t": micros(F.col(ts)), "_row": F.struct(*[F.col(f"`{c}`") for c in points.columns])}).select("_key", "_t", "_row")
    both = open_.select("_key", "_t", "_end", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_kind"))
    both = both.unionByName(rows.withColumns({"_end": F.lit(None).cast("bigint"), "_kind": F.lit(1)})).withColumn("_piece", slot(F.col("_t")))
    ends = open_.withColumn("_piece", slot(F.col("_t"))).groupBy("_key", "_piece").agg(F.max("_end").alias("_most"))
    # a row for each piece that has points or intervals: what was open before it
    pieces = ends.unionByName(rows.filter("_key is not null and _t is not null").select("_key", slot(F.col("_t")).alias("_piece"), F.lit(None).cast("bigint").alias("_most")).distinct())
    pieces = pieces.groupBy("_key", "_piece").agg(F.max("_most").alias("_most"))
    before = pieces.withColumn("_before", F.max("_most").over(Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))).drop("_most")
    so_far = Window.partitionBy("_key", "_piece").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_now", F.max("_end").over(so_far)).filter("_kind = 1").join(before, ["_key", "_piece"], "left")
    most = F.greatest("_now", "_before")
    yes = (most >= F.col("_t") + width) if width else most > F.col("_t")
    return found.select("_row.*", F.coalesce(yes & F.col("_key").isNotNull(), F.lit(False)).alias(out))


def interval_join(points: DataFrame, intervals: DataFrame, key: str = "symbol", ts: str = "ts", start: str = "start", end: str = "end", piece: float = 3600.0) -> DataFrame:
    """Points with each interval of their key that holds them (start <= ts < end); intervals need both ends.

    `piece` is the length of the shortest blocks. A point is repeated once for each level in use (few: levels double), an interval once or
    twice, and pairs are checked exactly.
    """
    size = int(piece * 1_000_000)
    begin, stop = micros(F.col(start)), micros(F.col(end))
    length = F.ceil((stop - begin) / size)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1))))).cast("int")
    width = lambda k: F.lit(size) * F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    placed = intervals.filter(F.col(key).isNotNull() & (begin < stop)).withColumn("_level", level)
    first, last = F.floor(begin / width(F.col("_level"))), F.floor((stop - 1) / width(F.col("_level")))
    placed = placed.withColumn("_block", F.explode(F.sequence(first, last)))
    levels = [r[0] for r in placed.select("_level").distinct().collect()]  # at most 63 numbers
    asked = points.withColumn("_asked", F.explode(F.array(*[F.lit(k) for k in sorted(levels)])) if levels else F.lit(None).cast("int"))
    asked = asked.withColumn("_at", F.floor(micros(F.col(ts)) / width(F.col("_asked"))))
    pairs = asked.join(placed.withColumnRenamed(key, "_own"), (F.col(key) == F.col("_own")) & (F.col("_asked") == F.col("_level")) & (F.col("_at") == F.col("_block")))
    held = (F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end))
    return pairs.filter(held).drop("_own", "_asked", "_at", "_level", "_block")


def lifecycle(bars: DataFrame, registry: DataFrame, bar: float, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Add live_bar (the whole bar lies in the life of its symbol) and live_open (its open does), from registry (symbol, start, end)."""
    found = inside(bars, registry, key, ts, bar=bar, out="live_bar")
    return inside(found, registry, key, ts, out="live_open")


def cells(grid: DataFrame, events: DataFrame, covered: DataFrame, x: str, size: float, key: str = "symbol", ts: str = "ts", out: str = "total") -> DataFrame:
    """Add to a grid (symbol, ts) the sum of x of the events of each cell of `size` seconds.

    Cells without events are 0 where the whole span of queries (`covered`: symbol, start, end) has them, and NULL elsewhere; a cell with
    an event whose x is unknown is NULL.
    """
    step = int(size * 1_000_000)
    cell = F.timestamp_micros(F.floor(micros(F.col(ts)) / step) * step)
    sums = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key).alias("_k"), cell.alias("_c")).agg(F.sum(x).alias("_s"), F.count_if(F.col(x).isNull()).alias("_unknown"))
    asked = inside(grid, covered, key, ts, out="_covered")
    joined = asked.join(sums, (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_c")), "left")
    value = F.when(F.col("_covered") & (F.coalesce("_unknown", F.lit(0)) == 0), F.coalesce("_s", F.lit(0.0)))
    return joined.withColumn(out, value).drop("_k", "_c", "_s", "_unknown", "_covered")
