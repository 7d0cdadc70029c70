"""Factor algebra over a long panel of (symbol, ts, ...), and a set of published formulas.

A formula is a tree of nodes. Window operators run either over one symbol in time or across the
symbols of one instant; Spark cannot nest windows, so that every window node becomes a column, and
nodes that can be computed together are added in one step (equal subtrees once). Phases alternate
between the two partitionings only where the formulas do, all formulas together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.functions.windows import full, series, trailing
from tidemill.operators.formulas import formulas


def instant() -> WindowSpec:
    """The symbols of one instant."""
    return Window.partitionBy("ts")


def rank_share(v: Column) -> Column:
    """Average rank among the values of the instant, as a share of their number; all by one sort."""
    by_value = instant().orderBy(v.asc_nulls_last())
    ties = F.count(v).over(by_value.rangeBetween(Window.currentRow, Window.currentRow))
    number = F.count(v).over(by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(v.isNotNull(), (F.rank().over(by_value) + (ties - 1) / 2) / number)


class Node:
    """An operator, its inputs and the partitioning that it needs (None: row by row)."""

    def __init__(self, key: str, build: Callable[..., Column], inputs: Iterable[Node] = (), over: str | None = None) -> None:
        self.inputs, self.build, self.over = list(inputs), build, over
        self.key = f"{key}({','.join(x.key for x in self.inputs)})"

    def _with(self, other, name: str, f) -> Node:
        return Node(name, f, [self, node(other)])

    def __add__(self, o):
        return self._with(o, "add", lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, "sub", lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, "mul", lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, "div", F.try_divide)

    def __radd__(self, o):
        return node(o) + self

    def __rsub__(self, o):
        return node(o) - self

    def __rmul__(self, o):
        return node(o) * self

    def __rtruediv__(self, o):
        return node(o) / self

    def __neg__(self):
        return node(-1.0) * self

    def __pow__(self, o):
        return signedpower(self, o)

    def __lt__(self, o):
        return self._with(o, "lt", lambda a, b: (a < b).cast("double"))

    def __le__(self, o):
        return self._with(o, "le", lambda a, b: (a <= b).cast("double"))

    def __gt__(self, o):
        return node(o) < self

    def __ge__(self, o):
        return node(o) <= self


def node(x) -> Node:
    return x if isinstance(x, Node) else Node(f"lit:{float(x)}", lambda: F.lit(float(x)))


def column(name: str) -> Node:
    return Node(f"col:{name}", lambda: F.col(name).cast("double"))


def whole(d: float) -> int:
    """Windows of the formulas may be fractions; they are cut to whole rows."""
    return max(1, math.floor(d))


def across(name: str, x, f: Callable[[Column], Column]) -> Node:
    return Node(name, f, [node(x)], "instant")


def along(name: str, inputs: list, f: Callable[..., Column]) -> Node:
    return Node(name, f, [node(x) for x in inputs], "series")


def rank(x) -> Node:
    """Average rank among the values of the instant, as a share of their number."""

    return across("rank", x, rank_share)


def scale(x, a: float = 1.0) -> Node:
    return across(f"scale:{a}", x, lambda v: F.try_divide(v * a, F.nullif(F.sum(F.abs(v)).over(instant()), F.lit(0.0))))


def indneutralize(x) -> Node:
    return across("demean", x, lambda v: v - F.avg(v).over(instant()))


def sign(x) -> Node:
    return Node("sign", F.signum, [node(x)])


def log(x) -> Node:
    return Node("log", lambda v: F.when(v > 0, F.log(v)), [node(x)])


def absolute(x) -> Node:
    return Node("abs", F.abs, [node(x)])


def signedpower(x, a) -> Node:
    """x ^ a; NULL where that is no number."""

    def f(v: Column, e: Column) -> Column:
        p = F.pow(v, e)
        return F.when(~F.isnan(p) & (F.abs(p) < float("inf")), p)

    return Node("power", f, [node(x), node(a)])


def where(condition, yes, no) -> Node:
    """`yes` where the condition holds, else `no`; unknown where it is."""
    return Node("where", lambda c, a, b: F.when(c.isNull(), None).when(c == 1, a).otherwise(b), [node(condition), node(yes), node(no)])


def either(a, b) -> Node:
    return Node("either", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)), [node(a), node(b)])


def equal(a, b) -> Node:
    return Node("equal", lambda x, y: (x == y).cast("double"), [node(a), node(b)])


def smaller(a, b) -> Node:
    return Node("smaller", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)), [node(a), node(b)])


def larger(a, b) -> Node:
    return Node("larger", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)), [node(a), node(b)])


def delay(x, d: float) -> Node:
    return along(f"delay:{whole(d)}", [x], lambda v: F.lag(v, whole(d)).over(series()))


def delta(x, d: float) -> Node:
    return node(x) - delay(x, d)


def _gated(name: str, x, d: float, f: Callable[[Column], Column]) -> Node:
    n = whole(d)
    return along(f"{name}:{n}", [x], lambda v: full(f(v).over(trailing(n)), v, n))


def total(x, d):
    return _gated("sum", x, d, F.sum)


def average(x, d):
    return _gated("mean", x, d, F.avg)


def stddev(x, d):
    return _gated("std", x, d, F.stddev_samp)


def ts_min(x, d):
    return _gated("min", x, d, F.min)


def ts_max(x, d):
    return _gated("max", x, d, F.max)


def product(x, d):
    return _gated("prod", x, d, F.product)


def _listed(name: str, x, d: float, f: Callable[[Column, Column], Column]) -> Node:
    """An operator on the array of a window's values; the array itself goes no further."""
    n = whole(d)

    def g(v: Column) -> Column:
        values = full(F.collect_list(v).over(trailing(n)), v, n)
        return F.when(values.isNotNull() & v.isNotNull(), f(values, v))

    return along(f"{name}:{n}", [x], g)


def ts_rank(x, d):
    n = whole(d)
    return _listed("tsrank", x, d, lambda a, v: (F.size(F.filter(a, lambda y: y < v)) + (F.size(F.filter(a, lambda y: y == v)) + 1) / 2) / n)


def ts_argmax(x, d):
    return _listed("argmax", x, d, lambda a, v: F.array_position(a, F.array_max(a)).cast("double"))


def ts_argmin(x, d):
    return _listed("argmin", x, d, lambda a, v: F.array_position(a, F.array_min(a)).cast("double"))


def _paired(name: str, x, y, d: float, f: Callable[[Column, Column, int], Column]) -> Node:
    n = whole(d)

    def g(a: Column, b: Column) -> Column:
        both = a.isNotNull() & b.isNotNull()
        return F.when(F.count_if(both).over(trailing(n)) == n, f(a, b, n))

    return along(f"{name}:{n}", [x, y], g)


def correlation(x, y, d):
    def f(a: Column, b: Column, n: int) -> Column:
        w = trailing(n)
        spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
        return F.when(spread > 1e-14, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(a, b).over(w), spread))))

    return _paired("corr", x, y, d, f)


def covariance(x, y, d):
    return _paired("cov", x, y, d, lambda a, b, n: F.covar_samp(a, b).over(trailing(n)))


def decay_linear(x, d):
    """Weights n for the newest row down to 1, over their sum."""
    n = whole(d)

    def f(v: Column) -> Column:
        terms = [(n - k) * F.lag(v, k).over(series()) for k in range(n)]
        return sum(terms[1:], terms[0]) / (n * (n + 1) / 2)

    return along(f"decay:{n}", [x], f)


def _phases(nodes: list[Node], first: str) -> dict[str, tuple[int, int]]:
    """(phase, level) of each node: phases take turns at the two partitionings, beginning with `first`; levels follow one another within a phase."""
    kinds, at = (first, "instant" if first == "series" else "series"), {}
    for n in nodes:
        phase, level = max((at[x.key] for x in n.inputs), default=(0, 0))
        if n.over is not None:
            here = kinds[(phase + 1) % 2] == n.over if phase else False
            level = level + 1 if here else 1
            phase += 0 if here else 1 if kinds[phase % 2] == n.over else 2
        at[n.key] = (phase, level)
    return at


def _below(factors: Iterable[Node]) -> list[Node]:
    """All nodes of the trees, equal ones once, inputs first."""
    found: dict[str, Node] = {}

    def visit(n: Node) -> None:
        if n.key not in found:
            for x in n.inputs:
                visit(x)
            found[n.key] = n

    for n in factors:
        visit(n)
    return list(found.values())


def add_factors(df: DataFrame, factors: dict[str, Node]) -> DataFrame:
    """Add one column for each factor.

    All that one partitioning can give is computed before rows move to the other one. What moves is the values that
    later phases or the factors ask for, not what these were made from.
    """
    nodes = _below(factors.values())
    at = min((_phases(nodes, first) for first in ("series", "instant")), key=lambda x: max((p for p, _ in x.values()), default=0))
    last = max((p for p, _ in at.values()), default=0)
    needed: dict[str, int] = {}
    for n in nodes:
        for x in n.inputs:
            needed[x.key] = max(needed.get(x.key, 0), at[n.key][0])
    needed |= {n.key: last + 1 for n in factors.values()}
    names: dict[str, str] = {}

    def value(n: Node) -> Column:
        return F.col(names[n.key]) if n.key in names else n.build(*[value(x) for x in n.inputs])

    def named(wanted: Iterable[Node]) -> dict[str, Column]:
        """Columns for nodes that have none yet; those without inputs are columns or numbers already."""
        fresh = {n.key: value(n) for n in wanted if n.inputs and n.key not in names}
        names.update({k: f"_f{len(names) + i}" for i, k in enumerate(fresh)})
        return {names[k]: v for k, v in fresh.items()}

    for phase in range(1, last + 1):
        own = [n for n in nodes if n.over is not None and at[n.key][0] == phase]
        df = df.repartition("symbol" if own[0].over == "series" else "ts")
        for level in range(1, max(at[n.key][1] for n in own) + 1):
            step = [n for n in own if at[n.key][1] == level]
            df = df.withColumns(named(x for n in step for x in n.inputs)).withColumns(named(step))
        df = df.withColumns(named(n for n in nodes if at[n.key][0] <= phase < needed[n.key]))
    return df.withColumns({name: value(n) for name, n in factors.items()}).drop(*names.values())


class PanelAlgebra:
    """Inputs and operators of the published formulas as nodes over a panel."""

    open, high, low, close, volume = (column(x) for x in ("open", "high", "low", "close", "volume"))
    vwap, returns = column("quote_volume") / column("volume"), column("close") / delay(column("close"), 1) - 1
    rank, scale, indneutralize, sign, log, abs = map(staticmethod, (rank, scale, indneutralize, sign, log, absolute))
    delay, delta, correlation, covariance, decay_linear = map(staticmethod, (delay, delta, correlation, covariance, decay_linear))
    ts_min, ts_max, ts_argmax, ts_argmin, ts_rank = map(staticmethod, (ts_min, ts_max, ts_argmax, ts_argmin, ts_rank))
    sum, product, stddev, signedpower = map(staticmethod, (total, product, stddev, signedpower))
    where, either, equal, smaller, larger = map(staticmethod, (where, either, equal, smaller, larger))

    @staticmethod
    def adv(d: float) -> Node:
        """Average value traded a day."""
        return average(column("quote_volume"), d)

    #: There is no capitalisation in a panel: the value traded of the 30 days before stands in.
    cap = delay(average(column("quote_volume"), 30), 1)


def alphas(df: DataFrame, numbers: Iterable[int] | None = None) -> DataFrame:
    """The panel with columns a001, a002, ... of the chosen formulas."""
    built = formulas(PanelAlgebra)
    chosen = sorted(built if numbers is None else numbers)
    return add_factors(df, {f"a{n:03d}": built[n]() for n in chosen})


# Cross-sectional preparation


def winsorised(x: str, low: float = 0.01, high: float = 0.99) -> Column:
    """Values drawn in to quantiles of their instant."""
    v = F.col(x)
    lo, hi = (F.percentile(v, F.lit(q)).over(instant()) for q in (low, high))
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def standardised(x: str) -> Column:
    v = F.col(x)
    return F.try_divide(v - F.avg(v).over(instant()), F.nullif(F.stddev_samp(v).over(instant()), F.lit(0.0)))


def pct_rank(x: str) -> Column:
    return rank_share(F.col(x))


def forward_return(df: DataFrame, horizon: int = 1, out: str = "target") -> DataFrame:
    """Return from the next row's close on, so that the row itself can be traded."""
    entry, leave = F.lead("close", 1).over(series()), F.lead("close", 1 + horizon).over(series())
    return df.withColumn(out, F.try_divide(leave, entry) - 1)


def rank_ic(df: DataFrame, factor: str, target: str = "target", least: int = 5) -> DataFrame:
    """(ts, n, ic): Spearman correlation of factor and target at each instant with enough symbols."""
    both = df.filter(F.col(factor).isNotNull() & F.col(target).isNotNull())
    ranked = both.withColumns({"_a": pct_rank(factor), "_b": pct_rank(target)})
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    return (
        ranked.groupBy("ts").agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_c"), spread.alias("_s"))
        .filter(F.col("n") >= least).select("ts", "n", F.when(F.col("_s") > 1e-12, F.col("_c") / F.col("_s")).alias("ic"))
    )


def hac_mean(series: DataFrame, x: str = "ic", lags: int = 4) -> DataFrame:
    """(n, mean, t): mean of a series in order of ts, and its t-value with Bartlett weights."""
    order = Window.orderBy("ts")  # one row per instant: a short series
    values = series.filter(F.col(x).isNotNull()).withColumn("_d", F.col(x) - F.avg(x).over(Window.partitionBy()))
    values = values.withColumns({f"_l{k}": F.col("_d") * F.lag("_d", k).over(order) for k in range(1, lags + 1)})
    parts = [F.sum(F.col("_d") * F.col("_d"))] + [2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) for k in range(1, lags + 1)]
    got = values.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (sum(parts[1:], parts[0]) / F.count("*")).alias("_v"))
    return got.select("n", "mean", F.when(F.col("_v") > 0, F.col("mean") / F.sqrt(F.col("_v") / F.col("n"))).alias("t"))


def residual(y: str, x: str) -> Column:
    """What a line through the symbols of the instant leaves of y."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.var_pop(b).over(instant())
    slope = F.when(spread > 1e-14, F.covar_pop(a, b).over(instant()) / spread).otherwise(0.0)
    return a - F.avg(a).over(instant()) - slope * (b - F.avg(b).over(instant()))


def ic_decay(df: DataFrame, factor: str, horizons: Iterable[int], least: int = 5) -> DataFrame:
    """(horizon, n, mean_ic): mean rank IC of a factor with returns over longer and longer spans."""
    out = None
    for h in horizons:
        one = rank_ic(forward_return(df, h), factor, least=least).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic")).select(F.lit(h).alias("horizon"), "n", "mean_ic")
        out = one if out is None else out.unionByName(one)
    return out


def long_short(df: DataFrame, factor: str, target: str = "target", share: float = 0.2) -> DataFrame:
    """(ts, ret): mean target of the top share of symbols less that of the bottom share, at each instant."""
    placed = df.filter(F.col(factor).isNotNull() & F.col(target).isNotNull()).withColumn("_r", pct_rank(factor))
    top, bottom = F.avg(F.when(F.col("_r") > 1 - share, F.col(target))), F.avg(F.when(F.col("_r") <= share, F.col(target)))
    return placed.groupBy("ts").agg((top - bottom).alias("ret")).filter("ret is not null")


def yearly(series: DataFrame, x: str = "ret") -> DataFrame:
    """(year, n, mean, sd, hit): statistics of a series by calendar year."""
    v = F.col(x)
    return series.groupBy(F.year("ts").alias("year")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.avg((v > 0).cast("double")).alias("hit"))
