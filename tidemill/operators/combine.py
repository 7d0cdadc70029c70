"""Signals into scores and verdicts. Signals of a row are an array of (name, direction, strength, value).

Direction is BULLISH, BEARISH or anything else for neutral; scores are rounded to two places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verdicts from best to worst with the least score of each. Fixed values.
VERDICTS = {"STRONG_CANDIDATE": 8.0, "CANDIDATE": 5.0, "WATCHLIST": 2.0, "SKIP": 0.0, "AVOID": None}


def signal(name: str, direction: Column, strength: Column, value: Column) -> Column:
    parts = {"name": F.lit(name), "direction": direction, "strength": strength.cast("double"), "value": value.cast("double")}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def side(x: Column) -> Column:
    """The direction of a signed number."""
    return F.when(x > 0, "BULLISH").when(x < 0, "BEARISH").otherwise("NEUTRAL")


def _signed(s: Column) -> Column:
    return F.when(s["direction"] == "BULLISH", s["value"]).when(s["direction"] == "BEARISH", -F.abs(s["value"])).otherwise(0.0)


def _summed(signals: Column, weight) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda n, s: n + F.coalesce(_signed(s) * weight(s), F.lit(0.0)))


def number(signals: Column, direction: str, least_strength: float = 0.0) -> Column:
    return F.size(F.filter(signals, lambda s: (s["direction"] == direction) & (s["strength"] >= least_strength)))


def added(signals: Column) -> Column:
    """Values weighed by their strength."""
    return F.round(_summed(signals, lambda s: s["strength"]), 2)


def weighted(signals: Column, weights: dict[str, float] | None = None) -> Column:
    """Values weighed by the name of their signal, 1 where there is none."""

    def weight(s: Column) -> Column:
        out = F.lit(1.0)
        for name, w in (weights or {}).items():
            out = F.when(s["name"] == name, float(w)).otherwise(out)
        return out

    return F.round(_summed(signals, weight), 2)


def tiered(tiers: list[tuple[Column, float]]) -> Column:
    """Sum over tiers of the plain sum of a tier's signals times its weight."""
    return F.round(sum((_summed(signals, lambda s: F.lit(1.0)) * w for signals, w in tiers), F.lit(0.0)), 2)


def majority(signals: Column, least_strength: float = 0.0) -> Column:
    """(bullish - bearish) / number of the signals that are strong enough; 0 without any."""
    strong = F.size(F.filter(signals, lambda s: s["strength"] >= least_strength))
    net = number(signals, "BULLISH", least_strength) - number(signals, "BEARISH", least_strength)
    return F.round(F.coalesce(F.try_divide(net, strong), F.lit(0.0)), 2)


def in_sequence(signals: Column, bullish: int = 0, bearish: int = 0, least_strength: float = 0.3) -> Column:
    """The number of bullish signals if there are as many as asked for, else minus that of bearish ones, else 0."""
    up, down = (number(signals, d, least_strength).cast("double") for d in ("BULLISH", "BEARISH"))
    enough = lambda n, asked: (n >= asked) & F.lit(asked > 0)
    return F.when(enough(up, bullish), up).when(enough(down, bearish), -down).otherwise(0.0)


def stepped(value: Column, steps: list[tuple[float, float, str]]) -> Column:
    """(score, label) of the first level that a value reaches; levels fall."""
    pair = lambda score, label: F.struct(F.lit(float(score)).alias("score"), F.lit(label).alias("label"))
    out = pair(0.0, "BELOW_ALL")
    for level, score, label in reversed(steps):
        out = F.when(value >= level, pair(score, label)).otherwise(out)
    return out


def classified(score: Column, levels: dict[str, float | None] | None = None) -> Column:
    names = list((levels or VERDICTS).items())
    out = F.lit(names[-1][0])
    for name, least in reversed(names[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def capped(score: Column, gates: list[Column], cap: str = "WATCHLIST") -> Column:
    """The verdict of a score, no better than `cap` if a gate is not passed; an unknown gate is not passed."""
    passed = F.lit(True)
    for g in gates:
        passed = passed & F.coalesce(g, F.lit(False))
    better = list(VERDICTS)[: list(VERDICTS).index(cap)]
    raw = classified(score)
    return F.when(~passed & raw.isin(better), cap).otherwise(raw)


def agreement(scores: list[Column], least: float = 0.66) -> Column:
    """(agreed, direction, percent): the most common sign of some scores, ties to the one that comes first."""
    sides = F.array(*[side(s) for s in scores])
    counted = F.transform(sides, lambda d: F.struct(F.size(F.filter(sides, lambda x: x == d)).alias("n"), d.alias("d")))
    best = F.aggregate(counted, F.element_at(counted, 1), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    share = best["n"] / len(scores)
    return F.struct((share >= least).alias("agreed"), best["d"].alias("direction"), F.round(100 * share, 1).alias("percent"))


def conflicts(a: Column, b: Column) -> Column:
    """Number of pairs of one signal from each side that point in opposite directions."""
    return number(a, "BULLISH") * number(b, "BEARISH") + number(a, "BEARISH") * number(b, "BULLISH")
