"""News features: labels by words, ages, counts per topic and window, weighted sentiment."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of events in the order in which they are tried, with the terms that name them.
EVENT_TERMS = {
    "security_incident": ("hack", "exploit", "breach", "stolen", "drained", "rug pull", "被盗", "攻击", "漏洞"),
    "delisting": ("delist", "will remove", "removal of", "下架", "退市"),
    "listing": ("will list", "listing", "lists", "new listing", "launchpool", "上币", "上线交易"),
    "token_unlock": ("unlock", "vesting", "cliff", "解锁"),
    "regulation": ("sec", "cftc", "lawsuit", "regulator", "ban", "sanction", "监管", "诉讼", "禁令"),
    "mainnet_upgrade": ("mainnet", "hard fork", "upgrade", "halving", "主网", "升级", "减半"),
    "governance": ("proposal", "governance", "vote", "dao", "治理", "投票"),
    "partnership": ("partnership", "integrat", "collaborat", "合作"),
    "funding_round": ("raises", "funding round", "series a", "series b", "investment", "融资"),
    "macro": ("cpi", "fomc", "fed", "interest rate", "nonfarm", "inflation", "gdp", "非农", "通胀", "加息", "降息"),
    "etf_flow": ("etf", "spot etf", "inflow", "outflow"),
    "maintenance": ("maintenance", "suspend", "pause", "halt", "维护", "暂停"),
}
# Seconds for which an event of a kind may still matter, and the direction that it has by itself.
HALF_LIFE = {
    "listing": 1800, "delisting": 14400, "security_incident": 7200, "maintenance": 3600, "macro": 14400, "etf_flow": 86400, "regulation": 86400,
    "mainnet_upgrade": 172800, "token_unlock": 259200, "governance": 259200, "partnership": 43200, "funding_round": 43200, "unclassified": 3600,
}
BIAS = {
    "listing": 0.6, "delisting": -0.7, "security_incident": -0.8, "maintenance": 0.0, "token_unlock": -0.4, "mainnet_upgrade": 0.3, "governance": 0.0,
    "partnership": 0.3, "funding_round": 0.3, "regulation": -0.3, "macro": 0.0, "etf_flow": 0.0, "unclassified": 0.0,
}
# Terms of rising and falling prices, and the scores of a publisher's own tag.
BULLISH = ("surge", "rally", "soar", "jump", "bullish", "record high", "all-time high", "approve", "approval", "adopt", "breakthrough", "gain", "upgrade", "上涨", "大涨", "突破", "利好", "获批", "新高")
BEARISH = (
    "plunge", "crash", "slump", "tumble", "bearish", "sell-off", "selloff", "reject", "denied", "halt", "liquidat", "exploit", "hack", "decline",
    "下跌", "暴跌", "跌破", "利空", "抛售", "清算", "被拒",
)
TENDENCY = {0: 0.0, 1: 0.5, 2: -0.5}


def _apart(terms: Sequence[str]) -> list[list[str]]:
    """Terms in groups of which none begins with another, so that one pattern finds all of a group."""
    groups: list[list[str]] = []
    for term in terms:
        free = (g for g in groups if not any(x.startswith(term) or term.startswith(x) for x in g))
        group = next(free, None)
        if group is None:
            groups.append([term])
        else:
            group.append(term)
    return groups


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms that a text has, in their order; none for null.

    A term in ASCII counts where no letter or digit of ASCII stands before it, others anywhere. One pass over the text finds
    all terms that may stand at one place; matches may overlap.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    ascii_, other = [t for t in terms if t.isascii()], [t for t in terms if not t.isascii()]
    patterns = [f"(?<![a-z0-9])(?=({'|'.join(map(re.escape, g))}))" for g in _apart(ascii_)] + [f"(?=({'|'.join(map(re.escape, g))}))" for g in _apart(other)]
    seen = F.concat(F.array().cast("array<string>"), *[F.regexp_extract_all(low, F.lit(p), 1) for p in patterns])
    each = F.array(*[F.lit(t) for t in terms])
    return F.element_at(F.transform(F.array(F.array_distinct(seen)), lambda s: F.filter(each, lambda t: F.array_contains(s, t))), 1)  # found once


def classified(events: DataFrame, text: str, kinds: Mapping[str, Sequence[str]] = EVENT_TERMS, half_life: Mapping[str, int] = HALF_LIFE) -> DataFrame:
    """Add event_type (the first kind that has a term in the text), matched_terms and expected_half_life_seconds."""
    each = [F.struct(F.lit(k).alias("kind"), found_terms(F.col(text), v).alias("terms"), F.lit(half_life.get(k, half_life["unclassified"])).alias("life")) for k, v in kinds.items()]
    first = F.get(F.filter(F.array(*each), lambda x: F.size(x["terms"]) > 0), 0)
    rows = events.withColumn("_kind", first)
    return rows.withColumns({
        "event_type": F.coalesce("_kind.kind", F.lit("unclassified")), "matched_terms": F.coalesce("_kind.terms", F.array().cast("array<string>")),
        "expected_half_life_seconds": F.coalesce("_kind.life", F.lit(half_life["unclassified"])),
    }).drop("_kind")


def sentiment(events: DataFrame, text: str, kind: str = "event_type", tendency: str | None = None, least: float = 0.35) -> DataFrame:
    """Add sentiment_score, _confidence, _source and _label: by terms and the kind's own direction, by that alone, or by the publisher's tag.

    The label stays neutral below `least` confidence. With `tendency`, sentiment_disagrees_with_publisher tells whether the tag points the other way.
    """
    low = F.col(text)
    terms = found_terms(low, BULLISH + BEARISH)
    bias = F.coalesce(F.create_map(*[F.lit(x) for kv in BIAS.items() for x in kv])[F.col(kind)], F.lit(0.0))
    tag = F.create_map(*[F.lit(x) for kv in TENDENCY.items() for x in kv])[F.col(tendency).cast("int")] if tendency else F.lit(None).cast("double")
    # one list of counts, made once for each row
    counts = F.element_at(F.transform(F.array(terms), lambda s: F.array(F.size(F.filter(s, lambda t: t.isin(*BULLISH))), F.size(F.filter(s, lambda t: t.isin(*BEARISH))))), 1)
    rows = events.withColumns({"_counts": counts, "_bias": bias, "_tag": tag})
    rows = rows.withColumns({"_up": F.col("_counts")[0], "_down": F.col("_counts")[1]}).withColumn("_n", F.col("_up") + F.col("_down"))
    source = F.when(F.col("_n") > 0, "lexicon").when(F.col("_bias") != 0, "event_type").when(F.col("_tag").isNotNull(), "publisher").otherwise("none")
    by_terms = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.7 * (F.col("_up") - F.col("_down")) / F.col("_n") + 0.3 * F.col("_bias")))
    pick = lambda a, b, c, d: F.when(F.col("sentiment_source") == "lexicon", a).when(F.col("sentiment_source") == "event_type", b).when(F.col("sentiment_source") == "publisher", c).otherwise(d)
    rows = rows.withColumn("sentiment_source", source).withColumns({
        "sentiment_score": F.round(pick(by_terms, F.col("_bias"), F.col("_tag"), F.lit(0.0)), 4),
        "sentiment_confidence": F.round(pick(F.least(F.lit(0.85), 0.35 + 0.12 * F.col("_n")), F.lit(0.5), F.lit(0.3), F.lit(0.0)), 4),
    })
    score = F.col("sentiment_score")
    label = F.when((F.col("sentiment_confidence") < least) | (score == 0), "neutral").when(score > 0, "bullish").otherwise("bearish")
    against = F.coalesce(F.signum("_tag") * F.signum(score) < 0, F.lit(False))
    return rows.withColumns({"sentiment_label": label, "sentiment_disagrees_with_publisher": against}).drop("_counts", "_up", "_down", "_bias", "_tag", "_n")


def news_metrics(events: DataFrame, as_of: Column | None = None, spans: Mapping[str, int] | None = None, by: str = "instrument_id", available: str = "available_time", least: float = 0.35, copies: bool = False) -> DataFrame:
    """(instrument_id, metric, window, unit, value) of enriched events that were known at `as_of` (by default the last one known).

    Per instrument and span of seconds: count, share of bullish among the confident, their mean score weighted by confidence, best source reliability,
    largest number of reposts, least lateness; and the seconds since the last event. One aggregation, however many
    spans; metrics without a value have no row. Copies are left out unless `copies`.
    """
    spans = {"1h": 3600, "4h": 14400, "24h": 86400} if spans is None else spans
    rows = events.filter(F.col(by).isNotNull() & F.col(available).isNotNull())
    if not copies and "is_duplicate" in events.columns:
        rows = rows.filter(~F.coalesce("is_duplicate", F.lit(False)))
    seconds = F.unix_micros(F.col(available).cast("timestamp")) / 1e6
    if as_of is None:
        last = rows.agg(F.max(seconds)).first()[0]
        now = F.lit(last).cast("double")
    else:
        now = F.unix_micros(as_of.cast("timestamp")) / 1e6
    rows = rows.withColumn("_age", now - seconds).filter("_age >= 0")
    sure, score = F.col("sentiment_confidence") >= least, F.col("sentiment_score")
    found: dict[tuple[str, str, str], Column] = {}
    for name, size in spans.items():
        inside = F.col("_age") < size
        when = lambda x, also=True: F.when(inside & also, x)  # noqa: B023, E731
        weight = F.sum(when(F.col("sentiment_confidence"), sure))
        found[f"news_count_{name}", name, "count"] = F.count_if(inside).cast("double")
        found[f"news_bull_ratio_{name}", name, "ratio"] = F.try_divide(F.count_if(inside & sure & (score > 0)).cast("double"), F.count_if(inside & sure))
        found[f"news_sentiment_mean_{name}", name, "score"] = F.when(weight > 0, F.sum(when(score * F.col("sentiment_confidence"), sure)) / weight)
        for metric, column, best, unit in (("max_reliability", "source_reliability", F.max, "ratio"), ("repost_max", "repost_count", F.max, "count"), ("min_lead_time", "lead_time_seconds", F.min, "seconds")):
            if column in events.columns:
                found[f"news_{metric}_{name}", name, unit] = best(when(F.col(column).cast("double")))
    found["news_seconds_since_last", "point", "seconds"] = F.min("_age")
    wide = rows.groupBy(by).agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("window"), F.lit(u).alias("unit"), v.alias("value")) for (m, w, u), v in found.items()]).alias("_m"))
    return wide.select(by, F.explode("_m").alias("m")).select(by, "m.*").filter("value is not null")


def tokens(text: Column) -> Column:
    """Lower-case words; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def mentions(text: Column, words: list[str]) -> Column:
    """How often words of a list occur."""
    return F.size(F.filter(tokens(text), lambda x: x.isin(*words)))


def label(text: Column, topics: dict[str, list[str]], other: str = "other") -> Column:
    """The first topic any of whose words occurs."""
    out = F.lit(other)
    for name, words in reversed(list(topics.items())):
        out = F.when(mentions(text, words) > 0, name).otherwise(out)
    return out


def tendency(text: Column, good: list[str], bad: list[str]) -> Column:
    """(good - bad) / (good + bad), 0 if neither occurs."""
    g, b = mentions(text, good), mentions(text, bad)
    return F.coalesce(F.try_divide((g - b).cast("double"), (g + b).cast("double")), F.lit(0.0))


def windowed_counts(events: DataFrame, now: Column, spans: dict[str, int], by: str, ts: str) -> DataFrame:
    """(by, n_<name>...): events within each span of seconds before now; one conditional aggregation."""
    age = now.cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")
    return events.groupBy(by).agg(*[F.count_if((age >= 0) & (age < s)).alias(f"n_{name}") for name, s in spans.items()])
