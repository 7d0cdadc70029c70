"""Stories and instruments of news: against a plain greedy loop, and the rules one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import stories


def greedy(texts, similarity=0.6):
    """Each text in turn: the first telling alike, or a new one."""
    tellers, out = [], []
    for k, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        own = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()
        for t, theirs, raw in tellers:
            if raw == (text or "").lower() or (own | theirs and len(own & theirs) / len(own | theirs) >= similarity):
                out.append(t)
                break
        else:
            tellers.append((k, own, (text or "").lower()))
            out.append(k)
    return out


def clusters(spark, texts, **more):
    rows = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "event_id long, text string, at long")
    found = {r.event_id: r for r in stories.story_clusters(rows, "event_id", "text", "at", **more).collect()}
    return [found[k] for k in range(len(texts))]


@pytest.mark.parametrize("first", [2, 8])
def test_equals_the_greedy_loop(spark, monkeypatch, first):
    """Chains of copies, templates with a word changed, exact copies, texts without words; few or many met in a round."""
    monkeypatch.setattr(stories, "FIRST", first)
    rng = random.Random(first)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(6, 16))] for _ in range(4)]
    texts = []
    for _ in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice("abcdefghij")
        texts.append(" ".join(words))
        if rng.random() < 0.1:
            base.append(words)  # copies of copies drift away
    texts += ["price of x up", "Price of X up!", None, "", "…", "…", "two words", "two words."]
    texts += [f"the price of coin {k} rose by {k} percent in the last hour of trade" for k in range(15)]
    rng.shuffle(texts)
    want = greedy(texts)
    found = clusters(spark, texts)
    assert [r.duplicate_of if r.is_duplicate else k for k, r in enumerate(found)] == want
    assert [r.repost_count for r in found] == [want.count(w) for w in want]
    assert len(set(want)) > 20


def test_known_stories_and_lateness(spark):
    rows = spark.createDataFrame([("new", "Exchange will list ABC", 100, 160)], "event_id string, text string, at long, seen long")
    rows = rows.select("event_id", "text", F.timestamp_seconds("at").alias("at"), F.timestamp_seconds("seen").alias("seen"))
    before = stories.story_clusters(rows.withColumn("event_id", F.lit("old")), "event_id", "text", "at").select("content_hash", "event_id")
    got = stories.story_clusters(rows, "event_id", "text", "at", available_col="seen", known=before).collect()
    assert [(r.duplicate_of, r.is_duplicate, r.lead_time_seconds) for r in got] == [("old", True, 60.0)]
    assert stories.story_clusters(rows.limit(0), "event_id", "text", "at").count() == 0


def test_instruments(spark):
    rows = [
        (0, "Exchange will list ABC", ["ABC"], None), (1, "Markets are quiet", ["$sol"], None), (2, "BTC ETH SOL ADA all up", ["BTC", "ETH", "SOL", "ADA"], None),
        (3, "a new coin", ["NOTACOIN"], None), (4, None, None, None), (5, "solana and btc move", ["SOL", "BTC", "SOL"], None), (6, "about ada", [], "ADAUSDT"), (7, "xbtc only", ["BTC"], ""),
    ]
    events = spark.createDataFrame(rows, "event_id long, text string, tickers array<string>, named string")
    universe = spark.createDataFrame([(k, s) for k, s in enumerate(["ABCUSDT", "SOLUSDT", "BTCUSDT", "ETHUSDT", "ADAUSDC", "adausdt"])], "place int, symbol string")
    got = {r.event_id: (r.instrument_id, r.entity_source, r.entity_confidence) for r in stories.resolve_instruments(events, universe, "event_id", "text", ["tickers"], "named").collect()}
    assert got == {
        0: ("ABCUSDT", "text", 0.9), 1: (None, "publisher_only", 0.0), 2: (None, "ambiguous", 0.0), 3: (None, "none", 0.0), 4: (None, "none", 0.0),
        5: ("SOLUSDT", "text", 0.6), 6: ("ADAUSDT", "text", 0.9), 7: (None, "publisher_only", 0.0),
    }
    trusting = stories.resolve_instruments(events, universe, "event_id", "text", ["tickers"], require_mention=False).filter("event_id = 1").first()
    assert (trusting.instrument_id, trusting.entity_source, trusting.entity_confidence) == ("SOLUSDT", "publisher", 0.4)


def test_kinds_sentiment_and_metrics(spark):
    """The first kind that fits, terms at the start of words only, publishers' tags last, what is known by a time."""
    from tidemill.operators import news

    rows = [
        (0, "Exchange WILL LIST abc", 1, "A", 0), (1, "Bridge hacked, token delisted", 0, "A", 50), (2, "the ranch bans nothing", None, "A", 3500), (3, "交易所上币 利好", 2, "A", 3601),
        (4, None, 2, "B", 10), (5, "unlist", None, None, 10), (6, "rally, surge and crash", 2, "B", 5000), (7, "later", 1, "A", -5),
    ]
    df = spark.createDataFrame(rows, "event_id long, text string, tendency int, instrument_id string, age int").withColumn("available_time", F.timestamp_seconds(F.lit(1_000_000) - F.col("age")))
    found = news.sentiment(news.classified(df, "text"), "text", tendency="tendency").withColumns({"is_duplicate": F.lit(False), "repost_count": F.col("event_id")})
    got = {r.event_id: r for r in found.collect()}
    assert [got[k].event_type for k in range(8)] == ["listing", "security_incident", "regulation", "listing", "unclassified", "unclassified", "unclassified", "unclassified"]
    assert got[1].matched_terms == ["hack"] and got[2].matched_terms == ["ban"] and got[0].expected_half_life_seconds == 1800
    assert [(got[k].sentiment_score, got[k].sentiment_confidence, got[k].sentiment_source, got[k].sentiment_label) for k in (0, 1, 3, 4, 5, 6)] == [
        (0.6, 0.5, "event_type", "bullish"), (-0.94, 0.47, "lexicon", "bearish"), (0.88, 0.47, "lexicon", "bullish"), (-0.5, 0.3, "publisher", "neutral"),
        (0.0, 0.0, "none", "neutral"), (0.2333, 0.71, "lexicon", "bullish"),
    ]
    assert [got[k].sentiment_disagrees_with_publisher for k in (0, 3, 6)] == [False, True, True]
    metrics = {(r.instrument_id, r.metric): r.value for r in news.news_metrics(found, F.timestamp_seconds(F.lit(1_000_000)), {"1h": 3600}).collect()}
    assert metrics["A", "news_count_1h"] == 3 and metrics["B", "news_count_1h"] == 1 and metrics["A", "news_seconds_since_last"] == 0
    assert metrics["A", "news_bull_ratio_1h"] == pytest.approx(1 / 3) and metrics["A", "news_repost_max_1h"] == 2 and ("B", "news_bull_ratio_1h") not in metrics
    assert news.news_metrics(found.limit(0)).count() == 0
