"""Source divergence: against SQL, with small blocks and chunks, and on odd tables."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string"


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(divergence.SQL).fetchall())


def by_spark(docs, **sizes):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, **sizes).collect())


def odd_rows():
    rng = random.Random(5)
    vocabulary = [rng.choice(["", "É", "ß"]) + "".join(rng.choice("abcXYZ") for _ in range(rng.randint(1, 4))) for _ in range(90)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ü", None, "z" * 30])) for k in range(240)]
    rows += [(1, "same words\x00here,12same", "fr", "hot")] * 40 + [(None, None, "fr", "without"), (3, "", "fr", ""), (4, "few words", "it", "x"), (5, None, "it", "y"), (6, "12 .", "it", None)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "chunk": 4}, {"block": 1, "chunk": 1000}])
def test_equals_sql(spark, sizes):
    """Whatever the sizes of blocks and chunks; a chunk of 4 terms makes several spans."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("clash")).withColumn("n", F.lit(None).cast("int")).withColumn("term", F.lit(1))
    want = by_sql(rows)
    assert by_spark(docs, **sizes) == want
    assert {r[0] for r in want} == {"", "de", "en", "fr", "it"} and all(r[4] == 0 for r in want if r[0] == "it")


def test_empty_table(spark):
    assert by_spark(spark.createDataFrame([], SCHEMA)) == []


def test_long_texts_are_taken_in_slices():
    data = b"ab cd " * 50 + b"e" * 40 + b" fg"
    for most in (1, 7, 30, 1000):
        parts = list(divergence.slices(data, most))
        assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


def test_shares_are_exact():
    count, whole = np.array([0, 7, 123456789012345, 8_999_999_999_999_000]), 8_999_999_999_999_998
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (int(c) + 2) // whole for c in count]


def test_shares_in_spark_are_exact_on_both_sides_of_a_product_in_64_bits(spark):
    whole = 8_999_999_999_999_998
    counts = [0, 7, divergence.AT_ONCE - 1, divergence.AT_ONCE, 9_223_372_035, 123456789012345, 8_999_999_999_999_000]
    got = spark.createDataFrame([(c, w) for c in counts for w in (whole, c + 5)], "c bigint, w bigint").select("c", "w", divergence.share(F.col("c"), F.col("w")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.c + 2) // r.w for r in got]


def test_counts_leave_a_task_as_columns(spark):
    """One row for each group and term, in Arrow's columns, whatever leaves a task early."""
    times, holders = divergence.Counter([b"x", b"y", b"x"]), divergence.Counter([b"x", b"y"])
    (batch,) = divergence.given({("en", "a"): (times, holders), ("en", ""): (divergence.Counter(), divergence.Counter())})
    assert batch.to_pylist() == [{"lang": "en", "source": "a", "term": t, "n": n, "docs": 1} for t, n in ((b"x", 2), (b"y", 1))]
    rows = [(k, f"Same word {k % 3} \u00c9t\u00e9" + " b" * k, "en", "a" if k % 2 else None) for k in range(9)]
    got = {(r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "same"): (4, 4), ("a", "word"): (4, 4), ("a", "\u00c9t\u00e9"): (4, 4), ("a", "b"): (16, 4), ("", "same"): (5, 5), ("", "word"): (5, 5), ("", "\u00c9t\u00e9"): (5, 5), ("", "b"): (20, 4)}


def test_only_kept_terms_are_written(spark, monkeypatch):
    """Rare terms are dropped before anything is written out."""
    written = []
    plain = divergence.cut
    monkeypatch.setattr(divergence, "cut", lambda df: written.append(plain(df)) or written[-1])
    rows = [(k, f"common rare{chr(97 + k)}", "en", "ab"[k % 2]) for k in range(12)]
    assert by_spark(spark.createDataFrame(rows, SCHEMA)) == by_sql(rows)
    assert {r.term for df in written if "term" in df.columns for r in df.collect()} == {"common"}
