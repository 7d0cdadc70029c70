"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a Boolean column that is true where a document must go. A bounded sample gives the
cost of each rule (time to evaluate it) and its selectivity (share of rows it rejects); rules then
run in the order of rejection per cost, and a rule runs only on rows that all earlier rules have
let through. The verdict does not depend on the order.

Defined results: a null or blank text has no words and fails the base rule; ties do not arise; a
repeated row gets the same verdict each time; extra columns pass through `apply_rules`, and one that
is named like a result stays under its name with `_input` behind it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, aside, let, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """`rejects` is true where a row fails the rule; null counts as passed."""

    name: str
    rejects: Column


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def matching_chars(text: Column, char_class: str) -> Column:
    """Number of characters in a class: what is lost when they are taken out."""
    return char_count(text) - char_count(F.regexp_replace(text, char_class + "+", ""))


def repeated_words(word_array: Column) -> Column:
    """Words inside windows of eight words that occur at least twice in the text.

    Window hashes are built by doubling (2, 4, 8 words), and only a text with a repeated hash is
    sorted to find where the windows stand.
    """

    def covered(h8: Column) -> Column:
        placed = F.array_sort(F.transform(h8, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            hit = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.array_sort(F.transform(hit, lambda x: x["p"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(placed, positions), length)

    def count(h1: Column) -> Column:
        n = F.size(h1)
        h2 = let(h1, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))
        h4 = let(h2, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 2))))
        h8 = let(h4, lambda h: F.transform(F.filter(h, lambda x, i: i <= n - WINDOW), lambda x, i: F.xxhash64(x, F.get(h, i + 4))))
        return let(h8, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    return F.when(F.size(word_array) < WINDOW, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def line_counts(text: Column) -> Column:
    """Struct of lines with a word and of those equal to an earlier line."""
    blank = F.lit(SPACES)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, blank)) > 0)
    return let(
        lines,
        lambda a: F.struct(
            F.size(a).cast("long").alias("n_lines"),
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        ),
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules read: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.col(text_col)
    return (
        docs.withColumn("_tm_words", words(text))
        .withColumn("_tm_lines", line_counts(text))
        .withColumn("n_words", F.size("_tm_words").cast("long"))
        .withColumn("word_chars", char_count(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")))
        .withColumn("n_symbols", matching_chars(text, SYMBOLS))
        .withColumn("n_lines", F.col("_tm_lines.n_lines"))
        .withColumn("n_dup_lines", F.col("_tm_lines.n_dup_lines"))
        .withColumn("n_repeat_words", repeated_words(F.col("_tm_words")))
        .drop("_tm_words", "_tm_lines")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules over the counts of `with_statistics` and over the text itself.

    Shouting: more than 40 % of a text's characters are capital letters. Symbols: more than one
    for every ten words. Repeated lines: more than 30 %. Word length: a mean outside 2 to 15.
    Words without a letter: more than 30 %.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    no_letter = F.size(F.filter(words(text), lambda w: ~w.rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")))
    return [
        Rule("shouting", 100 * matching_chars(text, "[A-Z]") > 40 * F.col("word_chars")),
        Rule("letterless words", 100 * no_letter > 30 * F.col("n_words")),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("word length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds, rejected share) by falling rejection per cost, from a bounded sample of the texts."""
    texts = docs.select(text_col)
    total = texts.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = with_statistics(texts.sample(min(1.0, sample_rows / total), seed).limit(4 * sample_rows), text_col).persist()
    try:
        shares = sample.agg(*[F.avg(F.coalesce(r.rejects, F.lit(False)).cast("int")).alias(f"r{i}") for i, r in enumerate(rules)]).first()

        def seconds(column: Column) -> float:
            began = time.perf_counter()
            sample.agg(F.sum(column.cast("int"))).first()
            return time.perf_counter() - began

        seconds(F.lit(True))
        empty = seconds(F.lit(True))
        found = [(r, max(seconds(r.rejects) - empty, 1e-4), shares[i] or 0.0) for i, r in enumerate(rules)]
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def verdict(ordered: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only if the earlier ones have passed."""
    kept = F.lit(True)
    for rule in reversed(ordered):
        kept = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False)).otherwise(kept)
    return kept


def apply_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Add the statistics, base_failed and kept to every row."""
    rules = default_rules(text_col) if rules is None else rules
    columns = with_statistics(docs.select(*aside(docs, RESULTS)), text_col)
    ordered = [r for r, _, _ in order_rules(docs, rules, text_col, sample_rows)]
    failed = base_failed()
    return columns.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(ordered))
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
win AS (SELECT r, p, string_agg(word, ' ') OVER eight AS s, count(*) OVER eight AS n FROM w
        WINDOW eight AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM win WHERE n = 8) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
          FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT d.doc_id, d.text, len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')) AS n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(l.n_lines, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM d LEFT JOIN lines l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT 100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 40 * word_chars
  AND NOT 10 * n_symbols > n_words AND NOT 100 * n_dup_lines > 30 * n_lines
  AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
  AND NOT 100 * len(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'),
      lambda x: NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) > 30 * n_words AS kept
FROM f
"""
