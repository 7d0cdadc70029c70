"""Near-duplicate lines by a deletion-neighbourhood join.

A line is its sequence of words (A-Z as a-z, white space ignored); blank lines always stay. A line
goes if an earlier line, in the order of document and then place, is equal to it, or, where both
have at least `min_words` words, lies within an edit distance of one word (one word replaced,
inserted or left out). "Earlier" counts removed lines too, so the result does not depend on any
order of work.

1. One pass hashes all lines; equal lines become one by an aggregation.
2. A line within one edit of another shares its first or its last half with it. Only lines whose
   half occurs in another line go on (this loses nothing).
3. Those emit all their one-word deletions as hashed keys. Two lines of one length that agree after
   the word at the same place is left out differ by a replacement: the earliest line of each key is
   found by an aggregation. A line that equals a deletion of another differs by an insertion: each
   key has one such line, so that join is linear. No group of lines is ever paired with itself.
4. Each match is verified on the word sequences themselves.

Defined results: null texts stay null and blank ones stay as they are; documents with equal or null
ids are ordered by a row number; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemill.llm.common import cut, small, with_row_key
from tidemill.llm.textvec import LOWER, chunks, mix, words_of

MIN_WORDS = 8
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def lines_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, and for each line with a word: its text, its number, its first word.

    The last array has one entry more, the end of the last line.
    """
    hashes, bounds = words_of(texts)
    per_line = [[len(line.split()) for line in t.encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")] if t else [0] for t in texts]
    counts = np.concatenate([np.array(c, np.int64) for c in per_line]) if per_line else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), [len(c) for c in per_line])
    number = np.concatenate([np.arange(len(c)) for c in per_line]) if per_line else text
    full = counts > 0
    starts = np.concatenate(([0], np.cumsum(counts[full])))
    assert starts[-1] == len(hashes) == bounds[-1]
    return hashes, text[full], number[full], starts


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of value * step^i, the powers of the step, and those of its inverse."""
    n = len(values) + 1
    up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, s)))) for s in (_STEP, _STEP_INVERSE))
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, up, down


def line_rows(texts: list) -> pd.DataFrame:
    """One row per line with words: text, no, n, a 128-bit identity (h1, h2) and up to four half keys."""
    hashes, text, number, starts = lines_of(texts)
    a, b = starts[:-1], starts[1:]
    n = b - a
    sums, _, down = prefix_sums(hashes)
    other, _, _ = prefix_sums(mix(hashes ^ np.uint64(0xA5A5A5A5)))
    part = lambda s, x, y: (s[y] - s[x]) * down[x]
    length = n.astype(np.uint64)
    out = pd.DataFrame({"text": text, "no": number.astype(np.int32), "n": n.astype(np.int32)})
    out["h1"], out["h2"] = (mix(part(s, a, b) + length).view(np.int64) for s in (sums, other))
    for k, (m, front) in enumerate(((n // 2, True), (n // 2, False), ((n + 1) // 2, True), ((n + 1) // 2, False))):
        half = part(sums, a, a + m) if front else part(sums, b - m, b)
        out[f"k{k}"] = mix(half * np.uint64(4) + m.astype(np.uint64) * np.uint64(2) + np.uint64(front)).view(np.int64)
    return out


def all_lines(keyed: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch["text"].tolist(), batch["row"].to_numpy()
            for x, y in chunks(texts):
                got = line_rows(texts[x:y])
                got.insert(0, "row", rows[x:y][got.pop("text")])
                yield got

    chosen = keyed.select(F.col("_tm_row").alias("row"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(run, "row bigint, no int, n int, h1 bigint, h2 bigint, k0 bigint, k1 bigint, k2 bigint, k3 bigint")


def line_words(keyed: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(row, no, words): word hashes of the wanted lines (row, nos)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for x, y in chunks(texts):
                hashes, text, number, starts = lines_of(texts[x:y])
                nos = [set(v) for v in batch["nos"].iloc[x:y]]
                rows = batch["row"].to_numpy()[x:y]
                take = [k for k in range(len(text)) if number[k] in nos[text[k]]]
                yield pd.DataFrame({
                    "row": rows[text[take]], "no": number[take].astype(np.int32),
                    "words": [hashes[starts[k] : starts[k + 1]].view(np.int64) for k in take],
                })

    chosen = keyed.select(F.col("_tm_row").alias("row"), F.col(text_col).alias("text")).join(small(wanted), "row")
    return chosen.select("row", "text", "nos").mapInPandas(run, "row bigint, no int, words array<bigint>")


def deletions(words: DataFrame) -> DataFrame:
    """(key, at, row, no): the hash of a line without its word number `at`; at = -1 is the whole line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in range(0, len(batch), 512):
                part = batch.iloc[x : x + 512]
                keys, at = [], []
                for w in part["words"]:
                    w = np.asarray(w, np.int64).view(np.uint64)
                    sums, _, _ = prefix_sums(w)
                    shorter = mix(sums[:-1] + (sums[-1] - sums[1:]) * _STEP_INVERSE + np.uint64(len(w) - 1))
                    keys.append(np.concatenate((mix(sums[-1:] + np.uint64(len(w))), shorter)).view(np.int64))
                    at.append(np.arange(-1, len(w), dtype=np.int32))
                sizes = [len(k) for k in keys]
                yield pd.DataFrame({
                    "key": np.concatenate(keys), "at": np.concatenate(at),
                    "row": np.repeat(part["row"].to_numpy(), sizes), "no": np.repeat(part["no"].to_numpy(), sizes),
                })

    return words.mapInPandas(run, "key bigint, at int, row bigint, no int")


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """True if the edit distance of two sequences is at most one."""
    short, n, m = min(len(a), len(b)), len(a), len(b)
    if abs(n - m) > 1:
        return False
    differ = np.flatnonzero(a[:short] != b[:short])
    if not len(differ):
        return True
    p = differ[0]
    return bool(np.array_equal(a[p + (n >= m) :], b[p + (m >= n) :]))


@F.pandas_udf(BooleanType())
def verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def near_matches(keyed: DataFrame, reps: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """(row, no) of those distinct lines that an earlier distinct line matches within one edit."""
    halves = reps.filter(F.col("n") >= min_words).select("row", "no", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("key"))
    crowded = halves.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    wanted = halves.join(crowded, "key", "left_semi").select("row", "no").distinct().groupBy("row").agg(F.collect_list("no").alias("nos"))
    words = cut(line_words(keyed, cut(wanted), text_col))
    # one shuffle by key; within it, rows sorted by place let running windows see the earliest and the whole line
    pos, place = F.struct("row", "no"), ["row", "no"]
    same = Window.partitionBy("key", "at").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    of_key = Window.partitionBy("key").orderBy("at", *place).rowsBetween(Window.unboundedPreceding, 0)
    seen = deletions(words).repartition("key").select(
        "at", pos.alias("pos"), F.first(pos).over(same).alias("first"), F.first(F.when(F.col("at") == -1, pos), True).over(of_key).alias("whole")
    )
    replaced = F.when(F.col("pos") != F.col("first"), F.struct("pos", F.col("first").alias("by")))
    inserted = F.when(F.col("whole").isNotNull(), F.struct(F.greatest("pos", "whole").alias("pos"), F.least("pos", "whole").alias("by")))
    matches = (
        seen.filter("at >= 0 and (pos != first or whole is not null)")
        .select(F.explode(F.array(replaced, inserted)).alias("m")).filter("m is not null")
        .groupBy("m.pos").agg(F.min("m.by").alias("by"))
        .select("pos.row", "pos.no", F.col("by.row").alias("by_row"), F.col("by.no").alias("by_no"))
    )
    theirs = words.select(F.col("row").alias("by_row"), F.col("no").alias("by_no"), F.col("words").alias("by_words"))
    return matches.join(words, ["row", "no"]).join(theirs, ["by_row", "by_no"]).filter(verified("words", "by_words")).select("row", "no")


def duplicate_lines(keyed: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, no, near): the lines that go from a table with the long key `_tm_row`; near is false for equal lines."""
    lines = cut(all_lines(keyed, text_col))
    keys = [F.min(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")]  # equal in all lines of a group
    reps = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("row", "no")).alias("first"), F.count("*").alias("copies"), *keys).select("h1", "h2", "copies", "first.row", "first.no", "n", "k0", "k1", "k2", "k3"))
    near = cut(near_matches(keyed, reps, text_col, min_words))
    marked = reps.join(near.withColumn("near", F.lit(True)), ["row", "no"], "left").select(
        "h1", "h2", "copies", F.struct("row", "no").alias("first"), F.coalesce("near", F.lit(False)).alias("near")
    )
    odd = marked.filter("near or copies > 1").drop("copies")
    return (
        lines.select("row", "no", "h1", "h2").join(odd, ["h1", "h2"])
        .filter("near or struct(row, no) != first")
        .select("row", "no", "near")
    )


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the text that is left, and `_tm_exact`, `_tm_near`: the numbers of lines that went."""
    keyed = with_row_key(docs, id_col)
    gone = cut(duplicate_lines(keyed.select("_tm_row", text_col), text_col, min_words))
    per_doc = gone.groupBy("row").agg(
        F.collect_list("no").alias("_tm_nos"), F.count_if(~F.col("near")).alias("_tm_exact"), F.count_if("near").alias("_tm_near")
    ).withColumnRenamed("row", "_tm_row")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("_tm_nos", i))
    text = F.when(F.col("_tm_nos").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return keyed.join(per_doc, "_tm_row", "left").select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(F.split(F.col(text_col), "\n", -1)).alias("_tm_lines"),
        F.coalesce("_tm_exact", F.lit(0)).alias("_tm_exact"), F.coalesce("_tm_near", F.lit(0)).alias("_tm_near"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_lines(docs).select(
        "doc_id", F.coalesce("_tm_lines", F.lit(0)).cast("long").alias("n_lines"), F.col("_tm_exact").alias("n_exact"), F.col("_tm_near").alias("n_near"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
w AS (SELECT doc_id, no, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
full_line AS (SELECT doc_id * 1000000 + no AS pos, w, len(w) AS n, array_to_string(w, ' ') AS s FROM w WHERE len(w) > 0),
rep AS (SELECT s, min(pos) AS pos, any_value(w) AS w, any_value(n) AS n FROM full_line GROUP BY s),
places AS (SELECT pos, n, w, s, unnest(range(1, n + 1)) AS i FROM rep WHERE n >= 8),
del AS (SELECT pos, n, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ')) AS v FROM places),
sub AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY v, i, n) AS e FROM del) WHERE e < pos),
ins AS (SELECT greatest(del.pos, r.pos) AS pos FROM del JOIN rep r ON md5(r.s) = del.v AND r.n = del.n - 1 WHERE r.n >= 8),
near AS (SELECT pos FROM sub UNION SELECT pos FROM ins),
verdict AS (SELECT f.pos, n.pos IS NOT NULL AS near, r.pos <> f.pos AS copy FROM full_line f JOIN rep r USING (s) LEFT JOIN near n ON n.pos = r.pos),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS text FROM l LEFT JOIN verdict v ON v.pos = l.doc_id * 1000000 + l.no
         WHERE NOT coalesce(v.near OR v.copy, false) GROUP BY l.doc_id),
counted AS (SELECT pos // 1000000 AS doc_id, count(*) FILTER (WHERE near) AS n_near, count(*) FILTER (WHERE copy AND NOT near) AS n_exact FROM verdict GROUP BY 1)
SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
