"""Spelling variants: against brute force, with small blocks, and on odd tables."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import spelling

SCHEMA = "doc_id bigint, text string"


def counted(rows, slip=97):
    n = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if own is None else own}:{word}".encode())
            if h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def grouped(n):
    """All words that one insertion or replacement makes are looked up."""
    near, letters = {w: set() for w in n}, set("".join(n))
    for w in n:
        for k in range(len(w) + 1):
            for x in [w[:k] + c + w[k + d :] for c in letters for d in (0, 1)]:
                if x != w and x in n and len(x) >= len(w):
                    near[w].add(x)
                    near[x].add(w)
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, small_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{small_dir}/documents.parquet')").fetchall()
    want = grouped(counted(rows))
    assert rows_of(spelling.query(spark, small_dir)) == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] not in (None, r[2]) for r in want)


@pytest.mark.parametrize("block", [3, 20_000])
def test_crowded_shards(spark, block):
    """A third of the words share their grams; tiles of three words give the same as whole shards."""
    rng = random.Random(3)
    words = {"aaaaa" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4))): rng.randint(3, 90) for _ in range(60)}
    words |= {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))): rng.randint(3, 90) for _ in range(120)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert rows_of(spelling.group_spellings(table, block=block)) == grouped(words)


def test_odd_rows(spark):
    rows = [(None, "Wörter WÖRTER wörter"), (1, None), (1, ""), (2, "Straße straße, STRAße!ſtraße"), (2, "x" * 3000 + " " + "y1" * 500)]
    rows += [(3, "again again")] * 2 + [(4, "Ārticle article\x00article日article article" + " agaim" * 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("id", F.lit(0))
    found = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert found == counted(rows, slip=1 << 40)
    assert rows_of(spelling.group_spellings(spelling.word_counts(docs))) == grouped(found)
    assert spelling.group_spellings(spelling.word_counts(spark.createDataFrame([], SCHEMA))).count() == 0


def test_merge_finds_what_counting_finds():
    rng = random.Random(11)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        least = rng.randint(1, 8)
        times = Counter(x for own in lists for x in own)
        assert list(spelling.merged(lists, least)) == sorted(x for x, k in times.items() if k >= least)


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "xabc") and spelling.one_edit("abc", "abcc")
    assert not any(spelling.one_edit(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcde"[1:]), ("aab", "bbb")))
