"""Spelling variants: words within one edit of each other, found through a positional q-gram index.

1. One pass counts words; tasks keep counts and give them away when they are many.
2. A word is the list of its grams of `WIDTH` characters with their places, padded at both ends, and its
   grams are ordered by how rare they are. One edit changes at most `WIDTH` grams, so that of two near
   words each has one of its first `WIDTH` + 1 grams among those of the other. These stand in the index.
3. The index is dealt out by gram and length: a shard has the words of one length for which the gram is
   one of their first, and those of that length and of one less as its queries. Crowded shards are parted
   into tiles of two blocks of about `BLOCK` words.
4. In a tile, postings of all grams of a query under its length and position limits are merged: since nearly
   all must agree, a near word stands in one of the shortest few lists. These are merged on a heap, and the others
   asked until the bound on shared grams is met or out of reach. What reaches it is verified.
5. A pair counts in the shard of the first gram that both index. Tasks give one row for each word: how many
   near words it has there, and the most frequent; no pairs are shuffled.

Words get as form their most frequent near word if that is `RATIO` times as frequent, and as root the end
of the chain of forms, by pointer doubling.

Defined results: a null text has no words; a null id counts as empty text; repeated rows count each; words
below the least length or count are no words; ties of frequency go to the smaller word in the order of
code points; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import cut, small
from tidemill.llm.divergence import slices

WIDTH = 3
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
BLOCK = 20_000
#: Grams are told apart by so many bits of a hash; equal ones only make more candidates.
GRAM_BITS = 18
#: Counts that a task holds before it gives them away.
HELD = 300_000
#: What a word is in a tile: indexed and a query, indexed only, a query only.
BOTH, HELD_ONLY, ASKS = range(3)
#: Pads of a word's begin and end.
BEGIN, END = "\x00", "\x01"

#: Latin-1 bytes of runs: letters, A-Z as a-z, and C0 to FF; everything else parts them.
RUN_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = 0) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z as a-z, with their frequencies.

    With `slip` above 0, a run loses a character in those documents where that number divides the
    CRC-32 of `<id>:<run>`: misspellings that are known, to measure what is found.
    """
    chosen = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, int] = {}

        def given() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in found], "n": list(found.values())})

        for batch in batches:
            for own, text in zip(batch["id"], batch["text"], strict=True):
                start = zlib.crc32(f"{own}:".encode())
                for part in slices(text.encode("latin-1", "replace").translate(RUN_BYTES)):
                    for word, n in Counter([w for w in part.split() if len(w) >= least_length]).items():
                        if slip:
                            code = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                            if code % slip == 0:
                                at = code % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                        found[word] = found.get(word, 0) + n
                if len(found) >= HELD:
                    yield given()
                    found = {}
        if found:
            yield given()

    return chosen.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def grams(word: str, width: int = WIDTH) -> list[int]:
    """Hashes of the grams of a padded word, by place."""
    padded = BEGIN * (width - 1) + word + END * (width - 1)
    most = (1 << GRAM_BITS) - 1
    return [zlib.crc32(padded[k : k + width].encode("utf-8", "surrogatepass")) & most for k in range(len(word) + width - 1)]


def gram_frequencies(words: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How many times each gram occurs in all words: at most 2^GRAM_BITS numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << GRAM_BITS, np.int64)
        for batch in batches:
            for word in batch["word"]:
                np.add.at(n, grams(word, width), 1)
        held = np.flatnonzero(n)
        yield pd.DataFrame({"gram": held, "n": n[held]})

    found = words.select("word").mapInPandas(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << GRAM_BITS, np.int64)
    out[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def indexed(codes: list[int], frequency: np.ndarray, width: int = WIDTH) -> list[int]:
    """The rarest distinct grams of a word that make up `width` + 1 of its grams at least."""
    times, out, covered = Counter(codes), [], 0
    for code in sorted(times, key=lambda c: (frequency[c], c)):
        out.append(code)
        covered += times[code]
        if covered > width:
            break
    return out


def one_edit(a: str, b: str) -> bool:
    """True if exactly one character is replaced (equal lengths) or inserted (b is longer by one)."""
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a != b and a[k + (len(a) == len(b)) :] == b[k + 1 :]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers that stand in at least `least` of the rising lists.

    A number that so many hold stands in one of the shortest len(lists) - least + 1. These are merged on a heap; the longer lists
    are only asked, by bisection, until the bound is met or out of reach.
    """
    if len(lists) < least:
        return
    lists = sorted(lists, key=len)
    few = len(lists) - least + 1
    short, long, last, count = lists[:few], lists[few:], None, 0

    def reaches(x: int, count: int) -> bool:
        for k, own in enumerate(long):
            if count >= least or count + len(long) - k < least:
                break
            at = bisect_left(own, x)
            count += at < len(own) and own[at] == x
        return count >= least

    for x in heapq.merge(*short):
        if x == last:
            count += 1
            continue
        if last is not None and reaches(last, count):
            yield last
        last, count = x, 1
    if last is not None and reaches(last, count):
        yield last


def tile_pairs(length: int, index: list[str], queries: list[str], width: int = WIDTH) -> Iterator[tuple[str, int]]:
    """(query, place in the index) of all near pairs of a tile: queries have the length of the index or one less.

    Pairs of equal length come once for each of the two as query. A query's gram at a place may stand at that place or, in a
    longer word, one further on; `least` counts grams that agree, so a gram counts once wherever it stands.
    """
    begin, end = BEGIN * (width - 1), END * (width - 1)
    postings: list[dict[str, list[int]]] = [{} for _ in range(length + width)]
    for k, word in enumerate(index):
        padded = begin + word + end
        for place in range(length + width - 1):
            postings[place].setdefault(padded[place : place + width], []).append(k)
    least = length - 1  # of max length + width - 1 grams, one edit leaves all but `width`
    for word in queries:
        padded = begin + word + end
        if len(word) == length:
            lists = [x for place in range(length + width - 1) if (x := postings[place].get(padded[place : place + width]))]
        else:
            lists = []
            for place in range(length + width - 2):
                gram = padded[place : place + width]
                here, ahead = postings[place].get(gram), postings[place + 1].get(gram)
                if here and ahead:
                    lists.append(sorted({*here, *ahead}))
                elif here or ahead:
                    lists.append(here or ahead)
        for k in merged(lists, least):
            if one_edit(word, index[k]):
                yield word, k


def near_words(words: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n) for words (word, n), each once, that have a near one.

    Words need at least two characters, as shorter ones may share no gram with a near word.
    """
    frequency = words.sparkSession.sparkContext.broadcast(gram_frequencies(words, width))

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = [indexed(grams(w, width), frequency.value, width) for w in batch["word"]]
            yield batch.assign(length=[len(w) for w in batch["word"]], first=first)

    entries = words.select("word", "n").mapInPandas(posted, "word string, n bigint, length int, first array<int>")
    placed = entries.select("word", "n", "length", "first", F.posexplode("first").alias("at", "gram"))
    postings = cut(placed.select("word", "n", "length", "gram", F.slice("first", F.lit(1), F.col("at")).alias("rarer")))
    crowded = cut(postings.groupBy("gram", F.col("length").alias("shard")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1"))
    # a word is indexed at its own length, and asks there and at the next
    rows = postings.withColumn("r", F.explode(F.array(F.struct(F.col("length").alias("shard"), F.lit(BOTH).alias("role")), F.struct((F.col("length") + 1).alias("shard"), F.lit(ASKS).alias("role")))))
    rows = rows.select("gram", "r.shard", "r.role", "word", "n", "rarer").join(small(crowded), ["gram", "shard"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    held = F.transform(every, lambda k: F.struct(own.alias("left"), k.alias("right"), F.when(k == own, F.lit(BOTH)).otherwise(F.lit(HELD_ONLY)).alias("role")))
    asked = F.transform(every, lambda k: F.struct(k.alias("left"), own.alias("right"), F.lit(ASKS).alias("role")))
    tiled = F.when(F.col("role") == ASKS, asked).otherwise(F.concat(held, F.filter(asked, lambda t: t["left"] != own)))
    key = ["gram", "shard", "left", "right"]

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, index, queries, known, found = None, [], [], {}, {}

        def credit(word: str, near: str, n: int) -> None:
            have = found.get(word)
            if have is None:
                found[word] = [1, -n, near]
            else:
                have[0] += 1
                if (-n, near) < (have[1], have[2]):
                    have[1:] = -n, near

        def finish() -> None:
            if not index or not queries or index == queries and len(index) == 1:
                return
            for word, k in tile_pairs(now[1], index, queries, width):
                other = index[k]
                (n, rarer), (m, others) = known[word], known[other]
                # a rarer gram that both index is where the pair counts
                if not len(rarer) or not len(others) or set(rarer.tolist()).isdisjoint(others.tolist()):
                    credit(word, other, m)
                    if len(word) < len(other):
                        credit(other, word, n)

        def given() -> pd.DataFrame:
            return pd.DataFrame({"word": list(found), "n_near": [x[0] for x in found.values()], "near_n": [-x[1] for x in found.values()], "near": [x[2] for x in found.values()]})

        for batch in batches:
            columns = [batch[c].tolist() for c in ("role", "word", "n", "rarer")]
            for tile, role, word, n, rarer in zip(zip(*[batch[c].tolist() for c in key], strict=True), *columns, strict=True):
                if tile != now:
                    finish()
                    if len(found) >= HELD:
                        yield given()
                        found.clear()
                    now, index, queries, known = tile, [], [], {}
                known[word] = n, rarer
                if role != ASKS:
                    index.append(word)
                if role != HELD_ONLY:
                    queries.append(word)
        finish()
        if found:
            yield given()

    dealt = rows.select("gram", "shard", F.explode(tiled).alias("t"), "word", "n", "rarer").select("gram", "shard", "t.left", "t.right", "t.role", "word", "n", "rarer")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    parts = dealt.mapInPandas(tiles, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words (word, form) that have a form: the end of the chain, by pointer doubling.

    A form is more frequent than its word, so that chains end; each round doubles the steps.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = cut(now.join(ahead, "root", "left"))
        now = moved.select("word", F.coalesce("ahead", "root").alias("root"))
        if moved.filter("ahead is not null").isEmpty():
            return now


def group_spellings(words: DataFrame, ratio: int = RATIO, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of words (word, n)."""
    words = cut(words)
    found = words.join(near_words(words, width, block), "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_spellings(word_counts(docs, slip=97))
