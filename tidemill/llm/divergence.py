"""Source divergence audit: how far the words of sources of one language are apart, by two-dimensional tiling.

Terms of each language that enough of its documents hold are kept. Every (language, source) group and
every language gets smoothed shares of the kept terms in billionths; the divergence of two groups sums
(p - q)^2 / (p + q), rounded down, over the terms. All arithmetic is on whole numbers.

1. One pass counts terms: tasks keep counts by group and term and give them away when they are many, so
   that a source with a third of all rows arrives at the shuffle as counts. A term's counts meet once, to
   tell whether enough documents hold it and to number it; only what is kept is written.
2. Kept terms are dealt into chunks of about `CHUNK`; a group's counts in a chunk are one packed vector.
3. Groups are dealt into blocks of about `BLOCK`; each vector goes to the tiles (block by block) of its
   block. A tile reads its chunks one after the other, in sorted order, and holds no more than one chunk
   and its own submatrix. Long vocabularies are parted into spans of `SPAN` chunks, whose submatrices are
   added up.
4. A term that no group of a tile has in a chunk gives each pair the same value; those are counted, not
   visited.

Defined results: null text, language and source count as empty; each row is a document, repeated ones too;
a group without terms has the share of zero for each term; a language without kept terms gives pairs of
value 0 and no terms; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, small

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
CHUNK = 4096
BLOCK = 64
SPAN = 16
#: Counts that a task holds before it gives them away, and bytes of text that it has read by then;
#: bytes of one text that become terms at once.
HELD, HELD_BYTES = 200_000, 1 << 27
SLICE = 1 << 20
UNIT = 1_000_000_000
#: Below this a count and 2, times UNIT, is less than 2^63.
AT_ONCE = 9_000_000_000

#: Bytes of terms: letters (A-Z as a-z) and all bytes beyond ASCII; everything else parts them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def slices(data: bytes, most: int = SLICE) -> Iterator[bytes]:
    """Runs of about `most` bytes that end at a blank."""
    first = 0
    while first < len(data):
        last = first + most
        if last < len(data):
            last = max(data.rfind(b" ", first, last), first)
            last = last if last > first else data.find(b" ", first + most)
            last = len(data) if last < 0 else last
        yield data[first:last]
        first = last


def given(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """The rows of each group; its two counters hold the same terms in the same order."""
    for (lang, source), (times, holders) in found.items():
        if times:
            counts = (pa.array(np.fromiter(c.values(), np.int64, len(times))) for c in (times, holders))
            columns = [pa.repeat(lang, len(times)), pa.repeat(source, len(times)), pa.array(list(times), pa.binary()), *counts]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    chosen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    chosen = chosen.withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, size = {}, 0, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                times, holders = found.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(times), {}
                for part in slices(text.translate(TERM_BYTES)):
                    terms = part.split()
                    times.update(terms)
                    seen |= dict.fromkeys(terms)
                holders.update(iter(seen))
                held += len(times) - before
                size += len(text)
                if held >= HELD or size >= HELD_BYTES:
                    yield from given(found)
                    found, held, size = {}, 0, 0
        yield from given(found)

    partial = chosen.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint").withColumn("term", F.col("term").cast("string"))
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def whole_part(a: Column, b: Column) -> Column:
    """a / b rounded down, for whole numbers that are not negative."""
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """(p - q)^2 / (p + q), rounded down."""
    return whole_part((p - q) * (p - q), p + q)


def share(count: Column, whole: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / whole), by long division where the product needs it; exact for wholes below 9e15."""
    at_once = whole_part((count + 2) * UNIT, whole)
    left, found = count + 2, F.lit(0).cast("bigint")
    for _ in range(3):
        left = left * 1000
        found = found * 1000 + whole_part(left, whole)
        left = left % whole
    return F.when(count < AT_ONCE, at_once).otherwise(found) + 1


def shares(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """The same with numpy."""
    left, found = count + 2, 0
    for _ in range(3):
        more, left = np.divmod(left * 1000, whole)
        found = found * 1000 + more
    return found + 1


def tile_values(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sums of (p - q)^2 // (p + q) for each row of the first with each of the second."""
    out = np.zeros((len(first), len(second)), np.int64)
    for i, p in enumerate(first):
        gap = second - p
        out[i] = (gap * gap // (second + p)).sum(1)
    return out


class Tile:
    """One tile of one span: its groups, the sums so far, and the chunk that is being read."""

    def __init__(self) -> None:
        self.groups: tuple[list, list] = ([], [])
        self.sums, self.visited, self.chunk, self.rows = None, 0, None, []

    def add(self, side: int, row) -> None:
        self.groups[side].append((row.source, int(row.total), int(row.v)))

    def read(self, chunk: int, side: int, row) -> None:
        if self.sums is None:
            self.sums = np.zeros([len(g) for g in self.groups], np.int64)
            self.places = [{s: k for k, (s, _, _) in enumerate(g)} for g in self.groups]
        if chunk != self.chunk:
            self.close_chunk()
            self.chunk = chunk
        self.rows.append((side, self.places[side][row.source], row.places, row.counts))

    def close_chunk(self) -> None:
        if not self.rows:
            return
        present = np.unique(np.concatenate([r[2] for r in self.rows]))
        dense = [np.zeros((len(g), len(present)), np.int64) for g in self.groups]
        for side, k, places, counts in self.rows:
            dense[side][k, np.searchsorted(present, places)] = counts
        wholes = [np.array([n + 2 * v for _, n, v in g], np.int64).reshape(-1, 1) for g in self.groups]
        self.sums += tile_values(*[shares(d, w) for d, w in zip(dense, wholes, strict=True)])
        self.visited += len(present)
        self.rows = []

    def result(self, lang: str, diagonal: bool) -> Iterator[pd.DataFrame]:
        """The pairs of the tile, if it has any."""
        self.close_chunk()
        a, b = self.groups
        sums = self.sums if self.sums is not None else np.zeros((len(a), len(b)), np.int64)
        i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1)) if diagonal else np.nonzero(np.ones(sums.shape, bool))
        if len(i):
            yield pd.DataFrame({
                "lang": lang, "source": [a[k][0] for k in i], "item": [b[k][0] for k in j], "value": sums[i, j], "visited": self.visited,
                "source_total": [a[k][1] for k in i], "item_total": [b[k][1] for k in j], "v": [a[k][2] for k in i],
            })


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by tile, and in a tile by chunk, its groups (chunk -1) before its vectors."""
    key, tile = None, None
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = (row.lang, row.first_block, row.second_block, row.span)
            if own != key:
                if tile is not None:
                    yield from tile.result(key[0], key[1] == key[2])
                key, tile = own, Tile()
            sides = (0, 1) if row.first_block == row.second_block else (0,) if row.block == row.first_block else (1,)
            for side in sides:
                if row.chunk < 0:
                    tile.add(side, row)
                else:
                    tile.read(row.chunk, side, row)
    if tile is not None:
        yield from tile.result(key[0], key[1] == key[2])


def pair_values(groups: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, item, value) for the pairs of groups of one language, each once, smaller block first.

    `groups`: lang, source, total, v, block, blocks, spans. `held`: lang, source, chunk, place, n.
    """
    vectors = held.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("cells"))
    vectors = vectors.select("lang", "source", "chunk", F.transform("cells", lambda x: x["place"]).alias("places"), F.transform("cells", lambda x: x["n"]).alias("counts"))
    vectors = vectors.join(small(groups.select("lang", "source", "total", "v", "block", "blocks")), ["lang", "source"]).withColumn("span", F.floor(F.col("chunk") / SPAN).cast("int"))
    heads = groups.withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).withColumns({"chunk": F.lit(-1), "places": F.array().cast("array<bigint>"), "counts": F.array().cast("array<bigint>")})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ("lang", "first_block", "second_block", "span", "chunk", "block", "source", "total", "v", "places", "counts")
    rows = heads.unionByName(vectors, allowMissingColumns=True).withColumn("other", other)
    rows = rows.withColumns({"first_block": F.least("block", "other"), "second_block": F.greatest("block", "other")}).select(*columns)
    key = ("lang", "first_block", "second_block", "span")
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "chunk", "source")
    parts = dealt.mapInPandas(_tiles, "lang string, source string, item string, value bigint, visited bigint, source_total bigint, item_total bigint, v bigint")
    summed = parts.groupBy("lang", "source", "item", "source_total", "item_total", "v").agg(F.sum("value").alias("value"), F.sum("visited").alias("visited"))
    zero, p, q = F.lit(0).cast("bigint"), F.col("p"), F.col("q")
    both = F.col("v") > 0
    summed = summed.withColumns({"p": F.when(both, share(zero, F.col("source_total") + 2 * F.col("v"))), "q": F.when(both, share(zero, F.col("item_total") + 2 * F.col("v")))})
    rest = F.when(both, (F.col("v") - F.col("visited")) * gap(p, q)).otherwise(zero)
    return summed.select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for the other sources of the language, `term` rows for
    the terms that a source has more of than its language."""
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col)
    known = counts.withColumns({"lang_n": F.sum("n").over(term), "holders": F.sum("docs").over(term)}).filter(F.col("holders") >= least_documents)
    # a term is numbered by the least of its rows' numbers: its rows lie in one task, and the numbers are written out
    known = known.drop("docs", "holders").withColumn("number", F.monotonically_increasing_id()).withColumn("place", F.min("number").over(term))
    known = cut(known.withColumn("once", F.col("number") == F.col("place")).drop("number"))
    langs = known.groupBy("lang").agg(F.count_if("once").alias("v"), F.sum("n").alias("lang_total"))
    langs = small(cut(langs.withColumn("chunks", F.ceil(F.col("v") / chunk))))
    held = known.drop("once").join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(groups.join(totals, ["lang", "source"], "left"))
    numbers = small(cut(groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))))
    groups = groups.join(numbers, "lang").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"), F.coalesce("v", F.lit(0)).cast("bigint").alias("v"),
        F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), "blocks", F.coalesce(F.ceil(F.col("chunks") / SPAN), F.lit(1)).cast("int").alias("spans"),
    )
    groups = cut(groups)
    pairs = cut(pair_values(groups, held.select("lang", "source", "chunk", "place", "n")))
    pairs = pairs.union(pairs.select("lang", F.col("item"), F.col("source"), "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    p, q = F.col("p"), F.col("q")
    own = held.join(small(groups.select("lang", "source", "total")), ["lang", "source"])
    own = own.withColumns({"p": share(F.col("n"), F.col("total") + 2 * F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v"))})
    terms = own.filter(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(p, q).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)
    return pairs.union(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), terms AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, COUNT(*)::HUGEINT AS n FROM terms GROUP BY lang, term HAVING COUNT(DISTINCT row) >= 10
), counts AS (
    SELECT lang, source, term, COUNT(*)::HUGEINT AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
    SELECT lang, COUNT(*) AS v, SUM(n) AS total FROM kept GROUP BY lang
), sources AS (
    SELECT DISTINCT lang, source FROM docs
), totals AS (
    SELECT s.lang, s.source, COALESCE(SUM(c.n), 0) AS total FROM sources s LEFT JOIN counts c USING (lang, source) GROUP BY s.lang, s.source
), shares AS (
    SELECT t.lang, t.source, k.term, COALESCE(c.n, 0) AS n,
        (1 + 1000000000 * (COALESCE(c.n, 0) + 2) // (t.total + 2 * l.v))::HUGEINT AS p,
        (1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v))::HUGEINT AS q
    FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
