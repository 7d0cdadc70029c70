"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts gives for each document the fingerprint of its shingle set, band keys
   from its minima, and the low `BITS` bits of all minima, packed into four longs.
2. Documents with equal sets become one class by an aggregation, however many copies there are.
3. Classes that share a band key are candidates. Within a bucket, pairs are never all listed: first
   one hub is tested against the members, and what is linked falls into components. Buckets that
   still hold members of unlike components are then compared in tiles of two blocks each, inside
   tasks: only links come out. So no link that joins two components is lost, and no task holds more
   than two blocks.
4. A candidate pair must pass the size bound and the similarity estimated from bit counts
   (corrected for chance collisions, with six standard deviations of slack); then the whole sets
   decide.
5. Components of the links are found by star contraction.

With 32 bands of four minima, a pair at similarity 0.8 shares no band with probability 5e-8.

Defined results: documents without text or words have an empty set, are linked with nothing and
form components of their own; rows with a null id take part, and a component of such rows alone has
a null id; repeated rows are copies; an empty table gives an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut, small, with_row_key
from tidemill.llm.graph import connected_components
from tidemill.llm.textvec import mix, shingle_sets

BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
#: Members of a block of a bucket, and shingles of all of them, that a tile compares with another block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Chance that the low bits of two unequal minima agree.
CHANCE = 2.0**-BITS

_A, _B = np.random.default_rng(8).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64)
_A |= np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES minima for each (nonempty) set."""
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((HASHES, len(sets)), np.uint64)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((values * _A[k] + _B[k]) >> np.uint64(32), starts)
    return out.T


def band_keys(m: np.ndarray) -> np.ndarray:
    grouped = m.reshape(len(m), BANDS, ROWS)
    keys = np.zeros((len(m), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return keys.view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of all minima, 32 minima to a long."""
    low = (m & np.uint64(2**BITS - 1)).reshape(len(m), -1, 64 // BITS)
    return (low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def signatures(keyed: DataFrame, text_col: str, width: int) -> DataFrame:
    """(row, n, fp, bands, bits) of every row; fp, bands and bits are null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, rows = 0, batch["row"].to_numpy()
            for sets in shingle_sets(batch["text"].tolist(), width):
                full = [i for i, s in enumerate(sets) if len(s)]
                out = pd.DataFrame({"row": rows[at : at + len(sets)], "n": [len(s) for s in sets]})
                for c in ("fp", "bands", "bits"):
                    out[c] = pd.Series([None] * len(sets), dtype=object)
                if full:
                    m = minima([sets[i] for i in full])
                    for c, values in (("fp", [xxhash.xxh3_128_digest(sets[i].tobytes()) for i in full]), ("bands", list(band_keys(m))), ("bits", list(packed_bits(m)))):
                        column = np.empty(len(sets), object)
                        for i, v in zip(full, values, strict=True):
                            column[i] = v
                        out[c] = column
                at += len(sets)
                yield out

    chosen = keyed.select(F.col("_tm_row").alias("row"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(run, "row bigint, n bigint, fp binary, bands array<bigint>, bits array<bigint>")


def whole_sets(keyed: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """(fp, members): the full shingle sets of the wanted rows (row, fp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch["text"].tolist(), width):
                yield pd.DataFrame({"fp": batch["fp"].iloc[at : at + len(sets)].array, "members": [s.view(np.int64) for s in sets]})
                at += len(sets)

    chosen = keyed.select(F.col("_tm_row").alias("row"), F.col(text_col).alias("text")).join(small(wanted), "row").select("fp", "text")
    return chosen.mapInPandas(run, "fp binary, members array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits, corrected for chance collisions."""
    unequal = F.lit(0)
    for k in range(HASHES * BITS // 64):
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        unequal = unequal + F.bit_count(pairs)
    return (1 - unequal / HASHES - CHANCE) / (1 - CHANCE)


def slack(threshold: float) -> float:
    """Six standard deviations of the estimate at the threshold."""
    p = CHANCE + (1 - CHANCE) * threshold
    return 6 * (p * (1 - p) / HASHES) ** 0.5 / (1 - CHANCE)


def linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets have 100 * intersection >= percent * union, as (u, v)."""
    about = lambda s: classes.select(F.col("fp").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    whole = lambda s: sets.select(F.col("fp").alias(s), F.col("members").alias(f"members_{s}"))
    threshold = percent / 100
    likely = (
        pairs.join(about("a"), "a")
        .join(about("b"), "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .filter(estimate(F.col("bits_a"), F.col("bits_b")) >= threshold - slack(threshold))
        .select("a", "b", "n_a", "n_b")
    )
    shared = F.size(F.array_intersect("members_a", "members_b"))
    return (
        likely.join(whole("a"), "a")
        .join(whole("b"), "b")
        .withColumn("_shared", shared)
        .filter(100 * F.col("_shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("_shared")))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def links_of_tile(tile: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (u, v) between members of one bucket that are in unlike components.

    A tile compares two blocks of a bucket (or one with itself). Bit counts come first, as a matrix;
    then a pair is taken up in the first band that both share only, so that no other bucket repeats
    it, and unless both are linked by now, the whole sets decide.
    """
    found: list[tuple[bytes, bytes]] = []
    bits, bands = (np.stack(tile[c].to_numpy()).astype(np.int64).view(np.uint64) for c in ("bits", "bands"))
    n, block = tile["n"].to_numpy(), tile["block"].to_numpy()
    roots, fps, members = tile["root"].tolist(), tile["fp"].tolist(), [np.asarray(m, np.int64).view(np.uint64) for m in tile["members"]]
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    root = np.array([number[r] for r in roots])
    parent = list(range(len(number)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    band = int(np.flatnonzero(bands[0].view(np.int64) == tile["key"].iloc[0])[0])
    first, second = tile["first"].iloc[0], tile["second"].iloc[0]
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    threshold = percent / 100 - slack(percent / 100)
    ones = np.uint64(0x5555555555555555)
    for at in range(0, len(left), 256):
        x = left[at : at + 256]
        differ = bits[x][:, None, :] ^ bits[right][None, :, :]
        unequal = np.bitwise_count((differ | (differ >> np.uint64(1))) & ones).sum(axis=2, dtype=np.int64)
        likely = (1 - unequal / HASHES - CHANCE) / (1 - CHANCE) >= threshold
        likely &= (root[x][:, None] != root[right][None, :]) & (100 * np.minimum(n[x][:, None], n[right][None, :]) >= percent * np.maximum(n[x][:, None], n[right][None, :]))
        if first == second:
            likely &= x[:, None] < right[None, :]
        i, j = np.nonzero(likely)
        order = np.argsort(unequal[i, j], kind="stable")
        i, j = x[i[order]], right[j[order]]
        own = (bands[i] == bands[j]).argmax(axis=1) == band
        for p, q in zip(i[own].tolist(), j[own].tolist(), strict=True):
            a, b = top(root[p]), top(root[q])
            if a != b:
                small_set, large_set = sorted((members[p], members[q]), key=len)
                place = np.minimum(np.searchsorted(large_set, small_set), len(large_set) - 1)
                shared = int((large_set[place] == small_set).sum())
                if 100 * shared >= percent * (len(small_set) + len(large_set) - shared):
                    parent[a] = b
                    found.append((fps[p], fps[q]))
    return pd.DataFrame(found, columns=["u", "v"])


def tiles(open_buckets: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of buckets with all that a comparison needs, once for each tile that they are in.

    A bucket has as many blocks as keep a block within BLOCK members and BLOCK_SHINGLES shingles on
    average; its tiles are the pairs of blocks.
    """
    sized = open_buckets.join(classes.select("fp", "n"), "fp")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    placed = (
        sized.join(sized.groupBy("key").agg(blocks.alias("blocks")), "key")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "fp", "root")
    )
    return placed.join(classes.select("fp", "n", "bits", "bands"), "fp").join(sets, "fp")


def tile_links(tiled: DataFrame, percent: int) -> DataFrame:
    """(u, v) of all tiles; a task takes its tiles one after the other."""
    order = ["key", "first", "second"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            rows = pd.concat([*held, batch], ignore_index=True) if held else batch
            same = (rows[order] == rows[order].shift()).all(axis=1).to_numpy()
            starts = np.append(np.flatnonzero(~same), len(rows))
            for a, b in zip(starts[:-2], starts[1:-1], strict=True):
                yield links_of_tile(rows.iloc[a:b], percent)
            held = [rows.iloc[starts[-2] :]] if len(rows) else []
        if held:
            yield links_of_tile(held[0], percent)

    return tiled.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, "u binary, v binary")


def link_classes(keyed: DataFrame, classes: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(node, root) over the fingerprints of classes (fp, row, n, bands, bits) that are linked with another."""
    members = classes.select(F.explode("bands").alias("key"), "fp")
    crowded = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("fp").alias("hub")).filter("_n > 1").select("key", "hub")
    buckets = cut(members.join(small(cut(crowded)), "key"))
    wanted = buckets.select("fp").distinct().join(classes.select("fp", "row"), "fp")
    sets = cut(whole_sets(keyed, cut(wanted), text_col, width))
    left = buckets.filter("fp != hub")
    links = cut(linked(left.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct(), classes, sets, percent))
    roots = cut(connected_components(links))
    placed = left.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    unlike = placed.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a != _b").select("key")
    more = cut(tile_links(tiles(cut(placed.join(unlike, "key", "left_semi")), classes, sets), percent))
    return roots if more.isEmpty() else connected_components(links.union(more))


def components(keyed: DataFrame, text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(row, n, fp, root) of every row of a table with the long key `_tm_row`; root is null for an empty set."""
    signed = cut(signatures(keyed, text_col, width))
    first = signed.filter("fp is not null").groupBy("fp").agg(
        F.min_by(F.struct("row", "n", "bands", "bits"), "row").alias("_first")
    )
    classes = cut(first.select("fp", "_first.*"))
    roots = link_classes(keyed, classes, text_col, width, percent).withColumnRenamed("node", "fp")
    named = cut(classes.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    some = signed.filter("fp is not null").select("row", "n", "fp").join(named, "fp").select("row", "n", "fp", "root")
    none = signed.filter("fp is null").select("row", "n", "fp", F.lit(None).cast("binary").alias("root"))
    return some.union(none)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (least id of its component) and kept."""
    keyed = with_row_key(docs.select(id_col, text_col), id_col)
    found = cut(components(keyed, text_col, width, percent).join(keyed.select(F.col("_tm_row").alias("row"), F.col(id_col).alias("_id")), "row"))
    least = found.filter("root is not null").groupBy("root").agg(F.min("_id").alias("_least"))
    some = found.filter("root is not null").join(least, "root").select("_id", "n", F.col("_least").alias("component_id"))
    none = found.filter("root is null").select("_id", "n", F.col("_id").alias("component_id"))
    return some.union(none).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the least key stays."""
    keyed = with_row_key(docs, id_col)
    found = cut(components(keyed, text_col, width, percent))
    firsts = found.filter("root is not null").groupBy("root").agg(F.min("row").alias("row")).select("row")
    kept = firsts.union(found.filter("root is null").select("row")).withColumnRenamed("row", "_tm_row")
    return keyed.join(kept, "_tm_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN e ON b = x) SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id, d.doc_id = r.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id
"""
