"""Exact top-k inner product search by block-at-a-time pruning.

Vectors are rounded to integers, so that scores and ties are exact. They are laid out in an order
that puts similar vectors together (nearest of a bounded sample of pivots, then a hash) and cut
into blocks of consecutive rows. A block keeps its vectors (the forward index) and the largest and
smallest value of every dimension. For a query, the dimensions' maxima summed with its weights
bound every score in the block. Each task takes its blocks in falling order of that bound for each
query, scores them whole, and leaves a query alone once its bounds are below its k-th best score.
A bounded sample of rows gives each query a first valid k-th score.

Queries are held in slices of at most `slice_queries` rows, which every task sees (bounded
broadcast); vectors are never paired outside the blocks that are scored.

Defined results: rows whose vector or id is null, or whose vector holds a null or non-finite
component, take no part; components that a shorter vector lacks count as 0; equal scores go to the
smaller id; a repeated id is one candidate for each of its rows, and none for a query of that id;
with fewer than k candidates all are returned; an empty table gives an empty result; extra columns
are not looked at. Components must be below 2^40 in size, so that sums stay within a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut

BLOCK, PIVOTS, SAMPLE = 128, 64, 2048


def rounded(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of every component as longs; null unless all components are finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(factor * x)))


def matrix(vectors, dims: int) -> np.ndarray:
    """Rows of longs, padded with zeros (or cut: they are zeros then) to one width."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as longs; by floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def sample_of(rows: DataFrame, n: int) -> tuple[np.ndarray, list]:
    """A bounded sample: the rows with the least hash of their id."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
    return np.array([r["vec_id"] for r in got], np.int64), [r["v"] for r in got]


def build_blocks(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """(ids, data, low, high): blocks of up to BLOCK vectors that lie together in the order by pivot."""
    lengths = np.maximum(np.linalg.norm(pivots, axis=1), 1e-9)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"], dims)
            near = np.argmax(x @ pivots.T / lengths, axis=1) if len(pivots) else np.zeros(len(x))
            yield batch.assign(near=near.astype(np.int32))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                x = matrix(part["v"], dims)
                yield pd.DataFrame({
                    "ids": [part["vec_id"].to_numpy()], "data": [x.tobytes()],
                    "low": [x.min(axis=0).tobytes()], "high": [x.max(axis=0).tobytes()],
                })

    placed = rows.mapInPandas(place, "vec_id bigint, v array<bigint>, near int")
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    ordered = placed.repartitionByRange(tasks, "near", F.xxhash64("vec_id"), "vec_id").sortWithinPartitions("near", F.xxhash64("vec_id"))
    return ordered.mapInPandas(block, "ids array<bigint>, data binary, low binary, high binary")


class Best:
    """The k best (query, score, id) so far of every query, and its threshold."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k = least.copy(), k
        self.rows = np.zeros((3, 0), np.int64)  # query number, score, id

    def add(self, found: list[np.ndarray]) -> None:
        rows = np.concatenate([self.rows, *found], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        rank = np.arange(rows.shape[1]) - first
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.least[last[0]] = np.maximum(self.least[last[0]], last[1])


def search_blocks(q: np.ndarray, ids: np.ndarray, blocks: list, best: Best) -> None:
    """Score blocks (ids, x, low, high) for the queries, each query in falling order of its bounds."""
    low, high = (np.stack([b[k] for b in blocks]) for k in (2, 3))
    bounds = product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for rank in range(len(blocks)):
        now = order[:, rank]
        alive = np.flatnonzero(bounds[np.arange(len(q)), now] >= best.least)
        if not len(alive):
            break
        found = []
        for k in np.unique(now[alive]):
            own = alive[now[alive] == k]
            scores = product(q[own], blocks[k][1])
            hit, row = np.nonzero((scores >= best.least[own][:, None]) & (ids[own][:, None] != blocks[k][0][None, :]))
            found.append(np.stack((own[hit], scores[hit, row], blocks[k][0][row])))
        best.add(found)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, slice_queries: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows (vec_id, v) for each query (vec_id, v) but itself."""
    spark = rows.sparkSession
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = cut(rows)
    sample_ids, sample = sample_of(rows, SAMPLE)
    sampled = matrix(sample, dims)
    blocks = cut(build_blocks(rows, sampled[:PIVOTS], dims))
    slices = max(1, -(-queries.count() // slice_queries))
    found, place = None, F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    for s in range(slices):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s).distinct().collect()
        ids, q = np.array([r["vec_id"] for r in got], np.int64), matrix([r["v"] for r in got], dims)
        first = product(q, sampled)
        first[ids[:, None] == sample_ids[None, :]] = np.iinfo(np.int64).min
        least = np.sort(first, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
        shared = spark.sparkContext.broadcast((q, ids, least))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q, ids, least = shared.value
            best = Best(least, k)
            for batch in batches:
                as_rows = lambda b: np.frombuffer(b, np.int64)
                parts = [(np.asarray(r.ids), as_rows(r.data).reshape(-1, dims), as_rows(r.low), as_rows(r.high)) for r in batch.itertuples()]
                if parts and len(q):
                    search_blocks(q, ids, parts, best)
            yield pd.DataFrame({"query_id": ids[best.rows[0]], "vec_id": best.rows[2], "score": best.rows[1]})

        part = blocks.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint").withColumn("rank", place).filter(F.col("rank") <= k)
        part = cut(part.select("query_id", "rank", "vec_id", "score"))  # written before the next slice is taken up
        shared.destroy()
        found = part if found is None else found.union(part)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    rows = (
        spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        .select(F.col("vec_id").cast("long").alias("vec_id"), rounded(F.col("embedding")).alias("v"))
        .filter("vec_id is not null and v is not null")
    )
    return top_k(rows, rows.filter("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
