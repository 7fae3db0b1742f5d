"""Exact top-k search by inner product with a table of pivot distances.

Every vector keeps its distances to the pivots, chosen farthest first from a
bounded sample. For a query q and a vector x the greatest difference of their
distances to a pivot is a lower bound d of their own distance, so q.x is at most
(|q|^2 + |x|^2 - d^2) / 2. A block's vectors are put in the order of their nearest
pivot and cut into groups of ``GROUP``; the least and greatest distance of a group
to each pivot bound all its members at once. Groups are evaluated in the order of
their bound, each as one matrix product for the queries of a batch that it may
still concern, and are left out once the bound is below a query's k-th best score
found so far; the scores are exact integers. Queries are taken in blocks of
``QUERIES`` that are sent to all executors; each task returns k rows a query.

Components become floor(256 x). Vectors that are null or hold null or non-finite
components, and rows with a null vec_id, take no part; nor do empty ones. Shorter
vectors count as filled with zeros. Rows with the query's vec_id are not its
candidates; rows that share a vec_id are one query (the smallest vector) and several
candidates. Ties go to the smaller vec_id. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

PIVOTS, SAMPLE, QUERIES = 32, 2000, 8192
#: Vectors that are bounded together, and queries that are evaluated together.
GROUP, BATCH = 256, 128
NONE = np.iinfo(np.int64).min
SCALE = 256
TABLE = "n int, ids binary, vectors binary, norms binary, dists binary"


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE x) of each vector, as exact floats, filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(SCALE * flat)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e).filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & fine)


def choose(sample: np.ndarray, number: int) -> np.ndarray:
    """Pivots: each the vector farthest from those before it."""
    if not len(sample):
        return sample
    out = [sample[np.argmax((sample * sample).sum(axis=1))]]
    far = np.linalg.norm(sample - out[0], axis=1)
    while len(out) < min(number, len(sample)) and far.max() > 0:
        out.append(sample[far.argmax()])
        far = np.minimum(far, np.linalg.norm(sample - out[-1], axis=1))
    return np.array(out)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def build(vectors: DataFrame, dims: int, number: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """The pivot table (blocks of vectors with squared norms and pivot distances) and the pivots."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    pivots = choose(_whole(some["embedding"].combine_chunks(), dims), number) if some.num_rows else np.zeros((0, dims))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch["embedding"], dims)
            dists, ids = _distances(x, pivots), batch["vec_id"].to_numpy().astype(np.int64)
            order = np.argsort(dists.argmin(axis=1), kind="stable") if dists.size else np.arange(len(x))
            x, dists, ids = x[order], dists[order], ids[order]
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], type=pa.int32()), *[pa.array([v.tobytes()], type=pa.binary()) for v in (ids, x, (x * x).sum(axis=1), dists)]], names=["n", "ids", "vectors", "norms", "dists"])

    return workspace.materialize(vectors.mapInArrow(work, TABLE), "pivots"), pivots


def _open(row: dict, dims: int) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[k]).reshape(row["n"], -1) if k != "ids" else np.frombuffer(row[k], dtype=np.int64) for k in ("ids", "vectors", "norms", "dists"))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of each row of ``x`` with each of ``q``."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0)
    if most * x.shape[1] < 2.0**53:
        return (x @ q.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(row, one)) for one in q] for row in x], dtype=np.int64).reshape(len(x), len(q))


class Best:
    """The k best of each query so far, by descending score and ascending id; NONE stands for no score."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), NONE, dtype=np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((i, -s.astype(np.float64) if (np.abs(s[s != NONE]) < 1 << 53).all() else [-int(v) for v in s]))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]

    def add_group(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row an id and a column a query."""
        good = (scores >= self.scores[queries, -1]) & (scores != NONE)
        for c in np.flatnonzero(good.any(axis=0)):
            own, named = scores[good[:, c], c], ids[good[:, c]]
            if len(own) > 4 * self.k:
                top = own >= np.partition(own, -self.k)[-self.k]
                own, named = own[top], named[top]
            self.add(queries[c], own, named)


def search_block(best: Best, queries: tuple, block: tuple, group: int = GROUP, batch: int = BATCH) -> int:
    """Evaluate a block's groups for all queries; returns how many pairs were evaluated."""
    (q_ids, q, q_norms, q_dists), (ids, x, norms, dists), done = queries, block, 0
    if not len(ids):
        return 0
    starts = np.arange(0, len(ids), group)
    near, far, longest = np.minimum.reduceat(dists, starts), np.maximum.reduceat(dists, starts), np.maximum.reduceat(norms[:, 0], starts)
    order = np.argsort(q_dists.argmin(axis=1), kind="stable") if q_dists.size else np.arange(len(q_ids))
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        gap = np.zeros((len(own), len(starts)))
        for p in range(dists.shape[1]):
            d = q_dists[own, p][:, None]
            np.maximum(gap, np.maximum(d - far[:, p], near[:, p] - d), out=gap)
        bound = (q_norms[own] + longest - gap * gap) / 2
        bound += 1e-9 * (longest + q_norms[own]) + 0.5
        for g in np.argsort(-bound.max(axis=0), kind="stable"):
            open_ = own[bound[:, g] >= best.scores[own, -1]]
            if not len(open_):
                continue
            some = slice(starts[g], starts[g] + group)
            scores = products(x[some], q[open_])
            scores[ids[some][:, None] == q_ids[open_]] = NONE
            best.add_group(open_, scores, ids[some])
            done += scores.size
    return done


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its ``k`` best."""
    spark = vectors.sparkSession
    fine = usable(vectors)
    dims = max(1, fine.agg(F.max(F.size("embedding"))).first()[0] or 1)
    blocks, pivots = build(fine, dims)
    chosen = fine.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rounds = max(1, -(-chosen.count() // QUERIES))
    out = None
    for r in range(rounds):
        part = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r)
        got = part.toArrow()
        q = _whole(got["embedding"].combine_chunks(), dims) if got.num_rows else np.zeros((0, dims))
        shared = spark.sparkContext.broadcast((got["vec_id"].to_numpy(), q, (q * q).sum(axis=1)[:, None], _distances(q, pivots)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            if not len(queries[0]):
                return
            best = Best(len(queries[0]), k)
            for batch in batches:
                for row in batch.to_pylist():
                    search_block(best, queries, _open(row, dims))
            found = best.scores != NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[0], found.sum(axis=1))), pa.array(best.ids[found]), pa.array(best.scores[found])], names=["query_id", "vec_id", "score"])

        local = blocks.mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")
        local = workspace.materialize(local, "best") if rounds > 1 else local
        out = local if out is None else out.unionByName(local)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(k: int = 5, every: int = 50) -> str:
    """The same for ``embeddings`` in DuckDB's SQL."""
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score from v q join v c on q.vec_id % {every} = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {k}"""
