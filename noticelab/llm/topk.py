"""Exact top-k by inner product: tiled matrix products and merged top lists.

Queries go out in waves whose vectors take at most WAVE_BYTES, a bound that
does not depend on the data; each wave is one pass over all candidates.  A task
multiplies tiles of queries and candidates, keeps of each tile only what can
still enter a query's list, and ends with one short list per query.  The lists
are merged as a tree: MERGED tasks' lists of a query become one, and so on,
so that no merge reads more than MERGED * k rows a query however many tasks
there are.

Products are of integers: a matrix product in 32-bit or 64-bit floats is used
only where every partial sum is exact in it, 64-bit integers elsewhere.

Cases: vectors that are null or hold a null or non-finite component take no
part, nor do rows without an id; vectors of unlike lengths are not compared;
rows that repeat an id are candidates each, and none for a query of that id;
queries that repeat an id and its integers count once, other vectors of an id
share one list of all their products; ties go to the smaller id; fewer candidates than k give fewer rows; empty tables give no
row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

WAVE_BYTES = 64 << 20  #: of the query vectors that the executors hold at once, as doubles
TILE_QUERIES, TILE_ROWS = 1024, 4096
MERGED = 32  #: lists that become one in a step of the tree
LOWEST = -(1 << 62)  #: stands for no product; a power of two, exact in every type used here
NO_ID = (1 << 63) - 1


def to_integers(vectors) -> np.ndarray:
    """floor(256 x), x as double."""
    return np.floor(256.0 * np.asarray(vectors, np.float64))


def usable(embedding: F.Column) -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite


def _kind(dim: int, largest: float):
    """A type in which sums of dim products of such numbers are exact."""
    bound = dim * largest * largest
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class TopLists:
    """The k best (score, -id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.largest = np.abs(vectors).max(initial=0)
        self.scores = np.full((len(ids), k), LOWEST, np.int64)
        self.best = np.full((len(ids), k), NO_ID, np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        kind = _kind(vectors.shape[1], max(self.largest, np.abs(vectors).max(initial=0)))
        for b in range(0, len(ids), TILE_ROWS):
            rows, own = vectors[b : b + TILE_ROWS].astype(kind), ids[b : b + TILE_ROWS]
            for a in range(0, len(self.ids), TILE_QUERIES):
                self._tile(slice(a, a + TILE_QUERIES), self.vectors[a : a + TILE_QUERIES].astype(kind) @ rows.T, own)

    def _tile(self, at: slice, product: np.ndarray, own: np.ndarray) -> None:
        """Merge a tile's products into the lists; own holds its columns' ids, ascending."""
        k, n = self.k, len(product)
        low, high = np.searchsorted(own, self.ids[at], "left"), np.searchsorted(own, self.ids[at], "right")
        for q in np.flatnonzero(low < high):  # a query's own rows
            product[q, low[q] : high[q]] = LOWEST
        least = self.scores[at, -1]
        if product.shape[1] > k:  # the tile's own k-th best bounds it too
            least = np.maximum(least, np.partition(product, -k, axis=1)[:, -k].astype(np.int64))
        floor = least[:, None].astype(product.dtype)
        enter = (product >= floor) & (product != LOWEST)
        if enter.sum() > 4 * k * n:  # of many equals the first k, in the order of ids, are enough
            equal = enter & (product == floor)
            enter &= ~equal | (np.cumsum(equal, axis=1) <= k)
        q, c = np.nonzero(enter)
        if not len(q):
            return
        score = np.concatenate([product[q, c].astype(np.int64), self.scores[at].ravel()])
        ids = np.concatenate([own[c], self.best[at].ravel()])
        q = np.concatenate([q, np.repeat(np.arange(n), k)])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        take = np.searchsorted(q, np.arange(n))[:, None] + np.arange(k)
        self.scores[at], self.best[at] = score[take], ids[take]


def _vectors(batch: pa.RecordBatch):
    """(ids, vectors) of a batch (vec_id, embedding), by length."""
    column, ids = batch.column("embedding"), batch.column("vec_id").to_numpy(zero_copy_only=False)
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == d)
        yield ids[of], flat[begin[of][:, None] + np.arange(d)]


def _searched(rows: DataFrame, wave: DataFrame, k: int) -> DataFrame:
    """(shard, query_id, vec_id, score): each task's list for each query of one wave."""
    sets: dict[int, list] = {}
    for batch in wave.orderBy("vec_id").toArrow().to_batches():
        for ids, vectors in _vectors(batch):
            sets.setdefault(vectors.shape[1], []).append((ids, vectors))
    sets = {d: (np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])) for d, x in sets.items()}
    held = rows.sparkSession.sparkContext.broadcast(sets)

    def search(batches):
        from pyspark import TaskContext

        lists = {d: TopLists(ids, vectors, k) for d, (ids, vectors) in held.value.items()}
        for batch in batches:
            for ids, vectors in _vectors(batch):
                if vectors.shape[1] in lists:
                    lists[vectors.shape[1]].add(ids, to_integers(vectors))
        for found in lists.values():
            for a in range(0, len(found.ids), TILE_QUERIES):
                q, r = np.nonzero(found.best[a : a + TILE_QUERIES] != NO_ID)
                q += a
                out = {
                    "shard": np.full(len(q), TaskContext.get().partitionId()),
                    "query_id": found.ids[q],
                    "vec_id": found.best[q, r],
                    "score": found.scores[q, r],
                }
                yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in out.items()})

    found = _shared.written(rows.mapInArrow(search, "shard long, query_id long, vec_id long, score long"), "lists")
    held.unpersist()
    return found


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (vec_id, embedding) against
    rows (vec_id, embedding), rows of the query's own id left out."""
    clean = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    queries, rows = clean(queries), clean(rows)
    integers = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    queries = queries.select("vec_id", integers.alias("embedding")).distinct()
    n, dim = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    waves = max(1, -(-n * 8 * (dim or 1) // WAVE_BYTES))
    wave_of = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(waves))
    lists = reduce(DataFrame.unionByName, [_searched(rows, queries.where(wave_of == w) if waves > 1 else queries, k) for w in range(waves)])
    shards = (lists.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        lists = lists.withColumn("shard", F.expr(f"shard div {MERGED}"))
        shards = -(-shards // MERGED)
        group = Window.partitionBy("query_id", "shard") if shards > 1 else Window.partitionBy("query_id")
        lists = lists.withColumn("rank", F.row_number().over(group.orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared.table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 50 = 0"), rows, 5)


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_inner_product(list_transform(q.e, lambda x: cast(x as double)), list_transform(c.e, lambda x: cast(x as double))) as bigint) as score
  from (select distinct vec_id, e from v where vec_id % 50 = 0) q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""
