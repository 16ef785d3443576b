"""Exact top-k by inner product over an impact-ordered index, one score level at a time.

A posting is a vector's component in a dimension; its impact is quantised to the number of bits of its absolute value, and the postings
of one impact, dimension by dimension, are a segment.  Segments are processed by descending impact and added to the scores of
all queries of a block.  After a level, the unprocessed components of a vector add to its score at most their norm times the query's norm (Cauchy-Schwarz),
which bounds each score from above.  The exact scores of the k vectors that lead so far bound a query's k-th best score from below, as does the k-th best score that it
has from earlier shards.  A query stops when few vectors have an upper bound that reaches that: this is the proof that all others are no members;
those that may be are rescored exactly in integers.  If no level gives a small set, all are processed, and scores are exact.  The other queries of the
block go on without it.  Levels before which no proof can hold, because too much is unprocessed, are added up together.

Scale: vectors are dealt to shards of about ``SHARD`` rows and move once; a shard's index is built once, in one task of bounded memory, which
reads the queries block by block from the shared folder.  Shards go in rounds, ``GROWTH`` times as many in all each time; after a round each
query's k-th best score is known, and later shards return only what reaches it, so a query gets about k * GROWTH rows a round, however many shards there are.
Equal vectors, however many, spread by their id's hash.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part; vectors of other
lengths than the query's are no candidates; repeated query rows count as one query (rows with one id and different vectors share its list), repeated candidates each count; ties go
to the smaller vec_id; a query without candidates has no rows; an empty table gives none; other columns are not read.  Scores are exact while they fit into 64 bits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, prepare, remove, table

K = 20
SHARD = 8192
QUERIES = 4096
#: Shards of the first round, and how many times more there are after each later one.
GROWTH = 8
#: Queries whose scores are held at once, and the share of a shard's vectors that may be left when a query stops.
STEP = 256
REST = 0.05
#: A proof is tried once unprocessed norms are, in the mean, at most this share of whole norms.
EARLY = 0.3

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantise(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: str) -> Column:
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


class ImpactIndex:
    """Segments of the vectors of one shard by impact and dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids, self.order = vectors, ids, np.argsort(ids, kind="stable")
        self.skipped = self.processed = 0  # levels, summed over queries
        size = np.abs(vectors)
        self.largest = int(size.max(initial=0))
        impact = np.zeros(vectors.shape, np.int8)
        for bit in range(self.largest.bit_length()):
            impact += size >> bit > 0
        square = vectors.astype(np.float64) ** 2
        whole = square.sum(1)
        left, self.levels = whole.copy(), []  # (dimensions, rows, values, norms that are left after it) by descending impact
        for level in sorted(set(np.unique(impact).tolist()) - {0}, reverse=True):
            dims, rows = np.nonzero(impact.T == level)
            left = np.maximum(left - np.bincount(rows, square[rows, dims], minlength=len(vectors)), 0)
            self.levels.append((dims, rows, vectors[rows, dims], np.sqrt(left * 1.000001)))
        if self.levels:  # all is processed
            self.levels[-1][3][:] = 0
        self.mean_norm = float(np.sqrt(whole).mean()) if len(vectors) else 0.0

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        """Rows (query number, vector's row, score): each query's k best of those that reach its floor, ties to the smaller id."""
        floor = np.full(len(queries), np.iinfo(np.int64).min) if floor is None else floor
        for i in range(0, len(queries), STEP):
            part = slice(i, i + STEP)
            q, x = self._members(queries[part], query_ids[part], k, floor[part])
            yield from self._exact(q + i, x, queries, k, floor)

    def _members(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all that may be among the k best."""
        n, m = len(self.vectors), len(queries)
        most = float(np.abs(queries).max(initial=0)) * self.largest * max(1, queries.shape[1])
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        weights, norms = queries.astype(kind), np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * 1.000001
        score, pending = np.zeros((m, n), kind), np.zeros((queries.shape[1], n), kind)
        lo, hi = (np.searchsorted(self.ids[self.order], query_ids, side) for side in ("left", "right"))
        own = [self.order[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        active, got = np.arange(m), []
        levels = self.levels or [(np.empty(0, int), np.empty(0, int), np.empty(0, int), np.zeros(n))]  # only zeros: every score is 0
        for number, (dims, rows, values, left) in enumerate(levels):
            pending[dims, rows] = values
            self.processed += len(active)
            last = number == len(levels) - 1
            if not last and left.mean() > EARLY * self.mean_norm:
                continue
            score += weights @ pending
            pending[:] = 0
            least = np.maximum(self._leaders(score, queries, [own[q] for q in active], active, k), floor[active].astype(np.float64))
            # a little wide, so that rounding can't break the proof
            bar = least[:, None] - (1 + most * 1e-12) - norms[active][:, None] * left[None, :]
            may = score >= bar
            for q, a in enumerate(active.tolist()):
                may[q, own[a]] = False
            done = np.full(len(active), True) if last else may.sum(1) <= REST * n + k
            q, x = np.nonzero(may[done])
            got.append((active[done][q], x))
            self.skipped += int(done.sum()) * (len(levels) - 1 - number)
            if done.all():
                break
            if done.any():
                score, weights, active = score[~done], weights[~done], active[~done]
        return np.concatenate([q for q, _ in got]), np.concatenate([x for _, x in got])

    def _leaders(self, score: np.ndarray, queries: np.ndarray, own: list[np.ndarray], active: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of each query's k-th best score: the k-th best exact score among those that lead so far, its own rows left out."""
        n, wide = len(self.vectors), k + max(map(len, own), default=0)
        if n < wide:
            return np.full(len(score), -np.inf)
        lead = np.argpartition(score, n - wide, axis=1)[:, n - wide :]
        exact = np.empty(lead.shape, np.float64)
        for q, rows in enumerate(lead):
            exact[q] = self.vectors[rows] @ queries[active[q]]
            if len(own[q]):
                exact[q, np.isin(rows, own[q])] = -np.inf
        return np.partition(exact, wide - k, axis=1)[:, wide - k]

    def _exact(self, q: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        exact = np.empty(len(q), np.int64)
        for i in range(0, len(q), 16_384):
            part = slice(i, i + 16_384)
            exact[part] = np.einsum("ij,ij->i", self.vectors[x[part]], queries[q[part]])
        fine = exact >= floor[q]
        q, x, exact = q[fine], x[fine], exact[fine]
        order = np.lexsort((self.ids[x], -exact, q))
        q, x, exact = q[order], x[order], exact[order]
        first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        top = place < k
        yield q[top], x[top], exact[top]


def _by_length(t: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """The rows of each vector length, their vectors as a matrix."""
    sizes = np.array([len(v) for v in t.column("v")], np.int64)
    for dim in np.unique(sizes).tolist():
        part = t.filter(pa.array(sizes == dim)).combine_chunks()
        flat = part.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False)
        yield flat.astype(np.int64).reshape(part.num_rows, dim), part


def _searcher(files: list[str], k: int):
    """A function from a shard to what its index finds for the queries in these files."""

    def search(shard: pa.Table) -> pa.Table:
        got = []
        indexes = {v.shape[1]: ImpactIndex(v, t.column("vec_id").to_numpy()) for v, t in _by_length(shard)}
        for f in files:
            fs, path = filesystem(f)
            for v, t in _by_length(pq.read_table(path, filesystem=fs)):
                if v.shape[1] in indexes:
                    index, ids = indexes[v.shape[1]], t.column("vec_id").to_numpy()
                    floor = t.column("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
                    for q, x, s in index.search(v, ids, k, floor):
                        got.append(pa.Table.from_arrays([pa.array(ids[q]), pa.array(index.ids[x]), pa.array(s)], schema=_OUT))
        return pa.concat_tables(got) if got else _OUT.empty_table()

    return search


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K) -> DataFrame:
    """vectors, queries: (vec_id long, v array<long>) -> (query_id, rank, vec_id, score), the k best others of each query."""
    spark = vectors.sparkSession
    prepare(spark)
    shards = max(1, -(-vectors.count() // SHARD))
    parts = max(1, -(-queries.count() // QUERIES))
    own = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    if shards > GROWTH:  # several rounds: vectors are read and dealt once, and a round skips the row groups of other shards
        own = cut(own.repartitionByRange(max(1, shards // GROWTH), "shard"), "topk-vectors")
    asked = cut(queries.dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.lit(None).cast("long").alias("floor")).repartition(parts, "vec_id"), "topk-queries")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, done = None, 0
    while done < shards:
        upto = GROWTH * max(1, done)
        mine = own.filter((F.col("shard") >= done) & (F.col("shard") < upto))
        got = mine.groupBy("shard").applyInArrow(_searcher(asked.inputFiles(), k), "query_id long, vec_id long, score long")
        every = got if found is None else got.unionByName(found.select(*got.columns))
        ranked = every.withColumn("rank", F.row_number().over(best_first).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        done = upto
        if done >= shards:
            return ranked
        before, found = (asked, found), cut(ranked, "topk-found")
        floors = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        asked = cut(asked.drop("floor").join(floors, "vec_id", "left").select("vec_id", "v", "floor").repartition(parts, "vec_id"), "topk-queries")
        for old in before:
            if old is not None:
                remove(spark, old)


def op4_impact_topk(spark, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(usable("embedding") & F.col("vec_id").isNotNull())
    vectors = own.select(F.col("vec_id").cast("long").alias("vec_id"), quantise("embedding").alias("v"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
