"""Product codes of integer vectors by filtering Lloyd rounds: kd-trees hand whole subtrees to a codebook entry at once.

Vectors are cut into ``PARTS`` equal parts, each with a codebook that starts from the vectors with the smallest ids.  Rows are packed once into blocks of
bounded size; for each part of a block a kd-tree splits the part's points at the median of their widest dimension and keeps, for every node, the bounding box, the sum and the number of its points.

A round walks the trees level by level with the entries that are left for each node.  The entry nearest to a box's middle stays; another entry goes if
even in the box's corner that favours it most it is no nearer (farther, or as near with a higher index).  A node with one entry left
gives that entry its cached sum and count; leaves with several compare their points.  Boxes that are one point (copies)
always have one entry left, so copies cost one step, however many.  All arithmetic is on integers, so results don't depend on
blocks or partitions.

Scale: rows move once, into blocks in the shared folder, without a shuffle; a round reads the blocks and shuffles sums of each task by (part, entry,
position); the driver holds codebooks only (``ENTRIES`` x dimensions integers).  Hot labels: errors are summed before the shuffle, and the join that brings sums
back reads them from a table of their own, so it is broadcast or its hot keys are split.

Defined results: vectors that are null or hold null or non-finite components take no part; all others must have one length, a multiple of the number of
parts (else an error names the lengths); a null id counts as the largest; rows with equal ids start codebooks by their vectors' order; with fewer
rows than entries codebooks have as many entries as rows; repeated rows each count; ties go to the lower index;
unused entries stay; an empty table gives no rows.  Numbers whose squared distances go beyond 63 bits are an error.
"""

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, table
from .topk import quantise, usable
from .whitening import matrix

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Integers of a block, and points of a leaf, at most.
BLOCK = 1 << 19
LEAF = 16


class Tree:
    """A kd-tree over the rows of ``points``: nodes by level; children of node i are child[i] and child[i] + 1."""

    def __init__(self, points: np.ndarray):
        n, dim = points.shape
        order = np.arange(n)
        starts, ends = np.array([0]), np.array([n])
        levels, first = [], 0
        while len(starts):
            inner = points[order[np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])]]
            cuts = np.r_[0, np.cumsum(ends - starts)[:-1]]
            lo, hi = np.minimum.reduceat(inner, cuts), np.maximum.reduceat(inner, cuts)
            split = (ends - starts > LEAF) & (lo < hi).any(1)
            child = np.where(split, first + len(starts) + 2 * (np.cumsum(split) - 1), -1)
            levels.append((starts, ends, lo, hi, np.add.reduceat(inner, cuts, dtype=np.int64), child))
            first += len(starts)
            a, b, wide = starts[split], ends[split], (hi - lo)[split].argmax(1)
            for s, e, d in zip(a.tolist(), b.tolist(), wide.tolist(), strict=True):
                own = order[s:e]
                order[s:e] = own[np.argpartition(points[own, d], (e - s) // 2)]
            half = a + (b - a) // 2
            starts, ends = np.stack([a, half], 1).ravel(), np.stack([half, b], 1).ravel()
        self.order = order.astype(np.int32)
        self.start, self.end, self.lo, self.hi, self.sum, self.child = (np.concatenate(x) for x in zip(*levels, strict=True))

    def filter(self, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(nearest entry of each point, sums and counts by entry, subtrees that were handed over whole), ties to the lower entry."""
        entries, dim = book.shape
        largest = max(np.abs(points).max(initial=0), np.abs(book).max(initial=0))
        if 16 * dim * float(largest) ** 2 >= 2.0**62:
            raise ValueError(f"components up to {largest}: squared distances go beyond 63 bits")
        kind = np.float64 if 16 * dim * float(largest) ** 2 < 2.0**52 else np.int64  # both exact
        z = book.astype(kind)
        size = (z * z).sum(1)
        apart = z[None] - z[:, None]  # [nearest, other]: what the other has more
        more, less = np.maximum(apart, 0), np.minimum(apart, 0)
        index = np.arange(entries)
        codes = np.empty(len(points), np.int64)
        sums, counts, whole = np.zeros((entries, dim), np.int64), np.zeros(entries, np.int64), 0
        nodes, left = np.zeros(1, np.int64), np.ones((1, entries), bool)
        far = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        leaves, masks = [], []
        while len(nodes):
            lo, hi = self.lo[nodes].astype(kind), self.hi[nodes].astype(kind)
            near = np.where(left, 2 * size - 2 * (lo + hi) @ z.T, far).argmin(1)  # 2 |z|^2 - 4 z * middle: by distance to the middle
            favour = np.einsum("med,md->me", more[near], hi) + np.einsum("med,md->me", less[near], lo)
            # distance to the other entry less that to the nearest, at the corner that is best for the other
            gain = size[None] - size[near][:, None] - 2 * favour
            left = left & ((gain < 0) | ((gain == 0) & (index < near[:, None])))
            left[np.arange(len(nodes)), near] = True
            one, inner = left.sum(1) == 1, self.child[nodes] >= 0
            whole += int((one & inner).sum())
            for i, e in zip(nodes[one].tolist(), near[one].tolist(), strict=True):
                codes[self.order[self.start[i] : self.end[i]]] = e
            np.add.at(sums, near[one], self.sum[nodes[one]])
            np.add.at(counts, near[one], (self.end - self.start)[nodes[one]])
            leaves.append(nodes[~one & ~inner])
            masks.append(left[~one & ~inner])
            down = ~one & inner
            nodes, left = np.stack([self.child[nodes[down]], self.child[nodes[down]] + 1], 1).ravel(), np.repeat(left[down], 2, 0)
        leaf, mask = np.concatenate(leaves), np.concatenate(masks)
        if len(leaf):
            each = self.end[leaf] - self.start[leaf]
            at = np.concatenate([np.arange(a, b) for a, b in zip(self.start[leaf].tolist(), self.end[leaf].tolist(), strict=True)])
            rows = self.order[at]
            distance = size - 2 * points[rows].astype(kind) @ z.T
            own = np.where(np.repeat(mask, each, 0), distance, far).argmin(1)
            codes[rows] = own
            np.add.at(sums, own, points[rows].astype(np.int64))
            counts += np.bincount(own, minlength=entries)
        return codes, sums, counts, whole


def _smallest(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if most < np.iinfo(t).max))


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Rows packed into (ids, labels, data): data holds a block's matrix and the trees of its parts."""
    most, part = max(1, BLOCK // dim), dim // PARTS

    def packed(ids: list[pa.Array], labels: list[pa.Array], x: list[np.ndarray]) -> pa.RecordBatch:
        m = _smallest(np.concatenate(x))
        trees = [Tree(m[:, p * part : (p + 1) * part]) for p in range(PARTS)]
        one = [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([pa.concat_arrays(labels).to_pylist()], pa.list_(pa.string())), pa.array([pickle.dumps((m, trees), 5)], pa.binary())]
        return pa.RecordBatch.from_arrays(one, names=["ids", "labels", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x, held = [], [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, most):
                s = b.slice(at, most)
                if held + s.num_rows > most and held:
                    yield packed(ids, labels, x)
                    ids, labels, x, held = [], [], [], 0
                ids.append(s.column("vec_id"))
                labels.append(s.column("label"))
                x.append(matrix(s, "v", dim))
                held += s.num_rows
        if held:
            yield packed(ids, labels, x)

    return rows.select("vec_id", "label", "v").mapInArrow(pack, "ids array<long>, labels array<string>, data binary")


def _unpacked(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for i in range(b.num_rows):
            yield (*pickle.loads(b.column("data")[i].as_buffer()), b, i)  # noqa: S301  written by _blocks


def _update(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, position) after one round over all blocks."""
    parts, entries, dim = books.shape
    cells = entries * (dim + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, dim + 1), np.int64)
        for m, trees, _, _ in _unpacked(batches):
            for p, tree in enumerate(trees):
                _, sums, counts, _ = tree.filter(m[:, p * dim : (p + 1) * dim], books[p])
                total[p, :, :dim] += sums
                total[p, :, dim] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["cell", "value"])

    got = blocks.select("ids", "data").mapInArrow(add, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total = np.zeros(parts * cells, object)
    for r in got:
        total[r.cell] = int(r.value)
    total = total.reshape(parts, entries, dim + 1)
    out = books.copy()
    for p, e in zip(*np.nonzero(total[:, :, dim]), strict=True):
        out[p, e] = [s // total[p, e, dim] for s in total[p, e, :dim]]
    return out


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) by the last assignment."""
    dim = books.shape[2]
    hexes = np.array([f"{e:02x}" for e in range(max(1, books.shape[1]))], object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, trees, b, i in _unpacked(batches):
            code, error = np.full(len(m), "", object), np.zeros(len(m), np.int64)
            for p, tree in enumerate(trees):
                own = m[:, p * dim : (p + 1) * dim]
                codes = tree.filter(own, books[p])[0]
                code = code + hexes[codes]
                error += ((own.astype(np.int64) - books[p][codes]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(assign, "vec_id long, label string, code string, error long")


def _first_books(rows: DataFrame, dim: int) -> np.ndarray:
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    return np.array(first, np.int64).reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2).copy()


def compress(rows: DataFrame, *, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """rows (vec_id long, label string, v array<long>) -> (vec_id, label, code, error), and the codebooks (part, entry, position)."""
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    dim = sizes.most or 0
    if dim and (sizes.least != dim or dim % PARTS):
        raise ValueError(f"vectors have {sizes.least} to {dim} components: all must have one length, a multiple of {PARTS}")
    if not dim:
        return rows.select("vec_id", "label", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    blocks = cut(_blocks(rows, dim), "kdcodes-blocks")
    books = _first_books(rows, dim)
    for _ in range(rounds):
        books = _update(blocks, books)
    return _coded(blocks, books), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all codebook integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_filtering_lloyd(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    own = table(spark, sf_dir, "embeddings").filter(usable("embedding"))
    rows = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), quantise("embedding", 256).alias("v"))
    codes, books = compress(rows)
    codes = cut(codes, "kdcodes-codes")
    sums = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "kdcodes-labels")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


OP11_SQL = """
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, (i - 1) // w AS part, list(v ORDER BY i) AS v
  FROM (SELECT r, unnest(list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))) AS v, unnest(range(1, len(embedding) + 1)) AS i, len(embedding) // 16 AS w FROM kept)
  GROUP BY r, part),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS z FROM x WHERE r <= 64),
{rounds}
last AS MATERIALIZED ({last}),
coded AS MATERIALIZED (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY part, entry)) AS s FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (r), books
"""
_NEAREST = "SELECT r, part, v, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, x.part, v, entry, list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x JOIN b{n} b ON b.part = x.part) GROUP BY r, part, v"
_NEXT = """a{n} AS MATERIALIZED ({nearest}),
m{m} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS z FROM (SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS i FROM a{n}) GROUP BY part, entry, i) GROUP BY part, entry),
b{m} AS MATERIALIZED (SELECT part, entry, coalesce(m.z, b.z) AS z FROM b{n} b LEFT JOIN m{m} m USING (part, entry)),"""
OP11_SQL = OP11_SQL.format(rounds="\n".join(_NEXT.format(n=n, m=n + 1, nearest=_NEAREST.format(n=n)) for n in range(ROUNDS)), last=_NEAREST.format(n=ROUNDS)).replace("WITH RECURSIVE", "WITH")
