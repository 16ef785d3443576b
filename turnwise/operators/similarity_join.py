"""Exact similarity joins that don't compare all pairs: the first pattern that holds for a turn, and pairs of sparse vectors over a threshold."""

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one side that a group compares at once, and patterns of a block, at most about.
ROWS = 4096
BLOCK = 1024
#: Rounding errors of a sum of products of unit vectors are smaller.
CLOSE = 1e-9
#: So are those of a sum of products and a bound of four bytes each.
ROUNDED = 1e-5


# -- the first pattern that holds ------------------------------------------------------------------------------------
def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _spread(one: DataFrame, salts: Column) -> DataFrame:
    """A copy of each row for each salt; columns are new ones, so that both sides of a cogroup can come from one table."""
    return one.withColumn("salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1))).select(*(F.col(c).alias(c) for c in (*one.columns, "salt")))


def _salt(of: str, salts: Column) -> Column:
    return F.pmod(F.xxhash64(of), salts).cast("int")


def _nearest_pivot(patterns: pa.Table, pivots: pa.Table) -> pa.Table:
    if not patterns.num_rows:
        return patterns.select(["state", "pattern"]).append_column("pivot", pa.array([], pa.int32())).append_column("near", pa.array([], pa.float64()))
    cos = _matrix(patterns.column("centroid")) @ _matrix(pivots.column("pivots")[0].values).T
    best = cos.argmax(1)
    return patterns.select(["state", "pattern"]).append_column("pivot", pa.array(best.astype(np.int32))).append_column("near", pa.array(cos[np.arange(len(best)), best]))


def _packed(block: pa.Table) -> pa.Table:
    block = block.sort_by("pattern").combine_chunks()
    head = {c: block.column(c)[:1].combine_chunks() for c in ("state", "pivot", "part")}
    lists = {c: pa.array([block.column(c).to_pylist()], pa.list_(t)) for c, t in (("pattern", pa.int64()), ("template", pa.string()), ("reliability", pa.float64()))}
    return pa.table(head | {"least": pa.array([min(block.column("near").to_pylist())])} | lists | {"matrix": pa.array([_matrix(block.column("centroid")).tobytes()], pa.binary())})


_BLOCK = "state string, pivot int, part int, least double, pattern array<long>, template array<string>, reliability array<double>, matrix binary"


def _blocks(patterns: DataFrame, pivots: DataFrame, counts: DataFrame) -> DataFrame:
    """Patterns near one pivot of their state, in one row for about ``BLOCK`` of them, with the smallest cosine to the pivot."""
    salts = F.ceil(F.col("n") / ROWS)
    asked = patterns.join(counts, "state").withColumn("salt", _salt("pattern", salts)).select("state", "salt", "pattern", "centroid")
    held = _spread(pivots.join(counts, "state"), salts).select("state", "salt", "pivots")
    near = asked.groupBy("state", "salt").cogroup(held.groupBy("state", "salt")).applyInArrow(_nearest_pivot, "state string, pattern long, pivot int, near double")
    parts = near.groupBy("state", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = near.join(parts, ["state", "pivot"]).withColumn("part", _salt("pattern", F.col("parts"))).drop("parts").join(patterns, ["state", "pattern"])
    return dealt.groupBy("state", "pivot", "part").applyInArrow(_packed, _BLOCK)


def _probe(route: float):
    """Blocks of its state that may hold a pattern over ``route`` for a turn, by the angles between turn, pivot and members; the likeliest is marked."""
    out = ["turn", "state", "vector", "pivot", "part", "bound", "first"]

    def probe(turns: pa.Table, heads: pa.Table) -> pa.Table:
        if not turns.num_rows or not heads.num_rows:
            none = turns.schema.empty_table().select(["turn", "state", "vector"])
            for c, t in zip(out[3:], (pa.int32(), pa.int32(), pa.float64(), pa.bool_()), strict=True):
                none = none.append_column(c, pa.array([], t))
            return none
        blocks = heads.column("blocks")[0].as_py()
        pivots = _matrix(heads.column("pivots")[0].values)
        own = np.array([b["pivot"] for b in blocks])
        radius = np.arccos(np.clip([b["least"] for b in blocks], -1, 1))
        angle = np.arccos(np.clip(_matrix(turns.column("vector")) @ pivots.T, -1, 1))[:, own]
        bound = np.cos(np.maximum(0, angle - radius[None]))
        t, b = np.nonzero(bound >= route - CLOSE)
        rows = turns.select(["turn", "state", "vector"]).take(pa.array(t))
        more = [pa.array(np.array([x[c] for x in blocks], np.int32)[b]) for c in ("pivot", "part")] + [pa.array(bound[t, b]), pa.array(b == bound.argmax(1)[t])]
        for c, a in zip(out[3:], more, strict=True):
            rows = rows.append_column(c, a)
        return rows

    return probe


def _walk(route: float, holds: Callable[[object, str], bool]):
    """For each turn of a block: its patterns over ``route`` by (cosine, reliability, age) until one holds."""
    schema = pa.schema([("turn", pa.int64()), ("pattern", pa.int64()), ("cosine", pa.float64()), ("reliability", pa.float64()), ("compared", pa.int64())])

    def walk(turns: pa.Table, blocks: pa.Table) -> pa.Table:
        if not turns.num_rows or not blocks.num_rows:
            return schema.empty_table()
        ids, templates, reliability = (blocks.column(c)[0].as_py() for c in ("pattern", "template", "reliability"))
        members = np.frombuffer(blocks.column("matrix")[0].as_py()).reshape(len(ids), -1)
        asked = _matrix(turns.column("vector"))
        t, p = np.nonzero(asked @ members.T >= route - CLOSE)
        cos = np.einsum("ij,ij->i", asked[t], members[p])  # each pair on its own: the same in any block
        order = np.lexsort((np.array(ids)[p], -np.array(reliability)[p], -cos, t))
        payloads, out, done = turns.column("payload").to_pylist(), {}, set()
        for i in order[cos[order] >= route].tolist():
            row = int(t[i])
            if row not in done and holds(payloads[row], templates[p[i]]):
                done.add(row)
                out[row] = (ids[p[i]], float(cos[i]), reliability[p[i]])
        rows = [(turn, *out.get(i, (None, None, None)), len(ids)) for i, turn in enumerate(turns.column("turn").to_pylist())]
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return walk


def _searched(probes: DataFrame, turns: DataFrame, blocks: DataFrame, walk) -> DataFrame:
    """Probes meet their blocks; a block that very many turns ask for is copied for each ``ROWS`` of them."""
    at = ["state", "pivot", "part"]
    salts = probes.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("salts"))
    asked = probes.join(salts, at).withColumn("salt", _salt("turn", F.col("salts"))).select(*at, "salt", "turn", "vector").join(turns.select("turn", "payload"), "turn")
    held = _spread(blocks.join(salts, at), F.col("salts")).drop("salts", "least")
    return asked.groupBy(*at, "salt").cogroup(held.groupBy(*at, "salt")).applyInArrow(walk, "turn long, pattern long, cosine double, reliability double, compared long")


def one_of(payload: list[str] | None, template: str) -> bool:
    return template in (payload or ())


def first_valid(turns: DataFrame, patterns: DataFrame, *, route: float, holds: Callable[[object, str], bool] = one_of, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """(turn, pattern, cosine, compared, in_state): each turn's best pattern of its state by (cosine, reliability, age) that is at least ``route`` near and holds.

    turns: (turn long, state, vector of unit length, payload); patterns: (pattern long, state, centroid of unit length, template, reliability).
    holds(payload, template): whether the template can be filled in and is valid for the turn; the default looks it up in a list.

    Exact.  Patterns of a state lie in blocks around about sqrt(n) pivots; by the triangle inequality of angles a block's smallest cosine to its pivot bounds
    what a turn can find in it.  A turn searches its likeliest block first, and then the blocks alone whose bound reaches what it has by then.
    ``compared`` of the ``in_state`` patterns were compared.  States, pivots and blocks that hold very many rows are salted; turns without
    a pattern have nulls.  keep(frame, name): writes a table that is read more than once.
    """
    turns = turns.select(F.col("turn").cast("long").alias("turn"), F.col("state").cast("string").alias("state"), F.col("vector").cast("array<double>").alias("vector"), "payload")
    patterns = patterns.select(F.col("pattern").cast("long").alias("pattern"), F.col("state").cast("string").alias("state"), F.col("centroid").cast("array<double>").alias("centroid"), "template", F.col("reliability").cast("double").alias("reliability"))
    drawn = F.pmod(F.xxhash64("pattern"), F.lit(1 << 30)) / (1 << 30)
    counts = patterns.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(drawn, "pattern")).alias("least"))
    chosen = patterns.join(counts, "state").filter((drawn * F.sqrt("n") <= 1) | (F.col("pattern") == F.col("least.pattern")))
    pivots = chosen.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("pattern", "centroid"))), lambda x: x["centroid"]).alias("pivots"))
    counts = counts.select("state", "n")
    blocks = keep(_blocks(patterns, pivots, counts), "blocks")
    heads = blocks.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("pivot", "part", "least"))).alias("blocks")).join(pivots, "state")
    salts = turns.groupBy("state").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("salts"))
    asked = turns.join(salts, "state").withColumn("salt", _salt("turn", F.col("salts"))).select("state", "salt", "turn", "vector")
    held = _spread(heads.join(salts, "state"), F.col("salts")).select("state", "salt", "blocks", "pivots")
    probes = keep(asked.groupBy("state", "salt").cogroup(held.groupBy("state", "salt")).applyInArrow(_probe(route), "turn long, state string, vector array<double>, pivot int, part int, bound double, first boolean"), "probes")
    walk = _walk(route, holds)
    near = keep(_searched(probes.filter("first"), turns, blocks, walk), "near")
    have = near.select("turn", F.col("cosine").alias("have"))
    rest = probes.filter("NOT first").join(have, "turn", "left").filter(F.col("have").isNull() | (F.col("bound") >= F.col("have") - CLOSE)).drop("have")
    found = near.unionByName(_searched(rest, turns, blocks, walk))
    best = F.min(F.when(F.col("pattern").isNotNull(), F.struct((-F.col("cosine")).alias("c"), (-F.col("reliability")).alias("r"), "pattern")))
    top = found.groupBy("turn").agg(best.alias("m"), F.sum("compared").alias("compared"))
    out = turns.select("turn", "state").join(counts, "state", "left").join(top, "turn", "left")
    return out.select("turn", F.col("m.pattern").alias("pattern"), (-F.col("m.c")).alias("cosine"), F.coalesce("compared", F.lit(0).cast("long")).alias("compared"), F.coalesce("n", F.lit(0).cast("long")).alias("in_state"))


# -- sparse vectors over a threshold ---------------------------------------------------------------------------------
#: Entries of prefixes of a block, at most about, and blocks at least: each pair of blocks is a task.
ENTRIES = 5_000_000
LEAST_BLOCKS = 6
#: Texts and different words of texts of a chunk, which has one vocabulary, and whole vectors of a bucket, at most about.
TEXTS = 8192
WORDS = 2_500_000
BUCKET = 4096


def _keys(df: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order of terms, rare ones first: a level of the number of vectors with the term, then 26 bits of the term's hash."""
    level = np.minimum(63, np.floor(2.6 * np.log2(np.maximum(df, 1)))).astype(np.uint32)
    return (level << np.uint32(26)) | (h.view(np.uint64) >> np.uint64(38)).astype(np.uint32)


def _prefixes(off: np.ndarray, keys: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of unit vectors, sorted by key, are in the prefixes, and the norm of what follows each prefix.

    What begins with a term of the prefix may still reach the threshold.  Terms with one key are in or out together.
    """
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    c = np.concatenate([[0.0], np.cumsum(w * w)])
    rest = np.maximum(0.0, c[off[1:]][row] - c[:-1])
    inside = rest >= (threshold - 1e-7) ** 2
    n = off[:-1] + np.bincount(row[inside], minlength=len(off) - 1)
    while len(more := np.flatnonzero((n > off[:-1]) & (n < off[1:]) & (keys[np.minimum(n, len(keys) - 1)] == keys[np.maximum(n - 1, 0)]))):
        n[more] += 1
    return np.arange(len(w)) < n[row], np.sqrt(np.maximum(0.0, c[off[1:]] - c[n]))


_PREFIX = "id long, chunk long, n int, keys binary, ws binary, tail float"


def _packed_prefixes(ids: np.ndarray, chunk: int, off: np.ndarray, keys: np.ndarray, w: np.ndarray, threshold: float) -> pa.RecordBatch:
    """``_PREFIX`` rows of vectors that have a prefix; weights in two bytes, rounded up."""
    inside, tail = _prefixes(off, keys, w, threshold)
    n = np.add.reduceat(np.append(inside, False).astype(np.int64), off[:-1]) * (np.diff(off) > 0) if len(ids) else np.empty(0, np.int64)
    half = w[inside].astype(np.float16)
    half = np.where(half < w[inside], np.nextafter(half, np.float16(np.inf)), half)
    cut = np.concatenate([[0], np.cumsum(n)])
    k, h = keys[inside].tobytes(), half.tobytes()
    has = np.flatnonzero(n)
    cols = [pa.array(ids[has]), pa.array(np.full(len(has), chunk, np.int64)), pa.array(n[has].astype(np.int32)), pa.array([k[4 * cut[i] : 4 * cut[i + 1]] for i in has], pa.binary()), pa.array([h[2 * cut[i] : 2 * cut[i + 1]] for i in has], pa.binary()), pa.array((tail[has] + ROUNDED).astype(np.float32))]
    return pa.RecordBatch.from_arrays(cols, ["id", "chunk", "n", "keys", "ws", "tail"])


def _side(t: pa.Table) -> dict:
    """A block's prefixes as flat arrays; rest: at most the square of the norm of what follows an entry (weights were rounded up)."""
    off = np.concatenate([[0], np.cumsum(t.column("n").to_numpy(), dtype=np.int64)])
    flat = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    w = flat("ws", np.float16).astype(np.float32)
    c = np.cumsum(np.square(w, dtype=np.float64))
    c -= np.repeat(np.concatenate([[0.0], c])[off[:-1]], np.diff(off))
    np.clip(1 + ROUNDED - c * (1 - 2.0**-9), 0, None, out=c)
    return {"id": t.column("id").to_numpy(), "tail": t.column("tail").to_numpy(), "off": off, "key": flat("keys", np.uint32), "w": w, "rest": c.astype(np.float32)}


#: Vectors of a block whose meetings are looked up at once.
SLICE = 4096


def _meet(threshold: float):
    """Pairs a < b of the two blocks of a cell (or of one) whose prefixes leave room for the threshold.

    The products of all terms that both prefixes have are added up.  Any other common term follows the end of the prefix that ends first, say a's, so a's tail times the
    norm of what follows there in b bounds what is left (Cauchy-Schwarz).  Terms with equal keys count as equal, which only raises the sum.
    """
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def rest(side: dict, start, end) -> np.ndarray:
        return np.sqrt(np.where(end > start, side["rest"][np.maximum(end - 1, 0)], 1.0))

    def meet(cell: pa.Table) -> pa.Table:
        block = cell.column("block").to_numpy()
        same = cell.column("low")[0].as_py() == cell.column("high")[0].as_py()
        if not same and block.min() == block.max():
            return none
        A = _side(cell.filter(pa.array(block == block.min())))
        B = A if same else _side(cell.filter(pa.array(block == block.max())))
        size = len(B["id"])
        at_row = np.repeat(np.arange(size, dtype=np.int32), np.diff(B["off"]))
        placed = at_row.astype(np.uint64)
        placed <<= np.uint64(32)
        placed |= B["key"]
        order = np.argsort(B["key"], kind="stable").astype(np.int32)
        key, at_row, at_w = B["key"][order], at_row[order], B["w"][order]
        last, most = B["key"][B["off"][1:] - 1], B["tail"].max()
        del order
        out_a, out_b = [], []
        for i in range(len(A["id"])):
            if i % SLICE == 0:
                first = A["off"][i]
                asked = A["key"][first : A["off"][min(i + SLICE, len(A["id"]))]]
                low = np.searchsorted(key, asked, "left")
                count = np.searchsorted(key, asked, "right") - low
            s, e = A["off"][i], A["off"][i + 1]
            c = count[s - first : e - first]
            if not (m := int(c.sum())):
                continue
            at = np.repeat(low[s - first : e - first] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(m)
            had = np.bincount(at_row[at], weights=at_w[at] * np.repeat(A["w"][s:e], c), minlength=size)
            j = np.flatnonzero(had > max(0.0, threshold - 2 * ROUNDED - max(most, A["tail"][i])))
            j = j[(had[j] + np.maximum(B["tail"][j], A["tail"][i]) >= threshold - ROUNDED) & (j > (i if same else -1))]
            if not len(j):
                continue
            end = A["key"][e - 1]
            in_b = np.searchsorted(placed, (j.astype(np.uint64) << np.uint64(32)) | np.uint64(end), "right")
            in_a = s + np.searchsorted(A["key"][s:e], last[j], "right")
            left = np.where(end <= last[j], A["tail"][i] * rest(B, B["off"][j], in_b), B["tail"][j] * rest(A, s, in_a))
            j = j[had[j] + left >= threshold - ROUNDED]
            out_a.append(np.full(len(j), A["id"][i]))
            out_b.append(B["id"][j])
        if not out_a:
            return none
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return meet


def _met(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of ``_PREFIX`` rows that may reach the threshold.  Blocks of prefixes meet in pairs, so what is shipped are prefixes, for each block once, and no meetings."""
    total = prefixes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    g = max(LEAST_BLOCKS, -(-total // ENTRIES))
    block = F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    each = prefixes.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    cells = each.select("id", "n", "keys", "ws", "tail", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return cells.repartition(4 * g * g, "low", "high").groupBy("low", "high").applyInArrow(_meet(threshold), "a long, b long")


def _products(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Exact cosines of a cell's pairs."""
    h = dict(zip(held.column("id").to_pylist(), zip(held.column("hs").to_pylist(), held.column("ws").to_pylist(), strict=True), strict=True))
    a, b, out, own = *(asked.column(c).to_numpy() for c in "ab"), np.empty(asked.num_rows), None
    for i in np.lexsort((b, a)).tolist():
        if own != a[i]:
            own, (at, aw) = a[i], (np.frombuffer(h[int(a[i])][0], np.int64), np.frombuffer(h[int(a[i])][1]))
        bt, bw = np.frombuffer(h[int(b[i])][0], np.int64), np.frombuffer(h[int(b[i])][1])
        at_b = np.minimum(np.searchsorted(bt, at), len(bt) - 1)
        out[i] = (aw * bw[at_b])[bt[at_b] == at].sum()
    return pa.table({"a": a, "b": b, "cosine": out})


def _exact(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(a, b, cosine) of pairs.  fetch(wanted): (id, cell, hs, ws) for (id, cell), hs being hashes in order.

    Similar vectors are similar to the same ones: a vector's label is its smallest neighbour, vectors of one label share a bucket (or a few), and a vector is shipped
    once for each bucket that has a neighbour, not once for each pair.
    """
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("to")))
    labels = keep(ends.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("label")), "labels")
    buckets = max(1, -(-labels.count() // BUCKET))
    parts = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("parts"))
    placed = labels.hint("merge").join(parts, "label").select("id", F.pmod(F.xxhash64("label", _salt("id", F.col("parts"))), F.lit(buckets)).cast("int").alias("bucket"))
    of = lambda c: placed.select(F.col("id").alias(c), F.col("bucket").alias("at_" + c))
    cell = F.struct(F.least("at_a", "at_b").alias("low"), F.greatest("at_a", "at_b").alias("high"))
    asked = keep(pairs.hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b").select("a", "b", cell.alias("cell")), "asked")
    wanted = asked.select(F.col("a").alias("id"), "cell").unionByName(asked.select(F.col("b").alias("id"), "cell")).distinct()
    return asked.groupBy("cell").cogroup(fetch(wanted).groupBy("cell")).applyInArrow(_products, "a long, b long, cosine double")


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(id, terms, ws, keys): unit vectors as arrays, the rarest terms first.  rows: (id, term, weight), one for each term."""
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    whole = rows.join(df, "term").join(norms.filter("norm > 0"), "id")
    level = F.least(F.lit(63), F.floor(F.log2("df") * 2.6)).cast("long")
    key = F.shiftleft(level, 26) + F.shiftrightunsigned(F.xxhash64("term"), 38)
    v = whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "term", (F.col("weight") / F.col("norm")).alias("w")))).alias("v"))
    return v.select("id", F.col("v.term").alias("terms"), F.col("v.w").alias("ws"), F.col("v.key").alias("keys"))


def _vector_prefixes(vectors: DataFrame, threshold: float) -> DataFrame:
    def of(batches):
        for b in batches:
            if b.num_rows:
                off = b.column("ws").offsets.to_numpy()
                yield _packed_prefixes(b.column("id").to_numpy(), 0, off - off[0], b.column("keys").flatten().to_numpy().astype(np.uint32), b.column("ws").flatten().to_numpy(), threshold)

    return vectors.select(F.col("id").cast("long").alias("id"), "keys", "ws").mapInArrow(of, _PREFIX)


def prefix_rows(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, term, w, key, tail): what a vector is found by.  Two vectors whose cosine reaches the threshold share the first of their common terms here.

    tail: the norm of what follows all of these terms.
    """
    p = vectors.join(_vector_prefixes(vectors, threshold).select("id", "n", "tail"), "id")
    part = F.arrays_zip(*(F.slice(c, F.lit(1), F.col("n")).alias(x) for c, x in (("terms", "term"), ("ws", "w"), ("keys", "key"))))
    return p.select("id", "tail", F.explode(part).alias("p")).select("id", "p.term", "p.w", "p.key", "tail")


def candidate_pairs(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b of ``prefix_rows`` that leave room for the threshold."""

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        half = (w := t.column("w").to_numpy()).astype(np.float16)
        half = np.where(half < w, np.nextafter(half, np.float16(np.inf)), half)
        return pa.table({"id": t.column("id")[:1], "chunk": pa.array([0]), "n": pa.array([t.num_rows], pa.int32()), "keys": pa.array([t.column("key").to_numpy().astype(np.uint32).tobytes()], pa.binary()), "ws": pa.array([half.tobytes()], pa.binary()), "tail": t.column("tail")[:1]})

    rows = prefixes.select(F.col("id").cast("long").alias("id"), "w", "key", F.col("tail").cast("float").alias("tail"))
    return _met(rows.groupBy("id").applyInArrow(packed, _PREFIX), threshold)


def similar_pairs(rows: DataFrame, threshold: float, *, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of sparse vectors with a cosine of at least ``threshold`` > 0: prefix filter, norm bounds, exact products.

    rows: (id, term, weight).  A term that every vector has stands last in the order of terms and is left out of nearly all prefixes.
    Terms are told apart by hashes of 64 bits.
    """
    vectors = keep(unit_vectors(rows), "vectors")
    pairs = keep(_met(keep(_vector_prefixes(vectors, threshold), "prefixes"), threshold), "pairs")

    def whole(batches):
        for b in batches:
            h, w, off = b.column("h").flatten().to_numpy(), b.column("ws").flatten().to_numpy(), b.column("h").offsets.to_numpy()
            off = off - off[0]
            order = np.lexsort((h, np.repeat(np.arange(len(off) - 1), np.diff(off))))
            h, w = h[order].tobytes(), w[order].tobytes()
            cut = lambda x: pa.array([x[8 * s : 8 * e] for s, e in zip(off, off[1:])], pa.binary())  # noqa: B023,B905,E731
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cell"), cut(h), cut(w)], ["id", "cell", "hs", "ws"])

    def fetch(wanted: DataFrame) -> DataFrame:
        v = vectors.select(F.col("id").cast("long").alias("id"), F.transform("terms", lambda t: F.xxhash64(t)).alias("h"), "ws")
        return wanted.hint("merge").join(v, "id").select("id", "cell", "h", "ws").mapInArrow(whole, _WHOLE)

    return _exact(pairs, fetch, keep).filter(F.col("cosine") >= threshold)


# -- texts -----------------------------------------------------------------------------------------------------------
_WHOLE = "id long, cell struct<low int, high int>, hs binary, ws binary"
_CHUNK = "chunk long, ids binary, sizes binary, at binary, times binary, vocabulary array<string>, seen array<int>"


def _chunked(batches):
    """Texts as counts of words, ``TEXTS`` to a row: a row's own vocabulary, and for each text, places in it and times, packed."""
    ids: list = []
    at: list = []
    times: list = []
    names: dict = {}

    def row():
        sizes = np.array([len(x) for x in at], np.int32)
        every = np.concatenate(at)
        step = np.diff(every, prepend=np.int32(0))
        pack = lambda x: zlib.compress(x.tobytes(), 1)
        seen = np.bincount(every, minlength=len(names)).astype(np.int32)
        own = {"chunk": [ids[0]], "ids": [np.array(ids, np.int64).tobytes()], "sizes": [sizes.tobytes()], "at": [pack(step)], "times": [pack(np.concatenate(times))], "vocabulary": [list(names)], "seen": [seen.tolist()]}
        return pa.RecordBatch.from_pydict(own, pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "at", "times")), ("vocabulary", pa.list_(pa.string())), ("seen", pa.list_(pa.int32()))]))

    find, entries = re.compile("[a-z0-9]+").findall, 0
    for b in batches:
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if not (ws := find(text)):
                continue
            x, n = np.unique(np.array([names.setdefault(w, len(names)) for w in ws], np.int32), return_counts=True)
            ids.append(i)
            at.append(x)
            times.append(n.astype(np.int32))
            entries += len(x)
            if len(ids) == TEXTS or entries > WORDS:
                yield row()
                ids, at, times, names, entries = [], [], [], {}, 0
    if ids:
        yield row()


def _opened(r: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, hashes, keys, weights) of a chunk's unit vectors of (1 + ln times) * idf, sorted by key."""
    ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int32)
    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    row = np.repeat(np.arange(len(ids)), sizes)
    at = np.cumsum(np.frombuffer(zlib.decompress(r["at"]), np.int32), dtype=np.int64)
    h, df = np.array(r["hashes"], np.int64), np.array(r["df"], np.int64)
    w = (1 + np.log(np.frombuffer(zlib.decompress(r["times"]), np.int32))) * (np.log((1.0 + n) / (1.0 + df)) + 1)[at]
    w = w / np.sqrt(np.add.reduceat(w * w, off[:-1]))[row]
    keys = _keys(df, h)[at]
    order = np.lexsort((keys, row))
    return ids, off, h[at][order], keys[order], w[order]


def similar_texts(texts: DataFrame, n: int, threshold: float, *, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``similar_pairs`` of texts (id long, text in lower case) by TF-IDF of their words among ``n`` texts.

    Words are counted where a text is read.  Only the vocabularies of chunks of texts are shuffled to learn how many texts have a word;
    vectors are made from a chunk's packed counts when they are asked for.
    """
    ids = texts.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    if ids.groupBy("id").count().filter("count > 1").limit(1).count():
        ids = ids.groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    chunks = keep(ids.mapInArrow(_chunked, _CHUNK).withColumn("hashes", F.transform("vocabulary", lambda t: F.xxhash64(t))).drop("vocabulary"), "chunks")
    terms = chunks.select("chunk", F.posexplode(F.arrays_zip("hashes", "seen")).alias("at", "t")).select("chunk", "at", F.col("t.hashes").alias("h"), "t.seen")
    df = terms.select("chunk", "at", F.sum("seen").over(Window.partitionBy("h")).cast("int").alias("df"))
    dfs = df.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "df"))), lambda x: x["df"]).alias("df"))
    whole = keep(chunks.drop("seen").hint("merge").join(dfs, "chunk"), "counted")

    def prefixes(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, off, _, keys, w = _opened(r, n)
                yield _packed_prefixes(ids, r["chunk"], off, keys, w, threshold)

    found = keep(whole.mapInArrow(prefixes, _PREFIX), "prefixes")
    pairs = keep(_met(found, threshold), "pairs")

    def vectors(asked: pa.Table, chunk: pa.Table) -> pa.Table:
        got = {"id": [], "cell": [], "hs": [], "ws": []}
        if asked.num_rows:
            ids, off, h, _, w = _opened(chunk.to_pylist()[0], n)
            place = {i: k for k, i in enumerate(ids.tolist())}
            for r in asked.to_pylist():
                s, e = off[place[r["id"]]], off[place[r["id"]] + 1]
                order = np.argsort(h[s:e])
                for c, x in (("id", r["id"]), ("cell", r["cell"]), ("hs", h[s:e][order].tobytes()), ("ws", w[s:e][order].tobytes())):
                    got[c].append(x)
        return pa.table(got, pa.schema([("id", pa.int64()), ("cell", pa.struct([("low", pa.int32()), ("high", pa.int32())])), ("hs", pa.binary()), ("ws", pa.binary())]))

    def fetch(wanted: DataFrame) -> DataFrame:
        at = wanted.hint("merge").join(found.select("id", "chunk"), "id")
        return at.groupBy("chunk").cogroup(whole.groupBy("chunk")).applyInArrow(vectors, _WHOLE)

    return _exact(pairs, fetch, keep).filter(F.col("cosine") >= threshold)
