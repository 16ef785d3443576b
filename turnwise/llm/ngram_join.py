"""Joining documents whose five-word shingles have a Jaccard similarity of 0.8 or more, by a MinHash LSH forest.

Words are what white space separates, in lower case; shorter texts have one shingle of all their words.

1. Equal texts (by MD5) are one node; each node's signature is made once for each copy, without moving texts.
2. A signature has ``TREES`` labels of ``DEPTH`` MinHash values of 16 bits.  The forest is a table of (tree, label, node), range-partitioned
   and sorted: each tree is a prefix trie whose inner nodes of depth d are runs of rows with equal first d values.  Ranges are
   cut anywhere, so a run, however long, may be spread over many tasks; a run that is cut is stitched at the ends of its pieces.
3. Matching begins with whole labels.  Each run at the current depth hangs its texts on its first one.  The signatures of these pairs
   estimate their similarities s; a pair of similarity s meets at depth d in some tree with probability p(s, d) = 1 - (1 - s^d)^TREES, so
   each link that was met stands for 1 / p(s, d) links, and what a depth finds, and misses, can be added up.  Matched prefixes are shortened to the
   longest depth with the target recall on the links seen so far, matched and measured again, until the recall at the current
   depth reaches the target (``shorten``).  At the latest they stop at the depth at which even a pair at the threshold meets with that probability.
4. Components of these edges hold every pair that met.  They are verified exactly, on hashes of shingles, in blocks: up to ``BLOCK`` nodes at a
   time, against themselves and, in large components, against blocks of like sizes (a similarity of 0.8 needs sizes within a
   factor of 1.25).  A block counts all its true links by one matrix of common shingles; what leaves it is one row for each
   node: its links and the root of its part.  So a group of thousands of near copies is split over many tasks, and its pairs are counted but never
   listed.  Blocks of a large component carry, where that is less, only each text's difference from the component's lead: common
   shingles of x and y are |L| - |L - x| - |L - y| + |common differences|.
5. Components of the verified parts are the classes.

The result has a row for each document: class_id (smallest doc_id of its class), n_links (different texts that are as
similar, exact among all that met), n_copies (other rows with the same text).  Every pair that meets in the forest, or
whose texts meet others of their component, is verified.

Defined results: texts without words (null, empty, blank) are linked to nothing, class_id is their own doc_id; null
doc_ids are ignored when a class takes its smallest id; repeated rows are copies; an empty table gives no rows; names of
the input's columns that begin with ``__tw_`` are ours.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, remove, table, text_or_empty
from .graph import components

WORDS = 5
#: The threshold as a fraction, so that comparisons are exact.
THRESHOLD = (4, 5)
TREES = 40
DEPTH = 8
RECALL = 0.999999
#: Nodes, and shingles, of a block.
BLOCK = 1024
BLOCK_SHINGLES = 1_000_000
#: Pairs of sets with a common term that are counted at once.
PAIRS = 1 << 20
#: Rows of the forest in a range, about.
FOREST_ROWS = 500_000
#: Base of size classes: over 1.25, so linked sizes are at most one class apart.
SIZE_BASE = 1.26
SEED = 20240501


def missed(similarity, depth: int, trees: int = TREES):
    """The probability that a pair of this similarity meets in no tree at this depth."""
    return (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from ``depth`` downwards, at which even a pair at the threshold meets with probability ``recall``."""
    return next((m for m in range(depth, 0, -1) if 1 - missed(threshold, m, trees) >= recall), 1)


def shorten(depth: int, links: float, lost: list[float], recall: float, floor: int) -> int:
    """The next depth: the longest up to ``depth`` whose recall reaches the target.  links: what was met at ``depth`` stands for so many;
    lost[d - 1]: how many of them depth d misses.  Without links nothing is known, and the floor is next."""
    if not links:
        return min(depth, floor)
    return next((d for d in range(depth, floor, -1) if lost[d - 1] <= (1 - recall) * links), min(depth, floor))


def shingles(text: str, words: int = WORDS, known: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    known = {} if known is None else known
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    hashes = []
    for w in ws:
        h = known.get(w)
        if h is None:
            if len(known) > 300_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    if len(h) < words:  # a short text must differ from a longer one with the same words hashed in front
        out ^= np.uint64(len(h))
    return np.unique(out)


class Signer:
    """Labels of a text: for each tree, ``depth`` MinHash values of 16 bits, big-endian, so that labels sort as prefixes do."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def labels(self, found: np.ndarray) -> bytes:
        if not len(found):
            return b""
        short = (found ^ (found >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(short), 256):
            x = short[i : i + 256, None] ^ self.b
            x *= self.a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(least, x.min(0), out=least)
        least *= np.uint32(0x9E3779B1)
        return (least >> np.uint32(16)).astype(">u2").tobytes()


def _signatures(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("size", pa.int32()), ("labels", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, known = Signer(), {}
        for b in batches:
            found = [shingles(t, known=known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary()), pa.array([len(s) for s in found], pa.int32()), pa.array(map(signer.labels, found), pa.binary())], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, node binary, size int, labels binary")


# -- the forest ------------------------------------------------------------------------------------------------------
def forest(nodes: DataFrame) -> DataFrame:
    """(part, tree, label, node), sorted within parts; parts are ranges of the order.  nodes: (node, labels)."""
    wide = 2 * DEPTH
    rows = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.cast("short").alias("tree"), F.substring(F.col("labels"), t * wide + 1, F.lit(wide)).alias("label")))).alias("x"))
    rows = rows.select("x.tree", "x.label", "node")
    n = max(1, -(-nodes.count() * TREES // FOREST_ROWS))
    order = ["tree", "label", "node"]
    return cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *order), "forest")


_MET = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("tree", pa.int16()), ("label", pa.binary()), ("node", pa.binary()), ("kind", pa.int32())])


def matches(trees: DataFrame, depth: int) -> DataFrame:
    """(a, b): distinct pairs of a text and the first text of its run of equal prefixes of this depth."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, tree, label, node, lead of its run)

        def ends(rows: list[tuple]) -> pa.RecordBatch:
            """kind 0: the first row of a piece; 1: the last one.  b: the lead of its run."""
            return pa.RecordBatch.from_pylist([{"a": None, "b": lead, "tree": tree, "label": label, "node": node, "kind": kind} for (_, tree, label, node, lead), kind in rows], schema=_MET)

        for b in batches:
            if not b.num_rows:
                continue
            part, tree = b.column(0).to_numpy(), b.column(1).to_numpy()
            labels, nodes = b.column(2).to_pylist(), b.column(3).to_pylist()
            prefix = np.frombuffer(b"".join(labels), np.uint8).reshape(-1, 2 * DEPTH)[:, : 2 * depth]
            # a piece ends with its part, or where the order falls back: splits of one file may come in any order
            high, low = np.frombuffer(b"".join(labels), ">u8").reshape(-1, DEPTH // 4)[:, :2].T
            back = (tree[1:] < tree[:-1]) | ((tree[1:] == tree[:-1]) & ((high[1:] < high[:-1]) | ((high[1:] == high[:-1]) & (low[1:] < low[:-1]))))
            piece = np.r_[last is None or last[0] != part[0] or (last[1], last[2]) > (tree[0], labels[0]), (part[1:] != part[:-1]) | back]
            new = piece | np.r_[True, (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]).any(1)]
            going_on = not piece[0] and last[1] == tree[0] and last[2][: 2 * depth] == labels[0][: 2 * depth]
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            lead = [nodes[i] for i in start.tolist()]
            if going_on:
                stop = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(new)
                lead[:stop] = [last[4]] * stop
                new[0] = False
            row = lambda i: (int(part[i]), int(tree[i]), labels[i], nodes[i], lead[i])  # noqa: B023, E731
            cuts = []
            for i in np.flatnonzero(piece).tolist():
                if i or last is not None:
                    cuts.append((row(i - 1) if i else last, 1))
                cuts.append((row(i), 0))
            if cuts:
                yield ends(cuts)
            met = np.flatnonzero(~new).tolist()
            none = [None] * len(met)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([nodes[i] for i in met], [lead[i] for i in met], none, none, none, none), _MET.types, strict=True)], schema=_MET)
            last = row(len(new) - 1)
        if last is not None:
            yield ends([(last, 1)])

    met = cut(trees.select("part", "tree", "label", "node").mapInArrow(scan, "a binary, b binary, tree short, label binary, node binary, kind int"), "forest-met")
    # the pieces' ends, two rows for each piece of a part that a task read: where one piece's last run goes on in the next one
    order = Window.partitionBy(F.lit(0)).orderBy("tree", "label", "node", "kind")
    before = lambda c: F.lag(c).over(order)
    cut_runs = met.filter("kind is not null").select(F.col("b").alias("a"), before("b").alias("b"), "kind", ((before("tree") == F.col("tree")) & (F.substring(before("label"), 1, 2 * depth) == F.substring("label", 1, 2 * depth)) & (before("kind") == 1)).alias("on")).filter("kind = 0 and on and a != b")
    found = cut(met.filter("kind is null").select("a", "b").unionByName(cut_runs.select("a", "b")).filter("a != b").distinct(), "forest-edges")
    remove(trees.sparkSession, met)
    return found


def measure(edges: DataFrame, nodes: DataFrame, depth: int) -> tuple[float, list[float]]:
    """What the links among the edges, by their estimated similarities, stand for: how many links, and how many of them each depth misses."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("labels").alias(f"l{end}"))
    pairs = edges.join(of("a"), "a").join(of("b"), "b").select("la", "lb")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, lost = 0.0, np.zeros(DEPTH)
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, TREES * DEPTH) for i in (0, 1))
            s = (x == y).mean(1)
            s = s[s >= THRESHOLD[0] / THRESHOLD[1]]
            weight = 1 / (1 - missed(s, depth))
            links += weight.sum()
            lost += [(weight * missed(s, d)).sum() for d in range(1, DEPTH + 1)]
        yield pa.RecordBatch.from_pydict({"links": [links], "lost": [lost.tolist()]}, schema=pa.schema([("links", pa.float64()), ("lost", pa.list_(pa.float64()))]))

    sums = pairs.mapInArrow(add, "links double, lost array<double>").agg(F.sum("links"), *(F.sum(F.col("lost")[d]) for d in range(DEPTH))).first()
    return sums[0] or 0.0, [x or 0.0 for x in sums[1:]]


def candidates(nodes: DataFrame, recall: float = RECALL) -> tuple[DataFrame, list[int]]:
    """Edges (a, b) between texts that met at the depth with the target recall, and the depths on the way there."""
    floor = least_depth(THRESHOLD[0] / THRESHOLD[1], TREES, DEPTH, recall)
    trees, depth, seen = forest(nodes), DEPTH, []
    while True:
        seen.append(depth)
        edges = matches(trees, depth)
        following = shorten(depth, *measure(edges, nodes, depth), recall, floor)
        if following == depth:
            remove(nodes.sparkSession, trees)
            return edges, seen
        remove(nodes.sparkSession, edges)
        depth = following


# -- verification ----------------------------------------------------------------------------------------------------
def common_terms(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common terms of each left and each right set of distinct terms."""
    n, m = len(left), len(right)
    flat = lambda sets: (np.concatenate(sets) if sets else np.empty(0, np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (x, i), (y, j) = flat(left), flat(right)
    order = np.argsort(y, kind="stable")
    y, j = y[order], j[order]
    lo, hi = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    both = hi > lo
    x, i, lo, n_right = x[both], i[both], lo[both], (hi - lo)[both]
    out = np.zeros((n, m), np.float32)
    order = np.argsort(x, kind="stable")
    x, i, lo, n_right = x[order], i[order], lo[order], n_right[order]
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    n_left = np.diff(np.r_[starts, len(x)])
    often = n_left * n_right[starts] > 64
    rare = ~np.repeat(often, n_left)
    ii, ll, kk = i[rare], lo[rare], n_right[rare]
    upto, s = np.cumsum(kk), 0
    while s < len(ii):  # terms of few sets: their pairs one by one, some at a time
        e = max(s + 1, int(np.searchsorted(upto, upto[s] - kk[s] + PAIRS, "right")))
        a, b, k = ii[s:e], ll[s:e], kk[s:e]
        at = np.repeat(b - (upto[s:e] - k - (upto[s] - kk[s])), k) + np.arange(k.sum())
        out += np.bincount(np.repeat(a, k) * m + j[at], minlength=n * m).reshape(n, m)
        s = e
    terms = np.flatnonzero(often)
    for s in range(0, len(terms), 1024):  # terms of many sets: a product of membership matrices
        part = terms[s : s + 1024]
        u, v = np.zeros((n, len(part)), np.float32), np.zeros((len(part), m), np.float32)
        for k, t in enumerate(part):
            a = starts[t]
            u[i[a : a + n_left[t]], k] = 1
            v[k, j[lo[a] : lo[a] + n_right[a]]] = 1
        out += u @ v
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], sizes: tuple, lead: int = 0, less: tuple | None = None) -> np.ndarray:
    """Which pairs of sets reach the threshold.  With ``lead``, the terms are differences from a lead of so many shingles, and ``less`` tells
    how many of the lead's shingles each set lacks."""
    common = common_terms(left, right).astype(np.int64)
    if less is not None:
        common += lead - less[0][:, None] - less[1][None, :]
    p, q = THRESHOLD
    return common * (p + q) >= p * (sizes[0][:, None] + sizes[1][None, :])  # i / (a + b - i) >= p / q


def _parts(links: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected part."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(rows: list[tuple]) -> np.ndarray:
    """The symmetric matrix of links in a block: all pairs of side 0, or pairs of sides 1 and 2.  rows: (side, node, size, less, lead, terms)."""
    n = len(rows)
    side = np.array([r[0] for r in rows])
    sizes, less = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
    out = np.zeros((n, n), bool)
    one, two = (np.arange(n),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    for s in range(0, len(one), 256):
        part = one[s : s + 256]
        out[np.ix_(part, two)] = linked([rows[i][5] for i in part], [rows[i][5] for i in two], (sizes[part], sizes[two]), rows[0][4], (less[part], less[two]))
    np.fill_diagonal(out, False)
    return out | out.T


def _verify(blocks: DataFrame) -> DataFrame:
    """blocks: (task, side, node, size, less, lead, terms), sorted by task within partitions -> (node, root, links) of each block."""
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])

    def settle(task: list[tuple]) -> list[tuple]:
        rows = list({r[1]: r for r in task}.values())  # repeated rows of one text count once
        if len(rows) < 2:
            return []
        links = _block_links(rows)
        degree, root = links.sum(1), _parts(links)
        return [(rows[i][1], rows[root[i]][1], int(degree[i])) for i in np.flatnonzero(degree)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def flush():
            nonlocal out
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], schema.types, strict=True)], schema=schema)
            out = []
            return got

        for b in batches:
            lists = b.column(6)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (task, *row) in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True)):
                if task != now:
                    out += settle(rows)
                    now, rows = task, []
                    if len(out) > 5000:
                        yield flush()
                rows.append((*row, flat[at[i] : at[i + 1]]))
        out += settle(rows)
        yield flush()

    return blocks.mapInArrow(run, "node binary, root binary, links long")


def _shingled(members: DataFrame) -> DataFrame:
    """members: (node, root, size, text) -> (node, root, size, terms)."""
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("size", pa.int32()), ("terms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            found = [shingles(t, known=known).view(np.int64) for t in b.column(3).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), b.column(1).cast(pa.binary()), b.column(2), lists], schema=schema)

    return members.select("node", "root", "size", "text").mapInArrow(run, "node binary, root binary, size int, terms array<long>")


def _differences(members: DataFrame) -> DataFrame:
    """members: (node, root, size, terms), of large components -> with (less, lead, terms): what tells a text from its component's lead, if that is less in
    all, otherwise all shingles (lead and less 0)."""
    # the lead: the first text of the component's most frequent size class
    size_class = F.floor(F.log("size") / math.log(SIZE_BASE)).cast("int")
    classes = members.groupBy("root", size_class.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    lead = classes.groupBy("root").agg(F.max(F.struct("n", "node")).alias("x")).select("root", F.col("x.node").alias("node"))
    leads = cut(members.join(lead, ["root", "node"]).dropDuplicates(["root"]).select("root", F.col("terms").alias("l")), "leads")
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("size", pa.int32()), ("less", pa.int32()), ("lead", pa.int32()), ("terms", pa.list_(pa.int64())), ("differs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, root, size, terms, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                terms, own = terms.values.to_numpy(), own.values.to_numpy()
                d = np.setxor1d(terms, own, assume_unique=True)
                less = (len(d) + len(own) - len(terms)) // 2
                out.append((node, root, size, less, len(own), d, len(d)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, schema.types, strict=True)], schema=schema)

    told = cut(members.select("root", "node", "size", "terms").join(leads, "root").select("node", "root", "size", "terms", "l").mapInArrow(run, "node binary, root binary, size int, less int, lead int, terms array<long>, differs long"), "differences")
    short = cut(told.groupBy("root").agg((F.sum("differs") < F.sum("size")).alias("short")).filter("short").select("root"), "told-apart")
    by_lead = told.join(short, "root").drop("differs")
    whole = members.join(short, "root", "left_anti").select("node", "root", "size", F.lit(0).alias("less"), F.lit(0).alias("lead"), "terms")
    return by_lead.select(*whole.columns).unionByName(whole)


def _tasks(members: DataFrame) -> DataFrame:
    """members: (node, root, size, less, lead, terms) of large components -> with (task, side): the blocks in which a node is compared."""
    sized = members.withColumn("s", F.floor(F.log("size") / math.log(SIZE_BASE)).cast("int"))
    per = sized.groupBy("root", "s").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("terms")) / BLOCK_SHINGLES, F.lit(1))).cast("int").alias("k"))
    below = per.select("root", (F.col("s") + 1).alias("s"), F.col("k").alias("k_below"))
    above = per.select("root", (F.col("s") - 1).alias("s"), F.col("k").alias("k_above"))
    # a table of its own, so that a large component's rows can be split in the join that reads it
    per = cut(per.join(below, ["root", "s"], "left").join(above, ["root", "s"], "left"), "size-classes")
    placed = sized.join(per, ["root", "s"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    s, c, k = F.col("s"), F.col("c"), F.col("k")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda s1, c1, s2, c2, side: F.struct(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"), side.alias("side"))
    own = F.transform(upto(k), lambda o: pair(s, F.least(c, o), s, F.greatest(c, o), F.when(o == c, 0).when(c < o, 1).otherwise(2)))
    up = F.transform(upto(F.coalesce("k_above", F.lit(0))), lambda o: pair(s, c, s + 1, o, F.lit(1)))
    down = F.transform(upto(F.coalesce("k_below", F.lit(0))), lambda o: pair(s - 1, o, s, c, F.lit(2)))
    placed = placed.withColumn("t", F.explode(F.concat(own, up, down)))
    task = F.md5(F.concat(F.hex("root"), *(x for f in ("s1", "c1", "s2", "c2") for x in (F.lit(":"), F.col(f"t.{f}").cast("string")))))
    return placed.select(task.alias("task"), F.col("t.side").alias("side"), "node", "size", "less", "lead", "terms")


def _blocks(members: DataFrame) -> DataFrame:
    """members: (node, root, size, terms) -> rows of the blocks in which they are compared."""
    one = (F.count(F.lit(1)) <= BLOCK) & (F.sum("size") <= BLOCK_SHINGLES)
    large = cut(members.groupBy("root").agg(one.alias("one")).filter("not one").select("root"), "large-components")
    small = members.join(large, "root", "left_anti").select(F.hex("root").alias("task"), F.lit(0).alias("side"), "node", "size", F.lit(0).alias("less"), F.lit(0).alias("lead"), "terms")
    return small.unionByName(_tasks(_differences(members.join(large, "root"))))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, class_id, n_links, n_copies): one row for each row of ``docs``; node is the MD5 of the text."""
    prepare(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    signed = cut(_signatures(rows), "signatures")
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("labels").alias("labels")), "nodes")
    edges, _ = candidates(nodes.filter("size > 0").select("node", "labels"))
    groups = components(edges)
    wanted = cut(groups.join(nodes.select("node", "rep", "size"), "node"), "members")
    # always by a merge join: a join that is broadcast on small inputs only would behave differently on large ones
    texts = rows.join(wanted.hint("merge"), (rows["node"] == wanted["node"]) & rows["doc_id"].eqNullSafe(wanted["rep"])).select(rows["node"], "root", "size", "text")
    members = cut(_shingled(texts).dropDuplicates(["node"]), "shingles")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verified = cut(_verify(_blocks(members).repartition(n, "task").sortWithinPartitions("task")), "verified")
    degrees = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.filter(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")))
    ids = cut(classes.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id")), "class-ids")
    of_node = classes.join(ids, "root").join(degrees, "node").select("node", "class_id", "links")
    # a table of its own, so that both sides of the next join are shuffled for it and the copies of one text can be split
    per_node = cut(nodes.select("node", "rep", "copies", "size").join(of_node, "node", "left"), "classes")
    return signed.select("doc_id", "node").join(per_node, "node").select(
        "doc_id",
        "node",
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.coalesce("class_id", "rep")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its smallest doc_id.  Texts without words all stay."""
    key = lambda i, node: F.md5(F.concat(F.coalesce(i.cast("long").cast("string"), F.lit("")), F.lit(":"), node))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    lone = F.col("class_id").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))
    keep = found.filter(lone).select(key(F.col("doc_id"), F.hex("node")).alias("__tw_k"))  # repeats don't matter to a semi join
    text = text_or_empty(text_col)
    empty = F.trim(F.regexp_replace(text, r"\s+", "")) == ""
    worded = docs.filter(~empty).withColumn("__tw_k", key(F.col(id_col), F.upper(F.md5(text))))
    # one key for the join and for repeated rows, so that rows move once
    kept = worded.join(keep.hint("merge"), "__tw_k", "left_semi").dropDuplicates(["__tw_k"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.filter(empty).select(*columns))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies")


#: All pairs of texts by their common shingles, and what can be reached over links.
OP5_SQL = r"""
WITH RECURSIVE t AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS copies, list_filter(regexp_split_to_array(lower(coalesce(any_value(text), '')), '\s+'), lambda x: x <> '') AS w FROM documents GROUP BY coalesce(text, '')),
sh AS (
  SELECT rep, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM t),
n AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.rep <> y.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c * 9 >= 4 * (x.n + y.n)),
r(a, b) AS (SELECT rep, rep FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, CASE WHEN len(w) = 0 THEN d.doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links, CASE WHEN len(w) = 0 THEN 0 ELSE copies - 1 END AS n_copies
FROM documents d JOIN t ON coalesce(d.text, '') = t.text LEFT JOIN c ON c.a = t.rep LEFT JOIN k ON k.a = t.rep
"""
