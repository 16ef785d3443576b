"""Deterministic acyclic automata of token frames, as edge tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Frames that a grammar may have; more are refused rather than brought to the driver.
LARGEST = 200_000


def _collected(frames: DataFrame) -> list:
    rows = frames.orderBy("frame").limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"more than {LARGEST} frames: mask items before compiling")
    return rows


def compile_frames(frames: DataFrame) -> DataFrame:
    """(frame, support) -> (src, symbol, dst, accepts): the minimal automaton of the frames.

    A grammar has far fewer frames than requests, since items are masked; the frames, ``LARGEST`` at most, come to the driver, and states with
    equal futures are joined there from the ends backwards.  State 0 starts; a state without edges has one row with null symbol.
    """
    trie: dict = {}
    for r in _collected(frames):
        node = trie
        for w in r.frame.split(" "):
            node = node.setdefault(w, {})
        node[None] = r.support
    known: dict = {}

    def join(node: dict) -> int:
        key = (node.get(None), tuple((w, join(n)) for w, n in sorted((k, v) for k, v in node.items() if k is not None)))
        return known.setdefault(key, len(known))

    top = join(trie)
    number = {old: 0 if old == top else old + 1 for old in known.values()}
    rows = []
    for (support, edges), old in known.items():
        rows += [(number[old], w, number[to], support) for w, to in edges] or [(number[old], None, None, support)]
    return frames.sparkSession.createDataFrame(rows, "src int, symbol string, dst int, accepts long")


def dot(edges: DataFrame) -> DataFrame:
    """(src, line): a graph description, one line for each state's edges, labels gathered by target."""
    by_target = edges.filter("symbol IS NOT NULL").groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ", ").alias("label"))
    return by_target.select("src", F.format_string('%d -> %d [label="%s"];', "src", "dst", "label").alias("line"))


# -- learning by merging ---------------------------------------------------------------------------------------------
def structural_negatives(frames: list[tuple[str, ...]], slot: str = "<item>") -> set[tuple[str, ...]]:
    """What a grammar should refuse: proper prefixes of frames, and frames without their slot, unless they are frames themselves."""
    cut = {f[:i] for f in frames for i in range(len(f))} | {tuple(w for w in f if w != slot) for f in frames}
    return cut - set(frames)


class _Merged:
    """A prefix tree whose states are merged: each state stands for a block of tree nodes."""

    def __init__(self):
        self.to: list[dict[str, int]] = [{}]
        self.label: list[bool | None] = [None]

    def add(self, words: tuple[str, ...], label: bool) -> None:
        state = 0
        for w in words:
            if w not in self.to[state]:
                self.to[state][w] = len(self.to)
                self.to.append({})
                self.label.append(None)
            state = self.to[state][w]
        self.label[state] = label

    def merged(self, red: int, blue: int) -> "_Merged | None":
        """This machine with ``blue`` folded into ``red``, and what follows from it; None where an accepting state would meet a refusing one."""
        new = _Merged()
        new.to, new.label = [dict(t) for t in self.to], list(self.label)
        for t in new.to:
            for w, x in t.items():
                if x == blue:
                    t[w] = red
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            if None not in (new.label[a], new.label[b]) and new.label[a] != new.label[b]:
                return None
            new.label[a] = new.label[b] if new.label[a] is None else new.label[a]
            for w, x in new.to[b].items():
                if w in new.to[a]:
                    todo.append((new.to[a][w], x))
                else:
                    new.to[a][w] = x
        return new


def learn_acceptor(positive: list[tuple[str, ...]], negative: set[tuple[str, ...]]) -> tuple[list[tuple[int, str, int]], set[int]]:
    """(edges, accepting states) of a machine that takes all positive and no negative sequences, by red-blue state merging.

    States that are settled are red, their other successors blue.  Each blue state, nearest first, is merged into the first red one with which no accepting state
    meets a refusing one; if there is none, it becomes red.  So the machine also takes sequences that it was never shown.
    """
    machine = _Merged()
    for words, label in sorted([(p, True) for p in set(positive)] + [(n, False) for n in negative]):
        machine.add(words, label)
    red = [0]
    while True:
        blue = [x for r in red for _, x in sorted(machine.to[r].items()) if x not in red]
        if not blue:
            break
        found = next((m for r in red if (m := machine.merged(r, blue[0])) is not None), None)
        if found is None:
            red.append(blue[0])
        else:
            machine = found
    number = {r: i for i, r in enumerate(red)}
    edges = sorted((number[r], w, number[x]) for r in red for w, x in machine.to[r].items())
    return edges, {number[r] for r in red if machine.label[r]}


def learn_frames(frames: DataFrame) -> tuple[list[tuple[int, str, int]], set[int]]:
    """A machine learnt from (frame, ...) and their structural negatives."""
    positive = [tuple(r.frame.split(" ")) for r in _collected(frames.select("frame").distinct())]
    return learn_acceptor(positive, structural_negatives(positive))


# -- models ----------------------------------------------------------------------------------------------------------
FORMAT = "turnwise-machine-1"


def compile_records(records: DataFrame) -> dict[str, DataFrame]:
    """Tables of a model from (type, text, state, event, action, next_state, _source): edges, controller, config.

    Queries give frames; a (state, event) with several outcomes is refused, with the places of two of them.
    """
    frames = records.filter("type = 'query'").groupBy(F.col("text").alias("frame")).agg(F.count(F.lit(1)).alias("support"))
    moves = records.filter("type = 'transition'").groupBy("state", "event").agg(F.min(F.struct("action", "next_state", "_source")).alias("a"), F.max(F.struct("action", "next_state", "_source")).alias("b"), F.count(F.lit(1)).alias("support"))
    broken = moves.filter((F.col("a.action") != F.col("b.action")) | (F.col("a.next_state") != F.col("b.next_state"))).first()
    if broken:
        raise ValueError(f"({broken.state}, {broken.event}) has two outcomes: {broken.a._source} and {broken.b._source}")
    start = [r.state for r in records.filter("type = 'config'").select("state").distinct().limit(2).collect()]
    if len(start) != 1:
        raise ValueError(f"{len(start)} start states")
    config = records.sparkSession.createDataFrame([(FORMAT, start[0])], "format string, start_state string")
    return {"edges": compile_frames(frames), "controller": moves.select("state", "event", "a.action", "a.next_state", "support"), "config": config}


def dump_model(model: dict[str, DataFrame], path: str) -> None:
    for name, t in model.items():
        t.write.mode("error").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dumped model; anything else is refused."""
    config = spark.read.parquet(f"{path}/config")
    formats = [r.format for r in config.select("format").limit(2).collect()] if "format" in config.columns else []
    if formats != [FORMAT]:
        raise ValueError(f"{path} has format {formats}, expected {FORMAT}")
    return {"config": config, **{n: spark.read.parquet(f"{path}/{n}") for n in ("edges", "controller")}}
