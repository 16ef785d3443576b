"""The rules of a dialogue on inventories of any size: a request meets the phrases, items and families that it speaks of, never an inventory.

A rule runs on a ``View`` of its setting's inventory, which holds the answers that it has so far.  A rule that needs another answer stops with its questions; each
distinct question is answered once, by a join with a table of the inventory, and the rule runs again with more answers until every row has its result.  The
first round asks for all phrases in a row's texts, so most rows are through in the second.  An answer is bounded: of many items it tells the number
and the first, which is all that rules look at.
"""

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import keeper
from .dialogue import CANDIDATES, HEAD, Inventory, Members, compact, normal, spread, tokens


class Need(Exception):
    """Raised where a rule has no answer yet: runs of words whose phrases it asks for, and questions (kind, *key)."""

    def __init__(self, runs: list[str] = (), questions: list[tuple] = ()):
        super().__init__()
        self.runs, self.questions = list(runs), list(questions)


class Named(list):
    """The first ids of ``count`` items that some phrases name."""

    def __init__(self, ids: Iterable[str], count: int, families: list[str], phrases: tuple[str, ...]):
        super().__init__(ids)
        self.count, self.families, self.phrases = count, families, phrases

    def __len__(self) -> int:
        return self.count

    def __bool__(self) -> bool:
        return self.count > 0


class _Items:
    """Items by id, as far as they are asked for."""

    def __init__(self, view: "View"):
        self.view, self.own = view, {}

    def get(self, key, default=None):
        if not isinstance(key, str) or not key:
            return default
        found = self.own[key] if key in self.own else self.view.ask("item", key)
        return default if found is None else found

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def values(self):
        raise ValueError("an inventory of this size isn't walked: name the candidates")


@lru_cache(maxsize=4096)
def _answer(text: str) -> tuple[tuple, object]:
    """(question, answer) of a row of ``_Tables``; shared by requests, and changed by none."""
    x = json.loads(text)
    kind, key = x["kind"], x["key"]
    if kind == "phrase":
        return (kind, key[0]), {k: [tuple(json.loads(v)) if k == "attribute" else v for v in x["told"]] for k in [key[1]]} if key[1] != "item" else {"item": Named(x["ids"], x["n"], x["families"], (key[0],)), "bodies": [json.loads(b) for b in x["bodies"]]}
    if kind == "item":
        return (kind, *key), json.loads(x["body"])
    if kind == "union":
        return (kind, *key), x["n"]
    members = Members(x["n"], [json.loads(b) for b in x.get("bodies", [])])
    return (kind, *key), (members, [(t["k"], t["differs"]) for t in x.get("told") or []])


class View:
    """What a rule sees of an inventory; the interface of ``dialogue.Inventory`` that rules use."""

    spans_of = Inventory.spans

    def __init__(self, known: Iterable[str], asked: Iterable[str], lengths: list[int]):
        self.asked, self.lengths, self.longest = set(asked), lengths, max(lengths, default=0)
        self.phrases, self.answers, self.items = {}, {}, _Items(self)
        for question, answer in map(_answer, known):
            if question[0] != "phrase":
                self.answers[question] = answer
                continue
            own = self.phrases.setdefault(tuple(question[1].split(" ")), {})
            own.update((k, v) for k, v in answer.items() if k != "bodies")
            self.items.own.update((x["id"], x) for x in answer.get("bodies", ()))

    def ask(self, *question: str):
        """The answer to a question; None where the inventory has none."""
        if question not in self.answers and compact(question) not in self.asked:
            raise Need(questions=[question])
        return self.answers.get(question)

    def want(self, runs: Iterable[list[str]]) -> None:
        """Stop unless the phrases of all these runs of words are known."""
        joined = dict.fromkeys(" ".join(words) for words in runs if words)
        had = [f" {a} " for a in self.asked if not a.startswith("[")]
        if new := [r for r in joined if r not in self.asked and not any(f" {r} " in a for a in had)]:
            raise Need(runs=new)

    def read(self, texts: Iterable[str | None]) -> None:
        """Ask for the phrases of texts at once, in both ways of reading them."""
        self.want(words for t in texts for words in (tokens(t), re.findall("[a-z0-9]+", normal(t))))

    def grams(self, run: str) -> Iterable[str]:
        words = run.split(" ")
        return (" ".join(words[i : i + n]) for n in self.lengths for i in range(len(words) - n + 1))

    def spans(self, words: list[str], kinds: list[str]):
        self.want([words])
        return self.spans_of(words, kinds)

    def families_of(self, values: Named) -> list[str]:
        return values.families

    def union(self, one: Named, other: Named) -> Named:
        phrases = tuple(sorted({*one.phrases, *other.phrases}))
        ids = list(dict.fromkeys([*one, *other]))
        whole = all(len(x) <= HEAD for x in (one, other))
        return one if phrases == one.phrases else Named(ids if whole else ids[:HEAD], len(ids) if whole else self.ask("union", *phrases), [], phrases)

    def members(self, name, attributes: dict | None = None) -> Members:
        if not isinstance(name, str):
            return Members(0, [])
        if not attributes:
            return self._family(name)[0]
        found = self.ask("having", name, *(x for kv in sorted(attributes.items()) for x in kv))
        return found[0] if found else Members(0, [])

    def _family(self, name) -> tuple[Members, list]:
        return (self.ask("family", name) if isinstance(name, str) else None) or (Members(0, []), [])

    def keys(self, family: str) -> set[str]:
        return {k for k, _ in self._family(family)[1]}

    def disagreeing(self, family: str) -> list[str]:
        return [k for k, differs in self._family(family)[1] if differs]


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType())
_ENTRY = _fields(of=_TEXT, id=_TEXT, family=_TEXT, body=_TEXT, entries=T.ArrayType(_fields(kind=_TEXT, phrase=_TEXT, value=_TEXT, pos=T.IntegerType())))


@pandas_udf(_ENTRY)
def _prepared(of: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for key, x in zip(of, rows.astype(object).where(rows.notna(), None).to_dict("records"), strict=True):
        x["attributes"] = dict(x["attributes"]) if x["attributes"] is not None else {}
        if "aliases" in x:
            x["aliases"] = list(x["aliases"]) if x["aliases"] is not None else []
        one = Inventory([x])
        (own,) = one.items.values()
        entries = [(kind, " ".join(words), compact(v) if kind == "attribute" else v, n) for words, kinds in one.phrases.items() for kind, values in kinds.items() for n, v in enumerate(values)]
        out.append((key, own["id"], own["family"], json.dumps(own, ensure_ascii=False), entries))
    return pd.DataFrame(out, columns=["of", "id", "family", "body", "entries"])


def _told(kind: Column, key: Column, **more: Column) -> Column:
    return F.to_json(F.struct(kind.alias("kind"), key.alias("key"), *(c.alias(n) for n, c in more.items()))).alias("answer")


def _first(rows: DataFrame, by: list[str], n: int, value: str) -> DataFrame:
    """by, and ``value`` of the n rows with the smallest ids, in order."""
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("rank") <= n)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("x")))), lambda x: x["x"]).alias(value))


class _Tables:
    """An inventory as tables of answers, keyed by setting and question."""

    def __init__(self, items: DataFrame, settings: DataFrame, keep: Callable[[DataFrame, str], DataFrame]):
        columns = [c for c in ("setting", "id", "name", "family", "attributes", "aliases", "drawer", "location") if c in items.columns]
        own = items.withColumn("of", _of(F.col("setting"))).join(settings, "of", "left_semi")
        self.keep = keep
        self.rows = keep(spread(own, "id").select(_prepared("of", F.struct(*columns)).alias("x")).select("x.*"), "items")
        twice = self.rows.groupBy("of", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
        if twice:
            raise ValueError(f"item {twice.id!r} repeats an id")
        self.phrases = keep(self._phrases(), "phrases")
        self.lengths = sorted(r.n for r in self.phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect())
        self.made: dict[str, DataFrame] = {}

    def _phrases(self) -> DataFrame:
        """(of, phrase, answer): a row for each kind of thing that a phrase names."""
        each = self.rows.select("of", "id", "family", "body", F.explode("entries").alias("e")).select("of", F.col("e.phrase").alias("phrase"), "id", "family", "body", "e.kind", "e.value", "e.pos")
        named, by = each.filter("kind = 'item'"), ["of", "phrase"]
        count = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("family")).alias("families"))
        ids = _first(named.withColumn("x", F.struct("id", "body")), by, HEAD, "x")
        first = F.transform(F.slice("x", 1, CANDIDATES), lambda x: x["body"])
        key = lambda kind: F.array(F.col("phrase"), kind)
        item = count.join(ids, by).select(*by, _told(F.lit("phrase"), key(F.lit("item")), n=F.col("n"), families=F.col("families"), ids=F.col("x.id"), bodies=first))
        other = each.filter("kind <> 'item'").groupBy(*by, "kind", "value").agg(F.min(F.struct("id", "pos")).alias("at"))
        told = other.groupBy(*by, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("told"))
        return item.unionByName(told.select(*by, _told(F.lit("phrase"), key(F.col("kind")), told=F.col("told"))))

    def _having(self) -> DataFrame:
        return self.rows.select("of", "id", "family", "body", F.explode(F.from_json(F.get_json_object("body", "$.attributes"), "map<string,string>")).alias("k", "v"))

    def table(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.keep({"family": self._family, "having": self._having}[name](), name)
        return self.made[name]

    def _family(self) -> DataFrame:
        by = ["of", "family"]
        count = self.rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        keyed = self.table("having").groupBy(*by, "k").agg(F.count(F.lit(1)).alias("having"), (F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("values"), F.max(F.col("v").isNull()).alias("none"))
        lacks = (F.col("having") < F.col("n")) & ~F.col("none")
        told = keyed.join(count, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", (F.col("values") + lacks.cast("int") > 1).alias("differs")))).alias("told"))
        all_of = count.join(_first(self.rows, by, CANDIDATES, "body"), by).join(told, by, "left")
        return all_of.select("of", F.col("family").alias("name"), _told(F.lit("family"), F.array("family"), n=F.col("n"), bodies=F.col("body"), told=F.col("told")))

    def answers(self, kind: str, asked: DataFrame) -> DataFrame:
        """(of, question, answer) of distinct questions (of, question, key) of a kind; questions without an answer give no row."""
        if kind == "family":
            return asked.withColumn("name", F.col("key")[0]).join(self.table("family"), ["of", "name"]).select("of", "question", "answer")
        if kind == "item":
            met = asked.withColumn("id", F.col("key")[0]).join(self.rows.select("of", "id", "body"), ["of", "id"])
            return met.select("of", "question", _told(F.lit(kind), F.col("key"), body=F.col("body")))
        if kind == "union":
            named = self.rows.select("of", "id", F.explode("entries").alias("e")).filter("e.kind = 'item'").select("of", F.col("e.phrase").alias("phrase"), "id")
            met = asked.withColumn("phrase", F.explode("key")).join(named, ["of", "phrase"]).groupBy("of", "question", "key").agg(F.count_distinct("id").alias("n"))
            return met.select("of", "question", _told(F.lit(kind), F.col("key"), n=F.col("n")))
        # items of a family by their rarest wanted attribute, kept if they have all of them
        having, by = self.table("having"), ["of", "family", "k", "v"]
        pairs = asked.withColumn("p", F.explode(F.sequence(F.lit(1), F.size("key") - 2, F.lit(2)))).select("of", "question", "key", F.col("key")[0].alias("family"), F.get("key", F.col("p")).alias("k"), F.get("key", F.col("p") + 1).alias("v"))
        counted = pairs.join(having.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, "left")
        rarest = counted.groupBy("of", "question", "key", "family").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "v")).alias("x")).filter("x.n > 0").select("of", "question", "key", "family", "x.k", "x.v")
        own = F.from_json(F.get_json_object("body", "$.attributes"), "map<string,string>")
        fits = F.forall(F.sequence(F.lit(1), F.size("key") - 2, F.lit(2)), lambda p: F.coalesce(F.try_element_at(own, F.get("key", p)) == F.get("key", p + 1), F.lit(False)))
        met = rarest.join(having, by).filter(fits).select("of", "question", "key", "id", "body")
        to = ["of", "question", "key"]
        all_of = met.groupBy(*to).agg(F.count(F.lit(1)).alias("n")).join(_first(met, to, CANDIDATES, "body"), to)
        return all_of.select("of", "question", _told(F.lit(kind), F.col("key"), n=F.col("n"), bodies=F.col("body")))


def _of(setting: Column) -> Column:
    """A setting as a key of joins: rows without one meet the items without one."""
    return F.coalesce(F.concat(F.lit("="), setting.cast("string")), F.lit(""))


_OPEN = _fields(done=T.BooleanType(), runs=_LIST, grams=_LIST, questions=T.ArrayType(_fields(question=_TEXT, kind=_TEXT, key=_LIST)))


def _tried(schema: T.StructType, rule: Callable, texts: Callable, lengths: list[int]):
    """Results of a rule where it has all answers, else what it asks for."""
    kind = T.StructType([*schema.fields, *_OPEN.fields])

    @pandas_udf(kind)
    def tried(*given: pd.Series) -> pd.DataFrame:
        out = []
        for *row, known, asked in zip(*given, strict=True):
            view = View(known, asked, lengths)
            try:
                view.read(texts(row, view))
                out.append((*rule(row, view), True, None, None, None))
            except Need as need:
                grams = list(dict.fromkeys(g for r in need.runs for g in view.grams(r)))
                out.append((*[None] * len(schema), False, need.runs, grams, [(compact(q), q[0], list(q[1:])) for q in need.questions]))
        return pd.DataFrame(out, columns=kind.names, dtype=object)

    return tried


def by_lookup(rows: DataFrame, keys: list[str], given: list[str], items: DataFrame, schema: T.StructType, rule: Callable, texts: Callable) -> DataFrame:
    """keys and ``schema`` by rule(values of ``given``, view of the setting's inventory) -> tuple; texts(values, view): what the rule will read, at least most of it.

    Tables that are read again are written to the shared folder, one for each round.
    """
    keep = keeper(rows.sparkSession, "lookups")
    none = F.array().cast("array<string>")
    pending = spread(rows, keys[0]).withColumn("of", _of(F.col("setting"))).withColumn("row", F.monotonically_increasing_id()).withColumns({"known": none, "asked": none})
    tables = _Tables(items, rows.select(_of(F.col("setting")).alias("of")).distinct(), keep)
    tried = _tried(schema, rule, texts, tables.lengths)
    own, results, n = [*dict.fromkeys([*keys, *given]), "of", "row", "known", "asked"], [], 0
    while True:
        now = keep(pending.select(*own, tried(*given, "known", "asked").alias("r")), f"round{n}")
        results.append(now.filter("r.done").select(*keys, *(F.col(f"r.{c}").alias(c) for c in schema.names)))
        left = now.filter("NOT r.done")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, results)
        found = left.select("row", "of", F.explode("r.grams").alias("phrase")).join(tables.phrases, ["of", "phrase"]).select("row", "answer")
        questions = left.select("row", "of", F.explode("r.questions").alias("q")).select("row", "of", "q.*")
        for kind in sorted(r.kind for r in questions.select("kind").distinct().collect()):
            mine = questions.filter(F.col("kind") == kind)
            told = tables.answers(kind, mine.select("of", "question", "key").distinct())
            found = found.unionByName(mine.select("row", "of", "question").join(told, ["of", "question"]).select("row", "answer"))
        more = found.groupBy("row").agg(F.collect_list("answer").alias("more"))
        asks = F.concat("asked", "r.runs", F.transform("r.questions", lambda q: q["question"]))
        pending = spread(left.join(more, "row", "left"), "row").select(*own[:-2], F.concat("known", F.coalesce("more", none)).alias("known"), asks.alias("asked"))
        n += 1
