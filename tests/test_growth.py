"""Work that grows with the tables and not with their square: what is counted here is what used to be walked for each row."""

import hashlib
import inspect
import json
import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import alignment, matching
from turnwise.operators import dialogue as D
from turnwise.plans import catalog
from turnwise.sources import files

SF = "/root/testdata/sf0.001"


class Walked(dict):
    """Items that count how often all of them are walked."""

    walks = 0

    def values(self):
        Walked.walks += 1
        return super().values()


def _items(n, rng):
    return [{"id": str(i), "name": f"{rng.choice(['red', 'blue'])} {rng.choice(['ring', 'bolt'])}" + (f" {i}" if i % 3 else ""), "family": rng.choice(["SMALL", "LARGE", f"own{i}"]), "attributes": {k: str(rng.randint(1, 3)) for k in ("brand", "size") if rng.random() < 0.8}, "drawer": rng.choice([None, "drawer 1"])} for i in range(n)]


def test_requests_do_not_walk_the_inventory():
    rng = random.Random(5)
    inv = D.Inventory(_items(200, rng))
    inv.items = Walked(inv.items)
    said = ["Which SMALL is here", "Where is the red ring?", "the LARGE 2", "hello friend", "No, I said the blue bolt"]
    raw = [D.compact(D.decision("clarify", item_family=f, attributes=a, missing_attributes=m)) for f, a, m in (("SMALL", {}, []), ("LARGE", {"size": "2"}, ["brand"]), (None, {}, []), ("none", {}, []))]
    D._judged([(None, t, r, None, None, p) for t in said for r in raw for p in (None, "The red ring is in drawer 1.")], lambda _: inv)
    assert Walked.walks == 0


def test_family_answers_equal_a_walk():
    rng = random.Random(6)
    items = _items(150, rng)
    inv = D.Inventory(items)
    for _ in range(500):
        family, wanted = rng.choice(["SMALL", "LARGE", "own7", "none", None]), {k: str(rng.randint(1, 4)) for k in ("brand", "size", "color") if rng.random() < 0.4}
        own = [x for x in items if x["family"] == family]
        want = [x["id"] for x in own if all(x["attributes"].get(k) == v for k, v in wanted.items())]
        n, head = inv.members(family, wanted)
        assert [x["id"] for x in inv.family(family, wanted)] == want and n == len(want) and [x["id"] for x in head] == want[: D.CANDIDATES]
        assert inv.disagreeing(family) == [k for k in sorted({k for x in own for k in x["attributes"]}) if len({x["attributes"].get(k) for x in own}) > 1]
        assert inv.keys(family) == {k for x in own for k in x["attributes"]}


def test_files_of_records_are_read_in_pieces(spark, tmp_path):
    row = lambda i: f'{{"id": "{i}", "text": "{"x" * (i % 50)}"}}'
    texts = {
        "unix.jsonl": "\n".join(map(row, range(3000))) + "\n",
        "open.jsonl": "\n".join(map(row, range(700))),
        "windows.jsonl": "\r\n".join(map(row, range(500))) + "\r\n\r\n  \r\n" + row(7) + "\r\n",
        "blank.jsonl": "\n\n" + row(1) + "\n\n",
        "marked.jsonl": "﻿" + row(1) + "\n" + row(2),
        "marked_too.jsonl": "﻿" + row(1) + "\n" + row(2) + "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = files.read_records(spark, [str(tmp_path / n) for n in texts], "id string")
        got = sorted((r["_source"].rsplit("/", 1)[1], r["_sha256"], r["id"]) for r in records.collect())
        assert "wholetext" not in inspect.getsource(files.read_records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for name, text in texts.items():
        for n, line in enumerate(text.removeprefix("﻿").split("\n")):
            if line.strip():
                want.append((f"{name}:{n + 1}", hashlib.sha256(text.encode()).hexdigest(), json.loads(line)["id"]))
    # a line of blanks with a carriage return is blank
    assert got == sorted(want)


def test_equal_claims_are_compared_once(spark, monkeypatch):
    rng = random.Random(3)
    said = ["where is the red ring", "no the blue bolt", "", None, "thanks"]
    claims = [(i, rng.choice("ab"), rng.choice(said)) for i in range(400)]
    told = [(rng.choice("ab"), i, rng.choice(["the red ring is here", "where is the blue bolt", "", None])) for i in range(40)]
    c, t = spark.createDataFrame(claims, "claim long, key string, text string"), spark.createDataFrame(told, "key string, transcript long, text string")
    got = {r.claim: (r.best, r.support) for r in alignment.evidence(c, t).collect()}
    for i, key, text in claims:
        support, best = min((-round(alignment.coverage(alignment._words(text), alignment._words(x)), 6), n) for k, n, x in told if k == key)
        assert got[i] == (best, -support)
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a, b):
        compared.add(len(a))
        return a.str.len() * 0.0

    monkeypatch.setattr(alignment, "covered", counted)
    alignment.evidence(c, t).collect()
    assert compared.value <= 2 * 4 * 4


def test_runs_of_words_are_not_sent_to_all_tasks(spark):
    plan = catalog.QUERIES["longest_candidate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_typing_by_join_carries_no_lists_of_items(spark):
    words = ["red ring", "blue bolt", "ring", "zz top"]
    table = [("a", w, "item", f"{w[0]}{i}") for w in words[:3] for i in range(30 if w != "ring" else 1)] + [("a", "bolt", "family", "bolt"), ("b", "red ring", "item", "r3"), ("a", "red ring", "family", "x")]
    phrases = spark.createDataFrame(table, "setting string, phrase string, kind string, value string")
    texts = ["the red ring", "red ring and blue bolt", "blue bolt and red ring and the red ring", "no i said the ring", "bolt", "", "zz top"]
    requests = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate((s, t) for s in ("a", "b", "c") for t in texts)], "id long, setting string, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    joined = matching.typed_features(requests, phrases, largest=1)
    assert rows(joined) == rows(matching.typed_features(requests, phrases))
    udf = [line for line in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line and "known" in line]
    assert udf and not any("values" in line for line in udf)


def test_judge_reviews_a_request_once_and_leaves_inventories_out_of_collections(monkeypatch):
    import gc

    from turnwise.operators import dialogue

    item = {"id": "1", "name": "blue ring", "family": "ring", "attributes": {"size": "7"}, "drawer": "drawer 2"}
    inv = dialogue._built("growth", "lab", lambda: {"lab": [item]})
    assert gc.get_freeze_count() > 0
    calls, own = [], dialogue.review
    monkeypatch.setattr(dialogue, "review", lambda q, i: calls.append(q) or own(q, i))
    row = dialogue._judge(("lab", "Where is the blue ring?", "no json", None, None, None), inv)
    assert row[3:6] == ("1", "locate", "no_json_object") and len(calls) == 1
    gc.unfreeze()


@pytest.mark.parametrize("name", ["slot_symbols", "tfidf_idf", "tfidf_norm", "lookup_outcome", "ngram_features", "hash_embedding"])
def test_requests_go_to_as_many_tasks_as_their_number_asks_for(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from turnwise.plans import base

    monkeypatch.setattr(base, "TASK_ROWS", 7)
    parts = -(-spark.read.parquet(f"{SF}/part.parquet").count() // 7)
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and f"{parts})" in plan


def test_equal_texts_are_embedded_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["hash_embedding"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan[plan.index("ArrowEvalPython") :]


def test_dialogues_are_aligned_in_as_many_tasks_as_a_shuffle_has(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["source_alignment"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_judge_works_out_only_what_is_wanted(spark, monkeypatch):
    inv = D.Inventory(_items(60, random.Random(8)))
    rows = [("lab", t, r, None, m, p) for t in ("Where is the red ring?", "Which SMALL is here", "No, I said the blue bolt 4", "", None) for r in (None, D.compact(D.decision("clarify", item_family="SMALL"))) for m in (None, '{"resolved_item_id":"4"}') for p in (None, "The red ring is in drawer 1.")]
    whole = [dict(zip(D._JUDGED.names, D._judge(row, inv), strict=True)) for row in rows]
    for name in D._JUDGED.names:
        assert [D._judge(row, inv, [name]) for row in rows] == [(x[name],) for x in whole]

    def refused(*_):
        raise AssertionError("not wanted")

    for name in ("prompt", "compile_template", "instantiate", "left_out"):
        monkeypatch.setattr(D, name, refused)
    styles, own = [], D.extract
    monkeypatch.setattr(D, "extract", lambda text, i, style="v3": styles.append(style) or own(text, i, style))
    assert [D._judge(row, inv, ["memory", "reply"]) for row in rows] == [(x["memory"], x["reply"]) for x in whole] and set(styles) == {"v3"}
    for query in ("memory_after", "rendered_replies", "reply_format", "seed_audit"):
        plan = catalog.QUERIES[query](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "j#" in plan and "prompt" not in plan and "left_out" not in plan


def test_inventories_are_sent_in_order_with_all_their_values(spark):
    rows = [("lab", "9", None, {"size": "1", "brand": None}, ["x"], None), ("lab", "10", "a b", None, None, "drawer 1"), (None, "2", "ü", {}, [], ""), ("lab", "1", "", {"k": ""}, ["y", "z"], "d")]
    items = spark.createDataFrame(rows, "setting string, id string, name string, attributes map<string,string>, aliases array<string>, drawer string")
    of = lambda r: {"setting": r[0], "id": r[1], "name": r[2], "attributes": r[3] or {}, "aliases": r[4], "drawer": r[5]}
    assert D._inventories(items.repartition(3), 4) == {"lab": [of(rows[3]), of(rows[1]), of(rows[0])], None: [of(rows[2])]}
    assert D._inventories(items, 3) is None and D._inventories(items.limit(0), 3) == {}


@pytest.mark.parametrize("largest", [1, 1000])
def test_draws_are_made_in_equal_ranges_and_equal_a_walk(spark, largest, monkeypatch):
    from turnwise.operators import metrics

    rng = random.Random(2)
    rows = [(u, rng.choice([True, False, None])) for u in (rng.randint(0, 3000) for _ in range(400))] + [(5000, None)]
    by = {}
    for u, x in rows:
        s, n = by.get(u, (0, 0))
        by[u] = (s + (x is True), n + (x is not None))
    sums = [by[u] for u in sorted(by)]
    means = []
    for r in range(1, 51):
        drawn = [sums[int(hashlib.md5(f"{r}:{k}".encode()).hexdigest()[:8], 16) % len(sums)] for k in range(len(sums))]
        means.append(sum(s for s, _ in drawn) / sum(n for _, n in drawn))
    means.sort()
    at = lambda q: means[int(q * 49)] + (means[int(q * 49) + 1] - means[int(q * 49)]) * (q * 49 - int(q * 49))
    monkeypatch.setattr(metrics, "TASK_DRAWS", 1000)
    known = spark.createDataFrame(rows, "u long, correct boolean")
    got = metrics.clustered_bootstrap(known, resamples=50, largest=largest)
    assert tuple(got.first()) == (round(at(0.025), 6), round(at(0.975), 6), 50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f"splits=Some({-(-50 * len(sums) // 1000)})" in plan and "Generate" not in plan
    told = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert ("BroadcastHashJoin" if largest > 1 else "ShuffledHashJoin") in told
    assert tuple(metrics.clustered_bootstrap(known.limit(0), resamples=5, largest=largest).first()) == (None, None, 0)


def test_items_words_are_not_sent_to_all_tasks(spark):
    """The items that ``word_subset`` looks phrases up for stay where they are; phrases are sent, or sorted if there are many."""
    plan = catalog.QUERIES["word_subset"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    rng = random.Random(8)
    words = [f"w{k}" for k in range(9)]
    keys = spark.createDataFrame([(i, rng.sample(words, rng.randint(0, 8))) for i in range(50)], "key int, words array<string>")
    phrases = spark.createDataFrame([(f"p{i}", rng.choices(words, k=rng.randint(0, 3))) for i in range(60)], "phrase string, words array<string>")
    sent, sorted_ = matching.subset_join(keys, phrases), matching.subset_join(keys, phrases, largest=5)
    assert "BroadcastHashJoin" not in sorted_._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, sorted_.collect())) and sent.count() > 50


def test_a_list_of_items_is_written_once_and_not_for_each_request(spark, tmp_path):
    """``items`` grows with the square where names are shared; what a writer stores of it doesn't."""
    names = [f"{a} {b}" for a in ("red", "blue", "old", "hot") for b in ("ring", "bolt")]
    table = [("a", n, "item", hashlib.sha256(f"{n}{i}".encode()).hexdigest()) for n in names for i in range(4000)]
    phrases = spark.createDataFrame(table, "setting string, phrase string, kind string, value string")
    requests = spark.createDataFrame([(i, "a", f"where is the {names[i % 8]}" if i % 9 else "thanks") for i in range(400)], "id long, setting string, text string").repartition(2)
    want = {n: ",".join(sorted(v for _, p, _, v in table if p == n)) for n in names}
    for largest in (100, 4):
        out = tmp_path / str(largest)
        matching.typed_features(requests, phrases, largest=largest).write.parquet(str(out))
        assert sum(f.stat().st_size for f in out.rglob("*.parquet")) < 2 * sum(map(len, want.values()))  # all requests' lists: 46 times their sum
        got = {r.id: r["items"] for r in spark.read.parquet(str(out)).collect()}
        assert got == {i: want[names[i % 8]] if i % 9 else "" for i in range(400)}
