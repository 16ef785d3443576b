"""Canonical JSON, losses, samples, committed tables and session commands."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import canonical as C
from turnwise.functions import losses
from turnwise.operators import agreement
from turnwise.plans import catalog, service_queries
from turnwise.sources.commits import Commits
from turnwise.streaming import commands, replay

SF = "/root/testdata/sf0.001"


# -- canonical JSON --------------------------------------------------------------------------------------------------
def some_value(rng, depth=0):
    kind = rng.randint(0, 5 if depth > 3 else 7)
    if kind == 6:
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == 7:
        return {rng.choice(["a", "B", "é", "𝒳", "�", "", "a b", '"', "\n"]) + str(rng.randint(0, 3)): some_value(rng, depth + 1) for _ in range(rng.randint(0, 5))}
    return [None, True, rng.randint(-(10**30), 10**30), rng.choice([0.1, 1e-7, 1e22, -0.0, 1.0, 123456789.125]), "".join(rng.choices('aé"\\/\n\t\x01\x1f\x7f😀 ', k=rng.randint(0, 6))), False][kind]


def spelled(v, rng):
    """Other key orders, spaces and escapes of the same value."""
    if isinstance(v, dict):
        items = list(v.items())
        rng.shuffle(items)
        return "{ " + " , ".join(f"{json.dumps(k)} : {spelled(x, rng)}" for k, x in items) + "}"
    if isinstance(v, list):
        return "[" + " ,\n".join(spelled(x, rng) for x in v) + "]"
    return json.dumps(v, ensure_ascii=rng.random() < 0.5)


def test_digests_are_pythons_and_dont_depend_on_key_order(spark):
    rng = random.Random(6)
    values = [some_value(rng) for _ in range(400)] + [{"z": {"y": [{"b": 1, "a": {"d": 1, "c": 2}}]}, "a": 1.50}]
    rows = [(i, spelled(v, rng)) for i, v in enumerate(values) for _ in range(3)]
    got = spark.createDataFrame(rows, "i int, t string").repartition(3).select("i", C.try_canonical(F.col("t")).alias("x")).select("i", "x.*", F.sha2("x.json", 256).alias("d")).collect()
    want = [json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for v in values]
    assert len(got) == 3 * len(values) and all(r.error is None and r.json == want[r.i] for r in got)
    assert len({(r.i, r.d) for r in got}) == len(values)


@pytest.mark.parametrize("text, says", [('{"a":1,"b":{"x":1,"x":2}}', "'x' is repeated"), ("[NaN]", "NaN"), ("[-Infinity]", "Infinity"), ("{", "Expecting"), ('"\\ud800"', "surrogate"), ("[" * 100_000, "deep"), ("1e999", "range"), ("", "Expecting")])
def test_what_has_no_canonical_form_is_refused(spark, text, says):
    r = spark.createDataFrame([(text,)], "t string").select(C.try_canonical(F.col("t")).alias("x")).first().x
    assert r["json"] is None and says.lower() in r["error"].lower()


def test_columns_of_any_kind(spark):
    df = spark.sql("SELECT named_struct('b', map('z', array(1.5D, 2.0D), 'a', array()), 'a', cast(null AS string), 'c', named_struct('y', 1e-7D, 'x', true)) AS v UNION ALL SELECT null")
    got = [r[0] for r in df.select(C.canonical(F.col("v"))).collect()]
    assert sorted(map(str, got)) == ["None", '{"a":null,"b":{"a":[],"z":[1.5,2.0]},"c":{"x":true,"y":1e-07}}']
    with pytest.raises(Exception, match="'a' is repeated"):
        spark.sql("SELECT 1 AS i").select(F.when(C.try_canonical(F.lit('{"a":1,"a":2}'))["error"].isNotNull(), F.raise_error(C.try_canonical(F.lit('{"a":1,"a":2}'))["error"]))).collect()


# -- losses ----------------------------------------------------------------------------------------------------------
def lse(xs):
    m = max(xs)
    return m if math.isinf(m) else m + math.log(sum(math.exp(x - m) for x in xs))


def test_losses_stay_finite_and_equal_the_formulas(spark):
    rows = [([1000.0, -1000.0, 999.0], [0, 2, 2], [0.0, 0.0, 0.0]), ([0.0, 0.0], [1], [-1000.0, 1000.0]), ([-1000.0, -1000.0], [0, 1], [5.0, 5.0]), ([3.0], [0], [7.0]), ([1e6, -1e6], [1], [1.0, 2.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<double>, c array<int>, r array<double>")
    got = df.select("i", losses.log_sum_exp(F.col("l")).alias("z"), losses.preference_loss(F.col("l"), F.col("c")).alias("p"), losses.kl_divergence(F.col("r"), F.col("l")).alias("k"), losses.recovery_loss(F.col("l"), F.col("c"), F.col("r"), 0.5).alias("w")).collect()
    for g in got:
        x, c, r = rows[g.i]
        q, p = [v - lse(r) for v in r], [v - lse(x) for v in x]
        want = lse(x), lse(x) - lse([x[j] for j in sorted(set(c))]), sum(math.exp(a) * (a - b) for a, b in zip(q, p, strict=True))
        assert np.allclose([g.z, g.p, g.k], want, rtol=1e-12, atol=1e-12) and g.w == pytest.approx(want[1] + 0.5 * want[2]) and math.isfinite(g.w)
    for bad in (F.array().cast("array<int>"), F.lit(None).cast("array<int>")):
        with pytest.raises(Exception, match="missing preference"):
            df.select(losses.preference_loss(F.col("l"), bad)).collect()
    with pytest.raises(ValueError, match="negative"):
        losses.recovery_loss(F.col("l"), F.col("c"), F.col("r"), -1)
    edges = spark.sql("SELECT array(-double('inf'), -double('inf')) AS a, array() AS b, array(double('inf'), 1.0D) AS c, array(null, 2.0D) AS d").select(*(losses.log_sum_exp(F.col(n).cast("array<double>")) for n in "abcd")).first()
    assert tuple(edges) == (-math.inf, None, math.inf, 2.0)


def test_log_sum_exp_of_rows_is_mergeable(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([rng.gauss(0, 1), rng.gauss(0, 3000), 1000.0, -1000.0])) for _ in range(3000)] + [("c", -5000.0)] * 7 + [("d", float("-inf"))] * 2 + [("e", None), ("f", float("inf")), ("f", 1.0), ("b", float("-inf"))]
    want = {k: lse([x for j, x in rows if j == k and x is not None]) for k in "abcdf"}
    for n in (1, 9):
        got = {r.k: r.log_sum_exp for r in losses.log_sum_exp_by(spark.createDataFrame(rows, "k string, x double").repartition(n), ["k"], F.col("x")).collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = losses.log_sum_exp_by(spark.createDataFrame(rows, "k string, x double"), ["k"], F.col("x"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


# -- samples ---------------------------------------------------------------------------------------------------------
def test_samples_dont_depend_on_partitions_order_or_repeats(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), str(rng.randint(0, 400))) for _ in range(2000)] + [("z", None), ("one", "1")]
    import hashlib

    h = lambda k: hashlib.sha256(f"7:{k}".encode()).hexdigest()
    for group in (None, "g"):
        want = {}
        for g, k in rows:
            if k is not None:
                want.setdefault(g if group else "", set()).add(k)
        want = {g: sorted(ks, key=h)[:25] for g, ks in want.items()}
        for n in (1, 7):
            df = spark.createDataFrame(rows, "g string, k string").repartition(n)
            got = {}
            for r in agreement.bottom_k(df, "k", 25, group=group).orderBy("rank").collect():
                got.setdefault(r.group, []).append(r.key)
            assert got == want


def test_agreement_is_by_value_and_counts_failures(spark):
    rows = [(str(i), json.dumps({"i": i}), json.dumps({"action": "x", "n": i})) for i in range(60)] * 2

    def ask(payload):
        i = json.loads(payload)["i"]
        if i % 5 == 0:
            raise RuntimeError
        return "no JSON" if i % 5 == 1 else json.dumps({"n": i + (i % 5 == 2), "action": "x"}, indent=2)

    df = spark.createDataFrame(rows, "key string, payload string, answer string").repartition(5)
    assert agreement.self_consistency(df, ask, sample=1000).first()[:] == (pytest.approx(0.4), 60)
    some = agreement.bottom_k(df, "key", 10).collect()
    assert agreement.self_consistency(df, ask, sample=10).first()[:] == (pytest.approx(sum(int(r.key) % 5 > 2 for r in some) / 10), 10)
    even = agreement.self_consistency(df, ask, sample=1000, valid=lambda a: F.get_json_object(a, "$.n").cast("int") % 2 == 0).first()
    assert even.agreement == pytest.approx(sum(i % 5 > 2 and i % 2 == 0 for i in range(60)) / 60)
    assert agreement.self_consistency(df.limit(0), ask).first()[:] == (None, 0)


# -- committed tables ------------------------------------------------------------------------------------------------
def rows_of(spark, ids, run):
    return spark.createDataFrame([(str(i), run) for i in ids], "id string, run string")


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_a_killed_run_leaves_nothing_and_a_restart_goes_on(spark, tmp_path):
    table = Commits(spark, str(tmp_path / "t"), "id string, run string")
    assert held(table) == [] and table.append(rows_of(spark, [1, 2, 2], "a"), "id") == 0

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.append(rows_of(spark, [2, 3, 4], "b"), "id", before_commit=die)
    assert held(table) == [("1", "a"), ("2", "a")]
    assert table.append(rows_of(spark, [2, 3, 4], "c"), "id") == 1
    assert held(table) == [("1", "a"), ("2", "a"), ("3", "c"), ("4", "c")]
    assert sorted(map(tuple, table.read(until=0).collect())) == [("1", "a"), ("2", "a")]
    assert table.append(rows_of(spark, [1, 4], "d"), "id") == -1 and len(table.entries()) == 2
    assert table.vacuum() == 0 and table.vacuum(older_than_seconds=-1) == 2  # the dead run's files, and those without rows
    assert len(held(table)) == 4


def test_of_two_writers_each_key_comes_once(spark, tmp_path):
    table = Commits(spark, str(tmp_path / "t"), "id string, run string")
    rivals = iter([[1, 2], [2, 3], []])

    def rival():
        if ids := next(rivals, []):
            Commits(spark, table.path, table.schema).append(rows_of(spark, ids, "rival"), "id")

    assert table.append(rows_of(spark, [1, 2, 3, 4], "slow"), "id", before_commit=rival) == 2
    assert held(table) == [("1", "rival"), ("2", "rival"), ("3", "rival"), ("4", "slow")]
    name = table.stage(rows_of(spark, [9], "late"))
    assert not table.commit(1, name) and table.commit(3, name) and ("9", "late") in held(table)


# -- session commands ------------------------------------------------------------------------------------------------
def said(seq, op=None, **more):
    row = {k: None for k in ("cart", "text", "condition", "rating", "reason", "case_id", "case_text", "dialogue", "observed_wait_seconds")}
    return {"session": "s", "seq": seq, "bad": op is None, "op": op, "answers": ["A", "B"], **row, **more}


def test_six_operations_and_what_they_refuse():
    s = commands.Session()
    steps = [
        (said(0, "continue", condition="learned"), False, "Send a message first."),
        (said(1, "rate", condition="learned", rating="uncertain"), False, "Nothing to rate."),
        (said(2, "message", cart="attic", text="hi"), False, "A message needs a cart."),
        (said(3, "message", cart="lab", text="  "), False, "A message needs a text."),
        (said(4, "message", cart="lab", text=" where? "), True, "A | B"),
        (said(5, "message", cart="lab", text="again"), False, "Choose a reply to go on, or reset."),
        (said(6, "continue", condition="none"), False, "Unknown condition."),
        (said(7, "rate", condition="learned", rating="fine"), False, "Unknown rating."),
        (said(8, "rate", condition="learned", rating="appropriate"), True, "Review 1 of learned: appropriate."),
        (said(9, "continue", condition="learned"), True, "Reply added."),
        (said(10, "message", cart="hospital", text="and?"), False, "Reset before changing carts."),
        (said(11, "message", cart="lab", text="and?"), True, "A | B"),
        (said(12), False, "A line must be one JSON object."),
        (said(13, "dance"), False, "Unknown operation dance."),
        (said(14, "reset"), True, "New interaction."),
        (said(15, "replay", case_id="x"), False, "Unknown case x."),
        (said(16, "replay", case_id="c", case_text="old"), True, "Replayed: old"),
        (said(17, "continue", condition="learned"), False, "Send a message first."),
        (said(18, "message", cart="hospital", text="new"), True, "A | B"),
        (said(19, "recover", cart="lab", dialogue="participant: a\nrobot: b"), False, "A dialogue must end with the participant."),
        (said(20, "recover", cart="lab", dialogue="participant: a", observed_wait_seconds=3601.0), False, "Waiting time is out of range."),
        (said(21, "recover", cart=None, dialogue="participant: a"), False, "Choose a cart."),
        (said(22, "recover", cart="lab", dialogue="robot: b\n\nparticipant: a", observed_wait_seconds=2.5), True, "Recovering after 2 turns and 2.5 s."),
    ]
    turns = []
    for row, ok, message in steps:
        before = replay.snapshot(s)
        got = s.turn(row)
        assert (got["ok"], got["message"]) == (ok, message), row
        assert ok or replay.snapshot(s) == before  # refused commands change nothing
        turns.append(got["turns"])
    assert turns[4] == 1 and turns[9] == 2 and turns[11] == 3 and turns[14] == 0 and turns[18] == 1 and s.pending == "recover"


def test_log_and_stream_of_commands_agree(spark, tmp_path):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    log = catalog.QUERIES["command_log"](spark, SF)
    want = sorted(map(repr, map(tuple, log.collect())))
    assert {r.op for r in log.select("op").distinct().collect()} >= {"message", "continue", "reset", "replay", "rate", "recover", "dance", None}
    assert {r.ok for r in log.select("ok").distinct().collect()} == {True, False}
    lines = service_queries.command_lines(read).cache()
    for part in range(3):
        lines.filter(F.when(F.col("seq") < 5, 0).when(F.col("seq") < 9, 1).otherwise(2) == part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = commands.parsed(source, service_queries.answers_of, service_queries.cases_of(read))
    q = replay.stream(rows, commands.Session, commands.OUTPUT, key="session", order="seq").writeStream.format("memory").queryName("commands").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    lines.unpersist()
    assert q.exception() is None and sorted(map(repr, map(tuple, spark.table("commands").collect()))) == want
