"""Golden rules of the caches, functions and sources, against brute force or stated values."""

import base64
import difflib
import functools
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import similarity as S
from turnwise.functions import text as T
from turnwise.operators import automata, matching, ordering, splits
from turnwise.plans import text_queries
from turnwise.sources import files
from turnwise.streaming import caches, events, replay


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


# -- text ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, tokens",
    [("Drawer two!", "drawer 2"), ("drawer too", "drawer 2"), ("the blue one", "the blue one"), ("which drawer for tape", "which drawer for tape"), ("door FOUR", "door 4"), ("", "")],
)
def test_number_words_only_after_a_drawer(spark, text, tokens):
    assert " ".join(one(spark, text, T.drawer_tokens)) == tokens


@pytest.mark.parametrize("phrase, other", [("battery", "batteries"), ("batteries", "battery"), ("glove", "gloves"), ("gloves", "glove"), ("glass", "glasss"), ("key", "keys"), ("small ring", "small rings")])
def test_number_variants(spark, phrase, other):
    assert one(spark, phrase, T.number_variants) == [phrase, other]


@pytest.mark.parametrize("ms, label", [(1000.0, "<=1000"), (1000.1, "<=3000"), (15000.0, "<=15000"), (15000.5, ">15000"), (None, "missing")])
def test_timing_edges_are_closed(spark, ms, label):
    assert spark.createDataFrame([(ms,)], "t double").select(T.timing_bucket(F.col("t")).alias("x")).first().x == label


def test_hmac(spark):
    import hmac

    assert one(spark, "méssage", lambda c: T.hmac_sha256(b"k" * 70, c)) == hmac.new(b"k" * 70, "méssage".encode(), "sha256").hexdigest()


def test_null_texts(spark):
    for f in (T.normal_text, T.drawer_tokens, T.unicode_tokens, T.source_words, T.number_variants, T.drawer_mentions, T.is_correction):
        spark.createDataFrame([(None,), ("",), ("x" * 50_000,)], "t string").select(f(F.col("t"))).collect()


def test_similarities(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc ") for _ in range(12)), "".join(rng.choice("abc ") for _ in range(12))) for _ in range(40)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.sequence_ratio("a", "b").alias("r")).collect()
    assert all(r.r == pytest.approx(difflib.SequenceMatcher(None, r.a, r.b).ratio()) for r in got)
    v = S.hash_vector("Where is the ring?")
    assert v.shape == (2048,) and np.sqrt((v**2).sum()) == pytest.approx(1) and S.hash_vector("")[0] is not None


# -- matching --------------------------------------------------------------------------------------------------------
def test_scan_takes_the_longest_phrase_then_the_best_kind():
    table = {("red",): {"attribute": ["red"]}, ("red", "ring"): {"item": ["1"], "family": ["x"]}, ("ring",): {"family": ["ring"]}}
    assert matching.scan("the red ring and ring".split(), table, 2) == [("word", ["the"]), ("item", ["1"]), ("word", ["and"]), ("family", ["ring"])]
    assert matching.scan([], table, 2) == []


def test_interval_join_equals_nested_loops(spark):
    rng = random.Random(2)
    left = [(i, rng.randint(0, 2), a := rng.randint(-50, 50), a + rng.randint(0, 40)) for i in range(60)]
    right = [(i, rng.randint(0, 2), a := rng.randint(-50, 50), a + rng.randint(0, 40)) for i in range(60)]
    got = matching.interval_join(spark.createDataFrame(left, "i int, k int, a int, b int"), spark.createDataFrame(right, "j int, k int, c int, d int"), "k", "a", "b", "c", "d", 7).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[3] > y[2] and x[2] < y[3])


def test_phrase_hits_count_a_common_name_once_for_each_request(spark):
    req = spark.createDataFrame([(1, "s", "the red ring"), (2, "s", "nothing"), (3, "t", "red ring"), (4, "s", None)], "id int, setting string, text string")
    items = spark.createDataFrame([("s", i, "red ring") for i in range(50)] + [("s", 99, "ring")], "setting string, item_id int, name string")
    assert [(r.id, r.n, r.first) for r in matching.phrase_hits(req, items).collect()] == [(1, 51, [0, 1, 2])]


def test_phrase_hits_find_names_of_many_words(spark):
    req = spark.createDataFrame([(1, "s", "where is the very long old red left ring now"), (2, "s", "ring")], "id int, setting string, text string")
    items = spark.createDataFrame([("s", 1, "very long old red left ring"), ("s", 2, "ring")], "setting string, item_id int, name string")
    assert sorted((r.id, r.n, r.first) for r in matching.phrase_hits(req, items).collect()) == [(1, 2, [1, 2]), (2, 1, [2])]
    assert matching.phrase_hits(req, items.limit(0)).count() == 0


def test_the_longest_candidate_may_have_many_words(spark):
    part = spark.createDataFrame([(0, "very long old red left ring")], "p_partkey long, p_name string")
    assert [r.candidate for r in text_queries.longest_candidate(lambda t: part).collect()] == ["very long old red left ring"]


# -- ordering --------------------------------------------------------------------------------------------------------
def test_ordered_computations_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SPAN", 7)
    rng = random.Random(3)
    v = [rng.choice([None, 0, 1, 5]) for _ in range(50)]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "position long, v int")
    got = {r.position: r for r in ordering.rolling(df, F.col("v"), 5, "m", least=3).collect()}
    for i in range(50):
        w = [x for x in v[max(0, i - 4) : i + 1] if x is not None]
        assert got[i + 1].m == (pytest.approx(sum(w) / len(w)) if w and i >= 2 else None)
    run = {r.position: r for r in ordering.running(df, {"s": F.col("v")}, {"last": F.col("v")}).collect()}
    for i in range(50):
        seen = [x for x in v[: i + 1] if x is not None]
        assert run[i + 1].s == sum(seen) and run[i + 1].last == (seen[-1] if seen else None)
    ranked = ordering.position(df.withColumnRenamed("position", "p"), [F.floor(F.col("p") / 9)], ["p"]).collect()
    assert all(r.position == r.p for r in ranked)


def test_hash_split_shares(spark):
    got = splits.hash_split(spark.range(1000).withColumnRenamed("id", "p"), "p", salt="x:", cuts=(0.65, 0.82)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 650, "validation": 170, "test": 180}


def test_group_folds_keep_connected_participants(spark):
    got = {r.a: r.fold for r in splits.group_folds(spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 12), (5, 13)], "a int, b int"), folds=2).collect()}
    assert got[1] == got[2] == got[3] and len(set(got.values())) == 2


# -- automata --------------------------------------------------------------------------------------------------------
def test_minimal_automaton(spark):
    frames = ["where is the <item>", "which is the <item>", "where <item>", "where"]
    edges = automata.compile_frames(spark.createDataFrame([(f, 1) for f in frames], "frame string, support long")).collect()
    nxt, accepts = {(r.src, r.symbol): r.dst for r in edges if r.symbol}, {r.src for r in edges if r.accepts}

    def accepted(text):
        s = 0
        for w in text.split():
            s = nxt.get((s, w))
            if s is None:
                return False
        return s in accepts

    assert all(map(accepted, frames)) and not any(map(accepted, ["which", "is the <item>", "where is the"]))
    assert len({r.src for r in edges}) <= 6


def test_paths_through_slots(spark):
    df = spark.createDataFrame([(1, ["where", "is", "the", "red", "ring"]), (2, ["where"]), (3, [])], "id int, w array<string>")
    assert [tuple(r) for r in matching.automaton_paths(df).collect()] == [(1, 1, 2)]


def test_slots_capture_phrases_of_any_length(spark):
    texts = ["where is the old left hand drill", "which drawer has the saw", "where is the", "the saw"]
    df = spark.createDataFrame([(i, t.split(" ")) for i, t in enumerate(texts)], "id int, w array<string>")
    got = sorted(tuple(r) for r in matching.automaton_matches(df).collect())
    assert got == [(0, 0, "locate", {"item": "old left hand drill"}, 3, 1), (1, 0, "locate", {"item": "saw"}, 4, 1)]


def test_a_repeated_slot_captures_one_phrase():
    edges = [(0, "S:x", 1), (1, "L:and", 2), (2, "S:x", 3), (0, "S:y", 3)]
    match = lambda t: [m[:2] for m in matching.match_all(t.split(" "), edges, {3: "i"})]
    assert match("a b and a b") == [("i", {"x": "a b"}), ("i", {"y": "a b and a b"})]
    assert match("a b and a c") == [("i", {"y": "a b and a c"})]
    assert match("a and a and a and a") == [("i", {"x": "a and a"}), ("i", {"y": "a and a and a and a"})]
    assert matching.match_all(["a"] * 129, edges, {3: "i"}) == []
    assert len(matching.match_all(["a"] * 40, [(0, "S:x", 1), (1, "S:y", 2), (2, "S:z", 3)], {3: "i"})) == 256


def test_traversal_goes_over_all_words(spark):
    edges = [(0, "a", 1), (1, "b", 2), (2, "a", 1)]
    df = spark.createDataFrame([(0, list("abab")), (1, list("abc")), (2, []), (3, list("aba")), (4, list("cab"))], "id int, w array<string>")
    got = df.select("id", matching.traverse(F.col("w"), edges, {2}).alias("x")).select("id", "x.accepted", "x.path").collect()
    assert sorted(tuple(r) for r in got) == [(0, True, [0, 1, 2, 1, 2]), (1, False, [0, 1, 2]), (2, False, [0]), (3, False, [0, 1, 2, 1]), (4, False, [0])]


# -- caches ----------------------------------------------------------------------------------------------------------
def turn(position, template="t", state="s", vector=(1.0, 0.0), valid=True, **more):
    return {"position": position, "state": state, "successor": "n", "template": template, "valid": [template] if valid else [], "vector": list(vector), "evidence": f"e{position}", "seed": False, **more}


def test_admission_needs_five_successes_at_085():
    c = caches.SemanticCache()
    assert [c.turn(turn(i))["source"] for i in range(6)] == ["slm"] * 5 + ["fsm"]


def test_two_observations_suffice_at_070():
    c = caches.SemanticCache(admit=0.70)
    assert [c.turn(turn(i))["source"] for i in range(3)] == ["slm", "slm", "fsm"]


def test_repeated_evidence_doesnt_admit():
    c = caches.SemanticCache(admit=0.70)
    assert [c.turn({**turn(i), "evidence": "same"})["source"] for i in range(4)] == ["slm"] * 4


def test_seeds_serve_at_once_and_stop_after_a_failed_audit():
    c = caches.SemanticCache()
    c.turn(turn(0, seed=True))
    assert c.turn(turn(1))["source"] == "fsm"
    assert c.turn(turn(2, template="other"))["source"] == "slm"  # the seed's template doesn't bind
    c.feedback(0, False, "f")
    assert c.turn(turn(3))["source"] == "slm"


def test_far_vectors_are_not_served_or_merged():
    c = caches.SemanticCache(admit=0.5, least=1)
    c.turn(turn(0))
    assert c.turn(turn(1, vector=(0.0, 1.0)))["source"] == "slm" and len(c.patterns) == 2
    assert c.turn(turn(2, state="elsewhere"))["source"] == "slm"


def test_no_learning_when_switched_off():
    c = caches.SemanticCache(learn=False)
    for i in range(5):
        c.turn(turn(i))
    assert c.patterns == []


def lifecycle_turn(i, decision="d", risky=False, success=None):
    return {"position": i, "exact": "k", "typed": "k", "decision": decision, "risky": risky, "evidence": i, "success": success}


@pytest.mark.parametrize("risky, served_at", [(False, 12), (True, 21)])
def test_imitation_activates_at_the_11th_or_20th_observation(risky, served_at):
    c = caches.Lifecycle()
    first = next(i for i in range(1, 40) if c.turn(lifecycle_turn(i, risky=risky))["source"] != "slm")
    assert first == served_at


def test_conflict_quarantines_and_restarts():
    c = caches.Lifecycle()
    for i in range(5):
        c.turn(lifecycle_turn(i))
    assert c.turn(lifecycle_turn(5, decision="other"))["quarantined"] == 2
    c.turn(lifecycle_turn(6))
    assert c.entries["exact:k"]["generation"] == 1 and c.entries["exact:k"]["status"] == "candidate"


def test_failure_feedback_quarantines_an_active_entry():
    c = caches.Lifecycle()
    for i in range(11):
        c.turn(lifecycle_turn(i))
    assert c.turn(lifecycle_turn(11, success=False))["source"] == "fsm_exact"
    assert c.entries["exact:k"]["status"] == "quarantined" and c.turn(lifecycle_turn(12))["source"] == "fsm_typed"


def test_failure_feedback_quarantines_siblings_too():
    c = caches.Lifecycle(siblings=True, audit=False)
    for i in range(11):
        c.turn(lifecycle_turn(i))
    assert c.turn(lifecycle_turn(11, success=False))["quarantined"] == 2
    assert c.turn(lifecycle_turn(12))["source"] == "slm"


def test_audits_find_a_teacher_who_changed():
    c = caches.Lifecycle()
    sources = [c.turn(lifecycle_turn(i))["source"] for i in range(300)]
    assert 5 <= sources.count("fsm_exact_audited") == c.entries["exact:k"]["audit_matches"] <= 30
    later = [c.turn(lifecycle_turn(i, decision="other")) for i in range(300, 500)]
    first = next(i for i, x in enumerate(later) if x["source"] == "slm_audit_fallback")
    assert later[first]["decision"] == "other" and later[first]["quarantined"] == 2 and later[first + 1]["source"] == "slm"
    assert {x["source"] for x in later[:first]} == {"fsm_exact"}


def test_frozen_caches_neither_learn_nor_audit():
    c = caches.Lifecycle()
    for i in range(20):
        c.turn(lifecycle_turn(i))
    c.freeze()
    assert {c.turn(lifecycle_turn(i, decision="other"))["source"] for i in range(20, 220)} == {"fsm_exact"}
    c.freeze(audits=True)
    assert "slm_audit_fallback" in [c.turn(lifecycle_turn(i, decision="other"))["source"] for i in range(220, 420)]
    c.turn(lifecycle_turn(420))
    assert c.entries["exact:k"]["status"] == "quarantined" and c.entries["exact:k"]["generation"] == 0
    c.unfreeze()
    c.turn(lifecycle_turn(421))
    assert c.audit and c.entries["exact:k"]["generation"] == 1


def test_verified_policies_need_outcomes():
    c = caches.Lifecycle(policy="development")
    assert all(c.turn(lifecycle_turn(i))["source"] == "slm" for i in range(20))
    c = caches.Lifecycle(policy="development")
    assert any(c.turn(lifecycle_turn(i, success=True))["source"] != "slm" for i in range(8))


def test_heat_promotion_and_demotion():
    c = caches.HeatCache()
    row = lambda i, **k: {"position": i, "key": "k", "surface": "s", "example": f"e{i}", "variant": f"v{i}", "decision": "d", "ok": True, **k}
    assert [c.turn(row(i))["source"] for i in range(4)] == ["slm", "slm", "fsm", "fsm"]
    c.turn(row(4, decision="x", ok=False))
    assert c.patterns["k"]["status"] == "candidate"


def rows_for_replay():
    rng = random.Random(4)
    return [(i % 3, i, "s", "n", f"t{i % 2}", [f"t{i % 2}"], [rng.random(), rng.random()], str(i), False) for i in range(60)]


TURNS = "cache_id long, position long, state string, successor string, template string, valid array<string>, vector array<double>, evidence string, seed boolean"
OUT = "cache_id long, position long, source string, pattern int, similarity double, active int, candidates int"


make = functools.partial(caches.SemanticCache, admit=0.7, merge=0.5, route=0.5)


def test_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(rows_for_replay(), TURNS)
    batch = sorted(map(tuple, replay.replay(df, make, OUT).collect()))
    names, want = [c.split()[0] for c in TURNS.split(", ")], []
    for k in range(3):
        m = make()
        want += [(k, *m.turn(dict(zip(names, r, strict=True))).values()) for r in rows_for_replay() if r[0] == k]
    assert [x[:4] for x in batch] == [x[:4] for x in sorted(want)]
    for part in range(3):
        df.filter(f"position between {part * 20} and {part * 20 + 19}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = (
        replay.stream(spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), make, OUT)
        .writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("replayed").collect()))
    assert [x[:3] for x in got] == [x[:3] for x in batch]


def test_snapshots(spark, tmp_path):
    c = make()
    c.turn(turn(0))
    files.save_state(spark, [("a", replay.snapshot(c))], str(tmp_path / "state"), "semantic")
    again = replay.restore(make, files.load_state(spark, str(tmp_path / "state"), "semantic")["a"])
    assert again.patterns == c.patterns
    with pytest.raises(ValueError):
        files.load_state(spark, str(tmp_path / "state"), "lifecycle")
    with pytest.raises(ValueError):
        replay.restore(caches.HeatCache, replay.snapshot(c))


def test_late_feedback_in_time_only(spark):
    t = spark.sql("SELECT 1 trace_id, timestamp'2024-01-01 00:00:00' ts UNION ALL SELECT 2, timestamp'2024-01-01 00:00:00'")
    f = spark.sql("SELECT 1 trace_id, timestamp'2024-01-01 23:59:59' feedback_ts, true success UNION ALL SELECT 2, timestamp'2024-01-02 00:00:01', true")
    assert [r.trace_id for r in events.late_feedback(t, f).collect()] == [1]


# -- sources ---------------------------------------------------------------------------------------------------------
def test_item_documents(spark, tmp_path):
    item = {"id": "1", "name": "ring", "family": "f", "attributes": {"size": "2"}, "aliases": ["band"], "location": "drawer 3"}
    forms = {"list": json.dumps([item]), "items": json.dumps({"items": [item]}), "settings": json.dumps({"lab": [item], "hospital": [item]}, indent=1), "lines": json.dumps(item) + "\n\n" + json.dumps({**item, "id": "2"})}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        rows = files.read_items(spark, str(tmp_path / name)).collect()
        assert all(r.drawer == "drawer 3" and r.attributes == {"size": "2"} for r in rows)
        assert len(rows) == {"settings": 2, "lines": 2}.get(name, 1)
    assert [r.setting for r in files.read_items(spark, str(tmp_path / "settings"), " LAB ").collect()] == ["lab"]


def test_jsonl_is_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert [r.x for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").orderBy("x").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "x int").collect()


def test_snapshot_digest(spark, tmp_path):
    data = b'{"a": 1}'
    (tmp_path / "n.py").write_text(f"x = 1\nDATA = '{base64.b64encode(zlib.compress(data)).decode()}'\n")
    assert files.read_snapshot(spark, str(tmp_path / "n.py"), "DATA", hashlib.sha256(data).hexdigest()) == data.decode()
    for name, digest in (("DATA", "0" * 64), ("OTHER", None)):
        with pytest.raises(ValueError):
            files.read_snapshot(spark, str(tmp_path / "n.py"), name, digest)


def test_dialogue_text(spark):
    texts = [(1, "Participant: where is\nthe ring\n\nrobot: drawer 2"), (2, ""), (3, "hello"), (4, "robot: hi"), (5, "participant:\nrobot: x"), (6, None)]
    rows = files.parse_dialogue(spark.createDataFrame(texts, "id int, text string")).orderBy("id", "turn").collect()
    assert [(r.turn, r.role, r.text, r.error) for r in rows if r.id == 1] == [(1, "participant", "where is the ring", None), (2, "robot", "drawer 2", None)]
    assert {r.id: r.error for r in rows if r.id > 1} == {2: "empty", 3: "starts without a speaker", 4: "no participant", 5: "empty turn", 6: "empty"}


def test_verified_source_and_resumed_append(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"k": "a"}\n{"k": "b"}\n')
    digest = hashlib.sha256((tmp_path / "d.jsonl").read_bytes()).hexdigest()
    df = files.read_verified(spark, str(tmp_path / "d.jsonl"), "k string", sha256=digest, rows=2)
    with pytest.raises(ValueError):
        files.read_verified(spark, str(tmp_path / "d.jsonl"), "k string", sha256=digest, rows=3)
    out = str(tmp_path / "cache")
    assert files.append_new(df.select("k"), out, "k") == 2
    assert files.append_new(spark.createDataFrame([("b",), ("c",), ("c",)], "k string"), out, "k") == 1
    files.write_jsonl(df.select("k"), str(tmp_path / "out"), ["k"])
    assert [r.k for r in spark.read.json(str(tmp_path / "out")).orderBy("k").collect()] == ["a", "b"]
    files.write_csv(df.select("k"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_user_reports(spark):
    items = spark.createDataFrame([("lab", "1", "Ring", 2)], "setting string, item_id string, name string, drawer int")
    reports = spark.createDataFrame([("lab", " ring", 1, True), ("lab", "tape", 3, True), ("lab", "tape", 4, True), ("lab", "saw", 9, True), ("lab", "pen", 1, False)], "setting string, name string, drawer int, enabled boolean")
    out = files.add_reports(items, reports, drawers=5).collect()
    assert len(out) == 2 and out[1].name == "tape" and out[1].item_id.startswith("user_")


# -- alignment -------------------------------------------------------------------------------------------------------
def test_alignment_flags_and_gaps():
    from turnwise.operators import alignment

    segments = ["where is the ring", "it is in drawer two", "no it is not there", "thanks"]
    got = alignment.align(["It is in drawer two.", "where is the ring", "it is there", "completely different words here", ""], segments)
    assert [g[:2] for g in got] == [(1, 1), (0, 0), (2, 2), (-1, -1), (-1, -1)]
    assert [g[3] for g in got] == ["", "order", "polarity", "", ""]
    assert alignment.coverage([], ["a"]) == 0 and alignment.coverage(["a", "b"], ["b", "a", "b"]) == 1


def test_selectors_fall_back_to_similar_ones(spark):
    e = spark.createDataFrame([(1, "sd card"), (2, "sd crad"), (3, "pen"), (4, None)], "id int, entity string")
    s = spark.createDataFrame([("sd card",), ("blue tape",), ("wires",)], "selector string")
    got = {r.id: (r.method, r.selector) for r in matching.selector_lookup(e, s).collect()}
    assert got[1] == ("exact", "sd card") and got[3][0] == "none" and got[4][0] == "none"
