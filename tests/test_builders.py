"""Machines learnt by merging, models as tables, records with their places, and builders on hand-made rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from turnwise.operators import automata, datasets, dialogue, matching
from turnwise.sources import files


def accepts(edges, accept, words):
    to, state = {(s, w): t for s, w, t in edges}, 0
    for w in words:
        if (state, w) not in to:
            return False
        state = to[state, w]
    return state in accept


def test_merging_keeps_what_was_shown_and_generalises():
    frames = [tuple(f.split()) for f in ("where is the <item>", "where is the <item> please", "find <item>", "find <item> please", "find the <item>", "a a <item>", "a a a <item>")]
    negative = automata.structural_negatives(frames)
    edges, accept = automata.learn_acceptor(frames, negative)
    assert all(accepts(edges, accept, f) for f in frames) and not any(accepts(edges, accept, n) for n in negative)
    tree = {f[:i] for f in [*frames, *negative] for i in range(len(f) + 1)}
    states = {s for s, _, _ in edges} | {t for _, _, t in edges}
    assert len(states) < len(tree) / 2
    words = sorted({w for f in frames for w in f})
    new = [s for n in range(1, 6) for s in itertools.product(words, repeat=n) if accepts(edges, accept, s) and s not in frames]
    assert new  # it takes sequences that it was never shown


def test_merging_refuses_to_unite_accepting_and_refusing():
    edges, accept = automata.learn_acceptor([("a",), ("a", "a", "a")], {(), ("a", "a")})
    assert [accepts(edges, accept, ("a",) * n) for n in range(4)] == [False, True, False, True]


def test_models_from_files_and_back(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"type": "config", "state": "idle"}\n\n{"type": "query", "text": "where is <item>"}\n')
    (tmp_path / "two.jsonl").write_text('{"type": "query", "text": "find <item>"}\n{"type": "transition", "state": "idle", "event": "found", "action": "tell", "next_state": "idle"}\n')
    schema = "type string, text string, state string, event string, action string, next_state string"
    records = files.read_records(spark, [str(tmp_path / "one.jsonl"), str(tmp_path / "two.jsonl")], schema)
    places = sorted(r._source.rpartition("/")[2] for r in records.collect())
    assert places == ["one.jsonl:1", "one.jsonl:3", "two.jsonl:1", "two.jsonl:2"]
    assert records.select("_sha256").distinct().count() == 2
    model = automata.compile_records(records)
    automata.dump_model(model, str(tmp_path / "model"))
    back = automata.load_model(spark, str(tmp_path / "model"))
    assert sorted(map(tuple, back["edges"].collect()), key=str) == sorted(map(tuple, model["edges"].collect()), key=str)
    assert [tuple(r) for r in back["controller"].collect()] == [("idle", "found", "tell", "idle", 1)]
    spark.createDataFrame([("other", "idle")], "format string, start_state string").write.mode("overwrite").parquet(str(tmp_path / "model" / "config"))
    with pytest.raises(ValueError, match="format"):
        automata.load_model(spark, str(tmp_path / "model"))
    twice = records.unionByName(records.filter("type = 'transition'").withColumn("action", F.lit("ask")))
    with pytest.raises(ValueError, match="two outcomes"):
        automata.compile_records(twice)
    (tmp_path / "bad.jsonl").write_text('{"type": "query", "text": "x"}\n[1]\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        files.read_records(spark, [str(tmp_path / "bad.jsonl")], schema).collect()


def test_prefixes_and_boundaries(spark):
    turn = "struct<role:string,text:string,start:double,end:double,flags:array<string>>"
    row = lambda *ts: [(r, x, s, s + 1.0, f) for r, x, s, f in ts]
    cases = [
        (row(("participant", "a", 0.0, []), ("participant", "b", 0.0, []), ("robot", "c", 1.0, None)), [("participant", "a b"), ("robot", "c")], None),
        (row(("operator", "o", 0.0, ["x"]), ("participant", "b", 0.0, [])), [("participant", "b")], None),
        (row(("participant", "a", 0.0, ["x"])), None, "unresolved_role_or_source_span"),
        (row((None, "a", 0.0, [])), None, "unresolved_role_or_source_span"),
        (row(("guest", "a", 0.0, [])), None, "invalid_speaker"),
        (row(("participant", "a", 0.0, []), ("operator", "", 0.0, ["next_trial"])), None, "crosses_next_trial"),
        ([], None, "no_participant_request"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], f"i int, turns array<{turn}>")
    prefix, reason = datasets.clean_prefix(F.col("turns"), F.size("turns") - 1)
    for r in df.select("i", prefix.alias("p"), reason.alias("r")).collect():
        _, want, why = cases[r.i]
        assert (None if r.p is None else [(t.role, t.text) for t in r.p]) == want and r.r == why, r.i
    said = spark.createDataFrame([(1, [("participant", "x"), ("robot", "y"), ("robot", "z")]), (2, [("robot", "y")]), (3, []), (4, [("participant", "x")])], f"i int, turns {datasets.TURNS}")
    history, proposal, user = datasets.decision_boundary(F.col("turns"))
    assert [tuple(r) for r in said.select(F.size(history), proposal, user).collect()] == [(1, "y z", True), (0, "y", False), (0, None, False), (1, None, True)]


def test_sessions_close_and_spread(spark):
    items = spark.createDataFrame([("lab", "w", "wire", "wire", {}, "drawer 3"), ("lab", "g", "glove", "glove", {}, None)], "setting string, id string, name string, family string, attributes map<string,string>, drawer string")
    turns = spark.createDataFrame([(1, "lab", 0, "where is the wire"), (1, "lab", 1, "no i said glove"), (1, "lab", 2, "more"), (2, "ship", 0, None), (3, "lab", 0, "find the glove")], "session int, setting string, turn int, text string")
    out = {(r.session, r.turn): (r.action, r.reply, r.closes) for r in dialogue.sessions(turns, items).collect()}
    assert out[1, 0] == ("locate", "The wire is listed in drawer 3.", False) and out[1, 1][0] == "recover" and out[1, 1][2] and (1, 2) not in out
    assert out[2, 0][0] == "redirect" and out[3, 0][1] == "I have no place on record for that item."
    assert dialogue.sessions(turns.limit(0), items).count() == 0


def test_typed_features_join_a_table_that_is_too_large(spark):
    table = spark.createDataFrame([("lab", f"p{i}", "item", str(i)) for i in range(5)] + [("lab", "p1", "family", "f")], "setting string, phrase string, kind string, value string")
    asked = spark.createDataFrame([(1, "lab", "p1 or p9"), (2, "other", "p1"), (3, None, "p1"), (4, "lab", "")], "id int, setting string, text string")
    sent, joined = (sorted(map(tuple, matching.typed_features(asked, table, largest=n).collect())) for n in (100, 4))
    assert sent == joined and sent[0][:3] == (1, "<item> or p9", "1") and sent[1][1] == "p1"


def test_several_snapshots_are_verified_together(spark, tmp_path):
    import base64
    import hashlib
    import zlib

    texts = {"ITEMS": "[1, 2]", "FOLDS": "{}", "CASES": "x" * 500}
    code = "".join(f"{n} = '{base64.b64encode(zlib.compress(t.encode())).decode()}'\n" for n, t in texts.items())
    (tmp_path / "cell.py").write_text("import x\n" + code)
    pinned = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    assert files.read_snapshots(spark, str(tmp_path / "cell.py"), pinned) == texts
    with pytest.raises(ValueError, match="FOLDS"):
        files.read_snapshots(spark, str(tmp_path / "cell.py"), pinned | {"FOLDS": "0" * 64})
