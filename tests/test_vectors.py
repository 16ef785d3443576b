"""Hash vectors against a loop over hashes, and the functions for SQL against their formulas."""

import hashlib
import math

import pytest

from turnwise.functions import sql
from turnwise.plans import catalog
from turnwise.streaming.caches import wilson

SF = "/root/testdata/sf0.001"


def test_hash_vectors_equal_a_loop(spark):
    got = {}
    for r in catalog.QUERIES["hash_vectors"](spark, SF).collect():
        got.setdefault(r.name, {})[r.place] = r.value
    assert len(got) > 20
    for name, v in got.items():
        words = name.split(" ")
        line = f" {name} "
        features = [f"w:{w}" for w in words] + [f"b:{a}_{b}" for a, b in zip(words, words[1:], strict=False)] + [f"c{n}:{line[i : i + n]}" for n in (3, 4, 5) for i in range(len(line) - n + 1)]
        want: dict = {}
        for f in features:
            h = int(hashlib.blake2b(f.encode(), digest_size=8).hexdigest(), 16)
            want[h % 2048] = want.get(h % 2048, 0) + (1 if h < 2**63 else -1)
        size = math.sqrt(sum(x * x for x in want.values()))
        assert v == {k: pytest.approx(x / size, abs=1e-6) for k, x in want.items() if x}


def test_functions_for_sql(spark):
    names = sql.register(spark)
    assert sql.register(spark) == names and all(n.startswith("tw_") for n in names)
    one = lambda e: spark.sql(f"SELECT {e} AS x").first().x
    assert one("tw_beta(3D, 4D)") == pytest.approx(4 / 6)
    for k, n in ((0, 0), (3, 4), (10, 10)):
        assert one(f"tw_wilson({k}D, {n}D)") == pytest.approx(wilson(k, n))
    assert one("tw_dot(array(1D, 2D), array(3D, 4D))") == 11
    assert one("tw_log_sum_exp(array(1000D, 1000D))") == pytest.approx(1000 + math.log(2))
    assert one("tw_words('Red, 2nd-hand')") == ["red", "2nd", "hand"] and one("tw_jaccard(array('a', 'b'), array('b'))") == 0.5
    assert one("""tw_canonical_json('{"b": 1, "a": [ ]}')""") == '{"a":[],"b":1}' and one("""tw_canonical_json('{"b": 1, "b": 2}')""") is None
    assert one("tw_nfkc('ﬁ  X')") == "fi x" and one("tw_sequence_ratio('abcd', 'bcde')") == 0.75
    got = spark.sql("SELECT * FROM tw_turns('noise\nParticipant: a\nb\n\nrobot:c')").collect()
    assert [tuple(r) for r in got] == [(0, "participant", "a b"), (1, "robot", "c")]
    assert spark.sql("SELECT * FROM tw_turns(CAST(NULL AS STRING))").count() == 0
    # SQL functions are part of the plan, not calls
    plan = spark.sql("SELECT tw_beta(CAST(id AS DOUBLE), 4D) AS x FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "/" in plan
