"""Mixing, top-k, chat, personal data and toxicity: SQL or brute force, and edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import chat, common, mixing, pii, registry, topk, toxicity

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "conversations", "labels"]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def on_duckdb(sql, **tables):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'") if t not in tables else con.register(t, tables[t])
    rel = con.sql(sql)
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def same(df, rows):
    cols = sorted(df.columns)
    return sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(str([plain(r[c]) for c in cols]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), on_duckdb(registry.SQL[name]))


# -- mixing ----------------------------------------------------------------------------------------------------------
def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, source string, size string, target string")


def brute_mix(rows, epochs=3):
    """One copy after another by virtual finish time until the budget is used up."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(z for z, (*_, s) in zip(size, rows, strict=True) if s == n) for n in names}
    target, left = {}, {n: i % 3 + 1 for i, n in enumerate(names)}
    rest = sum(size)
    while left:
        level = rest / sum(left.values())
        full = [n for n, w in left.items() if w * level > epochs * total[n]]
        if not full:
            target |= {n: w * level for n, w in left.items()}
            break
        for n in full:
            target[n] = float(epochs * total[n])
            rest -= epochs * total[n]
            del left[n]
    copies, h = [], [hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest() for i, *_ in rows]
    for n in names:
        order = sorted((i for i, r in enumerate(rows) if r[2] == n), key=lambda i: (h[i], size[i]))
        done = 0
        for e in range(epochs):
            for i in order:
                done += size[i]
                if size[i]:
                    copies.append((done / target[n] > 1, done / target[n], "~" if n is None else "=" + n, h[i], size[i], e, i))
    taken, used = collections.Counter(), 0
    for late, *_, z, _, i in sorted(copies):
        used += z
        if late and used > sum(size):
            break
        taken[i] += z
    return [(target[r[2]], taken[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # the range in which the budget ends is cut up further
        monkeypatch.setattr(mixing, "SORTED", 3)
        monkeypatch.setattr(mixing, "PIECES", 4)
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.choice((0, 1, 3, 30, 300))), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(120)]
    got = {r.doc_id: r for r in mixing.mix_sources(docs_of(spark, rows)).collect()}
    for (i, *_), (target, taken) in zip(rows, brute_mix(rows), strict=True):
        assert got[i]["__tw_target"] == pytest.approx(target) and got[i]["__tw_size"] * got[i]["__tw_copies"] == taken
    assert sum(r["__tw_size"] * r["__tw_copies"] for r in got.values()) <= sum(r["__tw_size"] for r in got.values())
    assert got[0].size == "a"  # clashing columns pass through


def test_documents_without_id_are_dealt_to_many_ranges(spark):
    rng = random.Random(4)
    rows = [(i if i % 2 else None, " ".join("w" * (1 + n)), rng.choice("ab")) for i, n in enumerate(rng.sample(range(200), 80))]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    want = brute_mix(rows)
    assert sorted((r.text, r["__tw_size"] * r["__tw_copies"]) for r in got) == sorted((t, taken) for (_, t, _), (_, taken) in zip(rows, want, strict=True))
    h = hashlib.md5(b"mix-1:").hexdigest()
    sizes = spark.createDataFrame([(h, n) for n in (1, 20, 300)] + [(h[:3] + "0" * 29, 5), (h[:3] + "f" * 29, 5), ("0" * 32, 1)], "h string, n long")
    ranges = [r.r for r in sizes.select("h", "n", mixing._range_of(F.col("h"), F.col("n"), h).alias("r")).orderBy("h", "n").collect()]
    assert ranges == sorted(ranges) and len(set(ranges)) == 6


def test_mix_edges(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "a b", "y"), (3, "one " * 50_000, "z")]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert len(got) == 5 and all(0 <= r["__tw_copies"] <= 3 for r in got)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert all(r["__tw_copies"] == 0 for r in mixing.mix_sources(docs_of(spark, [(1, " ", "x")])).collect())
    again = mixing.mixture(docs_of(spark, rows))
    assert again.columns == ["doc_id", "text", "source", "size", "target"] and again.count() == sum(r["__tw_copies"] for r in got)


# -- top-k -----------------------------------------------------------------------------------------------------------
def vectors_of(spark, rows):
    return spark.createDataFrame([(i, list(map(int, v))) for i, v in rows], "vec_id long, v array<bigint>")


def brute_top(rows, queries, k):
    out = []
    for q, x in queries:
        s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))
        out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 40, 10**6, 10**8])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "GROWTH", 2 if scale == 40 else 8)  # several rounds of shards, or one
    rng = np.random.default_rng(scale)
    rows = [(i, (rng.normal(size=8) * scale).astype(int).tolist()) for i in range(160)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(900, [0] * 8), (901, [1, 2]), (902, [5, 5])]
    queries = [r for r in rows if r[0] % 20 == 0]
    got = topk.top_k(vectors_of(spark, rows), vectors_of(spark, queries), k=5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, queries, 5)


def test_queries_share_an_id(spark):
    rows = [(i, [i, 1]) for i in range(10)]
    queries = [(0, [1, 0]), (0, [-1, 0]), (0, [1, 0])]
    got = [(r.query_id, r.vec_id, r.score) for r in topk.top_k(vectors_of(spark, rows), vectors_of(spark, queries), k=3).orderBy("rank").collect()]
    assert got == [(0, 9, 9), (0, 8, 8), (0, 7, 7)]
    empty = vectors_of(spark, [(1, [0, 0]), (2, [0, 0])])
    assert [tuple(r) for r in topk.top_k(empty, empty).orderBy("query_id").collect()] == [(1, 1, 2, 0), (2, 1, 1, 0)]


def test_queries_stop_on_proof_and_are_exact():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64)) * 8
    v = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64)) * 2).astype(np.int64)
    index, got = topk.ImpactIndex(v, np.arange(3000)), collections.defaultdict(list)
    full = v[:40] @ v.T
    want = [sorted((-int(full[q, i]), i) for i in range(3000) if i != q)[:20] for q in range(40)]
    for q, x, s in index.search(v[:40], np.arange(40), 20):
        for a, b, c in zip(q.tolist(), x.tolist(), s.tolist(), strict=True):
            got[a].append((-c, b))
    assert [got[q] for q in range(40)] == want
    assert index.skipped > 0.2 * (index.skipped + index.processed)  # levels that proofs made needless
    floor = np.array([-w[9][0] for w in want])
    one, got = topk.ImpactIndex(v, np.arange(3000)), collections.defaultdict(list)
    for q, x, s in one.search(v[:40], np.arange(40), 20, floor):
        for a, b, c in zip(q.tolist(), x.tolist(), s.tolist(), strict=True):
            got[a].append((-c, b))
    assert [got[q] for q in range(40)] == [[w for w in ws if w[0] <= ws[9][0]] for ws in want]
    assert one.skipped >= index.skipped


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, None), (20, [float("nan"), 1.0]), (40, [1.0, 2.0]), (41, [1.0, None]), (None, [1.0, 1.0]), (42, [0.5, 0.5]), (60, [])], "vec_id long, e array<float>")
    assert [r.vec_id for r in df.filter(topk.usable("e")).collect()] == [40, None, 42, 60]
    v = df.filter(topk.usable("e") & F.col("vec_id").isNotNull()).select("vec_id", topk.quantise("e").alias("v"))
    assert [tuple(r) for r in topk.top_k(v, v.filter("vec_id % 20 = 0")).collect()] == [(40, 1, 42, 6144)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


# -- chat ------------------------------------------------------------------------------------------------------------
def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    bits = [*chat.OWN, *chat.OTHERS, "\\", "<", "[", "|", "s>", "\\\\", "x", "<\\/s>", "<\\\\|end|>"]
    for _ in range(5000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.OWN + chat.OTHERS)


def test_chat_round_trip(spark, monkeypatch):
    path, pattern = chat.default_tokenizer()
    rows = [(1, 1, "assistant", "Hé <|end|> 😀"), (1, 0, "user", None), (None, 0, "assistant", "x"), (2, 0, None, ""), (2, 1, "assistant", ""), (2, 1, "assistant", "a"), (3, 0, "user", "</s>" * 5000), (4, 0, "assistant", "one"), (4, 1, "assistant", "two"), (1, None, "system", "[INST]")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df, path=path, pattern=pattern), path=path, pattern=pattern).collect()}
    turns = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", len(r[3] or ""))):
        turns[c].append((r or "", x or ""))
    assert set(out) == set(turns)
    for c, ts in turns.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        text = "".join(f"{chat.OWN[0]}{chat.escape(r)}{chat.OWN[1]}{chat.escape(x)}{chat.OWN[2]}" for r, x in ts)
        assert (out[c].n_turns, out[c].loss_chars, out[c].formatted_chars) == (len(ts), len(loss), len(text))
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    pieces = chat.format_chats(df, path=path, pattern=pattern).filter("conv_id = 4").collect()
    assert chat.formatted_text(pieces[0].input_ids, path=path, pattern=pattern) == "<|turn|>assistant<|text|>one<|end|><|turn|>assistant<|text|>two<|end|>"
    assert len(pieces[0].input_ids) == len(pieces[0].loss_mask) and set(pieces[0].loss_mask) == {0, 1}
    assert chat.format_chats(df.limit(0), path=path, pattern=pattern).count() == 0


def test_long_conversations_come_in_pieces():
    own = chat.tokenizer(*chat.default_tokenizer())
    ids, mask, reader = [], [], chat._Reader(own, 1)
    for i in range(50):
        turn, head = chat.encode_turn(own, "assistant" if i % 2 else "user", f"text {i} é")
        ids += turn
        mask += [0] * head + [i % 2] * (len(turn) - head)
    for i in range(0, len(ids), 7):  # pieces may end anywhere
        reader.add(np.array(ids[i : i + 7], np.int32), np.array(mask[i : i + 7], np.int8))
    row = reader.row()
    assert row[1] == 50 and row[3] == sum(len(f"text {i} é") for i in range(1, 50, 2))


def test_a_conversation_of_over_a_million_tokens(spark):
    path, pattern = chat.default_tokenizer()
    text = "hello there " * 25_000
    df = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", text) for t in range(24)] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df, path=path, pattern=pattern).withColumn("n", F.size("input_ids"))
    pieces = formatted.filter("conv_id = 1").select("piece", "n").collect()
    assert len(pieces) == 2 and sum(r.n for r in pieces) > 1_200_000 and max(r.n for r in pieces) < 1.1 * chat.PIECE
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df, path=path, pattern=pattern), path=path, pattern=pattern).collect()}
    assert got[1].n_turns == 24 and got[1].loss_chars == 12 * len(text) and got[1].loss_sha256 == hashlib.sha256((text * 12).encode()).hexdigest()
    assert got[2].n_turns == 1


# -- personal data ---------------------------------------------------------------------------------------------------
def brute_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(only(m[0])) <= 15]


def test_base_spans_equal_patterns():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@.+-% 0123456789()") for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    texts += ["4111 1111 1111 1111", "x 4111-1111-1111-1111 y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "a@b.c@d.e", "+1 (988) 555-2485", "", "0" * 5000, "a" * 20_000 + "@b"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_spans_stay_and_repeats_are_added(field):
    text = "Write to jo.doe77@mail.example.com soon. Later jo.doe77 said so, and jo.doe77 left. Version 2.0 of 17 parts."
    base, spans = pii.all_spans(text, field)
    assert set(base) <= set(spans)
    assert [text[a:b] for k, a, b in spans if (k, a, b) not in base] == ["jo.doe77", "jo.doe77"]


def test_clean_texts_stay_clean(field):
    for t in ["", "no data here", "Version 2.0, 17 apples and 3.5 pears.", "call 12345", "1234567890123456 is no card"]:
        assert pii.all_spans(t, field) == ([], [])


def test_loopy_passing_equals_sums_over_all_labellings_on_a_tree(field):
    nodes = pii.Nodes("a+1 b+2 c+3", [("phone", 0, 3)])
    k = len(pii.LABELS)
    logs = np.array([field.unary.get(s, field.unknown) for s in nodes.shapes])
    logs[0] = np.where(np.arange(k) == pii.LABELS.index("phone"), 0, -30)
    total = np.zeros((3, k))
    for x in range(k):
        for y in range(k):
            for z in range(k):
                p = np.exp(logs[0, x] + logs[1, y] + logs[2, z] + field.chain[x, y] + field.chain[y, z])
                total[0, x] += p
                total[1, y] += p
                total[2, z] += p
    assert np.allclose(field.marginals(nodes), total / total.sum(1, keepdims=True), atol=2e-3)


def test_skips_equal_sums_over_all_labellings(field):
    """A base span, two equal tokens that repeat a part of it, and a token that is none of them: the hub of the group is summed out too."""
    nodes = pii.Nodes("a.bcd12@e.fg x a.bcd12 y a.bcd12 z 77", [("email", 0, 12)])
    assert nodes.equal == [[1, 2]] and nodes.similar == [(1, 0), (2, 0)] and nodes.observed == [True, False, False, False]
    k = len(pii.LABELS)
    logs = np.array([field.unary.get(s, field.unknown) for s in nodes.shapes])
    logs[0] = np.where(np.arange(k) == 1, 0, -30)
    total = np.zeros((4, k))
    for v in np.ndindex(k, k, k, k, k):  # four tokens and the hub
        p = np.exp(sum(logs[i, v[i]] for i in range(4)) + field.skip[v[1], v[0]] + field.skip[v[2], v[0]] + field.skip[v[1], v[4]] + field.skip[v[2], v[4]])
        for i in range(4):
            total[i, v[i]] += p
    assert np.allclose(field.marginals(nodes), total / total.sum(1, keepdims=True), atol=5e-3)


def test_similar_tokens():
    found = pii.Similar()
    found.add("+1 (555) 123-4567", 3)
    found.add("jo.doe77@mail.example.com", 9)
    for token, want in (("15551234567", {3}), ("5551234567", {3}), ("call:15551234567x", {3}), ("jo.doe77", {9}), ("JO.DOE77", {9}), ("mail.example.com", {9}), ("doe77", {9}), ("oe77", set()), ("5551234568", set()), ("xjodoe77y", {9})):
        assert found.of(pii.core(token)) == want, token


def test_planted_repeats_are_found(field):
    """Names and numbers of base spans, repeated in part; beside them numbers and words that repeat nothing."""
    rng = random.Random(6)
    word = lambda n=5: "".join(rng.choice("abcdeinorst") for _ in range(n))
    hits = planted = wrong = 0
    for _ in range(200):
        name, digits = f"{word()}.{word()}{rng.randrange(10, 99)}", "".join(rng.choice("23456789") for _ in range(7))
        base = rng.choice([f"{name}@{word(6)}.example.com", f"+1 (555) {digits[:3]}-{digits[3:]}"])
        repeat = name if "@" in base else "555" + digits
        others = [word(), str(rng.randrange(10**5, 10**6)), f"{word()}{rng.randrange(10, 99)}", word(8)]
        rng.shuffle(others)
        text = " ".join([word(), base, word(), others[0], others[1], word(), repeat, others[2], word(), repeat, others[3]])
        known, spans = pii.all_spans(text, field)
        more = [text[a:b] for k, a, b in spans if (k, a, b) not in known]
        planted += 2
        hits += more.count(repeat)
        wrong += len(more) - more.count(repeat)
    print("recall", hits / planted, "precision", hits / max(1, hits + wrong))
    assert hits >= 0.9 * planted and wrong <= 0.05 * hits


def test_training_leaves_repeats_of_unknown_label_out():
    counts = collections.Counter()
    pii.count_features("jo.doe77@mail.example.com and jo.doe77 or kim99x kim99x", counts)
    shapes = {(s, y): n for (kind, s, y), n in counts.items() if kind == "shape"}
    assert (pii.shape("jo.doe77"), 0) not in shapes and shapes[pii.shape("jo.doe77@mail.example.com"), 1] == 1
    assert counts["skip", "0", 0] == 1 and not any(kind == "skip" and (a != "0" or b) for kind, a, b in counts)


def test_op8_equals_brute_force(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10_000, None), (10_001, ""), (10_002, "Ask jo.doe77@mail.example.com for it; jo.doe77 knows. " * 3000), (10_003, docs[5][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    field = pii.train(common.table(spark, tmp_path, "documents"))
    got = {r.doc_id: r for r in pii.op8_pii_crf(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    written = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for i, t in docs:
        base = brute_spans(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        spans = got[i].spans.split(",") if got[i].spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans) and got[i].spans == written(pii.all_spans(t or "", field)[1])
    assert got[10_002].spans.count("email") == 6000  # each repeat is found, in a text of any length


def test_pii_columns(spark, field):
    df = spark.createDataFrame([(1, "a@b.cd", "x"), (2, None, "x"), (1, "a@b.cd", "x"), (3, "", "x")], "doc_id long, text string, spans string")
    out = pii.find_pii(df, field).collect()
    assert [r["__tw_pii"].base for r in out] == [["email:0:6"], [], ["email:0:6"], []] and out[0].spans == "x"
    assert pii.find_pii(df.limit(0), field).count() == 0
    with pytest.raises(ValueError, match="__tw_pii"):
        pii.find_pii(pii.find_pii(df, field), field)
    assert pii.train(df.limit(0)).marginals(pii.Nodes("", [])).shape[0] == 0


# -- toxicity --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return toxicity.fit(common.table(spark, d, "documents"), common.table(spark, d, "labels").filter(~toxicity.held_out()))


def cosines(model, text):
    """All cosines of a text, from its vector and the examples' weights, one example after another."""
    c, w = model.vector(text)
    mine = dict(zip(c.tolist(), w.tolist(), strict=True))
    out = np.zeros(model.n)
    for t in c.tolist():
        for x in range(model.ends[t], model.ends[t + 1]):
            out[model.owner[x]] += mine[t] * float(model.weight[x])
    return out


def brute_score(model, text):
    s = sorted((-round(x, 12), int(model.number[n]), n) for n, x in enumerate(cosines(model, text)) if x > 0)[: toxicity.NEIGHBOURS]
    s = [(x, n) for x, _, n in s]
    vote = (sum(-x * int(model.labels[n]) for x, n in s) + toxicity.PRIOR_WEIGHT * model.prior) / (sum(-x for x, _ in s) + toxicity.PRIOR_WEIGHT)
    a, b = model.curve
    z = a * np.log(max(vote, 1e-6) / max(1 - vote, 1e-6)) + b
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), s


def test_nearest_equals_brute_force(spark, model):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    model.visited = 0
    for t in texts[::3]:
        (i, s), *_ = model.nearest([model.vector(t)])
        want = brute_score(model, t)[1]
        assert list(i) == [n for _, n in want] and np.allclose(s, [-x for x, _ in want])
    assert 0 < model.visited


def test_all_terms_of_the_examples_are_indexed():
    texts = ["one two extraordinary", "two three", "four", ""]
    weights = toxicity.label_weights(texts, [1, 0, 0, 1])
    assert list(weights) == sorted({"one", "two", "extraordinary", "extra*", "three", "four"}) and all(0 < w <= 1 for w in weights.values())
    model = toxicity.Model(weights, [1] * 6, 10, (texts, [1, 0, 0, 1], [5, 6, 7, 8]))
    assert len(model.owner) == 7 and model.n == 4


def test_ties_go_to_the_smaller_example(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "FIRST", 1)
    texts = [f"same words {'here' if i % 2 else 'there'}" for i in range(60)]
    weights = toxicity.label_weights(texts, [i % 2 for i in range(60)])
    model = toxicity.Model(weights, [9] * len(weights), 100, (texts, [i % 2 for i in range(60)], list(range(60))))
    for t in ("same here", "same there", "words", "nothing"):
        (i, _), *_ = model.nearest([model.vector(t), model.vector('')])
        assert list(i) == [n for _, n in brute_score(model, t)[1]]
    assert [model.ids[n] for n in model.nearest([model.vector("here")])[0][0]] == list(range(1, 30, 2))
    texts[7] += " special"
    weights = toxicity.label_weights(texts, [i % 2 for i in range(60)])
    model = toxicity.Model(weights, [9] * len(weights), 100, (texts, [i % 2 for i in range(60)], list(range(60))))
    assert [model.ids[n] for n in model.nearest([model.vector("special here")], k=1)[0][0]] == [7]
    assert model.visited < model.blocks  # the bounds of the others prove that they can't enter


def test_op10_equals_brute_force(spark, tmp_path):
    import zlib

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs += [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, docs[0][1], "de", "t", 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(common.table(spark, tmp_path, "documents"), common.table(spark, tmp_path, "labels").filter(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.op10_toxicity_knn(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        score, evidence = brute_score(model, t or "")
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].score == pytest.approx(score) and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].evidence == ",".join(str(model.ids[n]) for _, n in evidence)
    assert got[10_000].score == got[10_001].score and got[10_002].score == got[docs[0][0]].score


def test_held_out_accuracy(spark, model):
    d = "/root/testdata/sf0.01"
    held = common.table(spark, d, "labels").filter(toxicity.held_out()).join(common.table(spark, d, "documents"), "doc_id").collect()
    hits = collections.Counter((r.toxic, int(model.score(r.text)[0] >= 0.5)) for r in held)
    assert hits[0, 0] >= 0.95 * (hits[0, 0] + hits[0, 1])
    assert sum(n for (a, b), n in hits.items() if a == b) >= 0.93 * sum(hits.values())


def test_toxicity_edges(spark, model):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 100_000, 1), (1, None, 1)], "doc_id long, text string, score int")
    out = toxicity.score_documents(df, model).collect()
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="score"):
        toxicity.score_documents(df, model, into="score")
    assert len({r["__tw_tox"].score for r in out}) == 1 and out[0].score == 1 and 0 <= out[0]["__tw_tox"].score < 0.5
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("anything") == (0.0, [], [])
    one = toxicity.fit(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "doc_id long, toxic int"))
    assert one.n == 1 and 0 <= one.score("a b")[0] <= 1
