"""Codes by filtering Lloyd, whitening and token counts: brute force, the libraries themselves, and edge cases."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from turnwise.llm import kdcodes, registry, token_counts, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, code string, x long, v string, size int"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables to a folder, as the driver's."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, n, "c", 1, "v", 2) for i, v, n in rows], VECTORS)


ODD = [(900, None, 1), (901, [1.0] * 31 + [None], 1), (902, [float("nan")] * 32, None), (903, [float("inf")] * 32, 2)]


# -- codes -----------------------------------------------------------------------------------------------------------
def lloyd(rows, parts=16, entries=64, rounds=2):
    """The same by comparing every part with every entry."""
    kept = [(i, [math.floor(256 * c) for c in v], n) for i, v, n in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cuts = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(cuts(v)[p]) for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, z, strict=True)) for z in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cuts(v)):
                groups[p][nearest(p, x)[0]].append(x)
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else z for g, z in zip(gs, zs, strict=True)] for gs, zs in zip(groups, books, strict=True)]
    coded = [(i, n, [nearest(p, x) for p, x in enumerate(cuts(v))]) for i, v, n in kept]
    label = {}
    for _, n, c in coded:
        label[n] = label.get(n, 0) + sum(d for _, d in c)
    sha = hashlib.sha256(",".join(str(x) for b in books for z in b for x in z).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{e:02x}" for e, _ in c), sum(d for _, d in c), label[n], sha)) for i, n, c in coded)


@pytest.mark.parametrize("kind", ["spread", "copies", "few"])
def test_codes_equal_brute_force(spark, folder, kind, monkeypatch):
    monkeypatch.setattr(kdcodes, "BLOCK", 32 * 100)  # several blocks
    rng = random.Random(kind)
    n = 20 if kind == "few" else 300
    rows = [(rng.choice([i, i, i // 2, None]), [rng.gauss(0, 0.3) for _ in range(32)], rng.choice([1, 2, None])) for i in range(n)]
    if kind == "copies":  # most rows are equal, and some differ only in one part
        rows = [(i, rows[0][1] if rng.random() < 0.7 else [*rows[0][1][:30], *v[30:]], n) for i, v, n in rows]
    rows = [(i, [float(np.float32(c)) for c in v], n) for i, v, n in rows]
    got = registry.QUERIES["op11_filtering_lloyd"](spark, folder(embeddings=embeddings(spark, rows + ODD).repartition(5)))
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got.collect()) == lloyd(rows)


@pytest.mark.parametrize("dim, span", [(1, 2), (2, 1), (4, 60), (7, 2**20), (3, 2**25)])
def test_filtered_entries_equal_comparing_all(dim, span):
    rng = np.random.default_rng(dim)
    for n in (1, 16, 17, 900):
        points = np.round(rng.normal(0, span, (n, dim))).astype(np.int64)
        points[: n // 2] = points[0]
        book = np.vstack([points[rng.integers(0, n, 40)], np.round(rng.normal(0, span, (24, dim))).astype(np.int64)])  # with equal entries
        codes, sums, counts, whole = kdcodes.Tree(points).filter(points, book)
        want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (codes == want).all() and (counts == np.bincount(want, minlength=64)).all()
        assert all((sums[e] == points[want == e].sum(0)).all() for e in range(64))


def test_copies_and_clusters_are_handed_over_as_subtrees():
    middles, book = np.array([[0, 0], [100, 100], [5, -90]]), np.array([[1, 1], [99, 99], [0, -80], [500, 500]])
    points = np.repeat(middles, 2000, axis=0)
    tree = kdcodes.Tree(points)
    assert tree.filter(points, book)[2].tolist() == [2000, 2000, 2000, 0] and len(tree.start) < 40
    near = points + np.random.default_rng(1).integers(-3, 4, points.shape)
    tree = kdcodes.Tree(near)
    _, _, counts, whole = tree.filter(near, book)
    assert counts.tolist() == [2000, 2000, 2000, 0] and 0 < whole < 20  # a few subtrees instead of 6000 points


def test_code_edges(spark, folder):
    none = embeddings(spark, ODD)
    assert registry.QUERIES["op11_filtering_lloyd"](spark, folder(embeddings=none)).collect() == []
    uneven = spark.createDataFrame([(1, "a", [1] * 16), (2, "a", [1] * 32)], "vec_id long, label string, v array<bigint>")
    with pytest.raises(ValueError, match="16 to 32"):
        kdcodes.compress(uneven)
    with pytest.raises(ValueError, match="multiple of 16"):
        kdcodes.compress(uneven.selectExpr("vec_id", "label", "array(1L) AS v"))
    with pytest.raises(ValueError, match="63 bits"):
        kdcodes.Tree(np.array([[2**40]])).filter(np.array([[2**40]]), np.array([[0]]))


# -- whitening -------------------------------------------------------------------------------------------------------
def whitened(rows, k=8):
    """By the whole covariance matrix, in integers up to the last step."""
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    exact = [[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in kept]
    c = np.array(exact, float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1][:, :k]
    return n, [sum(a * a for a in x) for x in exact], c @ u / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("kind", ["flat", "steep", "copies"])
def test_whitening_equals_the_whole_covariance(spark, folder, kind):
    rng = np.random.default_rng(len(kind))
    size = {"flat": np.ones(40), "steep": 0.8 ** np.arange(40), "copies": np.ones(40)}[kind]
    v = (rng.standard_normal((600, 40)) * size).astype(np.float32)
    if kind == "copies":
        v[::3] = v[0]  # a third of all rows
    rows = [(i, v[i].tolist()) for i in range(len(v))]
    table = embeddings(spark, [(i, x, None) for i, x in rows] + ODD).repartition(7)
    got = registry.QUERIES["op12_subspace_whitening"](spark, folder(embeddings=table)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, w, explained = whitened(rows)
    assert len(got) == 8 * 600 and set(got.n) == {n}
    assert got[got.component == 1].deviation.tolist() == deviation
    own = got.whitened.to_numpy().reshape(600, 8)
    assert np.abs(own * np.sign((own * w).sum(0)) - w).max() < 1e-9
    assert np.allclose(got.explained.to_numpy()[:8], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def spectrum(values, seed=0):
    u = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return u * values @ u.T


@pytest.mark.parametrize("values, narrow", [(0.5 ** np.arange(200), True), (np.linspace(1, 0.9, 200), False), (np.r_[5, 5, 3, 3, 3, np.full(95, 1e-3)], True)])
def test_iteration_certifies_and_widens_only_where_it_must(values, narrow):
    m = spectrum(values)
    u, e, trace, passes, width = whitening.subspace_iteration(lambda q: (m @ q, float(np.trace(m))), len(values), 5)
    assert np.allclose(e, values[:5], rtol=1e-12) and np.abs(m @ u - u * e).max() < 1e-12
    assert (width < len(values)) == narrow and passes < 40
    assert np.abs(u.T @ u - np.eye(5)).max() < 1e-12


def test_whitening_edges(spark, folder):
    run = registry.QUERIES["op12_subspace_whitening"]
    assert run(spark, folder(embeddings=embeddings(spark, ODD))).collect() == []
    rows = lambda *v: spark.createDataFrame([(i, list(x)) for i, x in enumerate(v)], "vec_id long, x array<bigint>")
    same = rows([1, 2], [1, 2])
    assert whitening.whiten(same, whitening.fit(same), 0.0).collect() == []  # no variance
    line = rows([0, 0, 7], [2, 4, 7], [4, 8, 7])
    model = whitening.fit(line)
    assert len(model.values) == 1 and whitening.identity_error(line, model) < 1e-12
    got = whitening.whiten(line, model, 0.0).orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [36 + 144, 0, 36 + 144] and [round(r.whitened, 6) for r in got] == [-1.224745, 0.0, 1.224745]
    assert got[0].explained == pytest.approx(1.0)
    with pytest.raises(ValueError, match="1 to 2"):
        whitening.fit(rows([1], [1, 2]))
    with pytest.raises(ValueError, match="64 bits"):
        whitening.fit(rows([2**61], [1]))
    far = whitening.fit(rows([0], [2**40]))
    assert far.deviations(np.array([[0]])) == [None]  # (2 ** 40) ** 2


# -- token counts ----------------------------------------------------------------------------------------------------
PARTS = ["a", "The", "é", "é", "́", " ", "  ", "\n", "\t", "\r", "\x0b", "\x85", "　", "\xa0", "<|endoftext|>", "<|startoftext|>", "<|end", "12", "7", "!", "?!", "'s", "'LL", "ß", "İ", "Σ", "中文", "😀", "‍", "\x00", "ﬁ", "﻿", "ᄀ", "ᅡ"]


def library(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name, monkeypatch):
    import public_tokenizers

    rng, path = random.Random(name), public_tokenizers.path(name)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(8000)] + ["word " * 40_000, "x" * 30_000, "", "a b" * 20_000]
    own = token_counts.tokenizer.__wrapped__(path)
    small = {"piece": 5} if isinstance(own, token_counts.Whole) else {}
    monkeypatch.setattr(token_counts, "REMEMBER", 500)  # what is remembered is dropped and found again
    want = library(path, texts)
    for _ in range(2):
        got = [n for i in range(0, len(texts), 700) for n in own.lengths(pa.array(texts)[i : i + 700], encode_bytes=1000, **small).tolist()]
        assert got == want


def test_arrays_of_any_layout_count_alike():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    own, texts = token_counts.tokenizer(path), ["one two", "", "three  four\nfive", "é", ""]
    want = library(path, texts)
    for a in (pa.array(texts), pa.array(["x y z", *texts])[1:], pa.array(texts, pa.large_string()), pa.array(["", ""])):
        assert own.lengths(a).tolist() == (want if len(a) == 5 else [0, 0])


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        parts = json.load(f)
    parts["pre_tokenizer"] = {**parts["pre_tokenizer"], "add_prefix_space": True}  # each piece would get a space
    path = str(tmp_path / "own.json")
    with open(path, "w") as f:
        json.dump(parts, f)
    own = token_counts.tokenizer(path)
    assert isinstance(own, token_counts.Whole) and own.boundary is None
    texts = ["one two  three", "", " x"]
    assert own.lengths(pa.array(texts)).tolist() == library(path, texts)
    with pytest.raises(ValueError, match=r"\.json or \.model"):
        token_counts.tokenizer("a.tiktoken")


def test_pieces_and_runs_are_bounded():
    text = "ab cd  ef " * 1000
    got = list(token_counts.pieces(text, token_counts._AT_SINGLE_SPACE, 50))
    assert " ".join(got) == text and max(map(len, got)) <= 60
    runs = list(token_counts.balanced(["x" * n for n in (5, 90, 1, 200, 30, 30, 30)], 100))
    assert [len(x) for r in runs for x in r] == [5, 90, 1, 200, 30, 30, 30]
    assert all(len(r) == 1 or sum(map(len, r)) <= 100 for r in runs)


def test_token_count_query(spark, folder):
    import public_tokenizers

    rows = [(1, None, "a"), (1, "", "a"), (None, "Ünï codé <|endoftext|> 日本", None), (2, "long words " * 30_000, "b"), (2, "long words " * 30_000, "b"), (3, "one two", "c")]
    docs = spark.createDataFrame([(*r, 5, "y") for r in rows], "doc_id long, text string, source string, n_bytes int, over_limit string")
    got = registry.QUERIES["op13_token_counts"](spark, folder(documents=docs)).collect()
    counts = library(public_tokenizers.path("word_bpe_49k.json"), [t or "" for _, t, _ in rows])
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t, _), n in zip(rows, counts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    with pytest.raises(ValueError, match="already"):
        token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), into="N_BYTES")
    assert token_counts.count_tokens(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []
