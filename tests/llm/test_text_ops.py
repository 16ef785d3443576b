"""Brute-force versions and edge cases of the operators that no SQL expresses."""

import collections
import hashlib
import random
import struct
import zlib

import pytest

from turnwise.llm import byte_bpe, line_dedup, ngram_join, ogg, records

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, source string, th string, node string, spans string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "clash", "clash") for i, t in rows], DDL)


def read(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# -- line dedup ------------------------------------------------------------------------------------------------------
def brute_lines(rows, min_words=50):
    """Lines in any run of at least min_words words whose lines also stand earlier, by all pairs of places."""
    import xxhash  # noqa: F401

    docs = sorted(((i is not None, i or 0), t, i) for i, t in set(rows))
    at, out = {}, {}
    for order, text, _ in docs:
        lines = [(k, s) for k, x in enumerate(text.split("\n")) if (s := x.strip())]
        gone = set()
        places = []
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b][1].split())
                if words >= min_words:
                    key = tuple(s for _, s in lines[a : b + 1])
                    if key in at:
                        gone |= set(range(lines[a][0], lines[b][0] + 1))
                    places.append(key)
                    at.setdefault(key, None)
                    if b - a > 60:  # longer spans are covered by spans of up to 60 lines, which have over 50 words
                        break
        out[order, text] = gone
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 12, 25, 60)))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "text", "__tw_lines.*").collect()}
    want = brute_lines(rows)
    for i, t in rows:
        gone = want[(True, i), t]
        assert got[i].n_deleted == len(gone), i
        assert got[i].kept == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert got[i].text == t


def test_lines_that_stand_first_in_other_company(spark):
    """The fingerprint of a run may stand first, or first twice, among other lines: later places of the run still meet."""
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(6)]
    own = iter(range(10**6))
    rows = [(i, "\n".join([f"lead {next(own)} " + "x " * 15, lines[i % 6], f"end {next(own)} " + "y " * 40])) for i in range(12)]
    rows += [(50 + i, "\n".join([f"own {next(own)}", *lines[i % 3 : i % 3 + 4], f"own {next(own)}"])) for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "__tw_lines.*").collect()}
    want = brute_lines(rows)
    assert {i: got[i].n_deleted for i, _ in rows} == {i: len(want[(True, i), t]) for i, t in rows}
    assert got[52].n_deleted and got[55].n_deleted == 4


def test_minima_thin_windows_out():
    rng = random.Random(2)
    text = "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(6)) for _ in range(900))
    words, hashes = [6] * 900, [rng.getrandbits(63) for _ in range(900)]
    n_windows, n_prints = len(list(line_dedup.windows(words, hashes, 50))), len(list(line_dedup.fingerprints(text, 50)))
    assert n_windows > 850 and n_prints < 0.4 * n_windows


def test_line_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long + "\nshort"), (None, None), (3, ""), (4, long + "\n" + long), (5, "x" * 200_000)]
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "__tw_lines.*").collect():
        got[r.doc_id].append((r.kept, r.n_deleted))
    assert got[1] == [(long, 0), (long, 0)]  # repeated rows are one document
    assert got[2] == [("short", 1)] and got[4] == [("", 2)]
    assert got[None] == [("", 0)] and got[3] == [("", 0)] and got[5][0][1] == 0
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# -- n-gram join -----------------------------------------------------------------------------------------------------
def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = (frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), t or "")
    links, root = collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = collections.defaultdict(set)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (x, s), (y, t) = sets[a], sets[b]
            if x and y and len(x & y) * 5 >= 4 * len(x | y):
                if s != t:
                    seen[a].add(t)
                    seen[b].add(s)
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (find(i), len(seen[i])) for i in ids}, links


def variants(seed=3, n=150):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice((4, 30, 120, 400)))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    return rows


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = variants()
    want, _ = brute_near(rows)
    for block in (1024, 8):  # small blocks: large components are split, and told apart by differences
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
        assert got == want


def test_near_duplicates_edges(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t), (3, t), (3, t), (None, t), (7, None), (8, ""), (9, " \n"), (10, "one two"), (11, "one two"), (12, "z" * 100_000)]
    got = collections.defaultdict(list)
    for r in ngram_join.near_duplicates(documents(spark, rows)).collect():
        got[r.doc_id].append((r.class_id, r.n_links, r.n_copies))
    assert got[5] == [(3, 0, 3)] and got[3] == [(3, 0, 3)] * 2 and got[None] == [(3, 0, 3)]
    assert [got[i][0][0] for i in (7, 8, 9, 10, 11, 12)] == [7, 8, 9, 10, 10, 12]
    kept = sorted((r.doc_id is None, r.doc_id) for r in ngram_join.keep_one(documents(spark, rows)).collect())
    assert [i for _, i in kept] == [3, 7, 8, 9, 10, 12]
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0


def test_depths_follow_what_was_met():
    floor = ngram_join.least_depth(0.8, 40, 8, 0.999999)
    assert 1 - ngram_join.missed(0.8, floor) >= 0.999999 > 1 - ngram_join.missed(0.8, floor + 1)
    lost = lambda s: [float(ngram_join.missed(s, d)) for d in range(1, 9)]
    assert ngram_join.shorten(8, 1, lost(0.97), 0.999999, floor) == 8  # links of near equal texts: whole labels do
    assert ngram_join.shorten(8, 1, lost(0.83), 0.999999, floor) in (6, 7)
    assert ngram_join.shorten(8, 1, lost(0.8), 0.999999, floor) == floor
    assert ngram_join.shorten(8, 0, lost(0.8), 0.999999, floor) == floor  # nothing is known
    assert ngram_join.shorten(6, 1, lost(0.97), 0.999999, floor) == 6


def signed(spark, texts):
    signer = ngram_join.Signer()
    return spark.createDataFrame([(bytearray(k.to_bytes(16, "big")), bytearray(signer.labels(ngram_join.shingles(t)))) for k, t in enumerate(texts)], "node binary, labels binary")


@pytest.mark.parametrize("rows", [500_000, 40])
def test_runs_of_the_forest_equal_equal_prefixes(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_join, "FOREST_ROWS", rows)  # small ranges: runs are cut and stitched
    nodes = signed(spark, [t for _, t in variants(n=60)])
    labels = {bytes(r.node): bytes(r.labels) for r in nodes.collect()}
    trees = ngram_join.forest(nodes)
    assert trees.count() == 60 * 40
    for depth in (8, 5):
        met, root = {tuple(map(bytes, r)) for r in ngram_join.matches(trees, depth).collect()}, {n: n for n in labels}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in met:
            assert any(labels[a][t * 16 : t * 16 + 2 * depth] == labels[b][t * 16 : t * 16 + 2 * depth] for t in range(40))
            root[find(a)] = find(b)
        for a in labels:
            for b in labels:
                if any(labels[a][t * 16 : t * 16 + 2 * depth] == labels[b][t * 16 : t * 16 + 2 * depth] for t in range(40)):
                    assert find(a) == find(b)


def test_prefixes_are_shortened_by_the_data_and_planted_pairs_are_met(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def pairs(low, high, n):
        """Pairs whose similarity lies between the two."""
        out = []
        while len(out) < n:
            a = words(300)
            b = list(a)
            for _ in range(rng.randint(1, 8)):
                b[rng.randrange(300)] = f"x{rng.random()}"
            x, y = (set(ngram_join.shingles(" ".join(t)).tolist()) for t in (a, b))
            if low <= len(x & y) / len(x | y) <= high:
                out.append((" ".join(a), " ".join(b)))
        return out

    def met(some):
        edges, depths = ngram_join.candidates(signed(spark, [t for p in some for t in p]))
        found = {frozenset(int.from_bytes(x, "big") for x in r) for r in edges.collect()}
        return sum(frozenset((2 * k, 2 * k + 1)) in found for k in range(len(some))), depths

    n, depths = met(pairs(0.95, 1, 40))
    assert n == 40 and depths == [8]
    n, depths = met(pairs(0.8, 0.85, 300))
    assert n == 300 and depths[0] == 8 and depths[-1] < 7


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_differences_from_a_lead_count_the_same_links(pairs, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_join, "PAIRS", pairs)

    rng = np.random.default_rng(3)
    base = np.arange(1, 400, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(300, 399), replace=False), rng.integers(1000, 1040, rng.integers(1, 40)).astype(np.uint64)]) for _ in range(70)]
    sizes = np.array(list(map(len, sets)))
    want = np.array([[len(set(x.tolist()) & set(y.tolist())) * 9 >= 4 * (len(x) + len(y)) for y in sets] for x in sets])
    assert (ngram_join.linked(sets, sets, (sizes, sizes)) == want).all() and 0 < want.sum() < want.size
    d = [np.setxor1d(x, base) for x in sets]
    less = np.array([len(np.setdiff1d(base, x)) for x in sets])
    assert (ngram_join.linked(d, d, (sizes, sizes), len(base), (less, less)) == want).all()


# -- byte-level BPE --------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(*byte_bpe.default_tokenizer())


@pytest.fixture(scope="module")
def tiktoken_encode(codec):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary


def test_tree_equals_library(codec, tiktoken_encode, monkeypatch):
    rng = random.Random(1)
    alphabets = ["abcdeinrst", "ab", "éèäß한국😀", "0123456789", "aé!?.,-' \n\t"]
    for leaf in (1, 3, 32):
        monkeypatch.setattr(byte_bpe, "LEAF_BYTES", leaf)
        for _ in range(400):
            s = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 90)))
            ids = [t for m in codec.find(s) for t in codec._tree(m.encode())]
            assert ids == tiktoken_encode(s)


def test_whole_texts_and_round_trip(codec, tiktoken_encode, monkeypatch, spark):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", 64)
    for t in [*(t for _, t in read(spark)), "", " ", "a" * 20_000, "ab" * 9_000, "<|endoftext|>", "x \n\n  y", " lead", "tail "]:
        ids = codec.encode(t)
        assert ids == tiktoken_encode(t) and codec.decode(ids) == t.encode()


def test_ordinary_words_go_through_the_tree(codec, tiktoken_encode):
    own = byte_bpe.Codec(*byte_bpe.default_tokenizer())
    text = "unquestionably extraterrestrial zyxgrammatology preposterousness"
    assert own.encode(text) == tiktoken_encode(text)
    assert own.joins > 6 and own.windows > 0  # halves joined, seams re-encoded


def test_op9_equals_the_library(spark, tiktoken_encode):
    got = {r.doc_id: r for r in byte_bpe.op9_byte_bpe(spark, SF).collect()}
    for i, t in read(spark):
        ids = tiktoken_encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_remembered_pieces_equal_the_library(tiktoken_encode, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBER", 50)  # memories fill up and are emptied
    own, rng = byte_bpe.Codec(*byte_bpe.default_tokenizer()), random.Random(9)
    alphabets = ["abcdeinrst", "éèäß한😀", "0123456789", "a!?.,-' \n\t", "   ", " \x1c\x85\xa0\u3000"]
    for _ in range(3000):
        s = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        assert own.encode(s) == tiktoken_encode(s)


def test_bpe_edges(spark):
    path, pattern = byte_bpe.default_tokenizer()
    assert byte_bpe.encode_documents(documents(spark, []), path=path, pattern=pattern).count() == 0
    assert byte_bpe.encoding_digests(documents(spark, []), path=path, pattern=pattern).count() == 0
    clash = documents(spark, [(1, "a")]).withColumnRenamed("th", "ids").withColumnRenamed("node", "decoded")
    with pytest.raises(ValueError, match="ids"):
        byte_bpe.encode_documents(clash, path=path, pattern=pattern)
    out = byte_bpe.encode_documents(clash, path=path, pattern=pattern, ids_col="own")
    with pytest.raises(ValueError, match="decoded"):
        byte_bpe.decode_documents(out, path=path, pattern=pattern, ids_col="own")
    assert byte_bpe.decode_documents(out, path=path, pattern=pattern, ids_col="own", bytes_col="b").first().ids == "clash"


def test_bpe_columns(spark):
    path, pattern = byte_bpe.default_tokenizer()
    df = documents(spark, [(1, "hello there"), (1, "hello there"), (None, None), (2, "")])
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(df, path=path, pattern=pattern), path=path, pattern=pattern).collect()
    assert [(r.doc_id, bytes(r.decoded)) for r in out] == [(1, b"hello there"), (1, b"hello there"), (None, b""), (2, b"")]
    d = byte_bpe.encoding_digests(df, path=path, pattern=pattern).collect()
    assert [r.n_tokens for r in d][2:] == [0, 0]
    assert d[0].ids_sha256 == hashlib.sha256(",".join(map(str, out[0].ids)).encode()).hexdigest()


# -- records ---------------------------------------------------------------------------------------------------------
def slow_crc32c(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    data = random.Random(2).randbytes(1000)
    cuts = [4, 8, 255, 256, 257, 1000]
    assert records.crc32c_many([data[:n] for n in cuts]) == [slow_crc32c(data[:n]) for n in cuts]
    assert records.crc32c_many([b"123456789"]) == [0xE3069283]


def test_words_equal_whole_texts(spark):
    import public_tokenizers

    e = records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for _, t in read(spark)] + ["don't  STOP\u0085x y\x1cz <|endoftext|> á ́x 12 34.5", "", " ", "Σας ΣΑΣ İ", "q" * 5000]
    for t, ids in zip(texts, e.encode(texts, 2), strict=True):
        assert ids.tolist() == [*e.own.encode(t, add_special_tokens=False).ids, 2]


def test_added_tokens_in_texts_equal_the_untouched_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["ab <|endoftext|> cd", "<|startoftext|>Hello", "x<|endoftext|>y<|startoftext|>.", "<|ENDOFTEXT|> <|endoftext|", "é<|endoftext|>\u0301ß\tz"]
    got = [x.tolist() for x in records.WordEncoder(path).encode(texts, 2)]
    assert got == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert got[0] == [3937, 49407, 4480, 2]


@pytest.fixture(scope="module")
def plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_records(rows, tokenizer):
    """(doc_id, start, n_tokens, ids_crc32) in ascending order of ids; rows with one id are given in the order of their texts' hashes."""
    import numpy as np
    import xxhash

    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or ""))):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_op7_equals_the_library(spark, plain_tokenizer):
    got = records.op7_binary_records(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute_records(read(spark), plain_tokenizer)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizer_files_go_through_the_library_whole(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    e, own = records.WordEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert e.by_words == (name == "word_bpe_49k.json")
    texts = ["Hello  there,\n<|endoftext|> you", "", " x"]
    assert [x.tolist() for x in e.encode(texts, 2)] == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_records_round_trip(spark, tmp_path, plain_tokenizer):
    import public_tokenizers

    rows = [(7, "b c"), (None, None), (3, "x " * 3000), (5, ""), (3, "a"), (3, "a"), (-2, "Zed <|endoftext|> z"), *((None, f"no id {i}") for i in range(40)), *((100 + i, f"doc {i}") for i in range(50))]
    written = records.write_records(documents(spark, rows), str(tmp_path / "out"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), docs_per_file=10)
    files = written.orderBy("range", "number").collect()
    assert len(files) > 6 and max(f.n_records for f in files) <= 30  # rows without id are split too
    got = records.read_records(written).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute_records(rows, plain_tokenizer)
    with open(files[1]["path"] + ".rec", "rb") as data, open(files[1]["path"] + ".idx", "rb") as index:
        some = [records.read_record(data, index, i) for i in range(files[1]["n_records"])]
        assert sum(len(records.unpack(x)[1]) for x in some) == files[1]["n_ids"]
        assert records.read_record(data, index, 2) == some[2] and records.read_record(data, index, 0) == some[0]
    blob = bytearray(open(files[0]["path"] + ".rec", "rb").read())
    blob[20] ^= 1
    import io

    with pytest.raises(ValueError, match="checksum"):
        list(records.read_frames(io.BytesIO(bytes(blob))))
    empty = records.write_records(documents(spark, []), str(tmp_path / "none"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    assert records.read_records(empty).count() == 0


# -- Ogg -------------------------------------------------------------------------------------------------------------
def slow_ogg_crc(b):
    c = 0
    for x in b:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum():
    for b in (b"", b"a", b"123456789" * 9):
        assert ogg.page_crc(b) == slow_ogg_crc(b)


def test_packets_survive_lacing_and_interleaving():
    sizes = [0, 1, 254, 255, 256, 510, 70_000, 65_025, 3]
    one = [(bytes([i]) * n, i * 10) for i, n in enumerate(sizes)]
    two = [(b"note" * k, k) for k in range(1, 400)]
    got = ogg.demux(b"junk" + ogg.mux({1: one, 2: two}) + b"Ogg")
    assert got.bad_checksums == 0 and got.skipped_bytes == 7
    assert got.streams[1].packets == [p for p, _ in one] and got.streams[2].packets == [p for p, _ in two]
    assert got.streams[1].first and got.streams[1].last
    ends = ogg.packet_ends(got.streams[2].granules, [1] * 399)
    assert ends[-1] == 399


def test_a_damaged_page_is_left_out():
    media = bytearray(ogg.mux({1: [(b"head", 0), *((bytes([i]) * 5000, i) for i in range(60))]}))
    pages = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    media[pages[2] + 300] ^= 1
    got = ogg.demux(bytes(media))
    assert got.bad_checksums == 1 and got.streams[1].gaps == 1
    assert 0 < len(got.streams[1].packets) < 61 and all(len(set(p)) == 1 for p in got.streams[1].packets[1:])


def test_op1_equals_brute_force(spark):
    got = {r.doc_id: r for r in ogg.op1_ogg_media(spark, SF).collect()}
    for i, t in read(spark):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        frames = len(payload) // 576
        # an audio stream: a page with its 44-byte header, then packets of three lacing values, 85 to a page; and a note stream of one page
        pages = -(-3 * frames // 255)
        size = 27 + 1 + 28 + sum(27 + min(255, 3 * frames - 255 * k) for k in range(pages)) + len(payload) + 27 + 1 + 8
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == size - 28 + ogg._PCM.size
        media = ogg.mux_payload(len(data), payload)
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and len(media) == r.media_bytes
        assert r.feature == (
            f"streams=2;pages={pages + 2};bad=0;gaps=0;packets={frames + 1};end_ms={len(payload) * 1000 // 8000};last_granule={len(payload)};"
            f"mean={sum(payload) / len(payload):.3f};spaces={payload.count(b' ')};lines={payload.count(10)};pad={payload.count(255)}"
        )


def test_ogg_edges(spark):
    assert ogg.store_texts(documents(spark, [])).count() == 0
    twice = ogg.store_texts(documents(spark, [(1, "a"), (1, "a"), (None, "é" * 300_000)]))
    assert twice.count() == 3 and ogg.demux_packets(twice).filter("size(packets) = 0").count() == 0
    with pytest.raises(ValueError, match="media"):
        ogg.store_texts(twice)
    assert ogg.demux_packets(spark.createDataFrame([(None,)], "media binary")).first().packets == []


def test_stored_texts(spark):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "y" * 577), (5, "é" * 70_000), (6, "")]
    media = ogg.store_texts(documents(spark, rows)).collect()
    for r in media:
        n, payload = ogg.padded(r.text or "")
        x = ogg.demux_payload(bytes(r.media))
        assert x["payload"] == payload and x["n_bytes"] == n == len((r.text or "").encode())
        assert len(payload) % 576 == 0 and payload
    assert media[0].media == media[1].media == media[5].media
    packets = ogg.demux_packets(ogg.store_texts(documents(spark, rows))).select("packets").collect()
    assert len(packets[3].packets) == 1 + 2 + 1 and bytes(packets[3].packets[-1].data) == struct.pack("<Q", 577)


def test_every_packet_has_the_time_of_its_end(spark):
    n, payload = ogg.padded("x" * 576 * 200)
    media = bytearray(ogg.mux_payload(n, payload))
    got = ogg.demux_packets(spark.createDataFrame([(media,)], "media binary")).first().packets
    assert [p.end_ms for p in got if p.serial == ogg.AUDIO] == [i * 72.0 for i in range(201)]
    assert [p.end_ms for p in got if p.serial == ogg.NOTE] == [0.0]
    pages = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    media[pages[-2] + 400] ^= 1  # a page of samples amid others
    left = [r["end_ms"] for r in ogg.packet_rows(bytes(media)) if r["serial"] == ogg.AUDIO]
    assert len(left) < 201 and left[-1] == 200 * 72.0 and set(left) <= {i * 72.0 for i in range(201)} and len(set(left)) == len(left)
    head = ogg._PCM.pack(b"PCM     ", 0, 0, 1, 48000, 16, 2, 480, 0)
    stereo = ogg.mux({5: [(head, 0), *((b"ab" * 960, 480 * (i + 1)) for i in range(9))]})
    assert [r["end_ms"] for r in ogg.packet_rows(stereo)] == [i * 10.0 for i in range(10)]


def test_the_mean_is_over_all_samples():
    text = "".join(chr(97 + i % 2) for i in range(9216)) + "\U0001f600" * 144  # 9792 bytes, no padding
    got = ogg.demux_payload(ogg.mux_payload(*ogg.padded(text)))
    assert f";mean={sum(text.encode()) / len(text.encode()):.3f};" in got["feature"]


# -- components ------------------------------------------------------------------------------------------------------
def test_components_of_chains_stars_and_random_edges(spark):
    from turnwise.llm.graph import components

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + rng.randint(0, 60), 200 + rng.randint(0, 60)) for _ in range(45)]
    edges = [e for e in edges if e[0] != e[1]]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = components(spark.createDataFrame(edges, "a int, b int"))
    assert sorted(map(tuple, got.collect())) == sorted(root.items())
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("sizes", [[10, 100, 130_000, 7], [300] * 900, [70_000, 1, 1, 254, 255, 256, 70_000, 3]])
def test_times_stay_when_a_page_is_lost(sizes):
    head = ogg._PCM.pack(b"PCM     ", 0, 0, 1, 8000, 8, 1, 576, 0)
    rng, packets, at = random.Random(1), [(head, 0)], 0
    for n in sizes:
        at += n
        packets.append((rng.randbytes(n), at))
    pages = list(ogg.pages_of(7, packets))
    whole = ogg.packet_rows(b"".join(pages))
    assert [r["end_ms"] for r in whole] == [g / 8 for _, g in packets] and ogg.demux(b"".join(pages)).streams[7].gaps == 0
    times = {}
    for r in whole:
        times.setdefault(r["data"], set()).add(r["end_ms"])
    for lost in range(len(pages)):
        media = b"".join(p for i, p in enumerate(pages) if i != lost)
        for r in ogg.packet_rows(media):
            assert r["end_ms"] in times[r["data"]] or (lost == 0 and r["end_ms"] is None)  # without its header a stream's rate isn't known
        assert ogg.demux(media).streams[7].gaps == 1, lost
