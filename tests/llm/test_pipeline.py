"""The pipeline against its stages' brute-force versions, one after another, and on odd tables."""

import hashlib

import numpy as np
import pytest
from test_more_ops import brute_mix
from test_text_ops import brute_lines, brute_near

import corpus_pipeline
from turnwise.llm import byte_bpe, common, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    # planted: a passage of over 50 words in many documents, near copies, an exact copy
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = [(i, t + "\n" + passage if i % 9 == 0 else t, *rest) for i, t, *rest in base]
    words = " ".join(f"near{i}" for i in range(200)).split()
    docs += [(1000 + k, " ".join(words[:k] + [f"changed{k}"] + words[k + 1 :]), "en", "s", 1) for k in range(5)] + [(1010, docs[3][1], "en", "s", 1)]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    d = write(spark, tmp_path, docs, labels)
    got = sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))

    model = toxicity.fit(common.table(spark, d, "documents"), common.table(spark, d, "labels").filter(~toxicity.held_out()))
    clean = [(i, t, s) for i, t, _, s, _ in docs if model.score(t)[0] < 0.5]
    gone = brute_lines([(i, t) for i, t, _ in clean])
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(True, i), t]), s) for i, t, s in clean]
    root, _ = brute_near([(i, t) for i, t, _ in kept])
    one = [r for r in kept if root[r[0]][0] == r[0]]
    assert {r[0] for r in one} & set(range(1000, 1005)) == {1000}
    codec = byte_bpe.codec(*byte_bpe.default_tokenizer())
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary
    want = []
    for (i, t, _), (_, taken) in zip(one, brute_mix(one), strict=True):
        size = len([w for w in t.replace("\x0b", " ").split() if w])
        ids = encode(t)
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want += [row] * (taken // size if size else 0)
    assert got == sorted(want)


@pytest.mark.parametrize("docs", [[], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b", None, "s", 3), (None, "x " * 40_000, "en", "s", 80_000)]])
def test_odd_tables(spark, tmp_path, docs):
    d = write(spark, tmp_path, docs, [(1, 1, 0), (None, 0, 1), (2, None, None)])
    df = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        df = common.cut(out, "odd")
    assert corpus_pipeline.STAGES[-1][1](spark, df, d).count() == df.count()
    assert np.isfinite(corpus_pipeline.run(spark, d).count())
