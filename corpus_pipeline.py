"""Five operators in a row over ``documents``: toxicity, line dedup, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet to the shared folder and reads it back for the next, so a lost executor repeats a part of one stage at most.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import byte_bpe, common, line_dedup, mixing, ngram_join, toxicity


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model learns from the labels of rows that aren't held out."""
    labels = common.table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.filter(F.col("__tw_tox.score") < 0.5).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later repeats of runs of 50 words or more; a document may be left empty.  n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    x = lambda n: F.col("__tw_lines." + n)
    kept = {"text": F.when(x("n_deleted") > 0, x("kept")).otherwise(F.col("text")), "n_chars": F.when(x("n_deleted") > 0, F.length(x("kept")).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(kept[c].cast(t).alias(c) if c in kept else F.col(f"`{c}`") for c, t in docs.dtypes))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as it is taken."""
    return mixing.mixture(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of their decoding."""
    path, pattern = byte_bpe.default_tokenizer()
    common.prepare(spark)
    return byte_bpe.encoding_digests(docs, path=path, pattern=pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources", mix),
    ("byte-level BPE", tokenize),
]

#: No SQL: similarity search and winnowing decide what later stages see.  tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
