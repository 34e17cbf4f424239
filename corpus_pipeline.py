"""The corpus pipeline: five stages over `documents`, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again. All but the last return the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import byte_bpe, quality_model, set_join, source_mix, surrogates
from feedloom.llm.common import cut, documents, small_batches, table

#: Words of a shingle and similarity of near copies in the pipeline; op5's contract has values of its own.
NEAR = {"num": 80, "den": 100, "shingle": 5}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of 0.5 and more). A null or empty text is judged by its
    statistics (all 0), repeated rows are judged alike, long texts whole, and an empty table stays empty."""
    scored = quality_model.classify(docs, table(spark, sf_dir, "labels"), keep_columns=True, names=("__score", "__predicted"))
    return scored.filter("__predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that links join: the one of least doc_id, a null one last. Rows are told
    apart by a row number of a written table, so doc_ids may repeat or be null. Texts without words are in no group and stay."""
    marked = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = set_join.similar_components(marked, **NEAR, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    named = found.join(marked.select("__row", "doc_id"), "__row")
    firsts = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x")).select(F.col("x.__row").alias("__row"))
    return marked.join(firsts, "__row", "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data; n_chars follows the text. Null texts stay null (n_chars too),
    texts without entities stay as they are, repeated rows are replaced alike."""
    out = surrogates.with_surrogates(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: once an epoch, the last of a source cut at the budget. Texts without words take nothing
    and aren't in the mix; a null source is a source, the last one; repeated rows are taken each for itself."""
    out = source_mix.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of the decoded bytes of every row. A null text counts as empty
    and has no tokens; repeated rows are encoded alike; long texts whole."""
    # executors that the stages before have filled have little left for batches of texts and for workers
    with small_batches(spark, byte_bpe.LEAN_ROWS):
        return cut(byte_bpe.digests(docs, *byte_bpe.multi_50k(), keep=("source",), hold=False), "tokens")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: No single SQL text states boosted trees, components and BPE merges; a test holds run() against
#: brute-force groups and tokens, and tests of their own hold the trees, surrogates and mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
