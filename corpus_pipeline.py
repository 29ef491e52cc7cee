"""A training-corpus pipeline over the documents table.

Each stage takes what its predecessor kept and calls one operator over all of it:

1. quality: documents that the classifier rejects go;
2. near_duplicates: of each group of documents linked by n-gram Jaccard one stays, that of least id;
3. personal_data: spans are replaced by their kind in brackets;
4. mixing: each document appears as often as the mix takes it;
5. tokens: the SentencePiece ids of each text.

All but the last return the columns of documents. Every row is a document of its own, whatever its id; a null text
counts as an empty one, an empty table gives an empty one at each stage, and further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedloom.llm import mixing, ngram_join, piece_codec, pii, quality
from fedloom.plans.session import Scratch, arrow_batches, read_table, ship_package, work_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH = 1000  # texts that redaction gets at once: both sides of the pipe to Python hold that many


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those of them that labels covers, scores 0.5 or more.

    Repeated rows get the same decision. Without labels of both kinds every row gets the same score.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id (a null id is the last, ties by a hash of the text).

    Rows are told apart by id and text. Of rows that are equal in both one stays, the least by language, source
    and length; they are brought together before the shuffle, so many of them do no harm. Texts without words
    are linked with nothing, and all rows with one stay.
    """
    ship_package(spark)
    worded = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"))
    keyed = docs.where(worded).select(*COLUMNS, key.alias("row_key"))
    groups = ngram_join.similar_components(spark, keyed, id_col="row_key")
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("row_key")).distinct()
    rows = keyed.groupBy("row_key").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"), F.first("text").alias("text"))
    rows = rows.join(stay, "row_key", "left_semi").select("row_key.doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")
    return rows.union(docs.where(~worded).select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets, and n_chars of the new text (a null text stays as it is)."""
    ship_package(spark)
    # written here, as the number of rows that Python gets at once holds only until then
    with arrow_batches(spark, BATCH):
        clean = work_table(spark, pii.find_personal_data(docs.select(*COLUMNS), output="redacted"), "pipeline-redacted")
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; texts without words are never taken."""
    mixed = mixing.mix_sources(spark, docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"))
    copies = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.where("taken > 0").select(*COLUMNS, F.explode(copies).alias("copy")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the ids of each text, their number, and hashes of ids and decoded text; a null or empty text has no ids."""
    ship_package(spark)
    return piece_codec.encode_column(docs, keep=("doc_id", "lang", "source", "n_chars"), output="ids")


STAGES = [
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: The classifier and the random field can't be stated in SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet in the shared folder and read again; what a stage read is deleted once it is written."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, f"pipeline-{name}")
            scratch.drop(before)
    return docs
