"""From raw documents to token ids, in stages; part of the subpackage hydroframe.llm.

STAGES are (name, function).  A function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.  No stage can be told as SQL as
a whole, so ORACLE_SQL is None; tests compare every stage with a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.llm import bpe, decontam, jaccard, langid, secretscan
from hydroframe.llm.textkit import Tables, lean, table, tokenizer_path, written
from hydroframe.operators.window import numbered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No stage can be told as SQL as a whole.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; a missing lang becomes the prediction."""
    lean(spark)
    model = langid.train(docs)
    found = langid.identify(docs, model)
    return found.where("accepted").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


#: So many ids at most are broadcast; more are joined by a shuffle.
MOST_IDS = 1_000_000


def _split(docs: DataFrame, ids: DataFrame, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """docs without the ids, and those with them; texts aren't shuffled while the ids are few."""
    if ids.limit(MOST_IDS + 1).count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, by, "left_anti"), docs.join(ids, by, "left_semi")


def _numbered(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """docs with _row, a number in the order of doc_id and text; of rows with one doc_id and text the first stays."""
    single, repeated = _split(docs, twice)
    copies, texts = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars"), Window.partitionBy("doc_id").orderBy("text")
    repeated = repeated.withColumn("_n", F.row_number().over(copies)).where("_n = 1").withColumn("_n", F.row_number().over(texts))
    rows = written(single.select(*COLUMNS, F.lit(1).alias("_n")).unionByName(repeated.select(*COLUMNS, "_n")), "near-duplicates-rows")
    order = numbered(rows.where("doc_id is not null").select("doc_id", "_n"), "doc_id", "_n", name="_row")
    return written(rows.join(order, ["doc_id", "_n"], "left").select(*COLUMNS, "_row"), "near-duplicates-numbered")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (five words, 0.8): the one of least doc_id, then the first by text.

    Rows that share a doc_id are told apart by their texts; those with the same
    text are one.  Rows without a doc_id can't be told apart, and stay.
    """
    lean(spark)
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rows = _numbered(docs.select(*COLUMNS), twice) if twice.limit(1).count() else docs.select(*COLUMNS, F.col("doc_id").alias("_row"))
    found = written(jaccard.classes(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, num=80, den=100), "near-duplicates").where("doc_id is not null")
    kept, _ = _split(rows, found.where("doc_id <> component_id").select(F.col("doc_id").alias("_row")).distinct(), "_row")
    return kept.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of ten words."""
    lean(spark)
    found = decontam.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), size=10, keep_text=True)
    return found.where("not contaminated").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    lean(spark)
    found = secretscan.scan(docs.select(*COLUMNS), secretscan.train())
    changed = F.col("n_secrets") > 0
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian uint32) and ids_sha256; exact: the ids decode to the text."""
    lean(spark)
    made = bpe.encode(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")), tokenizer_path("byte_bpe_multi_50k.tiktoken"), decoded="decoded")
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == F.col("text").cast("binary")).alias("exact"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted once the next one's is written."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for name, stage in STAGES:
        last, docs = list(tables.paths.values()), tables.write(stage(spark, docs, sf_dir), name)
        if last:
            tables.drop(*[df for df, _ in last])
    return docs
