"""A corpus from documents to packed sequences: toxic documents go, common lines are dropped, one document of each
group of near copies stays, sources are mixed to their weights, and what is left is packed.

Each stage reads all that the one before has kept, as a table. ``run`` writes them in the shared folder.

Defined cases, for every stage: an empty table gives an empty table with the stage's columns; a null or empty text is a
document like any other (it scores the base rate, has one empty line, is near nothing, has the size 0, and is one
end-of-document id); rows that repeat an id are documents of their own but for the third stage; texts of any length are
read whole; other columns are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisieve.llm import line_dedup, mixing, ngram_join, packing, scratch, toxicity


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; ``n_chars``, where it is one of them, follows the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under its threshold. Without labels all of them stay; a null id
    has no label and is scored by its text."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.scored(docs, machine).where(F.col("__ls_score") < toxicity.THRESHOLD).drop("__ls_score")


def common_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; one whose lines all go stays, with an empty text. Rows
    with a null id are one document when lines are counted, the smallest."""
    return _recounted(line_dedup.drop_common_lines(docs), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, of those with its smallest id; all ids without words stay. Rows that
    repeat an id stay or go by their own texts: of equal texts, of near copies and of texts without words one stays.
    Rows without an id can't be named as copies and stay."""
    found = ngram_join.grouped(docs.select("doc_id", "text"))
    kept = found.where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("text_hash").alias("__ls_text"))
    kept = kept.select("doc_id", "__ls_text").distinct()
    named = docs.withColumn("__ls_text", ngram_join.text_hash()).join(kept, ["doc_id", "__ls_text"], "left_semi")
    # Equal rows are brought together before they are dealt by id.
    one = named.groupBy("doc_id", "__ls_text").agg(F.any_value(F.struct(*docs.columns)).alias("__ls_row")).select("__ls_row.*")
    return one.unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, the last one in part; documents without a word are not
    taken. A null source is a source, the last one. Equal rows are taken by their place, so each counts."""
    return _recounted(mixing.mix(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, of copies that the mix made, too; a null id stays null in its pieces."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", common_lines_out),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: The toxicity and the packing stages are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
