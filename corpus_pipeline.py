"""A corpus pipeline of five stages over ``documents``; part of the optional training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.decontaminate import without_leaks
from barwright.llm.jaccard_join import jaccard_components
from barwright.llm.packing import pack
from barwright.llm.quality import score_column, train
from barwright.llm.secrets import redact_secrets
from barwright.plans.bits import may_be_among
from barwright.plans.shared import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is 0.5 or more; the classifier is fitted on labelled rows of ``docs``.

    Null and empty texts, and null ids, are scored like any other; equal rows fare alike. Without labelled rows all stay.
    """
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score_column(machine, docs) >= 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of links between texts: the one with the smallest doc_id.

    Documents that share a doc_id, or have a null one, are documents of their own by their texts (known by a 64-bit hash of id and
    text, which takes the place of the id in its group); of rows with equal id and text one stays, the one with the least
    hash of all columns. Texts without a word link with nothing and stay, one of each id.
    """
    used = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in used else free(f"_{name}")
    row, many = free("row"), free("many")
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    several = stage(several.select("doc_id", F.lit(True).alias(many)), "several-ids")
    named = docs.join(several, "doc_id", "left").withColumn(many, F.col(many).isNotNull() | F.col("doc_id").isNull())
    named = named.withColumn(row, F.when(F.col(many), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    found = jaccard_components(named.select(F.col(row).alias("doc_id"), "text"))
    # of the texts, only those are shuffled that may be dropped or share an id
    dropped = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(row)).distinct(), "dropped")
    perhaps = free("perhaps")
    told = may_be_among(named, row, dropped, perhaps).withColumn(perhaps, F.col(perhaps) | F.col(many))
    asked = told.where(f"`{perhaps}`").join(dropped, row, "left_anti")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    first = asked.withColumn(free("nth"), F.row_number().over(Window.partitionBy(row, many).orderBy(whole))).where(f"`{free('nth')}` = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return told.where(f"not `{perhaps}`").select(*columns).union(first.select(*columns))


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, or 13 words of one, give or take substituted words.

    Null and empty texts stay. The columns other than text do not matter; equal rows fare alike.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts and renew n_chars; every document stays, null texts as they are."""
    return redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids: a row for each piece, its ids as a binary column.

    Null and empty texts, repeated rows and null ids are packed like any other. No documents, no pieces.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", no_leaks),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: Fitting, shingle hashing and tokenizing cannot be stated in SQL; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; between stages the rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
