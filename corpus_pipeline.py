"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next.  All but the last return the
columns of documents.  There is no SQL for the whole: the first stage is a trained model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.llm.common import Workspace, read_table
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.jaccard_join import jaccard_components
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.packing import pack

ORACLE_SQL = None


OWN = ("doc_id", "text", "n_chars")  # columns that the operators of the stages read


def _beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What stage keeps of docs, with the columns of docs.

    Other columns than OWN go through under names that no operator gives its results.
    """
    held = {c: f"held_{i}_" for i, c in enumerate(docs.columns) if c not in OWN}
    return stage(docs.withColumnsRenamed(held)).select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = read_table(spark, sf_dir, "labels").filter(~quality.held_out())
    return _beside(docs, lambda d: quality.score(spark, d, quality.train(spark, d, labels)).filter("predicted = 1"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go from all of them; a document whose lines all go stays, empty."""
    return _beside(docs, lambda d: dedup_lines(spark, d).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents that with the smallest id stays.

    Where rows share an id or have none, rows are judged by their places in the table
    instead: of linked rows the first stays, and rows without words stay all."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").take(1):
        held = {c: f"held_{i}_" for i, c in enumerate(docs.columns)}
        rows = Workspace(spark, "rows").keep(docs.withColumnsRenamed(held).withColumn("row_", F.monotonically_increasing_id()), "rows")
        names = {v: k for k, v in held.items()}
        stay = jaccard_components(spark, rows, "row_", held["text"]).filter("doc_id = component_id").select(F.col("doc_id").alias("row_"))
        return rows.join(stay, "row_", "left_semi").drop("row_").withColumnsRenamed(names)
    stay = jaccard_components(spark, docs).filter("doc_id = component_id").select("doc_id")
    return docs.join(stay, "doc_id", "left_semi").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of a benchmark item stands go, however long they are."""
    return _beside(docs, lambda d: decontaminate(spark, d, read_table(spark, sf_dir, "benchmark")).filter("n_hit = 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_common_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = Workspace(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.keep(docs, f"stage-{i}")
    return docs
