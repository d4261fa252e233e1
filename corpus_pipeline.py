"""A corpus pipeline out of the llm operators: each stage takes what its predecessor kept.

The stages filter by language and by quality, keep one document of each near-duplicate group (five-word shingles,
similarity 0.8 or more), take out passages that repeat across documents, and pack what is left into sequences. All but
the last return the columns of `documents`. A null doc_id or repeated rows are kept apart by their content: filters
judge each row, and of equal rows one stays in the near-duplicate stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm import common, language, packing, partenum, quality, repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No stage but the filters can be said in SQL, so the whole is tested against a brute-force version.
ORACLE_SQL = None


def of_documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in none of the learnt languages (null, or without a letter); a null lang becomes the language found."""
    seen = language.judged(docs, keep=COLUMNS)
    return of_documents(seen.filter("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on the labels of what is left, scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.judged(docs, labels, keep=COLUMNS)
    return of_documents(scored.filter("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of every component of near-duplicates."""
    return of_documents(partenum.one_of_each(docs, partenum.Threshold(80, 100, 5), keep=COLUMNS))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # a cut can leave part of a character: that part goes too
        at = batch.schema.names.index("text")
        texts = [x.decode("utf-8", "ignore") if x is not None else None for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every passage of 200 bytes or more that occurs again; documents of which nothing is left go."""
    cut = repeats.cut(docs, keep=("doc_id", "lang", "source"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = cut.select("doc_id", F.col("kept").alias("text"), "lang", "source").mapInArrow(_decoded, f"doc_id {kinds['doc_id']}, text string, lang {kinds['lang']}, source {kinds['source']}")
    out = out.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"]))
    return of_documents(out.filter(F.length(F.trim("text")) > 0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written as Parquet and read again. What a stage has staged for
    itself is removed as soon as its result is written, and that result when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(common.staged_paths())
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        common.clear_staged({*others, common.staged_paths()[-1]})
    return STAGES[-1][1](spark, docs, sf_dir)
