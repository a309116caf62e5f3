"""A training corpus in five stages: each takes ``(spark, docs, sf_dir)`` and is written before the next.

1. language: documents without a language (no letters), or between two, go.
2. near_duplicates: of each group linked by near-duplicate texts the smallest id stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. pii: personal data is replaced by its kind in brackets; n_chars follows the new text.
5. packing: what is left becomes token sequences, one row per piece.

All but the last return the columns they got.  Stage 2: a row with a null id takes no part and stays; of
rows that repeat an id and a text one stays; rows of one id with different texts stay or go together.
Stage 3 decides row by row, whatever the ids.  How stage 5 cuts and groups pieces follows the partitions of
its input; which ids a document's pieces hold does not.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antiphon.llm import decontaminate, langid, neardup, packing, pii
from antiphon.llm.common import free_name, materialise, small_batches, table, without_ids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    name = free_name(docs, "language_found")
    out = langid.with_language(docs, as_col=name)
    return out.filter((F.col(f"{name}.lang") != langid.UNDETERMINED) & ~F.col(f"{name}.ambiguous")).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.groups(docs)
    kept = without_ids(docs, found.filter("not kept").select("doc_id"), "doc_id")
    again = materialise(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if not again.limit(1).count():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = free_name(docs, "row_key")  # of the text alone: equal texts share their fate
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("binary"))))
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return without_ids(keyed, found.filter(F.size("spans") > 0).select(key), key).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("length", (F.octet_length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]

#: No stage but decontamination can be put into SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
