"""A training corpus from raw documents: five stages, each written and read again before the next.

1. Language identification; documents that it rejects go.
2. Near duplicates by 5-word shingles at a similarity of 0.8; the smallest id of each group stays.
3. Byte strings of 50 and more that an earlier document has are cut from the texts.
4. The sources are mixed to target weights; documents may leave or come twice.
5. What is left is encoded as token ids, and decoding them is checked.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. Null
texts are rejected by the first stage; the others take them as empty. Rows
without an id pass stages 2 and 3 untouched; rows that share an id are one
document there. Each stage starts from heaps without the garbage of the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_documents
from tessera.llm.jaccard import jaccard_components
from tessera.llm.language import fit_languages, identify
from tessera.llm.mixing import mix_documents
from tessera.llm.substrings import remove_repeats
from tessera.llm.text import small_batches
from tessera.sources.shared import cut, fresh_path, made, sweep, trim
from tessera.sources.tables import table

#: Ids of dropped documents up to this number are sent to the tasks (8 bytes each); beyond, they are joined.
SENT_IDS = 4_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a language's centroids, learned from their own labels."""
    trim(spark)
    small_batches(spark)
    model = fit_languages(docs.select("doc_id", "text", "lang"))
    return identify(docs, model).filter("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    trim(spark)
    small_batches(spark)
    before = made()
    found = jaccard_components(docs, n=5, percent=80)
    gone = cut(found.filter("component_id != doc_id").select("doc_id").distinct(), "pipeline-copies")
    sweep(spark, before, gone)
    return docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that documents with smaller ids have; bytes of a character cut in two go as well."""
    trim(spark)
    small_batches(spark)
    done = remove_repeats(docs, as_text=True).withColumn("text", F.col("kept"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    trim(spark)
    return mix_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the decoded text."""
    trim(spark)
    small_batches(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("bpe", bpe),
]

#: No SQL states these stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
