"""A training-data pipeline: language, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``, whatever else they are called: further columns are kept, too. Texts
are worked on whole, however long; an empty table leaves every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm import bpe, decontaminate, jaccard, langid
from sagitta.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language that the text is identified as; what stood there is only learned from. Documents without a language
    (null, or no letter at all) go; nothing else does, repeated rows and null ids included."""
    return langid.labeled(docs, langid.fit(docs, ~langid.held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five-word shingles and a similarity of 0.8 the document with the smallest id stays, once.

    Of rows with one id and different texts each group keeps its own. Null ids and texts without words link with nothing."""
    return jaccard.drop_near_duplicates(docs, width=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a test item (or all words of a shorter one) go, each row by itself;
    null texts and items hold nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), ngram=10, max_coverage=0.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language, token ids (little-endian 32-bit) and decoded text of each row that is left; a null text has none."""
    # the workers hold other stages' memory, too
    rows = bpe.encode_decode(docs, remembered=40_000, keep=False, others=("lang",))
    return rows.select("doc_id", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", remove_benchmark), ("bpe", encode)]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
