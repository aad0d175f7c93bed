"""From raw documents to training pieces: five stages, each on all its predecessor kept.

Toxic documents go; repeated runs of lines are deleted from the later documents; of a group of near
copies (five-word shingles, Jaccard 0.8) the smallest doc_id stays; sources are interleaved to their target weights; texts are
encoded to pieces. All stages but the last return the columns of documents, n_chars counted anew.
The order of rows ends with a stored table, so the last stage lays out the schedule of its rows again and returns it as slot,
block and place_in_block: rows sorted by slot and place_in_block are the mix, and every stretch of slots has the target shares.
Empty texts and rows without doc_id pass every stage; equal doc_ids are one document for the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import LEAN, Store, table
from folioflow.llm.jaccard_join import JoinOptions, jaccard_components
from folioflow.llm.line_dedup import dedup_lines
from folioflow.llm.mixing import mix
from folioflow.llm.piece_transducer import encode_pieces
from folioflow.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score_toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_components(docs.select("doc_id", "text"), JoinOptions(words=5, percent=80))
    stay = groups.filter("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(stay.hint("merge"), "doc_id").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(mix(docs).select(*COLUMNS, "slot", "block", "place_in_block"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard),
          ("mixing to target weights", mixing), ("SentencePiece", pieces)]

#: The first stage learns a classifier, so no SQL states the rows; tests/llm compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark, "pipeline", LEAN), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
