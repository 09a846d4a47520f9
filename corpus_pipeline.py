"""A corpus pipeline of five stages, each an operator of ``tidemill.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import discard, materialize, table, text_of
from tidemill.llm.dedup import exact_dedup
from tidemill.llm.jaccard import one_of_each
from tidemill.llm.langid import accepted
from tidemill.llm.mixing import mix_order, mixed
from tidemill.llm.pieces import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language; those with a null, empty or letterless text go, and of mixed texts those that no language holds half of."""
    return accepted(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents with equal texts, the one with the largest id.

    A null text counts as empty.  Of null and other ids the others stay; rows
    that repeat the text and the id that stays are all kept.
    """
    dropped = exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("__dropped"), F.col("text_sha256").alias("__sha")).distinct()
    # by id and text: other rows of an id, or of no id, may be no copies
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col("__dropped")) & (F.sha2(text_of().cast("binary"), 256) == F.col("__sha")), "left_anti")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest id.

    One row of each component stays, even of several with one id; null ids
    stay only where all of the component are null.  Null and empty texts link
    with nothing, so they stay.
    """
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents into the order of the mix; none is lost, and null is a source like others."""
    return mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document and its place in the mix.

    Files don't keep the order of rows, and ``documents`` has no column for
    it, so the places, which depend on nothing but the rows, are taken here:
    (slot, slot_row) orders the mix.  Null and empty texts have no ids.
    """
    placed = mix_order(docs, columns=["text"]).select(F.struct("doc_id", "slot", "slot_row").alias("at"), "text")
    return encode_documents(placed, id_col="at").select("at.doc_id", "ids", "n_ids", "round_trip", "at.slot", "at.slot_row")


STAGES = [("language_id", language_id), ("exact_dedup", dedup_exact), ("jaccard_join", dedup_near), ("mix_sources", mix_sources), ("pieces", encode_pieces)]

#: Language ID, the order of the mix and the pieces have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            if k:
                discard(before)
    return docs
