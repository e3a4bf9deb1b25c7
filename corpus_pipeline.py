"""A training-data pipeline of five stages over `documents`: classify, drop lines, drop near copies, hide personal data, pack.

Each stage takes the documents that the one before kept, as (spark, docs, sf_dir), and its result is written as
Parquet and read again for the next. All stages but the last return the columns of `documents`, n_chars being
the length of the text as it is then; any further columns of `docs`, whatever their names, are left out. An empty
table gives an empty table in each stage. Texts of any length are taken whole; the operators say what memory they need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import stored, table, tokenizer_path
from presswork.llm.op3_lines import drop_lines
from presswork.llm.op5_packing import pack_documents
from presswork.llm.op6_quality import held_out, score, train
from presswork.llm.op7_jaccard import jaccard_components
from presswork.llm.op9_pii import pseudonymise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more, ties included.

    A null or empty text is scored as one empty line, and stays a null or empty text if it is kept. Rows that repeat
    score alike, so all or none of them stay. Without any label all stay.
    """
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return score(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document (or line) has; one that has no text left by that goes.

    A null text comes back empty, and empty texts stay, since they lose nothing. A null doc_id is the latest. Rows that
    repeat doc_id and text lose the same lines, but none by each other; near_copies leaves one of them.
    """
    out = drop_lines(docs.select(*COLUMNS))
    return _counted(out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: of the smallest doc_id (null is the largest), and there of the smallest hash of the text.

    Rows that repeat doc_id and text are one, the one of the least other columns. Rows of one doc_id with other texts are
    documents of their own. Null and empty texts link with nothing, so each doc_id keeps one of either.
    """
    # A long's bits with the sign turned, in hexadecimal, sort as the long does.
    id_ = F.coalesce(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("null"))
    keyed = docs.select(*COLUMNS).withColumn("key", F.concat(id_, F.coalesce(F.md5("text"), F.lit(""))))
    component = jaccard_components(keyed, id_column="key").where("key = component_id").select("key")
    rows = keyed.groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return rows.join(component, "key", "left_semi").select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and secrets. A null text stays null; repeated rows are changed alike."""
    return _counted(pseudonymise(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    A null or empty text is a piece of one token, the end. Repeated rows, and rows without a doc_id, each have their pieces.
    """
    out = pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("private", private),
    ("packing", packing),
]

#: A chain of line labels, edit distances and keyed permutations are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
