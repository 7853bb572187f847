"""From raw documents to token ids: language ID, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. :func:`run` writes each
stage's rows as Parquet in the shared folder and reads them as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import language_id
from evalweave.llm.common import columns, discard, free_name, table, written
from evalweave.llm.jaccard_join import distinct_documents
from evalweave.llm.mixing import mix_sources
from evalweave.llm.pieces import digests, encode_pieces
from evalweave.llm.registry import PIECE_BPE

#: Below this posterior a document's language counts as undecided.
LEAST_SCORE = 0.5
#: Near copies share this many of a hundred of their distinct shingles of WIDTH words; op3's 90 and 3 are that query's own contract.
PERCENT, WIDTH = 80, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents in a language that the model knows; those without letters or without a likely language go, null and empty texts with them."""
    lang, score = (free_name(c, docs.columns) for c in ("lang_pred", "score"))
    known = language_id.predict(docs, language_id.fit(docs), lang_name=lang, score_name=score)
    return known.where((F.col(lang) != "und") & (F.col(score) >= least_score)).select(*columns(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One document of each group of links stays, as :func:`evalweave.llm.jaccard_join.distinct_documents` says; documents that share an id but not a group all stay."""
    return distinct_documents(docs, percent=percent, width=width)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their size, each document repeated by its Poisson count, shuffled. A null source is one of its own; an empty table stays empty."""
    return mix_sources(docs, copy_name=free_name("copy", docs.columns), key_name=free_name("shuffle_key", docs.columns)).select(*columns(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and digests of the ids and of what they decode to; a null or empty text is its end id alone."""
    rows = encode_pieces(docs.select("doc_id", "source", "text"), PIECE_BPE, decoded_col="decoded")
    return rows.select("doc_id", "source", "ids", *digests(rows))


STAGES = [("language_id", identify_language), ("jaccard_join", drop_near_duplicates), ("mix_sources", mix), ("sentencepiece", encode)]

#: Encoding has no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
