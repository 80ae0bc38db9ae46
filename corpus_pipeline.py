"""The corpus pipeline: stages over the documents table, each written and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns the columns of documents; the last returns what training
reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm import lines, minhash, mixing, pieces, quality
from corpuslens.llm.common import documents, text_of
from corpuslens.sources.store import write_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.classify(docs).filter("kept").select(*docs.columns)


PASSAGE_WORDS = 50


def _without_lines(docs: DataFrame, **rule) -> DataFrame:
    """Of a line that ``rule`` finds repeated the first occurrence stays; ``n_chars`` follows the text."""
    kept = lines.drop_lines(docs, min_chars=1, keep_first=True, **rule)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of a line found in ten or more documents the first occurrence stays.

    Long lines found in fewer go after near-dedup, which reads them whole.
    """
    return _without_lines(docs, min_docs=10)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each group stays.

    Of a line of PASSAGE_WORDS words or more found in two or more of these the first occurrence stays: in this order
    the one that stays is never in a document that goes.
    """
    flags = minhash.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = flags.filter("NOT kept").select("doc_id")
    single = write_table(docs.join(gone, "doc_id", "left_anti").select(*docs.columns), "single-documents")
    return _without_lines(single, min_docs=2, min_words=PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: sources are repeated, at most twice as often as the largest, towards equal weights.

    The budget is the least that passes every source once, so that no document is lost.
    """
    return mixing.mix_documents(docs, target_entropy=0.97, max_repeats=2.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding of every row, with the score of the second-best segmentation."""
    coded = pieces.encode(docs.select("doc_id", "text"), pieces.Vocabulary.read(pieces.MODEL), k=2)
    return coded.select("doc_id", "ids", "n_pieces", "score", F.get("others", F.lit(0)).alias("second_score"),
                        "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_common_lines),
    ("minhash near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("sentencepiece encoding", encode_pieces),
]

#: Trained models and randomised order: SQL has no form for these stages. They are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{at}")
    return docs
