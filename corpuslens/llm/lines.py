"""Line dedup by range-partitioned line hashes and per-document keep bitmaps.

Hashes of lines are dealt by range with document and text. A hash aggregate finds
a line's first place in each document; the sort asked for below it never runs, as
the optimizer removes it. The first occurrence of a line and its number of
documents come from a partial aggregation, and a line so common that it spans
partitions leaves one partial row in each. Only the decisions go
back, as bitmaps of 64 lines a word; texts meet them in one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import SPACES, ascii_lower, partitions, text_of, word_count
from corpuslens.sources.store import write_table

WORD_BITS = 64


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1,
                min_words: int = 0) -> DataFrame:
    """(_id, _text, _pos, _h1, _h2) per line that has a key of at least ``min_chars`` code points and ``min_words`` words.

    ``_text`` is a hash of the text: rows of a repeated id with other texts are other documents, equal rows are one.
    Two hashes with different seeds identify a key.
    """
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"),
                        F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("_pos", "_line"))
    key = keyed.withColumn("_line", F.trim(F.col("_line"), F.lit(SPACES)))
    key = key.filter(F.length("_line") >= min_chars)
    if min_words:
        key = key.filter(word_count(F.col("_line")) >= min_words)
    return (key
            .select("_id", "_text", "_pos", F.xxhash64("_line").alias("_h1"),
                    F.xxhash64(F.lit("line"), F.col("_line")).alias("_h2")))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(_h1, _h2, n_docs, _first) of keys found in at least ``min_docs`` documents; ``_first`` is the first place."""
    n = partitions(lines.sparkSession)
    ordered = (lines.repartitionByRange(n, "_h1", "_h2", "_id", "_text")
               .sortWithinPartitions("_h1", "_h2", "_id", "_text", "_pos"))
    in_document = ordered.groupBy("_h1", "_h2", "_id", "_text").agg(F.min("_pos").alias("_pos"))
    return (in_document.groupBy("_h1", "_h2")
            .agg(F.count("*").alias("n_docs"), F.min(F.struct("_id", "_text", "_pos")).alias("_first"))
            .filter(F.col("n_docs") >= min_docs))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2,
                 min_chars: int = 1, keep_first: bool = True, min_words: int = 0) -> DataFrame:
    """(_id, _text, keep) per document that loses a line; others keep all and have no row.

    ``keep`` is a sparse bitmap: entries (word, bits) for every 64 lines with a dropped line, bit ``pos % 64`` set
    for a line that stays; words without an entry are all ones. With ``keep_first`` the first occurrence (by id,
    then position) of a repeated line stays; otherwise all its lines go.
    """
    lines = write_table(line_hashes(docs, id_col, text_col, min_chars, min_words), "line-hashes")
    # written, so that the join below reads it as it is and can deal out a very common line
    repeated = write_table(repeated_lines(lines, min_docs), "repeated-lines")
    gone = lines.join(repeated, ["_h1", "_h2"])
    if keep_first:
        gone = gone.filter(~F.col("_first").eqNullSafe(F.struct("_id", "_text", "_pos")))
    word = F.floor(F.col("_pos") / WORD_BITS).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(_pos % {WORD_BITS} as int))")
    return (gone.repartition("_id", "_text")
            .groupBy("_id", "_text", word.alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
            .groupBy("_id", "_text").agg(F.collect_list(F.struct("word", "bits")).alias("keep")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2,
               min_chars: int = 1, keep_first: bool = True, min_words: int = 0) -> DataFrame:
    """``docs`` with repeated lines removed from the text, plus n_lines and n_dropped.

    A line's key is the line without white space at its ends and with A-Z lower-cased. A null or empty text is one
    empty line, which has no key and stays; a null text comes back empty. Other columns pass through; columns named
    n_lines or n_dropped are replaced. A table without rows gives none.
    """
    maps = (keep_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first, min_words)
            .select(F.col("_id").alias("_doc"), F.col("_text").alias("_hash"), "keep"))
    base = docs.drop("n_lines", "n_dropped")
    kept = [c for c in base.columns]
    row = base.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                      text_of(f"`{text_col}`").alias("_t"))
    met = row.withColumn("_x", F.xxhash64("_t")).join(
        maps, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_x") == F.col("_hash")), "left")
    lines = met.withColumn("_lines", F.split("_t", "\n", -1))
    dense = F.expr(f"transform(sequence(0, (size(_lines) - 1) div {WORD_BITS}), "
                   "w -> coalesce(map_from_entries(keep)[cast(w as int)], -1L))")
    left = F.expr(f"filter(_lines, (x, i) -> "
                  f"(shiftright(_bits[cast(i div {WORD_BITS} as int)], i % {WORD_BITS}) & 1L) = 1L)")
    out = (lines.withColumn("_bits", F.when(F.col("keep").isNotNull(), dense))
           .withColumn("_left", F.when(F.col("keep").isNotNull(), left).otherwise(F.col("_lines"))))
    text = F.array_join("_left", "\n")
    return out.select(
        *[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in kept],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_left")).cast("long").alias("n_dropped"))
