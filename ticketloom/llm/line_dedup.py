"""Line dedup (operator 10): repeated lines go, and what returns is a bitmap per document.

1. Every long enough line becomes two 64-bit hashes. The first is counted with partial sums before
   the shuffle; those found in enough rows stay candidates.
2. The lines with a candidate hash are dealt by range over (both hashes, document, position), sorted,
   and stored. A hot line spreads over many ranges, since the document
   is part of the range key.
3. The documents of a line key are counted, and the last one found, by hash aggregates over the stored
   rows: distinct (both hashes, document), with partial sums, then a count and a maximum per key. The
   shuffle has at most a row per key and document; the sorted order itself is not read.
4. Every occurrence outside the document that keeps the key is dropped. Dropped positions travel as
   64-bit words of a bitmap, only for the words that have a dropped line. No text is shuffled before
   the caller asks for it.

Defined cases: a null or empty text is one empty line; keys below ``min_chars`` code points stay;
rows that repeat a document's id count as one document, and the last id keeps all its lines; a null
id is a document of its own, lower than every other; empty tables give empty results. Only the two
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .common import SPACES, ascii_lower, free_names

MIN_CHARS = 20
MIN_DOCUMENTS = 3
WORD_BITS = 64


def line_identity(line: Column) -> Column:
    """Equal for two trimmed lines exactly if they are equal after lower-casing A-Z.

    ``lower`` is far cheaper than a translation of 26 letters, but folds other letters as well, so the
    other letters follow after a line feed, which no line holds. Two letters fold into ASCII; lines
    with them are translated.
    """
    plain = F.octet_length(line) == F.char_length(line)
    into_ascii = F.contains(line, F.lit("\u0130")) | F.contains(line, F.lit("\u212a"))
    marked = F.concat(F.lower(line), F.lit("\n"), F.regexp_replace(line, "[\\x00-\\x7F]+", " "))
    return F.when(plain, F.lower(line)).when(into_ascii, ascii_lower(line)).otherwise(marked)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_hash(key: str, text: str) -> Column:
    """Tells apart rows that share a document id; equal rows share it, and are treated alike."""
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def _lines(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    rows = df.select(F.col(key).alias("doc"), row_hash(key, text).alias("row"),
                     F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    trimmed = rows.filter(F.octet_length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(SPACES)))
    keyed = trimmed.filter(F.char_length("line") >= min_chars).withColumn("line", line_identity(F.col("line")))
    return keyed.select("doc", "row", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def dropped_lines(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS,
                  min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc, row, pos) of every line that goes; ``row`` is ``row_hash`` of the row it stands in."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _lines(df, key, text, min_chars)
    # Stored, so that the join has two plain sides: Spark broadcasts a small one and splits hot keys.
    often = stored(lines.groupBy("h").agg(F.count(F.lit(1)).alias("_rows"))
                   .filter(F.col("_rows") >= min_documents).select("h"), "line-hashes")
    candidates = lines.join(often, "h", "left_semi")
    order = ["h", "h2", "doc", "row", "pos"]
    runs = stored(candidates.repartitionByRange(partitions, *order).sortWithinPartitions(*order), "line-runs")
    per_document = runs.select("h", "h2", "doc").distinct()
    keeper = stored(per_document.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("doc").alias("_keeper")).filter(
        F.col("_docs") >= min_documents).select("h", "h2", "_keeper"), "line-keepers")
    return runs.join(keeper, ["h", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("_keeper"))).select("doc", "row", "pos")


def keep_bitmaps(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS,
                 min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The compressed keep bitmap of each document that loses a line.

    ``words`` holds (index, bits) in order of index: bit b of word w is 1 if line 64 * w + b stays.
    Words that are not listed are all ones.
    """
    dropped = dropped_lines(df, key, text, min_chars, min_documents)
    word = F.floor(F.col("pos") / WORD_BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % WORD_BITS)
    words = dropped.groupBy("doc", "row", word.alias("index")).agg(F.bit_or(bit).alias("_gone"))
    return words.groupBy("doc", "row").agg(
        F.sort_array(F.collect_list(F.struct("index", F.bitwise_not("_gone").alias("bits")))).alias("words"))


def _dropped_positions(words: Column) -> Column:
    bits = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    in_word = lambda w: F.filter(
        F.transform(bits, lambda b: F.when(F.getbit(w.bits, b) == 0, w.index * WORD_BITS + b)), lambda p: p.isNotNull())
    return F.coalesce(F.flatten(F.transform(words, in_word)), F.array().cast("array<int>"))


def apply_bitmaps(df: DataFrame, key: str, text: str, bitmaps: DataFrame) -> DataFrame:
    """``df`` with the lines its bitmaps keep, the line count before, and the number dropped, in
    ``kept_text``, ``n_lines`` and ``n_dropped``, which replace columns of these names. A document that keeps everything
    keeps its text, null included. Other columns pass through, whatever their names."""
    doc, row, words, gone, lines = free_names(df, "doc", "row", "words", "gone", "lines")
    marks = bitmaps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("words").alias(words))
    joined = df.join(marks.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(doc)) & (row_hash(key, text) == F.col(row)), "left")
    placed = joined.withColumn(gone, F.when(F.col(words).isNotNull(), _dropped_positions(F.col(words))))
    all_lines = lines_of(F.col(text))
    n_lines = F.size(all_lines)
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(gone))
    source = placed.withColumn(lines, F.when(F.col(gone).isNotNull(), all_lines))
    shorter = F.array_join(F.transform(kept, lambda p: F.get(F.col(lines), p)), "\n")
    names = [F.col(f"`{c}`") for c in df.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    return source.select(
        *names, F.when(F.col(gone).isNull(), F.col(text)).otherwise(shorter).alias("kept_text"),
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped"))


def deduplicate(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS,
                min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Bitmaps found, stored, and applied to the same table."""
    bitmaps = stored(keep_bitmaps(df, key, text, min_chars, min_documents), "keep-bitmaps")
    return apply_bitmaps(df, key, text, bitmaps)
