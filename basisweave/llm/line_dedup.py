"""Repeated-line removal, native: a range-partitioned line index and per-document keep bitmaps.

Lines become 96-bit hashes with their document and position. The hashes are range-partitioned together with a salt of the
document, so that a line that is everywhere spreads over many tasks, and sorted inside with document and position as
secondary keys. One stream over the sorted runs, without a further shuffle, numbers a run's documents and carries its
first occurrence along; a run's last row holds both, and only these rows meet again over the salts. Documents come back
with sparse 64-line keep bitmaps, never as text: words that keep all their lines are left out.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` are always kept; rows equal
in doc_id and text are one document, each still returned; a null doc_id is a document like any other; an empty table
gives no rows; extra columns are ignored by ``line_bitmaps`` and kept by ``drop_repeated_lines``, but for those that bear
the name of an output, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basisweave.llm.common import SPACES, lower_ascii, read_table, unused, written


#: Parts that a line's documents are dealt into.
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, partitions: int | None = None) -> DataFrame:
    """(h1, h2, salt, doc, txt, pos, n_docs, first) of every line with a long enough key, as a written, sorted table.

    ``n_docs`` and ``first`` stand in the last row of a run (h1, h2, salt) alone: its number of documents and its first
    occurrence. A document has one salt, so runs of the same hash never share one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc"), _text_id(text).alias("txt"), F.posexplode(F.transform(F.split(lower_ascii(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))).alias("pos", "key"))
    salt = F.pmod(F.xxhash64("doc", "txt"), F.lit(SALTS)).cast("int").alias("salt")
    hashed = keyed.where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), salt, "doc", "txt", "pos")
    # Written first: the range bounds are sampled from it without reading the texts again.
    occurrences = written(hashed, "lines")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run, inside = ["h1", "h2", "salt"], ["doc", "txt", "pos"]
    stream = Window.partitionBy(*run).orderBy(*inside)
    ranged = occurrences.repartitionByRange(n, *run).sortWithinPartitions(*run, *inside)
    numbered = ranged.select("*", F.dense_rank().over(stream.orderBy("doc", "txt")).alias("rank"), F.first(F.struct(*inside)).over(stream.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lead(F.lit(True)).over(stream).alias("more"))
    last = F.col("more").isNull()
    return written(numbered.select(*run, *inside, F.when(last, F.col("rank")).alias("n_docs"), F.when(last, F.col("head")).alias("first")), "line-index")


def line_stats(index: DataFrame) -> DataFrame:
    """Per hash: number of documents and first occurrence in document and position order, from the runs' last rows."""
    runs = index.where("n_docs is not null")
    return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, partitions: int | None = None) -> DataFrame:
    """Per document that loses lines: doc, txt and ``kept``, an array of (word, bits): bit i of word w is line 64w+i, 1 if it stays.

    Words that keep all their lines are left out. ``keep_first`` spares the first occurrence of each repeated line.
    """
    index = line_index(docs, id_col, text_col, min_chars, partitions)
    # Written, so that the join below stands right on its exchanges and a line that is everywhere can be split.
    hot = written(line_stats(index).where(F.col("n_docs") >= min_docs).withColumnRenamed("first", "head").drop("n_docs"), "repeated-lines")
    lost = index.select("h1", "h2", "doc", "txt", "pos").join(hot, ["h1", "h2"])
    if keep_first:
        lost = lost.where(~(F.struct("doc", "txt", "pos").eqNullSafe(F.col("head"))))
    bits = lost.groupBy("doc", "txt", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63)))).alias("bits"))
    return bits.groupBy("doc", "txt").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("kept"))


def is_kept(kept: Column, pos: Column) -> Column:
    """Whether the bitmap (as a map from word to bits) keeps this line."""
    return F.coalesce(F.getbit(F.element_at(kept, F.shiftright(pos, 6)), pos.bitwiseAND(63)) == 1, F.lit(True))


OUTPUTS = ("n_lines", "n_dropped", "kept_text")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (null where nothing is lost) added."""
    docs = docs.select(*(c for c in docs.columns if c not in OUTPUTS))
    doc, txt, kept = (unused(docs.columns, c) for c in ("doc", "txt", "kept"))
    maps = line_bitmaps(docs, id_col, text_col, **rule).select(F.col("doc").alias(doc), F.col("txt").alias(txt), F.col("kept").alias(kept))
    joined = docs.join(maps, docs[id_col].eqNullSafe(maps[doc]) & (_text_id(docs[text_col]) == maps[txt]), "left")
    lines = lines_of(F.col(text_col))
    left = F.filter(lines, lambda x, i: is_kept(F.map_from_entries(kept), i))
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.aggregate(kept, F.lit(0), lambda a, x: a + 64 - F.bit_count(x["bits"])), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col(kept).isNotNull(), F.array_join(left, "\n")))
        .drop(doc, txt, kept)
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", "text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, text, row, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.key = hot.key GROUP BY row, doc_id
"""
