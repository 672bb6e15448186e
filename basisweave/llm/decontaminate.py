"""Benchmark decontamination through a distributed positional inverted index.

The benchmark is cut into windows of consecutive words. One pass over the documents counts how often each benchmark
term occurs; each window is then known by its rarest terms. A second pass writes the index: per document, postings
(position, term) of the benchmark terms that lie within reach of a rarest term, since only there can a window occur.
The index is a written table and is searched with joins: the offset-adjusted postings of a window's two rarest terms
meet on (document, start), what is left fetches its other terms' postings, and a start with all terms is an
occurrence. Proximity matches allow the terms in any order within a slop.

The benchmark's windows and terms go to the tasks as a broadcast, about ``block_windows`` windows at a time; a larger
benchmark is searched block by block, so nothing broadcast grows with either table.

A proximity match is a stretch of a window's length and ``slop`` more words that holds all the window's words, each as
often as the window does, in any order. The index then reaches ``slop`` words further; documents in which a window's two
rarest different terms lie near each other are looked at, window by window, in their own postings.

Defined cases: null and empty texts have no words, hits or windows; a null id is an id like any other; equal
documents are searched each for itself; equal benchmark rows count once each by item id; an empty table on either
side gives documents without hits, or no rows; extra columns are ignored. Very long texts are indexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basisweave.llm.common import read_table, written

#: ASCII other than letters and digits becomes a space, A-Z becomes a-z; bytes from 0x80 on are parts of words.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The words of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(window, item, len, offset, term): a row per window and word; fewer words than ``width`` are one window.

    Windows with the same words share their id, so that a phrase is searched once however many items have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (w := terms(t))]
            rows = [(i, [x.decode("utf-8", "surrogatepass") for x in w[s : s + width]]) for i, w in found for s in range(max(1, len(w) - width + 1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["item", "words"])

    schema = T.StructType([T.StructField("item", items.schema[id_col].dataType), T.StructField("words", T.ArrayType(T.StringType()))])
    return items.select(id_col, text_col).mapInArrow(run, schema)


def term_counts(docs: DataFrame, vocabulary, text_col: str = "text") -> DataFrame:
    """(term id, n): occurrences of each broadcast term, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary.value
        n = np.zeros(len(ids) + 1, np.int64)
        look = ids.get
        for b in batches:
            for t in b.column(0).to_pylist():
                if w := terms(t):
                    got = np.fromiter((look(x, -1) for x in w), np.int32, len(w))
                    n += np.bincount(got + 1, minlength=len(n))
        at = np.flatnonzero(n[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[1:][at])], names=["term", "n"])

    return docs.select(text_col).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, vocabulary, anchors, reach: int, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by n_words and postings: the benchmark terms within ``reach`` words of an anchor."""
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.IntegerType()))])
    flat = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, is_anchor = vocabulary.value.get, anchors.value
        for b in batches:
            n, positions, found = [], [], []
            for t in b.column(text_col).to_pylist():
                w = terms(t)
                got = np.fromiter((look(x, -1) for x in w), np.int32, len(w))
                near = np.zeros(len(w) + 1, np.int64)
                at = np.flatnonzero(is_anchor[got])  # the last flag, for -1, is False
                np.add.at(near, np.maximum(at - reach, 0), 1)
                np.add.at(near, np.minimum(at + reach + 1, len(w)), -1)
                at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (got >= 0)).astype(np.int32)
                n.append(len(w))
                positions.append(at)
                found.append(got[at])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), flat(positions), flat(found)], names=[*keep, "n_words", "positions", "terms"])

    return docs.mapInArrow(run, schema)


def phrase_occurrences(postings: DataFrame, parts: DataFrame, n_rare: int = 2) -> DataFrame:
    """(rid, window, start, len) of every exact occurrence.

    ``postings``: (rid, pos, term); ``parts``: (window, len, offset, term, rank), rank 1 for a window's rarest term.
    """
    lists = lambda r: postings.join(F.broadcast(parts.where(F.col("rank") == r).select("window", "len", "offset", "term")), "term").select("rid", "window", "len", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    candidates = lists(1)
    for r in range(2, n_rare + 1):
        short = parts.groupBy("window").agg(F.max("rank").alias("ranks"))
        met = candidates.join(lists(r).select("rid", "window", "start", F.lit(True).alias("met")), ["rid", "window", "start"], "left").join(F.broadcast(short), "window")
        candidates = met.where(F.col("met") | (F.col("ranks") < r)).select("rid", "window", "len", "start")
    rest = parts.where(F.col("rank") > n_rare).groupBy("window").agg(F.collect_list(F.struct("offset", "term")).alias("rest"))
    wanted = candidates.join(F.broadcast(rest), "window", "left").select("rid", "window", "len", "start", F.explode_outer("rest").alias("p")).select("rid", "window", "len", "start", (F.col("start") + F.col("p.offset")).alias("pos"), F.col("p.term").alias("term"))
    held = wanted.join(postings.withColumn("held", F.lit(1)), ["rid", "pos", "term"], "left")
    return held.groupBy("rid", "window", "len", "start").agg(F.count("term").alias("n"), F.count("held").alias("h")).where("n = h").select("rid", "window", "start", "len")


def near_stretch(at: dict[int, np.ndarray], need: dict[int, int], span: int) -> bool:
    """Whether ``span`` consecutive words hold each needed term as often as needed; ``at``: each term's sorted positions."""
    if any(len(at.get(t, ())) < n for t, n in need.items()):
        return False
    pos = np.concatenate([at[t] for t in need])
    of = np.repeat(list(need), [len(at[t]) for t in need])
    order = np.argsort(pos, kind="stable")
    pos, of, missing, lo, held = pos[order].tolist(), of[order].tolist(), len(need), 0, dict.fromkeys(need, 0)
    for p, t in zip(pos, of):
        held[t] += 1
        missing -= held[t] == need[t]
        while p - pos[lo] >= span:
            missing += held[of[lo]] == need[of[lo]]
            held[of[lo]] -= 1
            lo += 1
        if not missing:
            return True
    return False


def proximity_matches(index: DataFrame, parts: DataFrame, slop: int) -> DataFrame:
    """(rid, window) of every proximity match in ``index`` (rid, positions, terms), built with a reach of slop more words."""
    spark = index.sparkSession
    needs: dict[int, tuple[int, dict[int, int]]] = {}
    for r in parts.groupBy("window", "term").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len")).toArrow().to_pylist():  # bounded by the block of windows
        needs.setdefault(r["window"], (r["len"] + slop, {}))[1][r["term"]] = r["n"]
    shipped = spark.sparkContext.broadcast(needs)
    postings = index.select("rid", F.explode(F.arrays_zip("positions", "terms")).alias("p")).select("rid", F.col("p.positions").alias("pos"), F.col("p.terms").alias("term"))
    kinds = parts.groupBy("window", "term").agg(F.min("rank").alias("rank"), F.max("len").alias("len")).withColumn("k", F.row_number().over(Window.partitionBy("window").orderBy("rank")))
    met = lambda k: postings.join(F.broadcast(kinds.where(F.col("k") == k).select("window", "len", "term")), "term").select("rid", "window", F.floor(F.col("pos") / (F.col("len") + slop)).alias("cell"))
    first, second = met(1).distinct(), met(2).select("rid", "window", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")).distinct()
    single = kinds.groupBy("window").agg(F.max("k").alias("k")).where("k = 1").select("window")
    near = first.join(second, ["rid", "window", "cell"]).select("rid", "window").unionByName(first.join(F.broadcast(single), "window").select("rid", "window")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needs = shipped.value
        for b in batches:
            rids, found = [], []
            for rid, wanted, pos, of in zip(b.column("rid").to_pylist(), b.column("windows").to_pylist(), b.column("positions"), b.column("terms")):
                pos, of = pos.values.to_numpy(), of.values.to_numpy()
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order])) + 1
                at = {int(of[g[0]]): pos[g] for g in np.split(order, cuts)} if len(of) else {}
                for w in wanted:
                    span, need = needs[w]
                    if near_stretch(at, need, span):
                        rids.append(rid)
                        found.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(found, pa.int64())], names=["rid", "window"])

    wanted = near.groupBy("rid").agg(F.collect_set("window").alias("windows"))
    return wanted.join(index.select("rid", "positions", "terms"), "rid").select("rid", "windows", "positions", "terms").mapInArrow(verify, "rid long, window long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = 10, n_rare: int = 2, block_windows: int = 200_000, slop: int | None = None) -> DataFrame:
    """(rid, id, n_words, n_hit, items) per row of ``docs``: words inside benchmark windows, and the sorted items that have one.

    With a ``slop`` also near_items, the sorted items with a proximity match.
    """
    spark = docs.sparkSession
    cut = written(windows(items, item_col, "text", width).withColumn("window", F.xxhash64("words")), "benchmark-windows")
    exploded = cut.select("window", F.posexplode("words").alias("offset", "term")).distinct()
    n_blocks = max(1, -(-cut.select(F.count_distinct("window")).first()[0] // block_windows))
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if n_blocks > 1:  # row ids that several passes agree on
        keyed = written(keyed, "numbered")
    hits, near, sizes = [], [], None
    for k in range(n_blocks):
        own = exploded if n_blocks == 1 else exploded.where(F.pmod("window", F.lit(n_blocks)) == k)
        names = [r[0] for r in own.select("term").distinct().collect()]  # at most the width times the block's windows
        vocabulary = spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(names)})
        ids = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string()), "term_id": pa.array(range(len(names)), pa.int32())}))
        counts = term_counts(keyed, vocabulary)
        by_rarity = Window.partitionBy("window").orderBy("n", "term", "offset")
        parts = own.withColumnRenamed("term", "name").join(ids, "name").withColumnRenamed("term_id", "term").join(counts, "term", "left").fillna(0, ["n"]).withColumn("rank", F.row_number().over(by_rarity))
        parts = written(parts.withColumn("len", F.max("offset").over(Window.partitionBy("window")) + 1).select("window", "len", "offset", "term", "rank"), "benchmark-parts")
        flags = np.zeros(len(names) + 1, bool)
        flags[[r[0] for r in parts.where("rank = 1").select("term").distinct().collect()]] = True
        index = written(build_index(keyed, vocabulary, spark.sparkContext.broadcast(flags), width - 1 + (slop or 0)), "postings")
        postings = index.select("rid", F.explode(F.arrays_zip("positions", "terms")).alias("p")).select("rid", F.col("p.positions").alias("pos"), F.col("p.terms").alias("term"))
        hits.append(written(phrase_occurrences(postings, parts, n_rare), "occurrences"))
        if slop is not None:
            near.append(written(proximity_matches(index, parts, slop), "near-windows"))
        sizes = index.select("rid", "id", "n_words") if sizes is None else sizes
    found = reduce(DataFrame.unionByName, hits)
    before = Window.partitionBy("rid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    fresh = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))))
    covered = fresh.groupBy("rid").agg(F.sum("fresh").cast("long").alias("n_hit"))
    owners = cut.select("window", F.col("item").cast("string").alias("item")).distinct()
    none = F.array().cast("array<string>")
    items = lambda rows, name: rows.select("rid", "window").distinct().join(owners, "window").select("rid", "item").distinct().groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias(name))
    out = sizes.join(covered, "rid", "left").join(items(found, "items"), "rid", "left")
    columns = ["rid", "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items")]
    if slop is not None:
        out = out.join(items(reduce(DataFrame.unionByName, near), "near_items"), "rid", "left")
        columns.append(F.coalesce("near_items", none).alias("near_items"))
    return out.select(*columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), slop=4)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items")
    )


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, list_slice(w, s, s + 9) AS words, array_to_string(list_slice(w, s, s + 9), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, pos.n AS n FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
dwp AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM dw),
freq AS (SELECT word, count(*) AS c FROM dwp GROUP BY word),
need AS MATERIALIZED (SELECT g, n, word, count(*) AS k FROM (SELECT g, n, unnest(words) AS word FROM (SELECT DISTINCT g, n, words FROM win)) GROUP BY ALL),
rare AS (SELECT g, n, arg_min(word, (coalesce(c, 0), word)) AS word FROM need LEFT JOIN freq USING (word) GROUP BY g, n),
anchor AS MATERIALIZED (SELECT doc_id, g, n, pos AS apos FROM rare JOIN dwp USING (word)),
kinds AS (SELECT g, n, count(*) AS kinds FROM need GROUP BY g, n),
full_anchor AS (SELECT doc_id, g, n, apos FROM anchor JOIN kinds USING (g, n) JOIN need USING (g, n) JOIN dwp p USING (doc_id, word) WHERE p.pos > apos - n - 4 AND p.pos < apos + n + 4
  GROUP BY doc_id, g, n, apos HAVING count(DISTINCT word) = any_value(kinds)),
stretch AS (SELECT doc_id, g, n, unnest(range(apos - n - 3, apos + 1)) AS s FROM full_anchor),
near AS (SELECT DISTINCT doc_id, g, n FROM (
  SELECT doc_id, g, n, s, word, least(count(*), any_value(k)) AS held FROM (SELECT DISTINCT doc_id, g, n, s FROM stretch) JOIN need USING (g, n) JOIN dwp p USING (doc_id, word)
  WHERE p.pos >= s AND p.pos < s + n + 4 GROUP BY doc_id, g, n, s, word) GROUP BY doc_id, g, n, s HAVING sum(held) = n),
near_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN win USING (g, n) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""
