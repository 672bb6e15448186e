"""Filter interaction audit: what a chain of filters removes in every order, and what each filter is worth.

Each document becomes one bit mask of the filters it fails, and each part of the corpus 32 counts by mask: all that is
asked follows from those. The removal game of a part gives a coalition of filters the number of documents that fail any
of them. Its Hart-Mas-Colell potential is computed recursively over the coalitions, smaller ones first; a filter's
Shapley value is the potential of all filters less the potential without that one. What a step of an order removes
is the difference of two coalitions' values.

The potential is held times the factorial of the coalition's size, which keeps it whole: with Q(S) = |S|! P(S),
Q(S) = (|S| - 1)! v(S) + the sum of Q(S without i). All orders' removals of i together are then Q(all) - |all| Q(all without i).

Copies are found by the texts' SHA-256: the smallest id of each text is aggregated before the shuffle, and a row meets it
by text and id together, so a text that a third of all rows share is no hot key.

Defined cases: a null text is empty (and so a copy of any smaller id's empty or null text); a null part is the empty string;
a null id has no label and is no copy, nor is anything a copy of it; a row that repeats an id and its text is no copy
by that; a document is good (toxic) if any of its label rows says so; an empty table has no parts; a part whose
filters remove nothing has all its rows, with zeros; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisweave.llm.common import read_table, words, written

FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (null: empty) fails the length, variety, capitals and symbol filters."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    n = F.size(w)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {"A": n < 100, "B": 100 * F.size(F.array_distinct(w)) < 80 * n, "C": 100 * capitals > 10 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", bits: dict[str, Column] | None = None, copies: str | None = "E") -> DataFrame:
    """(id, part, mask): bit k of the mask is set where the document fails the k-th filter of ``bits``; ``copies`` names the filter
    after those, which copies of a smaller id's text fail. One pass over the texts, written once."""
    bits = text_failures(F.col(text_col)) if bits is None else bits
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(bits.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    if copies is None:
        return rows.drop("digest")
    rows = written(rows, "audit-masks")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    met = rows.join(first, ["digest", "id"], "left")
    again = F.when(F.col("id").isNotNull() & F.col("is_first").isNull(), 1 << len(bits)).otherwise(0)
    return met.select("id", "part", (F.col("mask") + again).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", flags: dict[str, Column] | None = None) -> DataFrame:
    """``masks`` with a flag a label, true where any of the id's label rows says so."""
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1} if flags is None else flags
    said = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()))
    joined = masks.join(said.where(" or ".join(flags)), "id", "left")
    return joined.select("part", "mask", *(F.coalesce(n, F.lit(False)).alias(n) for n in flags))


def _values(game: str, n: int) -> Column:
    """v(S) of each coalition S, by its bits: the documents of ``game`` that fail any filter of S."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: F.aggregate(F.filter("held", lambda h: h["mask"].bitwiseAND(s) != 0), F.lit(0).cast("long"), lambda a, h: a + h[game]))


def _potentials(v: Column, n: int) -> Column:
    """|S|! times the potential of each coalition, smaller bit patterns first, so that a coalition's parts are there before it."""
    weight = F.array(*(F.lit(factorial(max(0, k - 1))).cast("long") for k in range(n + 1)))

    def grown(q: Column, s: Column) -> Column:
        parts = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(q, s.bitwiseXOR(F.lit(1 << i)))).otherwise(0) for i in range(n)]
        return F.concat(q, F.array(F.get(weight, F.bit_count(s)) * F.get(v, s) + sum(parts[1:], parts[0])))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.array(F.lit(0).cast("long")), grown)


def audit(masks: DataFrame, names: str = FILTERS, flags: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row per part, order of ``names`` and step: kept, removed, redundant, unique_fails, <flag>_lost, shapley.

    ``masks``: part, mask and the flags. ``shapley`` sums the filter's removals over all orders."""
    n = len(names)
    full = (1 << n) - 1
    counts = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), *(F.count_if(f).alias(f) for f in flags))
    # A part has at most 2^n masks.
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", *flags)).alias("held"), F.sum("docs").alias("total"))
    games = held.select("part", "total", *(_values(g, n).alias(f"v_{g}") for g in ("docs", *flags)))
    solved = games.withColumn("q", _potentials(F.col("v_docs"), n))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(names)))
    steps = solved.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    own, before = F.lit(0), F.lit(0)
    for k, name in enumerate(names):
        place = F.instr("filter_order", name)
        own = own + F.when(place == F.col("step"), 1 << k).otherwise(0)
        before = before + F.when(place < F.col("step"), 1 << k).otherwise(0)
    at = lambda game, s: F.get(F.col(game), s)
    placed = steps.withColumns({"own": own, "before": before})
    after = F.col("own") + F.col("before")
    removed = at("v_docs", after) - at("v_docs", F.col("before"))
    return placed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("v_docs", after)).alias("kept"),
        removed.alias("removed"),
        (at("v_docs", F.col("own")) - removed).alias("redundant"),
        (at("v_docs", F.lit(full)) - at("v_docs", full - F.col("own"))).alias("unique_fails"),
        *((at(f"v_{f}", after) - at(f"v_{f}", F.col("before"))).alias(f"{f}_lost") for f in flags),
        (at("q", F.lit(full)) - n * at("q", full - F.col("own"))).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failures(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return audit(labelled(masks, read_table(spark, sf_dir, "labels")))


#: The definition itself: every order's steps counted over the masks, without potentials.
OP13_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (SELECT min(doc_id) AS lead, text AS same FROM d GROUP BY text),
l AS (SELECT doc_id AS labelled, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > lead, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN m ON text = same LEFT JOIN l ON doc_id = labelled),
c AS (SELECT part, CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + 4 * CAST(c AS INTEGER) + 8 * CAST(d AS INTEGER) + 16 * CAST(e AS INTEGER) AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)),
o AS (SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
k AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) AS g(step)),
s AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s"""
