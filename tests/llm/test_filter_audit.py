from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from basisweave.llm.filter_audit import OP13_SQL, audit, failures, labelled, op13_filter_audit

SPACES = " \t\n\x0b\x0c\r"


def fails(rows):
    """(part, set of failed filters, good, toxic) of each of rows (id, text, lang, good, toxic), one at a time."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, lang, good, toxic in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in SPACES else c for c in t).split(" ") if x]
        own = set()
        own |= {"A"} if len(w) < 100 else set()
        own |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        own |= {"D"} if set(t) & set("#$%&*|") else set()
        own |= {"E"} if i is not None and i > least[t] else set()
        yield lang or "", own, good, toxic


def brute(rows):
    docs = defaultdict(list)
    for part, *rest in fails(rows):
        docs[part].append(rest)
    out = []
    for part, own in docs.items():
        total, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = list(own)
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                steps.append([part, "".join(order), k, len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_query_against_brute_force(spark, small_tables):
    flags = {}
    for r in spark.read.parquet(f"{small_tables}/labels.parquet").collect():
        good, toxic = flags.get(r.doc_id, (False, False))
        flags[r.doc_id] = good or r.quality == 1, toxic or r.toxic == 1
    flags.pop(None)
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang, *flags.get(r.doc_id, (False, False))) for r in docs]
    got = op13_filter_audit(spark, small_tables).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_tables}/{t}.parquet/*.parquet'")
    assert sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall()) == brute(rows)


def test_copies_repeats_and_nulls(spark, make_docs):
    rows = [(5, "same"), (3, "same"), (3, "same"), (None, "same"), (9, "other"), (8, None), (7, ""), (2, "last one")]
    got = failures(make_docs(rows, id=1, mask=2, digest="x", is_first=True))
    assert sorted((str(r.id), r.mask >> 4) for r in got.collect()) == sorted((str(i), int(i in (5, 8))) for i, _ in rows)
    assert {(r.id, r.mask) for r in failures(make_docs([(1, "# a"), (2, "# a")]), copies=None, bits={"X": F.col("text").startswith("#")}).collect()} == {(1, 1), (2, 1)}


def test_general_filters_and_empty_tables(spark, tmp_path):
    masks = spark.createDataFrame([("p", m, m % 2 == 0, m == 3) for m in (0, 1, 2, 3, 3, 7, 4)] + [("clean", 0, True, False)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): r for r in audit(masks, "XYZ").collect()}
    assert len(got) == 2 * 6 * 3
    assert all(r.kept == 1 and r.removed == r.redundant == r.shapley == 0 for (p, _, _), r in got.items() if p == "clean")
    first = got["p", "YXZ", 1]
    assert (first.kept, first.removed, first.redundant, first.unique_fails) == (3, 4, 0, 1)
    # The three values share out what all filters remove.
    assert sum(got["p", "XYZ", k].shapley for k in (1, 2, 3)) == 6 * 6
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op13_filter_audit(spark, str(tmp_path)).count() == 0


def test_labels_said_twice(spark):
    masks = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (None, "a", 1)], "id long, part string, mask int")
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, labelled(masks, labels).collect())) == [("a", 1, False, False), ("a", 1, False, True), ("a", 1, True, False)]
