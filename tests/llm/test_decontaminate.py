import random
import re
from collections import Counter

from basisweave.llm.decontaminate import decontaminate, op4_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, width):
    w, hit, found = split(text), set(), set()
    for i, t in items:
        b = split(t)
        for s in range(max(1, len(b) - width + 1) if b else 0):
            win = b[s : s + width]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    vocab = ["a", "b", "Cé", "the", "x1", *(f"w{k}" for k in range(12))]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([0, 1, 2, 3, 4, 5, 9, 12, 12, 20])] + [(20, None), (3, "dup of three"), (30, "b b b b b b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for k in range(60):
        t = " ".join(rng.choices(vocab, k=rng.randint(0, 40)))
        if k % 3 == 0:
            t += "; " + (items[rng.randrange(len(items))][1] or "").upper() + ", " + t
        rows.append((k, t))
    rows += [(100, None), (101, ""), (5, rows[5][1]), (None, "b b b b b b b")]
    for blocks in (200_000, 15):
        got = decontaminate(make_docs(rows, rid=1, term="x"), bench, width=4, block_windows=blocks).collect()
        assert sorted((str(r.id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted((str(i), *brute(t, items, 4)) for i, t in rows)


def test_empty_sides(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate(make_docs([]), bench).count() == 0
    got = decontaminate(make_docs([(1, "one two three")]), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(3, 0, [])]


def brute_near(text, items, width, slop):
    """Items with a stretch of a window's words in any order, each as often as in the window."""
    w, found = split(text), set()
    for i, t in items:
        b = split(t)
        for s in range(max(1, len(b) - width + 1) if b else 0):
            need = Counter(b[s : s + width])
            span = min(len(b), width) + slop
            if any(not need - Counter(w[p : p + span]) for p in range(len(w))):
                found.add(str(i))
    return sorted(found)


def test_proximity_against_brute_force(spark, make_docs):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(14)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12])] + [(20, None), (30, "b b b"), (31, "b b b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, " ".join(rng.choices([*vocab, "other", "b", "c"], k=rng.randint(0, 60)))) for k in range(50)] + [(100, None), (101, ""), (102, "b other b c b"), (102, "b other b c b")]
    for blocks, slop in ((200_000, 0), (200_000, 2), (9, 3)):
        got = decontaminate(make_docs(rows), bench, width=4, block_windows=blocks, slop=slop).collect()
        assert sorted((str(r.id), r.near_items) for r in got) == sorted((str(i), brute_near(t, items, 4, slop)) for i, t in rows)
        assert all(set(r["items"]) <= set(r.near_items) for r in got)


def test_query_on_odd_rows(spark, small_tables):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, against brute force."""
    got = op4_decontamination(spark, small_tables).collect()
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{small_tables}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {tuple(b[s : s + 10]) for _, t in items if (b := split(t)) for s in range(max(1, len(b) - 9))}
    sizes = {len(x) for x in windows}
    want = []
    for r in docs:
        w, hit = split(r.text), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
        want.append((r.doc_id, len(w), len(hit)))
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got) == sorted(want)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_near_items >= r.n_items for r in got)
