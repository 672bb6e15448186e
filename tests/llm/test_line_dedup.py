import hashlib
import random
from collections import defaultdict

import duckdb

from basisweave.llm import line_dedup
from basisweave.llm.common import written
from basisweave.llm.line_dedup import drop_repeated_lines, line_bitmaps, op10_line_dedup

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, keep_first=False):
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(WS))
    seen = defaultdict(set)
    for d in docs:
        for line in d[1].split("\n"):
            if key(line):
                seen[key(line)].add(d)
    hot = {k for k, v in seen.items() if len(v) >= min_docs}
    return {d: [line for line in d[1].split("\n") if key(line) not in hot] for d in docs}


def collect(df):
    return {(r.doc_id, r.text or ""): (r.n_lines, r.n_dropped, r.kept_text if r.kept_text is not None else (r.text or "")) for r in df.collect()}


def test_against_brute_force(make_docs):
    rng = random.Random(1)
    lines = ["Common LINE", " common line\t", "É one", "é one", "", "x", *(f"own {k}" for k in range(30))]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "x\ncommon line"), (7, rows[7][1])]
    got = drop_repeated_lines(make_docs(rows, h1="clash", pos=3), min_docs=5)
    assert got.count() == len(rows) and {"h1", "pos"} <= set(got.columns)
    want = brute(rows, 5)
    for (i, t), (n, dropped, kept) in collect(got).items():
        lines_kept = want[(i, t)]
        assert n == t.count("\n") + 1 and dropped == n - len(lines_kept) and kept == "\n".join(lines_kept)


def test_keep_first_leaves_one_occurrence(make_docs):
    rows = [(k, f"same line\nown {k}") for k in range(12)]
    got = collect(drop_repeated_lines(make_docs(rows), min_docs=10, keep_first=True))
    assert sum("same line" in kept for _, _, kept in got.values()) == 1
    assert "same line" in got[(0, rows[0][1])][2]


def test_bitmap_words_and_long_text(make_docs):
    text = "\n".join(f"l{k % 70}" for k in range(5000))
    rows = [(k, text) for k in range(3)]
    maps = line_bitmaps(make_docs(rows), min_docs=3).collect()
    assert len(maps) == 3 and all(len(m.kept) == -(-5000 // 64) for m in maps)
    got = collect(drop_repeated_lines(make_docs(rows), min_docs=3))
    assert all(v == (5000, 5000, "") for v in got.values())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_empty_table(make_docs):
    assert drop_repeated_lines(make_docs([]), min_docs=2).count() == 0


def test_runs_are_streamed_without_another_shuffle(make_docs, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), written(df, name))[1])
    line_dedup.line_index(make_docs([(1, "a\nb"), (2, "a")]))
    plan = dict(plans)["line-index"]
    assert plan.count("Exchange") == 1 and "rangepartitioning(h1" in plan


def test_clashing_columns(make_docs):
    rows = [(k, f"same\nown {k}") for k in range(12)]
    docs = make_docs(rows, _doc=1, _txt=2, _kept=3, n_lines="x", n_dropped="y", kept_text="z", rank=4, head=5)
    got = drop_repeated_lines(docs, min_docs=10)
    assert set(got.columns) == set(docs.columns)
    assert all((r.n_lines, r.n_dropped, r.kept_text, r._doc, r._txt, r._kept, r.rank) == (2, 1, f"own {r.doc_id}", 1, 2, 3, 4) for r in got.collect())


def test_query_on_odd_rows(spark, small_tables):
    got = op10_line_dedup(spark, small_tables).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 10)
    digest = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(want[i, t or ""]), digest(want[i, t or ""])) for i, t in rows)


def test_query_and_sql_count_documents_alike(spark, tmp_path):
    """Five ids of two texts each are ten documents; a repeated row is none."""
    rows = [(k, f"shared\nown {k} {v}") for k in range(5) for v in range(2)] + [(k, f"rare\n{k}") for k in range(9)] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op10_line_dedup(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.sql(line_dedup.OP10_SQL).fetchall())
    assert sorted(r[2] for r in got) == [0] * 18 + [1] * 10
