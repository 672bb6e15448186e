import random
import re
from collections import Counter

from basisweave.llm.quality_rules import judge, op7_quality_rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_counts_against_brute_force(make_docs):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices(["a", "b ", "É", "#", "\n", "\t", "wort ", "x|y "], k=rng.randint(0, 60)))) for k in range(60)]
    rows += [(90, None), (91, ""), (92, " \n\t"), (93, "a b c d e f g h " * 40), (94, "w " * 3000), (0, rows[0][1]), (None, "x")]
    got = judge(make_docs(rows, _n=1)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(i), *brute(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)


def test_lines_and_verdicts(make_docs):
    clean = "This is a sentence of plain words that goes on for a while, as sentences do."
    rows = [
        (1, clean + "\n" + "Another line follows it with other words and ends here as well."),
        (2, clean + "\nHome About Contact\n" + "And the text goes on with more words than that."),
        (3, "alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa | lambda | my"),
        (4, clean + "\nWe use cookies on this page. Privacy policy."),
        (5, "of%%% the*** was$$$ and&&& " * 10 + "\n" + clean),
    ]
    got = {r.doc_id: r for r in judge(make_docs(rows), max_repeat_pct=1000).collect()}
    assert got[1].kept and got[1].cleaned == rows[0][1]
    assert got[2].kept and "Home" not in got[2].cleaned
    assert not got[3].kept and got[3].cleaned == ""
    assert "cookies" not in got[4].cleaned
    assert not got[5].kept
    assert judge(make_docs([])).count() == 0


def test_a_run_of_short_lines_is_navigation_in_any_language(make_docs):
    clean = "Dies ist ein Satz aus einfachen Wörtern, der eine Weile weitergeht, wie Sätze es tun."
    menu = "Startseite\nÜber uns\nKontakt\nBücher und Bilder"
    rows = [(1, f"{clean}\n{menu}\n{clean} Noch mehr."), (2, f"{clean}\nEin Titel\n{clean} Noch mehr."), (3, f"{clean}\nEins.\nZwei.\nDrei.\nVier.\n{clean} Mehr.")]
    got = {r.doc_id: r.cleaned for r in judge(make_docs(rows)).collect()}
    assert got[1] == f"{clean}\n{clean} Noch mehr." and got[2] == rows[1][1] and got[3] == rows[2][1]


def test_clashing_columns(make_docs):
    docs = make_docs([(1, "a b"), (2, None)], _n=1, _words=2, _lines=3, _bad=4, kept="x", n_words="y", _row=5)
    got = judge(docs)
    assert set(got.columns) == {*docs.columns, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned"}
    assert all((r._n, r._words, r._lines, r._bad, r._row, r.kept) == (1, 2, 3, 4, 5, False) for r in got.collect())


def test_query_on_odd_rows(spark, small_tables):
    got = op7_quality_rules(spark, small_tables).collect()
    rows = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((r.doc_id, *brute(r.text)) for r in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)
