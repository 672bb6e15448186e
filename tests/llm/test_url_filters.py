import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from basisweave.llm.url_filters import OP3_SQL, RULES, domain_ties, filter_urls, op3_url_filters, propagate

SCHEMA = "page_id long, url string, html string"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.Org/x?y#z", "https://example.org/es/1", "https://sub.EXAMPLE.org/en/12", "http://example.org/fr", "http://x.com/fr/a", "http://x.com/de/a", "http://xcom/fr/", "http://org", "http://org/", "a://b://c/d", "http://notexample.org/es/", "http://h.net?p=/x"]
    got = filter_urls(spark.createDataFrame([(k, u, None) for k, u in enumerate([*urls, urls[3]])], SCHEMA)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        if rule:
            assert r.verdict == ("allow" if rule.allow else "block")


def test_distrust_and_trust_travel_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    pages = [(k, f"http://bad.com/de/{k}", link("blog.shady.net")) for k in range(5)]
    pages += [(10, "http://blog.shady.net/a", link("bad.com")), (11, "http://friend.net/", link("good.org")), (12, "http://good.org/", link("friend.net")), (13, "http://alone.net/", None)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[10].verdict == "block" and got[10].distrust > 0
    assert got[11].verdict == "allow" and got[11].trust > 0
    assert got[13].verdict == "allow" and got[13].trust == got[13].distrust == 0
    assert filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_verdict_does_not_depend_on_the_number_of_blocked_hosts(spark):
    fed = [(0, "http://bad0.com/de/1", None), (1, "http://fed.net/a", '<a href="http://bad0.com/x">x</a>')]
    for n in (3, 400):
        pages = fed + [(k + 1, f"http://bad{k}.com/de/1", None) for k in range(1, n)]
        got = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, SCHEMA)).collect()}
        assert got[1].rule is None and got[1].verdict == "block"


def test_deep_hosts_are_tied_to_their_domain(spark):
    deep = ["a.b.c.d.e.bad.com", "x." * 200 + "bad.com"]
    pages = [(0, "http://bad.com/de/1", None), *((k, f"http://{h}/x", None) for k, h in enumerate(deep, 1))]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[1].verdict == "block"
    ties = {(r.src, r.dst) for r in domain_ties(spark.createDataFrame([(h,) for h in [*deep, "bad.com", "", "a..", "c.d.e.bad.com", "com"]], "host string")).collect()}
    assert ties == {(deep[0], "c.d.e.bad.com"), ("c.d.e.bad.com", "bad.com"), (deep[1], "bad.com")}


def test_hosts_that_share_a_suffix_are_strangers(spark):
    link = '<a href="http://evil.com/x">x</a>'
    pages = [(0, "http://evil.com/de/1", None), (1, "http://bad.co.uk/a", link), (2, "http://innocent.co.uk/a", None), (3, "http://lonely.net/a", None)]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}
    # A parent with pages of its own and few hosts answers for them; one with many hosts does not.
    hosting = [(10, "http://pages.io/a", None), *((100 + k, f"http://s{k}.pages.io/a", link if k == 0 else None) for k in range(30)), *pages]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(hosting, SCHEMA), max_children=20).collect()}
    assert got[100] == "block" and {got[100 + k] for k in range(1, 30)} == {"allow"}


def test_faint_distrust_does_not_block(spark):
    """The threshold counts in uniform shares: thirty hosts that link to one blocked site have about half of its distrust."""
    link = '<a href="http://evil.com/x">x</a>'
    pages = [(0, "http://evil.com/de/1", None), *((k, f"http://h{k}.net/", link) for k in range(1, 31)), *((1000 + k, f"http://quiet{k}.net/", None) for k in range(3))]
    out = filter_urls(spark.createDataFrame(pages, SCHEMA), min_share=0.5)
    strict = filter_urls(spark.createDataFrame(pages, SCHEMA), min_share=5.0)
    assert out.where("page_id between 1 and 30 and verdict = 'block'").count() == 30
    assert strict.where("page_id between 1 and 30 and verdict = 'block'").count() == 0


def test_propagation_against_a_dense_solve(spark):
    """Scores equal (I - d P')^-1 v, what hosts without edges hold going back to the seeds."""
    rng, n = random.Random(4), 25
    links = {(a, b): rng.randint(1, 5) for a in range(n) for b in range(n) if a != b and a % 6 and rng.random() < 0.15}
    out = {a: sum(w for (x, _), w in links.items() if x == a) for a in range(n)}
    v = np.zeros(n)
    v[[1, 2, 7]] = 0.5, 0.3, 0.2
    p = np.zeros((n, n))
    for (a, b), w in links.items():
        p[a, b] = w / out[a]
    for a in range(n):
        if not out[a]:
            p[a] = v
    want = np.linalg.solve(np.eye(n) - 0.85 * p.T, 0.15 * v)
    edges = spark.createDataFrame([("trust", str(a), str(b), w / out[a]) for (a, b), w in links.items()], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("trust", str(k), float(v[k])) for k in (1, 2, 7)], "kind string, host string, seed double")
    got = {int(r.host): r.score for r in propagate(edges, seeds, tolerance=1e-7, cut_every=20).collect()}
    assert all(abs(got.get(k, 0.0) - want[k]) < 1e-6 for k in range(n))


def test_domain_edges_can_be_left_out(spark):
    pages = spark.createDataFrame([(0, "http://bad.com/de/1", None), (1, "http://sub.bad.com/x", None)], SCHEMA)
    on, off = ({r.page_id: r.verdict for r in filter_urls(pages, domain_edges=k).collect()} for k in (True, False))
    assert on == {0: "block", 1: "block"} and off == {0: "block", 1: "allow"}


def test_query_and_clashing_columns(spark, small_tables):
    got = op3_url_filters(spark, small_tables).collect()
    pages = spark.read.parquet(f"{small_tables}/pages.parquet")
    want = sorted(((r.page_id, *brute(r.url)[:2], getattr(brute(r.url)[2], "name", None)) for r in pages.collect()), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == want
    assert all(r.verdict == ("allow" if brute("x://" + r.host + r.path)[2].allow else "block") for r in got if r.rule)
    odd = pages.withColumns({k: F.lit("old") for k in ("trust", "rule", "host", "verdict", "relative", "row")}).unionByName(pages.limit(3).withColumn("url", F.lit(None).cast("string")), allowMissingColumns=True)
    out = filter_urls(odd)
    assert {"page_id", "relative", "row", "trust", "distrust", "verdict", "rule"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert out.count() == odd.count() and out.where("verdict not in ('allow', 'block')").count() == 0


def test_query_and_sql_on_links_and_suffixes(spark, tmp_path):
    rng = random.Random(8)
    names = [f"{p}{n}.{s}" for p in ("", "www.", "a.b.") for n in ("bad", "good", "plain", "other") for s in ("com", "co.uk", "io")] + ["co.uk", "example.org"]
    pages = []
    for k in range(150):
        links = "".join(f'<a href="https://{h.upper()}/x">l</a>' for h in rng.sample(names, rng.randrange(3)))
        pages.append((k, f"http://{rng.choice(names)}/{rng.choice(['de', 'fr', 'es', 'en/1', 'x'])}/{k}", links or None))
    pages += [(900, None, "<a href=//good.com>x</a>"), (901, "", None), (902, "http://a../x", None), pages[3]]
    spark.createDataFrame(pages, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, op3_url_filters(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(OP3_SQL).fetchall(), key=str)
    assert len({g[4] for g in got if g[3] is None}) == 2
