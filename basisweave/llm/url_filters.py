"""URL filters, native: longest-prefix host rules, then trust and distrust propagated over the host link graph.

Hosts are nodes. Edges are the absolute links found in the pages, one weighted row per pair of hosts (aggregated
before any shuffle), and, unless ``domain_edges`` is off, a host and the nearest parent domain that has pages of its own
point at each other. A suffix without pages (co.uk) ties nobody, nor does a parent of more than ``max_children`` hosts:
its hosts are strangers that share a name (github.io). Personalised PageRank runs from the hosts whose pages the allow rules take; distrust
runs the same way over the reversed edges from the hosts whose pages the block rules take. Both walks share one edge
table and advance together until a round moves less than ``tolerance`` of the mass. A host's pages that no rule fits are blocked if its distrust exceeds ``min_share``
times the uniform share (one over the number of hosts with pages) and ``ratio`` times its trust.

Defined cases: a null url or one without "://" has empty host and path, fits no rule and is allowed; null html has no
links; repeated rows are judged alike; an empty table gives no rows; extra columns pass through ``filter_urls``, but for
those that bear the name of an output, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisweave.llm.common import lower_ascii, read_table, written

LINK = "(?i)href\\s*=\\s*[\"']?(?:https?:)?//([^/?#\"'\\s>]+)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as (name, allow), else null. Longest: the longest host, then the longest path."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    empty = F.lit(None).cast("struct<name:string,allow:boolean>")
    return reduce(lambda rest, r: F.when(fits(r), F.struct(F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))).otherwise(rest), reversed(ordered), empty)


def parent_domains(host: Column) -> Column:
    """All parent domains of two labels or more, the nearest first; of a host of over 128 labels (a name has 127 at most) the last 127."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    names = F.transform(F.sequence(F.greatest(F.lit(2), n - 126), n - 1), lambda k: F.array_join(F.slice(labels, k, n), "."))
    return F.when(n > 2, names).otherwise(F.array().cast("array<string>"))


def domain_ties(hosts: DataFrame, max_children: int = 100) -> DataFrame:
    """(src, dst): each host and its nearest parent domain among ``hosts``, but for parents of more than ``max_children`` of them."""
    parents = hosts.where("host <> ''").select(F.col("host").alias("dst"))
    near = hosts.select(F.col("host").alias("src"), F.explode(parent_domains(F.col("host"))).alias("dst")).join(parents, "dst")
    ties = near.groupBy("src").agg(F.max_by("dst", F.length("dst")).alias("dst"))
    few = ties.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_children).select("dst")
    return ties.join(few, "dst").select("src", "dst")


def host_edges(pages: DataFrame, hosts: DataFrame, domain_edges: bool = True, max_children: int = 100) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted by page, and the ties to parent domains both ways."""
    links = (
        pages.where(F.col("html").contains("//"))
        .select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii))).alias("dst"))
        .where((F.col("host") != "") & (F.col("dst") != F.col("host")))
        .groupBy(F.col("host").alias("src"), "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    if not domain_edges:
        return links
    tree = domain_ties(hosts, max_children).withColumn("weight", F.lit(1.0))
    return links.unionByName(tree).unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, max_rounds: int = 120, cut_every: int = 10) -> DataFrame:
    """(kind, host, score): personalised PageRank per kind from ``seeds`` (kind, host, seed), whose seeds sum to 1.

    ``edges``: (kind, src, dst, share), shares of a source summing to 1. What hosts without edges hold goes back to the
    seeds: that solution is the one without it, scaled to sum 1, so the scores are scaled once at the end. Rounds go on
    until ``cut_every`` of them together move less than ``tolerance`` of each kind's mass.
    """
    back = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    score = written(seeds.select("kind", "host", F.col("seed").alias("score")), "host-score")
    mass = lambda rows: rows.groupBy("kind").agg(F.sum("score").alias("mass"))
    for _ in range(0, max_rounds, cut_every):
        before = score
        for _ in range(cut_every):
            moved = edges.join(score.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            score = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        score = written(score, "host-score")
        change = score.join(before.withColumnRenamed("score", "was"), ["kind", "host"], "full").select("kind", F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))).alias("score"))
        moving = mass(change).join(mass(score).withColumnRenamed("mass", "whole"), "kind").where(F.col("mass") > tolerance * F.col("whole"))
        if not moving.take(1):  # two kinds at most
            break
    return score.join(F.broadcast(mass(score)), "kind").select("kind", "host", (F.col("score") / F.col("mass")).alias("score"))


def host_trust(pages: DataFrame, domain_edges: bool = True, max_children: int = 100, **walk) -> DataFrame:
    """(host, trust, distrust, relative) from ``pages`` (host, html, rule); relative is the distrust in uniform shares."""
    hosts = written(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("rule.allow").alias("n_allow"), F.count_if(~F.col("rule.allow")).alias("n_block")), "hosts")
    raw = written(host_edges(pages, hosts, domain_edges, max_children), "host-edges")
    both = raw.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(raw.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "host-shares")
    seeded = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("n_allow").alias("k")), F.struct(F.lit("distrust").alias("kind"), F.col("n_block").alias("k")))).alias("s")).select("host", "s.kind", "s.k").where("k > 0 and host <> ''")
    total = seeded.groupBy("kind").agg(F.sum("k").alias("all"))  # two rows
    seeds = written(seeded.join(F.broadcast(total), "kind").select("kind", "host", (F.col("k") / F.col("all")).alias("seed")), "host-seeds")
    score = propagate(edges, seeds, **walk)
    n_hosts = hosts.where("host <> ''").count()
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0))
    wide = score.groupBy("host").agg(of("trust", "score").alias("trust"), of("distrust", "score").alias("distrust"))
    return wide.withColumn("relative", F.col("distrust") * n_hosts)


OUTPUTS = ("host", "path", "rule", "trust", "distrust", "verdict")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = 2.0, min_share: float = 0.1, domain_edges: bool = True, **walk) -> DataFrame:
    """``pages`` (url, html, anything else) with host, path, rule, trust, distrust and verdict, without html."""
    keep = [c for c in pages.columns if c not in OUTPUTS and c != "html"]
    own = pages.select(F.struct(*keep).alias("row"), "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = own.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    scores = written(host_trust(ruled.select("host", "html", "rule"), domain_edges, **walk), "host-trust")
    joined = ruled.drop("html").join(scores, "host", "left").fillna(0.0, ["trust", "distrust", "relative"])
    distrusted = (F.col("relative") > min_share) & (F.col("distrust") > ratio * F.col("trust"))
    verdict = F.when(F.coalesce(F.col("rule.allow"), ~distrusted), "allow").otherwise("block")
    return joined.select("row.*", "host", "path", F.col("rule.name").alias("rule"), "trust", "distrust", verdict.alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql(rounds: int = 60) -> str:
    """The query in SQL: the walk is written out round by round; the given pages link to no other host."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda value: " ".join(f"WHEN {fits(r)} THEN {value(r)}" for r in ordered)
    walk = ",\n".join(
        f"s{k} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT e.kind, dst AS host, score * share * 0.85 AS score FROM share e JOIN s{k - 1} p ON e.kind = p.kind AND e.src = p.host UNION ALL SELECT kind, host, seed * 0.15 FROM seed) GROUP BY ALL)"
        for k in range(1, rounds + 1)
    )
    return rf"""
WITH located AS (
  SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {case(lambda r: f"'{r.name}'")} END AS rule, CASE {case(lambda r: str(r.allow).lower())} END AS allow FROM located),
hosts AS (SELECT host, count(*) FILTER (WHERE allow) AS n_allow, count(*) FILTER (WHERE NOT allow) AS n_block FROM ruled GROUP BY host),
link AS (SELECT host AS src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT DISTINCT page_id, host, lower(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1))) AS dst FROM ruled) WHERE host <> '' AND dst <> host GROUP BY ALL),
label AS (SELECT host, string_split(host, '.') AS l FROM hosts),
near AS (SELECT src, arg_max(up, length(up)) AS dst FROM (SELECT host AS src, array_to_string(list_slice(l, unnest(range(2, len(l))), len(l)), '.') AS up FROM label WHERE len(l) > 2) JOIN hosts ON hosts.host = up AND up <> '' GROUP BY src),
tree AS (SELECT src, dst FROM near WHERE dst IN (SELECT dst FROM near GROUP BY dst HAVING count(*) <= 100)),
edge AS (SELECT * FROM link UNION ALL SELECT src, dst, 1.0 FROM tree UNION ALL SELECT dst, src, 1.0 FROM tree),
both_ways AS (SELECT 'trust' AS kind, src, dst, weight FROM edge UNION ALL SELECT 'distrust', dst, src, weight FROM edge),
share AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM both_ways),
seeded AS (SELECT 'trust' AS kind, host, n_allow AS k FROM hosts WHERE n_allow > 0 AND host <> '' UNION ALL SELECT 'distrust', host, n_block FROM hosts WHERE n_block > 0 AND host <> ''),
seed AS MATERIALIZED (SELECT kind, host, k / sum(k) OVER (PARTITION BY kind) AS seed FROM seeded),
s0 AS (SELECT kind, host, seed AS score FROM seed),
{walk},
final AS (SELECT s.kind, s.host, score / sum(score) OVER (PARTITION BY s.kind) AS score FROM s{rounds} s),
wide AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM final GROUP BY host)
SELECT page_id, r.host, path, rule, CASE WHEN coalesce(allow, NOT (coalesce(distrust, 0) * (SELECT count(*) FROM hosts WHERE host <> '') > 0.1 AND coalesce(distrust, 0) > 2 * coalesce(trust, 0)))
       THEN 'allow' ELSE 'block' END AS verdict
FROM ruled r LEFT JOIN wide USING (host)
"""


OP3_SQL = _sql()
