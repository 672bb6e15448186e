"""Main text of web pages: gradient-boosted trees over block nodes, decoded top-down.

A page becomes a tree of block elements; inline elements count towards their block. Each block has features of its
subtree (text, link and tag density, punctuation), of its tag and attribute tokens, depth and place among its
siblings. The trees learn from a bounded sample, at most ``site_pages`` pages of each of ``sites`` hosts, the first by
hash, with weak labels: semantic elements and attribute words name some blocks as article or as page furniture; a block
without such marks whose whole text stands on several sampled pages of its host is furniture too, a label that no
feature shows; the others are left out. A third of the learning rows has its tag or its attribute words blanked or
exchanged for other words of the same meaning, so that no single mark decides. Decoding takes the likeliest choice for the whole tree under the rule that whatever hangs below
a dropped block is dropped.

Defined cases: null and empty html give an empty text; pages without any block tag are one block; unclosed and
misnested tags are closed as browsers do; comments end where browsers end them (`<!-->`, `--!>`); a cut-off tag at the
end is dropped; repeated rows are treated alike; an empty
table gives no rows; extra columns pass through ``extract_text``, but for one named ``text``, which is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basisweave.llm.common import first_by_hash, one_blas_thread, read_table

#: Elements that start a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is raw text up to their end tag, or to the page's end, and never text of the page.
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
#: Elements whose content is hidden; without an end tag they end with the element that holds them.
HIDDEN = frozenset("audio button canvas noscript object svg template video".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, up to the nearest named container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Attribute words of page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login menu meta nav navbar navigation newsletter notice pagination popup promo related respond search share sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Attribute words of articles.
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
FURNITURE_TAGS = frozenset("nav footer aside form header menu select fieldset dialog".split())
ARTICLE_TAGS = frozenset("article main".split())

_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<hid>{RAW})\b[^>]*>.*?(?:</(?P=hid)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[/a-z][^<>]*\Z", re.I | re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

TAG_GROUPS = ("article main", "nav menu", "footer", "header", "aside", "form fieldset select", "p", "h1 h2 h3 h4 h5 h6", "li ul ol dl dd dt", "div section", "table tbody tr td th", "body html")
_TAG_AT = {t: k for k, group in enumerate(TAG_GROUPS) for t in group.split()}
N_TAGS = len(TAG_GROUPS)
#: Tag flags, the parent's tag flags, six mark flags, and eleven measures.
MARKS = 2 * N_TAGS
N_MARKS = 6
N_FEATURES = MARKS + N_MARKS + 11


@dataclass
class Page:
    """Block nodes in page order (a parent comes before its children) and the text blocks with their nodes."""

    tags: list[str]
    parents: list[int]
    words: list[frozenset[str]]
    chars: list[int]
    link_chars: list[int]
    inline: list[int]
    marks: list[int]
    blocks: list[tuple[int, str]]


def parse(source: str | None) -> Page:
    page = Page(["html"], [-1], [frozenset()], [0], [0], [0], [0], [])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block that holds their text
    buffer: list[str] = []
    in_link = hidden = 0

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                page.blocks.append((stack[-1][1], text))
            buffer.clear()

    def add(text: str) -> None:
        if text and not hidden:
            buffer.append(text)
            n, node = len(text), stack[-1][1]
            page.chars[node] += n
            page.link_chars[node] += n if in_link else 0
            page.marks[node] += text.count(".") + text.count(",")

    def close_to(depth: int) -> None:
        nonlocal in_link, hidden
        gone = stack[depth:]
        if any(t in BLOCKS for t, _ in gone):
            flush()
        in_link -= sum(t == "a" for t, _ in gone)
        hidden -= sum(t in HIDDEN for t, _ in gone)
        del stack[depth:]

    at = 0
    source = source or ""
    for m in _TOKEN.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
            continue
        if tag in ("html", "head"):  # what a head holds besides raw elements is text of the body, as in browsers
            continue
        if tag in CLOSES:
            ended, limit = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    close_to(k)
                    break
                if stack[k][0] in limit or stack[k][0] in HIDDEN:
                    break
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] in BLOCKS or stack[k][0] in HIDDEN:
                    break
            flush()
            if tag == "hr":
                continue
            page.tags.append(tag)
            page.parents.append(stack[-1][1])
            page.words.append(frozenset(w for a in _ATTR.findall(m["attr"] or "") for w in _WORDS.findall("".join(a).lower())))
            for column in (page.chars, page.link_chars, page.inline, page.marks):
                column.append(0)
            stack.append((tag, len(page.tags) - 1))
        elif tag in VOID:
            add(" ")
            page.inline[stack[-1][1]] += 1
        elif not (tag in HIDDEN and (m["attr"] or "").endswith("/")):
            page.inline[stack[-1][1]] += 1
            in_link += tag == "a"
            hidden += tag in HIDDEN
            stack.append((tag, stack[-1][1]))
    add(source[at:])
    flush()
    return page


def node_marks(page: Page) -> np.ndarray:
    """Own furniture and article words; then, on the way from the root: furniture and article words, furniture and article tags."""
    out = np.zeros((len(page.tags), N_MARKS), np.float32)
    for k, (tag, words, up) in enumerate(zip(page.tags, page.words, page.parents)):
        row = out[k]
        if k:
            row[2:] = out[up][2:]
        if words:
            row[0], row[1] = bool(words & FURNITURE_WORDS), bool(words & ARTICLE_WORDS)
            row[2], row[3] = max(row[0], row[2]), max(row[1], row[3])
        if tag in FURNITURE_TAGS and not (tag == "header" and row[5]):
            row[4] = 1
        elif tag in ARTICLE_TAGS:
            row[5] = 1
    return out


def node_features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parents = page.parents
    sub = np.array([page.chars, page.link_chars, page.inline, page.marks, [1] * n, [t == "p" for t in page.tags]], np.float64)
    before = np.concatenate(([0.0], np.cumsum(sub[0])[:-1]))
    children, place, depth = [0] * n, [0] * n, [0] * n
    for k in range(1, n):
        p = parents[k]
        place[k], depth[k] = children[p], depth[p] + 1
        children[p] += 1
    columns = sub.T.tolist()
    for k in range(n - 1, 0, -1):
        own, up = columns[k], columns[parents[k]]
        for j in range(6):
            up[j] += own[j]
    chars, links, inline, marks, nodes, paragraphs = np.array(columns).T
    out = np.zeros((n, N_FEATURES), np.float32)
    for k, t in enumerate(page.tags):
        if (g := _TAG_AT.get(t)) is not None:
            out[k, g] = 1
        if k and (g := _TAG_AT.get(page.tags[parents[k]])) is not None:
            out[k, N_TAGS + g] = 1
    out[:, MARKS : MARKS + N_MARKS] = node_marks(page)
    siblings = np.array([children[p] if p >= 0 else 1 for p in parents])
    total = max(1.0, chars[0])
    out[:, MARKS + N_MARKS :] = np.stack(
        [np.log1p(chars), links / (chars + 1), chars / (nodes + inline), marks / (chars + 1) * 100, np.log1p(nodes), paragraphs / nodes, np.array(depth), np.array(place) / siblings, np.log1p(siblings), chars / total, before / total], 1
    )
    return out


def weak_labels(page: Page, repeated: set[str] = frozenset()) -> np.ndarray:
    """1 article, 0 furniture, -1 unnamed: furniture marks win over article marks on the same way from the root.

    A node without marks whose text blocks are all among ``repeated`` is furniture.
    """
    marks = node_marks(page)
    out = np.where(marks[:, 2] + marks[:, 4] > 0, 0, np.where(marks[:, 3] + marks[:, 5] > 0, 1, -1))
    if repeated:
        own: dict[int, bool] = {}
        for node, text in page.blocks:
            own[node] = own.get(node, True) and text in repeated
        for node, again in own.items():
            if again and out[node] < 0:
                out[node] = 0
    out[0] = -1
    return out


def repeated_texts(found: list[Page], least: int = 3, share: float = 0.2) -> set[str]:
    """Block texts of a host's pages that stand on ``least`` of them and on that ``share``."""
    n = Counter(text for p in found for text in {t for _, t in p.blocks})
    return {t for t, k in n.items() if k >= max(least, share * len(found))}


def varied(x: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The rows, with copies of a third each: without marks and tags; marked by words alone; marked by tags alone.

    Furniture copies may lie in an article: they then have an article row's measures and marks besides their own.
    """
    rng = np.random.default_rng(seed)
    articles, parts = x[y == 1], [(x, y)]
    for kind in ("blank", "word", "tag"):
        pick = np.flatnonzero(rng.random(len(x)) < 0.33)
        c, label = x[pick].copy(), y[pick]
        c[:, MARKS : MARKS + N_MARKS] = 0
        if kind == "blank":
            c[:, :MARKS] = 0
        else:
            inside = (rng.random(len(c)) < 0.6) & (label == 0) & (len(articles) > 0)
            if inside.any():
                c[inside] = articles[rng.integers(0, len(articles), int(inside.sum()))]
            own = rng.random(len(c)) < 0.5  # the marked block itself, else one below it
            if kind == "word":
                c[own, :N_TAGS] = 0
                c[own, _TAG_AT["div"]] = 1
                c[own & (label == 0), MARKS], c[own & (label == 1), MARKS + 1] = 1, 1
                c[label == 0, MARKS + 2], c[label == 1, MARKS + 3] = 1, 1
            else:
                c[own, :N_TAGS] = 0
                furniture = np.array([_TAG_AT[t] for t in ("nav", "footer", "header", "aside", "form")])
                c[own, np.where(label == 0, furniture[rng.integers(0, len(furniture), len(c))], _TAG_AT["article"])[own]] = 1
                c[label == 0, MARKS + 4], c[label == 1, MARKS + 5] = 1, 1
        parts.append((c, label))
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


@dataclass
class Boosted:
    """Depth-limited trees in arrays: node i has children 2i+1 (value <= cut) and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss over feature histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start, z = float(np.log(mean / (1 - mean))), np.full(len(x), np.log(mean / (1 - mean)))
    features, cuts, leaves = (np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * bins + binned[:, j]
                gs, hs = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                at = gain[:, : len(e)].argmax(1)
                won = gain[np.arange(width), at]
                take = won > best
                best[take] = won[take]
                features[k, first : first + width][take] = j
                cuts[k, first : first + width][take] = e[at[take]]
            node = 2 * node + 1 + (x[np.arange(len(x)), features[k, node]] > cuts[k, node])
        local = node - (2**depth - 1)
        gs, hs = (np.bincount(local, w, 2**depth) for w in (g, h))
        leaves[k] = rate * gs / (hs + ridge)
        z += leaves[k, local]
    return Boosted(features, cuts, leaves, start)


def decode(parents: list[int], logits: np.ndarray) -> np.ndarray:
    """The likeliest kept set in which no block below a dropped one is kept; the root is kept."""
    keep, drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    n = len(parents)
    for k in range(n - 1, 0, -1):
        keep[parents[k]] += max(keep[k], drop[k])
        drop[parents[k]] += drop[k]
    out = np.zeros(n, bool)
    out[0] = True
    for k in range(1, n):
        out[k] = out[parents[k]] and keep[k] > drop[k]
    return out


def site_sample(pages: DataFrame, id_col: str, html_col: str, url_col: str | None, sites: int, site_pages: int) -> DataFrame:
    """(host, id, html): the first ``site_pages`` pages by hash of the first ``sites`` hosts, one of each id."""
    host = F.lit("") if url_col is None else F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), "://([^/?#]*)", 1))
    located = pages.select(host.alias("host"), F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    hosts = located.select("host", "id").join(F.broadcast(first_by_hash(located, sites, "host")), "host").groupBy("host").agg(F.approx_count_distinct("id").alias("n"))
    # A cut at about twice the share goes before the ranking, so that a large host's ids are not sorted whole.
    mark = F.shiftrightunsigned(F.xxhash64("id"), 1)
    near = located.select("host", "id").join(F.broadcast(hosts), "host").where(mark / F.lit(2.0**63) <= (2 * site_pages + 20) / F.greatest(F.col("n"), F.lit(1))).distinct()
    ids = near.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(mark, "id"))).where(F.col("k") <= site_pages).select("host", "id")
    return located.join(F.broadcast(ids), ["host", "id"]).groupBy("host", "id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))


def fit_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", sites: int = 100, site_pages: int = 25) -> Boosted | None:
    """Trees learnt from a bounded sample; None without a named block of each kind. Without a url column all pages are one host's."""

    def learn(table: pa.Table) -> pa.Table:
        found = [parse(t) for t in table.column("html").to_pylist()]
        again = repeated_texts(found)
        y = np.concatenate([weak_labels(p, again) for p in found])
        x = np.concatenate([node_features(p) for p in found])[y >= 0]
        return pa.table({"x": pa.array(list(x), pa.list_(pa.float32())), "y": pa.array(y[y >= 0], pa.int64())})

    # A group holds ``site_pages`` pages at most.
    got = site_sample(pages, id_col, html_col, url_col, sites, site_pages).groupBy("host").applyInArrow(learn, "x array<float>, y long").toArrow()
    if not got.num_rows:
        return None
    x, y = np.array(got.column("x").to_pylist(), np.float32), got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # whatever order the tasks came in
    x, y = x[order], y[order]
    if y.min() == y.max():
        return None
    return boost(*varied(x, y.astype(np.float64)))


def extract_text(pages: DataFrame, model: Boosted | None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the html by default) with ``text``: the kept blocks in page order, an empty line between."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text")]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType())])
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        model = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [parse(t) for t in b.column(html_col).to_pylist()]
                x = np.concatenate([node_features(p) for p in found])
                z = model.logits(x) if model is not None else np.ones(len(x))
                texts, start = [], 0
                for p in found:
                    kept = decode(p.parents, z[start : start + len(p.tags)])
                    start += len(p.tags)
                    texts.append("\n\n".join(t for node, t in p.blocks if kept[node]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_text(pages, fit_extractor(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
