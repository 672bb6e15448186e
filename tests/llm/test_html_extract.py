import pytest
from pyspark.sql import functions as F

from basisweave.llm.html_extract import decode, extract_text, fit_extractor, op9_html_extraction, parse, repeated_texts, weak_labels

SCHEMA = "page_id long, url string, html string"


def page(k, body="", ad="div class='ad'"):
    tag = ad.split()[0]
    return f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p>'</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News {k}</a></li></ul></nav><{ad}>Buy now {k}.</{tag}><article><h1>Title {k}</h1><p><b>First &amp; bold\n text {k}.<br><p>Second   paragraph {k}, with commas.</p>{body}</article><footer>&copy; site {k}</footer></body></html>"


def text(k):
    return f"Title {k}\n\nFirst & bold text {k}.\n\nSecond paragraph {k}, with commas."


def test_parse_closes_and_collapses():
    p = parse("<body><p>a<b>b</b>\n c<p>d<br>e<ul><li>x<li>y</ul>tail &lt;<!-- no --> z<p cla")
    assert [t for _, t in p.blocks] == ["ab c", "d e", "x", "y", "tail < z"]


def test_decoding_never_keeps_below_a_dropped_block():
    kept = decode([-1, 0, 1, 1, 0, 4], __import__("numpy").array([0.0, -9.0, 2.0, 2.0, 1.0, -1.0]))
    assert kept.tolist() == [True, False, False, False, True, False]


def test_pages(spark):
    rows = [(k, "u", page(k)) for k in range(120)]
    model = fit_extractor(spark.createDataFrame(rows, SCHEMA))
    odd = [
        (900, "u", None), (901, "u", ""), (902, "u", "plain text"), (903, None, page(903)[:-20]), (903, None, page(903)[:-20]),
        (904, "u", page(904, "<section class='comments'><p>Nice post, really, I like it.</p></section><aside>See also</aside><form>Mail <input></form>")),
        (905, "u", "<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000),
        (906, "u", page(906, ad="div class='cookie-notice'")),
    ]
    got = [(r.page_id, r.text) for r in extract_text(spark.createDataFrame(rows[:20] + odd, SCHEMA), model).collect()]
    by = dict(got)
    assert len(got) == 28 and all(by[k] == text(k) for k in range(20))
    assert by[900] == by[901] == "" and by[902] == "plain text"
    assert by[903] == text(903) and by[904] == text(904) and by[906] == text(906)
    assert extract_text(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_without_named_blocks(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p><p>b</p>")], SCHEMA)
    assert fit_extractor(rows) is None
    assert extract_text(rows, None).first().text == "a\n\nb"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<head><title>x</title><meta charset=utf-8><body><article><p>Hello world.", ["Hello world."]),
        ("<p>a <button>b <p>c</button> d", ["a", "d"]),
        ("<div><p>one</p><button>two</div><p>three", ["one", "three"]),
        ("<p>x<svg viewBox='0'/>y</p>", ["xy"]),
        ("<p>x<svg><g><text>t</text></svg>y</p>", ["xy"]),
        ("<p>a<noscript><img src=x>n</noscript>b<template><p>q</p></template>c", ["ab", "c"]),
        ("<div><object>o</div><p>after", ["after"]),
        ("<section><canvas>no</section><video><p>v</video>text", ["text"]),
        ("<title>never closed <p>x", []),
        ("<p>a<textarea>b", ["a"]),
    ],
)
def test_hidden_elements_end_as_browsers_end_them(source, want):
    assert [t for _, t in parse(source).blocks] == want


def test_repeated_text_is_furniture_without_any_mark():
    found = [parse(f"<div><div>Same line on all pages</div><div>Own text {k}</div></div>") for k in range(5)]
    y = weak_labels(found[0], repeated_texts(found))
    texts = {t: y[n] for n, t in found[0].blocks}
    assert texts == {"Same line on all pages": 0, "Own text 0": -1}


def test_held_out_hosts(spark):
    """Trees fitted on some hosts extract the same text from the others as trees fitted there."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    fold = F.crc32(F.regexp_extract("url", "://([^/?#]*)", 1)) % 2
    own, other = (fit_extractor(pages.where(fold == k)) for k in (0, 1))
    a, b = (sorted(extract_text(pages.where(fold == 1), m).select("page_id", "text").collect()) for m in (own, other))
    assert sum(x == y for x, y in zip(a, b)) >= 0.98 * len(a)


def test_query_returns_every_page(spark, small_tables):
    got = op9_html_extraction(spark, small_tables)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    pages = spark.read.parquet(f"{small_tables}/pages.parquet").select("page_id", "url").collect()
    assert sorted(((r.page_id, r.url) for r in got), key=str) == sorted(((r.page_id, r.url) for r in pages), key=str)
    assert all(r.n_chars == len(r.text) for r in got)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", page(1))] * 500 + [(k, "u", page(k)) for k in range(2, 40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(7)).withColumn("host", F.lit("h")).withColumn("id", F.lit(1))
    got = extract_text(df, fit_extractor(df)).select("page_id", "text", "host", "id").distinct().collect()
    assert len(got) == 39 and all(r.text == text(r.page_id) and r.host == "h" and r.id == 1 for r in got)


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!---->", "<!-- a > b -- c -->"])
def test_comments_end_as_in_browsers(comment):
    page = parse(f"<p>one{comment}two</p><p>three</p>")
    assert [t for _, t in page.blocks] == ["onetwo", "three"]


def test_query_on_odd_pages(spark, small_tables):
    got = op9_html_extraction(spark, small_tables).collect()
    assert len(got) == spark.read.parquet(f"{small_tables}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[9001] == "" and by_id[9002] == "" and by_id[9004] == by_id[9005] == "tie tie tie"
    assert len(by_id[9003]) > 59_000


def test_query_gives_the_articles(spark, tmp_path):
    """The whole query against the text that the pages were made from."""
    rows = [(k, f"http://h{k % 5}.net/{k}", page(k, ad=("div class='ad'", "aside", "div id='sidebar'")[k % 3])) for k in range(120)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = op9_html_extraction(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(k, text(k), len(text(k))) for k in range(120)]
