import hashlib
import html
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import htmltext, quality, queries, warc

from shelfmark.storage import materialize

from .helpers import docs_table, odd_table, sf

PAGES = "page_id long, url string, html string, size int, digest string"


def test_warc_equals_its_sql(spark):
    out = queries.op9_warc(spark, "/root/testdata/sf0.01").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    con = duckdb.connect()
    con.sql("create view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, con.sql(warc.ORACLE).fetchall()))


def test_warc_round_trip(spark, tmp_path):
    big = "é🙂\r\n\r\nWARC/1.1\r\n0\r\n" * 400
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", big), (9, "u", "z" * 300_000), (10, "u", "\x00\n")]
    pages = spark.createDataFrame([(*r, 1, "clash") for r in rows], PAGES).repartition(3)
    path = f"file://{tmp_path}/w"
    got = [tuple(r) for r in warc.round_trip(pages, path, segment_bytes=700).collect()]
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        same = [j for j, _, o in rows if o == t and j is not None]
        revisit = len(raw) >= 1000 and (i is None or i < max(same))
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    payloads = {r["page_id"]: r["payload"] for r in warc.read(spark, path).where("type = 'response'").collect()}
    assert payloads[2] == big.encode() and payloads[9] == b"z" * 300_000 and payloads[3] == b""
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_faults():
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c"), (2, None, b"b")]
    assert warc.reassemble(parts) == b"abc"
    for wrong in ([(1, None, b"a"), (3, 2, b"c")], [(1, None, b"a"), (2, None, b"b")], [(1, None, b"a"), (2, 5, b"b")]):
        with pytest.raises(warc.BrokenRecord):
            warc.reassemble(wrong)
    for n in (0, 1, 4095, 4096, 4097, 9000):
        assert warc.unchunked(warc.chunked(b"q" * n)) == b"q" * n
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    for framed in (b"5\r\nabc\r\n0\r\n\r\n", b"3"):
        with pytest.raises(warc.BrokenRecord):
            warc.unchunked(framed)
    record = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Block-Digest", "sha1:00")], b"abc")
    with pytest.raises(warc.BrokenRecord):
        list(warc.parse(record))
    with pytest.raises(warc.BrokenRecord):
        list(warc.parse(record[:-4]))


def test_article_of_every_page(spark):
    pages = sf(spark, "pages", "sf0.01").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r for r in htmltext.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert out[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert out[p["page_id"]]["n_chars"] == len(out[p["page_id"]]["text"])


def test_page_shapes(spark):
    long = "A sentence that belongs to the article and goes on for quite a while, as they do. " * 3
    cases = [
        ("", ""), ("<nav>menu</nav>", ""), ("<main><div id='comments'><p>hey</p></div><p>Text  one\n is &lt;here&gt;</p><br>b<i>c</i></main>", "Text one is <here>\n\nbc"),
        (f"<body><div class='sidebar-left'>{long}</div><ul><li><a href=x>one</a><li><a href=y>two</a></ul><h2>Title</h2><div class=post><p>{long}<p>{long}</div><div class='cookie-notice'>{long}</div><form>{long}</form></body>", "Title\n\n" + "\n\n".join([long.strip()] * 2)),
        (f"<article><header><h1>T</h1></header><p>x</p><aside>{long}</aside><table><tr><td>a<td>b</table>tail<section class=comments><article class=comment>{long}</article></section></article>", "T\n\nx\n\na\n\nb\n\ntail"),
        ("<article>a<script>if (a < b) { x('</p>') }</script><style>p{}</style><!-- c --><p hidden>no</p><p style='display: none'>no</p>", "a"),
        ("<article><p>unclosed <b>bold &eacute;&#x1F642; &amp", "unclosed bold é🙂 &"),
    ]
    for page, want in cases:
        assert htmltext.main_text(page) == want, page
    rows = spark.createDataFrame([(1, None, None), (None, "u", "<p>only text here"), (2, "u", "<p>" + "word " * 100_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r["n_chars"] for r in htmltext.extract(rows).collect()}
    assert got == {1: 0, None: 14, 2: 499_999}


def test_clusters_decide_on_pages_with_an_article():
    long = "A sentence that belongs to the article and goes on for quite a while, as they do. " * 4
    want = [long.strip()] * 4
    paragraphs = f"<p>{long}</p>" * 2
    links = "<ul>" + "".join(f"<li><a href=x{k}>Other story {k}</a></li>" for k in range(8)) + "</ul>"
    one = "<p><a href=y>The source of it</a></p>"
    assert htmltext.main_text(f"<article>{paragraphs}{links}{paragraphs}</article>") == "\n\n".join(want)
    assert htmltext.main_text(f"<div>{links}</div>{paragraphs}<article>{paragraphs}</article>") == "\n\n".join(want)
    assert htmltext.main_text(f"<article>{paragraphs}<div><a href=z>Buy shoes now</a></div>{paragraphs}</article>") == "\n\n".join(want)
    assert htmltext.main_text(f"<article>{paragraphs}{one}{paragraphs}</article>") == "\n\n".join([*want[:2], "The source of it", *want[2:]])
    assert htmltext.main_text(f"<article>{paragraphs}<p>Short.</p></article>") == "\n\n".join([*want[:2], "Short."])


def test_without_levels_or_clusters_results_change(monkeypatch):
    long = "A sentence that belongs to the article and goes on for quite a while, as they do. " * 4
    links = "<ul>" + "".join(f"<li><a href=x{k}>Other story {k}</a></li>" for k in range(8)) + "</ul>"
    menu = "<div>" + "".join(f"<p>Menu item {k}</p>" for k in range(8)) + "</div>"
    pages = [f"<article><p>{long}</p><p>{long}</p>{links}<p>{long}</p></article>", f"<body>{menu}<div><p>{long}</p><p>{long}</p></div></body>"]
    want = ["\n\n".join([long.strip()] * n) for n in (3, 2)]
    assert [htmltext.main_text(p) for p in pages] == want
    with monkeypatch.context() as flat:
        flat.setattr(htmltext, "_smoothed", lambda x: np.zeros(len(x)))
        assert all(htmltext.main_text(p) != w for p, w in zip(pages, want))
    with monkeypatch.context() as flat:
        flat.setattr(htmltext, "_cut", lambda x: float(x.min()))
        assert all(htmltext.main_text(p) != w for p, w in zip(pages, want))


def test_odd_tables_of_pages(spark):
    rows = [(1, "u", "<p>twice</p>", "x", 5), (1, "u", "<p>twice</p>", "x", 5), (2, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(pages).collect()) == [(1, "twice", 5), (1, "twice", 5), (2, "", 0)]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_regions_without_an_article_stay_whole():
    text = lambda n, k=0: (f"Paragraph {k} of {n}. " + "words of the text and " * n)[: n - 1] + "."
    lengths = [(200, 600, 180, 550, 220, 90, 80, 500, 600), (500, 600, 30, 35, 25, 600, 550), (400, 30), (30, 400, 400, 400, 25), (*[30] * 40, 600, 600, *[30] * 40)]
    for page in lengths:
        want = [text(n, k) for k, n in enumerate(page)]
        for block in ("p", "div"):
            body = "".join(f"<{block}>{x}</{block}>" for x in want)
            assert htmltext.main_text(f"<body><div>{body}</div></body>") == "\n\n".join(want), (page, block)
            assert htmltext.main_text(f"<body>{body}</body>") == "\n\n".join(want), (page, block)
    items = [text(25, k) for k in range(8)]
    six = [text(400, k) for k in range(6)]
    listed = "".join(f"<p>{x}</p>" for x in six) + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    assert htmltext.main_text(f"<body><div>{listed}</div></body>") == "\n\n".join(six + items)
    # what is apart, and links, still go
    menu = "<div>" + "".join(f"<p>Menu item {k}</p>" for k in range(8)) + "</div>"
    links = "<ul>" + "".join(f"<li><a href=x{k}>Other story {k}</a></li>" for k in range(8)) + "</ul>"
    assert htmltext.main_text(f"<body>{menu}<div>{listed}{links}</div></body>") == "\n\n".join(six + items)
    assert htmltext.main_text(f"<body>{links}</body>") == ""


def test_names_leave_layout_wrappers_and_most_text():
    long = "A sentence that belongs to the article and goes on for quite a while, as they do. " * 3
    aside = f"<div class='sidebar-left'>{long}</div><div id=comments><article>{long}</article></div>"
    for name in ("content-sidebar-wrap", "site has-sidebar", "no-sidebar", "share-price-report", "sidebar", "hidden", "skip widget", "site-header"):
        for tag in ("main", "article"):
            assert htmltext.main_text(f"<body><div class='{name}'><{tag}><p>{long}<p>{long}</{tag}></div></body>") == "\n\n".join([long.strip()] * 2), name
    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar"):
        page = f"<body><div class='{name}'><main><p>{long}</main>{aside}</div></body>"
        assert htmltext.main_text(page) == long.strip(), name
    assert htmltext.main_text(f"<body><p>{long}<section class=share><div class=widget><b>{long}</section><p>{long}") == "\n\n".join([long.strip()] * 2)
    assert htmltext.main_text(f"<div class=banner><p>{long}<p>{long}</div><p>{long}") == "\n\n".join([long.strip()] * 3)
    assert htmltext.main_text(f"<main><p>{long}</main><div class='related'><article>{long * 3}</article></div>") == long.strip()


def test_quality_on_held_out_rows(spark):
    docs, labels = sf(spark, "documents", "sf0.1"), sf(spark, "labels", "sf0.1")
    table = materialize(quality.prepared(docs.withColumns({"positive": F.lit("clash"), "features": F.lit("clash")})), "features")
    model = quality.learn(table, labels)
    assert 0.7 < model.prior < 0.97
    out = quality.score(table, model)
    assert out.count() == docs.count()
    held = out.where("held_out").join(labels, "doc_id")
    right = held.where("predicted = quality").count() / held.count()
    assert right > 0.97
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out.limit(50).collect())
    # the pass over all rows gives the loss and gradient that the rows have
    x = model.scaled(np.array([r["features"] for r in table.limit(300).collect()], float))
    loss, grads = quality._negative_losses(table.limit(300), model)
    want = quality.losses(model.weights, x, False)
    assert np.isclose(loss, want[0] / 300) and all(np.allclose(a, b / 300) for a, b in zip(grads, want[1]))


@pytest.mark.parametrize("seed", range(6))
def test_risk_gradient_by_differences(seed):
    rng = np.random.default_rng(seed)
    w = [rng.normal(size=s) for s in ((3, 4), 4, 4, 1)]
    p, u = rng.normal(1, 1, (30, 3)), rng.normal(size=(50, 3))
    prior = (0.3, 0.99)[seed % 2]

    def value(w):
        of = lambda x, sign: quality._mean(quality.losses(w, x, sign), len(x))
        return quality.risk(prior, of(p, True), of(p, False), of(u, False)), of(u, False)[0] - prior * of(p, False)[0]

    (_, grads), below = value(w)
    for k, part in enumerate(w):
        for at in np.ndindex(part.shape):
            moved = []
            for step in (1e-5, -1e-5):
                other = [a.copy() for a in w]
                other[k][at] += step
                (r, _), b = value(other)
                moved.append(-b if below < 0 else r)
            assert np.isclose((moved[0] - moved[1]) / 2e-5, grads[k][at], rtol=1e-3, atol=1e-6)


@pytest.mark.parametrize("share", (0.2, 0.5, 0.8))
def test_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(7)
    sp = rng.normal(3, 1, 4000)
    su = np.concatenate([rng.normal(3, 1, int(40_000 * share)), rng.normal(-1, 1, int(40_000 * (1 - share)))])
    edges = np.linspace(-8, 8, quality.BINS)
    counts = np.bincount(np.clip(np.searchsorted(edges, su, "right") - 1, 0, len(edges) - 1), minlength=len(edges))
    assert abs(quality.best_bin(sp, edges, counts.astype(float)) - share) < 0.05


def test_quality_on_odd_rows(spark):
    docs, none = odd_table(spark), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    table = quality.prepared(docs)
    assert quality.learn(table, none) is None
    rows = quality.score(table, None).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}
    empty = quality.prepared(docs_table(spark, []))
    assert quality.score(empty, None).count() == 0 and quality.learn(empty, none) is None
    # one positive and an empty text are enough to learn from
    few = spark.createDataFrame([(2, 1), (5, 1), (6, 0), (6, 1)], "doc_id long, quality int")
    model = quality.learn(materialize(table, "features"), few)
    assert all(0 <= r["score"] <= 1 for r in quality.score(table, model).collect())
