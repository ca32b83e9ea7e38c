"""Page text and WARC archives."""

import hashlib
import re

from quirefold.llm import html_text, warc

PAGE = "page_id long, url string, html string, digest string, uid string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE)


def test_article_without_what_surrounds_it():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header class="site"><a href="/">Home</a></header><nav><ul><li><a>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now, please. Very long advert text, honestly.</div>
    <div class="cookie-notice">We use cookies, and so on.</div>
    <article><header><h1>The &amp; title</h1></header><p><b>First &lt;b&gt;<br>second&nbsp;line<p>Short.</p><ul><li>One</li><li>Two</li></ul>
    <aside>Related, stuff.</aside><form><label>Name</label><input></form><div id="comments"><p>Nice post! Really, really nice.</p></div></article>
    <footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(html) == "The & title First <b> second line Short. One Two"


def test_page_without_semantic_markup():
    para = "Some words here, and some more there; this goes on for a while, as texts do. "
    html = f"<body><div class='top-menu'><a>Home</a> <a>About</a></div><div id=wrap><div class=story><h2>Head</h2><p>{para * 3}</p><p>{para}</p><p>Tiny.</p></div><div class=sidebar><p>{para}</p></div></div><div>© 2020</div></body>"
    assert html_text.main_text(html) == " ".join(("Head " + para * 3 + para + "Tiny.").split())


PARA = "Some words here, and some more there; this goes on for a while, as texts do. "


def test_articles_keep_their_own_parts():
    """Headers, oddly named paragraphs and articles, and sections of an article are its text."""
    html = '<article><header class="post-header"><h1>T</h1></header><p class="legal">A b.</p><p>C d, e.</p></article>'
    assert html_text.main_text(html) == "T A b. C d, e."
    html = f'<body><div class="ad">{PARA}</div><article class="tag-news comments-open"><h1>T</h1><section><p>{PARA}</p></section><section><p>No.</p></section><div>x</div></article></body>'
    assert html_text.main_text(html) == f"T {PARA}No. x"
    html = f'<body><article class="comment"><p>{PARA}</p></article><article><p>{PARA * 2}</p></article><section class="comments"><article><p>{PARA}</p></article></section></body>'
    assert html_text.main_text(html) == (PARA * 2).strip()


def test_article_of_links():
    html = f'<body><nav><a>Menu</a></nav><div class="ad">{PARA}</div><article><p><a href="x">All of it is a link.</a></p></article></body>'
    assert html_text.main_text(html) == "All of it is a link."


def test_body_beside_a_teaser():
    html = f"<body><div class=text><h1>Head</h1>{''.join(f'<p>{PARA * 3}</p>' for _ in range(30))}</div><div><article class=box><p>Read on, here.</p></article></div></body>"
    assert html_text.main_text(html) == ("Head " + PARA * 90).strip()


def test_scores_choose_the_content(monkeypatch):
    """No semantic elements, no names: text and punctuation ratios alone tell lists of words and links from the text."""
    items = "".join(f"<div>word{k} word</div>" for k in range(80))
    links = "".join(f"<div><a>A longer link, with words; {k}</a></div>" for k in range(40))
    html = f"<body><div>{links}</div><div>{items}</div><div><p>{PARA * 3}</p><p>{PARA}</p><p>Yes.</p></div><div>2020</div></body>"
    assert html_text.main_text(html) == (PARA * 4 + "Yes.")
    scores = html_text.path_scores
    monkeypatch.setattr(html_text, "path_scores", lambda page: dict.fromkeys(scores(page), 1.0))
    assert html_text.main_text(html) != (PARA * 4 + "Yes.")


def test_time_is_linear_in_bad_markup():
    import time

    for make in (lambda n: '<a "' * n, lambda n: "<div>x " * n, lambda n: "<b>" * n + "<div></div>" * n, lambda n: "<ul><li>" + "<div>" * n + "<li></li>" * n, lambda n: '<a ">' * n, lambda n: "<p>" + "<b>x" * n + "</i>" * n):
        began = time.process_time()
        html_text.main_text(make(60_000))
        assert time.process_time() - began < 15


def test_quotes_that_never_close():
    assert html_text.main_text("<p class='a>it's <b>fine</b></p><p>so is this</p>") == "fine so is this"
    assert html_text.main_text('<p title="a > b">one</p><p title="c>two</p><p>three</p>') == "one two three"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only"), (3, "u", "plain text only"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<article>" + "<p>w x</p>" * 5000 + "</article>"), (6, "u", "<<>><!--"), (7, "u", "<script>never ends")]
    got = {r["page_id"]: r for r in html_text.extract_pages(pages_of(spark, rows)).collect()}
    assert got[1]["text"] == "" and got[2]["n_chars"] == 0 and got[3]["text"] == "plain text only" and got[4]["text"] == "unclosed bold"
    assert got[5]["text"] == " ".join(["w x"] * 5000) and got[7]["text"] == ""
    assert html_text.extract_pages(pages_of(spark, [])).collect() == []
    assert html_text.path_table(pages_of(spark, rows)).filter("content").count() > 0


def test_template_pages(spark):
    """On the given pages, the article is what a plain pattern finds."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from html import unescape

    truth = {r["page_id"]: " ".join(unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0].strip("</>") == "b" else " ", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])).split()) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert got == truth


def brute_warc(rows):
    first = {}
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    for p, b in raw:
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, b in raw:
        f = first.get(b)
        revisit = f is not None and f != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    long = "<p>é" + "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 10
    rows = [(5, "u", long), (3, "u\r\nX: y", long), (3, "u", long), (9, None, long), (None, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "\r\n" * 100), (8, "u", "\r\n" * 100), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "🙂" * 25), (13, "u", "🙂" * 25)]
    got = warc.warc_round_trip(pages_of(spark, rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_warc(rows)
    assert all(r["complete"] for r in got)
    assert warc.warc_round_trip(pages_of(spark, [])).collect() == []


def test_payloads_come_back(spark):
    from quirefold.llm.common import scratch_path

    path = scratch_path(spark, "test")
    warc.write_warc(pages_of(spark, [(1, "http://a/", "<p>ü\r\n\r\n"), (2, "http://b/", "x" * 200)]), path)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, path, payloads=True).filter("record_type = 'response'").collect()}
    assert got == {1: "<p>ü\r\n\r\n", 2: "x" * 200}


def test_damaged_archive_is_flagged(spark, tmp_path):
    import gzip
    from pathlib import Path

    from quirefold.llm.common import scratch_path

    path = scratch_path(spark, "test")
    pages = pages_of(spark, [(1, "http://a/", "first page" * 20), (2, "http://b/", "second page"), (3, "http://c/", "first page" * 20)])
    warc.write_warc(pages, path, date="2024-01-02T03:04:05Z")
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(Path(path.removeprefix("file://")).glob("*.gz")))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(b"WARC-Date: 2024-01-02T03:04:05Z") == raw.count(b"WARC-Record-ID")
    # the revisit names the response's identifier
    response = re.search(rb"WARC-Record-ID: (\S+)\r\n[^<]*http://a/[^<]*WARC-Page-ID: 1\r\n", raw)[1]
    assert re.search(rb"WARC-Refers-To: (\S+)\r\n", raw)[1] == response
    assert raw.count(b"warcinfo") == len(list(Path(path.removeprefix("file://")).glob("*.gz")))

    broken = raw.replace(b"second page", b"sEcond page")
    lost = re.search(rb"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:" + re.escape(response[10:-1]) + rb"-m>.*?payloadBytes: 200\r\n(?:\r\n\r\n)?", broken, re.S)[0]
    (tmp_path / "part.gz").write_bytes(gzip.compress(broken.replace(lost, b"")))
    found = warc.assemble(warc.read_warc(spark, f"file://{tmp_path}")).select("response.page_id", "complete", "intact").collect()
    assert sorted(tuple(r) for r in found) == [(1, False, True), (2, True, False), (3, True, True)]
