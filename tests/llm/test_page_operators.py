"""The page operators against plain Python, and on awkward rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratafold.llm import kernels, main_text, url_filter, warc

URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://EXAMPLE.com/en/1", "https://www.example.com/en/x?q", "http://a.net/es/", "http://a.net/fr", "http://b.a.net/fr/#x", "https://xnet/fr/1", "http://com/", "http://a.com?x/",
    "http://a.com:80/en/", "ftp://www.Example.com/en/", "http://x.example.com/en/://y", "http://examplÉ.com/a", "a://b://c/d", "http://evil\n.com/\n/x", "http://cheap-pills.example.org/a",
]


def rule_truth(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2])) if fits else None
    return host, path, best and best[1] + best[2], best and best[0]


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(spark)


def test_rules_against_brute_force(spark, model):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "x", "y"), (0, None, "x", "y")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, score string"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = rule_truth(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_regression_separates_hosts(spark, model):
    """Hosts of words that are in no name of the table together, and of words that are in none."""
    blocked = ["https://xxx-casino.org/", "http://cheap-casino.org/x", "http://m.payday-bonus.info/en/1", "https://poker-spam.net"]
    allowed = ["https://www.city-council.example.org/opening", "http://harbourside.net/en/2", "https://qwlkjh.example.com/de/4", "", None, "x" * 100_000, "https://" + "y" * 50_000 + ".org/" + "z" * 50_000]
    rows = list(enumerate(blocked + allowed)) + [(None, blocked[0]), (0, blocked[0])]
    got = [(r.page_id, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), model).collect()]
    assert sorted(got, key=str) == sorted([(i, "block" if i is None or i < len(blocked) else "allow") for i, _ in rows], key=str)


def test_scores_against_brute_force(spark, model):
    """The score is the logistic of the summed weights of a url's different n-grams."""
    from math import exp

    weights, intercept = model
    urls = ["https://www.free-pills24.example.com/en/77?x", "http://library.org", "ftp://É.ü/ß"]
    half = len(weights) // 2
    for u, r in zip(urls, url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model).orderBy("page_id").collect()):
        host, path = (re.sub("[1-9]", "0", c) for c in rule_truth(u)[:2])
        name, label = re.sub(r"\.[^.]*$", "", re.sub(r"^(www|m|blog)\.", "", host)), re.search(r"\.[^.]*$", host)[0]
        grams = [(t[i : i + n], first) for t, first in ((f"^{name}$", 0), (f"{label}{path}$", half)) for n in url_filter.GRAMS for i in range(len(t) - n + 1)]
        hashes = spark.createDataFrame(grams, "g string, first int").select((F.pmod(F.xxhash64("g"), F.lit(half)) + F.col("first")).alias("b")).distinct().collect()
        assert r.score == pytest.approx(1 / (1 + exp(-intercept - sum(weights[h.b] for h in hashes))), abs=1e-9)


def test_held_out_figures(spark):
    threshold, precision, recall = url_filter.best_threshold(url_filter.held_out(spark))
    assert threshold == pytest.approx(url_filter.THRESHOLD, abs=0.051) and precision > 0.97 and recall > 0.97


def test_main_text_rules():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body><header>no</header><nav><a>no</a></nav>
    <div class="ad big">no</div><article><h1>Head &amp; tail</h1><p>one <b>two<br>three<p>four&nbsp;&#233; <!-- no --> <span>five</span></p><aside>no</aside>
    <div class="cookie-notice">no</div><form><input value="x">no</form><ul><li>a<li>b</ul><p>x < y</p></article><section id="comments"><article>no</article></section><footer>no</footer>"""
    assert main_text.Page(page).main({}, {}) == "Head & tail\none two three\nfour é five\na\nb\nx < y"
    assert main_text.Page("").main({}, {}) == "" and main_text.Page("plain  text").main({}, {}) == "plain text"
    assert main_text.Page("<p>a<p>b</div></x><div>c").main({}, {}) == "a\nb\nc"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><section id="related-work"><p>a</p></section><h2 id="social-history">b</h2><p>c</p></article>', "a\nb\nc"),
        ('<article><section id="comments"><p>a</p></section><h2 id="comments">b</h2><p class="notice">c</p><div class="comments">no</div><div class="social-share">no</div></article>', "a\nb\nc"),
        ('<div><h1 class="entry-header">a</h1><p class="form-of-life">b</p><div id="social-history">c</div></div>', "a\nb\nc"),
        ('<body class="sidebar"><div aria-hidden="false">a</div><p title="the hidden valley">b</p><p data-id="comment-3" data-class=\'ad\'>c</p></body>', "a\nb\nc"),
        ('<p hidden>no</p><p HIDDEN="">no</p><div class="site-footer">no</div><div id=comment-3>no</div><div class="related-posts x">no</div><p>a</p>', "a"),
        ('<p>a<svg viewBox="0 0 1 1"/> b</p><p>c</p><svg><path/></svg><p>d</p>', "a b\nc\nd"),
        ('<p>a</p><svg width=1><p>b</p><svg><text>no</text><svg>no</svg>no</svg><p>c</p>', "a\nb\nc"),
        ('<p>a</p><template id="t"><p>b</p><script>"</template>"</script><!-- </template> --><p>c</p>', "a\nb\nc"),
    ],
)
def test_main_text_keeps_what_is_not_named(page, text):
    assert main_text.Page(page).main({}, {}) == text


def test_style_tree_removes_what_repeats(spark):
    def page(i):
        return f"<html><body><div class='top'>Our site, always here</div><div class='story'><p>story {i} of many</p></div><div class='end'>Call us</div></body></html>"

    rows = [(i, f"http://h.example.org/{i}", page(i)) for i in range(6)] + [(9, "http://other.example.org/", page(9)), (10, None, None), (None, "x", ""), (0, "http://h.example.org/0", page(0))]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("story 3 of many", 15)
    assert got[9][0] == "Our site, always here\nstory 9 of many\nCall us"  # one page says nothing about its site
    assert got[10] == ("", 0) and got[None] == ("", 0)
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_judges_blocks_inside_articles(spark):
    """What nearly every article of a site repeats goes, also without a class; what only some articles share stays, and so does a small site's text."""

    def page(i):
        shared = "<p>a passage of two stories</p>" if i < 2 else ""
        return f"<body><div class='a'>menu {i * 7 % 13}</div><article><h1>story {i}</h1><p>Read our letter every week.</p><p>text {i}</p>{shared}<div class='x'><p>our offices</p></div></article></body>"

    rows = [(i, f"http://big.org/{i}", page(i), "c") for i in range(14)] + [(100 + i, f"http://small.org/{i}", page(i), "c") for i in range(5)] + [(200, "http://big.org/copy", page(0), "c")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in main_text.extract(docs).collect()}
    assert got[0] == "story 0\ntext 0\na passage of two stories" and got[5] == "story 5\ntext 5" and got[200] == got[0]
    assert got[102] == "story 2\nRead our letter every week.\ntext 2\nour offices"
    assert {r.page_id: r.text for r in main_text.extract(docs, broadcast_nodes=0).collect()} == got


def test_importance_against_brute_force(spark):
    from collections import Counter, defaultdict
    from math import log

    def page(i):
        return f"<body><div class='a'>{'one' if i % 3 else 'two'}</div><div class='b'><p>same</p><p>text {i}</p></div>{'<ul><li>x</ul>' if i % 2 else ''}</body>"

    sources = [page(i) for i in range(9)] + [page(0)]
    rows = [(i, "http://h/", t) for i, t in enumerate(sources)]
    got = {(r.path, r.is_block): (r.pages, round(r.importance, 9)) for r in main_text.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    layouts, texts, blocks = defaultdict(Counter), defaultdict(Counter), Counter()
    for t in sorted(set(sources)):
        parsed = main_text.Page(t)
        for path, layout, text in parsed.nodes():
            layouts[path][layout] += 1
            texts[path][text] += 1
        blocks.update({(parsed.path[i], words) for i, _, words in parsed.blocks()})

    def spread(counts):
        n = sum(counts.values())
        return -sum(c / n * log(c / n) for c in counts.values()) / log(n) if n > 1 else 1.0

    want = {(p, False): (sum(layouts[p].values()), round(0.1 * spread(layouts[p]) + 0.9 * spread(texts[p]), 9)) for p in layouts}
    for (path, words), c in blocks.items():
        if c > 1:
            n = sum(layouts[path].values())
            want[main_text.digest(str(path), "", words), True] = (n, round(1 - log(c) / log(n), 9))
    assert {k: (n, pytest.approx(v, abs=1e-8)) for k, (n, v) in want.items()} == got


def test_main_text_takes_linear_time():
    import time

    hostile = ["<div>" * 100_000, "<div>" * 50_000 + "</b>" * 50_000, '<a "' * 100_000, "<!" * 200_000, "<form><h1>" * 20_000, "<p><button>" + "<div>" * 50_000, "<ul><li>" * 30_000, '<svg "' * 60_000, "<a '\">" * 50_001]
    began = time.process_time()
    for source in hostile:
        main_text.Page(source).main({}, {})
    assert time.process_time() - began < 20


def test_main_text_awkward(spark):
    long = "<article>" + "<p>word word</p>" * 60_000 + "</article>"
    rows = [(1, "http://h/", long, 5, "x"), (None, None, None, None, None), (1, "http://h/", "<p>a", 1, "y"), (1, "http://h/", "<p>a", 1, "y"), (2, "http:///x", " \n ", 0, "")]
    out = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path long, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0), r.n_chars) for r in out.collect()) == [(0, 0), (1, 1), (1, 1), (1, 60_000 * 10 - 1), (2, 0)]


@pytest.mark.parametrize(
    "page, text",
    [
        ('<html class="no-cookie"><body class="single has-sidebar"><article>a</article>', "a"),
        ("<form><article>a</article><input></form>", "a"),
        ("<form><p>q</p></form><p>x</p>", "x"),
        ('<main><div class="share">a</div><p>b</p></main>', "b"),
        ('<a "b>c</a> d > e', "c d > e"),
    ],
)
def test_main_text_weighs_evidence(page, text):
    assert main_text.Page(page).main({}, {}) == text


def test_main_text_of_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 5\r\n\r\na\n\nb\r"
    data = warc.arc_file(version, [("http://a b.example/", body), ("http://c/", b"")])
    found = list(warc.arc_records(data))
    assert [(h["URL"], b) for h, b in found] == [("http://a b.example/", body), ("http://c/", b"")]
    record = warc.to_warc(*found[0])
    assert record.headers["WARC-Type"] == "response" and record.headers["WARC-Date"] == "2024-01-01T00:00:00Z"
    assert warc.to_warc(*found[1]).headers["WARC-Type"] == "resource"
    again = list(warc.warc_records(record.to_bytes() + b"\r\n\r\n" + warc.to_warc(*found[1]).to_bytes() + b"\r\n\r\n"))
    assert again[0].block == body and again[0].http()[1] == b"a\n\nb\r" and again[1].block == b""
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-8] + b"\nx 1 2\n"))


def test_warc_round_trip(spark):
    long, other = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60, "y" * 999
    rows = [(1, "u1", long), (2, "u\n2", long), (3, None, long), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "z" * 1000), (None, "u", long), (None, "u", "q" * 2000), (None, "u", "q" * 2000), (3, "u", long)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()

    def want(i, h):
        data = (h or "").encode()
        same = [p for p, _, x in rows if (x or "") == (h or "") and p is not None]
        revisit = len(data) >= 1000 and same and i != max(same)
        return i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None

    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(want(i, h)) for i, _, h in rows)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_scratch_is_removed(spark, tmp_path):
    with kernels.Scratch(spark) as scratch:
        assert scratch.put(spark.range(3)).agg(F.sum("id")).first()[0] == 3
        folder = scratch.folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
