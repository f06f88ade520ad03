import random

import pytest

from tessera.llm import html as h


def test_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- x --><div class="ad">Buy <div>now</div></div>
    <article><h1>Head &amp; line</h1><p><b>One<br>two<p>Three &eacute; a&nbsp;b  c<aside>side</aside><div class="share-buttons">Share</div><form>f<input></form><p title="a>b">Four</p></article>
    <section class="comments"><article>me too</article></section><footer>&copy; x</footer></body></html>"""
    assert h.main_text(page, None) == "Head & line One two Three é a b c Four"


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a b"), ("<article><p>cut &am", "cut &am"), ("<article><p>x</p><p", "x"), ("<div>1 < 2</div>", "1 < 2"),
    ("<script>never closed", ""), ("<div class='cookie-notice'><p>We</p></div><div>Text</div>", "Text"), ("<article>a</article><article>b</article>", "a b"), ("<nav>menu<article>t</article>", "t"),
])
def test_small(page, text):
    assert h.main_text(page, None) == text


def test_common_lines():
    rnd = random.Random(4)
    for _ in range(400):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = h.common_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(got)
        it = iter(b)
        assert all(a[i] in it for i in got)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")


def test_differencing(spark):
    page = lambda k: f"<html><body><div>Our site</div><div>Unique text number {k} {'word ' * 30}{k}</div><div>Bottom line</div></body></html>"
    rows = [(k, f"http://a.example/{'x' if k % 2 else 'y'}/{k}", page(k)) for k in range(60)]
    rows += [(100, "http://b.example/1", page(100)), (101, None, None), (None, "http://c.example/", "<p>q</p>"), (7, "http://a.example/x/7", page(7))]
    got = h.main_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 60:
            assert r.text == " ".join(f"Unique text number {r.page_id} {'word ' * 30}{r.page_id}".split()), r
    by = {r.page_id: r for r in got}
    assert by[100].text.startswith("Our site") and by[101].text == "" and by[None].text == "q"
    assert all(r.n_chars == len(r.text) for r in got)
    assert h.main_texts(frame(spark, rows).limit(0)).count() == 0
    assert h.extract(frame(spark, rows)).count() == len(rows)


def test_same_by_any_partitioning(spark):
    page = lambda k: f"<div>Top {k // 7}</div><div>Own {k} {'word ' * 40}</div>"
    rows = [(k, f"http://a.example/{k:03}", page(k)) for k in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    texts = []
    try:
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            texts.append(sorted((r.page_id, r.text) for r in h.main_texts(frame(spark, rows)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert texts[0] == texts[1] == texts[2]


def test_copies_and_long_templates(spark):
    template = "".join(f"<div>Template line {j} of the whole site and more</div>" for j in range(9))
    page = lambda k: f"<html><body>{template}<div>Own {k}</div></body></html>"
    # Copies side by side by their query, before and after pages of other lines.
    rows = [(k * 10 + j, f"http://a.example/{k}?copy={j}", page(k)) for k in range(6) for j in range(3)]
    got = h.main_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.text == f"Own {r.page_id // 10}" for r in got)


def brute(rows):
    """Texts of whole pages: neighbours by sorting, alignment by the textbook table."""
    from collections import defaultdict
    from os.path import commonprefix
    from urllib.parse import urlsplit

    hosts, found = defaultdict(dict), {}
    for page_id, url, html in sorted(rows, key=lambda r: str(r[1])):
        u = urlsplit(url or "")
        path = u.path
        for tail in ("/index.html", "/index.htm", ".html", ".htm", "/"):
            if path.endswith(tail):
                path = path[: -len(tail)]
                break
        found[page_id] = (u.netloc.lower(), path, h.lines(html or ""))
        host, _, lines = found[page_id]
        key = frozenset(t for t, _ in lines)
        hosts[host].setdefault(key, []).append((path, page_id))
    out = {}
    for page_id, (host, path, lines) in found.items():
        pages = sorted((min(v)[0], k) for k, v in hosts[host].items())
        own = frozenset(t for t, _ in lines)
        at = next(i for i, (_, k) in enumerate(pages) if k == own)
        near = [pages[i] for i in (at - 1, at + 1) if 0 <= i < len(pages)]
        gone = set()
        if near:
            least = pages[at][0]
            best = max(near, key=lambda n: len(commonprefix([least, n[0]])))
            other = [t for t, _ in found[min(hosts[host][best[1]])[1]][2]]
            a = [t for t, _ in lines]
            n = [[0] * (len(other) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a) - 1, -1, -1):
                for j in range(len(other) - 1, -1, -1):
                    n[i][j] = n[i + 1][j + 1] + 1 if a[i] == other[j] else max(n[i + 1][j], n[i][j + 1])
            i = j = 0
            while i < len(a) and j < len(other):
                if a[i] == other[j]:
                    gone.add(i)
                    i, j = i + 1, j + 1
                elif n[i + 1][j] >= n[i][j + 1]:
                    i += 1
                else:
                    j += 1
        out[page_id] = " ".join(t for i, (t, what) in enumerate(lines) if what != h.NONE and (what == h.TEXT or i not in gone))
    return out


def test_whole_pages(spark):
    """Made pages of templates without any names, and the pages of the smallest tables."""
    rnd = random.Random(6)
    rows = []
    for k in range(120):
        site = k % 5
        lines = [f"Top {site}", f"Menu {site} {k // 40}", *(f"Own {k} {j}" for j in range(rnd.randint(1, 5))), f"Quoted {k % 3}", f"Bottom {site}"]
        body = "".join(f"<div>{x}</div>" for x in lines)
        rows.append((k, f"http://s{site}.example/{rnd.choice('abc')}/{k:03}", f"<article><p>Text {k}</p><p>Same</p><div>{body}</div></article>" if k % 4 == 0 else body))
    got = {r.page_id: (r.text, r.n_shared) for r in h.main_texts(frame(spark, rows)).collect()}
    assert {k: t for k, (t, _) in got.items()} == brute(rows)
    assert sum(n for _, n in got.values()) > 200 and all("Same" in got[k][0] for k in range(0, 120, 4))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    real = {r.page_id: r.text for r in h.main_texts(pages).collect()}
    assert real == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_unclosed_tags_take_linear_time():
    import time

    began = time.process_time()
    for tag in ("<button>", "<select>", "<svg>", "<object>", "<!--", "<x "):
        h.lines("<p>text</p>" + tag * 40000)
    assert time.process_time() - began < 10
