"""Html extraction: the scanner on awkward markup, the network's gradients and held-out accuracy, whole pages."""

import html
import random
import re

import numpy as np
import pytest

pytest.importorskip("sightline.llm")

from sightline.llm import html_text as h  # noqa: E402


def texts(page):
    return [b.text for b in h.leaf_blocks(page)]


def test_scanner():
    assert texts("") == [] and texts(" \n") == [] and texts("a &amp b&nbsp;c") == ["a & b c"]
    assert texts("<p><b>One<br><p>Two</p>x<!-- <p>no</p> --><script>var t='</p>';</script>y") == ["One", "Two", "xy"]
    assert texts("<ul><li>a<li>b <i>c</i><ul><li>d</ul><li>e</ul>") == ["a", "b c", "d", "e"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>z") == ["1", "2", "3", "z"]
    assert texts("<div title='a>b'>q</div><img src=x>r<p>s</b>t</p>") == ["q", "r", "st"]
    assert texts("<p>5 < 6 and &lt;b&gt; &#233;&#x41; &unknown;</p><select><option>n</select><p>&copy") == ["5 < 6 and <b> éA &unknown;", "©"]
    assert texts("<p>a<style>p{}") == ["a"] and texts("x<!-- y") == ["x"] and texts("a<") == ["a<"]
    assert len(texts("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1
    linked = h.leaf_blocks("<p>ab <a href=x>cd</a></p>")[0]
    assert linked.linked == 2 and [t for t, _ in linked.path] == ["p"]


def test_tags_whose_end_is_left_out():
    body = "<article><h1>One</h1><p>Two</p></article>"
    for head in ("<head><title>t</title>", "<head><meta charset=utf-8><style>p{}</style><script>x</script>\n", "<head>"):
        assert texts(f"<html>{head}<body>{body}</html>") == ["One", "Two"]
        assert texts(f"<html>{head}{body}</html>") == ["One", "Two"] == texts(f"<html>{head}</head><body>{body}")
    assert texts("<head><title>t</title>plain <b>text</b>") == ["plain text"]
    for control in ("<select><option>a<option>b", "<button>ok", "<option>a", "<object data=x>a", "<video src=x>a", "<datalist><option>a"):
        assert texts(f"<div>{control}{body}</div>z") == ["One", "Two", "z"], control
        assert texts(f"<div>{control}{body}<button>x</button><select><option>y</select></div>") == ["One", "Two"], control
    # with an end tag of its own, a control keeps all it holds
    assert texts("<button><div>no</div></button><p>a") == ["a"] == texts("<object><object><p>no</object><p>no</object><p>a")
    assert texts("<select><option>a<option>b<div>no</div></select><p>a") == ["a"]


def test_gradients():
    rng = np.random.default_rng(0)
    net = h.Labeller.fresh(1, width=5, hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, live = h._padded([rng.normal(size=(n, 5)) for n in (4, 2, 1)])
    x = x.astype(np.float64)
    wanted = rng.integers(0, 2, live.shape).astype(float)
    _, grads = net.gradients(x, live, wanted)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.w[name].shape)
            keep, eps = net.w[name][at], 1e-3
            net.w[name][at] = keep + eps
            up = net.gradients(x, live, wanted)[0]
            net.w[name][at] = keep - eps
            down = net.gradients(x, live, wanted)[0]
            net.w[name][at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), name


def test_pages_do_not_depend_on_their_company():
    rnd = random.Random(8)
    pages = [h.features(h.training_page(rnd)[0]) for _ in range(40)] + [np.zeros((0, h.WIDTH), np.float32)]
    together = h.trained().chances(pages)
    for k in (0, 7, 39, 40):
        assert np.allclose(together[k], h.trained().chances([pages[k]])[0], atol=1e-5)


def test_unseen_pages():
    rnd = random.Random(1234)
    samples = [h.training_page(rnd) for _ in range(300)]
    found = h.trained().chances([h.features(b) for b, _ in samples])
    right = np.concatenate([(p >= 0.5) == (y == 1) for p, (_, y) in zip(found, samples)])
    assert right.mean() > 0.99


def main_of(page):
    blocks = h.leaf_blocks(page)
    return [b.text for b, p in zip(blocks, h.trained().chances([h.features(blocks)])[0]) if p >= 0.5]


STORY = [
    "The old bridge over the river was closed for three years before the city found the money to build it again.",
    "Many people in the village said that they had never seen so much water, and the farmers lost most of the summer's work.",
    "A study by the school of science found that the winter would be long, and the army was asked to help.",
    "In the end the church and the market stood dry, and the children went back to school in the first days of the new year.",
]


def path_of(page):
    return h.features(h.leaf_blocks(page))[0][: h.PATH_BUCKETS]


def test_every_ancestor_and_class_word_counts():
    plain = path_of("<div>" * 30 + "<p>a")
    for k in (0, 9, 15, 21, 29):
        assert not np.allclose(plain, path_of("<div>" * k + '<div class="comments">' + "<div>" * (29 - k) + "<p>a")), k
        assert not np.allclose(plain, path_of("<div>" * k + "<aside>" + "<div>" * (29 - k) + "<p>a")), k
    looks = "flex px-2 mt-4 text-sm rounded shadow-lg md border"
    assert not np.allclose(path_of(f'<div class="{looks} sidebar"><p>a'), path_of(f'<div class="{looks}"><p>a'))
    assert np.allclose(path_of("<p>a"), path_of("<div class=x1>" * 40 + "</div>" * 40 + "<p>a"))  # what is closed is gone
    blocks = h.leaf_blocks("<div class=wide>" * 20000 + "<p>a")
    assert len(blocks[0].path) == 2 and len(blocks[0].above) == 2 * h.PATH_BUCKETS


def test_deep_and_late_markers():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    deep = lambda x, n: "<div>" * n + x + "</div>" * n
    said = "<p>The summer was long and the water low, as the people of the village know.</p>"
    for marked in ('<aside class="related">', '<nav class="menu">', '<footer class="footer">'):
        tag = marked[1:].split()[0]
        page = f"<body>{deep('<article>' + deep(story, 10) + '</article>', 10)}{deep(marked + deep(said, 10) + f'</{tag}>', 10)}</body>"
        assert main_of(page) == STORY, marked
    looks = "flex grid text border rounded shadow wide"
    page = f'<body><article>{story}</article><div class="{looks} comments"><div>{said}</div></div></body>'
    assert main_of(page) == STORY


NAV = '<a href="/">Home</a> | <a href="/news">News</a> | <a href="/about">About us</a>'
LIST = '<ul><li><a href="/1">One more story</a><li><a href="/2">Another</a></ul>'
COOKIES = "We use cookies to give you the best experience on our website. By continuing to use this site you accept our cookie policy."
SAID = "Thanks for sharing, great post. I agree with this article and will tell my friends of it."
P = "".join(f"<p>{x}</p>" for x in STORY)
D = "".join(f"<div>{x}</div>" for x in STORY)
#: Pages of unlike kinds; each has STORY as its main text.
LAYOUTS = {
    "plain": f"<article>{P}</article>",
    "no wrapper": f"<html><body>{P}</body></html>",
    "no semantic tags": f'<body><div class="menu">{NAV}</div><div class="content">{P}</div><div class="footer">&copy; 2020 Site. All rights reserved.</div></body>',
    "ids only": f'<body><div id="nav">{NAV}</div><div id="main">{P}</div><div id="sidebar">{LIST}</div></body>',
    "divs for paragraphs": f'<body><div class="nav">{NAV}</div><div class="post">{D}</div><div class="related">{LIST}</div></body>',
    "lines": f'<body><nav>{NAV}</nav><main>{"<br><br>".join(f"<p>{x}" for x in STORY)}</main></body>',
    "unclosed": f'<html><head><title>t</title><body><ul class=menu><li><a href=/>Home</a><li><a href=/a>News</a></ul><article>{"".join(f"<p>{x}" for x in STORY)}</article><footer><p>&copy; Site</footer>',
    "table": f'<table><tr><td class="menu">{NAV}</td><td class="content">{P}</td></tr></table>',
    "list of points": f'<nav>{NAV}</nav><article><ul>{"".join(f"<li>{x}</li>" for x in STORY)}</ul></article>',
    "quotes": f'<header><a href="/">Site</a></header><article><blockquote>{P}</blockquote></article><footer>Contact us</footer>',
    "headings": f'<main><h1>{STORY[0]}</h1><p>{STORY[1]}</p><h2>{STORY[2]}</h2><p>{STORY[3]}</p></main><aside><h3>Most read</h3>{LIST}</aside>',
    "aside within": f'<article><p>{STORY[0]}</p><aside class="related"><h3>Related articles</h3>{LIST}</aside><p>{STORY[1]}</p><p>{STORY[2]}</p><p>{STORY[3]}</p></article>',
    "advert within": f'<article><p>{STORY[0]}</p><p>{STORY[1]}</p><div class="ad">Buy now and save with free shipping</div><p>{STORY[2]}</p><p>{STORY[3]}</p></article>',
    "cookie notice in a plain div": f"<body><div>{COOKIES}</div><article>{P}</article></body>",
    "cookie notice below": f"<body><article>{P}</article><div>{COOKIES}</div></body>",
    "comments": f'<article>{P}</article><section class="comments"><h3>Comments</h3><div><b>Ann</b> {SAID}</div><div><b>Bob</b> {SAID}</div></section>',
    "comments as a list": f'<article>{P}</article><div id="comments"><ol><li>{SAID}</li><li>{SAID} Reply</li></ol></div>',
    "deep": "<div>" * 25 + f"<article>{P}</article>" + "</div>" * 25 + f"<footer>{NAV}</footer>",
    "utility classes": f'<div class="flex px mt text grid menu">{NAV}</div><article class="mx py max text">{P}</article><div class="grid mt bg footer">All rights reserved. Privacy policy</div>',
    "form": f'<form class="search-form"><label>Search</label><input name=q><button>Go</button></form><main>{P}</main><form><p>Sign up for our newsletter</p><input><button>Send</button></form>',
    "links in the text": f"<nav>{NAV}</nav><article>{''.join(f'<p><a href=/x>{x[:12]}</a>{x[12:]}</p>' for x in STORY)}</article>",
    "scripts between": f"<article><script>var a = '<p>no</p>';</script>{P}<style>p{{}}</style><noscript><p>Please enable scripts</p></noscript></article>",
    "xml endings": f'<script src="a.js"/>var t = 1;</script><body><nav>{NAV}</nav><article>{P.replace("<p>", "<p class=x >")}<br/><hr/><img src="a"/></article></body>',
    "upper case": f"<BODY><NAV>{NAV}</NAV><ARTICLE>{P.replace('<p>', '<P>').replace('</p>', '</P>')}</ARTICLE></BODY>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_unlike_layouts(name):
    assert main_of(LAYOUTS[name]) == STORY


def test_marks():
    assert texts('<p>a</p><script src="x"/>var a=1;</script><p>b') == ["a", "b"] == texts("<p>a<textarea/>x</textarea><p>b")
    assert texts("<p><a href=/>x</a> y</p>") == ["x y"] == texts("<div/><p>x <svg/>y")
    assert texts("<p>it <a title=it's>is</a> so</p>") == ["it is so"] and texts('<p>a <b title="x>y">c') == ["a c"]
    assert texts("a <!--> b <!-- c --!> d </3 e> f <3 g") == ["a b d f <3 g"] and texts("a <p") == ["a"]
    assert texts(f"<p>&#{'9' * 5000}; &#{'0' * 5000}65; &#x{'0' * 50}41; &#xFFFFFFFFFF;") == ["\ufffd A A \ufffd"]


@pytest.mark.parametrize(
    "page",
    ["<a " * 340_000, "<b>" * 340_000, '<a ="' * 200_000, "<a x='>" * 140_000, "<!--" * 250_000, "< " * 500_000, "<b>" * 20_000 + "<p>x</b>" * 20_000,
     "<ul>" * 20_000 + "<li>x" * 20_000, "<select>" * 120_000, "&#" * 500_000, "<p>" + "=" * 1_000_000, "<p " + 'class="' * 140_000, "<td><b></td>" * 80_000],
    ids=lambda p: p[:8],
)
def test_time_is_linear(page):
    import time

    took = []
    for own in (page[: len(page) // 4], page):
        began = time.perf_counter()
        h.leaf_blocks(own)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_long_blocks_have_words():
    long = " ".join(f"w{k}" for k in range(400))
    own = slice(h.PATH_BUCKETS, h.PATH_BUCKETS + h.WORD_BUCKETS)
    one, other = (h.features(h.leaf_blocks(f"<p>{x}"))[0][own] for x in (long, long + " cookies" * 40))
    assert np.linalg.norm(one) == pytest.approx(1) == np.linalg.norm(other) and not np.allclose(one, other)
    assert np.allclose(h.features(h.leaf_blocks("<p>The end."))[0][own], h.features(h.leaf_blocks("<p>the END"))[0][own])


def test_kept_weights(spark, tmp_path):
    first = h.kept(spark, str(tmp_path))
    again = h.kept(spark, str(tmp_path))
    assert first.w.keys() == again.w.keys() and all((first.w[k] == again.w[k]).all() for k in first.w) and first is not again


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = re.split(r"<(?:/?p|/?h1)>", body)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_layouts(spark):
    story = "".join(f"<p>{' '.join(f'word{k}{j}' for j in range(30))}.</p>" for k in range(4))
    want = "\n".join(f"{' '.join(f'word{k}{j}' for j in range(30))}." for k in range(4))
    page = (
        '<html><body><div class="cookie-notice"><p>We use cookies to make this page better for all.</p><button>ok</button></div>'
        '<header><a href=/>Site</a></header><nav class="menu"><a href=/a>Home</a> | <a href=/b>News</a></nav>'
        f'<article>{story}</article><aside class="sidebar"><h3>More</h3><ul><li><a href=1>One</a></ul></aside>'
        '<form class="search-form"><label>Search</label><input></form>'
        '<section class="comments"><h3>Comments</h3><div>I liked this a lot, thank you for it.</div></section><footer>&copy; Site</footer></body></html>'
    )
    rows = [(1, None, page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (None, "u", page, "x"), (1, None, page, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = h.extract_text(df).collect()
    assert [r.text for r in got] == [want, "", "", want, want]
    assert h.extract_text(df.limit(0)).count() == 0
