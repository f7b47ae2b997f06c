import itertools
import random

from siltstone.llm import html


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Example, all rights reserved.</footer>"


def test_article_without_boilerplate():
    got = html.main_text(page(f'<header><h2>Site</h2></header>{MENU}<div class="ad">Buy this now, it is good.</div><article><h1>A  title</h1><p>One &amp;\n two &eacute;<br>three.</p><p>Is.</p><div class="comments"><p>I like this, a lot.</p></div></article><aside><p>Other texts, to read.</p></aside><form><label>Mail</label><input></form>{FOOT}'))
    assert got == "A title\n\nOne & two é three.\n\nIs."


def test_no_article_element():
    text = "This is a longer paragraph of an article, with some commas, and full stops. It goes on for a while. "
    got = html.main_text(page(f'<div id="top-menu"><a href=x>Home</a> <a href=y>About</a></div><div class="post-content"><h1>Heading</h1><p>{text}</p><p>{text}</p><p>Short one.</p></div><div class="cookie-notice">We use cookies, as you know.</div><div class="sidebar"><p>{text}</p></div>{FOOT}'))
    assert got == "\n\n".join(["Heading", text.strip(), text.strip(), "Short one."])


def test_headers_by_name():
    got = html.main_text(page('<div class="site-header"><p>A site, with a motto, here.</p></div><article><div class="article-header"><h1>Title</h1></div><p>Text, of it.</p><p class="notice">Moved, since then.</p></article>'))
    assert got == "Title\n\nText, of it."


def test_broken_markup():
    assert html.main_text("<article><h1>T<p><b>One.<br><p>Two, three.</div><p>Four") == "T\n\nOne.\n\nTwo, three.\n\nFour"
    assert html.main_text("<article><p a='>'>x < y & z</p><!-- <p>no --><p>&#233;&#x4e2d;</p><script>1") == "x < y & z\n\né中"
    for bad in (None, "", "   ", "<", "<p", "&", "<!--", "<script>", "</p></p>", "<a" * 200):
        assert isinstance(html.main_text(bad), str)
    assert html.main_text("plain words, and nothing else.") == "plain words, and nothing else."


def test_cut_is_the_least_of_all_labellings():
    r = random.Random(2)
    for _ in range(150):
        n = r.randint(1, 8)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda y: sum(abs(s) for s, v in zip(scores, y) if (s > 0) != v) + sum(w for a, b, w in edges if y[a] != y[b])
        assert abs(cost(html.min_cut(scores, edges)) - min(cost(y) for y in itertools.product([False, True], repeat=n))) < 1e-6


def test_the_cut_corrects_what_a_blocks_own_text_says():
    """Planted wrong scores: long texts in boilerplate, bare words in an article."""
    long = "A long text, with commas, full stops. It reads like an article of its own, and goes on. " * 3
    r, corrected = random.Random(5), 0
    for _ in range(40):
        inside = [long if r.random() < 0.5 else r.choice(["Yes", "1984", "The end", "Table two"]) for _ in range(r.randint(1, 9))]
        outside = [long if r.random() < 0.6 else r.choice(["Log in", "Share"]) for _ in range(r.randint(1, 9))]
        tags = [r.choice(["p", "div", "li"]) for _ in outside]
        away = r.choice(["aside", 'div class="comments"', 'section id="related"', "footer"])
        name = away.split()[0]
        main = r.choice(["article", "main"])
        text = page(f"<{main}>" + "".join(f"<p>{x}</p>" for x in inside) + f"</{main}><{away}><div>" + "".join(f"<{k}>{x}</{k}>" for k, x in zip(tags, outside)) + f"</div></{name}>")
        found, tree = html.blocks(text)
        kept = [b.text for b, ok in zip(found, html.label(found, tree)) if ok]
        assert kept == [x.strip() for x in inside]
        corrected += sum((html.score(b) > 0) != ok for b, ok in zip(found, html.label(found, tree)))
    assert corrected > 60
    text = "<body><div>" + "".join(f"<p>{x}</p>" for x in (long, long, "Yes", long, long)) + '</div><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></body>'
    assert html.main_text(text) == "\n\n".join([long.strip(), long.strip(), "Yes", long.strip(), long.strip()])


def test_long_and_deep_pages():
    import time

    began = time.time()
    each = "".join(f"<p>Paragraph number {i}, of some length, with words.</p><div class='x'><a href=z>Buy {i}</a></div>" for i in range(50_000))
    found, tree = html.blocks(page(each))
    assert len(found) == 100_000 and sum(html.label(found, tree)) > 0
    deep = page("<div>" * 30_000 + "<p>Text, in depth, of an article.</p>" + "</div>" * 30_000 + "<p>More of it, here.</p>")
    assert html.main_text(deep).count("\n\n") == 1
    assert time.time() - began < 40


def test_long_pages():
    body = "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(3000))
    assert html.main_text(page(f"{MENU}<article>{body}</article>{FOOT}")).count("\n\n") == 2999


def test_table(spark):
    rows = [(1, "u", page("<article><p>Text, here.</p></article>"), "clash"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", "y")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "Text, here.", 11), (2, "", 0), (2, "", 0)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
