"""Main texts through wrappers: generated hosts with known texts, deep and unclosed pages, shared ids."""

import random

import pytest
from pyspark.sql import functions as F

from arborscan.llm import htmltext


def rendered(parts, own):
    """A page of a host's layout and its own text: fixed parts are the same on every page, ``*`` parts repeat, ``?`` parts may be missing."""
    out, texts = [], []
    for kind, tag, fixed in parts:
        if kind == "fixed":
            out.append(f"<{tag}>{fixed}</{tag}>")
            continue
        for _ in range({"slot": 1, "*": own.randint(1, 5), "?": own.randint(0, 1)}[kind]):
            texts.append(f"own {own.random()} &amp; {own.randint(0, 9)}")
            out.append(f"<{tag}><b>{texts[-1]}</b></{tag}>")
    return f"<html><body><div class=page>{''.join(out)}</div></body></html>", " ".join(texts).replace("&amp;", "&")


@pytest.mark.parametrize("seed", range(40))
def test_generated_hosts_give_their_own_texts(seed):
    layout = random.Random(seed)
    tags = ["p", "h2", "section", "blockquote", "pre", "h3"]
    # neighbours differ in tag, so that a place is told by its tag or its text
    parts = [(layout.choice(["fixed", "fixed", "slot", "*", "?"]), tags[i % len(tags)], f"Template {i} text") for i in range(layout.randint(2, 12))]
    parts.append(("slot", "div", ""))
    pages = [rendered(parts, random.Random(1000 * seed + n)) for n in range(30)]
    wrapper = htmltext.Wrapper.from_json(htmltext.learned([page for page, _ in pages[:8]]).to_json())
    fits = 0
    for page, text in pages:
        got, fit = htmltext.extracted(page, wrapper)
        fits += fit
        assert not fit or got == text
        assert all(piece in got for piece in text.split("own ")[1:])
    assert fits >= 8  # at least the pages it has learned from


def test_a_fixed_text_among_equal_tags():
    def page(n, story):
        return "<body><div><p>We hope you like it</p>" + "".join(f"<p>{n} {s}</p>" for s in story) + "<ul><li>Home</li><li>Shop</li></ul></div></body>"

    wrapper = htmltext.learned([page(n, "abcd"[: 1 + n % 3]) for n in range(6)])
    assert htmltext.extracted(page(9, "vwxyz"), wrapper) == ("9 v 9 w 9 x 9 y 9 z", True)
    assert htmltext.extracted(page(9, "v"), None) == ("We hope you like it 9 v Home Shop", False)
    # another text where the template's stood is the page's own
    assert htmltext.extracted(page(9, "vw").replace("Shop", "Sale"), wrapper) == ("9 v 9 w Sale", True)
    # few pages, copies of one page: no template texts
    assert not htmltext.learned([page(n, "ab") for n in range(3)]).fixed and not htmltext.learned([page(1, "ab")] * 8).fixed
    # a marked article keeps texts that all pages share, and a page that is all template is read by its tags
    article = [f"<body><p>Top</p><article><p>Shared</p><p>{n}</p></article></body>" for n in range(8)]
    assert htmltext.extracted(article[3], htmltext.learned(article)) == ("Shared 3", True)
    bare = htmltext.learned([f"<body><p>Same</p>{'<h2>x%d</h2>' % n}</body>" for n in range(8)])
    assert htmltext.extracted("<body><p>Same</p></body>", bare) == ("Same", False)


def test_wide_repeats_are_folded():
    tags = [f"t{i}x" for i in range(90)]
    unit = " ".join(f"{t} # /{t}" for t in tags)
    wrapper = htmltext.Wrapper(htmltext.infer([f"body {' '.join([unit] * n)} /body".split() for n in (2, 3)]))
    assert wrapper.span(f"body {' '.join([unit] * 7)} /body".split()) is not None
    assert wrapper.span(f"body {' '.join([unit] * 7)} t1x # /t1x /body".split()) is None


def test_deep_and_unclosed_pages():
    deep = "<div>" * 5000 + "<p>own {}</p>"
    wrapper = htmltext.Wrapper.from_json(htmltext.learned([deep.format(n) for n in range(5)]).to_json())
    assert htmltext.extracted(deep.format("x"), wrapper) == ("own x", True)
    assert htmltext.extracted("<div>" * 50_000 + "x" + "</ul></p></h1>" * 50_000, None) == ("x", False)


def test_all_articles_of_a_page():
    page = ("<body><article>Before</article><main><article><h1>One</h1><p>a</p></article><aside><article>Related</article></aside><article>Two</article></main>"
            "<section id=comments><article>Reader</article></section></body>")
    assert htmltext.extracted(page, None)[0] == "Before One a Two"
    assert htmltext.extracted("<main>All <p>of it</p></main><p>Rest</p>", None)[0] == "All of it"
    assert htmltext.extracted("<div class=widget><article>Only one</article></div>", None)[0] == "Only one"


def test_a_page_id_that_many_rows_share(spark):
    rows = [(1, "http://h.example/1", f"<body><p>Fixed</p><p>own {i}</p></body>") for i in range(60)]
    rows += [(i, f"http://h.example/{i}", f"<body><p>Fixed</p><p>own {i}</p></body>") for i in range(2, 40)] + [(None, "http://h.example/n", "<p>null</p>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = htmltext.extract(df, htmltext.learn(df)).collect()
    assert len(got) == len(rows)
    assert sorted(r.text for r in got if r.page_id == 1) == sorted(f"own {i}" for i in range(60))
    assert {r.text for r in got if r.page_id and r.page_id > 1} == {f"own {i}" for i in range(2, 40)}
    assert [r.text for r in got if r.page_id is None] == ["null", "null"]


def test_all_pages_of_a_host_teach(spark):
    def html(i):
        # every 40th page has a box of its own kind, every 30th another text in the footer's place
        box = f"<section><h4>box {i}</h4></section>" if i % 40 == 7 else ""
        foot = f"Other {i}" if i % 30 == 11 else "All rights"
        return f"<body><p>Fixed</p><h2>own {i}</h2>{box}<div><b>{'Story ' * (1 + i % 3)}{i}</b></div><address>{foot}</address></body>"

    def text(i):
        return f"own {i} " + (f"box {i} " if i % 40 == 7 else "") + "Story " * (1 + i % 3) + str(i) + (f" Other {i}" if i % 30 == 11 else "")

    rows = [(i, "http://h.example/x", html(i)) for i in range(400)] + [(400 + i, "http://few.example/x", html(i)) for i in range(3)]
    df = spark.createDataFrame(rows + [(500, "http://null.example/", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltext.extract(df.repartition(7), htmltext.learn(df.repartition(7))).collect()}
    assert all(got[i].fits and got[i].text == text(i) for i in range(400))
    assert all(got[400 + i].text.startswith("Fixed own") for i in range(3)) and got[500].text == ""
    # wrappers depend on the pages alone
    first, second = (sorted(map(tuple, htmltext.learn(part).collect())) for part in (df.coalesce(1), df.orderBy(F.desc("page_id")).repartition(5)))
    assert first == second


def test_shapes_align_in_any_number():
    pages = [f"<body><h1>{i}</h1>{'<p>a</p>' * (i % 4)}{'<ul><li>x %d</li></ul>' % i if i % 5 == 0 else ''}{'<pre>c</pre>' if i % 7 == 3 else ''}<h3>{i}</h3></body>" for i in range(80)]
    wrapper = htmltext.learned(pages)
    assert all(htmltext.extracted(page, wrapper)[1] for page in pages)
    assert htmltext.extracted("<body><h1>1</h1><table><tr><td>2</td></tr></table></body>", wrapper)[1] is False


def test_kinds_of_pages():
    def told(page):
        return htmltext.kind(htmltext.tokens(page))

    assert told("<body><p>a</p><p>b</p></body>") == told("<body><p>c</p></body>") and told("") == told("text alone") == 0
    unlike = [f"<body><{t} class=x{chr(97 + i % 26)}{t}><p>a</p></{t}></body>" for i, t in enumerate(["div", "section", "ul", "pre", "table"] * 10)]
    assert len({told(page) for page in unlike}) > 20
