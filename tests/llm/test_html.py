import html as entities
import itertools
import re

import numpy as np

from loomscreen.llm import html
from loomscreen.llm.queries import QUERIES


def test_sum_product_by_brute_force():
    rng = np.random.default_rng(0)
    pages = ["<div><p>a<b>x</b></p><ul><li>c</li></ul></div>", "<p>z"]
    f = html.forest([html.parse(p) for p in pages])
    score, pair = rng.standard_normal(len(f.parents)), rng.standard_normal((2, 2))
    got, _ = html.sum_product(f, score, pair)
    for a, b in itertools.pairwise(f.first):
        total = np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = sum(score[a + i] * k for i, k in enumerate(y)) + sum(pair[y[f.parents[a + i] - a], k] for i, k in enumerate(y) if f.parents[a + i] >= 0)
            for i, k in enumerate(y):
                total[i, k] += np.exp(s)
        np.testing.assert_allclose(got[a:b], total / total.sum(axis=1, keepdims=True), rtol=1e-9)


def test_query(spark):
    """The tables' pages mark their article; its blocks are paragraphs and headings."""
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op9_html_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_pages():
    model, rng, right = html.train(), np.random.default_rng(77), []
    for _ in range(120):
        page, labels = html._labelled(rng)
        t = html.parse(page)
        right.append(html.extract_texts(model, [page])[0] == html.text_of(t, np.array([True, *labels])))
    assert np.mean(right) > 0.9


PAGE = """<!doctype html><html><head><title>T</title><script>if (a<b) {"<p>"}</script></head><body>
<div id="cookie-notice"><p>We use cookies. Accept them?</p></div><nav><a href=/>Home</a></nav>
<div class=sidebar><h3>Related</h3><ul><li><a href=x>Other</a></ul></div>
<article class="post"><h1>A &amp; B</h1><p>One  two
three, <b>four</b>.<br>Five six seven, eight nine ten.<p>Caf&eacute; &#8364; and a longer sentence, with words.
<table><tr><td>cell one<td>cell two</table><form><input><label>mail</label></form></article>
<section class="comments"><div class="comment"><p>First! Nice article, I think.</p></div></section>
<footer>&copy; me</footer>"""


def test_edges(spark):
    got = html.extract_texts(html.train(), [PAGE, "", "plain text only, without any tag.", "<p>unclosed <b>bold<p>next", "<" * 50, "<div " * 20, "<script>x"])
    assert got[0].split("\n") == ["A & B", "One two three, four. Five six seven, eight nine ten.", "Café € and a longer sentence, with words.", "cell one", "cell two"]
    assert got[1] == "" and got[6] == ""
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (4, "u", "<article><p>" + "word " * 100_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = sorted((r.page_id, r.n_chars) for r in html.extract(df).collect())
    assert [k for k, _ in out] == [1, 2, 3, 3, 4] and out[0][1] == out[1][1] == 0 and out[4][1] == 499_999
    assert html.extract(df.limit(0)).collect() == []


def test_hidden_elements():
    """Only attributes and styles that hide an element drop it, not the word in names, labels or other values."""
    shown = ['aria-hidden="false"', "data-hidden", 'data-hidden="true"', 'style="overflow: hidden"', 'style="color: red; overflow:hidden;"', 'class="overflow hidden md:block"', 'aria-label="Hidden gems"', 'id="hidden gems"', 'title="the hidden=true one"', 'style="display: none; display: block"', "style=\"background: url('a;display:none')\""]
    gone = ["hidden", "HIDDEN=''", 'class="x" hidden', 'hidden="hidden"', 'aria-hidden="true"', "aria-hidden=true", 'style="display:none"', 'style="color:red;DISPLAY : None !important; display: block"', "style='visibility: hidden'"]
    for names, want in [(x, "Some text.\nMore of it.") for x in shown] + [(x, "Some text.") for x in gone]:
        t = html.parse(f"<article><p>Some text.</p><div {names}><p>More <b>of</b> it.</p></div></article>")
        assert html.text_of(t, np.ones(len(t.tags), dtype=bool)) == want, names
    t = html.parse("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p></div>")
    assert html.text_of(t, np.ones(len(t.tags), dtype=bool)) == "yes"


def _all(page):
    t = html.parse(page)
    return html.text_of(t, np.ones(len(t.tags), dtype=bool))


def test_elements_within_words():
    """Only line breaks are white space; references are decoded within one text."""
    assert _all("<p>super<wbr>cali<wbr/>fragil and foo<img src=x>bar<input>baz</p>") == "supercalifragil and foobarbaz"
    assert _all("<p>one<br>two<br/>three</p><hr><p>four</p>") == "one two three\nfour"
    assert _all("<p>&am<b>p;</b> &<i>lt;</i>b &amp;<b>lt;</b> &am<!-- x -->p;</p>") == "&amp; &lt;b &lt; &amp;"
    assert _all("<p>a&nbsp;b &#32; c</p><pre>x  y\n z</pre>") == "a b c\nx y z"
    assert _all('<p class="hidden sm:block">shown</p><p id=hidden>too</p><p hidden>not</p>') == "shown\ntoo"


def test_formulas_drawings_and_dialogs():
    """Formulas, labels, maps and open dialogs are text; their unseen parts, closed dialogs and fallbacks aren't."""
    assert _all("<p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> as known</p>") == "The energy is E=m as known"
    assert _all("<p>See <svg><title>t</title><desc>d</desc><defs><text>x</text></defs><circle r=1/><text>label</text></svg> here</p><p>More.</p>") == "See label here\nMore."
    assert _all("<map><p>In a map.</p><area></map><dialog open><p>Shown.</p></dialog><dialog><p>Closed.</p></dialog>") == "In a map.\nShown."
    assert _all("<p>a</p><object>no</object><video>no</video><canvas>no</canvas><form><p>no</p></form><p>b</p>") == "a\nb"
    model = html.train()
    page = BY_HAND[1][0]
    for old, new in [("<p>Burn what you cut", '<p>Use <math><mn>3</mn><mo>+</mo><mn>4</mn></math> buds.</p><p>Burn what you cut'), ("<p>Burn what you cut", '<map name=m><p>Roses of the north garden, by age and colour.</p></map><p>Burn what you cut')]:
        got = html.extract_texts(model, [page.replace(old, new)])[0]
        assert "Use 3+4 buds." in got or "Roses of the north garden, by age and colour." in got
        assert "Tweet" not in got and "Burn what you cut" in got


#: Pages written by hand, in layouts that the generator doesn't write, and their main text.
BY_HAND = [
    (
        """<html><body><table width=100%><tr><td colspan=2 class=logo><a href=/>The Daily</a></td></tr><tr><td class=menu><a href=1>News</a><br><a href=2>Sport</a><br><a href=3>Weather</a></td>
<td class=story><h1>River rises again</h1><p>The river rose by two metres overnight, officials said on Monday.</p><p>Residents were asked to move, and <i>most</i> of them did so before dawn.</p></td></tr>
<tr><td colspan=2 class=footer>Copyright the Daily. All rights reserved.</td></tr></table></body></html>""",
        "River rises again\nThe river rose by two metres overnight, officials said on Monday.\nResidents were asked to move, and most of them did so before dawn.",
    ),
    (
        """<body class="single-post"><div id="top-nav" class="navbar"><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></div><div class="hentry"><div class="entry-content">
<h2>How to prune roses</h2><p>Wait until the frost is over, then cut back to three buds.</p><blockquote><p>A sharp blade, my teacher said, is half of the work.</p></blockquote><p>Burn what you cut, as it may carry disease.</p></div></div>
<div class="sharedaddy share"><a href="#">Tweet</a><a href="#">Pin</a></div><ol class="comment-list"><li class="comment"><p>Thanks, this helped me a lot with mine.</p></li></ol><div class="widget"><h3>Popular</h3><ul><li><a href=x>Tulips</a></li></ul></div></body>""",
        "How to prune roses\nWait until the frost is over, then cut back to three buds.\nA sharp blade, my teacher said, is half of the work.\nBurn what you cut, as it may carry disease.",
    ),
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Docs</title></head><body><a class="skip-link" href="#m">Skip to content</a><header role="banner"><div class="site-logo">Docs</div></header><div class="layout"><nav class="toc"><ul><li><a href=#a>Install</a></li><li><a href=#b>Use</a></li></ul></nav>
<main id="m"><section><h1>Install</h1><p>Run the installer, then restart the service. It takes about a minute.</p><pre><code>install --now</code></pre></section><section><h2>Use</h2><p>Open the page in any browser, and sign in with your key.</p><ul><li>Keys last a year.</li><li>They can be renewed, once only.</li></ul></section></main></div><footer class="site-footer"><p>Edit this page. Licensed freely.</p></footer></body></html>""",
        "Install\nRun the installer, then restart the service. It takes about a minute.\ninstall --now\nUse\nOpen the page in any browser, and sign in with your key.\nKeys last a year.\nThey can be renewed, once only.",
    ),
    (
        """<div class="cookie-banner" role="dialog"><p>We value your privacy, so please accept all cookies.</p><button>OK</button></div><div id=page><div class="advertisement">Buy one, get two.</div><article itemprop="articleBody"><header><h1>Moon base plans</h1></header><p>Engineers showed a plan on Friday, in some detail.</p><div class="ad-slot sponsored">Sponsored: cheap flights, today only.</div><p>The first crew would land in ten years, they said.</p><figure><img src=m.jpg><figcaption>A drawing of the base.</figcaption></figure></article><aside class="related"><h4>More</h4><a href=y>Mars</a></aside></div>""",
        "Moon base plans\nEngineers showed a plan on Friday, in some detail.\nThe first crew would land in ten years, they said.\nA drawing of the base.",
    ),
    (
        """<body><div class="masthead"><a href=/>Chronicle</a><span class="tagline">Since 1901</span></div><div class="breadcrumbs"><a href=/a>Home</a> / <a href=/b>Science</a></div><div role="main"><h1>Bees count to four</h1><p class="lead">Honey bees can tell three dots from four, a study of two hundred hives found.</p><p>The insects were shown cards, and rewarded with sugar when they chose well.</p></div><div class="newsletter-signup"><form><p>Get our letter.</p><input name=e><button>Join</button></form></div><div id="footer"><ul><li><a href=x>Terms</a></li><li><a href=y>Privacy</a></li></ul></div></body>""",
        "Bees count to four\nHoney bees can tell three dots from four, a study of two hundred hives found.\nThe insects were shown cards, and rewarded with sugar when they chose well.",
    ),
    (
        """<html><body><nav><a href=1>Index</a><a href=2>Search</a></nav><section class="post"><h2>Bread without yeast</h2><ol><li>Mix the flour with water, and leave it for a day.</li><li>Feed the dough each morning, for a week or so.</li><li>Bake it in a hot oven, with some steam.</li></ol><p>Eat it warm, with butter.</p></section><section id="comments"><h3>Comments</h3><div class="comment"><p>Mine went mouldy, what did I do wrong?</p></div><div class="comment"><p>Use less water, I would say.</p></div></section></body></html>""",
        "Bread without yeast\nMix the flour with water, and leave it for a day.\nFeed the dough each morning, for a week or so.\nBake it in a hot oven, with some steam.\nEat it warm, with butter.",
    ),
    (
        """<body><div id=wrap><div id=sidebar><h4>Archives</h4><ul><li><a href=1>May</a></li><li><a href=2>June</a></li></ul></div><div id=content class="article-body"><h1>On tides</h1><p>The sea rises twice a day, as the moon pulls at it.</p><table><tr><th>Port</th><th>Height</th></tr><tr><td>Dover</td><td>6.7 metres</td></tr></table><p>Spring tides come at the new moon and the full moon, when the sun adds its share.</p></div></div><div class="cookie-notice"><p>This site uses cookies. <a href=c>Learn more</a></p></div></body>""",
        "On tides\nThe sea rises twice a day, as the moon pulls at it.\nPort\nHeight\nDover\n6.7 metres\nSpring tides come at the new moon and the full moon, when the sun adds its share.",
    ),
    (
        """<body><center><font size=5>My trip to the lakes</font></center><p>We left at six, in the rain, and had breakfast on the road.<p>By noon the sky was clear; we rowed out to the island and swam.<p>Nobody wanted to go home, least of all the dog.<hr><a href=index.html>Back</a> | <a href=next.html>Next</a></body>""",
        "My trip to the lakes\nWe left at six, in the rain, and had breakfast on the road.\nBy noon the sky was clear; we rowed out to the island and swam.\nNobody wanted to go home, least of all the dog.",
    ),
    (
        """<body><header class="global-header"><ul class="menu"><li><a href=a>Shop</a></li><li><a href=b>Help</a></li></ul></header><main><article><h1>Why steel rusts</h1><p>Iron gives electrons to oxygen, and water carries them.</p><p>The rate follows <math><mi>k</mi><mo>=</mo><mi>A</mi></math> at a given heat, more or less.</p><blockquote>Paint it, or lose it.</blockquote></article><aside class="promo"><p>Save ten percent on primer today!</p></aside></main><footer><p>All rights reserved, 2024.</p></footer></body>""",
        "Why steel rusts\nIron gives electrons to oxygen, and water carries them.\nThe rate follows k=A at a given heat, more or less.\nPaint it, or lose it.",
    ),
    (
        """<div class="page"><div class="top-banner ad">Win a car!</div><div class="story-content"><h1 class="headline">Old bridge to close</h1><div class="text"><p>The bridge over the Wye will close in March, for two years.</p><p>Its stones have shifted, engineers said, and the arches need new mortar.</p></div><div class="related-links"><h5>Related</h5><a href=1>Road works</a><a href=2>Bus routes</a></div><div class="text"><p>Walkers may use the ferry, which runs from dawn to dusk.</p></div></div><div class="social-share"><a href=#>Share</a></div></div>""",
        "Old bridge to close\nThe bridge over the Wye will close in March, for two years.\nIts stones have shifted, engineers said, and the arches need new mortar.\nWalkers may use the ferry, which runs from dawn to dusk.",
    ),
]


def test_pages_by_hand():
    """Blocks of pages that no generator wrote: nearly all of the main text's, and hardly any other."""
    model, want, got, both = html.train(), 0, 0, 0
    for page, text in BY_HAND:
        a, b = set(text.split("\n")), set(html.extract_texts(model, [page])[0].split("\n"))
        want, got, both = want + len(a), got + len(b), both + len(a & b)
    assert both >= 0.9 * want and both >= 0.9 * got, (want, got, both)
