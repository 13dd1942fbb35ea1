"""Main text: pages written by hand (nothing of them is in the training pages), marginals against enumeration, odd rows."""

import itertools
import re
import time

import numpy as np

from quadloom.llm.dom import parse
from quadloom.llm.html_text import _LABEL, edge_kinds, extract, extract_pages, leaf_bucket, trained
from quadloom.llm.pagegen import labelled_pages

#: (html, main text blocks)
BY_HAND = [
    (
        """<html><body><div id="top"><a href="/">Harbour Gazette</a> <a href="/w">Weather</a> <a href="/s">Sport</a></div>
<div class="story"><h1>Ferry returns to the island after six years</h1><p class="byline">By Ana Lund, 4 May</p>
<p>The first ferry since the pier collapsed left at dawn on Tuesday, carrying forty passengers, two tractors and a brass band.</p>
<p>Islanders had campaigned for the crossing since 2018. &quot;We simply wouldn't give up,&quot; said the harbour master.</p>
<div class="ad-slot"><p>Save now on garden furniture! Order before Friday.</p></div>
<p>The service will run three times a week until October, when the council is to review its costs.</p></div>
<div class="comments"><h3>Comments</h3><p>Finally, I have waited so long for this.</p><p>Who is paying for it, though?</p></div>
<div id="footer">Harbour Gazette Ltd. All rights reserved.</div></body></html>""",
        ["Ferry returns to the island after six years", "The first ferry since the pier collapsed left at dawn on Tuesday, carrying forty passengers, two tractors and a brass band.", 'Islanders had campaigned for the crossing since 2018. "We simply wouldn\'t give up," said the harbour master.', "The service will run three times a week until October, when the council is to review its costs."],
    ),
    (
        """<body><h1>How I sharpen chisels</h1><p>A chisel is sharp when it pares end grain without tearing it. Everything else is decoration.</p>
<p>Flatten the back first. Use a coarse stone, and don't stop before the scratches reach the edge.</p><h2>The bevel</h2>
<p>Hold twenty-five degrees. I count forty strokes on the fine stone, then turn the blade over to remove the wire.</p>
<ul><li>Keep the stone wet.</li><li>Use its whole width.</li></ul><p>Then strop it on leather, and go and make something.</p></body>""",
        ["How I sharpen chisels", "A chisel is sharp when it pares end grain without tearing it. Everything else is decoration.", "Flatten the back first. Use a coarse stone, and don't stop before the scratches reach the edge.", "The bevel", "Hold twenty-five degrees. I count forty strokes on the fine stone, then turn the blade over to remove the wire.", "Keep the stone wet.", "Use its whole width.", "Then strop it on leather, and go and make something."],
    ),
    (
        """<html><body><header class="site-header"><h1>Orchard Docs</h1><nav><ul><li><a href="/i">Install</a></li><li><a href="/c">Configure</a></li></ul></nav></header>
<main><h2>Configure the cache</h2><p>The cache holds decoded tiles. Its size is set in megabytes and defaults to a quarter of the memory.</p>
<pre>cache:
  size: 512</pre><p>After a change, restart the service; entries that no longer fit are evicted, the oldest first.</p></main>
<aside><h3>On this page</h3><a href="#1">Size</a> <a href="#2">Eviction</a></aside><footer><p>Orchard Docs 3.2 &ndash; licence</p></footer></body></html>""",
        ["Configure the cache", "The cache holds decoded tiles. Its size is set in megabytes and defaults to a quarter of the memory.", "cache: size: 512", "After a change, restart the service; entries that no longer fit are evicted, the oldest first."],
    ),
    (
        """<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=index.html>Home</a> | <a href=links.html>Links</a> | <a href=guest.html>Guestbook</a></td></tr>
<tr><td width=120><a href=a.html>Trains</a><br><a href=b.html>Trams</a><br><a href=c.html>Timetables</a></td>
<td><h2>The narrow line over the pass</h2><p>Built between 1903 and 1908, the line climbs eleven hundred metres in nineteen kilometres, all of it by adhesion.
<p>Snow closed it every winter until the long gallery was finished, and the last steam engine ran over it in 1954.
<p>Today's trains take fifty minutes. Sit on the left going up.</td></tr></table></body></html>""",
        ["The narrow line over the pass", "Built between 1903 and 1908, the line climbs eleven hundred metres in nineteen kilometres, all of it by adhesion.", "Snow closed it every winter until the long gallery was finished, and the last steam engine ran over it in 1954.", "Today's trains take fifty minutes. Sit on the left going up."],
    ),
    (
        """<html><body><div class="cookie-banner"><p>We and our partners store cookies.</p><button>Accept</button></div><nav class="main-nav"><a href="/r">Recipes</a><a href="/a">About</a></nav>
<article class="recipe"><header><h1>Barley soup</h1></header><p>Enough for four on a cold evening, and better on the second day.</p>
<ul><li>200 g pearl barley</li><li>Two leeks, sliced</li><li>A litre and a half of stock</li></ul>
<p>Soften the leeks slowly, stir in the barley and let it toast for a minute before the stock goes in.</p><p>Simmer for fifty minutes; season at the very end.</p>
<div class="newsletter-signup"><form><label>Get a recipe every week</label><input type=email></form></div></article>
<section class="related"><h3>You may also like</h3><ul><li><a href="/1">Pea soup</a></li><li><a href="/2">Rye bread</a></li></ul></section></body></html>""",
        ["Barley soup", "Enough for four on a cold evening, and better on the second day.", "200 g pearl barley", "Two leeks, sliced", "A litre and a half of stock", "Soften the leeks slowly, stir in the barley and let it toast for a minute before the stock goes in.", "Simmer for fifty minutes; season at the very end."],
    ),
    (
        """<html><body><header><a href="/">Valley Museum</a></header><section><h2>The loom room</h2><p>Twelve hand looms stand where the weavers left them when the mill closed its doors.</p>
<p>Visitors may try two of them on Sundays, under the eye of somebody who learned the trade here.</p></section>
<section><h2>The dye house</h2><p>Madder, weld and woad grew in the yard, and the vats still smell of them on warm days.</p></section><footer><p>Open daily except Monday. <a href="/t">Tickets</a></p></footer></body></html>""",
        ["The loom room", "Twelve hand looms stand where the weavers left them when the mill closed its doors.", "Visitors may try two of them on Sundays, under the eye of somebody who learned the trade here.", "The dye house", "Madder, weld and woad grew in the yard, and the vats still smell of them on warm days."],
    ),
]


def test_pages_by_hand():
    right = found = wanted = 0
    for (_, blocks), text in zip(BY_HAND, extract([h for h, _ in BY_HAND], trained()), strict=True):
        got = text.split("\n\n") if text else []
        right += len(set(got) & set(blocks))
        found, wanted = found + len(got), wanted + len(blocks)
    assert right / wanted >= 0.9 and right / found >= 0.9, (right, found, wanted)  # 30 of 32, all right, when this was written: a bare list of short items is missed


def test_page_forms_of_text():
    s = "The committee met twice in spring and once more in autumn to agree on the wording."
    pages = {
        f"<body><p>{s}</p><p>{s} Again.</p><p>{s} More.</p></body>": 3,
        f"<body><h1>On wording</h1><p>{s}</p><p>{s} Again.</p><p>{s} More.</p></body>": 4,
        f"<body><header><a href=/>Site</a></header><section>{''.join(f'<p>{s} {i}.</p>' for i in range(5))}</section><footer>Imprint</footer></body>": 5,
        f"<body><table><tr><td><a href=/>Home</a></td><td><h1>Wording</h1><p>{s}</p><p>{s} Two.</p></td></tr></table></body>": 3,
        f"<article><p>{s}</p><object><p>{s} Two.</p><svg><p>{s} Three.</p></article>": 3,
    }
    for (html, n), text in zip(pages.items(), extract(list(pages), trained()), strict=True):
        assert len(text.split("\n\n")) == n, html
    assert extract([f"<article><p>Here <math><mi>x</mi>=<mn>2</mn></math>, and visible<button>x</button> tail. {s}</p></article>"], trained()) == [f"Here x=2, and visiblex tail. {s}"]


def test_nesting_is_linear():
    took = []
    for n in (4000, 16000):
        began = time.process_time()
        parse("<ul><p>" * n)
        parse("<div>" * n + "<li>x" * n + "</i></b></td>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_marginals_equal_enumeration():
    """All states of small trees, weighed by the same potentials."""
    model = trained()
    for html in ("<p>One two three.</p>", "<div class=nav><a href=/>A</a></div><p>Some words here.</p>", "<main><h1>T</h1><p>Text of it.</p></main>", "<table><tr><td>a</td><td class=content>Words, words.</td></tr></table>"):
        t = parse(html)
        n = len(t.parent)
        own = np.zeros((n, 3))
        groups: dict = {}
        for k in range(n):
            up = t.parent[k]
            key = (t.tag[up] if k else "", t.tag[k], t.attrs[k]) if t.text[k] is None else leaf_bucket(t.text[k], t.linked[k], t.tag[k])
            own[k] = model.node(*key) if t.text[k] is None else model.leaf(key)
            groups.setdefault((up if t.text[k] is None else t.parent[up], key), []).append(k)
        for same in groups.values():
            own[same] *= (1 + np.log(len(same))) / len(same)
        edges = [None] + [model.edge(edge_kinds(t.tag[t.parent[k]], t.tag[k] if t.text[k] is None else "#text", not t.attrs[k])) for k in range(1, n)]
        weight = np.zeros((n, 3))
        for states in itertools.product(range(3), repeat=n):
            log = model.root[states[0]] + sum(own[k, x] for k, x in enumerate(states)) + sum(edges[k][states[t.parent[k]], states[k]] for k in range(1, n))
            weight[np.arange(n), states] += np.exp(log)
        assert np.allclose(model.marginals([t])[0], weight[:, 0] / weight.sum(1), atol=1e-9), html


def test_page_model_held_out():
    model, right, total = trained(), 0, 0
    for html in labelled_pages(150, seed=77):
        marked, plain = parse(html), parse(re.sub(r' data-y="[01]"', "", html))
        label = [0] * len(marked.parent)
        for k in range(1, len(label)):
            m = _LABEL.search(marked.attrs[k])
            label[k] = int(m[1]) if m else label[marked.parent[k]]
        p = model.marginals([plain])[0]
        for k, t in enumerate(plain.text):
            if t is not None:
                total += 1
                right += (p[k] >= 0.5) == bool(label[k])
    assert right / total > 0.98


def test_page_forms():
    page = '<html><head><title>no</title><script>var x="</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>One\n two&nbsp;&lt;b&gt;.<p>Three <b>bold</b><br>four.</article><section id="comments"><p>Nice one!</p></section><footer>&copy; me'
    text = "A & B\n\nOne two <b>.\n\nThree bold four."
    assert extract([page, None, "", "<", "<p", "<div" * 3000], trained())[:3] == [text, "", ""]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert len(extract([deep], trained())) == 1


def test_page_rows(spark):
    page, blocks = BY_HAND[0]
    long_one = "<article>" + "<p>A sentence that says a little about something.</p>" * 3000 + "</article>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (1, "v", None, None, None), (None, None, "", "x", None), (2, "w", long_one, "x", "y")]
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).collect()
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found), key=str) == sorted(
        [(1, "u", "\n\n".join(blocks), len("\n\n".join(blocks)))] * 2 + [(1, "v", "", 0), (None, None, "", 0), (2, "w", "\n\n".join(["A sentence that says a little about something."] * 3000), 3000 * 48 - 2)], key=str
    )
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
