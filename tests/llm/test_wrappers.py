"""Wrappers over planted templates, forgiving parsing, and edge cases."""

import html
import random

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import wrappers as W  # noqa: E402

JUNK = [
    '<aside class="x">side</aside>', '<div class="cookie-notice">we use cookies</div>', "<form><input><p>write us</p></form>", '<div id="ad-12">buy</div>', "<script>var a='<p>no</p>'</script>",
    "<style>p{}</style>", '<section class="comments"><p>first!</p></section>', "<!-- <p>no</p> -->", '<div role="navigation"><a href=/>go</a></div>', "<nav><ul><li>menu</li></ul></nav>", "<noscript>on</noscript>",
]


def page(rng, root):
    blocks = [" ".join(rng.choice(["word", "é&x", "a<b", "two"]) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6))]
    inner = ""
    for b in blocks:
        own = html.escape(b).replace(" ", rng.choice([" ", "\n  ", " "]), 1)
        inner += rng.choice([f"<p>{own}</p>", f"<p><b>{own}<br>", f"<div>{own}</div>", f"<h2>{own}</h2>"]) + rng.choice(["", *JUNK])
    top = f"<header><h1>Site</h1></header>{rng.choice(JUNK)}"
    return f"<!doctype html><html><head><title>t</title></head><body>{top}{root[0]}{inner}{root[1]}{rng.choice(JUNK)}<footer>end</footer>" + rng.choice(["</body></html>", ""]), "\n".join(blocks)


@pytest.mark.parametrize("root", [("<article>", "</article>"), ('<div class="wrap"><main>', "</main></div>"), ('<div class="post-content">', "</div>"), ('<div class="q7">', "</div>")])
def test_templates(spark, root):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}.org/x", *page(rng, root)) for i in range(60)]
    got = {r.page_id: r for r in W.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    for i, url, _, text in rows:
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].url == url


def test_folding_and_alignment():
    a = W.skeleton("<ul><li>a<li>b<li>c</ul><p>x")
    b = W.skeleton("<ul><li>a</ul><div>only here</div><p>x<p>y")
    w = W._joined(a, b)
    assert [(k[0], k[5], k[6]) for k in w[1]] == [("ul", 0, 0), ("div", 0, 1), ("p", 1, 0)]
    assert [(k[0], k[5]) for k in w[1][0][1]] == [("li", 1)]
    pairs = W.skeleton("<dl>" + "<dt>a<dd>b" * 5 + "</dl>")
    assert [(k[0], k[5]) for k in pairs[1][0][1]] == [("dt", 1), ("dd", 1)]
    rng = random.Random(4)
    many = "".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "h2", "h3", "ul", "div"], k=3000))
    assert len(W._joined(W.skeleton(many), W.skeleton(many[::1] + "<p>y"))[1]) >= 1


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "http://a/", "just text &amp; more"), (3, "http://a/", "just text &amp; more"), (None, "http://b/", "<p>" * 3000 + "deep"), (5, "http://c/", "<a href=\"x><b 'q" * 500), (6, "http://d/", "<article>" + "w " * 300000 + "</article>"), (7, "x", "<br><br/></p></div>&nbsp;&#x41;")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = W.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[3].text == "just text & more" and by[None].text == "deep" and by[6].n_chars == 599999 and by[7].text == "A"
    assert W.extract(df.limit(0)).collect() == []


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(7)
    for table in (1 << 28, 40):
        monkeypatch.setattr(W, "_TABLE", table)
        for _ in range(300):
            a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 25))] for _ in range(2))
            got = W.common(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))
            assert len(got) == lcs(a, b)


def neutral(i, rng):
    """A page with class names that say nothing; what is the same on all pages is template."""
    words = lambda n: " ".join(rng.choice(["ember", "slate", "willow", "cobalt", "hazel", "onyx"]) + str(rng.randrange(900)) for _ in range(n))
    blocks = [words(rng.randint(4, 40)) for _ in range(rng.randint(1, 5))]
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return f'<html><body><div class="k1"><p>Welcome to our site, the best of all.</p></div><div class="k2"><h1>{blocks[0]} {i}</h1><p>Read more about us here.</p>{body}</div><div class="k3"><p>All rights belong to us.</p></div></body></html>', "\n".join([f"{blocks[0]} {i}", *blocks])


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_neutral_template(spark, partitions):
    rng = random.Random(9)
    pages = [neutral(i, rng) for i in range(40)]
    rows = [(i, "http://n.example/x", *p) for i, p in enumerate(pages)] + [(100 + k, "http://copies.example/x", *pages[0]) for k in range(6)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(partitions)
    got = {r.page_id: r.text for r in W.extract(df).collect()}
    assert all(got[i] == text for i, _, _, text in rows if i < 100)
    whole = "Welcome to our site, the best of all.\n" + pages[0][1].replace("\n", "\nRead more about us here.\n", 1) + "\nAll rights belong to us."
    assert {got[100 + k] for k in range(6)} == {whole} or {got[100 + k] for k in range(6)} <= {whole, pages[0][1], whole.split("\n", 1)[1].rsplit("\n", 1)[0]}  # copies of one page show no template


def test_deep_nesting_and_nested_headers(spark):
    deep = "<div>" * 500 + "<p>kept one</p><div class='ad'><div>buy <p>now</p></div> and here</div><p>kept two</p>" + "</div>" * 500 + "<p>after</p>"
    rows = [(1, "http://a/", f"<article>{deep}</article>"), (2, "http://b/", "<body><header>site</header><article><div><header><h1>Title</h1></header><p>text</p></div></article></body>")]
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "kept one\nkept two\nafter", 2: "Title\ntext"}


def plain(pages):
    """Texts by one process: a wrapper per host page by page, and template strings by counting."""
    import re

    host = lambda u: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "") or [None, ""])[1].lower()
    wrappers, slots, kinds = {}, {}, {}
    for _, url, page in pages:
        h, own = host(url), W.skeleton(page)
        wrappers[h] = W._joined(wrappers[h], own) if h in wrappers else own
        found = W.slots_of(W.parse(page))
        if found:
            kinds.setdefault(h, set()).add(found[0])
            for s in found[1]:
                slots.setdefault((h, s), set()).add(found[0])
    same = {}
    for (h, s), on in slots.items():
        if len(on) >= W.SAME_PAGES and len(on) >= W.SAME_SHARE * len(kinds[h]):
            same.setdefault(h, []).append(s)
    said = {h: {"root": W.decide(w)["root"], "same": same.get(h)} for h, w in wrappers.items()}
    return [(i, W.text_of(page, said[host(url)])) for i, url, page in pages]


def test_against_one_process(spark):
    rng = random.Random(11)
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages += [(10**6 + i, f"http://n{i % 2}.example/x", neutral(i, rng)[0]) for i in range(30)] + [(2 * 10**6, None, None), (2 * 10**6 + 1, "u", "<p>x")]
    got = W.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(plain(pages))


ARTICLE = "<h1>Title here</h1><p>First words of it.</p><p>Then more words.</p>"
TEXT = "Title here\nFirst words of it.\nThen more words."
MENU, FOOT = "<nav><a href='/'>Home</a></nav>", "<footer>All rights</footer>"


@pytest.mark.parametrize("page, want", [
    (f'<body>{MENU}<div class="layout has-sidebar"><main>{ARTICLE}</main><div class="sidebar">Side</div></div>{FOOT}</body>', TEXT),
    (f'<body>{MENU}<div class="ad-free"><article>{ARTICLE}</article></div>{FOOT}</body>', TEXT),
    (f'<body>{MENU}<div class="post no-comment">{ARTICLE}<div class="comments">Me too</div></div>{FOOT}</body>', TEXT),
    (f'<body><form action="/p.aspx">{MENU}<div class="content">{ARTICLE}</div><div class="login">Name</div>{FOOT}</form></body>', TEXT),
    (f'<body>{MENU}<div class="content">{ARTICLE * 9}</div><div class="related"><article>Another one</article></div>{FOOT}</body>', "\n".join([TEXT] * 9)),
    (f'<body>{MENU}<div class="text">{ARTICLE}</div><div class="comments"><p>{"Long talk. " * 99}</p></div>{FOOT}</body>', TEXT),
    (f"<body>{MENU}<aside><article>Card</article></aside>{FOOT}</body>", ""),
])
def test_lists_do_not_hide_an_article(spark, page, want):
    rows = [(k, f"http://h{k % 2}.example/{k}", page.replace("words", f"words{k}")) for k in range(4)]
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want.replace("words", f"words{k}") for k in range(4)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_template_within_articles(spark, partitions):
    """What every article element of a host says is its template; what copies of one article say isn't."""
    rows = [(k, "http://m.example/x", f"<body>{MENU}<article><h1>Title {k}</h1><p>Sign in to save this story</p><p>Own words {k} of it, which are longer than that.</p></article>{FOOT}</body>") for k in range(40)]
    rows += [(100 + k, "http://copies.example/x", f"<body><article><p>Same words</p></article>{FOOT}</body>") for k in range(6)]
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)).collect()}
    assert got == {k: f"Title {k}\nOwn words {k} of it, which are longer than that." for k in range(40)} | {100 + k: "Same words" for k in range(6)}
