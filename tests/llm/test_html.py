"""Main text of pages."""

from collections import Counter
import random
import re
from html import unescape

import pytest

from pseudospark.llm.html_text import VOTES, main_texts, path_votes, read_page

CASES = [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>a<p>b", "a b"),
    ("<div>x<div></div>z</div>", "x z"),
    ("<p>x<!-- y -->z</p>", "xz"),
    ("a < b and c > d &amp;amp; &#233;", "a < b and c > d &amp; é"),
    ("hello <i>w</i>orld<script>if(a<b){'</p>'}</script><style>p{}</style>", "hello world"),
    ("<p>one<br>two\n\t three&nbsp;four</p>", "one two three four"),
    ("<article>foo<div class=ad>bar</div>baz</article>", "foo baz"),
    ("<article><header>H</header><p>A</p><form><input><p>f</p></form>B</article>", "A B"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<ul><li>a<li>b</ul>", "a b"),
    ("<article>unclosed <b>bold<p>next", "unclosed bold next"),
    (
        '<body class="has-sidebar"><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header>'
        '<div class="wrap header-wide"><main><h2>T</h2><p>Text</p></main><div id="comments"><p>nice</p></div></div>'
        '<aside>side</aside><footer>f</footer>',
        "T Text",
    ),
]


@pytest.mark.parametrize("html, text", CASES)
def test_single_pages(html, text):
    assert read_page(html).extract() == text


def test_host_consensus(spark, workspace):
    """One page alone would take its long list of links to other stories for the article."""
    usual = '<body><div class="story s{0}"><p>{1}</p></div><div class="more"><p>{2}</p></div></body>'
    pages = [(i, "http://Host.example/a", usual.format(i, "long text " * 30, "x")) for i in range(9)]
    pages.append((9, "https://user@host.example:80/b", usual.format(9, "brief", "other stories " * 30)))
    pages.append((10, "http://elsewhere.example/", "<div>alone</div>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in main_texts(df, workspace).collect()}
    assert found[9] == "brief" and found[10] == "alone" and found[0] == ("long text " * 30).strip()


def test_odd_rows(spark, workspace):
    rows = [(1, None, None), (None, "no url", "<p>a</p>"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "", "<p>é</p>")]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "page_id long, url string, html string, text string, host string, n_chars int")
    found = Counter(tuple(r) for r in main_texts(df, workspace).collect())
    assert found == Counter(
        {(1, None, "", 0): 1, (None, "no url", "a", 1): 1, (2, "http://h/", "", 0): 2, (3, "", "é", 1): 1}
    )
    assert main_texts(df.limit(0), workspace).count() == 0


def test_articles_of_the_test_data(spark, workspace):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in main_texts(pages, workspace).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))
        assert found[r.page_id] == " ".join(unescape(plain).split())


LONG = "long body " * 40

WHOLE = [
    (f"<body><article><h1>T</h1><p>lead</p><div>{LONG}</div></article></body>", "T lead " + LONG),
    (f"<body><div class=content><h1>T</h1><p>lead</p><div>{LONG}</div></div></body>", "T lead " + LONG),
    (f"<body><div><div class=lead>lead</div><div class=rest>{LONG}</div></div></body>", "lead " + LONG),
    (f"<body><p>menu</p><main><section>one</section><section>{LONG}</section></main></body>", "one " + LONG),
    ("<body><p>x</p><article>first part</article><article>second part</article></body>", "first part second part"),
]


@pytest.mark.parametrize("html, text", WHOLE)
def test_nothing_beside_a_dominant_container_is_lost(html, text):
    assert read_page(html).extract() == text.strip()


def test_host_vote_cuts_no_page(spark, workspace):
    """Pages whose usual container is small, or comes several times, keep all their text."""
    usual = "<body><article><div>{0} " + LONG + "</div></article></body>"
    odd = "<body><article><h1>T</h1><div>small</div><p>" + LONG + "</p></article></body>"
    lead = "<body><div class=s><div class=lead>lead {0}</div><div class=b>{0} " + LONG + "</div></div></body>"
    same = "<body><div class=s><div class=lead>same</div><div class=b>" + LONG + "</div></div></body>"
    pages = [(i, "http://a/", usual.format(i)) for i in range(9)] + [(9, "http://a/", odd)]
    pages += [(20 + i, "http://b/", lead.format(i)) for i in range(5)] + [(30 + i, "http://c/", same) for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in main_texts(df, workspace).collect()}
    assert found[9] == f"T small {LONG}".strip()
    assert all(found[20 + i] == f"lead {i} {i} {LONG}".strip() for i in range(5))
    assert all(found[30 + i] == f"same {LONG}".strip() for i in range(5))


NAMED = [
    ('<article><section id="discussion"><h2 id="related-work">Related</h2>a</section><section id="comments">b</section></article>', "Related a"),
    ('<article><p class="notice">n</p>price <span class="share-price">3</span><div class="article-header">h</div></article>', "price 3 h"),
    ('<body><div class=text><h2 id="social">S</h2><p class="notice">n</p><section id="discussion">d</section></div></body>', "S d"),
    ('<body><div class="post-header"><h1>T</h1></div><div>text</div></body>', "T text"),
    ('<body><form id="aspnetForm"><input><div>whole page</div></form><div>x</div></body>', "whole page x"),
    ('<body><form><div>menu</div><article>text<form>sign up</form></article></form></body>', "text"),
    ('<article>text of some length<div class="related-posts"><a href="/">other</a></div><div class="ads">buy</div></article>', "text of some length"),
    ('<main><article>text</article><div id="comments" class="comments-area"><article class="comment-body">nice</article></div></main>', "text"),
    ('<body><div class="widget"><article>text</article></div><div class="widget">other</div></body>', "text"),
    ('<main><article>text</article><div class="share-box">share</div></main>', "text"),
    ('<body><div class="page no-sidebar"><p>text</p></div></body>', "text"),
    ('<body><div id="wrap" class="has-fixed-header"><div>a</div><div>b</div></div></body>', "a b"),
    ('<body><div class="site menu-closed"><p>text</p></div></body>', "text"),
    ('<body><div class="menu"><p>text</p></div></body>', "text"),
    ('<body><div><p>some text</p></div><section id="comments"><p>nice</p></section></body>', "some text"),
    ('<article>some text<div class="user-comments">a</div><ul class="replies"><li>b</ul></article>', "some text"),
    ('<article>some text<div id="reader-comments">a</div><div class="cookie-notice">b</div></article>', "some text"),
    ('<article>some text<div class="promo">a</div><div class="related-posts">b</div></article>', "some text"),
]


@pytest.mark.parametrize("html, text", NAMED)
def test_names_and_forms(html, text):
    assert read_page(html).extract() == text


def _sentences(draw, least, most):
    words = "river mill stone light paper glass north train garden letter winter market signal harbour copper field".split()
    said = []
    for _ in range(draw.randint(least, most)):
        said.append(" ".join(draw.choices(words, k=draw.randint(6, 14))).capitalize() + f" {draw.randint(0, 9999)}.")
    return " ".join(said)


def _links(draw, n):
    return "".join(f'<li><a href="/{k}">{_sentences(draw, 1, 1)}</a></li>' for k in range(n))


def _generated(host, k, draw):
    """A page without article or main elements in its host's own layout, and its article."""
    title, lead = _sentences(draw, 1, 1), _sentences(draw, 1, 1)
    body = [_sentences(draw, 1, 4) for _ in range(draw.randint(1, 6))]
    paragraphs = "".join(f"<p>{p}</p>" for p in body)
    text = " ".join([title, lead, *body])
    same = "We write about rivers and mills since 1990. Write to us at any time, we answer all letters."
    remarks = "".join(f"<div><b>User {i}</b><p>{_sentences(draw, 1, 3)}</p></div>" for i in range(draw.randint(0, 5)))
    if host == "a.example":
        html = (
            f'<div class="t1"><ul>{_links(draw, 8)}</ul></div><div class="x page{k}"><h1>{title}</h1><p>{lead}</p>{paragraphs}</div>'
            f'<div class="z">{same}</div><div id="reader-comments">{remarks}</div>'
        )
    elif host == "b.example":
        html = (
            f'<div id="wrap" class="site no-sidebar"><table><tr><td class="l">{same}<ul>{_links(draw, 5)}</ul></td><td class="m">'
            f'<h2>{title}</h2><div class="lead">{lead}</div><div class="rest">{paragraphs}</div></td></tr></table>'
            f'<div class="user-comments">{remarks}</div></div>'
        )
    else:
        html = (
            f'<div class="page has-fixed-header"><div class="u">{same}</div><section class="s"><div class="post-header"><h1>{title}</h1></div>'
            f'<p>{lead}</p><div class="promo">{_sentences(draw, 1, 2)}</div>{paragraphs}</section><div class="r"><h3>More</h3>'
            f'<ul>{_links(draw, 6)}</ul></div><section id="comments">{remarks}</section></div>'
        )
    return f"<html><head><title>x</title></head><body class='p-{k}'>{html}</body></html>", text


def test_generated_hosts_without_article_elements(spark, workspace):
    """Words of articles found (recall) and of what was found (precision), host by host."""
    draw = random.Random(3)
    hosts = ["a.example", "b.example", "c.example"]
    made = {(h, k): _generated(h, k, draw) for h in hosts for k in range(40)}
    rows = [(f"{h}/{k}", f"http://{h}/{k}", html) for (h, k), (html, _) in made.items()]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    found = {r.page_id: r.text for r in main_texts(df, workspace).collect()}
    for h in hosts:
        right = given = wanted = 0
        for k in range(40):
            a, b = Counter(found[f"{h}/{k}"].split()), Counter(made[h, k][1].split())
            right, given, wanted = right + (a & b).total(), given + a.total(), wanted + b.total()
        print(h, "precision", right / given, "recall", right / wanted)
        assert right / given > 0.95 and right / wanted > 0.95


def test_votes_equal_a_plain_count(spark, workspace):
    """Verdicts of hosts against the same sums in Python, copies of a page counted once."""
    draw = random.Random(4)
    pages = [(h, _generated(h, k, draw)[0]) for h in ("a.example", "c.example") for k in range(12)]
    pages += pages[:5]
    df = spark.createDataFrame(pages, "host string, text string")
    votes: dict = {}
    for h, html in set(pages):
        for path, (score, share, text) in read_page(html).scored().items():
            vote = round(VOTES * score * share)
            votes.setdefault((h, path), []).append((max(1, vote) if score > 0 else vote, text))
    expected = {}
    for key, cast in votes.items():
        equal = max(Counter(t for _, t in cast if t is not None).values(), default=0)
        total = sum(v for v, _ in cast)
        won = total > 0 and not (equal >= 3 and 2 * equal > len(cast))
        expected[key] = total, won, any((v > 0) != won for v, _ in cast)
    found = {(r.host, r.path): (r.votes, r.won, r.overruled) for r in path_votes(df).collect()}
    assert found == expected and any(o for _, _, o in found.values())
