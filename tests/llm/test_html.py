import re
from html import unescape

from tallyscope.llm import html_text
from tallyscope.llm.common import table
from tallyscope.llm.queries import PLANS


def test_whole_table_against_the_article_element(spark, sf_dir):
    """All test pages hold one article; a plain reading of it is the expected text."""
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    got = PLANS["op2_html_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h\d|div|ul|li)\b[^>]*>", inner)
        want = [" ".join(unescape(re.sub(r"<br>", " ", b) if "<br>" in b else b).split()) for b in [re.sub(r"</?b>", "", b) for b in blocks]]
        assert r["text"] == "\n\n".join(b for b in want if b) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
<div class="top-menu"><a href=x>Home</a></div><div id="cookieNotice">We use cookies</div>
<div class="wrap%d"><div class="post-body"><h1>Title &amp;  more</h1><p>First <b>bold
text</b><br>line &lt;x&gt;<p>Second <a href="u">link</a> here &eacute;<script>if (a<b) "</p>"</script><ul><li>one<li>two</ul>
<div class="ad-slot">Buy</div><form>Name <input></form><!-- gone --><blockquote>Quote</blockquote></div></div>
<aside>Side</aside><section id="comments"><p>%s</p></section><div class="footer2">Foot</div></body></html>"""
WANT = "Title & more\n\nFirst bold text line <x>\n\nSecond link here é\n\none\n\ntwo\n\nQuote"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "p") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, path string")


def test_cases(spark):
    chatter = "A reader says a lot of things. " * 40
    rows = [(f"http://a.b/{i}", PAGE % (i, chatter)) for i in range(3)]
    rows += [(None, None), ("", ""), ("http://x.y/1", "<p>just text & more"), ("http://x.y/2", "no markup"), ("http://z/", "<div class='comments'>only</div>"),
             ("http://z/1", "<article><p>" + "word " * 30000 + "</article>"), ("http://q/", '<p title="open>broken</p>'), ("http://a.b/1", PAGE % (1, "x"))]
    got = {r["page_id"]: r for r in html_text.extract(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [got[i]["text"] for i in (0, 1, 2, 10)] == [WANT] * 4
    assert got[3]["text"] == "" and got[4]["text"] == "" and got[4]["n_chars"] == 0
    assert got[5]["text"] == "just text & more" and got[6]["text"] == "no markup" and got[7]["text"] == "only"
    assert got[8]["n_chars"] == 30000 * 5 - 1
    assert html_text.extract(frame(spark, [])).count() == 0


def test_the_host_outvotes_a_page(spark):
    """A page whose longest container is not the article of its host is read by the host's path."""
    page = "<body><div class='story'><p>%s</p></div><div class='box'><p>%s</p></div></body>"
    rows = [("http://h/%d" % i, page % ("Long story. " * 50, "short")) for i in range(5)] + [("http://h/9", page % ("Brief.", "Noise " * 300))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame(spark, rows)).collect()}
    assert got[5] == "Brief." and got[0] == ("Long story. " * 50).strip()


def texts(spark, pages, host="k"):
    return [r["text"] for r in html_text.extract(frame(spark, [(f"http://{host}{i}/", p) for i, p in enumerate(pages)])).orderBy("page_id").collect()]


INSIDE = """<h1 id="related-work">Related work</h1><p class="alert">Mind the step.</p><section id="discussion"><p>We discuss the outcome.</p></section>
<div class="entry-header"><h2>Title</h2></div><div class="social-search-widget"><p>Search engines and social media.</p></div>
<p>Mass <math aria-hidden="true"><mi>E</mi><mo>=</mo><mi>m</mi></math> follows.</p><form>Name <input></form><div class="comments">No</div><div class="share">No</div>
<div class="related"><a href="x">More stories here</a></div>"""
INSIDE_WANT = ["Related work", "Mind the step.", "We discuss the outcome.", "Title", "Search engines and social media.", "Mass E=m follows."]


def test_marks_inside_the_main_container(spark):
    got = texts(spark, [f"<body><div class='header'>Site of some five words</div>{a}{INSIDE}<p>And a last paragraph of text.</p>{b}<div class='footer'>Foot of the whole page here</div></body>"
                        for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post'>", "</div>"))])
    assert got == ["\n\n".join([*INSIDE_WANT, "And a last paragraph of text."])] * 3


def test_a_form_around_the_page(spark):
    page = "<body><form id='aspnetForm'><div class='nav'>Home</div><div class='text'><p>The text of a page within one form.</p></div><button>Go</button></form></body>"
    assert texts(spark, [page]) == ["The text of a page within one form."]


def test_no_sibling_block_is_cut(spark):
    """Lead, body and end note in differently classed containers, also on a page whose lead is most of the text."""
    page = "<body><div class='menu'><a href=x>a</a></div><div class=post><div class=lead><p>%s</p></div><div class=body><p>%s</p></div><div class=end><p>%s</p></div></div><div class=links><a href=y>One two three four five six</a></div></body>"
    lead, body, end = "This is the lead of the text.", "The body says a lot of things. " * 8, "A note at the very end."
    short = "<body><div class=post><div class=body><p>%s</p></div></div></body>" % body
    rows = [(lead, body, end)] * 3 + [(body, lead, end)]
    same_host = frame(spark, [(f"http://h/{i}", page % r) for i, r in enumerate(rows)] + [("http://h/s", short)] * 9)
    got = {r["page_id"]: r["text"] for r in html_text.extract(same_host).collect()}
    assert [got[i] for i in range(4)] == ["\n\n".join(x.strip() for x in r) for r in rows]
    assert got[4] == body.strip()


def test_longer_class_names_of_paragraphs_stay(spark):
    """One left-out word of a longer name does not mark article text; names of such words alone still do."""
    for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post'>", "</div>")):
        page = f"""<body><nav>Home</nav>{a}<h1 class="widget-history">A headline of some words here</h1>
            <p class="share-price">The share price rose by two points on that day.</p><p class="ad-hoc">An ad hoc committee met to talk about it all.</p>
            <p>Another plain paragraph of the article with enough words.</p><section class="comment-culture"><p>On the culture of comments in the town hall paper.</p></section>
            <p class="ad">Buy one now and get another one for free today.</p><section class="comments"><p>First! I like this article very much indeed.</p></section>
            <section class="comments-section"><p>Second! I do not like this article at all.</p></section>{b}</body>"""
        df = spark.createDataFrame([(1, "http://x.y/1", page)], "page_id long, url string, html string")
        text = html_text.extract(df).first()["text"]
        assert all(x in text for x in ("headline", "rose by two", "ad hoc committee", "plain paragraph", "culture of comments")), text
        assert not any(x in text for x in ("Buy one", "First!", "Second!", "Home")), text
