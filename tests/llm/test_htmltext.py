import html
import re

import pytest

from loomtext.llm.htmltext import blocks_of, decide, default_tree, extract_text, labelled_blocks, main_text


def truth(page):
    """Blocks of the one article element, by plain splitting."""
    start = page.find("<article>")
    end = page.find("</article>")
    part = re.sub(r"<[^>]*\Z", "", page[start + 9 : end if end >= 0 else len(page)]) if start >= 0 else ""
    rows = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", part))
    return "\n".join(r for r in rows if r)


def test_held_out_accuracy():
    x, y = labelled_blocks(120, seed=99)
    got = [decide(default_tree(), row) for row in x]
    assert sum(a == b for a, b in zip(got, y)) >= 0.98 * len(y)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    got = extract_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def kept(body):
    return main_text(f"<html><body>{body}</body></html>", default_tree())[0]


def test_markup():
    page = "<article><h1>A&amp;B &lt;x&gt;</h1><p>one\n <b>two</b>&nbsp;three<br>four<!-- no --><script>if (a</p>b) x</script> five<p>un<i>closed</i><style>p{}</style></article>"
    assert kept(page) == "A&B <x>\none two three four five\nunclosed"
    assert kept("<article><p title='a>b' x=\"</p>\">quoted</p><p>cut &am") == "quoted\ncut &am"
    assert kept("<article><p>text</p><p") == "text" and kept("<article><p>a < b and c</p></article>") == "a < b and c"
    assert kept("<ARTICLE><P>Case</P></ARTICLE>") == "Case" and [b.text for b in blocks_of("a<hr/>b")] == ["a", "b"]


def test_furniture_goes():
    article = "<article><h1>Title here</h1><p>Short.</p><aside class=related><p>See also this other thing</p></aside><form><p>Your mail</p></form><div class='share'>Share it</div><p>End of it.</p><section class='comments'><p>I liked this one a lot, thank you for it</p></section></article>"
    page = f"<header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><div class='cookie-banner'>We use cookies, is that fine for you?</div>{article}<div class=sidebar><p>{'side ' * 40}</p></div><footer>&copy; Us</footer>"
    assert kept(page) == "Title here\nShort.\nEnd of it."


def test_an_article_keeps_what_is_its_subject():
    page = "<article><h1>On it</h1><section id=discussion><p>We discuss it.</p></section><div class='legal'><p>The law.</p></div><div class='popular-science'><p>Plain words.</p></div><p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> ends</p></article>"
    assert kept(page) == "On it\nWe discuss it.\nThe law.\nPlain words.\nSum x+1 ends"
    assert kept("<div class=legal><p>All rights</p></div><article><p>Text of it.</p></article><div class='popular'><p>Read this too</p></div>") == "Text of it."


ARTICLE = "<article><h1>Title of it</h1><p>First paragraph of the text.</p><p>Second one.</p></article>"
PLAIN = "Title of it\nFirst paragraph of the text.\nSecond one."


@pytest.mark.parametrize("wrap", [
    "<main class='has-sidebar'>{}</main>", "<div class='layout sidebar-right'>{}</div>", "<div id='page' class='menu-open'>{}</div>", "<div class='modal-open page'>{}</div>", "<div class='sidebar'>{}</div>", "<form id='aspnetForm'>{}</form>",
    "<div class='widget'><div class='overlay'><main id=search>{}</main></div></div><div class='sidebar'>" + "<p>side words</p>" * 60 + "</div>",
    "<div class='content comments-open has-widgets'>{}</div><div class='comments'>" + "<article class='comment'><p>What a long reply this is</p></article>" * 30 + "</div>",
])
def test_no_name_of_a_wrapper_empties_a_page(wrap):
    assert kept(wrap.format(ARTICLE)) == PLAIN
    assert kept(wrap.format(ARTICLE.replace("<article>", "<article class='post tag-social comments-open sidebar'>"))) == PLAIN


def test_a_wrapper_without_an_article_element():
    text = "".join(f"<p>Paragraph {i} of a page that has neither an article nor a main element, and says a few words.</p>" for i in range(9))
    page = "<div class='menu'><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div class='layout sidebar-left'>" + text + "</div><div class='sidebar'><p>Some side text</p></div><div class='site-footer'>&copy; Us</div>"
    assert kept(page) == "\n".join(re.findall("<p>(Para[^<]*)", text))


@pytest.mark.parametrize("box, said", [
    ("<div class='notice'><p>Take notice of this remark about the matter at hand.</p></div>", "Take notice of this remark about the matter at hand."), ("<section class='social history'><h2>Social history</h2><p>It was so.</p></section>", "Social history\nIt was so."),
    ("<section id='reply'><p>The reply was no.</p></section>", "The reply was no."), ("<noscript>Said without scripts</noscript>", "Said without scripts"), ("<svg><text>A label</text></svg>", "A label"), ("<object data=x>What stands for it</object>", "What stands for it"),
    ("<xmp>a<b>&amp;</xmp>", "a<b>&amp;"), ("<p hidden>Hidden one</p>", "Hidden one"), ("<div hidden>Hidden two</div>", "Hidden two"), ("<div style='display:none'>Hidden three</div>", "Hidden three"),
])
def test_an_article_keeps(box, said):
    assert kept(ARTICLE.replace("<p>Second", box + "<p>Second")) == PLAIN.replace("Second", said + "\nSecond")


@pytest.mark.parametrize("box", [
    "<textarea>typed</textarea>", "<select><option>one</select>", "<script>x</script>", "<style>x</style>", "<template><p>x</p></template>", "<nav><a>Next</a></nav>", "<form><p>Your mail address, please</p></form>", "<div class='share-buttons'><a>Tweet</a> <a>Post</a></div>",
    "<div class='related-posts'><p>Another text that you will like as much as this one here.</p></div>", "<div class='ad-slot'>Buy the thing that everyone has by now.</div>", "<section id='comments'><div class='comment-body'><p>I think that it is all wrong from end to end.</p></div></section>", "<aside>By the way.</aside>",
])
def test_an_article_loses(box):
    assert kept(ARTICLE.replace("<p>Second", box + "<p>Second")) == PLAIN


#: Pages after the manner of common themes; none is built like the labelled ones. What is kept has an exclamation mark.
THEMES = (
    """<body class="home blog has-sidebar"><div id="page" class="site"><a class="skip-link" href="#c">Skip to content</a><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a>My Blog</a></p></div><nav id="site-navigation" class="main-navigation"><button>Menu</button><ul><li class="menu-item"><a>Home</a></li><li class="menu-item"><a>About</a></li></ul></nav></header>
    <div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-7" class="post-7 post type-post status-publish category-news tag-social"><header class="entry-header"><h1 class="entry-title">A walk in the hills!</h1></header><div class="entry-content"><p>We set out early!</p><figure><img><figcaption>The first hill!</figcaption></figure><p>It rained, and then it did not!</p><h2>What we saw!</h2><ul><li>Sheep!</li><li>Two dogs and a <a>shepherd</a>!</li></ul></div><footer class="entry-footer"><a>Walks</a></footer></article>
    <div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>Lovely, I was there last year with my whole family and we liked it.</p></article></li></ol><div id="respond"><form><label>Name</label></form></div></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Archives</h2><ul><li><a>May</a></li></ul></section></aside></div><footer id="colophon" class="site-footer">Proudly powered</footer></div></body>""",
    """<body class="modal-open"><nav class="navbar navbar-expand-lg fixed-top"><a class="navbar-brand">Brand</a><ul class="navbar-nav"><li class="nav-item"><a class="nav-link">Docs</a></li></ul></nav><div class="alert alert-info">We have moved.</div><div class="container"><div class="row"><div class="col-8"><article class="blog-post"><h2 class="blog-post-title">Release notes!</h2><p class="lead">Version three is here!</p><pre>pip install it!</pre><div class="alert alert-warning">Back up first, as the format of files has changed!</div><table><tr><th>Key!</th><th>Value!</th></tr></table></article><nav class="blog-pagination"><a>Older</a></nav></div><div class="col-4"><div class="sidebar-module"><h4>Elsewhere</h4><ol><li><a>Code</a></li></ol></div></div></div></div><footer class="blog-footer"><p>Built by us</p></footer><div class="cookie-banner" role="dialog"><p>We use cookies to do things that you may like or not.</p><button>Fine</button></div></body>""",
    """<body><div class="page-wrapper sidebar-left"><div class="topbar"><a>Log in</a> | <a>Sign up</a></div><div class="layout-sidebar"><ul class="menu"><li><a>One</a></li><li><a>Two</a></li></ul></div><div class="main-content"><div class="story-body"><h1>Council votes on bridge!</h1><p>The council has voted, by nine to four, to build the bridge!</p><p>Work begins in spring!</p><blockquote>We waited for years!</blockquote><p>The old one, from the last century, is to be kept for walkers!</p></div><div class="newsletter-signup"><p>Get our news each morning, free of charge.</p><form><input></form></div><div class="related-articles"><h3>More</h3><p><a>Bridge closed</a></p></div></div></div><div class="footer-links"><a>Terms</a> <a>Privacy</a></div></body>""",
)


@pytest.mark.parametrize("page", THEMES)
def test_themes_that_the_tree_has_not_seen(page):
    want = [" ".join(b.split()) for b in re.findall(r">([^<>]*(?:<a>[^<>]*</a>)?[^<>]*!)<", page)]
    assert kept(page).split("\n") == [re.sub("</?a>", "", w) for w in want]


def test_odd_rows(spark):
    long = "<article>" + "<p>word word</p>" * 60_000 + "</article>"
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<article><p>x</p>", "t"), (3, "u", "<article><p>x</p>", "t"), (None, "u", long, "t"), (5, "u", "<" * 5000 + "\"'" * 500, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    assert [r.text for r in got[:4]] == ["", "", "x", "x"] and got[4].n_kept == 60_000 and len(got) == 6
    assert extract_text(df.limit(0)).count() == 0
