import hashlib
import re

from loomtext.functions import dom
from loomtext.operators import readable as RD
from loomtext.plans import catalog


def chars(node, linked=None):
    """Characters of a node's text by element, or of those in links."""
    inside = linked is None or linked or node.tag == "a"
    own = len(dom.squeeze("".join(c for c in node.children if isinstance(c, str)))) if inside else 0
    return own + sum(chars(c, None if linked is None else inside) for c in node.children if isinstance(c, dom.Node))


def weight(node):
    names = re.sub("[-_]", " ", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()).split()
    good, bad = "article body content entry main post story text".split(), "ad ads banner comment comments footer menu nav promo related share sidebar social sponsor widget".split()
    return RD.BASE.get(node.tag, 0) + 25 * any(n in good for n in names) - 25 * any(n in bad for n in names)


def brute(page):
    """Text and score by walking the tree again and again."""
    tree = dom.visible(page or "")
    up = {id(tree): None}
    order = []
    for n in tree.walk():
        order.append(n)
        for c in n.children:
            if isinstance(c, dom.Node):
                up[id(c)] = n
    points = {}
    for n in order:
        if n.tag in RD.PARAGRAPHS and chars(n) >= 25 and up[id(n)] is not None and not any(x.tag in RD.BLOCKS for x in n.walk() if x is not n):
            worth = 1 + sum("".join(c for c in m.children if isinstance(c, str)).count(",") for m in n.walk()) + min(chars(n) // 100, 3)
            parent = up[id(n)]
            points[id(parent)] = points.get(id(parent), 0) + worth
            if up[id(parent)] is not None:
                points[id(up[id(parent)])] = points.get(id(up[id(parent)]), 0) + worth / 2
    density = lambda n: chars(n, False) / chars(n) if chars(n) else 0.0
    scores = {id(n): (points[id(n)] + weight(n)) * (1 - density(n)) for n in order if id(n) in points}
    if not scores:
        return "", None
    best = max((n for n in order if id(n) in scores), key=lambda n: (scores[id(n)], -order.index(n)))
    top = scores[id(best)]
    family = [n for n in order if n is best or up[id(n)] is up[id(best)] and up[id(best)] is not None]
    taken = [n for n in family if n is best or scores.get(id(n), -1e9) >= max(10.0, top * 0.2) or n.tag == "p" and chars(n) > 80 and density(n) < 0.25]
    out = []
    for n in taken:
        for m in n.walk():
            if m.tag in RD.BLOCKS and not any(x.tag in RD.BLOCKS for x in m.walk() if x is not m):
                text = re.sub(r"\n+", " ", dom.squeeze(m.text()))
                out += [text] if text else []
    return "\n".join(out), round(top, 6)


def test_pages_of_the_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.digest, r.n_chars, r.score) for r in catalog.QUERIES["readable_pages"](spark, sf).collect()}
    want = {k: brute(page) for k, page in pages.items()}
    assert got == {k: (hashlib.md5(t.encode()).hexdigest(), len(t), s) for k, (t, s) in want.items()}


def test_articles_among_furniture_and_odd_pages(spark):
    text = "".join(f"<p>Paragraph {i}, which is long enough, has commas, and goes on for a while so that it counts.</p>" for i in range(5))
    side = "<div class='sidebar'>" + "<p><a href=/x>A link that is long enough to count as a paragraph, in a way</a></p>" * 9 + "</div>"
    pages = {
        1: f"<body>{side}<div id='content'><h1>Title</h1>{text}</div><div class=footer><p>Copyright, all rights reserved, by us and ours.</p></div></body>",
        2: f"<table><tr><td class='nav'><a>Home</a></td><td>{text}</td></tr></table>",
        3: None, 4: "", 5: "<p>short</p>", 6: f"<div><div class=post-body>{text}</div><p>{'A sibling paragraph that is long, and plain. ' * 3}</p><p><a>{'only a link ' * 9}</a></p></div>",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id int, html string")
    got = {r.page_id: r.text for r in RD.readable_texts(df, "page_id", "html").collect()}
    assert got == {k: brute(p)[0] for k, p in pages.items()}
    assert got[1].startswith("Title\nParagraph 0") and "Copyright" not in got[1] and "A link" not in got[1]
    assert got[2].count("Paragraph") == 5 and "Home" not in got[2] and got[3] == got[4] == got[5] == ""
    assert "A sibling" in got[6] and "only a link" not in got[6]
    assert RD.readable_texts(df.limit(0), "page_id", "html").count() == 0
