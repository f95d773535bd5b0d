"""Main text of web pages: flat text blocks and a decision tree.

A page is read once into flat blocks, stretches of text between block-level
tags. A block's features are its word count and link density, those of the
blocks before and behind it, and what it stands in: an article or main element,
a container named like content, page furniture, a container whose name may be
furniture or subject, a heading, a list item. A decision tree, grown here by Gini
impurity on the small labelled table of ``labelled_blocks`` (pages built by rule
in several layouts, each block known to be article or not), keeps or drops each
block.

Furniture is an element that is it by kind (``nav``, ``footer``, ``form``) or by name: one
whole class, id or role, such as ``sidebar``, ``site-footer`` or ``share-buttons``; states
(``has-sidebar``, ``menu-open``, ``tag-social``) name nothing. An ``article``, ``main`` or
``body`` is never furniture by name, and whatever else holds the page's main element, its
longest article, or the most of its words (of the page's, if it has neither:
half of them with a first-rank heading, four fifths without) is a wrapper and none
either, unless it is named as comments. Names such as
``notice``, ``social`` or ``search`` are furniture outside an article; within, the tree
goes by the block's words and links.

Scripts, styles, templates, form controls, frames and comments never become text.
``noscript``, ``svg``, ``object``, ``xmp`` and hidden elements are text within an article or
main element, and none outside. Character references are decoded; white space in
a block becomes one space and kept blocks are joined by a line feed in page
order. A tag cut off by the end of the page is no text.

Defined results: a null or empty page gives the empty text; equal pages give
equal texts; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from loomtext.llm.rows import map_slices

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|</?\Z|</[^a-zA-Z>][^>]*(?:>|\Z)|</>""",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "noembed", "noframes", "xmp")}
#: Of these, what an article shows as its text.
_SHOWN = frozenset(("noscript", "svg", "object", "xmp"))
#: Fixed lists of HTML element names.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul video audio canvas".split())
_HELD = frozenset("article aside blockquote body button details dialog dir div dl fieldset figure footer form header main menu nav ol search section table td th ul head".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_FURNITURE = frozenset("nav footer aside form dialog button menu search fieldset head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side-bar widget widgets menu nav navigation navbar breadcrumb breadcrumbs footer masthead topbar comment comments disqus cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing related recommended recommendations teaser trending pagination pager toolbar contentinfo complementary popup skiplink skip".split())
#: Furniture outside an article; within one they may as well be its subject.
_EITHER = frozenset("banner notice alert reply replies respond social modal overlay copyright discussion legal popular search".split())
_COMMENTS = frozenset("comment comments replies respond disqus".split())
_SITE = frozenset("site page top global blog".split())
#: First and last parts of names that state something about an element's surroundings.
_STATE_FIRST = frozenset("has no not with without is tag category cat type format status js show hide".split())
_STATE_LAST = frozenset("open opened close closed active inactive enabled disabled visible hidden on off allowed expanded collapsed present fixed sticky".split())
_ROLES = frozenset("navigation contentinfo complementary banner search dialog alertdialog form menu menubar toolbar".split())
_NAMED_CONTENT = re.compile(r"(?:^|[^a-z])(?:article(?:-?body|-?text|-?content)?|content(?:-?body)?|post(?:-?body|-?content)?|entry(?:-?content)?|story(?:-?body)?|main(?:-?content)?|body-?text|page-?content|text)(?:$|[^a-z])")

FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "article", "content", "furniture", "doubtful", "heading", "item", "cell")


@lru_cache(maxsize=4096)
def name_kind(token: str) -> tuple[bool, bool, bool]:
    """Whether one whole name is of furniture, may be, is of comments."""
    parts = [x for x in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
    if not parts or len(parts) > 1 and (parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST):
        return False, False, False
    if len(parts) > 1 and parts[0] in _SITE and parts[-1] in ("header", "bar"):
        return True, False, False
    if parts[:2] in (["side", "bar"], ["top", "bar"], ["sign", "up"]):
        return True, False, False
    sure = parts[0] in _NAMED or parts[-1] in _NAMED
    return sure, not sure and (parts[0] in _EITHER or parts[-1] in _EITHER), parts[0] in _COMMENTS or parts[-1] in _COMMENTS


def names_kind(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element's names are of content, of furniture, maybe of it, of comments."""
    content = sure = maybe = comments = False
    for attribute, value in _NAMES.findall(attributes):
        tokens = value.strip("\"'").split()
        if attribute.lower() == "role":
            sure |= any(t.lower() in _ROLES for t in tokens)
            continue
        if attribute.lower() == "aria-label" and len(tokens) > 2:
            continue
        content |= bool(_NAMED_CONTENT.search(" ".join(tokens).lower()))
        for t in tokens:
            a, b, c = name_kind(t)
            sure, maybe, comments = sure | a, maybe | b, comments | c
    return content, sure, maybe, comments


@dataclass(slots=True)
class Block:
    text: str
    words: int
    links: float
    article: bool
    content: bool
    furniture: bool
    doubtful: bool
    heading: bool
    item: bool
    cell: bool
    title: bool
    held: tuple[int, ...]


class Element:
    """An element that may be furniture or hold the page's text; ``words`` are those within."""

    __slots__ = ("name", "furniture", "comments", "words", "title", "around")

    def __init__(self, name: str, furniture: bool, comments: bool, around: tuple[int, ...]):
        self.name, self.furniture, self.comments, self.words, self.title, self.around = name, furniture, comments, 0, False, around


def settle(blocks: list[Block], elements: list[Element]) -> None:
    """Which blocks stand in furniture that is no wrapper of the page's text."""
    total = 0
    for b in blocks:
        total += b.words
        for k in b.held:
            elements[k].words += b.words
            elements[k].title |= b.title
    # what is named as comments is not where the page's text is sought
    within = lambda k: any(elements[j].furniture and elements[j].comments for j in elements[k].around)
    bodies = [k for k, e in enumerate(elements) if e.name in ("article", "main") and not within(k)]
    articles = [k for k in bodies if elements[k].name == "article"]
    best = max(articles or bodies, key=lambda k: elements[k].words, default=None)
    wrappers = {j for k in bodies if k == best or elements[k].name == "main" for j in elements[k].around}
    scope = total if best is None else elements[best].words
    for k, e in enumerate(elements):
        inside = best is None or best in e.around
        if e.furniture and inside and not e.comments and e.words > scope * (0.5 if e.title else 0.8):
            wrappers.add(k)
    for b in blocks:
        b.furniture = any(elements[k].furniture and k not in wrappers for k in b.held)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple] = []  # name; article, content, doubtful, elements around
    article = content = doubtful = 0
    around: tuple[int, ...] = ()
    parts: list[str] = []
    linked: list[str] = []
    in_link, last = 0, ""
    names: dict[str, tuple[bool, bool, bool, bool, bool]] = {}

    def flush():
        nonlocal parts, linked
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                n = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                out.append(Block(" ".join(words), len(words), min(1.0, n / len(words)), article > 0, content > 0, False, doubtful > 0, last in _HEADINGS, last == "li", last in ("td", "th"), last == "h1", around))
        parts, linked = [], []

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in _RAW and not closing and not (article and name in _SHOWN and name != "xmp"):
            if name not in ("svg", "object") or not rest.rstrip().endswith("/"):
                stop = _RAW[name].search(page, at)
                if article and name == "xmp":
                    parts.append(page[at : stop.start() if stop else end].replace("&", "&amp;"))
                at = stop.end() if stop else end
                if name != "script":
                    parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in _BLOCK:
            continue
        flush()
        if closing:
            last = ""
            if name in _HELD:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        _, article, content, doubtful, around = stack[k]
                        del stack[k:]
                        in_link = 0
                        break
            continue
        last = name
        if name in _HELD and name not in _VOID:
            stack.append((name, article, content, doubtful, around))
            known = names.get(rest)
            if known is None:
                known = names[rest] = (*(names_kind(rest) if "=" in rest else (False,) * 4), bool(rest and _HIDDEN.search(rest)))
            own = name in ("article", "main")
            named = (known[1] or known[2] and not article) and not own and name != "body"
            furniture = name in _FURNITURE or named or name == "header" and not article or known[4] and not article and not own and name != "body"
            if furniture or own:
                elements.append(Element(name, furniture, named and known[3], around))
                around = (*around, len(elements) - 1)
            article += own
            content += known[0]
            doubtful += known[2] and article > 0 and not own
    flush()
    settle(out, elements)
    return out


def features_of(blocks: list[Block]) -> list[tuple]:
    n, out = len(blocks), []
    for i, b in enumerate(blocks):
        p, q = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < n else None
        out.append((b.words, b.links, p.words if p else 0, p.links if p else 0.0, q.words if q else 0, q.links if q else 0.0, b.article, b.content, b.furniture, b.doubtful, b.heading, b.item, b.cell))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4):
    """A tree as nested (feature, threshold, at most, above), leaves being bools."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)) or len(y) < 2 * least:
        return bool(2 * ones >= len(y))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= len(y) - least)]
        if len(at):
            left, right = t[at - 1], ones - t[at - 1]
            n, m = at, len(y) - at
            gini = left * (n - left) / n + right * (m - right) / m
            k = int(np.argmin(gini))
            if best is None or gini[k] < best[0] - 1e-12:
                best = (gini[k], f, (v[at[k]] + v[at[k] - 1]) / 2)
    if best is None:
        return bool(2 * ones >= len(y))
    _, f, threshold = best
    low = x[:, f] <= threshold
    a, b = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return a if a is b or a == b and isinstance(a, bool) else (f, float(threshold), a, b)


def decide(tree, row: tuple) -> bool:
    while type(tree) is not bool:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def labelled_pages(count: int = 420, seed: int = 1) -> list[str]:
    """Pages built by rule in seven layouts. Article blocks carry the mark ``qz`` in
    their first word, which no feature sees."""
    rnd = random.Random(seed)
    words = lambda a, b: " ".join("".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/x">{words(a, b)}</a>'
    keep = lambda a, b: f"qz{words(a, b)}"
    either = sorted(_EITHER)
    out = []
    for i in range(count):
        semantic = i % 7 in (0, 1, 3, 5)
        body = [f"<h1>{keep(2, 12)}</h1>"]
        for _ in range(rnd.randint(1, 9)):
            kind = rnd.random()
            if kind < 0.70:
                body.append(f"<p>{keep(*rnd.choice([(1, 4), (4, 15), (15, 90)]))}{' ' + link() if rnd.random() < 0.2 else ''}" + ("</p>" if rnd.random() < 0.9 else ""))
            elif kind < 0.78:
                body.append(f"<h2>{keep(1, 6)}</h2><p>{keep(20, 60)}</p>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{keep(3, 14)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif kind < 0.90 and semantic:
                body.append(f"<section class='{rnd.choice(either)}'><h2>{keep(1, 5)}</h2><p>{keep(5, 60)}</p></section>")
            elif kind < 0.93 and semantic:
                body.append(f"<div class='{rnd.choice(either)}'><p>{keep(6, 50)}</p></div>")
            elif kind < 0.95 and semantic:
                body.append(f"<div class='{rnd.choice(either)}'>{link(1, 2)} {link(1, 2)} {link(1, 1)}</div>")
            elif kind < 0.96 and semantic:
                body.append("<ul>" + "".join(f'<li><a href="/r">{keep(1, 9)}</a></li>' for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif kind < 0.98:
                body.append(f"<blockquote>{keep(6, 40)}</blockquote>")
            else:
                body.append(f"<table><tr><td>{keep(1, 6)}</td><td>{keep(1, 6)}</td></tr></table>")
        menu = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(3, 9)))
        ad = rnd.choice([f'<div class="ad">{words(2, 30)}</div>', f'<div id="ad-top">{words(1, 8)} {link()}</div>', f'<aside class="promo"><p>{words(5, 40)}</p></aside>'])
        notice = rnd.choice([f'<div class="cookie-notice"><p>{words(6, 40)}</p><button>{words(1, 2)}</button></div>', f'<div role="dialog" class="consent">{words(8, 30)}</div>', ""])
        comments = rnd.choice(["", f'<section id="comments"><h3>{words(1, 2)}</h3>' + "".join(f"<div class='comment'><p>{words(3, 60)}</p></div>" for _ in range(rnd.randint(1, 4))) + "</section>"])
        form = f'<form action="/s"><label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button><p>{words(3, 12)}</p></form>'
        foot = rnd.choice([f"<p>&copy; {words(2, 12)}</p>", f"&copy; {words(1, 3)} &middot; {words(3, 16)}"])
        layout = i % 7
        if layout == 0:
            page = f"<nav><ul>{menu}</ul></nav>{ad}<article>{''.join(body)}</article><footer>{foot}</footer>"
        elif layout == 1:
            page = f"<header><p>{words(1, 5)}</p><nav>{menu}</nav></header>{notice}<main><article>{''.join(body)}</article>{comments}</main><aside class='sidebar'><h3>{words(1, 3)}</h3><p>{words(10, 40)}</p></aside><footer>{foot}</footer>"
        elif layout == 2:
            page = f"<div id='menu'><ul>{menu}</ul></div>{notice}<div id='content'>{''.join(body)}</div><div class='sidebar'>{words(5, 30)}<p>{words(4, 40)}</p></div>{comments}<div id='footer'>{foot}</div>"
        elif layout == 3:
            half = len(body) // 2
            inner = [*body[:half], rnd.choice([ad, f"<div class='share'>{link()} {link()}</div>", form, f"<aside class='related'><p>{words(3, 20)}</p><ul>{menu}</ul></aside>"]), *body[half:]]
            page = f"<div class='navbar'>{link()} | {link()}</div><article class='post'>{''.join(inner)}{comments}</article>{form}<footer><p>{foot}</p></footer>"
        elif layout == 4:
            page = f"<ul>{menu}</ul><div>{''.join(body)}<p>{keep(25, 60)}</p></div><p>{link()} | {link()} | {link()}</p><p>{link(2, 5)}</p>"
        elif layout == 5:
            outer = rnd.choice(["layout sidebar-right", "page menu-open", "no-sidebar", "modal-open site"])
            page = f"<div class='{outer}'><header class='site-header'>{link()} {words(1, 4)}</header><main class='has-sidebar'><article class='post tag-social comments-open'>{''.join(body)}</article>{comments}</main><div class='sidebar'>{words(5, 90)}</div></div><footer>{foot}</footer>"
        else:
            page = f"{form}<p>{link()} {link()} {link()}</p>{''.join(body)}<p>{keep(25, 70)}</p><div>{link()} &middot; {link()}</div><div class='copyright'>{foot}</div>"
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>")
    return out


def labelled_blocks(count: int = 420, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in labelled_pages(count, seed):
        blocks = blocks_of(page)
        rows += features_of(blocks)
        labels += [b.text.startswith("qz") for b in blocks]
    return np.array(rows, float), np.array(labels, bool)


@lru_cache(maxsize=1)
def default_tree():
    return grow(*labelled_blocks())


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """Text, blocks kept, blocks in all."""
    if not page:
        return "", 0, 0
    blocks = blocks_of(page)
    kept = [b.text for b, row in zip(blocks, features_of(blocks)) if decide(tree, row)]
    return "\n".join(kept), len(kept), len(blocks)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree=None) -> DataFrame:
    """(id, url, text, n_chars, n_kept, n_blocks) of every row."""
    tree = default_tree() if tree is None else tree

    def make():
        def run(ids, urls, pages):
            found = [main_text(p, tree) for p in pages]
            text, kept, total = (list(x) for x in zip(*found)) if found else ([], [], [])
            return {id_col: ids, url_col: urls, "text": text, "n_chars": list(map(len, text)), "n_kept": kept, "n_blocks": total}

        return run

    kind = pages.schema[id_col].dataType.simpleString()
    return map_slices(pages.select(id_col, url_col, html_col), make, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long, n_kept int, n_blocks int")
