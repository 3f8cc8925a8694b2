"""HTML extraction: flat text blocks and a decision tree.

A page is cut at block-level tags into flat blocks.  A block has its number of
words, the share of its words inside links, both for the block before and the
block behind it, its kind, and two weak marks: what element holds it, and how far
the names of the elements around it are names of boilerplate or of content.  A
decision tree keeps or drops each block; it is grown here from a labelled table,
whose pages are written by a rule, half of them without any mark, so that words
and links of the neighbours decide.  Kept blocks are joined in page order.

Null and empty pages give empty texts, an empty table gives none.  Repeated rows
give repeated results; there are no ties, as every block is judged alone.  Extra
columns are ignored.  Unclosed comments, scripts and tags end with the page, other
unclosed dropped elements with the block around them.  Pages are handled one by
one, in time linear in their length, without a shuffle.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by what they do to the flow of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style noscript template title svg iframe object select textarea button audio video canvas".split())
#: Elements whose start tags may close themselves.
FOREIGN = frozenset(["svg"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar "
    "navigation newsletter notice pagination popup promo promoted recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "tags teaser toolbar toc topbar widget".split()
)
CONTENT_NAMES = frozenset("article body content entry main post story text".split())

# A quote counts behind "=" only, and only if it is closed; a tag without ">" is the rest of the page.  No part is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in sorted(RAW | {"head"})}
_KEEP = re.compile(r"""\bdata-keep\b""")


@dataclass
class Block:
    """``element`` and ``named`` are marks of what holds the block."""

    text: str
    words: int
    linked: int
    kind: int
    element: int
    named: float
    label: bool


def _element(name: str, outer: int) -> int:
    """-1 inside elements of boilerplate, 1 inside an article, else 0."""
    if outer < 0 or name in BOILERPLATE or name == "header" and outer == 0:
        return -1
    return 1 if name in CONTENT else outer


def _named(name: str, attributes: str, outer: float) -> float:
    """The share of boilerplate names in a name of the element, negative, or of content names; names of boilerplate go before those of content, within a name and from outside in."""
    found = [outer]
    if "=" in attributes and name not in ("html", "body"):
        for m in _NAMES.finditer(attributes):
            for whole in (m[1] or m[2] or m[3] or "").lower().split():
                parts = _NAME_PART.findall(whole)
                bad, good = (sum(p in names for p in parts) for names in (BOILERPLATE_NAMES, CONTENT_NAMES))
                if bad and not (good and "header" in parts):
                    found.append(-bad / len(parts))
                elif good:
                    found.append(good / len(parts))
    return min(found) if min(found) < 0 else max(found)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    text: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, float, bool]] = []
    opened: Counter[str] = Counter()
    element, named, kind, links, label = 0, 0.0, 0, 0, False

    def flush() -> None:
        if not text:
            return
        joined = " ".join(entities.unescape("".join(t for t, _ in text)).split())
        if joined:
            linked = sum(len(t.split()) for t, in_link in text if in_link)
            out.append(Block(joined, joined.count(" ") + 1, linked, kind, element, named, label))
        text.clear()

    def leave() -> str:
        nonlocal element, named, label
        name, element, named, label = stack.pop()
        opened[name] -= 1
        return name

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append((page[at:], links > 0))
            break
        if m.start() > at:
            text.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1]:
            if name in RAW or name in DROPPED:
                # What stands inside counts for nothing, tags included.
                if name in RAW:
                    end = _ENDS[name].search(page, at)
                    at = end.end() if end else n
                elif name == "head":
                    # A page has one.
                    end = _ENDS[name].search(page, at) if not opened[name] else None
                    opened[name] += 1
                    at = end.end() if end else at
                    flush()
                elif not (name in FOREIGN and m[3].endswith("/")):
                    at = _skip(page, name, at)
                continue
            if name == "br":
                text.append((" ", links > 0))
                continue
            if name == "a":
                links += 1
                continue
            if name not in BLOCKS:
                continue
            flush()
            links = 0
            if name in VOID:
                continue
            if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                leave()
            stack.append((name, element, named, label))
            opened[name] += 1
            element, named = _element(name, element), _named(name, m[3], named)
            label = label or bool(_KEEP.search(m[3]))
            kind = 2 if name in HEADINGS else 1 if name == "p" else 3 if name in ("li", "dt", "dd", "td", "th") else 0
        elif name == "a":
            links = max(0, links - 1)
        elif name in BLOCKS:
            flush()
            links = 0
            while opened[name] and leave() != name:
                pass
            kind = 0
    flush()
    return out


def _skip(page: str, name: str, at: int) -> int:
    """The position behind the end tag that closes ``name``, which may be nested; without one, before the end tag of the block around it."""
    depth, inside = 1, 0
    for m in _TOKEN.finditer(page, at):
        found = (m[2] or "").lower()
        if found == name:
            if not (name in FOREIGN and m[3].endswith("/")):
                depth += -1 if m[1] else 1
            if not depth:
                return m.end()
        elif found in BLOCKS and found not in VOID and not m[3].endswith("/"):
            inside += -1 if m[1] else 1
            if inside < 0:
                return m.start()
    return len(page)


FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "kind", "element", "named")


def features(blocks: list[Block]) -> np.ndarray:
    """One row a block; beyond the first and the last block there are no words."""
    n = len(blocks)
    own = np.array([[b.words, min(1.0, b.linked / b.words)] for b in blocks], dtype=np.float64).reshape(n, 2)
    edge = np.zeros((1, 2))
    before, behind = (np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])) if n else (own, own)
    marks = np.array([[b.kind, b.element, b.named] for b in blocks], dtype=np.float64).reshape(n, 3)
    return np.concatenate([own, before, behind, marks], axis=1)


_LONG = "This went on for a good while, and those who had come early were as tired of it as those who came late, so that in the end nobody could say what had been decided and why it had to be that night."
#: Pages written by hand.
_WRITTEN = (
    '<body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News of the day</a></li></ul></nav><div class="ad">Buy nine new lamps for the price of eight, only today.</div>'
    "<article data-keep><h1>A short title</h1><p>One.</p><p>Some ten words stand in this paragraph, and not one more.</p><p>The river had risen over night and the lower meadows stood under water, so that the cattle were driven up to the old quarry before the first light.</p></article>"
    "<footer>Copyright example. All rights are with the owner of this page.</footer></body>",
    '<body><div id="header"><h2>The Daily Page</h2><a href=x>Sign in</a></div><div class="content" data-keep><h2>Heading</h2><p>First of all <a href=y>a link</a> in a long paragraph of plain words that go on for a while and then end.</p>'
    '<ul><li>Item one</li><li>Item two with more words than the first</li></ul><blockquote>Said by someone long ago.</blockquote></div><div class="sidebar"><h3>Related</h3><ul><li><a href=z>Other story with a long name here</a></li></ul></div>'
    '<form><p>Your name and address, please, so that we can write to you.</p></form></body>',
    '<body><div><a href=1>Start</a> <a href=2>Archive</a> <a href=3>Contact</a></div><div data-keep><p>This page has no marks at all that tell what is what, yet long paragraphs with few links are text, and the words around them are too.</p>'
    '<p>A second paragraph follows the first, and it has about as many words, none of which is part of any link that leads elsewhere.</p><p>Short end of it between long ones.</p><p>And a last one that is long enough for the rule to hold on to, with its neighbours being as long as it is itself.</p></div>'
    "<div><a href=4>Terms</a> <a href=5>Privacy</a> <a href=6>About us</a></div></body>",
    '<body><div class="cookie-notice"><p>We use cookies to make this page better; by reading on you agree to that, and to all that follows from it.</p></div><main data-keep><h1>Notes</h1><p>Yes.</p><p>No, and here is why: the first answer was wrong.</p><table><tr><td>Cell</td><td>Another cell with words</td></tr></table></main>'
    '<section class="comments"><p>Great read, thank you so much for writing this down for all of us who were not there.</p><p>I do not agree with it at all.</p></section><aside><p>Subscribe to our letter and get the best stories each week without any cost to you.</p></aside></body>',
    '<body><header><p>The paper of the town since it was founded by two brothers.</p></header><article data-keep><header><h1>In the article</h1></header><section><h2>Part</h2><p>Text of the part.</p><p><a href=7>Only a link</a></p></section><p>End.</p></article>'
    "<nav><a href=8>Next</a></nav><footer><p>Printed on paper.</p></footer></body>",
    '<body><ul><li><a href=1>World</a></li><li><a href=2>Sport</a></li><li><a href=3>Money and markets</a></li></ul><div data-keep>Text that stands in a plain division without paragraphs, which old pages often have, and which goes on for more than a line or two before it ends here.</div>'
    '<div data-keep>A second plain division that holds text, again with many words in it and no link to any other page on this site or elsewhere.</div><h3><a href=4>More from us</a></h3><p><a href=5>Ten ways to do it better</a></p><p><a href=6>What they said then and what they say now</a></p><div>All rights reserved.</div></body>',
    '<body><div>Last changed on a Monday</div><h1 data-keep>What is on this page</h1><p data-keep>Here a paragraph begins that says what the page is about, in so many words that nobody could take it for a line of a menu.</p>'
    '<p data-keep>It is followed by one that has <a href=1>one link</a> among its words, as text on pages often does, and that is no reason to leave it out.</p><ul><li><a href=2>Back</a></li><li><a href=3>To the top</a></li></ul><div><a href=4>Imprint</a></div></body>',
    # Boilerplate may be long: what holds it counts before its length does.
    "<body>" + "".join(f"<{tag} {names}><p>{_LONG}</p><p>Then, a shorter remark of ten words follows here.</p></{tag}>" for tag, names in (("div", "class=ad"), ("aside", ""), ("footer", ""), ("div", "class=notice"), ("form", ""), ("nav", "")))
    + f"<article data-keep><h1>{_LONG}</h1><p>Short.</p></article><section class=comments><p>{_LONG}</p><p>{_LONG}</p></section></body>",
    "<body><p data-keep>A bare page of one paragraph that is long enough to be what the page is about and has nothing else around it at all.</p></body>",
)

def labelled_pages(count: int = 400, seed: int = 11) -> tuple[str, ...]:
    """Pages written by a rule: a menu, an advert, the article, other things and a footer, in elements that tell what they are, in named ones, or in plain divisions.  What is kept stands inside data-keep."""
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join(["word"] * r.randint(low, high))

    def link(low: int, high: int) -> str:
        return f"<a href=x>{words(low, high)}</a>"

    def paragraph() -> str:
        low, high = r.choice([(1, 8), (8, 40), (40, 160), (40, 160)])
        body = words(low, high)
        return f"<p>{body} {link(1, 3)} {words(2, 9)}</p>" if high > 8 and r.random() < 0.2 else f"<p>{body}</p>"

    def links(form: str) -> str:
        if form == "list":
            return "<ul>" + "".join(f"<li>{link(1, 9)}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
        return f"<div>{' '.join(link(1, 3) for _ in range(r.randint(2, 6)))}</div>"

    def inside(style: str) -> str:
        """An article: its heading, and paragraphs with a list, a table or a saying among them."""
        out = [f"<{h}>{words(1, 16)}</{h}>" for h in [r.choice(["h1", "h2"])] if r.random() < 0.85]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.8:
                out.append(paragraph())
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<h2>{words(1, 8)}</h2><p>{words(10, 80)}</p>")
            elif kind < 0.96:
                out.append(f"<blockquote>{words(3, 40)}</blockquote>")
            elif style != "plain":
                out.append(f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table><p>{link(2, 9)}</p>")
        return "".join(out)

    def boilerplate(style: str, element: str, names: list[str], body: str) -> str:
        if style == "plain":
            return f"<div>{body}</div>"
        return f"<{element}>{body}</{element}>" if style == "told" and element != "div" else f'<div class="{r.choice(names)}">{body}</div>'

    def page() -> str:
        style = r.choice(["plain", "plain", "told", "named"])
        out = [boilerplate(style, "nav", ["menu", "nav", "navbar-left", "main-nav", "header"], links(r.choice(["list", "row"])))]
        if r.random() < 0.7:
            short = words(2, 12) if style == "plain" or r.random() < 0.5 else f"{words(2, 60)}<p>{words(1, 60)}</p>"
            out.append(boilerplate(style, "div", ["ad", "ad-slot", "notice", "cookie-notice", "promo"], short))
        body = inside(style)
        keep = {"told": f"<article data-keep>{body}</article>", "named": f'<div class="{r.choice(["content", "post-body", "tags-of-war", "story"])}" data-keep>{body}</div>', "plain": f"<div data-keep>{body}</div>"}
        if style == "told" and r.random() < 0.4:
            # What stands inside an article need not be of it.
            keep["told"] += f'<article><div class="{r.choice(["comments", "related", "share"])}"><p>{words(1, 60)}</p><p>{words(1, 30)}</p></div><nav>{links("list")}</nav></article>'
        out.append(keep[style])
        if r.random() < 0.6:
            out.append(boilerplate(style, "aside", ["related", "sidebar", "sidebar-right", "related-posts"], f"<h3>{words(1, 3)}</h3>" + links("list")))
        if style != "plain" and r.random() < 0.5:
            out.append(boilerplate(style, r.choice(["form", "aside", "div"]), ["comments", "comment-list", "newsletter", "signup"], "".join(f"<p>{words(1, 60)}</p>" for _ in range(r.randint(1, 4)))))
        if r.random() < 0.8:
            out.append(boilerplate(style, "footer", ["footer", "site-footer"], r.choice([words(2, 20), f"{link(1, 3)} {link(1, 3)} {words(1, 3)}", f"<p>{words(2, 20)}</p>" if style != "plain" else words(2, 9)])))
        return f"<body>{''.join(out)}</body>"

    return tuple(page() for _ in range(count))


#: The labelled table: the blocks of these pages.
LABELLED = _WRITTEN + labelled_pages()


@dataclass(frozen=True)
class Node:
    feature: int
    limit: float
    low: object
    high: object


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 1) -> Node | bool:
    """A tree whose every cut takes as much Gini impurity away as one cut can."""
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return bool(2 * y.sum() >= len(y))
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones, k = np.cumsum(t)[:-1], np.arange(1, len(t))
        p, q = ones / k, (t.sum() - ones) / (len(t) - k)
        cost = k * p * (1 - p) + (len(t) - k) * q * (1 - q)
        cost[v[1:] == v[:-1]] = np.inf
        i = int(np.argmin(cost)) if len(cost) else 0
        if len(cost) and cost[i] < best[0]:
            best = (float(cost[i]), f, float((v[i] + v[i + 1]) / 2))
    if not np.isfinite(best[0]):
        return bool(2 * y.sum() >= len(y))
    _, f, limit = best
    low = x[:, f] <= limit
    return Node(f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def keeps(tree: Node | bool, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    low = x[:, tree.feature] <= tree.limit
    out = np.empty(len(x), dtype=bool)
    out[low], out[~low] = keeps(tree.low, x[low]), keeps(tree.high, x[~low])
    return out


def trained(pages: tuple[str, ...] = LABELLED) -> Node | bool:
    found = [blocks_of(p) for p in pages]
    return grow(np.concatenate([features(b) for b in found]), np.array([b.label for bs in found for b in bs], dtype=bool))


def main_text(page: str | None, tree: Node | bool) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, keeps(tree, features(blocks))) if keep)


def _extract(batches: Iterator[pa.RecordBatch], tree: Node | bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    tree = trained(labelled)
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: _extract(it, tree), "page_id long, url string, text string, n_chars long")
