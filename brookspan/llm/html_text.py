"""Main text of web pages by boosted trees over the nodes of the document tree.

A page is parsed leniently (unclosed and stray tags, raw text of scripts,
character references).  Its block elements, and the text that stands directly
in one beside other blocks, are the nodes.  A node is described by its subtree
(characters, characters per tag, link and punctuation density, share of its
parent and of the page), its tag and the words of its class, id and role
attributes, those of its ancestors, its depth and its siblings.  Boosted trees
give each node's odds of being wholly article, wholly not, or mixed.

Navigation, asides, footers, menus, dialogs, headers outside an article, and
forms that hold less than half of the page's text are never article text.
The decoding takes the likeliest assignment in which all nodes under a wholly
article (or wholly other) node are the same, so an ancestor never contradicts a
descendant.  Article nodes' blocks are joined in page order by one line feed,
white space inside a block being one blank.

There are no labelled pages, so the trees are fitted to pages written by
`written_page`, whose article is known: `pages` of them, seeded, on the driver.
Scripts, styles, templates, heads, frames and form controls never count as text.
A page of any length is read whole; the work grows with its nodes.

Nulls: null html is empty and has the empty text; every row is kept, also when
identifiers are null or repeat.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookspan.llm.boosting import BoostedTrees
from brookspan.llm.common import mapped, text_or_empty

MAIN, OTHER, MIXED = 0, 1, 2

# Element kinds of the HTML standard.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noframes iframe noembed".split())
NO_TEXT = RAW | set("template head noscript svg canvas select button datalist".split())
#: Elements that by their meaning are never article text, wherever they stand; a header is not outside the second kind.
NEVER_MAIN = set("nav aside footer menu dialog form".split())
ARTICLES = set("article main".split())
IN_HEAD = set("base link meta title style script noscript template".split())
#: An element of the first kind is closed by the start of one of the second kind.
CLOSED_BY = {
    "p": BLOCKS - set("html body option caption".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Beyond these an open element is not closed by another's start.
SCOPES = set("table ul ol dl menu td th html body article section div".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\s\u200b]+")


class Node:
    __slots__ = ("chars", "children", "depth", "direct", "links", "marks", "parent", "pieces", "tag", "tags", "words")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.pieces: list[tuple[int, str]] = []  # (block number, text) that stands directly here
        self.chars = self.links = self.marks = self.tags = self.direct = 0


def parse(page: str) -> Node:
    """The tree of block elements; text pieces carry the number of their block in page order."""
    root = Node("#page", (), None)
    stack: list[tuple[str, Node]] = [("#page", root)]  # all open elements, with the block element they belong to
    quiet = links = block = 0
    at = 0

    def put(raw: str) -> None:
        if quiet or not raw:
            return
        text = html_.unescape(raw) if "&" in raw else raw
        node = stack[-1][1]
        node.pieces.append((block, text))
        if not text.isspace():
            n = len(text.strip())
            node.direct += n
            node.marks += text.count(".") + text.count(",")
            node.links += n if links else 0

    def pop() -> None:
        nonlocal quiet, links, block
        tag, _ = stack.pop()
        quiet -= tag in NO_TEXT
        links -= tag == "a"
        block += tag in BLOCKS

    while True:
        found = _TAG.search(page, at)
        put(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        closing, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            if found.group().startswith("<![CDATA["):
                put(found.group()[9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop()
        for depth in range(len(stack) - 1, 0, -1):
            open_ = stack[depth][0]
            if tag in CLOSED_BY.get(open_, ()):
                while len(stack) > depth:
                    pop()
                if open_ not in ("td", "th"):
                    break
            elif open_ in SCOPES:
                break
        if tag == "br" or tag == "wbr":
            put(" " if tag == "br" else "")
        if tag in BLOCKS:
            block += 1
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS | NO_TEXT:
            continue
        parent = stack[-1][1]
        if tag in BLOCKS:
            words = tuple(w.lower() for m in _ATTRIBUTE.finditer(rest) for w in _WORD.findall(next(filter(None, m.groups()), ""))) if rest else ()
            node = Node(tag, words, parent)
            parent.children.append(node)
        else:
            node = parent
            node.tags += 1
        stack.append((tag, node))
        quiet += tag in NO_TEXT
        links += tag == "a"
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes with text, parents first; text beside blocks becomes a node of its own; sums over subtrees are filled in."""
    out: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        out.append(node)
        if node.children and node.direct:
            own = Node("#text", (), node)
            own.pieces, node.pieces = node.pieces, []
            own.direct, own.marks, own.links = node.direct, node.marks, node.links
            node.direct = node.marks = node.links = 0
            node.children.append(own)
        todo += reversed(node.children)
    for node in reversed(out):
        node.chars += node.direct
        node.tags += 1
        node.children = [c for c in node.children if c.chars]
        if node.parent:
            for name in ("chars", "links", "marks", "tags"):
                setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))
    return [node for node in out if node.chars]


#: Thresholds of the numeric features, in the order in which `described` gives them.
STEPS = [
    [5, 20, 50, 100, 200, 400, 800, 1600, 3200], [5, 10, 20, 40, 80, 160, 320], [0.05, 0.15, 0.3, 0.5, 0.7, 0.9],
    [0.002, 0.006, 0.012, 0.02, 0.03, 0.05], [0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8], [0.05, 0.1, 0.3, 0.5, 0.8, 0.95],
    [1.5, 2.5, 3.5, 4.5, 5.5, 7.5], [0.1, 0.3, 0.5, 0.7, 0.9], [0.5, 1.5, 3.5, 7.5, 15.5], [10, 40, 100, 200, 400], [0.1, 0.3, 0.5, 0.7, 0.9],
    [0.5, 1.5, 3.5, 8.5], [0.05, 0.15, 0.3, 0.5, 0.7, 0.9],
]


def described(all_: list[Node], vocabulary: dict[str, int]) -> np.ndarray:
    """0/1 features of the nodes of one page."""
    size = len(vocabulary)
    out = np.zeros((len(all_), sum(map(len, STEPS)) + 2 * size), np.uint8)
    page = max(1, all_[0].chars) if all_ else 1
    numbers = np.zeros((len(all_), len(STEPS)))
    marks: dict[int, set[int]] = {}
    seen = 0
    met: dict[int, int] = {}  # children of a node so far
    kinds: dict[int, tuple[dict[str, int], float]] = {}  # tags among a node's children, and their mean characters
    for i, node in enumerate(all_):
        parent = node.parent
        siblings = parent.children if parent else [node]
        if (known := kinds.get(id(parent))) is None:
            tags: dict[str, int] = {}
            for s in siblings:
                tags[s.tag] = tags.get(s.tag, 0) + 1
            known = kinds[id(parent)] = tags, sum(s.chars for s in siblings) / len(siblings)
        place = met.get(id(parent), 0) / max(1, len(siblings) - 1)
        met[id(parent)] = met.get(id(parent), 0) + 1
        same = known[0][node.tag] - 1
        numbers[i] = (
            node.chars, node.chars / node.tags, node.links / node.chars, node.marks / node.chars, node.chars / page,
            node.chars / max(1, parent.chars) if parent else 1.0, node.depth, place, same,
            known[1], seen / page, len(node.children),
            (parent.links / max(1, parent.chars)) if parent else 0.0,
        )
        seen += node.direct
        own = {vocabulary[w] for w in (f"<{node.tag}>", *node.words) if w in vocabulary}
        above = marks.get(id(parent), set()) if parent else set()
        out[i, [k for k in own]] = 1
        out[i, [size + k for k in above]] = 1
        marks[id(node)] = own | above
    column = 2 * size
    for k, steps in enumerate(STEPS):
        for step in steps:
            out[:, column] = numbers[:, k] > step
            column += 1
    return out


def decoded(all_: list[Node], logs: np.ndarray) -> list[int]:
    """The likeliest labels in which nodes under a MAIN or OTHER node have its label."""
    place = {id(node): i for i, node in enumerate(all_)}
    best = logs.copy()
    inside: set[int] = set()  # nodes in an article
    for i, node in enumerate(all_):
        if node.tag in ARTICLES or node.parent and id(node.parent) in inside:
            inside.add(id(node))
        never = node.tag in NEVER_MAIN and not (node.tag == "form" and 2 * node.chars > all_[0].chars)
        if never or node.tag == "header" and id(node) not in inside:
            best[i] = (-math.inf, 0.0, -math.inf)
    best[[i for i, node in enumerate(all_) if not node.children], MIXED] = -math.inf
    for i in range(len(all_) - 1, 0, -1):
        up = place[id(all_[i].parent)]
        best[up, MAIN] += best[i, MAIN]
        best[up, OTHER] += best[i, OTHER]
        best[up, MIXED] += best[i].max()
    labels = [MIXED] * len(all_)
    for i, node in enumerate(all_):
        above = labels[place[id(node.parent)]] if node.parent else MIXED
        labels[i] = int(best[i].argmax()) if above == MIXED else above
    return labels


class Extractor:
    """Fitted trees and the vocabulary of tags and attribute words."""

    def __init__(self, vocabulary: dict[str, int], trees: BoostedTrees):
        self.vocabulary, self.trees = vocabulary, trees

    def texts(self, pages: list[str]) -> list[str]:
        trees = [nodes(parse(page)) for page in pages]
        rows = [described(t, self.vocabulary) for t in trees if t]
        logs = self.trees.log_odds(np.concatenate(rows)) if rows else np.zeros((0, 3))
        out, at = [], 0
        for tree in trees:
            labels = decoded(tree, logs[at : at + len(tree)]) if tree else []
            at += len(tree)
            blocks: dict[int, list[str]] = {}
            for node, label in zip(tree, labels, strict=True):
                if label == MAIN:
                    for block, text in node.pieces:
                        blocks.setdefault(block, []).append(text)
            lines = (_SPACE.sub(" ", "".join(blocks[b])).strip() for b in sorted(blocks))
            out.append("\n".join(line for line in lines if line))
        return out


# Words of class, id and role attributes in common use, by what they mark.
OTHER_WORDS = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links tabs pagination pager toc navigation-main skip",
    "header": "header masthead banner branding logo top site-header page-header tagline topbar",
    "footer": "footer copyright site-info bottom colophon legal imprint site-footer page-footer",
    "aside": "sidebar aside widget related recommended popular trending complementary more-stories see-also tags archive rail",
    "ad": "ad ads advert advertisement sponsored promo banner-ad sponsor promotion adbox ad-slot dfp outbrain commercial",
    "notice": "cookie consent notice alert gdpr newsletter subscribe signup popup modal paywall overlay disclaimer message warning banner-notice",
    "share": "share social sharing tools actions buttons follow like rating",
    "comments": "comments comment comment-list discussion responses replies reader-comments disqus respond feedback thread",
}
MAIN_WORDS = "article content post entry story main text body article-body post-content entry-content story-body main-content page-content hentry prose"
WRAPPER_WORDS = "wrapper container page row col layout site outer inner grid wrap section"


def written_page(source: random.Random) -> tuple[str, str]:
    """A page and its article's text.  Spans of the article are between private-use characters while it is written."""
    letters = "etaoinshrdlucmfwypvbgkéäñ"

    def words(n: int) -> str:
        out = ["".join(source.choice(letters) for _ in range(source.randint(2, 10))) + source.choice(["", "", "", "", "", ",", "."]) for _ in range(n)]
        return (" ".join(out)).capitalize() + "."

    def attributes(pool: str, chance: float = 0.85) -> str:
        if source.random() > chance:
            return ""
        return f' {source.choice(["class", "class", "id"])}="{" ".join(source.sample(pool.split(), source.choice([1, 1, 2])))}"'

    def link(n: int) -> str:
        return f'<a href="/{source.randint(1, 999)}">{words(n)}</a>'

    def listing(n: int, length: int = 2) -> str:
        return "<ul>" + "".join(f"<li>{link(source.randint(1, length))}</li>" for _ in range(n)) + "</ul>"

    def other(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "comments": "section"}.get(kind, "div")
        semantic = tag != "div" and tag != "section" and source.random() < 0.6
        head = f"<{tag}{attributes(OTHER_WORDS[kind], 0.4)}>" if semantic else f"<{'div' if tag != 'section' or source.random() < 0.5 else tag}{attributes(OTHER_WORDS[kind], 1)}>"
        name = re.match(r"<(\w+)", head).group(1)
        plain = lambda: source.choice([words(source.randint(2, 45)), f"<p>{words(source.randint(2, 45))}</p>", f"<span>{words(5)}</span>"])
        body = {
            "nav": lambda: source.choice([listing(source.randint(2, 9)), " | ".join(link(1) for _ in range(source.randint(2, 8)))]),
            "header": lambda: f"<div>{link(2)}</div>" + source.choice(["", f"<p>{words(6)}</p>", f"<h1>{words(3)}</h1>", listing(4)]),
            "footer": lambda: f"&copy; {words(source.randint(2, 30))}" + source.choice(["", listing(4), f"<p>{words(15)}</p>", f"<div>{words(9)}</div>"]),
            "aside": lambda: source.choice(["", f"<h3>{words(2)}</h3>"]) + source.choice([listing(5, 8), plain(), plain() + listing(3, 6)]),
            "ad": lambda: source.choice([plain(), link(6), plain() + plain(), words(source.randint(3, 30)) + "\n" + words(3)]),
            "notice": lambda: plain() + source.choice(["", link(1), "<button>OK</button>", f"<form><label>{words(2)}</label><input></form>"]),
            "share": lambda: " ".join(link(1) for _ in range(source.randint(2, 5))),
            "comments": lambda: f"<h3>{words(2)}</h3>" + "".join(
                f'<div{attributes("comment reply comment-body response", 0.7)}>{source.choice(["", link(1)])}<p>{words(source.randint(3, 60))}</p></div>' for _ in range(source.randint(1, 6))
            ),
        }[kind]()
        return f"{head}{body}</{name}>"

    def mine(text: str) -> str:
        return f"\ue000{text}\ue001"

    def paragraph() -> str:
        n = source.choice([1, 2, 5, 12, 30, 60, 100])
        text = words(n)
        if source.random() < 0.2:
            text += " " + link(2) + " " + words(4)
        kind = source.random()
        if kind < 0.78:
            return f"<p>{text}</p>" if source.random() < 0.85 else f"<p><b>{text}<br>"
        if kind < 0.84:
            return f"<h2>{words(4)}</h2>"
        if kind < 0.89:
            return "<ul>" + "".join(f"<li>{words(source.randint(2, 20))}</li>" for _ in range(source.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.96:
            return f"<pre>{text}</pre>"
        return f"<table><tr><td>{words(3)}</td><td>{words(4)}</td></tr></table>" if kind < 0.98 else f"<div>{text}</div>"

    parts = [mine(f"<h1>{words(6)}</h1>" if source.random() < 0.8 else "")]
    if source.random() < 0.15:
        parts[0] = f"<header>{parts[0]}</header>"
    for _ in range(source.choice([1, 2, 3, 5, 8, 14])):
        parts.append(mine(paragraph()))
        if source.random() < 0.07:
            parts.append(other(source.choice(["ad", "share", "aside", "notice"])))
    tag = source.choice(["article", "article", "article", "main", "div", "div", "section"])
    article = "".join(parts)
    body = f"<{tag}{attributes(MAIN_WORDS, 0.35 if tag in ('article', 'main') else 0.95)}>{article}</{tag}>"
    if source.random() < 0.25:
        body += other("comments")
    if source.random() < 0.4:
        body = source.choice(["<main{}>{}</main>", "<div{}>{}</div>"]).format(attributes(WRAPPER_WORDS + " " + MAIN_WORDS), body)
    before = "".join(other(k) for k in ("notice", "header", "nav", "ad") if source.random() < 0.5)
    after = "".join(other(k) for k in ("share", "ad", "aside", "notice", "footer") if source.random() < 0.45)
    page = before + body + after
    for _ in range(source.choice([0, 0, 1, 2])):
        page = f"<div{attributes(WRAPPER_WORDS)}>{page}</div>"
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>"
    return page, article


def labelled(root_nodes: list[Node]) -> list[int]:
    """Labels of the nodes of a written page, whose article's characters stand between marks."""
    inside = False
    hits: dict[int, list[int]] = {id(node): [0, 0] for node in root_nodes}
    pieces = sorted(((block, k, node, i) for k, node in enumerate(root_nodes) for i, (block, _) in enumerate(node.pieces)), key=lambda x: (x[0], x[1], x[3]))
    for _, _, node, i in pieces:
        block, text = node.pieces[i]
        for part in re.split("([\ue000\ue001])", text):
            if part in ("\ue000", "\ue001"):
                inside = part == "\ue000"
            elif part.strip():
                up: Node | None = node
                while up:
                    if id(up) in hits:
                        hits[id(up)][0 if inside else 1] += 1
                    up = up.parent
        node.pieces[i] = block, text.replace("\ue000", "").replace("\ue001", "")
    return [MIXED if a and b else MAIN if a else OTHER for a, b in hits.values()]


def fit(pages: int = 700, seed: int = 5, words: int = 160) -> Extractor:
    """Trees fitted to `pages` written pages, with the `words` commonest tags and attribute words."""
    source = random.Random(seed)
    trees, labels = [], []
    for _ in range(pages):
        marked, _ = written_page(source)
        places = nodes(parse(marked))
        truth = labelled(places)
        clean = nodes(parse(marked.replace("\ue000", "").replace("\ue001", "")))
        kept = [(n, t) for n, t in zip(places, truth, strict=True) if any(x.strip(" \n\ue000\ue001") for _, x in n.pieces) or n.children]
        if len(kept) == len(clean):
            trees.append(clean)
            labels += [t for _, t in kept]
    count: dict[str, int] = {}
    for tree in trees:
        for word in {w for node in tree for w in (f"<{node.tag}>", *node.words)}:
            count[word] = count.get(word, 0) + 1
    common = sorted(count, key=lambda w: (-count[w], w))[:words]
    vocabulary = {w: i for i, w in enumerate(sorted(common))}
    rows = np.concatenate([described(tree, vocabulary) for tree in trees])
    return Extractor(vocabulary, BoostedTrees(3).fit(rows, np.array(labels)))


_FITTED: dict[tuple[int, int], Extractor] = {}


def main_text(pages: DataFrame, written: int = 700, seed: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    if (written, seed) not in _FITTED:
        _FITTED[written, seed] = fit(written, seed)
    model = pages.sparkSession.sparkContext.broadcast(_FITTED[written, seed])

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array(model.value.texts(batch.column(2).to_pylist()), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return mapped(rows, extract, "page_id long, url string, text string")
