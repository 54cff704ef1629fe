"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts.
Each block has features of its ancestors (tags, and words of their class, id and
role), of its text and of its place. A two-label chain (main text, other) is
trained on labelled pages by maximising the regularised conditional
log-likelihood, and decoded by Viterbi.

The tables at hand hold pages without labels, so the labelled pages are written
by `labelled_pages`: a fixed number of made-up pages in many layouts, whose
blocks are known to be article or not. That number (TRAINING_PAGES) is the bound
of the sample. The trained weights have a fixed size and are broadcast.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAINING_PAGES, SEED = 600, 7
WIDTH = 1 << 13
STEPS, RATE, DECAY = 120, 0.15, 1e-4
OTHER, MAIN = 0, 1

# HTML's tags without content; tags whose content is never shown, of which those of ENDLESS go on to the end
# of the page if nothing closes them; and tags within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes".split())
ENDLESS = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img svg math object canvas noscript".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Drawings and formulas lie within a line; HTML's own tags end them, but for those in the parts that may hold HTML.
FOREIGN, HOSTS = frozenset("svg math".split()), frozenset("foreignobject annotation-xml".split())
ENDS_FOREIGN = CLOSES_P | frozenset("b big body br center code dd dt em embed head i img li meta nobr ruby s small span strong strike sub sup tt u var".split())
UNSHOWN = frozenset("annotation annotation-xml defs desc metadata symbol".split())
# Tags that end an open one of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main aside nav body form".split())
# Tags that features name; all others are one kind to them.
NAMED = VOID | RAW | INLINE | CLOSES_P | ENDS_FOREIGN | frozenset(
    "html head body button label select option optgroup legend tr td th thead tbody tfoot caption colgroup video audio picture iframe template slot dialog output progress meter".split()
)
ABRUPT, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
READ = frozenset("class id role aria-label itemprop hidden style".split())
NAME = re.compile(r"[a-z]+|[0-9]+")
SPACE = re.compile(r"\s+")


class Node:
    """An open element as features see it: what it adds to the ancestors' tags and names, which later ones share.

    `tag` and `above` are the last two tags on the way to it that are not within a line, `tags` all of them and `before`
    all but the last. Sets hold tags of NAMED only, so their size has a bound; `added` has what no ancestor has.
    """

    __slots__ = ("above", "added", "before", "named", "parent", "tag", "tags", "total")

    def __init__(self, parent: Node | None, tag: str | None, names: Sequence[str]):
        self.parent, self.total = parent, None
        self.tag, self.above, self.tags, self.before, self.named = ("-", None, frozenset(), frozenset(), False) if parent is None else (
            parent.tag, parent.above, parent.tags, parent.before, parent.named,
        )
        added = [f"name:{x}" for x in names]
        if tag is not None:
            self.above, self.before = self.tag if parent is not None and self.tags else None, self.tags
            self.tag = tag
            if tag not in self.tags:
                self.tags |= {tag}
                added.append(f"in:{tag}")
        self.added = tuple(added)

    def score(self, weights: np.ndarray) -> float:
        """The weights of all that it and its ancestors add; each element is summed once."""
        way, node = [], self
        while node is not None and node.total is None:
            way.append(node)
            node = node.parent
        total = 0.0 if node is None else node.total
        for node in reversed(way):
            for name in node.added:
                total += float(weights[_slot(name)])
            node.total = total
        return total


class Block:
    """A leaf block: its text, how much of it is linked, and the element that it is in."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node = text, linked, node


class Stack:
    """The open elements, with the places of each tag, so that none is searched for from the top."""

    def __init__(self):
        self.open: list[tuple[str, bool, Node, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.names: set[str] = set()
        self.hidden = 0
        self.root = Node(None, None, ())

    def node(self) -> Node:
        return self.open[-1][2] if self.open else self.root

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of one of the tags; -1 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def foreign(self) -> int:
        """The place of the outermost drawing or formula that no part that may hold HTML stands in; -1 for none."""
        host = self.last(HOSTS)
        found = [places[i] for t in FOREIGN if (places := self.at.get(t)) and (i := bisect.bisect(places, host)) < len(places)]
        return min(found, default=-1)

    def push(self, tag: str, names: Sequence[str], hidden: bool) -> None:
        new = tuple(dict.fromkeys(x for x in names if x not in self.names))
        self.names.update(new)
        node = Node(self.node(), None if tag in INLINE else tag if tag in NAMED else "other", new)
        node.named = node.named or bool(names)
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hidden, node, new))
        self.hidden += hidden

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, hidden, _, new = self.open.pop()
            self.at[tag].pop()
            self.names.difference_update(new)
            self.hidden -= hidden
        while self.scopes and self.scopes[-1] >= k:
            self.scopes.pop()


class Ends:
    """Where a page's tags and unshown contents end; what was not found once is not sought again."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.missing: set[str] = set()

    def of_tag(self, at: int) -> int:
        """The place of the `>` that ends a tag: the first one outside of quoted values (or at all, once a quote has no end); -1 for none."""
        i = at
        while self.quotes and (m := QUOTE_OR_END.search(self.page, i)):
            if m[0] == ">":
                return m.start()
            i = m.end()
            if self.page[at : m.start()].rstrip()[-1:] == "=":
                i = self.page.find(m[0], i) + 1
                self.quotes = i > 0
        return self.page.find(">", at)

    def of_content(self, tag: str, at: int) -> int:
        """Where the page goes on behind content that is never shown; -1 if nothing closes it."""
        if tag in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(self.page, at)
        if not m:
            self.missing.add(tag)
        return m.end() if m else -1


def read_attributes(text: str) -> tuple[list[str], bool]:
    """The words of the attributes that features read, and whether the element is hidden."""
    names: list[str] = []
    hidden = False
    seen: set[str] = set()
    for a in ATTRIBUTE.finditer(text):
        key = a[1].lower()
        if key not in READ or key in seen:
            continue
        seen.add(key)
        value = (a[2] or a[3] or a[4] or "").lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key != "style":
            names += NAME.findall(value)
    return names, hidden


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order, with character references decoded and white space made single.

    Tags need no closing ones; broken markup is read as browsers do, in time linear in the page's length. Content that
    is never shown (scripts, styles and the like), comments and hidden elements give no blocks.
    """
    out: list[Block] = []
    stack, parts, linked = Stack(), [], 0
    page = page or ""
    ends = Ends(page)

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts)).replace("\x00", " ")).strip()
        if text:
            out.append(Block(text, linked, stack.node()))
        parts.clear()
        linked = 0

    def show(piece: str) -> None:
        nonlocal linked
        if piece and not stack.hidden:
            parts.append(piece)
            linked += len(piece) if stack.at.get("a") else 0

    def behind(mark: str, at: int) -> int:
        found = page.find(mark, at)
        return len(page) if found < 0 else found + len(mark)

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            show(page[at:])
            break
        show(page[at:start])
        if page.startswith("<!--", start):
            m = COMMENT_END.search(page, start + 4)
            abrupt = ABRUPT.match(page, start + 4)
            at = abrupt.end() if abrupt else m.end() if m else len(page)
            continue
        foreign = stack.foreign() if stack.at else -1
        if foreign >= 0 and page.startswith("<![CDATA[", start):
            at = behind("]]>", start + 9)
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = behind(">", start + 2)
            continue
        m = TAG.match(page, start)
        if not m:
            show("<")
            at = start + 1
            continue
        end = ends.of_tag(m.end())
        if end < 0:
            break  # a tag that never ends
        at = end + 1
        tag, closing, inner = m[2].lower(), bool(m[1]), page[m.end() : end]
        if not closing and tag in RAW:
            if foreign < 0 or not inner.endswith("/"):  # outside of drawings and formulas a slash closes nothing
                found = ends.of_content(tag, at)
                at = found if found >= 0 else len(page) if tag in ENDLESS else at
            continue
        if foreign >= 0 and tag in ENDS_FOREIGN and not closing:
            stack.pop_to(foreign)
            foreign = -1
        if tag == "br" or foreign >= 0 and tag == "text":
            parts.append(" ")
            if tag == "br":
                continue
        if tag not in INLINE and (foreign < 0 or closing and tag in ENDS_FOREIGN):
            flush()
        if closing:
            if stack.at.get(tag):
                stack.pop_to(stack.at[tag][-1])
            continue
        scope = stack.scopes[-1] if stack.scopes else -1
        if tag in CLOSES_P and (k := stack.last(("p",))) > scope:
            stack.pop_to(k)
        if tag in SIBLINGS and (k := stack.last(SIBLINGS[tag])) > scope:
            stack.pop_to(k)
        if tag in VOID or (foreign >= 0 or tag in FOREIGN) and inner.endswith("/"):
            continue
        names, hidden = read_attributes(inner) if inner and not inner.isspace() else ((), False)
        stack.push(tag, names, hidden or foreign >= 0 and tag in UNSHOWN)
    flush()
    return out


@functools.lru_cache(1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


def features(blocks: Sequence[Block]) -> list[list[int]]:
    """The hashed features of each block but those that its ancestors add: text, place, and the kind of its neighbours."""
    n, out, kinds = len(blocks), [], []
    for b in blocks:
        words = b.text.count(" ") + 1
        kinds.append((min(words.bit_length(), 8), min(3, 4 * b.linked // max(len(b.text), 1)), b.node.tag))
    for i, b in enumerate(blocks):
        (words, links, tag), node = kinds[i], b.node
        marks = sum(b.text.count(c) for c in ".!?")
        own = ["bias", f"tag:{tag}", f"words:{words}", f"links:{links}", f"marks:{min(marks, 4)}", f"words:{words}:links:{links}", f"tag:{tag}:words:{words}"]
        own += [f"above:{node.above}"] * (node.above is not None)
        own += [f"under:{t}:{tag}" for t in node.before]
        own += [f"named:{node.named}:{tag}", f"named:{node.named}:{'article' in node.tags or 'main' in node.tags}"]
        own += [f"place:{min(9, 10 * i // n)}", "first" if i == 0 else "last" if i == n - 1 else "mid"]
        own += [f"copyright:{'©' in b.text[:40]}", f"ends:{b.text[-1] in '.!?…:”»'}"]
        for d in (-1, 1):
            if 0 <= i + d < n:
                own += [f"near{d}:tag:{kinds[i + d][2]}", f"near{d}:words:{kinds[i + d][0]}"]
        out.append([_slot(f) for f in own])
    return out


def all_features(blocks: Sequence[Block]) -> list[list[int]]:
    """The features of each block with those that its ancestors add, one by one: for training."""
    out = features(blocks)
    for b, own in zip(blocks, out):
        node = b.node
        while node is not None:
            own += [_slot(f) for f in node.added]
            node = node.parent
    return out


class Field:
    """The chain: weights of each feature for main text against other, and of each pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def decode(self, blocks: Sequence[Block]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        scores = [float(self.weights[f].sum()) + b.node.score(self.weights) for b, f in zip(blocks, features(blocks))]
        (stay0, go1), (go0, stay1) = self.pairs.tolist()
        best = [0.0, scores[0]]
        back: list[tuple[int, int]] = []
        for s in scores[1:]:
            to0, to1 = (best[0] + stay0, best[1] + go0), (best[0] + go1, best[1] + stay1)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            best = [max(to0), max(to1) + s]
        label = int(best[1] > best[0])
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def train(pages: Sequence[tuple[Sequence[Block], Sequence[int]]], steps: int = STEPS) -> Field:
    """Weights by full gradient ascent (Adam) on the regularised log-likelihood; forward-backward over all pages at once."""
    pages = [(b, y) for b, y in pages if len(b)]
    longest = max(len(b) for b, _ in pages)
    n = len(pages)
    where, slot = [], []
    label = np.zeros((n, longest), dtype=np.int64)
    real = np.zeros((n, longest), dtype=bool)
    for p, (blocks, y) in enumerate(pages):
        label[p, : len(y)], real[p, : len(y)] = y, True
        for i, f in enumerate(all_features(blocks)):
            where += [p * longest + i] * len(f)
            slot += f
    where, slot = np.array(where), np.array(slot)
    both = real[:, 1:] & real[:, :-1]
    seen = np.bincount(slot, weights=(label.ravel() * real.ravel())[where], minlength=WIDTH)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (label[:, :-1][both], label[:, 1:][both]), 1)
    w = np.zeros(WIDTH + 4)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        unary = np.zeros((n, longest, 2))
        unary[:, :, 1] = np.bincount(where, weights=w[slot], minlength=n * longest).reshape(n, longest)
        pair = w[WIDTH:].reshape(2, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = unary[:, 0]
        for t in range(1, longest):
            come = np.logaddexp(ahead[:, t - 1, :1] + pair[0], ahead[:, t - 1, 1:] + pair[1]) + unary[:, t]
            ahead[:, t] = np.where(real[:, t, None], come, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            onward = behind[:, t + 1] + unary[:, t + 1]
            come = np.logaddexp(onward[:, :1] + pair[:, 0], onward[:, 1:] + pair[:, 1])
            behind[:, t] = np.where(both[:, t, None], come, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        main = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * real
        grad = np.zeros_like(w)
        grad[:WIDTH] = seen - np.bincount(slot, weights=main.ravel()[where], minlength=WIDTH)
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(ahead[:, :-1, a] + pair[a, b] + unary[:, 1:, b] + behind[:, 1:, b] - total[:, None]) * both
                grad[WIDTH + 2 * a + b] = seen_pairs[a, b] - p.sum()
        grad = grad / n - DECAY * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w = w + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(w[:WIDTH], w[WIDTH:].reshape(2, 2))


# What pages call their parts.
ARTICLE = (
    "article", "main", "section class=post-body", "div class=content", "div class='article-body'", "div id=story", "div class='post entry'",
    "div class='entry-content'", "div role=main", "div itemprop=articleBody", "div class='page text'", "div",
)
SIDE = (
    "aside", "div class=sidebar", "div id=secondary", "div class='widget related'", "section class=related-posts", "div class='recommended links'",
    "div class=popular", "aside class=trending",
)
NOTICE = (
    "div class=cookie-banner", "div id=cookie-notice", "div role=alert", "div class='gdpr consent'", "section class=notice",
    "div class='notification bar'", "div class=alert", "div class='newsletter signup'", "div id=subscribe", "div class=paywall", "dialog",
    "div class=modal", "div class='popup overlay'",
)
ADVERT = (
    "div class=ad", "div class='ads sponsored'", "div id=banner-ad", "aside class=promo", "div class=advertisement", "section class=sponsor",
    "div class='promoted box'", "ins class=adsbygoogle",
)
COMMENT = (
    "section id=comments", "div class=comments", "div class='comment-list'", "ol class=commentlist", "div id=disqus_thread",
    "div class='reader-comments'", "section class=discussion", "ul class=replies",
)
HEAD = ("header", "div class=header", "div id=masthead", "div class=topbar", "header role=banner")
FOOT = ("footer", "div class=footer", "div id=site-footer", "footer role=contentinfo", "div class=copyright")
MENU = (
    "nav", "div class=menu", "ul class=nav", "div class=breadcrumbs", "div role=navigation", "nav class='pagination'", "div class='share social'",
    "div class=tags", "nav id=toc",
)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """`count` made-up pages with a label for each leaf block."""
    rng = random.Random(seed)
    letters = ["the", "an", "er", "in", "st", "to", "ga", "lo", "mi", "é", "ü", "ß", "ño", "re", "on", "de", "ka", "vi", "sch", "ou"]

    def words(n: int) -> str:
        made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(max(n, 1))]
        for i in range(0, n, rng.randint(6, 18)):
            made[i] = made[i].capitalize() + rng.choice(["", "", ",", ".", "&amp;"])
        return " ".join(made)

    def sentence(n: int) -> str:
        return words(n).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose() -> str:
        if rng.random() < terse:
            return sentence(rng.randint(1, 4))
        return " ".join(sentence(rng.randint(4, 25)) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    pages = []
    for _ in range(count):
        label: list[int] = []
        terse = rng.choice([0.0, 0.1, 0.3, 0.8])  # share of very short paragraphs

        def block(tag: str, text: str, kind: int, label=label) -> str:
            label.append(kind)
            closed = rng.random() < 0.9 or tag not in ("p", "li")
            return f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if closed else "")

        def within(tag: str, inner: str) -> str:
            return f"<{tag}>{inner}</{tag.split()[0]}>"

        def menu() -> str:
            items = "".join(block("li", f"<a href=/{i}>{words(rng.randint(1, 3))}</a>", OTHER) for i in range(rng.randint(2, 8)))
            return within(rng.choice(MENU), items if rng.random() < 0.5 else f"<ul>{items}</ul>")

        def side() -> str:
            return within(
                rng.choice(SIDE),
                block(rng.choice(["h2", "h3", "h4"]), words(2), OTHER) + "".join(
                    block(
                        rng.choice(["li", "p"]), rng.choice([f"<a href=#>{words(rng.randint(2, 9))}</a>", sentence(rng.randint(4, 20))]), OTHER,
                    ) for _ in range(rng.randint(1, 6))
                ),
            )

        def notice() -> str:
            inner = "".join(block(rng.choice(["p", "p", "div", "h3"]), sentence(rng.randint(3, 25)), OTHER) for _ in range(rng.randint(1, 2)))
            return within(rng.choice(NOTICE), inner + (block("button", words(1), OTHER) if rng.random() < 0.5 else ""))

        def advert() -> str:
            tag = rng.choice(ADVERT)
            return block(tag, rng.choice([sentence, words])(rng.randint(2, 25)), OTHER) if rng.random() < 0.6 else within(
                tag, block(rng.choice(["p", "div", "h4"]), sentence(rng.randint(3, 25)), OTHER),
            )

        def form() -> str:
            return within(
                "form" + rng.choice(["", " class=search", " id=contact"]),
                block("p", f"<label>{words(2)}</label><input name=q>", OTHER) + (block("button", words(1), OTHER) if rng.random() < 0.7 else ""),
            )

        def comments() -> str:
            each = "".join(
                within(
                    rng.choice(["div class=comment", "li class=comment", "article class=comment", "div"]),
                    block(
                        rng.choice(["p class=author", "h4", "div class=meta"]), words(2), OTHER,
                    ) + "".join(block("p", prose(), OTHER) for _ in range(rng.randint(1, 2))),
                ) for _ in range(rng.randint(1, 4))
            )
            return within(
                rng.choice(COMMENT),
                (block(rng.choice(["h2", "h3"]), words(2), OTHER) if rng.random() < 0.7 else "") + each + (form() if rng.random() < 0.4 else ""),
            )

        def article() -> str:
            inner = ""
            if rng.random() < 0.85:
                title = block(rng.choice(["h1", "h1", "h1", "h2"]), words(rng.randint(2, 10)), MAIN)
                inner += within("header", title + (block("p class=byline", words(4), OTHER) if rng.random() < 0.5 else "")) if rng.random() < 0.15 else title
            for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14, 40])):
                r = rng.random()
                if r < 0.7:
                    inner += f"<p><b>{prose()}<br>" if rng.random() < 0.15 and not label.append(MAIN) else block(
                        "p", prose() + rng.choice(["", "", f" <a href=#>{words(2)}</a>", f" <em>{words(1)}</em>"]), MAIN,
                    )
                elif r < 0.78:
                    inner += block(rng.choice(["h2", "h3"]), words(rng.randint(1, 6)), MAIN)
                elif r < 0.86:
                    inner += within(rng.choice(["ul", "ol"]), "".join(block("li", sentence(rng.randint(2, 14)), MAIN) for _ in range(rng.randint(1, 4))))
                elif r < 0.9:
                    inner += block("blockquote", prose(), MAIN)
                elif r < 0.93:
                    inner += within("table", "<tr>" + "".join(block("td", words(rng.randint(1, 3)), MAIN) for _ in range(rng.randint(1, 4))))
                elif r < 0.95:
                    inner += block("pre", words(rng.randint(3, 20)), MAIN)
                elif r < 0.97:
                    inner += block("div", prose(), MAIN)
                else:
                    inner += rng.choice([advert, side, notice, form])()
            if rng.random() < 0.1:
                inner += comments()
            return within(rng.choice(ARTICLE), inner)

        page = "<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body>"
        before = [
            menu, advert, notice, side, form,
            lambda: within(
                rng.choice(HEAD),
                (block(rng.choice(["h1", "p", "div", "a"]), words(3), OTHER) if rng.random() < 0.6 else "") + (menu() if rng.random() < 0.6 else ""),
            ),
        ]
        after = [comments, side, menu, advert, notice, form]
        page += "".join(rng.choice(before)() for _ in range(rng.choice([0, 1, 2, 2, 3, 4])))
        page += article()
        page += "".join(rng.choice(after)() for _ in range(rng.choice([0, 0, 1, 2, 3])))
        if rng.random() < 0.85:
            page += within(
                rng.choice(FOOT), rng.choice(["", "&copy; "]) + words(rng.randint(2, 15)) + rng.choice(["", " &middot; " + sentence(12)]),
            ) if not label.append(OTHER) else ""
        pages.append((page, label))
    return pages


def trained(count: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    """The field trained on `labelled_pages`; the few pages whose blocks do not match their labels one by one are left out."""
    sets = [(blocks_of(page), label) for page, label in labelled_pages(count, seed)]
    return train([(b, y) for b, y in sets if len(b) == len(y)])


def main_text(field: Field, page: str | None) -> str:
    """The blocks decoded as main text, in page order, joined by two line ends; empty for a null or empty page."""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(blocks)) if y == MAIN)


def extract_column(page: str | Column, field: Field, spark: SparkSession) -> Column:
    held = spark.sparkContext.broadcast((field.weights, field.pairs))

    def make():
        own = Field(*held.value)
        return lambda page: (main_text(own, page),)

    return common.text_udf(make, "text string")(page)["text"]


def extract(pages: DataFrame, field: Field | None = None, html: str = "html", into: str = "text") -> DataFrame:
    """`pages` with the column `into`: each page's main text. A column of that name is replaced; others stay."""
    return pages.withColumn(into, extract_column(F.col(html), field or trained(), pages.sparkSession))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
