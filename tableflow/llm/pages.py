"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A leaf block is the text between two block-level tags. Its features are the tags and the class and id words of its
ancestors, and the shape of its text; neighbouring blocks are tied by whether they share a container. The field
learns from labelled pages: a bounded sample of the table, labelled where a page marks its article itself, and the same
paragraphs dressed in other layouts, where the labels are known. Viterbi decoding picks the blocks of the article.

Cases: a null or empty page, or one without visible text, has an empty text. Broken markup is read as browsers
read it: unclosed elements end with their parents, the head with the first thing that cannot stand in it, stray end tags are passed over. Pages are judged one by
one and whole; repeated rows get the same text; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm import spans

# Pages of the table that the field learns from, at most, and how often each is dressed anew.
SAMPLE = 120
DRESSES = 4
ROUNDS = 6

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template head svg iframe object canvas title textarea select math audio video".split())
# Start tags that leave the head open; any other, or text, ends it.
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes style script template".split())
RAW = set("script style textarea title iframe noscript".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br".split()
)
# An open element that a start tag of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table select menu".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL
)
NAMES = re.compile(r"\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    """Text of a leaf block, how much of it is in links, and its ancestors as (tag, words of class and id)."""

    text: str
    linked: int
    path: tuple[tuple[str, tuple[str, ...]], ...]


def _words(attributes: str) -> tuple[str, ...]:
    out = []
    for name, *values in NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "style":
            out += ["unseen"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
        elif name in ("hidden", "aria-hidden"):
            out += ["unseen"] if value != "false" else []
        else:
            out += [w.lower() for w in PARTS.findall(value)]
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page with visible text, in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    links: list[str] = []
    at, unseen, in_link = 0, 0, 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(links)).split()))
                path = tuple(x for x in stack if x[0] not in INLINE or x[1])
                out.append(Block(text, linked, path))
            pieces.clear()
            links.clear()

    def pop(to: int) -> None:
        nonlocal unseen, in_link
        while len(stack) > to:
            tag = stack.pop()[0]
            unseen -= tag in UNSEEN
            in_link -= tag == "a"

    def leave_head() -> None:
        if stack and stack[-1][0] == "head":
            pop(len(stack) - 1)

    end = len(page)
    while at < end:
        found = page.find("<", at)
        to = end if found < 0 else found
        if unseen and page[at:to].strip(" \t\n\f\r"):
            leave_head()
        if to > at and not unseen:
            pieces.append(page[at:to])
            if in_link:
                links.append(page[at:to])
        if found < 0:
            break
        tag = TAG.match(page, found)
        if not tag:
            leave_head()
            if not unseen:
                pieces.append("<")
            at = found + 1
            continue
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name not in INLINE:
            flush()
        elif name == "br" and not unseen:
            pieces.append("\n")
        if tag[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name not in IN_HEAD:
            leave_head()
        if name in VOID or tag[3].endswith("/") and name in ("svg", "path", "math"):
            continue
        if name not in INLINE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in SIBLINGS.get(name, ()):
                    pop(k)
                    break
                if stack[k][0] in LISTS or stack[k][0] not in INLINE and name not in SIBLINGS:
                    break
        stack.append((name, _words(tag[3]) if tag[3] else ()))
        unseen += name in UNSEEN
        in_link += name == "a"
        if name in RAW:
            closing = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
            at = closing.start() if closing else end
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Features of each block of a page."""
    out = []
    n = len(found)
    for k, block in enumerate(found):
        tags = [t for t, _ in block.path]
        own = ["bias", f"leaf:{tags[-1] if tags else ''}"]
        own += {f"in:{t}" for t in tags if t not in ("html", "body", "div", "p")}
        own += {f"word:{w}" for _, words in block.path for w in words}
        size = len(block.text)
        own.append(f"size:{min(10, size.bit_length())}")
        share = block.linked / max(1, size)
        own.append(f"links:{0 if share < 0.1 else 1 if share < 0.5 else 2}")
        own.append(f"end:{block.text[-1] if block.text[-1] in '.!?:;…' else 'other'}")
        own.append(f"inside:{min(3, block.text.count('. '))}")
        if "©" in block.text:
            own.append("rights")
        own.append(f"at:{4 * k // n}")
        out.append(own)
    return out


def joints(found: list[Block]) -> list[int]:
    """For each block but the first: 1 if its container is that of the block before."""
    return [int(a.path[:-1] == b.path[:-1]) for a, b in zip(found, found[1:])]


@dataclass
class Field:
    """Weight of each feature for being part of the article, and of each pair of neighbouring labels (by joint)."""

    weights: dict[str, float]
    pairs: np.ndarray

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in row]) for row in rows]

    def decode(self, rows: list[list[str]], ties: list[int]) -> list[int]:
        """The most probable labels (Viterbi)."""
        back = []
        no, yes = 0.0, 0.0
        pairs = self.pairs.tolist()
        for k, score in enumerate(self.scores(rows)):
            if k:
                (nn, ny), (yn, yy) = pairs[ties[k - 1]]
                back.append((int(yes + yn > no + nn), int(yes + yy > no + ny)))
                no, yes = max(no + nn, yes + yn), max(no + ny, yes + yy)
            yes += score
        labels = [int(yes > no)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Fit the conditional log-likelihood by stochastic gradient steps (AdaGrad); the order is fixed by a seed."""
    field = Field({}, np.zeros((2, 2, 2)))
    power: dict[str, float] = {}
    pair_power = np.full((2, 2, 2), 1e-6)
    data = [(features(b), joints(b), y) for b, y in pages if b]
    order = random.Random(7)
    for _ in range(rounds):
        order.shuffle(data)
        for rows, ties, labels in data:
            n = len(rows)
            emit = np.zeros((n, 2))
            emit[:, 1] = field.scores(rows)
            fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
            fore[0] = emit[0]
            for k in range(1, n):
                fore[k] = emit[k] + np.logaddexp.reduce(fore[k - 1][:, None] + field.pairs[ties[k - 1]], axis=0)
            for k in range(n - 2, -1, -1):
                aft[k] = np.logaddexp.reduce(field.pairs[ties[k]] + (emit[k + 1] + aft[k + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(fore[-1])
            chance = np.exp(fore + aft - total)[:, 1]
            step = np.zeros((2, 2, 2))
            for k in range(1, n):
                both = fore[k - 1][:, None] + field.pairs[ties[k - 1]] + (emit[k] + aft[k])[None, :] - total
                step[ties[k - 1]] -= np.exp(both)
                step[ties[k - 1], labels[k - 1], labels[k]] += 1
            for row, y, p in zip(rows, labels, chance.tolist()):
                for f in row:
                    g = (y - p) - decay * field.weights.get(f, 0.0)
                    power[f] = power.get(f, 1e-6) + g * g
                    field.weights[f] = field.weights.get(f, 0.0) + rate * g / power[f] ** 0.5
            pair_power += step * step
            field.pairs = field.pairs + rate * step / np.sqrt(pair_power)
    return field


# Layouts of the labelled pages: names that sites give to parts of a page. Fixed values.
ARTICLE = ["content", "article", "post", "entry", "story", "main", "text", "body", "post-content", "entry-content", "article-body", "main-text", "story-body", "page-content"]
PARTS_OF_PAGE = {
    "menu": ("nav", "div", "ul", "header"),
    "header": ("header", "div"),
    "footer": ("footer", "div"),
    "sidebar": ("aside", "div", "section"),
    "notice": ("div", "section", "aside", "p"),
    "ad": ("div", "aside", "section", "ins"),
    "form": ("form", "div"),
    "comments": ("div", "section", "ol"),
    "related": ("div", "section", "aside", "ul"),
    "share": ("div", "ul"),
}
PART_NAMES = {
    "menu": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "main-menu", "toc", "pagination"],
    "header": ["header", "masthead", "site-header", "topbar", "banner", "logo", "page-header", "branding"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom", "imprint"],
    "sidebar": ["sidebar", "side", "widget", "rail", "secondary", "aside", "right-col", "widget-area"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "banner", "paywall", "disclaimer", "cookie-banner", "privacy-notice", "warning", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsense", "ad-slot", "teaser"],
    "form": ["form", "search", "login", "newsletter", "subscribe", "signup", "contact-form", "search-form", "register"],
    "comments": ["comments", "comment", "comment-list", "responses", "replies", "discussion", "disqus", "comment-body", "reader-comments", "respond", "feedback"],
    "related": ["related", "recommended", "more", "read-more", "popular", "trending", "latest", "see-also", "related-posts"],
    "share": ["share", "social", "sharing", "follow", "share-buttons", "social-links", "tags", "meta", "byline", "author-box"],
}


def _dressed(paragraphs: list[str], fill: list[str], pick: random.Random) -> tuple[list[Block], list[int]]:
    """A page with these paragraphs as its article, in a layout drawn at random, and the labels of its blocks."""
    mark = ""

    def say(low: int, high: int) -> str:
        text = " ".join(pick.choice(fill) for _ in range(pick.randint(low, high)))
        return html.escape(text) + pick.choice(["", ".", "."])

    def named(kind: str) -> tuple[str, str]:
        tag = pick.choice(PARTS_OF_PAGE[kind])
        name = pick.choice(PART_NAMES[kind])
        if tag in ("nav", "footer", "aside", "form", "header") and pick.random() < 0.4:
            return tag, f"<{tag}>"
        return tag, f'<{tag} {pick.choice(["class", "class", "id"])}="{name}">'

    def part(kind: str) -> str:
        tag, head = named(kind)
        if kind in ("menu", "share", "related") and pick.random() < 0.8 or tag in ("ul", "ol") and kind != "comments":
            items = "".join(f'<li><a href="/{k}">{say(1, 4)}</a></li>' for k in range(pick.randint(2, 7)))
            body = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "comments":
            inner = pick.choice(["li", "div", "p", "article"]) if tag != "ol" else "li"
            body = (f"<h3>{say(1, 3)}</h3>" if tag != "ol" else "") + "".join(
                pick.choice([f"<{inner}>{say(4, 60)}</{inner}>", f'<{inner} class="comment"><b>{say(1, 2)}</b><p>{say(4, 60)}</p></{inner}>'])
                for _ in range(pick.randint(1, 5))
            )
        elif kind == "form":
            body = f"<label>{say(1, 3)}</label><input><button>{say(1, 2)}</button>" + pick.choice(["", f"<p>{say(3, 15)}</p>"])
        elif kind == "footer":
            body = pick.choice([f"&copy; {say(1, 6)}", f"<p>&copy; {say(2, 12)}</p>", f"<p>{say(4, 20)}</p>"])
        elif tag == "p":
            body = say(3, 30)
        else:
            body = pick.choice([say(3, 30), f"<p>{say(3, 40)}</p>", f"<h3>{say(1, 4)}</h3><p>{say(4, 40)}</p>", f"<p>{say(3, 20)}</p><p>{say(3, 30)}</p>"])
        return f"{head}{body}</{tag}>"

    inner = []
    if pick.random() < 0.3:
        paragraphs = [" ".join(p.split()[: pick.randint(1, 12)]) for p in paragraphs]
    for paragraph in paragraphs:
        text = mark + html.escape(paragraph)
        kind = pick.choices(["p", "li", "h2", "blockquote", "div", "b"], [12, 1, 1, 1, 1, 1])[0]
        inner.append({"li": f"<ul><li>{text}</li></ul>", "b": f"<p><b>{text}</b></p>"}.get(kind, f"<{kind}>{text}</{kind}>"))
        if pick.random() < 0.06:
            inner.append(part(pick.choice(["ad", "share", "related", "notice", "form"])))
    title = f"<h1>{mark}{html.escape(paragraphs[0][:60])}</h1>" if pick.random() < 0.8 else ""
    if pick.random() < 0.25:
        inner.append(part("comments"))
    holder = pick.choice(["article", "article", "main", "div", "div", "section", "td"])
    name = f' {pick.choice(["class", "id"])}="{pick.choice(ARTICLE)}"' if holder not in ("article", "main") or pick.random() < 0.3 else ""
    if holder == "div" and pick.random() < 0.15:
        name = ""
    body = f"<{holder}{name}>{title}{''.join(inner)}</{holder}>"
    if holder == "td":
        body = f"<table><tr>{body}</tr></table>"
    # Some pages have little or nothing around the article, and some no holder for it.
    around = pick.choice([0.0, 0.2, 0.5, 0.5, 0.5])
    if pick.random() < 0.2:
        body = f"{title}{''.join(inner)}"
    before = [part(k) for k in ("notice", "header", "menu", "form", "ad", "sidebar") if pick.random() < around]
    after = [part(k) for k in ("share", "related", "comments", "ad", "sidebar", "form", "notice", "footer") if pick.random() < around]
    pick.shuffle(before)
    found = blocks(f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    labels = [int(b.text.startswith(mark)) for b in found]
    return [Block(b.text.lstrip(mark), b.linked, b.path) for b in found], labels


CHROME = {w for names in PART_NAMES.values() for name in names for w in name.split("-")} - {"main", "text", "body", "post", "page", "content", "more", "message", "meta"}


def _marked(found: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself; None if it has none."""
    labels = []
    for block in found:
        tags = [t for t, _ in block.path]
        at = next((k for k, t in enumerate(tags) if t in ("article", "main")), None)
        inside = at is not None and not any(
            t in ("nav", "aside", "form", "footer", "button") or CHROME & set(words) for t, words in block.path[at:]
        )
        labels.append(int(inside))
    return labels if any(labels) else None


def learn(pages: DataFrame, key: str = "page_id", body: str = "html", sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` pages of the table, taken in the order of the hash of their key.

    Hashes up to a few times the share of the sample are looked at only, so that a task passes on few pages.
    """
    rows = pages.where(F.col(body).isNotNull()).select(F.xxhash64(key, body).alias("draw"), F.col(body).alias("body"))
    share = min(1.0, 4 * sample / max(1, rows.count()))
    near = rows.where(F.col("draw") <= int(-(2**63) + share * (2**64 - 1025)))
    taken = [blocks(r.body) for r in near.orderBy("draw").limit(sample).collect()]
    pick = random.Random(11)
    labelled, texts, fill = [], [], []
    for found in taken:
        labels = _marked(found)
        if labels:
            labelled.append((found, labels))
        good = [b.text for b, y in zip(found, labels or [int(len(b.text) > 60) for b in found]) if y]
        if good:
            texts.append(good)
        for block in found:
            fill += block.text.split()[:40]
    texts = texts or [["One plain paragraph of words stands here.", "Another one follows it."]]
    fill = fill or ["word", "and", "more"]
    for good in texts * max(DRESSES, -(-120 // len(texts))):
        size = pick.randint(1, min(25, len(good)))
        begin = pick.randint(0, len(good) - size)
        labelled.append(_dressed(good[begin : begin + size], fill, pick))
    return train(labelled)


def main_text(field: Field, page: str | None) -> str:
    """The blocks of the article, joined by a space."""
    found = blocks(page)
    if not found:
        return ""
    labels = field.decode(features(found), joints(found))
    return " ".join(b.text for b, y in zip(found, labels) if y)


def extracted(pages: DataFrame, field: Field, key: str = "page_id", address: str = "url", body: str = "html") -> DataFrame:
    """``key``, ``address``, ``text`` and ``n_chars`` per page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.chunked(batches, body):
            texts = [main_text(shared.value, page) for page in part.column(body).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    key: part.column(key),
                    address: part.column(address),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, address)}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", text string, n_chars long"
    return pages.select(key, address, body).mapInArrow(run, schema)
