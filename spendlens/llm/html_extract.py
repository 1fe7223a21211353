"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: runs of text between tags that start or
end a block, with the tags, classes and ids above them.  Every block gets
features of those ancestors and of its text; a chain with two labels (main or
not) scores blocks and neighbours together, and Viterbi finds the best labelling.

Training pages are a bounded sample of the table (``SAMPLE`` pages of at most
``SAMPLE_CHARS`` characters).  A page that marks its article is labelled by that
mark.  As marks differ between sites, the same texts are also set in layouts
that ``layouts`` makes, whose labels are known: other wrappers around the
article, and menus, headers, sidebars, notices, adverts, forms, comments and
footers around and inside it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.html_scan import next_tag
from spendlens.llm.store import ship

SAMPLE = 240
SAMPLE_CHARS = 40_000
LAYOUTS = 1400           #: pages set in made layouts
STEPS = 300             #: gradient steps
SEED = 3

BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav
ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("noscript", "template", "iframe", "svg")  # without text of the page up to their end tag; script and style also without one
CLOSES = {  # a new tag ends open ones of these kinds, up to the nearest container
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
CONTAINER = frozenset("html body div section article main aside nav header footer form table ul ol dl td blockquote fieldset figure".split())
_P_CLOSERS = BLOCK - {"html", "head", "body", "title", "button", "label", "option", "optgroup", "select", "textarea"}

_ENDS = {tag: re.compile(rf"(?i)</{tag}\s*>") for tag in RAW}
_NAMES = re.compile(r"(?is)\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"(?i)\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")

Block = tuple[str, list[str]]


def _element_features(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"in:{tag}"]
    if attributes:
        for value in _NAMES.findall(attributes):
            for part in _PART.findall(value.strip("\"'")):
                out.append(f"named:{part.lower()}")
        if _HIDDEN.search(attributes):
            out.append("hidden")
    return tuple(out)


def _text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    share = linked / max(1, len(text))
    out = [f"links:{0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.9 else 3}",
           f"words:{0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 60 else 4}",
           f"end:{'stop' if text[-1] in '.!?…。:;\"”»' else 'other'}"]
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if sum(c.isdigit() for c in text) * 4 > len(text):
        out.append("digits")
    return out


def leaf_blocks(html: str, cache: dict | None = None) -> list[Block]:
    """(text, features) of each leaf block with text, in page order.

    Character references are decoded, white space becomes one space.  Open tags
    that a page forgot to close end with their container; stray end tags, broken
    tags and anything else are read without an error.
    """
    cache = {} if cache is None else cache
    blocks: list[Block] = []
    open_ = _Open()
    text: list[str] = []
    linked = 0
    above: tuple[list[str], str] | None = None

    def add(raw: str) -> None:
        nonlocal linked, above
        piece = unescape(raw) if "&" in raw else raw
        if above is None and not piece.isspace():
            above = (list(open_.features), open_.leaf())
        text.append(piece)
        if open_.places.get("a"):
            linked += len(piece)

    def flush() -> None:
        nonlocal text, linked, above
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                features, inner = above or ([], "none")
                blocks.append((joined, [*features, f"leaf:{inner}", *_text_features(joined, linked)]))
        text, linked, above = [], 0, None

    at = 0
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page
    while found := next_tag(html, at):
        if found.start > at:
            add(html[at:found.start])
        at, tag = found.end, found.name
        if not tag:
            continue
        empty = found.attributes.rstrip().endswith("/")
        if tag in RAW and not found.closing:
            if tag not in endless and not (empty and tag == "svg"):
                end = _ENDS[tag].search(html, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        if tag in BLOCK:
            flush()
        if found.closing:
            if tag == "br":
                add(" ")
            else:
                open_.close((tag,), ())
            continue
        if tag in ("br", "wbr", "img", "input"):
            add(" " if tag in ("br", "input") else "")
        if tag in VOID:
            continue
        if tag in CLOSES:
            open_.close(CLOSES[tag], CONTAINER - CLOSES[tag])
        if tag in _P_CLOSERS:
            open_.close(("p",), CONTAINER)
        if empty and tag not in BLOCK:
            continue
        key = (tag, found.attributes)
        if key not in cache:
            if len(cache) > 50_000:
                cache.clear()
            cache[key] = _element_features(tag, found.attributes)
        open_.add(tag, cache[key])
    if at < len(html):
        add(html[at:])
    flush()
    return blocks


class _Open:
    """Open elements, with the features of all of them and each tag's places kept up to date."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.features: dict[str, int] = {}
        self.places: dict[str, list[int]] = {}
        self.blocks: list[str] = []

    def add(self, tag: str, features: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, features))
        for f in features:
            self.features[f] = self.features.get(f, 0) + 1
        if tag in BLOCK:
            self.blocks.append(tag)

    def leaf(self) -> str:
        return self.blocks[-1] if self.blocks else "none"

    def close(self, kinds, stop) -> None:
        """End the innermost element of ``kinds`` and all inside it, unless one of ``stop`` is nearer."""
        at = max((own[-1] for k in kinds if (own := self.places.get(k))), default=-1)
        if at < 0 or any(own[-1] > at for k in stop if (own := self.places.get(k))):
            return
        while len(self.stack) > at:
            tag, features = self.stack.pop()
            self.places[tag].pop()
            for f in features:
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]
            if tag in BLOCK:
                self.blocks.pop()


# -- the chain ------------------------------------------------------------------------------------


class Chain:
    """Two-label chain: a weight for each feature (towards main), and weights of starts, moves and ends."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.start, self.end = np.zeros(2), np.zeros(2)
        self.move = np.zeros((2, 2))

    def decode(self, blocks: list[Block]) -> list[int]:
        """Best labels by Viterbi."""
        if not blocks:
            return []
        get = self.weights.get
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start.tolist()
        back: list[tuple[int, int]] = []
        for i, (_, features) in enumerate(blocks):
            s = sum([get(f, 0.0) for f in features])
            if i:
                from_a = a + m00 >= b + m10
                to_b = a + m01 > b + m11
                back.append((0 if from_a else 1, 0 if to_b else 1))
                a, b = (a + m00 if from_a else b + m10), (a + m01 if to_b else b + m11)
            b += s
        label = 0 if a + self.end[0] >= b + self.end[1] else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train_chain(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    """Fit by gradient ascent (Adam) on the labels' conditional log-likelihood, with forward and backward sums over all pages at once."""
    chain = Chain()
    pages = [(b, y) for b, y in pages if b]
    if not pages:
        return chain
    names: dict[str, int] = {}
    flat, rows = [], []
    longest = max(len(b) for b, _ in pages)
    labels = np.full((len(pages), longest), -1)
    for p, (blocks, y) in enumerate(pages):
        labels[p, :len(y)] = y
        for t, (_, features) in enumerate(blocks):
            for f in features:
                flat.append(names.setdefault(f, len(names)))
                rows.append(p * longest + t)
    flat, rows = np.array(flat), np.array(rows)
    sizes = (labels >= 0).sum(axis=1)
    inside = labels >= 0
    gold = np.maximum(labels, 0)
    n = len(pages)
    theta = np.zeros(len(names) + 8)     # features, start, end, moves
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    # counts of the given labels
    given = np.zeros_like(theta)
    np.add.at(given, flat, gold.reshape(-1)[rows])
    for p in range(n):
        y = gold[p, :sizes[p]]
        given[len(names) + y[0]] += 1
        given[len(names) + 2 + y[-1]] += 1
        np.add.at(given, len(names) + 4 + y[:-1] * 2 + y[1:], 1)
    last = (np.arange(n), sizes - 1)
    for step in range(1, steps + 1):
        w, start, end, move = theta[:len(names)], theta[-8:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[..., 1] = np.bincount(rows, w[flat], n * longest).reshape(n, longest)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + emit[:, t]
        beta[last] = end
        for t in range(longest - 2, -1, -1):
            on = t < sizes - 1
            beta[on, t] = np.logaddexp.reduce(move + (emit[on, t + 1] + beta[on, t + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[last] + end, axis=1)
        state = np.where(inside[..., None], np.exp(np.minimum(alpha + beta - z[:, None, None], 0)), 0)
        expected = np.zeros_like(theta)
        expected[:len(names)] = np.bincount(flat, state[..., 1].reshape(-1)[rows], len(names))
        expected[-8:-6] = state[:, 0].sum(axis=0)
        expected[-6:-4] = state[last].sum(axis=0)
        pair = (alpha[:, :-1, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        expected[-4:] = np.where(inside[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0).sum(axis=(0, 1)).reshape(-1)
        g = (given - expected) / n - decay * theta
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        theta = theta + rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    chain.weights = {f: float(theta[i]) for f, i in names.items()}
    chain.start, chain.end, chain.move = theta[-8:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
    return chain


# -- labelled pages -------------------------------------------------------------------------------

#: Names that sites give to wrappers and to what isn't the article, as classes or ids.
MAIN_NAMES = ["content", "article", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "main-content",
              "articleBody", "story-body", "text", "page-content"]
PLAIN_NAMES = ["", "", "container", "wrapper", "page", "row", "col", "site", "inner", "layout", "box", "block"]
OTHER_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "main-nav", "topnav", "toc", "skip"],
    "header": ["header", "masthead", "site-header", "topbar", "branding", "logo", "page-header", "banner"],
    "footer": ["footer", "site-footer", "colophon", "copyright", "legal", "bottom", "page-footer"],
    "sidebar": ["sidebar", "aside", "widget", "related", "recommended", "rail", "secondary", "popular", "trending", "author-box", "right-column"],
    "notice": ["cookie", "cookie-banner", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "popup", "modal", "paywall",
               "message", "disclaimer", "cookie-notice", "announcement", "warning"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "ad-slot", "banner-ad", "adsbygoogle", "promotion"],
    "form": ["form", "search", "login", "signup", "contact", "search-form", "subscribe-form", "register"],
    "comments": ["comments", "comment", "comment-list", "replies", "disqus", "discussion", "respond", "responses", "reader-comments",
                 "user-comments", "thread", "reviews"],
    "share": ["share", "social", "tags", "share-buttons", "social-links", "follow"],
}
OTHER_TAGS = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
              "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "aside", "p", "dialog"],
              "advert": ["div", "div", "aside", "section", "ins"], "form": ["form", "form", "div"],
              "comments": ["section", "div", "div", "ol", "ul"], "share": ["div", "ul"]}


def _named(rng: random.Random, tag: str, names: list[str], chance: float = 0.85) -> str:
    name = rng.choice(names) if rng.random() < chance else ""
    return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">' if name else f"<{tag}>"


def _other(rng: random.Random, kind: str, say) -> str:
    """A part that isn't the article; ``say(short)`` gives its texts."""
    tag = rng.choice(OTHER_TAGS[kind])
    own = _named(rng, tag, OTHER_NAMES[kind], 0.6 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{say(True)}</a>"'[:-1]
    if kind in ("menu", "share"):
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7)))
        inner = items if tag == "ul" else f"<ul>{items}</ul>" if rng.random() < 0.7 else " ".join(link() for _ in range(3))
    elif kind == "header":
        inner = rng.choice([f"<div>{link()}</div>", f"<h1>{say(True)}</h1><p>{say(False)}</p>", f"<h2>{link()}</h2>", say(True)])
    elif kind == "footer":
        inner = rng.choice([f"&copy; {say(True)} &middot; {say(False)}", f"<p>{say(False)}</p><p>{link()}</p>", f"<p>&copy; 2024 {say(True)}</p>"])
    elif kind == "sidebar":
        inner = f"<h3>{say(True)}</h3>" + rng.choice([f"<p>{say(False)}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{say(False)}</p><p>{say(False)}</p>"])
    elif kind == "form":
        inner = f"<label>{say(True)}</label><input name=q><textarea>{say(True)}</textarea><button>{say(True)}</button>"
        inner += rng.choice(["", f"<p>{say(False)}</p>", f"<select><option>{say(True)}</option><option>{say(True)}</option></select>"])
    elif kind == "comments":
        item = "li" if tag in ("ol", "ul") else "div"
        inner = "" if item == "li" else rng.choice(["", f"<h3>{say(True)}</h3>"])
        inner += "".join(f"{_named(rng, item, ['comment', 'reply', 'comment-body', 'media'], 0.8)}" + rng.choice(["", f"<b>{say(True)}</b>"])
                         + f"<p>{say(False)}</p></{item}>" for _ in range(rng.randint(1, 4)))
    else:
        inner = say(False) if tag == "p" else rng.choice([say(False), f"<p>{say(False)}</p>", f"<p>{say(False)} {link()}</p><button>{say(True)}</button>"])
    return f"{own}{inner}</{tag}>"


def layouts(texts: list[list[str]], count: int = LAYOUTS, seed: int = SEED) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages made from the texts of articles, with their labels.

    Every text that isn't the article's carries a mark while the page is read,
    so a block's label is whether the mark is missing.
    """
    rng = random.Random(seed)
    texts = [t for t in texts if t]
    if not texts:
        return
    pool = [x for t in texts for x in t]
    mark = ""

    def say(short: bool) -> str:
        words = rng.choice(pool).split()
        return mark + escape(" ".join(words[:rng.randint(1, 4) if short else rng.randint(4, 60)]))

    for _ in range(count):
        own = rng.choice(texts)
        kinds = list(OTHER_NAMES)
        body = []
        for i, x in enumerate(own):
            tag = rng.choice(["h1", "h2"]) if i == 0 and rng.random() < 0.5 else rng.choice(["p"] * 12 + ["h2", "h3", "blockquote", "li", "pre", "div"])
            inline = rng.random()
            inner = escape(x)
            if inline < 0.1 and " " in x:
                a, b = x.split(" ", 1)
                inner = f"<b>{escape(a)}</b> {escape(b)}" if inline < 0.05 else f'<a href="/x">{escape(a)}</a> {escape(b)}'
            body.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
            if rng.random() < 0.06:
                body.append(_other(rng, rng.choice(["advert", "notice", "share", "sidebar", "form"]), say))
        wrapper = rng.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        inside = "".join(body) + ("".join(_other(rng, k, say) for k in rng.sample(["comments", "share", "advert", "form", "sidebar"], 2))
                                  if rng.random() < 0.35 else "")
        open_tag = _named(rng, wrapper, MAIN_NAMES, 1.0 if wrapper in ("div", "section", "td") else 0.5)
        article = f"{open_tag}{inside}</{wrapper}>"
        if wrapper == "td":
            article = f"<table><tr>{article}</tr></table>"
        for _ in range(rng.randint(0, 2)):
            article = f"{_named(rng, 'div', PLAIN_NAMES)}{article}</div>"
        before = [_other(rng, k, say) for k in rng.sample(kinds, rng.randint(0, 4))]
        after = [_other(rng, k, say) for k in rng.sample(kinds, rng.randint(0, 4))]
        page = f"<html><head><title>{say(True)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"
        blocks = leaf_blocks(page)
        yield ([(t.replace(mark, ""), f) for t, f in blocks], [int(mark not in t) for t, _ in blocks])


_NOT_MAIN = frozenset("in:nav in:aside in:form in:footer in:header in:title in:button".split())


def marked(html: str) -> tuple[list[Block], list[int]] | None:
    """A page's blocks labelled by its article mark, or None if it has no such mark with text."""
    blocks = leaf_blocks(html)
    other = {f"named:{n.lower()}" for names in OTHER_NAMES.values() for n in names if "-" not in n} | _NOT_MAIN
    labels = [int("in:article" in f and other.isdisjoint(f)) for _, f in blocks]
    return (blocks, labels) if any(labels) else None


def fit_pages(htmls: list[str], seed: int = SEED) -> Chain:
    labelled = [m for m in map(marked, htmls) if m]
    texts = [[t for (t, _), y in zip(blocks, labels) if y] for blocks, labels in labelled]
    if not texts:  # no page marks its article: take what reads like prose
        texts = [[t for t, f in leaf_blocks(h) if "end:stop" in f and t.count(" ") > 8] for h in htmls]
    return train_chain([*labelled, *layouts(texts, seed=seed)])


def main_text(chain: Chain, html: str, cache: dict | None = None) -> str:
    blocks = leaf_blocks(html, cache)
    return "\n".join(t for (t, _), y in zip(blocks, chain.decode(blocks)) if y)


def extract(pages: DataFrame, seed: int = SEED) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Null or empty html, and a page without main text, give an empty text.
    Pages are read whole, whatever their length.  Repeated rows get equal
    texts; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.col("html").cast("string")
    # a hash draws about 0.9 * SAMPLE pages, and the limit bounds them
    chance = min(1.0, 0.9 * SAMPLE / max(pages.count(), 1))
    drawn = (pages.select(html.alias("html")).filter(F.length("html").between(1, SAMPLE_CHARS))
             .filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "html"), 11) < int(chance * (1 << 53))).limit(SAMPLE).collect())
    sent = spark.sparkContext.broadcast(fit_pages(sorted({r["html"] for r in drawn}), seed))  # bounded by SAMPLE and LAYOUTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = [main_text(sent.value, h.as_py() or "", cache) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
            .mapInArrow(run, pages.select("page_id").schema.add("url", "string").add("text", "string").add("n_chars", "long")))
