"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

Method
------
1. The html is cut into leaf blocks: runs of text between block-level tags, each with its
   ancestors (tags, class and id words) and the share of its text inside links.
2. A block's features are its ancestor tags, their class and id words, its parent, and
   figures of its text (length, link share, punctuation, marks of legal lines).
3. A chain over the page's blocks with the labels {main, other} is trained by maximum
   likelihood (exact forward-backward gradients, L2) on labelled pages: ``labelled_pages``
   builds them from layouts whose parts are known, and at most ``SAMPLE`` pages of the
   corpus of fewer than ``LONGEST`` characters that mark their article join them with the
   labels of that markup.
4. Every page is decoded by Viterbi on the workers; blocks labelled main are its text.

Only the weights and the bounded sample pass through the driver.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .textkernel import small_batches

#: Pages of the corpus that may join the training pages, and made-up training pages.
SAMPLE, LABELLED = 200, 300
#: Corpus pages of so many characters are not drawn for training (all are extracted).
LONGEST = 100_000
EPOCHS, RATE, L2 = 120, 0.2, 1e-3

_WS = r"[\t\n\f\r ]"
# An attribute: a name, and maybe a value in quotes or up to white space or ">".
_ATTRIBUTE = rf"[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_WS}*+={_WS}*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r >\"'][^\t\n\f\r >]*+|(?=>)))?+"
_MARKUP = re.compile(
    r"<(?:(?P<comment>!--)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|(?P<bogus>[!?]|/(?![a-zA-Z]))|(?P<end>/?)(?P<name>[a-zA-Z][^\t\n\f\r />]*+))", re.S
)
_REST = re.compile(rf"(?P<attrs>(?:(?:{_WS}|/)*+{_ATTRIBUTE})*+)(?P<tail>(?:{_WS}|/)*+)>")
_COMMENT_END = re.compile(r"(?<=!--)-?>|--!?>")
_ATTR = re.compile(rf"([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{_WS}*+={_WS}*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\t\n\f\r >\"'][^\t\n\f\r >]*+)))?+")
# Element kinds of HTML.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript title iframe textarea noembed noframes".split())  # text up to their own end tag
_DROPPED = frozenset("template svg math object canvas audio video".split())  # elements whose content is no text of the page
_FOREIGN = frozenset("svg math".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_SELF_CLOSING = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_WORD = re.compile(r"[a-z]+")
_LEGAL = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign (?:in|up)\b", re.I)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # ancestor tags, outermost first
    marks: frozenset[str]  # words of their class, id and role
    links: int  # characters inside links


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks in page order; character references decoded, white space squeezed, none empty.

    Tags are read as HTML reads them: a value in quotes may hold any sign, one without
    quotes ends at white space or ">", a slash before ">" closes svg and math alone, and a
    tag or comment that the page's end cuts off is markup still.
    """
    page = page or ""
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[tuple[str, bool]] = []
    out: list[Block] = []
    links = hidden = 0

    def say(text: str):
        if text and not hidden:
            parts.append((entities.unescape(text) if "&" in text else text, links > 0))

    def flush():
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                marks = frozenset().union(*(m for _, m in stack))
                inside = sum(len(p) for p, linked in parts if linked)
                out.append(Block(text, tuple(t for t, _ in stack if t not in _INLINE), marks, min(inside, len(text))))
            parts.clear()

    def close(names, until=()):
        """Close the innermost open element of these names, if none of ``until`` is nearer."""
        nonlocal links, hidden
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                links -= sum(t == "a" for t, _ in stack[k:])
                hidden -= sum(t in _DROPPED for t, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if not m:
            tail = page[at:]
            say(tail[:-1] if tail.endswith("<") else tail[:-2] if tail.endswith("</") else tail)
            flush()
            return out
        say(page[at : m.start()])
        at = m.end()
        if m["comment"]:
            stop = _COMMENT_END.search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if m["cdata"] is not None:
            if not hidden:
                parts.append((m["cdata"], links > 0))
            continue
        if m["bogus"]:
            at = page.find(">", at) + 1 or len(page)
            continue
        name = m["name"].lower()
        rest = _REST.match(page, at)
        if not rest:
            flush()
            return out
        at = rest.end()
        if m["end"]:
            if name not in _INLINE:
                flush()
            if name == "p" and not any(t == "p" for t, _ in stack):
                continue
            close((name,))
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\t\n\f\r />])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            flush()
            continue
        if name not in _INLINE:
            flush()
        if name in _CLOSES_P:
            close(("p",), _CLOSES_P - {"p"})
        elif name in _SELF_CLOSING:
            names, until = _SELF_CLOSING[name]
            close(tuple(names.split()), tuple(until.split()))
        if name not in _VOID and not (name in _FOREIGN and rest["tail"].endswith("/")):
            words = " ".join(x or y or z or "" for key, x, y, z in _ATTR.findall(rest["attrs"]) if key.lower() in ("class", "id", "role")) if rest["attrs"] else ""
            stack.append((name, frozenset(_WORD.findall(words.lower()))))
            links += name == "a"
            hidden += name in _DROPPED


def _bucket(n: float, steps: tuple[float, ...]) -> int:
    return sum(n >= s for s in steps)


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for k, b in enumerate(blocks):
        words = b.text.split(" ")
        f = ["bias", f"length={_bucket(len(words), (2, 4, 8, 16, 40))}", f"links={_bucket(b.links / len(b.text), (0.05, 0.5, 0.9))}"]
        f.append(f"stop={b.text[-1] in '.!?:;…”»'}")
        f.append(f"comma={',' in b.text}")
        if _LEGAL.search(b.text):
            f.append("legal")
        if k == 0:
            f.append("first")
        if k == len(blocks) - 1:
            f.append("last")
        f += [f"under={t}" for t in set(b.path)]
        f.append(f"parent={b.path[-1] if b.path else ''}")
        f += [f"mark={w}" for w in b.marks]
        out.append(f)
    return out


@dataclass
class Chain:
    """Weights: per feature and label, and per label pair (from, to)."""

    weight: dict[str, tuple[float, float]]
    step: tuple[tuple[float, float], tuple[float, float]]

    def emissions(self, blocks: list[Block]) -> list[tuple[float, float]]:
        w, none = self.weight, (0.0, 0.0)
        out = []
        for f in features(blocks):
            found = [w.get(x, none) for x in f]
            out.append((sum(x[0] for x in found), sum(x[1] for x in found)))
        return out

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """Most likely labels; a tie goes to 0 (other)."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.step
        e = self.emissions(blocks)
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            to0 = (a + s00, 0) if a + s00 >= b + s10 else (b + s10, 1)
            to1 = (a + s01, 0) if a + s01 >= b + s11 else (b + s11, 1)
            back.append((to0[1], to1[1]))
            a, b = to0[0] + x, to1[0] + y
        label = [int(b > a)]
        for p in reversed(back):
            label.append(p[label[-1]])
        return label[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return " ".join(b.text for b, y in zip(blocks, self.viterbi(blocks), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = RATE) -> Chain:
    """Maximum likelihood by Adam; all pages go through forward-backward side by side."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    rows, cols, cells = [], [], []
    longest, n = max(len(b) for b, _ in pages), len(pages)
    gold = np.zeros((n, longest), int)
    size = np.array([len(b) for b, _ in pages])
    for i, (blocks, labels) in enumerate(pages):
        gold[i, : len(labels)] = labels
        for t, f in enumerate(features(blocks)):
            for x in f:
                cells.append(index.setdefault(x, len(index)))
                rows.append(i)
                cols.append(t)
    rows, cols, cells = map(np.array, (rows, cols, cells))
    flat = rows * longest + cols
    live = np.arange(longest)[None, :] < size[:, None]
    both = live[:, 1:]
    theta = np.zeros(2 * len(index) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for epoch in range(1, epochs + 1):
        w, step = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        e = np.stack([np.bincount(flat, w[cells, y], n * longest).reshape(n, longest) for y in (0, 1)], axis=2)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = lse(forward[:, t - 1, :, None] + step[None], 1) + e[:, t]
            forward[:, t] = np.where(live[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = lse(step[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], new, 0)
        z = lse(forward[:, -1], 1)
        node = np.exp(forward + backward - z[:, None, None]) * live[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + step[None, None] + (e + backward)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        truth = np.eye(2)[gold] * live[:, :, None]
        diff = (truth - node).reshape(-1, 2)
        g = np.stack([np.bincount(cells, diff[flat, y], len(index)) for y in (0, 1)], axis=1).ravel()
        pairs = (truth[:, :-1, :, None] * truth[:, 1:, None, :] - pair).sum((0, 1)).ravel()
        g = np.append(g, pairs) / n - L2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    w = theta[:-4].reshape(-1, 2)
    return Chain({x: (float(w[k, 0]), float(w[k, 1])) for x, k in index.items()}, tuple(map(tuple, theta[-4:].reshape(2, 2).tolist())))


# Labelled pages ---------------------------------------------------------------------

_SYLLABLES = "an er the ti on re es or ha en st nd ou in ble tion ing ed la de que un aux ich ein sch ver ado cion é ü ñ".split()
# Class and id words of page parts that are not the article.
_OTHER = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination tabs toc",
    "header": "header masthead banner site-header top logo branding",
    "footer": "footer site-footer bottom copyright legal colophon",
    "aside": "sidebar aside widget related recommended trending popular rail secondary",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbox",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe paywall signup disclaimer",
    "form": "form search login contact signup poll",
    "comment": "comment comments commentlist replies discussion reader-comments respond disqus",
    "share": "share social sharing tags meta byline-tools",
}
_MAIN = "article content main post entry story body post-content entry-content article-body text"


def labelled_pages(n: int = LABELLED, seed: int = 1) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, 1 if main)]) of made-up pages whose layout is known."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))

    def sentence(low=4, high=25):
        s = " ".join(word() for _ in range(r.randint(low, high)))
        return s[:1].upper() + s[1:] + r.choice([".", ".", ".", "!", "?", ""])

    def junk_words(text):
        return " ".join(w + r.choice(["###", "***", "&&&", "!!", " |"]) for w in text.split()) if r.random() < 0.1 else text

    pages = []
    for _ in range(n):
        html, truth = [], []

        def put(text, y, tag="p", attrs="", truth=truth):
            truth.append((text, y))
            inner = entities.escape(text)
            return f"<{tag}{attrs}>{inner}</{tag}>" if tag else inner

        def other(kind):
            mark = r.choice(_OTHER[kind].split())
            tag = r.choice({"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form"], "comment": ["section", "div", "ol"]}.get(kind, ["div", "div", "section", "p"]))
            attrs = r.choice([f' class="{mark}"', f' id="{mark}"', ""]) if tag in ("nav", "header", "footer", "aside", "form") else f' {r.choice(["class", "id"])}="{mark}"'
            if kind == "nav" or (kind in ("share", "aside") and r.random() < 0.6):
                items = [f"<li>{put(' '.join(word() for _ in range(r.randint(1, 3))), 0, 'a', ' href=\"/x\"')}</li>" for _ in range(r.randint(2, 7))]
                return f"<{tag}{attrs}>" + (f"<ul>{''.join(items)}</ul>" if tag != "ul" else "".join(items)) + f"</{tag}>"
            if kind == "form":
                return f"<form{attrs}>{put(sentence(1, 5), 0, 'label')}<input name=q>{put(word(), 0, 'button')}</form>"
            if kind == "footer":
                return f"<{tag}{attrs}>{put('© ' + word() + '.example.com · ' + sentence(), 0, r.choice(['', 'p', 'div']))}</{tag}>"
            if kind == "comment":
                items = [put(word(), 0, "h3")] + [put(sentence(3, 40), 0, r.choice(["p", "li", "div"])) for _ in range(r.randint(1, 4))]
                return f"<{tag}{attrs}>{''.join(items)}</{tag}>"
            return f"<{tag}{attrs}>{put(sentence(1, 30), 0, '' if tag == 'p' else r.choice(['', 'p', 'span']))}</{tag}>"

        for kind in ("header", "nav", "notice", "ad", "form"):
            if r.random() < {"nav": 0.8, "ad": 0.6}.get(kind, 0.35):
                html.append(other(kind))
        mark = r.choice(_MAIN.split())
        tag = r.choice(["article", "article", "main", "div", "section"])
        attrs = f' {r.choice(["class", "id"])}="{mark}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        body = [put(junk_words(sentence(2, 10)), 1, r.choice(["h1", "h2"]))] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.08:  # legal lines may belong to an article
                body.append(put(r.choice(["All rights reserved.", f"Copyright {word()}.", f"© {word()}, all rights reserved.", "Cookies and how to subscribe."]), 1, "p"))
            elif kind < 0.8:
                body.append(put(junk_words(" ".join(sentence() for _ in range(r.randint(1, 6)))), 1, r.choice(["p", "p", "p", "div"])))
            elif kind < 0.86:
                body.append("<ul>" + "".join(put(sentence(2, 9), 1, "li") for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                body.append(put(sentence(2, 8), 1, r.choice(["h2", "h3", "blockquote"])))
            else:
                body.append(other(r.choice(["ad", "aside", "share", "notice", "form"])))
        if r.random() < 0.25:
            body.append(other("comment"))
        wrap = r.random() < 0.3
        html.append("<main>" * wrap + f"<{tag}{attrs}>{''.join(body)}</{tag}>" + "</main>" * wrap)
        for kind in ("comment", "aside", "share", "ad", "notice", "form", "footer"):
            if r.random() < (0.8 if kind == "footer" else 0.3):
                html.append(other(kind))
        page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(html)}"
        pages.append((page + r.choice(["</body></html>", "</body></html>", ""]), truth))
    return pages


def _aligned(page: str, truth: list[tuple[str, int]]) -> tuple[list[Block], list[int]] | None:
    blocks = leaf_blocks(page)
    if [b.text for b in blocks] != [" ".join(t.split()) for t, _ in truth]:
        return None
    return blocks, [y for _, y in truth]


def _by_markup(page: str) -> tuple[list[Block], list[int]]:
    """Labels of a page that marks its article, for training."""
    blocks = leaf_blocks(page)
    other = {w for words in _OTHER.values() for x in words.split() for w in _WORD.findall(x)}
    label = lambda b: int("article" in b.path and not {"nav", "aside", "footer", "form"} & set(b.path) and not other & b.marks)
    return blocks, [label(b) for b in blocks]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> Chain:
    """The chain fitted to made-up pages and to at most ``sample`` pages that mark an article.

    These have fewer than ``longest`` characters and the smallest hashes.  Hashes are cut
    at a threshold that leaves about four times the sample, so what reaches the driver
    does not grow with the pages or the tasks.
    """
    made = [a for a in (_aligned(p, t) for p, t in labelled_pages()) if a]
    marked = pages.select(F.xxhash64(F.col(id_col).cast("string"), F.col(html_col).cast("string")).alias("h"), F.col(html_col).cast("string").alias("html"))
    marked = marked.where(F.col("html").contains("<article") & (F.length("html") < longest))
    share = min(1.0, 4 * sample / max(1, marked.count()))
    few = marked.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    drawn = sorted({(r["h"], r["html"]) for r in few.orderBy("h").limit(sample).collect()})
    return fit(made + [_by_markup(html) for _, html in drawn])


def extract(pages: DataFrame, chain: Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per row of ``pages``.

    Null or empty html, and pages without main text, give an empty text.  Html is read
    whole and may be broken off anywhere.  Null ids and urls stay null, repeated rows are
    extracted each, other columns are ignored, an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in small_batches(batches, 4 << 20, "html"):
            texts = [chain.main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumnRenamed("id", "page_id")
