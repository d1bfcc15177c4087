"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant tokenizer walks the page with a stack of open elements and cuts it into leaf blocks: runs of
text between block-level tags. Each block has binned features of its text (length, link density, marks,
digits, place in the page) and of its ancestors (tags, and words of their class, id and role). A two-state
chain, fitted by maximum likelihood on labelled pages, decodes each page by Viterbi; blocks decoded as
main text are joined by newlines. The labelled pages are made by ``labelled_pages``: layouts with known
blocks, drawn from a fixed seed, so training needs no table and takes seconds on the driver.

Scripts, styles, templates, frames, vector graphics, comments, form controls and the head are no blocks
at all. Character references are decoded, white space inside a block becomes one space, nothing is cut.

Defined cases: a null, empty or text-free page gives an empty text; markup left open is closed by the
page's end, as is a script, whose end tag alone closes it; stray end tags are passed over; of elements
nested deeper than 512 levels the innermost are taken as siblings, text and all; a table with other
columns keeps its id and url only.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea title iframe svg".split())
_DEEPEST = 512
_HIDDEN = frozenset("head select option optgroup button datalist input label".split())
# possessive throughout, so a page is read in time in proportion to its length; a quote opens a value only after "=", and one
# without an end is a character like any other
_TOKEN = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_CLOSE = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.I) for t in (*_RAW, "xmp")}
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMING = frozenset("class id role itemprop".split())
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_HINT = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Words of class, id and role attributes, by what they tell.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs tabs toolbar pagination pager toc skip",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer bottom colophon copyright legal contentinfo",
    "side": "aside sidebar side rail widget related recommended popular trending complementary promo teaser newsletter",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promoted dfp adsense",
    "note": "cookie cookies consent notice gdpr privacy alert modal popup overlay dialog banner paywall subscribe",
    "talk": "comment comments reply replies discussion disqus respond responses review reviews thread",
    "share": "share sharing social follow tweet facebook meta byline tags tag author",
    "form": "form search login signin signup register input",
    "main": "article content main post entry story body text prose markdown articlebody maincontent",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}


@dataclass
class Block:
    text: str
    tag: str
    tags: frozenset[str]
    hints: frozenset[str]
    linked: int


def _hints(attrs: str) -> frozenset[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        name = m[1].lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            found.add("hidden")
        elif name in _NAMING:
            found.update(_HINT_OF[w] for w in _HINT.findall(value) if w in _HINT_OF)
    return frozenset(found)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in document order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], frozenset[str], frozenset[str]]] = []  # tag, its hints, tags and hints down to it
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = hidden = links = 0
    at, end = 0, len(page)
    none: frozenset[str] = frozenset()

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                tag, _, tags, hints = stack[-1] if stack else ("", none, none, none)
                out.append(Block(line, tag, tags, hints, min(linked, len(line))))
            text.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal hidden, links
        for tag, hints, _, _ in stack[k:]:
            opened[tag] -= 1
            hidden -= tag in _HIDDEN or "hidden" in hints
            links -= tag == "a"
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            got = html.unescape(raw) if "&" in raw else raw
            text.append(got)
            if links:
                linked += len(got.strip())

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in _BLOCK and stack[k][0] in _BLOCK:
                    break
            continue
        if tag in _RAW:
            close = _CLOSE[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag == "xmp":
            close = _CLOSE[tag].search(page, at)
            flush()
            if not hidden:
                text.append(page[at : close.start() if close else end])
            flush()
            at = close.end() if close else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in _P_CLOSERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same:
                        pop(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "tr", "menu") and stack[k][0] != tag:
                        break
        if tag == "body":
            pop(next((k for k, x in enumerate(stack) if x[0] == "head"), len(stack)))
        if tag in _VOID or (tag not in _BLOCK and m[3].endswith("/")):
            continue
        if len(stack) >= _DEEPEST:
            pop(_DEEPEST - 1)
        hints = _hints(m[3]) if m[3] else none
        _, _, tags, all_hints = stack[-1] if stack else ("", none, none, none)
        stack.append((tag, hints, tags if tag in tags else tags | {tag}, all_hints if hints <= all_hints else all_hints | hints))
        opened[tag] += 1
        hidden += tag in _HIDDEN or "hidden" in hints
        links += tag == "a"
    flush()
    return out


_PRONE = re.compile(r"cookie|privacy|consent|subscribe|sign (?:in|up)|log ?in|all rights reserved|copyright|©|advertis|sponsored|comments?\b|repl(?:y|ies)|share|follow us|newsletter|terms of|read more|related", re.I)


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of each block of one page."""
    n = len(found)
    total = sum(len(b.text) for b in found) or 1
    out = []
    for k, b in enumerate(found):
        size = len(b.text)
        words = b.text.count(" ") + 1
        f = [f"len{min(size.bit_length(), 11)}", f"words{min(words.bit_length(), 8)}", f"link{round(3 * b.linked / size)}", f"tag:{b.tag}", f"end:{b.text[-1] in '.!?。”'}", f"place{4 * k // n}", f"share{min(3, int(10 * size / total))}"]
        f += [f"in:{t}" for t in b.tags]
        f += [f"hint:{h}" for h in b.hints]
        if not b.hints & {"nav", "head", "foot", "side", "ad", "note", "talk", "share", "form", "hidden"} and not {"nav", "header", "footer", "aside", "form"} & b.tags:
            f.append("plain")
        if size < 400 and _PRONE.search(b.text):
            f.append(f"prone{min(2, size // 120)}")
        if size < 80 and b.text[:1] in "©|»•":
            f.append("mark")
        f.append("bias")
        out.append(f)
    return out


@dataclass
class Model:
    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 2))
        for k, r in enumerate(rows):
            at = [self.names[x] for x in r if x in self.names]
            out[k] = self.weights[at].sum(axis=0)
        return out


def viterbi(emit: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best state sequence of a two-state chain; ties go to state 0."""
    if not len(emit):
        return []
    (m00, m01), (m10, m11) = moves.tolist()
    a, b = emit[0].tolist()
    back = []
    for e0, e1 in emit[1:].tolist():
        f0, f1 = b + m10 > a + m00, b + m11 > a + m01
        a, b = (b + m10 if f0 else a + m00) + e0, (b + m11 if f1 else a + m01) + e1
        back.append((f0, f1))
    state = int(b > a)
    path = [state]
    for f in reversed(back):
        state = int(f[state])
        path.append(state)
    return path[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[list[tuple[list[str], int]]], steps: int = 40, l2: float = 1e-3) -> Model:
    """Maximum-likelihood weights from pages of (features, label) blocks, by forward-backward and Adagrad."""
    names: dict[str, int] = {}
    data = []
    for page in pages:
        if page:
            data.append(([[names.setdefault(x, len(names)) for x in f] for f, _ in page], np.array([y for _, y in page])))
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    flat = [(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.array(r) for r in rows])) for rows, _ in data]
    for _ in range(steps):
        dw, dt = l2 * w, l2 * t
        for (rows, y), (at, idx) in zip(data, flat, strict=True):
            n = len(rows)
            emit = np.zeros((n, 2))
            np.add.at(emit, at, w[idx])
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = emit[0]
            for k in range(1, n):
                alpha[k] = emit[k] + _log_sum(alpha[k - 1][:, None] + t, 0)
            for k in range(n - 2, -1, -1):
                beta[k] = _log_sum(t + (emit[k + 1] + beta[k + 1])[None, :], 1)
            z = _log_sum(alpha[-1], 0)
            err = np.exp(alpha + beta - z)
            err[np.arange(n), y] -= 1
            np.add.at(dw, idx, err[at] / len(data))
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + t + (emit[1:] + beta[1:])[:, None, :] - z).sum(0)
                np.add.at(pair, (y[:-1], y[1:]), -1)
                dt = dt + pair / len(data)
        gw += dw * dw
        gt += dt * dt
        w -= 0.3 * dw / np.sqrt(gw)
        t -= 0.3 * dt / np.sqrt(gt)
    return Model(names, w, t)


def labelled_pages(count: int = 140, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Made-up pages in many layouts with the texts of their main blocks."""
    rng = random.Random(seed)
    syllables = "ka lo mi ter na shi or en ve du pra sto li ga él be ño ru zen thä qui".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def line(a: int, b: int, stop: str = ".") -> str:
        got = " ".join(word() for _ in range(rng.randint(a, b)))
        return got[:1].upper() + got[1:] + stop

    def para() -> str:
        if rng.random() < 0.25:
            return line(1, 3, rng.choice((".", ".", ",", "")))
        return " ".join(line(1, 16) for _ in range(rng.choice((1, 1, 2, 3, 5, 8))))

    def junk(kind: str) -> str:
        wrap = {
            "nav": ["<nav><ul>{items}</ul></nav>", '<div class="menu"><ul>{items}</ul></div>', '<ul id="navigation">{items}</ul>', '<div role="navigation">{items}</div>', '<div class="breadcrumbs">{links}</div>'],
            "head": ["<header><div class=logo>{short}</div>{links}</header>", '<div id="masthead"><p>{short}</p></div>', "<header><p>{line}</p><nav>{links}</nav></header>"],
            "foot": ["<footer>&copy; {short} &middot; {line}</footer>", '<div class="footer"><p>{line}</p><p>{links}</p></div>', '<footer><p>All rights reserved. {line}</p></footer>', "<footer><ul>{items}</ul><p>{para}</p></footer>"],
            "side": ["<aside><h3>{short}</h3><ul>{items}</ul></aside>", '<div class="sidebar"><h2>Related</h2><p>{line}</p>{links}</div>', '<aside><p>{para}</p></aside>', '<div id="related"><p>{line}</p><p>{line}</p></div>'],
            "ad": ['<div class="ad">{line}</div>', '<div class="advert"><p>{para}</p></div>', '<p class="sponsored">{line} {line}</p>', '<div id="ads-top"><a href="/x">{line}</a></div>', '<section class="promo ad"><h4>{short}</h4><p>{line}</p></section>'],
            "note": ['<div class="cookie-notice"><p>We use cookies. {line}</p><button>OK</button></div>', '<div role="dialog" class="consent">{para}</div>', '<div class="notice">{line} {line}</div>', '<div id="gdpr"><p>{line}</p></div>'],
            "form": ["<form><p>{line}</p><input name=q><button>{short}</button></form>", '<form class="newsletter"><h3>Subscribe</h3><p>{line}</p><input></form>', '<form><label>{short}</label><select><option>{short}</option></select></form>'],
            "talk": ['<section class="comments"><h3>Comments</h3><div class="comment"><p>{para}</p></div><div class="comment"><p>{line}</p></div></section>', '<div id="comments"><ol><li><p>{para}</p></li><li><p>{line}</p></li></ol></div>', '<div class="discussion"><p>{para}</p><p>{para}</p></div>'],
            "share": ['<div class="share"><a href="#">{short}</a> <a href="#">{short}</a></div>', '<ul class="social">{items}</ul>'],
        }[kind]
        links = " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(rng.randint(2, 7)))
        items = "".join(f'<li><a href="/{word()}">{line(1, 3, "")}</a></li>' for _ in range(rng.randint(2, 8)))
        return rng.choice(wrap).format(links=links, items=items, short=line(1, 3, ""), line=line(3, 14), para=para())

    made = []
    for _ in range(count):
        main: list[str] = []

        def own(shape: str) -> str:
            text = para() if "<p" in shape or "pre" in shape or "quote" in shape else line(2, 10, rng.choice(("", ".")))
            main.append(text)
            inner = text
            if rng.random() < 0.2:
                k = text.find(" ")
                inner = f"<{(t := rng.choice(('b', 'em', 'a href=/y', 'strong')))}>{text[:k]}</{t.split()[0]}>{text[k:]}" if k > 0 else text
            return shape.format(inner)

        body = [own(rng.choice(("<h1>{}</h1>", "<h1 class=title>{}</h1>", "<h2>{}</h2>")))]
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12))):
            body.append(own(rng.choice(("<p>{}</p>",) * 6 + ("<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<li>{}</li>", "<pre>{}</pre>", "<td>{}</td>", "<figcaption>{}</figcaption>"))))
            if rng.random() < 0.15:
                body.append(junk(rng.choice(("ad", "side", "share", "form", "note"))))
        inside = [junk("talk")] if rng.random() < 0.3 else []
        holder = rng.choice(("<article>{}</article>",) * 4 + ("<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', "<main><article>{}</article></main>", "<div>{}</div>", '<section class="entry">{}</section>', "<article class=post><div>{}</div></article>"))
        article = holder.format("".join(body + inside))
        before = [junk(k) for k in ("head", "nav", "note", "ad") if rng.random() < 0.6]
        after = [junk(k) for k in ("talk", "side", "form", "share", "ad", "note") if rng.random() < 0.3] + ([junk("foot")] if rng.random() < 0.9 else [])
        rng.shuffle(before)
        made.append((f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{article}{''.join(after)}</body></html>", main))
    return made


def train(pages: list[tuple[str, list[str]]] | None = None) -> Model:
    """A model from (html, texts of the main blocks) pages; without any, from ``labelled_pages``."""
    rows = []
    for page, main in labelled_pages() if pages is None else pages:
        found = blocks(page)
        wanted = [_SPACE.sub(" ", html.unescape(m)).strip() for m in main]
        labels, k = [], 0
        for b in found:
            hit = k < len(wanted) and b.text == wanted[k]
            labels.append(int(hit))
            k += hit
        rows.append(list(zip(features(found), labels, strict=True)))
    return fit(rows)


def extract(model: Model, page: str | None) -> str:
    """Main text of one page."""
    found = blocks(page or "")
    if not found:
        return ""
    path = viterbi(model.emissions(features(found)), model.moves)
    return "\n".join(b.text for b, s in zip(found, path, strict=True) if s)


def extract_table(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                text = [extract(shared.value, x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
